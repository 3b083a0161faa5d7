"""Token counts through a digest cache.

A text's key is the digest of its normalised content together with the digest of the tokenizer's file. Keys
that the cache has take their count from there; of the others each distinct one is encoded once and appended.
"""

from __future__ import annotations

import hashlib
import json
import os
from functools import lru_cache

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, texts_of

CACHE_SCHEMA = "content_digest string, tokenizer_digest string, n_tokens bigint"


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


@lru_cache(maxsize=2)
def _counter(path: str):
    """A function from texts to token counts, by the library that the file belongs to."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
    if path.endswith(".model"):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in processor.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def count_tokens(text: Column, path: str) -> Column:
    @F.arrow_udf("bigint")
    def counts(texts: pa.Array) -> pa.Array:
        count, out, batch, size = _counter(path), [], [], 0
        for t in texts_of(texts):  # few texts at a time: encodings are much larger than texts
            batch.append(t)
            size += len(t)
            if size > 200_000 or len(batch) == 256:
                out += count(batch)
                batch, size = [], 0
        return pa.array(out + (count(batch) if batch else []), pa.int64())

    return counts(text)


@lru_cache(maxsize=8)
def drops_runs_of_space(path: str) -> bool:
    """Whether the tokenizer makes one space of each run of white space before anything else can see the run.

    So it is with a .json file whose normaliser has that replacement behind steps that leave ASCII white space
    alone, and whose added tokens hold no white space.
    """
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    flat = lambda n: [x for y in n["normalizers"] for x in flat(y)] if n["type"] == "Sequence" else [n]
    if any(c.isspace() for t in file.get("added_tokens") or () for c in t["content"]):
        return False
    for step in flat(file["normalizer"]) if file.get("normalizer") else ():
        if step["type"] == "Replace" and step["pattern"] == {"Regex": r"\s+"} and step["content"] == " ":
            return True
        if step["type"] not in ("NFC", "NFD", "NFKC", "NFKD", "Lowercase"):
            return False
    return False


def normalised(text: Column, path: str) -> Column:
    """What the key is made of: texts of equal normalised content have equal counts.

    Null is the empty text. Runs of white space become one space where the tokenizer does the same.
    """
    text = F.coalesce(text, F.lit(""))
    return F.regexp_replace(text, r"[ \t\r\n]{2,}|[\t\r\n]", " ") if drops_runs_of_space(path) else text


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        spark.createDataFrame([], CACHE_SCHEMA).write.mode("ignore").parquet(cache)
        return spark.read.schema(CACHE_SCHEMA).parquet(cache)


def token_counts(docs: DataFrame, path: str, cache: str, limit: int = 2048, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) for each row of ``docs``.

    ``cache``: a folder of Parquet files that all executors reach; made if missing. Two writers that append the
    same key do no harm, as equal keys have equal counts. A null text counts as the empty text (0 tokens);
    repeated rows and null ids stay. Other columns are neither read nor returned.
    """
    spark, version = docs.sparkSession, tokenizer_digest(path)
    digest = F.sha2(normalised(F.col(text_column), path), 256)
    texts = docs.select(digest.alias("content_digest"), F.coalesce(F.col(text_column), F.lit("")).alias("content"))
    # one text for each digest, so copies are dropped before the shuffle
    distinct = texts.groupBy("content_digest").agg(F.first("content").alias("content"))
    stored = read_cache(spark, cache).where(F.col("tokenizer_digest") == version)
    misses = distinct.join(stored, "content_digest", "left_anti")
    misses.select("content_digest", F.lit(version).alias("tokenizer_digest"), count_tokens(F.col("content"), path).alias("n_tokens")).write.mode("append").parquet(cache)
    # written, so that the join has a plain shuffle on either side and can split a digest that many rows have
    counts = materialise(read_cache(spark, cache).where(F.col("tokenizer_digest") == version).groupBy("content_digest").agg(F.first("n_tokens").alias("n_tokens")), "token-counts-known")
    keyed = docs.select(id_column, F.octet_length(F.coalesce(F.col(text_column), F.lit(""))).cast("bigint").alias("n_bytes"), digest.alias("content_digest"))
    return keyed.join(counts, "content_digest").select(id_column, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
