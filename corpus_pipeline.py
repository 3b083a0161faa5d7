"""The corpus pipeline: stages from raw documents to token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.llm import alike, bpe, decontamination, quality, secrets
from tidebook.llm.common import free_name, materialise
from tidebook.llm.queries import tokenizer_path


#: Rows that a job of this pipeline hands to Python at once: documents are long, and workers hold a few such batches.
BATCH_ROWS = 500
#: Characters of a plan that the driver writes down and keeps: the encoding's holds its ranks, two megabytes, several times.
PLAN_CHARS = 100_000


def hand_over_few_rows(spark: SparkSession) -> None:
    """Sets the session's batches. A stage's rows are computed when they are written, which is after the stage has
    returned, so the setting can't be taken back here: it holds for the session from then on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def keep_short_plans(spark: SparkSession) -> None:
    """Sets the session's plan descriptions, which the driver keeps for every query; it holds from then on likewise."""
    spark.conf.set("spark.sql.maxPlanStringLength", PLAN_CHARS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier, trained on the labels that aren't held out, doesn't reject.

    Null and empty texts stand or fall with the empty text's score; repeated rows and null ids are judged like
    others; an empty table stays empty. Other columns pass through.
    """
    hand_over_few_rows(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the benchmark's passages; those of which more than half is benchmark go.

    Null and empty texts, repeated rows and null ids stay as they are; ``n_chars`` follows the text.
    """
    hand_over_few_rows(spark)
    return decontamination.remove_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest id, of each group that is linked by texts at least 0.8 alike.

    Likeness is the exact Jaccard likeness of five-word shingle sets. Null, empty and blank texts are alike. Of
    repeated rows one stays; rows without an id stay only where no row of their group has one.
    """
    hand_over_few_rows(spark)
    return alike.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, the secrets in their texts replaced by a mark; ``n_chars`` follows the text.

    Null and empty texts, repeated rows and null ids stay as they are.
    """
    hand_over_few_rows(spark)
    return secrets.redact(docs, secrets.fit_forest(dictionary_path=tokenizer_path("byte_bpe_50k.tiktoken")), path_column="source")


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars and token_ids of each document; an error if ids don't decode to their text.

    Null and empty texts have no ids; repeated rows and null ids stay; an empty table gives no rows.
    """
    hand_over_few_rows(spark)
    keep_short_plans(spark)
    path = tokenizer_path("byte_bpe_50k.tiktoken")
    digest = lambda text: F.unhex(F.sha2(text, 256))
    # the digest of a document's text is carried until its ids are decoded
    before, after = free_name(docs.columns, "_text_digest"), free_name(docs.columns, "_decoded")
    encoded = bpe.encode(docs.withColumn(before, digest(F.coalesce("text", F.lit("")).cast("binary"))), path, out="token_ids")
    return decoded_alike(encoded.withColumn(after, digest(bpe.decode(F.col("token_ids"), path))), before, after).drop(before, after)


def decoded_alike(encoded: DataFrame, before: str, after: str) -> DataFrame:
    """The same rows; those whose ids decode to another text (by the digests in two columns) raise an error once they are read."""
    wrong = F.raise_error(F.concat(F.lit("ids of document "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(" don't decode to its text")))
    return encoded.withColumn("token_ids", F.when(F.col(after) == F.col(before), F.col("token_ids")).otherwise(wrong.cast(encoded.schema["token_ids"].dataType)))


STAGES = [
    ("quality", keep_quality),
    ("near-duplicates", keep_one_of_near_duplicates),
    ("decontamination", remove_benchmark),
    ("secrets", redact_secrets),
    ("encoding", encode_bytes),
]

#: Quality, secrets and encoding can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
