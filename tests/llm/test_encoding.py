"""The encoding stage decodes what it encodes, and its blocks are bounded in rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

import corpus_pipeline
from tests.conftest import SF
from tests.llm.test_operators import odd
from tidebook.llm import bpe
from tidebook.llm.queries import tokenizer_path


def test_ids_are_decoded(spark, monkeypatch):
    docs, real = odd(spark), bpe.encode
    assert len(corpus_pipeline.encode_bytes(spark, docs, SF).collect()) == docs.count()

    def damaged(*args, **kwargs):
        ids = F.col("token_ids")
        return real(*args, **kwargs).withColumn("token_ids", F.when(F.size(ids) > 1, F.slice(ids, 1, F.size(ids) - 1)).otherwise(ids))

    monkeypatch.setattr(bpe, "encode", damaged)
    with pytest.raises(Exception, match="decode to its text"):
        corpus_pipeline.encode_bytes(spark, docs, SF).collect()


def test_blocks_of_empty_texts_are_bounded(spark):
    docs = spark.range(3000).select(F.when(F.col("id") % 2 == 0, "").alias("text")).coalesce(1)
    kind = T.StructType([T.StructField(bpe.BLOCK, T.LongType()), T.StructField(bpe.PART, T.IntegerType()), T.StructField(bpe.ROW, T.IntegerType()), T.StructField(bpe.COUNT, T.IntegerType()), T.StructField(bpe.DATA, T.BinaryType())])
    coded = docs.mapInArrow(bpe._coded(tokenizer_path("byte_bpe_50k.tiktoken"), "text", [], to_arrow_schema(kind), 6400), kind)
    rows = [r[1] for r in coded.groupBy(bpe.BLOCK).count().collect()]
    assert sum(rows) == 3000 and max(rows) <= 100


def test_fold_takes_signed_bytes(spark):
    """Words reach the fold as arrays of signed bytes; it gives what the heap gives."""
    path = tokenizer_path("byte_bpe_50k.tiktoken")
    words = [b"", b"q", b"\xff", " überzeugendst".encode(), b" unquestioningly42", "тест漢字".encode(), bytes(range(120, 184))]
    signed = [[b - 256 if b > 127 else b for b in w] for w in words]
    frame = spark.createDataFrame(list(enumerate(signed)), "n int, w array<tinyint>")
    got = {r.n: r.ids for r in frame.select("n", bpe.merged_bytes(F.col("w"), path).alias("ids")).collect()}
    assert got == {n: bpe.merged_long(w, bpe.read_ranks(path)) for n, w in enumerate(words)}
