"""Document fingerprints by one-permutation MinHash.

Each word shingle of a text is hashed once. The high bits of a hash choose one of ``bins`` bins, and a bin keeps
its smallest hash. An empty bin takes the value of another bin: each bin has an order of all bins, drawn once and
the same for all texts, and the first bin of it that isn't empty lends its value (optimal densification: every
filled bin is equally likely). Of each bin the ``bits`` low-order bits are packed. Two fingerprints' share of equal
bins, corrected for bins that are equal by chance, estimates the Jaccard likeness of the shingle sets.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import texts_of
from .simhash import shingle_hashes

BINS, BITS, WORDS, SEED = 256, 8, 5, 42


@lru_cache(maxsize=2)
def _orders(bins: int, seed: int = 17) -> np.ndarray:
    """For each bin the place of every bin in its order of lenders."""
    rng = np.random.default_rng(seed)
    return np.argsort(rng.random((bins, bins)), axis=1).argsort(axis=1).astype(np.int32)


def bin_values(hashes: np.ndarray, bins: int = BINS) -> np.ndarray:
    """The value of each bin: its smallest hash, or that of the bin which lends to it. Of no hashes there are none."""
    hashes = np.sort(hashes)
    if not len(hashes):
        return hashes
    bin_of = (hashes >> np.uint64(64 - (bins.bit_length() - 1))).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bin_of[1:] != bin_of[:-1]])
    filled, values = bin_of[first], np.zeros(bins, np.uint64)
    values[filled] = hashes[first]
    empty = np.setdiff1d(np.arange(bins), filled, assume_unique=True)
    if len(empty):
        values[empty] = values[filled[_orders(bins)[empty][:, filled].argmin(axis=1)]]
    return values


def packed_bins(text: str, bins: int = BINS, bits: int = BITS, words: int = WORDS, seed: int = SEED) -> bytes:
    """The fingerprint as bytes; empty for a text without words."""
    values = bin_values(shingle_hashes(text, words, seed), bins)
    if not len(values):
        return b""
    return np.packbits((values[:, None] >> np.arange(bits, dtype=np.uint64) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little").tobytes()


def likeness(a: bytes, b: bytes, bins: int = BINS, bits: int = BITS) -> float:
    """The estimated Jaccard likeness, 0 to 1: the share of equal bins, without those that chance makes equal.

    Two texts without words are alike (1); one without words is unlike any other (0).
    """
    if not a or not b:
        return float(a == b)
    x, y = (np.unpackbits(np.frombuffer(v, np.uint8), bitorder="little")[: bins * bits].reshape(bins, bits) for v in (a, b))
    equal, chance = (x == y).all(axis=1).mean(), 0.5**bits
    return float(min(1.0, max(0.0, (equal - chance) / (1 - chance))))


def fingerprint(text: Column, bins: int = BINS, bits: int = BITS, words: int = WORDS) -> Column:
    """The packed fingerprint of a text, binary; empty for null, empty and blank texts."""
    if bins & (bins - 1) or bins < 2 or not 1 <= bits <= 32:
        raise ValueError("bins must be a power of two, and bits 1 to 32")

    @F.arrow_udf("binary")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array((packed_bins(t, bins, bits, words) for t in texts_of(texts)), pa.binary())

    return of(text)


def likeness_of(left: Column, right: Column, bins: int = BINS, bits: int = BITS) -> Column:
    """:func:`likeness` of two columns of fingerprints; null if either is null."""

    @F.arrow_udf("double")
    def of(a: pa.Array, b: pa.Array) -> pa.Array:
        pairs = ((x.as_py(), y.as_py()) for x, y in zip(a, b))
        return pa.array((None if x is None or y is None else likeness(x, y, bins, bits) for x, y in pairs), pa.float64())

    return of(left, right)


# --- each document beside the next one ----------------------------------------------------------------------------

#: A document's place: rows without an id come first, then by id, then by the digest of the text.
PLACE = ["_has_id", "_id", "_digest"]


def placed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and the columns of PLACE. Whole numbers are ordered as such, other ids by their text."""
    text, kind = F.coalesce(F.col("text"), F.lit("")), docs.schema["doc_id"].dataType
    number = isinstance(kind, T.IntegralType)
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)) if number else F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.col("doc_id").isNotNull().alias("_has_id"), key.alias("_id"), F.xxhash64(text).alias("_digest"))


def _splits(places: DataFrame, parts: int) -> list:
    """The first place of each of about ``parts`` equal ranges: one row of three values each comes to the driver."""
    ranged = places.repartitionByRange(parts, *PLACE).select(F.struct(*PLACE).alias("place"), F.spark_partition_id().alias("part"))
    return sorted(r["first"] for r in ranged.groupBy("part").agg(F.min("place").alias("first")).collect())


def each_with_next(docs: DataFrame, shards: int, of: Callable[[str, str], tuple], fields: dict[str, str]) -> DataFrame:
    """doc_id and the values that ``of`` makes of each row's text and the next row's, in order of doc_id.

    The row after the last is the first. Rows without an id come first, ids that aren't whole numbers are ordered
    by their text, and rows of one id follow each other by the digest of their texts, so the order is the same in
    every run up to rows that are equal anyway. A single row is its own next. ``of`` is called in the order of the
    rows. ``fields`` names the values and their types.

    One shuffle of texts: every part of the order also gets the first row of the part after it.
    """
    # several parts for each shard, which even out where the parts' hashes meet
    rows, shards = placed(docs), 4 * shards
    splits = _splits(rows.select(*PLACE), shards)
    # a row's part by bisection of a literal table: the last split that isn't behind its place
    kind = rows.select(F.struct(*PLACE).alias("p")).schema["p"].dataType
    table = F.from_json(F.lit(json.dumps([r.asDict() for r in splits])), T.ArrayType(kind))
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(max(1, len(splits).bit_length())))))
    place = F.struct(*PLACE)
    part = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(table, at + step) <= place, at + step).otherwise(at))
    # the first row of a part also goes to the part before it, that of the first part to the last
    spread = rows.withColumn("_part", part).withColumn("_host", F.when(F.get(table, F.col("_part")) == place, F.when(F.col("_part") > 0, F.col("_part") - 1).otherwise(max(0, len(splits) - 1))))
    own, guest = (F.struct(F.col(c).alias("part"), F.lit(g).alias("guest")) for g, c in enumerate(("_part", "_host")))
    spread = spread.withColumn("_at", F.explode(F.when(F.col("_host").isNull(), F.array(own)).otherwise(F.array(own, guest))))
    # by part, the guests of a part behind its own rows
    spread = spread.select("doc_id", "text", "_at.part", "_at.guest", *PLACE).repartition(shards, "part").sortWithinPartitions("part", "guest", *PLACE).select("doc_id", "text", "part", "guest")
    kind, out = docs.schema["doc_id"].dataType, list(fields)

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # part, id and text of the row before, and whether it was a guest
        for batch in batches:
            ids, values = [], []
            for doc, text, part, guest in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                text = text.as_py()
                if held is not None and held[0] == part and not held[3]:
                    ids.append(held[1])
                    values.append(of(held[2], text))
                held = (part, doc.as_py(), text, bool(guest))  # of equal guests the first one is used
            if ids:
                arrow = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64()}
                columns = [pa.array([v[i] for v in values], arrow[fields[name]]) for i, name in enumerate(out)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), *columns], names=["doc_id", *out])

    return spread.mapInArrow(paired, ", ".join([f"doc_id {kind.simpleString()}", *(f"{k} {v}" for k, v in fields.items())]))


def compare_with_next(docs: DataFrame, bins: int = BINS, bits: int = BITS, words: int = WORDS, shards: int | None = None) -> DataFrame:
    """For each row of ``docs``, with the next row in order of doc_id (after the last: the first):

    doc_id, n_chars (code points), edited_sha256 (of the text whose last half, rounded down, gave way to as many
    first code points of the next text, or all of it), fingerprint and edited_fingerprint (lower-case hex),
    near_edited and near_next (likeness of the fingerprint to the edited text's and the next text's).

    Null texts count as empty; texts without words have an empty fingerprint. Ids may be of any type. Repeated
    rows and rows with a null id stay; their places are those of :func:`each_with_next`. An empty table gives no
    rows. Other columns are neither read nor returned.
    """
    if shards is None:
        shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    known: list = [None, b""]  # the next text is the next call's own

    def compared(text: str, following: str) -> tuple:
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        own = known[1] if known[0] == text else packed_bins(text, bins, bits, words)
        new, other = (packed_bins(t, bins, bits, words) for t in (edited, following))
        known[:] = following, other
        digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        return len(text), digest, own.hex(), new.hex(), likeness(own, new, bins, bits), likeness(own, other, bins, bits)

    fields = {"n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"}
    return each_with_next(docs.select("doc_id", "text"), shards, compared, fields)
