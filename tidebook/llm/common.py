"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Bytes of a word after lower-casing A-Z: digits, a-z and everything outside ASCII; the rest separates words.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(column, ASCII_UPPER, ASCII_UPPER.lower())


def free_name(columns: Iterable[str], name: str) -> str:
    """``name``, or the first of ``name_``, ``name__``, ... that is none of ``columns`` in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def column(name: str) -> Column:
    """The column of exactly this name, also if it holds dots or backticks."""
    return F.col(f"`{name.replace('`', '``')}`")


def only(frame: DataFrame, columns: Iterable[str]) -> DataFrame:
    return frame.select(*map(column, columns))


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is what the cluster names in ``spark.checkpoint.dir``. Only a session of a single machine, as in tests,
    may leave that unset; a temporary folder is used then. On a cluster executors would not see each other's
    files there, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext.getCheckpointDir()
        if held is None:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidebook-"))
            held = spark.sparkContext.getCheckpointDir()
        root = held
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def delete_path(spark: SparkSession, path: str) -> None:
    fs, at = _file_system(spark, path)
    fs.delete(at, True)


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Intermediate files go when the driver's JVM ends; results that read them must be written before."""
    fs, at = _file_system(spark, path)
    fs.deleteOnExit(at)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that run within hand at most so many rows at once to Python; texts are long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """Jobs that run within leave no shuffle files behind; else these stay until the driver collects its garbage.

    No frame with a shuffle may be run twice within, other than as part of another frame.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def release() -> None:
    """Gives the memory of freed objects back to the system; workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # another C library keeps it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def materialise(frame: DataFrame, name: str, bucket: str | None = None) -> DataFrame:
    """Write a frame to the shared folder and read it back, which cuts its lineage for good.

    The files are deleted when the driver ends. With ``bucket`` the rows are filed by that column, so that grouping by it needs no shuffle.
    """
    spark = frame.sparkSession
    path = shared_path(spark, name)
    if bucket is None:
        frame.write.parquet(path)
        delete_at_exit(spark, path)
        return spark.read.schema(frame.schema).parquet(path)
    table = path.rpartition("/")[2].replace("-", "_")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    frame.write.bucketBy(n, bucket).format("parquet").option("path", path).saveAsTable(table)
    delete_at_exit(spark, path)
    held = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # only its name: the files lie in the shared folder
    return held


def held_out(id_column: str) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text is a multiple of five.

    A null id counts as the empty text.
    """
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit(""))) % 5 == 0


def label_odds(labels: DataFrame, target: str) -> float:
    """Log odds of label 1 over all rows that may be learned from (one of each class is added)."""
    y = F.when(~held_out("doc_id"), F.col(target))
    n1, n0 = labels.agg(F.count_if(y == 1), F.count_if(y == 0)).first()
    return float(np.log((n1 + 1) / (n0 + 1)))


def first_by_hash(frame: DataFrame, columns: list[str], bound: int) -> DataFrame:
    """The ``bound`` rows of the smallest hash of ``columns``, and of these columns; all rows if there are fewer.

    A limit on the hash leaves about four times as many rows to be ordered, whatever the number of partitions.
    """
    n, share = frame.count(), 1.0
    if n > 8 * bound:
        share = 4 * bound / n
        while share < 1 and frame.where(F.xxhash64(*columns) < int(share * 2**64) - 2**63).count() < bound:
            share *= 4  # many equal rows: their hashes are few
    if share < 1:
        frame = frame.where(F.xxhash64(*columns) < int(share * 2**64) - 2**63)
    return frame.orderBy(F.xxhash64(*columns), *columns).limit(bound)


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, bound: int) -> list[tuple[str, int]]:
    """At most ``bound`` labelled texts of each class that are not held out, in an order fixed by the id's hash.

    The sample is the only text that reaches the driver; its size depends on ``bound`` alone. Labels other
    than 0 and 1, null ids and held-out rows are left out. Of an id that occurs repeatedly, each pair counts.
    """
    known = labels.where(F.col(target).isin(0, 1) & ~held_out("doc_id")).select("doc_id", F.col(target).alias("y"))
    known = materialise(known.join(docs.select("doc_id"), "doc_id", "left_semi"), "labelled-ids")
    chosen = None
    for value in (0, 1):
        part = first_by_hash(known.where(F.col("y") == value), ["doc_id"], bound)
        chosen = part if chosen is None else chosen.unionByName(part)
    # at most 2 * bound rows of an id and a label
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = texts.orderBy(F.xxhash64("doc_id"), "doc_id", "y", "text").limit(2 * bound).collect()
    return [(r["text"] or "", int(r["y"])) for r in rows]


def texts_of(array: pa.Array):
    """The values of an Arrow string column as Python strings; null as the empty text."""
    for value in array:
        yield value.as_py() or ""


def logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30.0, 30.0)))
