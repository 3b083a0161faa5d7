"""Captured feeds: JSON lines with a header, raw messages and a footer, gzipped or not."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CAPTURE = "type string, venue string, symbol string, started_ns bigint, format_version int, recv_ns bigint, raw string, ended_ns bigint, count bigint"
FORMAT_VERSION = 1


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of files in order: file, line_no (any number that rises with the line) and value."""
    lines = spark.read.text(path)
    # a split's rows are fewer than its bytes, so with room between the splits' starts lines are in order of the file
    within = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    rows = lines.select(F.col("_metadata.file_path").alias("file"), (F.col("_metadata.file_block_start") * F.lit(64) + within).alias("line_no"), "value")
    return rows.where(F.trim("value") != "")


def read_capture(spark: SparkSession, path: str) -> DataFrame:
    """The raw messages of a capture: file, msg_idx (rising with the line), recv_ns and raw.

    Blank lines are left out; a line that isn't JSON fails the job. A gzipped file is one split, so its order
    is the file's; a plain file's splits are in order of their start.
    """
    parsed = _lines(spark, path).select("file", "line_no", F.from_json("value", CAPTURE, {"mode": "FAILFAST"}).alias("r"))
    return parsed.where(F.col("r.type") == "msg").select("file", F.col("line_no").alias("msg_idx"), F.col("r.recv_ns").alias("recv_ns"), F.col("r.raw").alias("raw"))


def capture_header(spark: SparkSession, path: str) -> DataFrame:
    """The header of each file whose first line that isn't blank is one: file, venue, symbol, started_ns, format_version."""
    first = _lines(spark, path).groupBy("file").agg(F.min_by("value", "line_no").alias("value"))
    parsed = first.select("file", F.from_json("value", CAPTURE, {"mode": "FAILFAST"}).alias("r"))
    return parsed.where(F.col("r.type") == "header").select("file", "r.venue", "r.symbol", "r.started_ns", "r.format_version")


def write_capture(messages: DataFrame, path: str, venue: str, symbol: str, started_ns: int, ended_ns: int, order: str = "msg_idx") -> None:
    """Writes messages (recv_ns, raw) as gzipped captures, a file for each range of the order, raw payloads byte for byte.

    The first file begins with a header and the last ends with a footer that has the count, so the files read in
    order of their names are one capture.
    """
    spark = messages.sparkSession
    rows = messages.select(F.lit(1).alias("_kind"), F.col(order).cast("bigint").alias("_o"), F.to_json(F.struct(F.lit("msg").alias("type"), "recv_ns", "raw")).alias("value"))
    head = spark.range(1).select(F.lit(0).alias("_kind"), F.lit(0).cast("bigint").alias("_o"), F.to_json(F.struct(F.lit("header").alias("type"), F.lit(venue).alias("venue"), F.lit(symbol).alias("symbol"), F.lit(started_ns).cast("bigint").alias("started_ns"), F.lit(FORMAT_VERSION).alias("format_version"))).alias("value"))
    tail = messages.agg(F.count(F.lit(1)).alias("n")).select(F.lit(2).alias("_kind"), F.lit(0).cast("bigint").alias("_o"), F.to_json(F.struct(F.lit("footer").alias("type"), F.lit(ended_ns).cast("bigint").alias("ended_ns"), F.col("n").alias("count"))).alias("value"))
    ordered = head.unionByName(rows).unionByName(tail).repartitionByRange("_kind", "_o").sortWithinPartitions("_kind", "_o")
    ordered.select("value").write.option("compression", "gzip").text(path)
