"""Validity of book updates: a snapshot begins an epoch, and a gap ends its validity.

An update stream that has lost a message can't be trusted until the next snapshot. This is a property of the
order of arrival alone, so it is computed by windows: epochs by a running count of snapshots, and all else within
epochs, which are independent of each other. Long epochs are cut into pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut
from .ordered import Running, running, sliced

KEYS = ["venue", "symbol"]


def audit(updates: DataFrame, strict: bool = True, width: int = 1_000_000, piece: int = 200_000) -> DataFrame:
    """Adds epoch, last_seq (the last known sequence number of the epoch before the row) and applied; also where the row
    lies in its epoch: piece (from 0), pieces (of the epoch) and opens (the first row of a piece but the first).

    A delta is not applied before the first snapshot, nor from the first one on whose ``prev_seq`` is known and
    differs from a known ``last_seq``, until the next snapshot; with ``strict`` left out only the former. Rows
    of one venue and symbol are in order of ``idx``, ``width`` rows of it to a slice. A piece spans ``piece`` of ``idx``
    after its epoch's snapshot, so a symbol that is never sent one still makes many tasks; most epochs have one piece.
    """
    known, snapshot = F.col("is_snapshot") | F.col("seq").isNotNull(), F.col("is_snapshot")
    values = {"epoch": Running("sum", snapshot.cast("bigint")), "_start": Running("max", F.when(snapshot, F.col("idx"))), "_seen": Running("last", F.when(known, F.struct("seq")))}
    rows = running(sliced(updates, "idx", width), KEYS, "idx", values, keep=False).drop("_slice")
    rows = rows.withColumn("last_seq", F.when(~snapshot, F.col("_seen.seq")))
    broken = ~snapshot & F.coalesce(F.col("prev_seq") != F.col("last_seq"), F.lit(False)) & F.lit(strict)
    place = F.floor((F.col("idx") - F.coalesce("_start", F.lit(0))) / F.lit(piece)).cast("bigint")
    rows = rows.withColumns({"_broken": broken.cast("int"), "_part": place}).drop("_start", "_seen")
    rows, part = rows.withColumn("_is_row", F.lit(1)), Window.partitionBy(*KEYS, "epoch", "_part").orderBy("_is_row", "idx")
    if may_be_long(updates, piece):
        rows = cut(rows)
        rows, first = rows.unionByName(_places(rows), allowMissingColumns=True), F.first("_piece").over(part)
        where = {"piece": F.coalesce(first, F.lit(0)), "pieces": F.coalesce(F.first("_pieces").over(part), F.lit(1)), "opens": F.coalesce((F.row_number().over(part) == 2) & (first > 0), F.lit(False))}
    else:
        rows, part = rows.withColumn("_part", F.lit(0).cast("bigint")), Window.partitionBy(*KEYS, "epoch").orderBy("idx")
        where = {"piece": F.lit(0).cast("bigint"), "pieces": F.lit(1).cast("bigint"), "opens": F.lit(False)}
    upto = part.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_breaks": F.max("_broken").over(upto)} | where).where("_is_row = 1")
    rows = rows.withColumn("applied", (F.col("epoch") > 0) & (F.coalesce("_breaks", F.lit(0)) == 0))
    return rows.select(*updates.columns, "epoch", "last_seq", "applied", "piece", "pieces", "opens", "_part")


def may_be_long(updates: DataFrame, piece: int) -> bool:
    """Whether an epoch may span ``piece`` of ``idx``. It would span a whole slice of half that size without a snapshot,
    so one grouping of the slices, which reads three columns, tells as the query is built."""
    slices = sliced(updates, "idx", max(1, piece // 2)).groupBy(*KEYS, "_slice").agg(F.max("is_snapshot").alias("_any"))
    return not slices.where(~F.coalesce("_any", F.lit(False))).isEmpty()


def _places(rows: DataFrame) -> DataFrame:
    """Of each piece of a long epoch a row that carries its place, and whether the epoch broke before it."""
    epoch = Window.partitionBy(*KEYS, "epoch")
    parts = rows.groupBy(*KEYS, "epoch", "_part").agg(F.max("_broken").alias("_broke")).withColumn("_pieces", F.count(F.lit(1)).over(epoch))
    earlier = epoch.orderBy("_part")
    parts = parts.withColumns({"_piece": F.row_number().over(earlier).cast("bigint") - 1, "_lost": F.max("_broke").over(earlier.rowsBetween(Window.unboundedPreceding, -1))})
    return parts.where("_pieces > 1").select(*KEYS, "epoch", "_part", "_piece", "_pieces", F.col("_lost").alias("_broken"), F.lit(0).alias("_is_row"))


def gap_stats(audited: DataFrame, frame_column: str = "idx") -> DataFrame:
    """For each venue and symbol: frames, updates_applied, snapshots_applied, resyncs (frames with a rejected update)."""
    rejected = ~F.col("applied")
    return audited.groupBy(*KEYS).agg(
        F.countDistinct(frame_column).alias("frames"),
        F.count_if(F.col("applied")).alias("updates_applied"),
        F.count_if(F.col("is_snapshot")).alias("snapshots_applied"),
        F.countDistinct(F.when(rejected, F.col(frame_column))).alias("resyncs"),
    )


def replay_stats(parsed: DataFrame, audited: DataFrame) -> DataFrame:
    """What a replay of frames counts, as one row: messages, ignored, parse_errors, updates (applied), snapshots and
    resyncs (frames with a rejected update).

    ``parsed`` are frames with their outcome, ``audited`` the updates of those that were parsed, with msg_idx.
    """
    judged = parsed.agg(F.count(F.lit(1)).alias("messages"), F.count_if(F.col("outcome") == "ignored").alias("ignored"), F.count_if(F.col("outcome") == "parse_error").alias("parse_errors"))
    taken = audited.agg(
        F.count_if("applied").alias("updates"), F.count_if(F.col("applied") & F.col("is_snapshot")).alias("snapshots"), F.countDistinct(F.when(~F.col("applied"), F.col("msg_idx"))).alias("resyncs")
    )
    return judged.join(taken, F.lit(True), "left")
