"""Order-flow imbalance: contributions of consecutive tops of book, and time buckets of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ticks import is_two_sided, mid
from .epochs import KEYS
from .ordered import Running, evenly, numbered, running, sliced

TOB = ["bid_px", "bid_sz", "ask_px", "ask_sz"]


def contribution(p: dict[str, Column], c: dict[str, Column]) -> Column:
    """What the step from top ``p`` to ``c`` adds; 0 unless both are two-sided."""
    e = (
        F.when(c["bid_px"] >= p["bid_px"], c["bid_sz"]).otherwise(0.0) - F.when(c["bid_px"] <= p["bid_px"], p["bid_sz"]).otherwise(0.0)
        - F.when(c["ask_px"] <= p["ask_px"], c["ask_sz"]).otherwise(0.0) + F.when(c["ask_px"] >= p["ask_px"], p["ask_sz"]).otherwise(0.0)
    )
    return F.when(is_two_sided(p["bid_px"], p["ask_px"]) & is_two_sided(c["bid_px"], c["ask_px"]), e).otherwise(0.0)


def events(tob: DataFrame, width: int = 1_000_000, break_on_epoch: bool = False) -> DataFrame:
    """Adds e (the contribution), changed (whether any of the four values differs from the row before), first_ns
    (the time of the first row) and reached_ns (the latest time so far), all within a venue's symbol.

    The first row of a symbol has 0 and false. Pairs go across gaps unless ``break_on_epoch`` is set. The rows are
    computed once and kept.
    """
    values = {"_before": Running("lag", F.struct(*TOB, "epoch")), "first_ns": Running("first", F.col("recv_ts_ns")), "reached_ns": Running("max", F.col("recv_ts_ns"))}
    rows = running(sliced(tob, "idx", width), KEYS, "idx", values)
    known = F.col("_before").isNotNull()
    if break_on_epoch:
        known = known & (F.col("_before.epoch") == F.col("epoch"))
    p, c = {k: F.col(f"_before.{k}") for k in TOB}, {k: F.col(k) for k in TOB}
    changed = F.lit(False)
    for k in TOB:
        changed = changed | ~p[k].eqNullSafe(c[k])
    return rows.withColumn("e", F.when(known, contribution(p, c)).otherwise(0.0)).withColumn("changed", known & changed).drop("_before", "_slice")


def cumulative(event_rows: DataFrame, width: int = 1_000_000) -> DataFrame:
    """Adds ofi and events: the sum of e and the count of changes."""
    values = {"ofi": Running("sum", F.col("e")), "events": Running("sum", F.col("changed").cast("bigint"))}
    return running(sliced(event_rows, "idx", width), KEYS, "idx", values).drop("_slice")


def drained(event_rows: DataFrame, every: int) -> DataFrame:
    """What an accumulator that is emptied at each multiple of ``every`` of idx gives out: venue, symbol, drain (the
    number of the stretch), ofi and events of the stretch."""
    rows = event_rows.withColumn("drain", F.floor(F.col("idx") / F.lit(every)).cast("bigint"))
    return rows.groupBy(*KEYS, "drain").agg(F.sum("e").alias("ofi"), F.count_if("changed").alias("events"))


def rates(rows: DataFrame, interval_ns: int, keys: list[str] = KEYS) -> DataFrame:
    """Messages for each second in each interval of receipt that has any: keys, start_ns, messages and per_sec."""
    start = (F.floor(F.col("recv_ts_ns") / F.lit(interval_ns)) * F.lit(interval_ns)).cast("bigint")
    counted = rows.groupBy(*keys, start.alias("start_ns")).agg(F.count(F.lit(1)).alias("messages"))
    return counted.withColumn("per_sec", F.col("messages") / F.lit(interval_ns / 1e9))


def buckets(event_rows: DataFrame, interval_ns: int, depth: str | None = None) -> DataFrame:
    """Time buckets from the first observation of a venue's symbol on: venue, symbol, start_ns, end_ns, ofi, delta_mid,
    avg_depth, events, mid_start, mid_end.

    A late row counts in the bucket that the order of arrival has reached. mid_end is the last two-sided mid so
    far, mid_start the one before the bucket, or the first in it. Buckets without a two-sided row are dropped.
    The last bucket ends at the last row. ``depth`` names a column to average in place of half the sum of the
    best sizes. Rows are those of :func:`events`, read once and summed up before their shuffle.
    """
    if interval_ns <= 0:
        raise ValueError("interval_ns must be positive")
    both = is_two_sided(F.col("bid_px"), F.col("ask_px"))
    middle = F.when(both, mid(F.col("bid_px"), F.col("ask_px")))
    size = F.col(depth) if depth else (F.col("bid_sz") + F.col("ask_sz")) / 2.0
    at = F.when(both, F.col("idx"))
    grouped = event_rows.groupBy(*KEYS, "first_ns", bucket_of(interval_ns).alias("_k")).agg(
        F.sum("e").alias("ofi"), F.count_if("changed").alias("events"), F.avg(F.when(both, size)).alias("avg_depth"),
        F.max_by(middle, at).alias("_last"), F.min_by(middle, at).alias("_first"), F.max_by("recv_ts_ns", "idx").alias("_end"),
    )
    w = Window.partitionBy(*KEYS).orderBy("_k")
    before = F.last("_last", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    is_last = F.lead("_k").over(w).isNull()
    out = grouped.withColumn("mid_start", F.coalesce(before, "_first")).withColumn("_is_last", is_last).where(F.col("avg_depth").isNotNull())
    start = F.col("first_ns") + F.col("_k") * F.lit(interval_ns)
    return out.select(
        *KEYS, start.alias("start_ns"), F.when(F.col("_is_last"), F.col("_end")).otherwise(start + F.lit(interval_ns)).alias("end_ns"), "ofi",
        (F.col("_last") - F.col("mid_start")).alias("delta_mid"), "avg_depth", "events", "mid_start", F.col("_last").alias("mid_end"),
    )


def bucket_of(interval_ns: int) -> Column:
    return F.expr(f"(reached_ns - first_ns) div {int(interval_ns)}")


def signed_volume(event_rows: DataFrame, kept: DataFrame, interval_ns: int) -> DataFrame:
    """For each kept bucket a proxy of signed traded volume: venue, symbol, start_ns, signed_volume.

    A row belongs to the first kept bucket whose end lies behind the time reached, so rows of dropped buckets
    fall to the next kept one. Within a bucket each pair of neighbours adds the fall of the ask size at an
    unchanged ask, less the fall of the bid size at an unchanged bid.
    """
    first = event_rows.groupBy(*KEYS).agg(F.min("first_ns").alias("first_ns"))
    ends = kept.select(*KEYS, "start_ns", "end_ns").join(first, KEYS).withColumn("_k", F.expr(f"(start_ns - first_ns) div {int(interval_ns)}"))
    # a grid step that has rows takes the bucket of its own, or the next kept one: a window over steps and buckets
    steps = event_rows.select(*KEYS, bucket_of(interval_ns).alias("_k")).distinct()
    w = Window.partitionBy(*KEYS).orderBy("_k").rowsBetween(0, Window.unboundedFollowing)
    named = steps.join(ends.drop("first_ns"), [*KEYS, "_k"], "full").withColumn("_bucket", F.first(F.when(F.col("end_ns").isNotNull(), F.struct("start_ns", "end_ns")), ignorenulls=True).over(w))
    placed = event_rows.withColumn("_k", bucket_of(interval_ns)).join(named.select(*KEYS, "_k", "_bucket.start_ns", "_bucket.end_ns"), [*KEYS, "_k"]).where(F.col("reached_ns") < F.col("end_ns"))
    v = Window.partitionBy(*KEYS, "start_ns").orderBy("idx")
    p, c = {k: F.lag(k).over(v) for k in TOB}, {k: F.col(k) for k in TOB}
    fell = lambda side: F.when((c[f"{side}_px"] == p[f"{side}_px"]) & (c[f"{side}_sz"] < p[f"{side}_sz"]), p[f"{side}_sz"] - c[f"{side}_sz"]).otherwise(0.0)
    moved = placed.withColumn("_ask", fell("ask")).withColumn("_bid", fell("bid")).groupBy(*KEYS, "start_ns").agg(F.sum(F.col("_ask") - F.col("_bid")).alias("signed_volume"))
    return kept.select(*KEYS, "start_ns").join(moved, [*KEYS, "start_ns"], "left").withColumn("signed_volume", F.coalesce("signed_volume", F.lit(0.0)))


def every_n(bucket_rows: DataFrame, n: int) -> DataFrame:
    """Sums of whole runs of ``n`` consecutive buckets of a symbol; the run that reaches the last bucket is left out."""
    kept = evenly(bucket_rows, "start_ns")
    rows = numbered(kept, KEYS, "start_ns", "_n", keep=False).withColumn("chunk", F.expr(f"(_n - 1) div {int(n)}"))
    total = kept.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_total"))
    sums = rows.groupBy(*KEYS, "chunk").agg(F.sum("ofi").alias("ofi"), F.sum("delta_mid").alias("delta_mid"))
    return sums.join(total, KEYS).where((F.col("chunk") + 1) * n < F.col("_total")).drop("_total")
