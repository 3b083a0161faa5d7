"""The order-book feed that the queries derive from the events table, and its SQL.

Each event is an update of one level of its type's book. Every 200th update of a symbol is a snapshot, and one in
200 is lost, so the feed has gaps to be found.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import Running, running, sliced

LEVELS = "array<struct<price:bigint,size:double>>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, symbol, recv_ns, k, side, px, sz and value of each event."""
    rows = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    buys = F.col("event_id") % 2 == 0
    away = 1 + F.col("k") % 20
    return rows.select(
        F.col("event_id").alias("idx"), F.col("event_type").alias("symbol"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("recv_ts_ns"),
        k.alias("k"), F.when(buys, "BUY").otherwise("SELL").alias("side"), (F.floor("value").cast("bigint") % 7).cast("double").alias("sz"), "value",
    ).withColumn("px", F.when(F.col("side") == "BUY", 1000 - away).otherwise(1000 + away))


def updates(spark: SparkSession, sf_dir: str, width: int = 1_000_000) -> DataFrame:
    rows = running(sliced(events(spark, sf_dir), "idx", width), ["symbol"], "idx", {"rn": Running("sum", F.lit(1).cast("bigint"))}, keep=False)
    level = F.array(F.struct(F.col("px").alias("price"), F.col("sz").alias("size")))
    none = F.array().cast(LEVELS)
    return rows.where(F.col("rn") % 200 != 190).select(
        F.lit("events").alias("venue"), "symbol", "idx", (F.col("rn") % 200 == 1).alias("is_snapshot"), F.col("rn").alias("seq"), (F.col("rn") - 1).alias("prev_seq"),
        F.lit(None).cast("bigint").alias("exchange_ts_ns"), "recv_ts_ns", F.when(F.col("side") == "BUY", level).otherwise(none).alias("bids"), F.when(F.col("side") == "SELL", level).otherwise(none).alias("asks"),
    )


#: raw, feed, audit: the feed and its validity. For the other queries more steps follow.
FEED = """
raw AS (
  SELECT event_id AS idx, event_type AS symbol, epoch_us(ts) * 1000 AS recv_ts_ns, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
    CASE WHEN event_id % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, CAST(CAST(floor(value) AS BIGINT) % 7 AS DOUBLE) AS sz, value
  FROM events
), numbered AS (
  SELECT *, CASE side WHEN 'BUY' THEN 1000 - (1 + k % 20) ELSE 1000 + (1 + k % 20) END AS px, row_number() OVER (PARTITION BY symbol ORDER BY idx) AS rn FROM raw
), feed AS (
  SELECT *, rn % 200 = 1 AS is_snapshot, rn AS seq, rn - 1 AS prev_seq FROM numbered WHERE rn % 200 <> 190
), epochs AS (
  SELECT *, CAST(sum(CAST(is_snapshot AS INT)) OVER (PARTITION BY symbol ORDER BY idx) AS BIGINT) AS epoch FROM feed
), chained AS (
  SELECT *, last_value(seq IGNORE NULLS) OVER (PARTITION BY symbol, epoch ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_seq FROM epochs
), audit AS (
  SELECT *, epoch > 0 AND max(CASE WHEN NOT is_snapshot AND prev_seq <> last_seq THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, epoch ORDER BY idx) = 0 AS applied FROM chained
)"""

#: levels: each applied level with its lifetime; tob: best prices and sizes at each applied update.
BOOK = FEED + """, levels AS (
  SELECT symbol, epoch, idx, side, px, CASE WHEN sz > 0 THEN sz ELSE 0.0 END AS size,
    coalesce(lag(CASE WHEN sz > 0 THEN sz ELSE 0.0 END) OVER w, 0.0) AS old_size, lead(idx) OVER w AS until
  FROM audit WHERE applied WINDOW w AS (PARTITION BY symbol, epoch, side, px ORDER BY idx)
), standing AS (
  SELECT a.symbol, a.epoch, a.idx, a.recv_ts_ns, l.side, l.px, l.size
  FROM audit a LEFT JOIN levels l ON a.symbol = l.symbol AND a.epoch = l.epoch AND l.idx <= a.idx AND (l.until IS NULL OR l.until > a.idx) AND l.size > 0 WHERE a.applied
), tob AS (
  SELECT symbol, epoch, idx, recv_ts_ns, max(px) FILTER (side = 'BUY') AS bid_px, coalesce(arg_max(size, px) FILTER (side = 'BUY'), 0.0) AS bid_sz,
    min(px) FILTER (side = 'SELL') AS ask_px, coalesce(arg_min(size, px) FILTER (side = 'SELL'), 0.0) AS ask_sz
  FROM standing GROUP BY ALL
), final AS (
  SELECT symbol, side, px, size FROM levels JOIN (SELECT symbol, max(epoch) AS epoch FROM levels GROUP BY ALL) USING (symbol, epoch) WHERE until IS NULL AND size > 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY symbol, side ORDER BY CASE side WHEN 'BUY' THEN -px ELSE px END) AS level FROM final
)"""

#: ofi: contributions of consecutive tops.
FLOW = BOOK + """, lagged AS (
  SELECT *, lag(bid_px) OVER w AS bp, lag(bid_sz) OVER w AS bs, lag(ask_px) OVER w AS ap, lag(ask_sz) OVER w AS az, row_number() OVER w AS n FROM tob WINDOW w AS (PARTITION BY symbol ORDER BY idx)
), ofi AS (
  SELECT *, CASE WHEN bp IS NULL OR ap IS NULL OR bid_px IS NULL OR ask_px IS NULL THEN 0.0 ELSE
      (CASE WHEN bid_px >= bp THEN bid_sz ELSE 0 END) - (CASE WHEN bid_px <= bp THEN bs ELSE 0 END) - (CASE WHEN ask_px <= ap THEN ask_sz ELSE 0 END) + (CASE WHEN ask_px >= ap THEN az ELSE 0 END) END AS e,
    n > 1 AND (bid_px IS DISTINCT FROM bp OR bid_sz IS DISTINCT FROM bs OR ask_px IS DISTINCT FROM ap OR ask_sz IS DISTINCT FROM az) AS changed
  FROM lagged
)"""


def buckets_sql(interval_ns: str, source: str = "ofi", extra: str = "") -> str:
    """Steps from ``ofi`` to ``buckets`` of an interval, by symbol and the columns of ``extra``."""
    keys = f"symbol{', ' + extra if extra else ''}"
    return f""", reached AS (
  SELECT *, max(recv_ts_ns) OVER (PARTITION BY {keys} ORDER BY idx) AS r FROM {source}
), ends AS (
  SELECT {keys}, arg_min(recv_ts_ns, idx) AS t0, arg_max(recv_ts_ns, idx) AS t1 FROM {source} GROUP BY ALL
), placed AS (
  SELECT *, (r - t0) // {interval_ns} AS k, CASE WHEN bid_px IS NOT NULL AND ask_px IS NOT NULL THEN (bid_px + ask_px) / 2.0 END AS m FROM reached JOIN ends USING ({keys})
), grouped AS (
  SELECT {keys}, t0, t1, k, sum(e) AS ofi, count(*) FILTER (changed) AS events, avg((bid_sz + ask_sz) / 2.0) FILTER (m IS NOT NULL) AS avg_depth,
    arg_max(m, idx) FILTER (m IS NOT NULL) AS lm, arg_min(m, idx) FILTER (m IS NOT NULL) AS fm
  FROM placed GROUP BY ALL
), started AS (
  SELECT *, coalesce(last_value(lm IGNORE NULLS) OVER (PARTITION BY {keys} ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), fm) AS mid_start, lead(k) OVER (PARTITION BY {keys} ORDER BY k) IS NULL AS is_last FROM grouped
), buckets AS (
  SELECT {keys}, t0 + k * {interval_ns} AS start_ns, CASE WHEN is_last THEN t1 ELSE t0 + (k + 1) * {interval_ns} END AS end_ns, ofi, lm - mid_start AS delta_mid, avg_depth, events, mid_start, lm AS mid_end
  FROM started WHERE avg_depth IS NOT NULL
)"""
