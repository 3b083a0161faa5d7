"""The registered queries on the driver's tables, each beside the SQL that gives its rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixmsg, quotes, ticks
from ..operators import book, depth, epochs, fixsession, lifetimes, matching, ofi, orders, risk, stats
from ..operators.ordered import rolling_mean
from ..sources import adapters
from ..storage import cut
from .feed import BOOK, FEED, FLOW, buckets_sql, events, table, updates

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

HOUR = 3_600_000_000_000
#: Width of the buckets of most queries, and the widths of the sweep.
SIX_HOURS, SWEEP = 6 * HOUR, (3 * HOUR, 6 * HOUR, 12 * HOUR, 24 * HOUR)


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def rounded(frame: DataFrame, digits: int, *columns: str) -> DataFrame:
    return frame.withColumns({c: F.round(c, digits) for c in columns})


def audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return epochs.audit(updates(spark, sf_dir))


def tob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.top_of_book(audited(spark, sf_dir))


def flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ofi.events(tob(spark, sf_dir))


def level_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.levels(audited(spark, sf_dir))


def standing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.final_levels(level_rows(spark, sf_dir))


# --- books ------------------------------------------------------------------------------------------------------------


@query(f"WITH {FEED} SELECT symbol, idx, is_snapshot, seq, epoch, last_seq, applied FROM audit")
def epoch_audit(spark, sf_dir):
    return audited(spark, sf_dir).select("symbol", "idx", "is_snapshot", "seq", "epoch", "last_seq", "applied")


@query(
    f"WITH {BOOK}, gaps AS (SELECT symbol, count(DISTINCT idx) AS frames, count(*) FILTER (applied) AS updates_applied, count(*) FILTER (is_snapshot) AS snapshots_applied, count(DISTINCT idx) FILTER (NOT applied) AS resyncs FROM audit GROUP BY ALL) "
    "SELECT g.*, n.no_op_deletes FROM gaps g JOIN (SELECT symbol, count(*) FILTER (size = 0 AND old_size = 0) AS no_op_deletes FROM levels GROUP BY ALL) n USING (symbol)"
)
def book_stats(spark, sf_dir):
    rows = audited(spark, sf_dir)
    return epochs.gap_stats(rows).join(book.no_op_deletes(book.levels(rows)), epochs.KEYS).drop("venue")


@query(f"WITH {BOOK} SELECT symbol, idx, bid_px, bid_sz, ask_px, ask_sz FROM tob")
def top_of_book(spark, sf_dir):
    return tob(spark, sf_dir).select("symbol", "idx", "bid_px", "bid_sz", "ask_px", "ask_sz")


@query(
    f"WITH {BOOK} SELECT symbol, idx, (bid_px + ask_px) / 2.0 AS mid, ask_px - bid_px AS spread, CASE WHEN bid_px IS NULL OR ask_px IS NULL THEN NULL WHEN bid_sz + ask_sz > 0 THEN (bid_px * ask_sz + ask_px * bid_sz) / (bid_sz + ask_sz) ELSE (bid_px + ask_px) / 2.0 END AS microprice, "
    "bid_px IS NOT NULL AND ask_px IS NOT NULL AS two_sided, CAST(round((bid_px + ask_px) / 2.0 * 0.1, 6) AS DOUBLE) AS mid_price FROM tob"
)
def tob_measures(spark, sf_dir):
    bp, bs, ap, az = (F.col(c) for c in ofi.TOB)
    mid = ticks.mid(bp, ap)
    return tob(spark, sf_dir).select("symbol", "idx", mid.alias("mid"), ticks.spread(bp, ap).alias("spread"), ticks.microprice(bp, bs, ap, az).alias("microprice"), ticks.is_two_sided(bp, ap).alias("two_sided"), F.round(mid * 0.1, 6).alias("mid_price"))


@query(f"WITH {BOOK} SELECT symbol, side, level, px AS price, size FROM ranked WHERE level <= 5")
def depth_topk(spark, sf_dir):
    return book.ranked(standing(spark, sf_dir), 5).select("symbol", "side", "level", "price", "size")


@query(f"WITH {BOOK} SELECT symbol, side, level, px AS price, sum(size) OVER (PARTITION BY symbol, side ORDER BY level) AS cum_size FROM ranked")
def cumulative_depth(spark, sf_dir):
    return book.cumulative_depth(standing(spark, sf_dir)).select("symbol", "side", "level", "price", "cum_size")


@query(f"WITH {BOOK} SELECT symbol, sum(size) / 2.0 AS avg_depth FROM ranked WHERE level <= 5 GROUP BY ALL")
def average_depth(spark, sf_dir):
    return book.average_depth(standing(spark, sf_dir), 5).select("symbol", "avg_depth")


@query(
    f"WITH {BOOK}, asked AS (SELECT DISTINCT symbol, side, px FROM feed) SELECT symbol, side, px AS price, coalesce(size, 0.0) AS size FROM asked LEFT JOIN final USING (symbol, side, px)"
)
def size_at(spark, sf_dir):
    level = F.explode(F.concat(F.transform("bids", lambda x: F.struct(F.lit("BUY").alias("side"), x["price"].alias("price"))), F.transform("asks", lambda x: F.struct(F.lit("SELL").alias("side"), x["price"].alias("price")))))
    asked = updates(spark, sf_dir).select("venue", "symbol", level.alias("l")).select("venue", "symbol", "l.*").distinct()
    return book.size_at(standing(spark, sf_dir), asked).select("symbol", "side", "price", "size")


@query(f"WITH {BOOK} SELECT symbol, idx, coalesce(bid_px + k >= ask_px, false) AS crossed FROM tob JOIN (SELECT idx, k % 60 AS k FROM raw) USING (idx)")
def crossed_check(spark, sf_dir):
    shift = events(spark, sf_dir).select("idx", (F.col("k") % 60).alias("shift"))
    shifted = tob(spark, sf_dir).join(shift, "idx").withColumn("bid_px", F.col("bid_px") + F.col("shift"))
    return ticks.check_integrity(shifted).select("symbol", "idx", "crossed")


@query(
    f"WITH {BOOK}, side AS (SELECT symbol, string_agg(px || ':' || CAST(size AS BIGINT), ' ' ORDER BY level) FILTER (side = 'BUY') AS bids, string_agg(px || ':' || CAST(size AS BIGINT), ' ' ORDER BY level) FILTER (side = 'SELL') AS asks FROM ranked WHERE level <= 15 GROUP BY ALL), "
    "newest AS (SELECT symbol, idx, bid_px, ask_px, (bid_px + ask_px) / 2.0 AS mid FROM tob QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY idx DESC) = 1) "
    "SELECT symbol, coalesce(bids, '') AS bids, coalesce(asks, '') AS asks, idx, bid_px, ask_px, mid FROM newest JOIN side USING (symbol)"
)
def ladder_snapshot(spark, sf_dir):
    text = lambda c: F.concat_ws(" ", F.transform(c, lambda x: F.concat_ws(":", x["price"].cast("string"), x["size"].cast("bigint").cast("string"))))
    sides = book.ladder(standing(spark, sf_dir), 15).select(*epochs.KEYS, text("bids").alias("bids"), text("asks").alias("asks"))
    newest = book.latest(tob(spark, sf_dir).withColumn("mid", ticks.mid(F.col("bid_px"), F.col("ask_px"))), epochs.KEYS, "idx", ["idx", "bid_px", "ask_px", "mid"])
    return newest.join(sides, epochs.KEYS).select("symbol", "bids", "asks", "idx", "bid_px", "ask_px", "mid")


def shallow(side: str, best: str) -> str:
    """One step of a truncated side in SQL: the level set, in order, the best five."""
    kept = f"list_filter(CASE WHEN is_snapshot THEN [] ELSE {best} END, lambda x: r.side <> '{side}' OR x.p <> r.px)"
    sign = "-" if side == "BUY" else ""
    return f"list_sort({kept} || CASE WHEN r.side = '{side}' AND r.sz > 0 THEN [{{'o': {sign}r.px, 'p': r.px, 's': r.sz}}] ELSE [] END)[1:5]"


@query(
    f"WITH RECURSIVE {FEED}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol, epoch ORDER BY idx) AS n FROM audit WHERE applied), none AS (SELECT list_filter([{{'o': CAST(0 AS BIGINT), 'p': CAST(0 AS BIGINT), 's': CAST(0 AS DOUBLE)}}], lambda x: false) AS l), "
    f"b AS (SELECT symbol, epoch, n, idx, recv_ts_ns, {shallow('BUY', 'l')} AS bids, {shallow('SELL', 'l')} AS asks FROM r, none WHERE n = 1 UNION ALL "
    f"SELECT r.symbol, r.epoch, r.n, r.idx, r.recv_ts_ns, {shallow('BUY', 'b.bids')}, {shallow('SELL', 'b.asks')} FROM b JOIN r ON r.symbol = b.symbol AND r.epoch = b.epoch AND r.n = b.n + 1) "
    "SELECT 'events' AS venue, symbol, epoch, idx, recv_ts_ns, CAST(NULL AS BIGINT) AS exchange_ts_ns, bids[1].p AS bid_px, coalesce(bids[1].s, 0.0) AS bid_sz, asks[1].p AS ask_px, coalesce(asks[1].s, 0.0) AS ask_sz, "
    "(coalesce(list_sum(list_transform(bids, lambda x: x.s)), 0) + coalesce(list_sum(list_transform(asks, lambda x: x.s)), 0)) / 2.0 AS depth FROM b"
)
def book_truncated(spark, sf_dir):
    """Books that forget levels beyond the best five for good: only a fold has this."""
    return book.top_of_book(audited(spark, sf_dir), max_depth=5, depth_levels=5)


@query(f"WITH {BOOK} SELECT symbol, count(*) FILTER (bid_px >= ask_px) AS crossed_seen FROM tob GROUP BY ALL")
def crossed_seen(spark, sf_dir):
    return book.crossings(tob(spark, sf_dir)).select("symbol", "crossed_seen")


@query(f"WITH {FEED} SELECT symbol, recv_ts_ns // {SIX_HOURS} * {SIX_HOURS} AS start_ns, count(*) AS messages, count(*) / {SIX_HOURS / 1e9} AS per_sec FROM feed GROUP BY ALL")
def message_rates(spark, sf_dir):
    return ofi.rates(updates(spark, sf_dir), SIX_HOURS).drop("venue")


# --- flow -------------------------------------------------------------------------------------------------------------


@query(f"WITH {FLOW} SELECT symbol, idx, e, changed FROM ofi")
def ofi_events(spark, sf_dir):
    return flow(spark, sf_dir).select("symbol", "idx", "e", "changed")


@query(f"WITH {FLOW} SELECT symbol, idx, sum(e) OVER w AS ofi, count(*) FILTER (changed) OVER w AS events FROM ofi WINDOW w AS (PARTITION BY symbol ORDER BY idx)")
def ofi_cumulative(spark, sf_dir):
    return ofi.cumulative(flow(spark, sf_dir)).select("symbol", "idx", "ofi", "events")


@query(f"WITH {FLOW} SELECT symbol, idx // 500 AS drain, sum(e) AS ofi, count(*) FILTER (changed) AS events FROM ofi GROUP BY ALL")
def ofi_drained(spark, sf_dir):
    return ofi.drained(flow(spark, sf_dir), 500).drop("venue")


BUCKETS = f"{FLOW}{buckets_sql(str(SIX_HOURS))}"


def bucketed(spark, sf_dir):
    return ofi.buckets(flow(spark, sf_dir), SIX_HOURS)


@query(f"WITH {BUCKETS} SELECT symbol, start_ns, end_ns, ofi, delta_mid, round(avg_depth, 9) AS avg_depth, events, mid_start, mid_end FROM buckets")
def ofi_buckets(spark, sf_dir):
    return rounded(bucketed(spark, sf_dir), 9, "avg_depth").drop("venue")


@query(
    f"WITH {FLOW}, swept AS (SELECT ofi.*, interval_ns FROM ofi, (VALUES {', '.join(f'({x})' for x in SWEEP)}) v(interval_ns)){buckets_sql('interval_ns', 'swept', 'interval_ns')} "
    "SELECT symbol, interval_ns, count(*) AS n, round(regr_slope(delta_mid, ofi), 9) AS slope, round(regr_r2(delta_mid, ofi), 9) AS r2 FROM buckets WHERE events > 0 GROUP BY ALL HAVING count(*) >= 30"
)
def ofi_interval_sweep(spark, sf_dir):
    rows, out = flow(spark, sf_dir), None
    rows = cut(rows)
    for interval in SWEEP:
        some = ofi.buckets(rows, interval).where("events > 0").withColumn("interval_ns", F.lit(interval).cast("bigint"))
        out = some if out is None else out.unionByName(some)
    fitted = out.groupBy("symbol", "interval_ns").agg(F.count(F.lit(1)).alias("n"), F.regr_slope("delta_mid", "ofi").alias("slope"), F.regr_r2("delta_mid", "ofi").alias("r2"))
    return rounded(fitted.where("n >= 30"), 9, "slope", "r2")


@query(
    f"WITH {BUCKETS}, kept AS (SELECT * FROM buckets WHERE events > 0), spots AS (SELECT o.*, (SELECT min(b.end_ns) FROM kept b WHERE b.symbol = o.symbol AND b.end_ns > o.r) AS end_ns FROM reached o), "
    "pairs AS (SELECT *, lag(bid_px) OVER v AS pb, lag(bid_sz) OVER v AS pbs, lag(ask_px) OVER v AS pa, lag(ask_sz) OVER v AS pas FROM (SELECT symbol, idx, end_ns, bid_px, bid_sz, ask_px, ask_sz FROM spots WHERE end_ns IS NOT NULL) WINDOW v AS (PARTITION BY symbol, end_ns ORDER BY idx)), "
    "moved AS (SELECT symbol, end_ns, sum((CASE WHEN ask_px = pa AND ask_sz < pas THEN pas - ask_sz ELSE 0 END) - (CASE WHEN bid_px = pb AND bid_sz < pbs THEN pbs - bid_sz ELSE 0 END)) AS v FROM pairs GROUP BY ALL) "
    "SELECT symbol, start_ns, coalesce(v, 0.0) AS signed_volume FROM kept LEFT JOIN moved USING (symbol, end_ns)"
)
def signed_volume_proxy(spark, sf_dir):
    rows = cut(flow(spark, sf_dir))
    return ofi.signed_volume(rows, ofi.buckets(rows, SIX_HOURS).where("events > 0"), SIX_HOURS).drop("venue")


#: Least squares of delta_mid on ofi with Newey and West's errors, in closed form.
HAC = f"""WITH {BUCKETS}, kept AS (
  SELECT symbol, ofi AS x, delta_mid AS y, row_number() OVER (PARTITION BY symbol ORDER BY start_ns) AS i FROM buckets WHERE events > 0
), fit AS (
  SELECT symbol, count(*) AS n, sum(x) AS sx, sum(x * x) AS sxx, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_r2(y, x) AS r2 FROM kept GROUP BY ALL
), sized AS (
  SELECT *, CAST(floor(4 * pow(n / 100.0, 2.0 / 9.0)) AS INT) AS lags, n * sxx - sx * sx AS d FROM fit
), res AS (SELECT k.symbol, i, x, y - a - b * x AS e, lags FROM kept k JOIN sized USING (symbol)),
meat AS (
  SELECT p.symbol, sum(w * p.e * q.e) AS s00, sum(w * p.e * q.e * (p.x + q.x) / 2) AS s01, sum(w * p.e * q.e * p.x * q.x) AS s11, sum(CASE WHEN p.i = q.i THEN p.e * p.e END) AS ssr
  FROM (SELECT *, unnest(range(0, lags + 1)) AS l FROM res) p JOIN res q ON p.symbol = q.symbol AND q.i = p.i - p.l,
    LATERAL (SELECT CASE WHEN l = 0 THEN 1.0 ELSE 2 * (1 - l / (p.lags + 1.0)) END AS w) GROUP BY ALL
)
SELECT symbol, n AS n_obs, lags AS hac_lags, round(a, 7) AS intercept, round(b, 7) AS slope, round(sqrt(n / (n - 2.0) * (sxx * sxx * s00 - 2 * sxx * sx * s01 + sx * sx * s11) / (d * d)), 7) AS intercept_se,
  round(sqrt(n / (n - 2.0) * (n * n * s11 - 2 * n * sx * s01 + sx * sx * s00) / (d * d)), 7) AS slope_se, round(r2, 7) AS r_squared, round(sqrt(ssr / (n - 2.0)), 7) AS resid_std
FROM sized JOIN meat USING (symbol)"""


@query(HAC)
def hac_regression(spark, sf_dir):
    fit = stats.regress(bucketed(spark, sf_dir).where("events > 0"), "delta_mid", ["ofi"], epochs.KEYS, "start_ns")
    out = fit.select("symbol", "n_obs", "hac_lags", *(F.col(c)[i].alias(n) for n, c, i in (("intercept", "params", 0), ("slope", "params", 1), ("intercept_se", "stderr", 0), ("slope_se", "stderr", 1))), "r_squared", "resid_std")
    return rounded(out, 7, "intercept", "slope", "intercept_se", "slope_se", "r_squared", "resid_std")


@query(f"WITH {BUCKETS} SELECT symbol, count(*) AS n, round(regr_slope(delta_mid, ofi), 9) AS slope, round(regr_intercept(delta_mid, ofi), 9) AS intercept, round(regr_r2(delta_mid, ofi), 9) AS r2, round(avg(avg_depth), 9) AS mean_depth FROM buckets WHERE events > 0 GROUP BY ALL")
def ofi_regression(spark, sf_dir):
    """The flagship: from raw events to the price impact of order flow."""
    kept = bucketed(spark, sf_dir).where("events > 0")
    out = kept.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.regr_slope("delta_mid", "ofi").alias("slope"), F.regr_intercept("delta_mid", "ofi").alias("intercept"), F.regr_r2("delta_mid", "ofi").alias("r2"), F.avg("avg_depth").alias("mean_depth"))
    return rounded(out, 9, "slope", "intercept", "r2", "mean_depth")


GROUPS = (
    f"WITH {BUCKETS}, kept AS (SELECT * FROM buckets WHERE events > 0), edges AS (SELECT quantile_cont(avg_depth, [0.2, 0.4, 0.6, 0.8]) AS q FROM kept), "
    "quintiles AS (SELECT kept.*, len(list_filter(q, lambda c: c <= avg_depth)) + 1 AS depth_group FROM kept, edges), "
    "fitted AS (SELECT depth_group, count(*) AS n, avg(avg_depth) AS mean_depth, regr_slope(delta_mid, ofi) AS slope, regr_r2(delta_mid, ofi) AS r2 FROM quintiles GROUP BY ALL HAVING count(*) >= 30) "
)


def fitted_groups(spark, sf_dir):
    placed = stats.depth_groups(cut(bucketed(spark, sf_dir).where("events > 0")), [])
    fit = placed.groupBy("depth_group").agg(F.count(F.lit(1)).alias("n"), F.avg("avg_depth").alias("mean_depth"), F.regr_slope("delta_mid", "ofi").alias("slope"), F.regr_r2("delta_mid", "ofi").alias("r2"))
    return fit.where("n >= 30")


@query(GROUPS + "SELECT depth_group, n, round(mean_depth, 9) AS mean_depth, round(slope, 9) AS slope, round(r2, 9) AS r2 FROM fitted")
def depth_quintiles(spark, sf_dir):
    return rounded(fitted_groups(spark, sf_dir), 9, "mean_depth", "slope", "r2")


@query(GROUPS + "SELECT CASE WHEN count(*) >= 3 THEN round(regr_slope(ln(slope), ln(mean_depth)), 6) END AS elasticity, count(*) AS n FROM fitted WHERE slope > 0")
def elasticity(spark, sf_dir):
    kept = fitted_groups(spark, sf_dir).where("slope > 0")
    return kept.agg(F.when(F.count(F.lit(1)) >= 3, F.round(F.regr_slope(F.ln("slope"), F.ln("mean_depth")), 6)).alias("elasticity"), F.count(F.lit(1)).alias("n"))


@query(
    f"WITH {BUCKETS}, n AS (SELECT symbol, ofi, delta_mid, (row_number() OVER (PARTITION BY symbol ORDER BY start_ns) - 1) // 5 AS chunk, count(*) OVER (PARTITION BY symbol) AS total FROM buckets) "
    "SELECT symbol, chunk, sum(ofi) AS ofi, sum(delta_mid) AS delta_mid FROM n WHERE (chunk + 1) * 5 < total GROUP BY ALL"
)
def rebucketed(spark, sf_dir):
    return ofi.every_n(bucketed(spark, sf_dir), 5).drop("venue")


@query(f"WITH {BOOK} SELECT symbol, idx, round(avg((bid_px + ask_px) / 2.0) OVER (PARTITION BY symbol ORDER BY idx ROWS 599 PRECEDING), 6) AS mean_mid FROM tob WHERE bid_px IS NOT NULL AND ask_px IS NOT NULL")
def rolling_mid(spark, sf_dir):
    rows = tob(spark, sf_dir).withColumn("mid", ticks.mid(F.col("bid_px"), F.col("ask_px"))).where("mid IS NOT NULL")
    return rounded(rolling_mean(rows, epochs.KEYS, "idx", "mid", 600, "mean_mid"), 6, "mean_mid").select("symbol", "idx", "mean_mid")


@query(f"WITH {FEED} SELECT symbol, recv_ts_ns // {HOUR} AS hour, max(idx) AS idx, arg_max(px, idx) AS px, arg_max(sz, idx) AS sz FROM (SELECT * FROM numbered) GROUP BY ALL")
def conflate_latest(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("hour", F.expr(f"recv_ts_ns div {HOUR}"))
    return book.latest(rows, ["symbol", "hour"], "idx", ["idx", "px", "sz"])


# --- statistics -------------------------------------------------------------------------------------------------------


@query("SELECT event_type, round(quantile_cont(value, 0.5), 9) AS p50, round(quantile_cont(value, 0.9), 9) AS p90, round(quantile_cont(value, 0.99), 9) AS p99 FROM events GROUP BY ALL")
def percentiles(spark, sf_dir):
    out = stats.quantiles(table(spark, sf_dir, "events"), ["event_type"], "value", [0.5, 0.9, 0.99])
    return out.select("event_type", *(F.round(F.col("q")[i], 9).alias(n) for i, n in enumerate(("p50", "p90", "p99"))))


@query(
    "WITH n AS (SELECT event_type AS stage, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events) SELECT stage, count(*) AS n, round(quantile_cont(value, 0.5), 9) AS p50, round(quantile_cont(value, 0.9), 9) AS p90, "
    "round(quantile_cont(value, 0.99), 9) AS p99, round(quantile_cont(value, 0.999), 9) AS p999, max(value) AS max_ns, round(avg(value), 6) AS mean_ns FROM n WHERE n > 50 GROUP BY ALL"
)
def latency_report(spark, sf_dir):
    samples = table(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), F.col("event_id").alias("idx"), F.col("value").alias("ns"))
    return rounded(rounded(stats.latency_report(samples, 50), 9, "p50", "p90", "p99", "p999"), 6, "mean_ns")


@query(
    "SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 6) AS mean, round(stddev_samp(o_totalprice), 6) AS std, round(quantile_cont(o_totalprice, 0.05), 9) AS p05, round(quantile_cont(o_totalprice, 0.95), 9) AS p95 FROM orders GROUP BY ALL"
)
def distribution_summary(spark, sf_dir):
    return rounded(rounded(stats.summary(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice"), 6, "mean", "std"), 9, "p05", "p95")


# --- scalar functions -------------------------------------------------------------------------------------------------


@query(
    "WITH t AS (SELECT p_partkey, CAST(round(p_retailprice * 100) AS BIGINT) AS cents, p_partkey % 4 AS extra FROM part) "
    "SELECT p_partkey, (cents // 100) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') || CASE extra WHEN 1 THEN '0' WHEN 2 THEN '5' ELSE '' END AS text, CASE WHEN extra = 2 THEN NULL ELSE cents END AS ticks, CASE WHEN extra = 2 THEN NULL ELSE round(cents / 100.0, 6) END AS price FROM t"
)
def to_ticks(spark, sf_dir):
    cents = F.floor(F.col("p_retailprice") * 100 + 0.5).cast("bigint")
    rows = table(spark, sf_dir, "part").select("p_partkey", cents.alias("cents"), (F.col("p_partkey") % 4).alias("extra"))
    text = F.concat(F.expr("cents div 100").cast("string"), F.lit("."), F.lpad((F.col("cents") % 100).cast("string"), 2, "0"), F.when(F.col("extra") == 1, "0").when(F.col("extra") == 2, "5").otherwise(""))
    out = rows.select("p_partkey", text.alias("text")).withColumn("ticks", ticks.to_ticks(F.col("text"), 2))
    return out.withColumn("price", F.round(ticks.to_float(F.col("ticks"), 2), 6))


DEALER = quotes.DealerParams()


@query(
    "WITH e AS (SELECT event_id, value AS mid, CAST(event_id % 11 - 5 AS DOUBLE) AS q, (event_id % 100) / 100.0 AS t FROM events), r AS (SELECT *, mid - q * 0.1 * 4.0 * greatest(0.0, 1.0 - t) AS c, (0.1 * 4.0 * greatest(0.0, 1.0 - t) + 2 / 0.1 * ln(1 + 0.1 / 1.5)) / 2 AS h, (0.1 * 4.0 * 0.5 + 2 / 0.1 * ln(1 + 0.1 / 1.5)) / 2 AS s FROM e) "
    "SELECT event_id, round(c - h, 9) AS bid, round(c + h, 9) AS ask, round(mid - s, 9) AS flat_bid, round(mid + s, 9) AS flat_ask, round(1 - exp(-140 * exp(-1.5 * greatest(0.0, mid - (c - h))) * 0.005), 9) AS hit FROM r"
)
def as_quotes(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("value").alias("mid"), (F.col("event_id") % 11 - 5).cast("double").alias("q"), ((F.col("event_id") % 100) / 100.0).alias("t"))
    mid, q, t = F.col("mid"), F.col("q"), F.col("t")
    (bid, ask), (flat_bid, flat_ask) = quotes.inventory_quotes(mid, q, t, DEALER), quotes.symmetric_quotes(mid, DEALER)
    out = rows.select("event_id", bid.alias("bid"), ask.alias("ask"), flat_bid.alias("flat_bid"), flat_ask.alias("flat_ask"), quotes.fill_probability(mid - bid, 0.005, DEALER).alias("hit"))
    return rounded(out, 9, "bid", "ask", "flat_bid", "flat_ask", "hit")


# --- orders -----------------------------------------------------------------------------------------------------------

TRADES = """trades AS (
  SELECT 'S' || (l_partkey % 50) AS symbol, CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side, l_quantity AS qty, CAST(floor(l_extendedprice * 100 / l_quantity + 0.5) AS BIGINT) AS price, l_orderkey FROM lineitem
)"""
OPEN = """open_orders AS (
  SELECT 'S' || (o_orderkey % 50) AS symbol, CASE WHEN o_orderkey % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, CAST(o_custkey % 100 + 1 AS DOUBLE) AS leaves_qty, CAST(floor(o_totalprice) AS BIGINT) AS price, o_orderkey FROM orders WHERE o_orderstatus = 'O'
)"""


def trades(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("S"), (F.col("l_partkey") % 50).cast("string")).alias("symbol"), F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"),
        F.col("l_quantity").alias("qty"), F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity") + 0.5).cast("bigint").alias("price"), "l_orderkey",
    )


def open_orders(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'")
    return rows.select(
        F.concat(F.lit("S"), (F.col("o_orderkey") % 50).cast("string")).alias("symbol"), F.when(F.col("o_orderkey") % 2 == 0, "BUY").otherwise("SELL").alias("side"),
        (F.col("o_custkey") % 100 + 1).cast("double").alias("leaves_qty"), F.floor("o_totalprice").cast("bigint").alias("price"), "o_orderkey",
    )


@query(f"WITH {TRADES} SELECT symbol, sum(CASE side WHEN 'BUY' THEN qty ELSE -qty END) AS position FROM trades GROUP BY ALL")
def positions(spark, sf_dir):
    return orders.positions(trades(spark, sf_dir))


@query(f"WITH {TRADES} SELECT l_orderkey, sum(qty) AS cum_qty, sum(price * qty) AS notional, round(sum(price * qty) / sum(qty), 6) AS avg_px FROM trades GROUP BY ALL")
def vwap(spark, sf_dir):
    return rounded(orders.vwap(trades(spark, sf_dir), ["l_orderkey"]), 6, "avg_px")


EXPOSURE = f"{TRADES}, {OPEN}, held AS (SELECT symbol, sum(CASE side WHEN 'BUY' THEN qty ELSE -qty END) AS position FROM trades GROUP BY ALL), working AS (SELECT symbol, coalesce(sum(leaves_qty) FILTER (side = 'BUY'), 0) AS b, coalesce(sum(leaves_qty) FILTER (side = 'SELL'), 0) AS s, count(*) AS n_open FROM open_orders GROUP BY ALL), exposed AS (SELECT symbol, coalesce(position, 0) AS position, coalesce(position, 0) + coalesce(b, 0) AS max_long, coalesce(position, 0) - coalesce(s, 0) AS max_short, coalesce(n_open, 0) AS n_open FROM held FULL JOIN working USING (symbol))"


@query(f"WITH {EXPOSURE} SELECT symbol, position, max_long, max_short FROM exposed")
def exposure(spark, sf_dir):
    return orders.exposure(trades(spark, sf_dir), open_orders(spark, sf_dir))


@query(f"WITH {TRADES} SELECT symbol, sum(CASE side WHEN 'BUY' THEN qty ELSE -qty END) AS position, sum(CASE side WHEN 'BUY' THEN -price * qty ELSE price * qty END) + sum(CASE side WHEN 'BUY' THEN qty ELSE -qty END) * max(price) AS pnl FROM trades GROUP BY ALL")
def mtm_pnl(spark, sf_dir):
    rows = trades(spark, sf_dir)
    return orders.marked_profit(rows, rows.groupBy("symbol").agg(F.max("price").alias("mark")))


LIMITS = risk.Limits(max_order_qty=45, max_order_value=60_000, price_collar_bps=4_000, lot_size=2, tick_size=5, price_scale=100.0, max_position=1_000, max_open_orders=150)
CHECKED = """checked AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, symbol, side, qty, price, 150000 AS mid,
    CASE WHEN NOT qty > 0 THEN 'qty_sign' WHEN NOT is_market AND price IS NULL THEN 'missing_price' WHEN abs(qty / 2 - round_even(qty / 2, 0)) > 1e-9 THEN 'lot_size' WHEN price % 5 <> 0 THEN 'tick_size'
      WHEN qty > 45 THEN 'max_order_qty' WHEN qty * price / 100 > 60000 THEN 'max_order_value' WHEN abs(price - 150000) / 150000.0 * 10000 > 4000 THEN 'price_collar' END AS "check"
  FROM (SELECT *, 'S' || (l_partkey % 50) AS symbol, CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side, l_quantity - CASE WHEN l_suppkey % 17 = 0 THEN 60 ELSE 0 END AS qty, l_linestatus = 'F' AND l_linenumber = 1 AS is_market,
    CASE WHEN l_suppkey % 13 <> 0 THEN CAST(floor(l_extendedprice * 100 / l_quantity + 0.5) AS BIGINT) END AS price FROM lineitem)
)"""


def candidates(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    price = F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity") + 0.5).cast("bigint")
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.concat(F.lit("S"), (F.col("l_partkey") % 50).cast("string")).alias("symbol"), F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"),
        (F.col("l_quantity") - F.when(F.col("l_suppkey") % 17 == 0, 60).otherwise(0)).alias("qty"), ((F.col("l_linestatus") == "F") & (F.col("l_linenumber") == 1)).alias("is_market"),
        F.when(F.col("l_suppkey") % 13 != 0, price).alias("price"), F.lit(150_000).cast("bigint").alias("mid"),
    )


@query(f'WITH {CHECKED} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, "check" FROM checked')
def risk_static(spark, sf_dir):
    return risk.decisions(candidates(spark, sf_dir), risk.static_check(LIMITS)).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "check")


@query(
    f"WITH {CHECKED}, {EXPOSURE} SELECT coalesce(\"check\", CASE WHEN abs(CASE side WHEN 'BUY' THEN max_long + qty ELSE max_short - qty END) > 1000 THEN 'max_position' WHEN n_open >= 150 THEN 'max_open_orders' END, 'accepted') AS \"check\", count(*) AS n FROM checked JOIN exposed USING (symbol) GROUP BY ALL"
)
def risk_position(spark, sf_dir):
    working = open_orders(spark, sf_dir)
    exposed = orders.exposure(trades(spark, sf_dir), working).join(working.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_open")), "symbol", "left").fillna(0, ["n_open"])
    decided = risk.decisions(candidates(spark, sf_dir).join(exposed, "symbol"), F.coalesce(risk.static_check(LIMITS), risk.position_check(LIMITS)))
    return risk.check_counts(decided)


ARRIVALS = f"""{OPEN}, asked AS (SELECT symbol, side, leaves_qty AS qty, o_orderkey, o_orderkey * 1000 AS idx FROM open_orders), changes AS (
  SELECT 'S' || (l_partkey % 50) AS symbol, l_orderkey * 1000 + l_linenumber AS idx, CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS d_position, 0.0 AS d_buy, 0.0 AS d_sell, 0 AS d_open FROM lineitem
  UNION ALL SELECT symbol, idx, 0.0, CASE side WHEN 'BUY' THEN qty ELSE 0 END, CASE side WHEN 'SELL' THEN qty ELSE 0 END, 1 FROM asked
), both_ AS (SELECT symbol, idx * 2 + 1 AS o, d_position, d_buy, d_sell, d_open, NULL AS o_orderkey, NULL AS side, NULL AS qty FROM changes UNION ALL SELECT symbol, idx * 2, 0, 0, 0, 0, o_orderkey, side, qty FROM asked),
stood AS (SELECT *, sum(d_position) OVER w AS position, sum(d_buy) OVER w AS b, sum(d_sell) OVER w AS s, CAST(sum(d_open) OVER w AS BIGINT) AS n_open FROM both_ WINDOW w AS (PARTITION BY symbol ORDER BY o))"""


@query(f"WITH {ARRIVALS} SELECT o_orderkey, position, position + b AS max_long, position - s AS max_short, n_open, CASE WHEN abs(CASE side WHEN 'BUY' THEN position + b + qty ELSE position - s - qty END) > 1000 THEN 'max_position' WHEN n_open >= 150 THEN 'max_open_orders' END AS \"check\" FROM stood WHERE o_orderkey IS NOT NULL")
def risk_as_of_arrival(spark, sf_dir):
    """Positions and working orders as they stood when each order came."""
    asked = open_orders(spark, sf_dir).select("symbol", "side", F.col("leaves_qty").alias("qty"), "o_orderkey", (F.col("o_orderkey") * 1000).alias("idx"))
    side = lambda s: F.when(F.col("side") == s, F.col("qty")).otherwise(0.0)
    fills = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("S"), (F.col("l_partkey") % 50).cast("string")).alias("symbol"), (F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("idx"),
        F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("d_position"), F.lit(0.0).alias("d_buy"), F.lit(0.0).alias("d_sell"), F.lit(0).alias("d_open"),
    )
    opened = asked.select("symbol", "idx", F.lit(0.0).alias("d_position"), side("BUY").alias("d_buy"), side("SELL").alias("d_sell"), F.lit(1).alias("d_open"))
    stood = orders.exposure_as_of(fills.unionByName(opened), asked)
    return risk.decisions(stood, risk.position_check(LIMITS)).select("o_orderkey", "position", "max_long", "max_short", "n_open", "check")


@query(
    f"WITH {TRADES}, {OPEN}, c AS (SELECT symbol, side, qty, price * 10 AS price, l_orderkey FROM trades) SELECT symbol, side, count(*) AS n, sum(price) AS price_sum FROM c WHERE EXISTS (SELECT 1 FROM open_orders o WHERE o.symbol = c.symbol AND o.side <> c.side AND CASE c.side WHEN 'BUY' THEN c.price >= o.price ELSE c.price <= o.price END) GROUP BY ALL"
)
def self_trade(spark, sf_dir):
    hit = risk.self_trades(trades(spark, sf_dir).withColumn("price", F.col("price") * 10), open_orders(spark, sf_dir))
    return hit.groupBy("symbol", "side").agg(F.count(F.lit(1)).alias("n"), F.sum("price").cast("decimal(38,0)").alias("price_sum"))


LIVES = "lives AS (SELECT 'S' || (o_orderkey % 50) AS symbol, CASE WHEN o_orderkey % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, CAST(floor(o_totalprice) AS BIGINT) AS price, o_orderkey * 1000 AS from_idx, CASE WHEN o_orderstatus <> 'O' THEN (o_orderkey + o_custkey % 1000 + 1) * 1000 END AS until_idx FROM orders)"


def lives(spark, sf_dir) -> DataFrame:
    """Every order with the time that it works; open ones never end."""
    key, ends = F.col("o_orderkey"), (F.col("o_orderkey") + F.col("o_custkey") % 1000 + 1) * 1000
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("S"), (key % 50).cast("string")).alias("symbol"), F.when(key % 2 == 0, "BUY").otherwise("SELL").alias("side"), F.floor("o_totalprice").cast("bigint").alias("price"),
        (key * 1000).cast("bigint").alias("from_idx"), F.when(F.col("o_orderstatus") != "O", ends.cast("bigint")).alias("until_idx"),
    )


@query(
    f"WITH {LIVES}, c AS (SELECT 'S' || (l_partkey % 50) AS symbol, CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side, 10 * CAST(floor(l_extendedprice * 100 / l_quantity + 0.5) AS BIGINT) AS price, l_orderkey * 1000 + l_linenumber AS idx FROM lineitem), "
    "hit AS (SELECT * FROM c WHERE EXISTS (SELECT 1 FROM lives o WHERE o.symbol = c.symbol AND o.side <> c.side AND o.from_idx <= c.idx AND (o.until_idx IS NULL OR c.idx < o.until_idx) AND CASE c.side WHEN 'BUY' THEN c.price >= o.price ELSE c.price <= o.price END)) "
    "SELECT symbol, side, count(*) AS n, sum(price) AS price_sum FROM hit GROUP BY ALL"
)
def self_trade_as_of(spark, sf_dir):
    """Orders that would trade with an own order that works as they come."""
    asked = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 1000 + F.col("l_linenumber")).cast("bigint").alias("idx"), "*")
    price = F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity") + 0.5).cast("bigint") * 10
    rows = asked.select(F.concat(F.lit("S"), (F.col("l_partkey") % 50).cast("string")).alias("symbol"), F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"), price.alias("price"), "idx")
    hit = risk.self_trades_as_of(rows, lives(spark, sf_dir))
    return hit.groupBy("symbol", "side").agg(F.count(F.lit(1)).alias("n"), F.sum("price").cast("decimal(38,0)").alias("price_sum"))


@query(
    f"WITH {LIVES}, c AS (SELECT DISTINCT 'S' || (l_partkey % 50) AS symbol, l_orderkey * 1000 AS idx FROM lineitem) SELECT c.symbol, c.idx, max(o.price) FILTER (o.side = 'BUY') AS bid, min(o.price) FILTER (o.side = 'SELL') AS ask, "
    "(max(o.price) FILTER (o.side = 'BUY') + min(o.price) FILTER (o.side = 'SELL')) / 2.0 AS mid FROM c LEFT JOIN lives o ON o.symbol = c.symbol AND o.from_idx <= c.idx AND (o.until_idx IS NULL OR c.idx < o.until_idx) GROUP BY ALL"
)
def quotes_as_of(spark, sf_dir):
    """Best prices and mid of the orders that work at the moments of lineitem's orders."""
    asked = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("S"), (F.col("l_partkey") % 50).cast("string")).alias("symbol"), (F.col("l_orderkey") * 1000).cast("bigint").alias("idx")).distinct()
    return lifetimes.quotes_as_of(asked, lives(spark, sf_dir)).select("symbol", "idx", "bid", "ask", "mid")


@query(
    "WITH RECURSIVE m AS (SELECT user_id AS symbol, event_id AS idx, epoch_us(ts) / 1e6 AS t_s, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), "
    "s AS (SELECT symbol, idx, t_s, n, true AS accepted, [t_s] AS times FROM m WHERE n = 1 UNION ALL "
    "SELECT symbol, idx, t_s, n, len(kept) < 3, CASE WHEN len(kept) < 3 THEN list_append(kept, t_s) ELSE kept END FROM (SELECT m.*, "
    "CASE WHEN coalesce(list_position(list_transform(times, lambda x: m.t_s - x <= 86400), true), 0) = 0 THEN [] ELSE times[list_position(list_transform(times, lambda x: m.t_s - x <= 86400), true):] END AS kept "
    "FROM s JOIN m ON m.symbol = s.symbol AND m.n = s.n + 1)) SELECT symbol, idx, t_s, accepted FROM s"
)
def throttle(spark, sf_dir):
    """At most three accepted messages a day for each user; only accepted ones count, so this is a fold."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("symbol"), F.col("event_id").alias("idx"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t_s"))
    return risk.throttled(rows, 3, window=86_400.0)


REPORTS = """reports AS (
  SELECT l_orderkey AS id, 10 * l_linenumber + l_suppkey % 10 AS place, CASE l_suppkey % 5 WHEN 0 THEN 'NEW' WHEN 1 THEN 'PARTIALLY_FILLED' WHEN 2 THEN 'PENDING_CANCEL' WHEN 3 THEN 'CANCELED' ELSE 'FILLED' END AS ord_status, l_partkey, l_suppkey FROM lineitem
), ordered AS (SELECT *, row_number() OVER (ORDER BY id, place, l_partkey, l_suppkey) AS idx FROM reports)"""


def reports(spark, sf_dir) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, ("NEW", "PARTIALLY_FILLED", "PENDING_CANCEL", "CANCELED", "FILLED"))), (F.col("l_suppkey") % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("cl_ord_id"), (10 * F.col("l_linenumber") + F.col("l_suppkey") % 10).cast("bigint").alias("place"), status.alias("ord_status"), "l_partkey", "l_suppkey", "l_quantity")
    w = Window.partitionBy("cl_ord_id").orderBy("place", "l_partkey", "l_suppkey", "l_quantity")
    return rows.withColumn("idx", F.row_number().over(w).cast("bigint"))


@query(
    f"WITH {REPORTS}, l AS (SELECT *, coalesce(lag(ord_status) OVER (PARTITION BY id ORDER BY place, l_partkey, l_suppkey), 'PENDING_NEW') AS before FROM reports) SELECT before, ord_status, count(*) AS n, "
    + " OR ".join(f"before = '{a}' AND ord_status IN ({', '.join(repr(x) for x in b)})" for a, b in orders.ALLOWED.items() if b)
    + " AS allowed FROM l GROUP BY ALL"
)
def order_transitions(spark, sf_dir):
    judged = orders.bad_transitions(reports(spark, sf_dir))
    return judged.groupBy("before", "ord_status", "allowed").agg(F.count(F.lit(1)).alias("n"))


STEP = (
    "WITH RECURSIVE r AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY 10 * l_linenumber + l_suppkey % 10, l_partkey, l_suppkey, l_quantity) AS n, l_suppkey % 5 IN (1, 4) AS trade, l_partkey, l_quantity, "
    "CASE l_suppkey % 5 WHEN 0 THEN 'NEW' WHEN 1 THEN 'PARTIALLY_FILLED' WHEN 2 THEN 'PENDING_CANCEL' WHEN 3 THEN 'CANCELED' ELSE 'FILLED' END AS ord_status FROM lineitem), "
    "st AS (SELECT id, CAST(0 AS BIGINT) AS n, false AS trade, CAST(0 AS BIGINT) AS l_partkey, CAST(0 AS DOUBLE) AS l_quantity, CAST(NULL AS VARCHAR) AS ord_status, 'PENDING_NEW' AS status, CAST(NULL AS VARCHAR) AS order_id, CAST(0 AS DOUBLE) AS cum_qty, CAST(0 AS DOUBLE) AS avg_px, CAST(NULL AS VARCHAR) AS error FROM (SELECT DISTINCT id FROM r) UNION ALL "
    "SELECT id, n, trade, l_partkey, l_quantity, ord_status, CASE WHEN error IS NULL THEN ord_status ELSE before END, CASE WHEN legal THEN 'V1' ELSE order_id END, CASE WHEN error IS NULL AND trade THEN cum_qty + l_quantity ELSE cum_qty END, CASE WHEN error IS NULL AND trade THEN (avg_px * cum_qty + l_partkey * l_quantity) / (cum_qty + l_quantity) ELSE avg_px END, error "
    "FROM (SELECT *, CASE WHEN NOT legal THEN 'illegal_transition' WHEN trade AND NOT l_quantity > 0 THEN 'trade_without_quantity_or_price' WHEN trade AND l_quantity > greatest(0, 100 - cum_qty) + 1e-9 THEN 'overfill' END AS error FROM (SELECT r.*, st.status AS before, st.order_id, st.cum_qty, st.avg_px, "
    + "(" + " OR ".join(f"st.status = '{a}' AND r.ord_status IN ({', '.join(repr(x) for x in b)})" for a, b in orders.ALLOWED.items() if b) + ") AS legal FROM st JOIN r ON r.id = st.id AND r.n = st.n + 1))) "
)


@query(
    STEP + "SELECT n AS idx, CAST(id AS VARCHAR) AS cl_ord_id, 'S' AS symbol, CASE WHEN id % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, CASE WHEN trade THEN 'TRADE' ELSE ord_status END AS exec_type, CASE WHEN trade THEN l_quantity ELSE 0.0 END AS last_qty, CASE WHEN trade THEN l_partkey END AS last_px, "
    "status, order_id, cum_qty, round(avg_px, 6) AS avg_px, CAST(NULL AS VARCHAR) AS reject_reason, error FROM st WHERE n > 0"
)
def oms_fold(spark, sf_dir):
    """Execution reports through the order state machine: validity depends on what was accepted before."""
    known = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("cl_ord_id"), F.lit("S").alias("symbol"), F.when(F.col("o_orderkey") % 2 == 0, "BUY").otherwise("SELL").alias("side"), F.lit(100.0).alias("qty"))
    trade = F.col("ord_status").isin("PARTIALLY_FILLED", "FILLED")
    rows = reports(spark, sf_dir).select(
        "idx", "cl_ord_id", F.when(trade, "TRADE").otherwise(F.col("ord_status")).alias("exec_type"), "ord_status", F.lit("V1").alias("order_id"), F.concat_ws("-", F.lit("E"), "cl_ord_id", "idx").alias("exec_id"),
        F.when(trade, F.col("l_quantity")).otherwise(0.0).alias("last_qty"), F.when(trade, F.col("l_partkey")).alias("last_px"), F.lit(None).cast("double").alias("cum_qty"), F.lit("").alias("text"), F.col("idx").alias("ts_ns"),
    )
    return rounded(orders.apply_reports(known, rows), 6, "avg_px")


# --- matching ---------------------------------------------------------------------------------------------------------

RESTING = f"{OPEN}, resting AS (SELECT symbol, side, CAST(o_orderkey % 40 + CASE side WHEN 'BUY' THEN 960 ELSE 1001 END AS BIGINT) AS price, o_orderkey AS seq, leaves_qty AS remaining FROM open_orders)"
TAKERS = "takers AS (SELECT l_orderkey || '-' || l_linenumber || '-' || row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus) AS taker_id, 'S' || (l_partkey % 50) AS symbol, CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side, l_quantity * 20 AS qty, CASE WHEN l_linestatus = 'F' THEN CASE WHEN l_returnflag = 'R' THEN 970 ELSE 1030 END END AS limit_px FROM lineitem)"
WALK = f"{RESTING}, {TAKERS}, depth AS (SELECT *, coalesce(sum(remaining) OVER (PARTITION BY symbol, side ORDER BY CASE side WHEN 'BUY' THEN -price ELSE price END, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM resting), walked AS (SELECT taker_id, t.side, d.price, d.seq, least(remaining, qty - prior) AS fill FROM takers t JOIN depth d ON t.symbol = d.symbol AND t.side <> d.side AND prior < qty AND (limit_px IS NULL OR CASE t.side WHEN 'BUY' THEN d.price <= limit_px ELSE d.price >= limit_px END))"


def resting(spark, sf_dir) -> DataFrame:
    start = F.when(F.col("side") == "BUY", 960).otherwise(1001)
    return open_orders(spark, sf_dir).select("symbol", "side", (F.col("o_orderkey") % 40 + start).cast("bigint").alias("price"), F.col("o_orderkey").alias("seq"), F.col("leaves_qty").alias("remaining"))


def takers(spark, sf_dir) -> DataFrame:
    """All rows of lineitem; as an order's line may occur repeatedly, its rows are numbered."""
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")
    rows = table(spark, sf_dir, "lineitem").withColumn("n", F.row_number().over(w))
    return as_takers(rows, F.concat_ws("-", "l_orderkey", "l_linenumber", "n"))


def as_takers(rows: DataFrame, taker_id: Column) -> DataFrame:
    sells = F.col("l_returnflag") == "R"
    return rows.select(
        taker_id.alias("taker_id"), F.concat(F.lit("S"), (F.col("l_partkey") % 50).cast("string")).alias("symbol"),
        F.when(sells, "SELL").otherwise("BUY").alias("side"), (F.col("l_quantity") * 20).alias("qty"), F.when(F.col("l_linestatus") == "F", F.when(sells, 970).otherwise(1030)).alias("limit_px"),
    )


@query(f"WITH {WALK} SELECT taker_id, count(*) AS n_fills, sum(fill) AS traded, sum(fill * price) AS notional FROM walked WHERE fill > 0 GROUP BY ALL")
def walk_book_fill(spark, sf_dir):
    return filled(takers(spark, sf_dir), resting(spark, sf_dir))


def filled(takers: DataFrame, resting: DataFrame) -> DataFrame:
    return depth.traded(takers, resting, ["symbol"])


@query(
    f"WITH {WALK}, got AS (SELECT taker_id, sum(fill) AS available FROM walked WHERE fill > 0 GROUP BY ALL) SELECT side, coalesce(available, 0) >= qty - 1e-12 AS fok_ok, count(*) AS n, sum(qty) AS qty FROM takers LEFT JOIN got USING (taker_id) GROUP BY ALL"
)
def fok_check(spark, sf_dir):
    return fok_sums(takers(spark, sf_dir), resting(spark, sf_dir))


def fok_sums(takers: DataFrame, resting: DataFrame) -> DataFrame:
    judged = depth.can_fill(takers, resting, ["symbol"])
    return judged.groupBy("side", "fok_ok").agg(F.count(F.lit(1)).alias("n"), F.sum("qty").alias("qty"))


@query(f"WITH {RESTING} SELECT symbol, side, price, seq, coalesce(sum(remaining) OVER (PARTITION BY symbol, side, price ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS queue_ahead FROM resting")
def queue_ahead(spark, sf_dir):
    return depth.queue_ahead(resting(spark, sf_dir), ["symbol"]).select("symbol", "side", "price", "seq", "queue_ahead")


@query()
def matching_fold(spark, sf_dir):
    """Orders, cancels and anonymous flow through the matching venue, a symbol at a time."""
    rows = events(spark, sf_dir)
    op = F.when(F.col("k") % 10 < 3, "add").when(F.col("k") % 10 < 8, "submit").when(F.col("k") % 10 == 8, "market").otherwise("cancel_ahead")
    return matching.match(
        rows.select(
            "symbol", "idx", op.alias("op"), F.concat(F.lit("C"), F.col("idx").cast("string")).alias("cl_ord_id"), "side", (F.abs("sz") + 1).alias("qty"), F.when(op != "market", F.col("px") + F.when(F.col("k") % 10 >= 5, F.when(F.col("side") == "BUY", 20).otherwise(-20)).otherwise(0)).alias("price"),
            F.lit("LIMIT").alias("ord_type"), F.when(F.col("k") % 10 == 6, "IOC").when(F.col("k") % 10 == 7, "FOK").otherwise("DAY").alias("tif"),
        )
    )


# --- messages ---------------------------------------------------------------------------------------------------------

BODY = "'35=D' || chr(1) || '49=TIDE' || chr(1) || '56=VENUE' || chr(1) || '34=' || o_orderkey || chr(1) || '11=ORD-' || o_orderkey || chr(1) || '55=S' || (o_custkey % 50) || chr(1) || '54=' || (o_orderkey % 2 + 1) || chr(1) || '38=' || (o_custkey % 100 + 1) || chr(1) || '44=' || CAST(floor(o_totalprice) AS BIGINT) || chr(1)"
MESSAGES = f"bodies AS (SELECT o_orderkey, {BODY} AS body FROM orders), heads AS (SELECT o_orderkey, '8=FIX.4.4' || chr(1) || '9=' || length(body) || chr(1) || body AS head FROM bodies), framed AS (SELECT o_orderkey, head || '10=' || lpad(CAST(list_sum(list_transform(string_split(head, ''), lambda c: ascii(c))) % 256 AS VARCHAR), 3, '0') || chr(1) AS raw FROM heads)"


def messages(spark, sf_dir) -> DataFrame:
    text = lambda c: c.cast("string")
    fields = [
        (49, F.lit("TIDE")), (56, F.lit("VENUE")), (34, text(F.col("o_orderkey"))), (11, F.concat(F.lit("ORD-"), text(F.col("o_orderkey")))), (55, F.concat(F.lit("S"), text(F.col("o_custkey") % 50))),
        (54, text(F.col("o_orderkey") % 2 + 1)), (38, text(F.col("o_custkey") % 100 + 1)), (44, text(F.floor("o_totalprice").cast("bigint"))),
    ]
    return table(spark, sf_dir, "orders").select("o_orderkey", fixmsg.encode(F.lit("D"), fields).alias("raw"))


@query(f"WITH {MESSAGES} SELECT o_orderkey, raw FROM framed")
def fix_encode(spark, sf_dir):
    return messages(spark, sf_dir)


@query(
    f"WITH {MESSAGES}, damaged AS (SELECT o_orderkey, CASE o_orderkey % 7 WHEN 1 THEN replace(raw, '38=', '38=9') WHEN 2 THEN left(raw, length(raw) - 1) WHEN 3 THEN replace(raw, '55=S', '55S') WHEN 4 THEN replace(raw, '54=', 'x=') ELSE raw END AS raw, o_orderkey % 7 AS d FROM framed) "
    "SELECT o_orderkey, CASE d WHEN 1 THEN 'checksum_mismatch' WHEN 2 THEN 'no_trailing_soh' WHEN 3 THEN 'field_without_equals' WHEN 4 THEN 'tag_not_numeric' END AS error, CASE WHEN d NOT IN (1, 2, 3, 4) THEN regexp_extract(raw, chr(1) || '11=([^' || chr(1) || ']*)', 1) END AS cl_ord_id, CASE WHEN d NOT IN (1, 2, 3, 4) THEN CAST(regexp_extract(raw, chr(1) || '38=([0-9]*)', 1) AS DOUBLE) END AS qty FROM damaged"
)
def fix_decode(spark, sf_dir):
    d, raw = F.col("o_orderkey") % 7, F.col("raw")
    damaged = F.when(d == 1, F.replace(raw, F.lit("38="), F.lit("38=9"))).when(d == 2, F.left(raw, F.length(raw) - 1)).when(d == 3, F.replace(raw, F.lit("55=S"), F.lit("55S"))).when(d == 4, F.replace(raw, F.lit("54="), F.lit("x="))).otherwise(raw)
    rows = messages(spark, sf_dir).select("o_orderkey", damaged.alias("raw")).select("o_orderkey", fixmsg.decoded(raw).alias("m"))
    sound, fields = F.col("m.error").isNull(), F.col("m.fields")
    return rows.select("o_orderkey", "m.error", F.when(sound, fixmsg.field(fields, 11)).alias("cl_ord_id"), F.when(sound, fixmsg.field(fields, 38).cast("double")).alias("qty"))


SENT = "sent AS (SELECT user_id AS conn, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, CASE WHEN event_id % 3 = 0 THEN 'D' ELSE '0' END AS msg_type FROM events)"


def sent(spark, sf_dir) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("conn"), F.row_number().over(w).cast("bigint").alias("seq"), F.when(F.col("event_id") % 3 == 0, "D").otherwise("0").alias("msg_type"), "event_id")


@query(
    f"WITH {SENT}, g AS (SELECT *, seq - row_number() OVER (PARTITION BY conn, msg_type ORDER BY seq) AS island FROM sent) SELECT conn, seq AS begin_seq, seq + 1 AS new_seq, 'resend' AS action FROM g WHERE msg_type = 'D' UNION ALL SELECT conn, min(seq), max(seq) + 1, 'gap_fill' FROM g WHERE msg_type = '0' GROUP BY conn, island"
)
def fix_resend_gapfill(spark, sf_dir):
    return fixsession.resend_plan(sent(spark, sf_dir))


@query(
    f"WITH {SENT}, kept AS (SELECT conn, seq, lag(seq) OVER (PARTITION BY conn ORDER BY seq) + 1 AS expected FROM sent WHERE seq % 9 <> 5) SELECT conn, seq, expected, seq - expected AS missing FROM kept WHERE seq > expected"
)
def fix_seq_gaps(spark, sf_dir):
    return fixsession.sequence_gaps(sent(spark, sf_dir).where("seq % 9 <> 5"), order="seq").select("conn", "seq", "expected", "missing")


@query(
    f"WITH {MESSAGES}, m AS (SELECT CAST(o_orderkey % 20 AS VARCHAR) AS conn, o_orderkey * 2 + 1 AS idx, raw FROM framed JOIN orders USING (o_orderkey)) "
    "SELECT conn, idx, 0 AS n, raw AS message, CAST(NULL AS VARCHAR) AS remainder FROM m UNION ALL SELECT conn, max(idx), -1, NULL, '' FROM m GROUP BY conn"
)
def fix_split_stream(spark, sf_dir):
    """Messages of each connection, cut into reads that don't end where messages do, put together again."""
    rows = messages(spark, sf_dir).withColumn("conn", (F.col("o_orderkey") % 20).cast("string"))
    halves = F.array(F.struct(F.lit(0).alias("h"), F.left("raw", F.lit(30)).alias("raw")), F.struct(F.lit(1).alias("h"), F.substring("raw", F.lit(31), F.lit(1000)).alias("raw")))
    reads = rows.select("conn", "o_orderkey", F.explode(halves).alias("x")).select("conn", (F.col("o_orderkey") * 2 + F.col("x.h")).alias("idx"), "x.raw")
    return fixsession.split_streams(reads)


@query()
def fix_session(spark, sf_dir):
    """Sessions driven by each user's events."""
    rows = sent(spark, sf_dir)
    logon = rows.select("conn").distinct().select(F.col("conn").cast("string").alias("conn"), F.lit(0).cast("bigint").alias("idx"), F.lit("logon").alias("op"), F.lit(0.0).alias("t_s"), F.lit("A").alias("msg_type"), F.lit(None).cast("bigint").alias("seq"))
    body = rows.where("seq % 9 <> 5").select(F.col("conn").cast("string").alias("conn"), (F.col("seq") + 1).alias("idx"), F.when(F.col("seq") % 4 == 0, "poll").otherwise("message").alias("op"), (F.col("seq") * 12.0).alias("t_s"), "msg_type", "seq")
    return fixsession.run_sessions(logon.unionByName(body).withColumn("body", F.lit(None).cast("map<int,string>")))


FRAMES_OKX = """'{"arg":{"channel":"' || CASE WHEN k % 9 = 0 THEN 'trades' ELSE 'books' END || '","instId":"' || symbol || '"},"action":"' || CASE WHEN k % 5 = 0 THEN 'snapshot' ELSE 'update' END || '","data":[{"bids":[["' || px || '.5","' || CAST(sz AS BIGINT) || '","0","1"]],"asks":[["' || px || '.25","1"]],"ts":"' || (recv_ts_ns // 1000000) || '","seqId":' || idx || ',"prevSeqId":' || (idx - 1) || '}]}'"""


def frames(spark, sf_dir, text: str) -> DataFrame:
    return events(spark, sf_dir).select(F.col("idx").alias("msg_idx"), F.col("recv_ts_ns").alias("recv_ns"), F.expr(text).alias("raw"))


@query(f"WITH {FEED} SELECT symbol, idx AS msg_idx, k % 5 = 0 AS is_snapshot, idx AS seq, idx - 1 AS prev_seq, (recv_ts_ns // 1000000) * 1000000 AS exchange_ts_ns, px * 10 + 5 AS bid_px, sz AS bid_sz, 0 AS n_asks FROM numbered WHERE k % 9 <> 0")
def okx_parse(spark, sf_dir):
    """Frames of the first venue; asks with more digits than a tick has are left out, their frame kept."""
    text = FRAMES_OKX.replace("recv_ts_ns // 1000000", "recv_ts_ns div 1000000")
    rows = adapters.updates_of(adapters.okx(frames(spark, sf_dir, text), 1))
    return rows.select("symbol", "msg_idx", "is_snapshot", "seq", "prev_seq", "exchange_ts_ns", F.col("bids")[0]["price"].alias("bid_px"), F.col("bids")[0]["size"].alias("bid_sz"), F.size("asks").alias("n_asks"))


FRAMES_BYBIT = """'{"topic":"' || CASE WHEN k % 9 = 0 THEN 'trade.' ELSE 'orderbook.50.' END || symbol || '","type":"' || CASE WHEN k % 5 = 0 THEN 'snapshot' ELSE 'delta' END || '","ts":' || (recv_ts_ns // 1000000) || ',"data":{"s":"' || symbol || '","b":[["' || px || '.05","' || CAST(sz AS BIGINT) || '"],["x","1"]],"a":[],"u":' || idx || ',"seq":7}}'"""


@query(f"WITH {FEED} SELECT symbol, idx AS msg_idx, k % 5 = 0 AS is_snapshot, idx AS seq, CASE WHEN k % 5 <> 0 THEN idx - 1 END AS prev_seq, (recv_ts_ns // 1000000) * 1000000 AS exchange_ts_ns, px * 100 + 5 AS bid_px, sz AS bid_sz, 1 AS n_bids FROM numbered WHERE k % 9 <> 0")
def bybit_parse(spark, sf_dir):
    text = FRAMES_BYBIT.replace("recv_ts_ns // 1000000", "recv_ts_ns div 1000000")
    rows = adapters.updates_of(adapters.bybit(frames(spark, sf_dir, text), 2))
    return rows.select("symbol", "msg_idx", "is_snapshot", "seq", "prev_seq", "exchange_ts_ns", F.col("bids")[0]["price"].alias("bid_px"), F.col("bids")[0]["size"].alias("bid_sz"), F.size("bids").alias("n_bids"))


@query(
    f"WITH {FEED}, parsed AS (SELECT symbol, idx, k % 5 = 0 AS is_snapshot, idx AS seq, idx - 1 AS prev_seq FROM numbered WHERE k % 9 <> 0), e AS (SELECT *, sum(CAST(is_snapshot AS INT)) OVER (PARTITION BY symbol ORDER BY idx) AS epoch FROM parsed), c AS (SELECT *, lag(seq) OVER (PARTITION BY symbol, epoch ORDER BY idx) AS last_seq FROM e), "
    "a AS (SELECT *, epoch > 0 AND max(CASE WHEN NOT is_snapshot AND prev_seq <> last_seq THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, epoch ORDER BY idx) = 0 AS applied FROM c) "
    "SELECT (SELECT count(*) FROM numbered) AS messages, (SELECT count(*) FROM numbered WHERE k % 9 = 0) AS ignored, 0 AS parse_errors, count(*) FILTER (applied) AS updates, count(*) FILTER (applied AND is_snapshot) AS snapshots, count(DISTINCT idx) FILTER (NOT applied) AS resyncs FROM a"
)
def replay_counters(spark, sf_dir):
    """A replay of frames: what was ignored, parsed, applied, and where the books had to wait for a snapshot."""
    parsed = cut(adapters.okx(frames(spark, sf_dir, FRAMES_OKX.replace("recv_ts_ns // 1000000", "recv_ts_ns div 1000000")), 1))
    return epochs.replay_stats(parsed, epochs.audit(adapters.exploded(parsed)))
