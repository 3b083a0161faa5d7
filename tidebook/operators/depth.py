"""Takers against static depth, and the place of resting orders in their queues.

Each taker is by itself: none sees another's trades. What a taker trades in all needs no list of its fills: running sums
of quantity, value and orders, best price first and then oldest, are looked up where its quantity ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut
from .matching import EPSILON
from .ordered import Running, as_of, running, sliced


def best_first(side: Column, price: Column) -> Column:
    """A number that is smaller for a better resting price."""
    return F.when(side == "BUY", -price).otherwise(price)


def other(side: Column) -> Column:
    return F.when(side == "BUY", "SELL").otherwise("BUY")


def _levels(resting: DataFrame, keys: list[str]) -> DataFrame:
    """keys, side, price and what stands at better prices: _better (quantity), _better_n and _better_value; also _level, the
    level's own quantity, and _n, its orders."""
    rows = resting.where(F.col("remaining") > 0).groupBy(*keys, "side", "price").agg(F.sum("remaining").alias("_level"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys, "side").orderBy(best_first(F.col("side"), F.col("price"))).rowsBetween(Window.unboundedPreceding, -1)
    sums = {"_better": F.sum("_level").over(w), "_better_n": F.sum("_n").over(w), "_better_value": F.sum(F.col("_level") * F.col("price")).over(w)}
    return rows.withColumns({k: F.coalesce(v, F.lit(0)) for k, v in sums.items()})


def available(takers: DataFrame, levels: DataFrame, keys: list[str], prices: int = 1000) -> DataFrame:
    """Takers with _depth (all that stands within their limit) and _side (the one they hit); levels as :func:`_levels`.

    A limit is looked up in the running sums of the levels, ``prices`` ticks of them to a slice.
    """
    totals = levels.groupBy(*keys, "side").agg(F.sum("_level").alias("_total")).withColumnRenamed("side", "_side")
    known = levels.select(*keys, F.col("side").alias("_side"), best_first(F.col("side"), F.col("price")).cast("double").alias("_limit"), (F.col("_better") + F.col("_level")).alias("_upto"))
    asked = takers.withColumn("_side", other(F.col("side")))
    asked = asked.withColumn("_limit", best_first(F.col("_side"), F.col("limit_px")).cast("double"))
    met = as_of(asked, known, [*keys, "_side"], "_limit", ["_upto"], F.lit(prices)).join(totals, [*keys, "_side"], "left")
    depth = F.coalesce(F.when(F.col("limit_px").isNull(), F.col("_total")).otherwise(F.col("_known._upto")), F.lit(0.0))
    return met.withColumn("_depth", depth).drop("_known", "_limit", "_total")


def traded(takers: DataFrame, resting: DataFrame, keys: list[str], orders_a_slice: int = 10_000) -> DataFrame:
    """For each taker (keys, taker_id, side, qty, limit_px) that trades: n_fills, traded and notional, as :func:`walk` would
    list them. A row for each taker and order, whatever the fills."""
    levels = cut(_levels(resting, keys))
    means = levels.groupBy(*keys, F.col("side").alias("_side")).agg(F.greatest(F.sum("_level") / F.sum("_n") * orders_a_slice, F.lit(1e-9)).alias("_step"))
    queued = _queued(resting.where(F.col("remaining") > 0), keys).join(levels.drop("_level", "_n"), [*keys, "side", "price"])
    ahead = F.col("_upto") - F.col("remaining")
    orders = queued.select(
        *keys, F.col("side").alias("_side"), (F.col("_better") + ahead).cast("double").alias("_want"), "price", (F.col("_better_n") + F.col("_nth")).alias("n"), (F.col("_better_value") + ahead * F.col("price")).alias("value"),
    )
    wanting = available(takers.where(F.col("qty") > 0), levels, keys).withColumn("_want", F.least(F.col("qty"), F.col("_depth")).cast("double")).where("_want > 0")
    wanting = cut(wanting.select("taker_id", *keys, "_side", "_want"))
    sides = [*keys, "_side"]
    orders, wanting = orders.withColumn("before", F.col("_want")).join(means, sides), wanting.join(means, sides)
    met = as_of(wanting, orders, sides, "_want", ["price", "n", "value", "before"], F.col("_step"), strict=True)
    last = F.col("_known")
    return met.select("taker_id", last["n"].cast("bigint").alias("n_fills"), F.col("_want").alias("traded"), (last["value"] + last["price"] * (F.col("_want") - last["before"])).alias("notional"))


def can_fill(takers: DataFrame, resting: DataFrame, keys: list[str]) -> DataFrame:
    """For each taker available (up to its limit, no more than it asks for) and fok_ok."""
    got = available(takers, cut(_levels(resting, keys)), keys)
    out = got.withColumn("available", F.when(F.col("qty") > 0, F.least("qty", "_depth")).otherwise(0.0))
    return out.select(*takers.columns, "available", (F.col("available") >= F.col("qty") - EPSILON).alias("fok_ok"))


def walk(takers: DataFrame, resting: DataFrame, keys: list[str], orders_a_step: int = 256) -> DataFrame:
    """What each taker (keys, taker_id, side, qty, limit_px) would trade with the resting orders (keys, side,
    price, seq, remaining), best price first and then oldest: taker_id, price, seq and fill.

    Each taker is by itself: none sees another's trades. The depth before a resting order is what stands at better
    prices, a running sum over levels, and what stands before it at its own. Depth is cut into steps of equal
    quantity, of about ``orders_a_step`` orders each, and a taker is joined by equal keys with the steps that it
    reaches, so the work follows the fills and not the product of takers and orders.
    """
    best_first = F.when(F.col("side") == "BUY", -F.col("price")).otherwise(F.col("price"))
    levels = resting.groupBy(*keys, "side", "price").agg(F.sum("remaining").alias("_level"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys, "side").orderBy(best_first)
    levels = levels.withColumn("_better", F.coalesce(F.sum("_level").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    sides = levels.groupBy(*keys, "side").agg(F.sum("_level").alias("_total"), F.sum("_n").alias("_n"))
    sides = sides.select(*keys, F.when(F.col("side") == "BUY", "SELL").otherwise("BUY").alias("_taker"), "_total", F.greatest(F.col("_total") / F.col("_n") * orders_a_step, F.lit(1e-9)).alias("_step"))
    depth = queue_ahead(resting, keys).join(levels.drop("_level", "_n"), [*keys, "side", "price"]).withColumn("_before", F.col("_better") + F.col("queue_ahead"))
    depth = depth.withColumn("_taker", F.when(F.col("side") == "BUY", "SELL").otherwise("BUY")).drop("side").join(sides, [*keys, "_taker"])
    depth = depth.withColumn("_at", F.floor(F.col("_before") / F.col("_step")).cast("bigint")).select(*keys, F.col("_taker").alias("side"), "_at", "price", "seq", "remaining", "_before")
    wanting = takers.where(F.col("qty") > 0).join(sides.withColumnRenamed("_taker", "side"), [*keys, "side"])
    steps = F.floor(F.least("qty", "_total") / F.col("_step")).cast("bigint")
    reach = wanting.withColumn("_at", F.explode(F.sequence(F.lit(0).cast("bigint"), steps))).select(*keys, "side", "_at", "taker_id", "qty", "limit_px")
    joined = reach.join(depth, [*keys, "side", "_at"])
    within = F.col("limit_px").isNull() | F.when(F.col("side") == "BUY", F.col("price") <= F.col("limit_px")).otherwise(F.col("price") >= F.col("limit_px"))
    fill = F.least("remaining", F.col("qty") - F.col("_before"))
    return joined.where(within & (fill > 0)).select("taker_id", "price", "seq", fill.alias("fill"))



def _queued(resting: DataFrame, keys: list[str], width: int = 1_000_000) -> DataFrame:
    """Adds _upto and _nth: quantity and orders of a price up to each resting order, in order of a numeric seq."""
    sums = {"_upto": Running("sum", F.col("remaining")), "_nth": Running("sum", F.lit(1).cast("bigint"))}
    return running(sliced(resting, "seq", width), [*keys, "side", "price"], "seq", sums, keep=False).drop("_slice")


def queue_ahead(resting: DataFrame, keys: list[str], width: int = 1_000_000) -> DataFrame:
    """Adds the size that stands before each resting order at its price, in order of a numeric seq, over slices of it."""
    return _queued(resting, keys, width).withColumn("queue_ahead", F.col("_upto") - F.col("remaining")).drop("_upto", "_nth")
