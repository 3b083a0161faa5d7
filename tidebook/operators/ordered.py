"""Running values over long ordered groups, without a task that holds a whole group.

A window over a symbol puts all its rows into one task. Here each group is cut into slices of the order, every
slice is a window of its own, and a row for each slice carries what came before. The window over these carries
is as small as the rows divided by the slice's length. The carry is the first row of its slice's window, so
there is one shuffle of the rows, by group and slice, and no join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut


@dataclass(frozen=True)
class Running:
    """``kind``: sum, max or first (non-null; all with the row), last (non-null, before the row) or lag (one row before)."""

    kind: str
    value: Column


def sliced(frame: DataFrame, order: str, width: int, name: str = "_slice") -> DataFrame:
    """Adds the slice of a numeric order column: ``order div width``."""
    return frame.withColumn(name, F.floor(F.col(order) / F.lit(width)).cast("bigint"))


def evenly(frame: DataFrame, order: str, rows: int = 100_000, name: str = "_slice") -> DataFrame:
    """Adds slices of a numeric order that rises about evenly, such as a time, for about so many rows to a slice.

    The frame is computed once and kept.
    """
    frame = cut(frame)
    n, low, high = frame.agg(F.count(F.lit(1)), F.min(order), F.max(order)).first()
    width = 1 if not n or low is None else max(1, (high - low) // max(1, n // rows) + 1)
    return sliced(frame, order, width, name)


def ranged(frame: DataFrame, keys: list[str], order: str, name: str = "_slice") -> DataFrame:
    """Adds slices of about equal size for an order of any type: the partitions of a distributed sort, kept."""
    return cut(frame.repartitionByRange(*keys, order).withColumn(name, F.spark_partition_id().cast("bigint")))


def numbered(frame: DataFrame, keys: list[str], order: str, name: str, slice_column: str = "_slice", keep: bool = True) -> DataFrame:
    """Adds the place, from 1, in the order of ``order`` within ``keys``, which must be unique there."""
    return running(frame, keys, order, {name: Running("sum", F.lit(1).cast("bigint"))}, slice_column, keep)


def rolling_mean(frame: DataFrame, keys: list[str], order: str, value: str, rows: int, name: str, width: int = 1_000_000, block: int = 100_000) -> DataFrame:
    """Adds the mean of ``value`` over a row and the ``rows - 1`` before it in the order of a numeric ``order``.

    Rows are dealt into blocks by their place; a block also gets the last ``rows - 1`` of the block before.
    """
    block = max(block, rows)
    placed = numbered(sliced(frame, order, width), keys, order, "_place").withColumn("_own", F.expr(f"(_place - 1) div {block}"))
    lends = F.pmod(F.col("_place") - 1, F.lit(block)) >= block - (rows - 1)
    spread = placed.withColumn("_block", F.explode(F.when(lends, F.array(F.col("_own"), F.col("_own") + 1)).otherwise(F.array("_own"))))
    w = Window.partitionBy(*keys, "_block").orderBy("_place").rowsBetween(1 - rows, 0)
    return spread.withColumn(name, F.avg(value).over(w)).where(F.col("_block") == F.col("_own")).select(*frame.columns, name)


def running(frame: DataFrame, keys: list[str], order: str, values: dict[str, Running], slice_column: str = "_slice", keep: bool = True) -> DataFrame:
    """Adds the running values, in the order of ``order`` within ``keys``; the order must be unique in a group.

    Rows of null keys form a group. ``slice_column`` must not fall as ``order`` rises. The rows are read twice,
    so with ``keep`` they are computed once and kept; leave it out where they are a plain scan.
    """
    frame = cut(frame) if keep else frame
    before = Window.partitionBy(*keys).orderBy(slice_column).rowsBetween(Window.unboundedPreceding, -1)
    totals, carried = [], []
    for name, r in values.items():
        t, c = f"_all_{name}", f"_carry_{name}"
        if r.kind == "sum":
            totals.append(F.sum(r.value).alias(t))
            carried.append(F.sum(t).over(before).alias(c))
        elif r.kind == "max":
            totals.append(F.max(r.value).alias(t))
            carried.append(F.max(t).over(before).alias(c))
        elif r.kind == "first":
            totals.append(F.min_by(r.value, F.when(r.value.isNotNull(), F.col(order))).alias(t))
            carried.append(F.first(t, ignorenulls=True).over(before).alias(c))
        elif r.kind == "last":
            totals.append(F.max_by(r.value, F.when(r.value.isNotNull(), F.col(order))).alias(t))
            carried.append(F.last(t, ignorenulls=True).over(before).alias(c))
        elif r.kind == "lag":
            totals.append(F.max_by(F.struct(r.value.alias("v")), F.col(order)).alias(t))
            carried.append(F.last(t, ignorenulls=True).over(before).alias(c))
        else:
            raise ValueError(f"unknown kind {r.kind}")
    carries = frame.groupBy(*keys, slice_column).agg(*totals).select(*keys, slice_column, *carried, F.lit(0).alias("_is_row"))
    valued = frame.withColumns({f"_value_{name}": F.struct(r.value.alias("v")) if r.kind == "lag" else r.value for name, r in values.items()})
    both = valued.withColumn("_is_row", F.lit(1)).unionByName(carries, allowMissingColumns=True)
    # every slice's window begins with its carry, which has no values of its own
    w = Window.partitionBy(*keys, slice_column).orderBy("_is_row", order)
    upto, earlier = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    out = {}
    for name, r in values.items():
        value, carry = F.col(f"_value_{name}"), F.first(f"_carry_{name}").over(upto)
        if r.kind == "sum":
            out[name] = F.coalesce(carry, F.lit(0)) + F.coalesce(F.sum(value).over(upto), F.lit(0))
        elif r.kind == "max":
            out[name] = F.greatest(carry, F.max(value).over(upto))
        elif r.kind == "first":
            out[name] = F.coalesce(carry, F.first(value, ignorenulls=True).over(upto))
        elif r.kind == "last":
            out[name] = F.coalesce(F.last(value, ignorenulls=True).over(earlier), carry)
        else:
            out[name] = F.coalesce(F.lag(value).over(w), carry)["v"]
    return both.withColumns(out).where("_is_row = 1").select(*[c for c in frame.columns if c not in values], *values)


def as_of(asked: DataFrame, known: DataFrame, keys: list[str], at: str, values: list[str], width: Column, name: str = "_known", strict: bool = False) -> DataFrame:
    """``asked`` with a struct of ``values`` from the last row of ``known`` whose ``at`` isn't above its own (or, if
    ``strict``, is below it) among equal keys; null where there is none, or where the row has no ``at``.

    Both are one order, ``width`` of a numeric ``at`` to a slice. Places that are asked for repeatedly are looked up once,
    so a place or key that many rows ask for is no task of its own; in ``known`` a place occurs once.
    """
    points = asked.where(F.col(at).isNotNull()).select(*keys, at, F.floor(F.col(at) / width).cast("bigint").alias("_slice")).distinct()
    steps = known.select(*keys, at, F.floor(F.col(at) / width).cast("bigint").alias("_slice"), F.struct(*values).alias("_value"), F.lit(1).alias("_turn"))
    both = steps.unionByName(points.withColumn("_turn", F.lit(0 if strict else 2)), allowMissingColumns=True).withColumn("_order", F.struct(at, "_turn"))
    found = running(both, keys, "_order", {name: Running("last", F.col("_value"))}, keep=False).where(F.col("_turn") != 1)
    return asked.join(found.select(*keys, at, name), [*keys, at], "left")
