"""Regression with errors robust to heteroskedasticity and autocorrelation, quantiles, and latency reports."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordered import Running, evenly, numbered, ranged, running


def rule_of_thumb_lags(n: Column) -> Column:
    """Newey and West's bandwidth, floor(4 (n/100)^(2/9)); 0 for n of at most 1."""
    return F.when(n > 1, F.floor(4.0 * F.pow(n / 100.0, F.lit(2.0 / 9.0))).cast("int")).otherwise(0)


def _solved(names: list[str], k: int, add_constant: bool):
    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            inverse, params = [], []
            for gram, xy, n in zip(frame["gram"], frame["xy"], frame["n_obs"]):
                if n <= k:
                    inverse.append(None)
                    params.append(None)
                    continue
                inv = np.linalg.pinv(np.array(gram, float).reshape(k, k))
                inverse.append(inv.ravel().tolist())
                params.append((inv @ np.array(xy, float)).tolist())
            yield frame.assign(inverse=inverse, params=params)[[*names, "n_obs", "y_mean", "inverse", "params"]]

    return solve


def _sandwiched(names: list[str], k: int):
    def finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for inverse, meat, params, n in zip(f["inverse"], f["meat"], f["params"], f["n_obs"]):
                inv, s = np.array(inverse).reshape(k, k), np.array(meat, float).reshape(k, k)
                se = np.sqrt(np.maximum(np.diag(inv @ (s * (n / (n - k))) @ inv), 0.0))
                with np.errstate(divide="ignore", invalid="ignore"):
                    t = np.where(se > 0, np.array(params) / se, np.nan)
                out.append((se.tolist(), t.tolist()))
            yield f.assign(stderr=[o[0] for o in out], tstat=[o[1] for o in out])[[*names, "stderr", "tstat"]]

    return finish


def regress(frame: DataFrame, y: str, xs: list[str], keys: list[str], order: str, add_constant: bool = True, hac_lags: int | None = None) -> DataFrame:
    """Least squares of ``y`` on ``xs`` for each group of ``keys``.

    Gives n_obs, n_params, hac_lags, params, stderr, tstat (arrays, the constant first), r_squared (about the
    mean only with a constant; NaN if y doesn't vary), adj_r_squared and resid_std. Errors are Newey and West's
    with Bartlett weights over rows in order of ``order``; ``hac_lags`` of 0 gives White's. Rows with a null or
    NaN in y or a regressor are left out; a group of no more rows than parameters has nulls.

    Sums of products are aggregated in Spark; only matrices of the parameters' size are solved in Python.
    """
    k = len(xs) + add_constant
    if not k:
        raise ValueError("no regressors")
    used = frame.select(*keys, order, F.col(y).cast("double").alias("_y"), *(F.col(x).cast("double").alias(f"_x{i}") for i, x in enumerate(xs)))
    for c in ["_y", *(f"_x{i}" for i in range(len(xs)))]:
        used = used.where(F.col(c).isNotNull() & ~F.isnan(c))
    sliced_ = evenly(used, order) if isinstance(frame.schema[order].dataType, T.NumericType) else ranged(used, keys, order)
    used = numbered(sliced_, keys, order, "_i", keep=False).drop("_slice")
    x = [F.lit(1.0)] * add_constant + [F.col(f"_x{i}") for i in range(len(xs))]
    sums = used.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_obs"), F.avg("_y").alias("y_mean"), F.array(*(F.sum(a * b) for a in x for b in x)).alias("gram"), F.array(*(F.sum(a * F.col("_y")) for a in x)).alias("xy")
    )
    kinds = ", ".join(f"{c} {frame.schema[c].dataType.simpleString()}" for c in keys)
    head = kinds + ", " if keys else ""
    fitted = sums.mapInPandas(_solved(keys, k, add_constant), head + "n_obs bigint, y_mean double, inverse array<double>, params array<double>")
    fitted = fitted.withColumn("hac_lags", F.greatest(F.lit(0), F.least(F.lit(hac_lags) if hac_lags is not None else rule_of_thumb_lags(F.col("n_obs")), F.col("n_obs") - 1)).cast("int"))

    def with_fit(rows: DataFrame) -> DataFrame:
        return rows.join(fitted, keys) if keys else rows.join(F.broadcast(fitted), F.lit(True))  # one row without keys

    rows = with_fit(used).where(F.col("params").isNotNull())
    predicted = sum((F.col("params")[i] * c for i, c in enumerate(x)), F.lit(0.0))
    rows = rows.withColumn("_r", F.col("_y") - predicted)
    centre = F.col("y_mean") if add_constant else F.lit(0.0)
    squares = rows.groupBy(*keys).agg(F.sum(F.col("_r") * F.col("_r")).alias("ss_res"), F.sum(F.pow(F.col("_y") - centre, F.lit(2.0))).alias("ss_tot"))
    scores = rows.select(*keys, "_i", "hac_lags", F.array(*(c * F.col("_r") for c in x)).alias("u"))
    # each row meets the ones up to so many places before it, by an equi-join on the place
    late = scores.select(*keys, F.explode(F.expr("sequence(0, hac_lags)")).alias("_l"), "hac_lags", "u", "_i").withColumn("_j", F.col("_i") - F.col("_l"))
    early = scores.select(*keys, F.col("_i").alias("_j"), F.col("u").alias("v"))
    weight = F.when(F.col("_l") == 0, 0.5).otherwise(1.0 - F.col("_l") / (F.col("hac_lags") + 1.0))
    meat = late.join(early, [*keys, "_j"]).groupBy(*keys).agg(F.array(*(F.sum(weight * (F.col("u")[a] * F.col("v")[b] + F.col("v")[a] * F.col("u")[b])) for a in range(k) for b in range(k))).alias("meat"))
    parts = with_fit(meat)
    errors = parts.mapInPandas(_sandwiched(keys, k), head + "stderr array<double>, tstat array<double>")
    n = F.col("n_obs")
    r2 = F.when(F.col("ss_tot") > 0, 1.0 - F.col("ss_res") / F.col("ss_tot")).otherwise(F.when(F.col("ss_tot").isNotNull(), F.lit(float("nan"))))
    out = fitted.join(squares, keys, "left").join(errors, keys, "left") if keys else fitted.join(squares, F.lit(True), "left").join(errors, F.lit(True), "left")
    return out.withColumn("r_squared", r2).select(
        *keys, "n_obs", F.lit(k).alias("n_params"), "hac_lags", "params", "stderr", "tstat", "r_squared",
        (1.0 - (1.0 - F.col("r_squared")) * (n - 1) / F.nullif(n - k, F.lit(0))).alias("adj_r_squared"), F.sqrt(F.col("ss_res") / F.nullif(n - k, F.lit(0))).alias("resid_std"),
    )


def quantiles(frame: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """For each group of ``keys`` n, the count of values, and q, their exact quantiles with linear interpolation.

    Null values don't count; a group without any has NaNs. Equal values are counted first, and the counts are
    summed up over the parts of a distributed sort, which tells the ranks of each value: no task holds a group.
    """
    counted = frame.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    ranks = running(ranged(counted, keys, "_v"), keys, "_v", {"_end": Running("sum", F.col("_n"))}, keep=False)
    total = counted.groupBy(*keys).agg(F.sum("_n").alias("n"))
    # the two places, from 0, between which a share lies; a row for each group and share
    share = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), (F.lit(float(s)) * (F.col("n") - 1)).alias("at")) for i, s in enumerate(shares))))
    asked = total.withColumn("_s", share).select(*keys, "n", "_s.i", "_s.at")
    near = ranks.withColumn("_from", F.col("_end") - F.col("_n")).join(asked, keys) if keys else ranks.withColumn("_from", F.col("_end") - F.col("_n")).join(asked, F.lit(True))
    low, high = F.floor("at"), F.ceil("at")
    holds = lambda place: (F.col("_from") <= place) & (place < F.col("_end"))
    found = near.where(holds(low) | holds(high)).groupBy(*keys, "n", "i", "at").agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    found = found.withColumn("_q", F.col("_low") + (F.col("_high") - F.col("_low")) * (F.col("at") - low))
    listed = found.groupBy(*keys, "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "_q"))), lambda x: x["_q"]).alias("q"))
    nans = F.array(*(F.lit(float("nan")) for _ in shares))
    if not keys:
        return frame.sparkSession.range(1).join(listed, F.lit(True), "left").select(F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("q", nans).alias("q"))
    groups = frame.select(*keys).distinct()
    same = [groups[k].eqNullSafe(listed[k]) for k in keys]
    return groups.join(listed, same, "left").select(*(groups[k] for k in keys), F.coalesce(listed["n"], F.lit(0)).alias("n"), F.coalesce(listed["q"], nans).alias("q"))


def summary(frame: DataFrame, keys: list[str], value: str, shares: tuple[float, float] = (0.05, 0.95)) -> DataFrame:
    """For each group n, mean, std (of a sample) and the exact quantiles p05 and p95 of a value: how two strategies'
    sessions, say, are compared."""
    sums = frame.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    q = quantiles(frame, keys, value, list(shares)).drop("n")
    joined = sums.join(q, keys) if keys else sums.join(q, F.lit(True))
    return joined.select(*keys, "n", "mean", "std", F.col("q")[0].alias("p05"), F.col("q")[1].alias("p95"))


def latency_report(samples: DataFrame, warmup: int = 0, stage: str = "stage", order: str = "idx", value: str = "ns") -> DataFrame:
    """For each stage without its first ``warmup`` samples: count, p50, p90, p99, p999, max and mean.

    The mean is of an exact sum of nine digits after the point, so it doesn't depend on the order of the rows.
    The first samples of a stage are told by a bounded top-list of its smallest ``order``, so no task sorts a
    whole stage.
    """
    if warmup:
        ranked = samples.withColumn("_n", F.row_number().over(Window.partitionBy(stage, F.pmod(F.xxhash64(order), F.lit(64))).orderBy(order))).where(F.col("_n") <= warmup)
        edge = ranked.withColumn("_n", F.row_number().over(Window.partitionBy(stage).orderBy(order))).groupBy(stage).agg(F.max(F.when(F.col("_n") <= warmup, F.col(order))).alias("_edge"))
        samples = samples.join(edge, stage).where(F.col(order) > F.col("_edge"))
    q = quantiles(samples, [stage], value, [0.5, 0.9, 0.99, 0.999]).drop("n")
    sums = samples.groupBy(stage).agg(F.count(F.lit(1)).alias("n"), F.max(value).cast("double").alias("max_ns"), F.avg(F.col(value).try_cast("decimal(29,9)")).cast("double").alias("mean_ns"))
    return sums.join(q, stage).select(stage, "n", *(F.col("q")[i].alias(name) for i, name in enumerate(("p50", "p90", "p99", "p999"))), "max_ns", "mean_ns")


#: Ranks that a report of latencies gives, with their names.
LATENCIES = {"p50": 0.5, "p90": 0.9, "p99": 0.99, "p999": 0.999}


def latency_sketches(samples: DataFrame, stage: str = "stage", value: str = "ns", k: int = 800) -> DataFrame:
    """For each stage n, p50, p90, p99, p999, max_ns, mean_ns and the sketch that the percentiles were taken from, of a table
    or a stream; a stream's state is then a sketch a stage, whatever the number of samples.

    A percentile is a sample whose rank is off by no more than ``2.296 / k ** 0.9723`` of all (0.35 % for ``k`` of 800) with
    a probability of 99 %. Sketches of several tables or streams are merged by :func:`merged_latencies`. Null values and
    NaNs don't count; a stage without values has null percentiles.
    """
    number = F.col(value).cast("double")
    taken = samples.select(F.col(stage).alias("stage"), F.when(~F.isnan(number), number).alias("_v"))
    sums = taken.groupBy("stage").agg(F.kll_sketch_agg_double("_v", k).alias("sketch"), F.count("_v").alias("n"), F.max("_v").alias("max_ns"), F.sum("_v").alias("sum_ns"))
    return _read_off(sums)


def merged_latencies(reports: DataFrame, k: int = 800) -> DataFrame:
    """Reports of :func:`latency_sketches` as one: the same columns for each stage."""
    sums = reports.groupBy("stage").agg(F.kll_merge_agg_double("sketch", k).alias("sketch"), F.sum("n").alias("n"), F.max("max_ns").alias("max_ns"), F.sum("sum_ns").alias("sum_ns"))
    return _read_off(sums)


def _read_off(sums: DataFrame) -> DataFrame:
    at = lambda rank: F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(rank)))
    return sums.select("stage", "n", *(at(rank).alias(name) for name, rank in LATENCIES.items()), "max_ns", "sum_ns", (F.col("sum_ns") / F.nullif("n", F.lit(0))).alias("mean_ns"), "sketch")


def depth_groups(bucket_rows: DataFrame, keys: list[str], groups: int = 5, depth: str = "avg_depth") -> DataFrame:
    """Adds ``depth_group``, from 1: the bucket's place between the exact quantiles of depth; the last takes its upper edge.

    With no ``keys`` all buckets are one group.
    """
    edges = quantiles(bucket_rows, keys, depth, [i / groups for i in range(1, groups)]).drop("n").withColumnRenamed("q", "_edges")
    inner = F.filter("_edges", lambda e: e <= F.col(depth))
    joined = bucket_rows.join(edges, keys) if keys else bucket_rows.join(F.broadcast(edges), F.lit(True))  # one row without keys
    return joined.withColumn("depth_group", (F.size(inner) + 1).cast("bigint")).drop("_edges")
