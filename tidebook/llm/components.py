"""Connected components of a graph given by its links, as Spark jobs.

Large-star and small-star steps alternate until nothing changes: each hangs the neighbours of a node on the
smallest one it knows. Every step is two shuffles of pairs of numbers; nothing but a count reaches the driver,
and every round is written to the shared folder, so a lost executor costs no more than the round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete_at_exit, delete_path, shared_path


def _hung(pairs: DataFrame, larger: bool, rounds: Rounds) -> DataFrame:
    """Pairs (u, v): the neighbours v of each u, or only the larger ones, hung on the smallest of u and them."""
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if larger else pairs
    # written, so that the join has a plain shuffle on either side and can split a hub of many neighbours
    least = rounds.keep(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m")))
    joined = both.join(least, F.col("u") == F.col("_u"))
    if larger:
        moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        own = least.select(F.col("_u").alias("u"), F.col("m").alias("v"))
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own)
    return moved.where("u <> v").distinct()


def components(links: DataFrame, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of ``links`` (a, b: bigint): the smallest node of its component.

    Links of a node with itself, links with a null and repeated links say nothing and do no harm. A graph
    without links gives no rows. A hub of many links is split by the join's skew handling, and its minimum is
    aggregated before the shuffle. A round's files are deleted once the next round is written.
    """
    rounds = Rounds(links.sparkSession, name)
    pairs = rounds.keep(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(most_rounds):
        sums = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not sums[0]:
            break
        starred = rounds.keep(_hung(pairs, True, rounds))
        moved = rounds.keep(_hung(_oriented(starred), False, rounds))
        rounds.forget_but(moved)
        pairs = moved
        if sums == moved.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first():
            break
    else:
        raise RuntimeError("the components did not settle")
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


class Rounds:
    """Tables in the shared folder of which only the last one stays."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.held = spark, name, []

    def keep(self, frame: DataFrame) -> DataFrame:
        path = shared_path(self.spark, self.name)
        frame.write.parquet(path)
        delete_at_exit(self.spark, path)
        out = self.spark.read.schema(frame.schema).parquet(path)
        self.held.append((out, path))
        return out

    def forget_but(self, frame: DataFrame | None) -> None:
        for held, path in self.held:
            if held is not frame:
                delete_path(self.spark, path)
        self.held = [x for x in self.held if x[0] is frame]


def _oriented(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
