"""Audit of filters that are applied one after the other: what each removes, repeats and alone finds.

Failures are counted once for every intersection of filters: the sum, over all rows, of the product of the flags.
All else is inclusion and exclusion over these counts. Survivors of a set of filters are its signed sum; the rows
that a filter removes in an order are a difference of two survivors; rows that fail one filter only are the signed
sum over the intersections that hold it. The number removed by a set of filters is a game whose Harsanyi dividend
is, up to its sign, an intersection's count, and a filter's Shapley value is the sum of its dividends, each shared
by the filters of the intersection. So the rows are read once, whatever the number of orders.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_UPPER, materialise

#: Fixed value: words lie between ASCII white space.
BLANKS = r"[\x20\x09-\x0D]+"


def _total(columns: list[Column]) -> Column:
    return reduce(Column.__add__, columns, F.lit(0).cast("bigint"))


def _subsets(mask: int) -> list[int]:
    return [s for s in range(mask + 1) if s & mask == s]


def joint_failures(flagged: DataFrame, filters: str, lost: dict[str, str], part: str = "part") -> DataFrame:
    """For each part the arrays n and those named in ``lost``: how many rows fail all filters of a set, by the set's
    bits, and how many of these have the named flag. Filters are columns of one letter; null flags count as false.

    Rows are first counted by their flags, so at most two to the number of filters rows a part and task are sent.
    """
    flags = {f: F.coalesce(F.col(f), F.lit(False)).cast("bigint").alias(f) for f in filters}
    marks = {name: F.coalesce(F.col(column), F.lit(False)).alias(f"is_{name}") for name, column in lost.items()}
    rows = flagged.select(F.col(part).alias("part"), *flags.values(), *marks.values())
    alike = rows.groupBy("part", *filters).agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col(f"is_{name}")).alias(name) for name in lost))

    def sums(count: str) -> Column:
        made = [reduce(Column.__mul__, (F.col(f) for i, f in enumerate(filters) if mask >> i & 1), F.col(count)) for mask in range(1 << len(filters))]
        return F.array(*(F.sum(product) for product in made)).alias(count)

    return alike.groupBy("part").agg(*(sums(c) for c in ("n", *lost)))


def audit(flagged: DataFrame, filters: str, lost: dict[str, str], part: str = "part") -> DataFrame:
    """A row for each part, order of the filters (filter_order) and step from 1, the counts as in the module's text:

    kept (after the step), removed (by it), redundant (failing its filter, but removed before), unique_fails (failing
    its filter only), ``<name>_lost`` for each flag of ``lost`` (removed by the step and flagged), and shapley (removed
    by its filter, summed over all orders). Parts with no rows don't show; an empty table gives no rows.
    """
    n, all_sets = len(filters), range(1 << len(filters))
    counts = joint_failures(flagged, filters, lost, part)
    sign = lambda mask: -1 if bin(mask).count("1") % 2 else 1
    at = lambda name, mask: F.col(name)[mask]
    left = {f"left_{c}": F.array(*(_total([at(c, s) * sign(s) for s in _subsets(mask)]) for mask in all_sets)) for c in ("n", *lost)}
    holding = [[s for s in all_sets if s >> i & 1] for i in range(n)]
    alone = F.array(*(_total([at("n", s) * -sign(s) for s in sets]) for sets in holding))
    shapley = F.array(*(_total([at("n", s) * (-sign(s) * (factorial(n) // bin(s).count("1"))) for s in sets]) for sets in holding))
    orders = F.array(*(F.lit("".join(p)) for p in permutations(filters)))
    rows = counts.withColumns(left | {"alone": alone, "shared": shapley}).withColumn("filter_order", F.explode(orders))
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    own = F.instr(F.lit(filters), F.substring("filter_order", F.col("step"), F.lit(1))) - 1
    bits = [F.when(F.instr(F.col("filter_order"), F.lit(f)) < F.col("step"), 1 << i).otherwise(0) for i, f in enumerate(filters)]
    rows = rows.withColumns({"own": own, "before": reduce(Column.__add__, bits)}).withColumn("bit", F.expr("shiftleft(1, own)"))
    after = F.col("before") + F.col("bit")
    gone = lambda c: F.get(f"left_{c}", F.col("before")) - F.get(f"left_{c}", after)
    return rows.select(
        "part", "filter_order", "step", F.get("left_n", after).alias("kept"), gone("n").alias("removed"), (F.get("n", F.col("bit")) - gone("n")).alias("redundant"),
        F.get("alone", F.col("own")).alias("unique_fails"), *(gone(c).alias(f"{c}_lost") for c in lost), F.get("shared", F.col("own")).alias("shapley"),
    )


def text_flags(docs: DataFrame) -> DataFrame:
    """doc_id, part (the language), digest of the text and the flags A to D, which need a row's own text.

    A: under 100 words; B: under 80 distinct words in 100; C: more than one character in ten is a capital A-Z; D: one
    of ``#$%&*|`` occurs. A null text is the empty text, a null language the empty string.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", BLANKS), ""))
    n, distinct, chars = F.size("words"), F.size(F.array_distinct("words")), F.char_length("text")
    capitals = chars - F.char_length(F.translate("text", ASCII_UPPER, ""))
    return rows.select(
        "doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), (n < 100).alias("A"), (distinct.cast("bigint") * 100 < n.cast("bigint") * 80).alias("B"),
        (capitals.cast("bigint") * 100 > chars.cast("bigint") * 10).alias("C"), F.col("text").rlike(r"[#$%&*|]").alias("D"),
    )


def flag_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, the flags A to E, and good and toxic by the labels, for each row of ``docs``.

    E: the text is that of a smaller doc_id anywhere in the table. A text's smallest id is found by a grouping that is
    combined before it is sent, and met again by text and id together, so copies of one text don't meet in a task.
    Repeated rows of a text's smallest id don't fail E. Rows without an id never fail it, nor do they make others fail,
    and have no labels. Of an id that is labelled repeatedly, one such label counts.
    """
    rows = materialise(text_flags(docs), "filter-flags")
    known = rows.where(F.col("doc_id").isNotNull())
    first = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    judged = known.join(first, ["digest", "doc_id"], "left").join(marks, "doc_id", "left")
    judged = judged.select("part", *"ABCD", F.col("is_first").isNull().alias("E"), "good", "toxic")
    no, without = F.lit(False), rows.where(F.col("doc_id").isNull())
    return judged.unionByName(without.select("part", *"ABCD", no.alias("E"), no.alias("good"), no.alias("toxic")))


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """:func:`audit` of the five filters of :func:`flag_documents`; other columns of either table aren't read."""
    return audit(flag_documents(docs, labels), "ABCDE", {"good": "good", "toxic": "toxic"})
