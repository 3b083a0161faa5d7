"""The audit of filters against plain counting, order by order."""

from __future__ import annotations

import random
import re
from itertools import permutations

from pyspark.sql import functions as F

from tests.conftest import SF
from tests.llm.test_operators import ODD, odd, sorted_rows
from tidebook.llm import filter_audit

DOCS = "doc_id long, text string, lang string"


def by_hand(docs, labels):
    """Every order is run as it is written: each filter in turn takes what it fails from what is left."""
    texts = {}
    for doc, text, _ in docs:
        texts.setdefault(text or "", []).append(doc)
    good, toxic = ({d for d, *v in labels if d is not None and v[i] == 1} for i in (0, 1))
    fails = []
    for doc, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        made = "A" * (len(words) < 100) + "B" * (100 * len(set(words)) < 80 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 10 * len(text))
        made += "D" * bool(re.search(r"[#$%&*|]", text)) + "E" * (doc is not None and any(d is not None and d < doc for d in texts[text]))
        fails.append((lang or "", made, doc in good, doc in toxic))
    out, shapley = {}, {}
    for part in {p for p, *_ in fails}:
        rows = [r for r in fails if r[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = list(range(len(rows)))
            for step, f in enumerate(order, 1):
                gone = [i for i in left if f in rows[i][1]]
                failing = [i for i in range(len(rows)) if f in rows[i][1]]
                left = [i for i in left if i not in set(gone)]
                out[part, order, step] = (len(left), len(gone), len(failing) - len(gone), sum(r[1] == f for r in rows), sum(rows[i][2] for i in gone), sum(rows[i][3] for i in gone))
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
    return [(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()]


def test_against_counting(spark):
    rng, docs = random.Random(3), []
    for doc in range(150):
        words = [rng.choice(["a", "B", "c#", "dd", "\tE", "f g", "|"]) if rng.random() < 0.5 else str(rng.random()) for _ in range(rng.choice([0, 3, 99, 100, 130]))]
        docs.append((doc, None if doc % 31 == 0 else " ".join(words), rng.choice(["en", "fr", None, ""])))
    docs += [(rng.choice([doc, 200 + i, -i]), text, "de") for i, (doc, text, _) in enumerate(docs[:60])] + [(None, "x", "en"), (None, docs[1][1], "en"), docs[1], docs[1]]
    rng.shuffle(docs)
    labels = [(d, rng.choice([0, 1, None]), rng.choice([0, 1])) for d in range(0, 210, 2)] + [(2, 1, 1), (2, 0, 0), (None, 1, 1)]
    got = filter_audit.audit_documents(spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted_rows(got.collect()) == sorted_rows(by_hand(docs, labels))


def test_odd_rows_and_clashing_columns(spark):
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("own")).withColumn("good", F.lit("own"))
    docs = odd(spark)
    for name in ("part", "words", "A", "E", "n", "good", "toxic", "step", "is_first", "left_n", "own"):
        docs = docs.withColumn(name, F.lit("own"))
    got = filter_audit.audit_documents(docs, labels).collect()
    assert sorted_rows(got) == sorted_rows(by_hand([(d, t, "own") for d, t in ODD], [(1, 1, 1), (3, 1, 0)]))
    assert filter_audit.audit_documents(docs.limit(0), labels).count() == 0
    assert filter_audit.audit_documents(docs, labels.limit(0)).agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0


def test_other_filters(spark):
    """Three flags with nulls, and no further flags."""
    rows = [("p", True, None, True), ("p", True, True, False), ("p", False, False, False), ("q", None, None, None)]
    got = filter_audit.audit(spark.createDataFrame(rows, "part string, X boolean, Y boolean, Z boolean"), "XYZ", {})
    assert got.count() == 2 * 6 * 3 and "good_lost" not in got.columns
    first = got.where("part = 'p' AND filter_order = 'XYZ'").orderBy("step").collect()
    assert [(r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in first] == [(1, 2, 0, 0, 6), (1, 0, 1, 0, 3), (1, 0, 1, 0, 3)]


def test_the_whole_table(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    want = by_hand([tuple(r) for r in docs.select("doc_id", "text", "lang").collect()], [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])
    assert sorted_rows(filter_audit.audit_documents(docs, labels).collect()) == sorted_rows(want)
