"""Fill-in-the-middle against slicing of token lists, and the rope against strings."""

from __future__ import annotations

import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import SF
from tests.llm.test_operators import ODD, odd, sorted_rows
from tidebook.llm import fill_in_middle as fim

UNIT = re.compile("[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def by_hand(doc, text):
    text = text or ""
    digest = sha(f"42:{'' if doc is None else doc}")
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = UNIT.findall(text)
    n = len(units)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return doc, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < 80 else "psm"
    out = f"<P>{prefix}<S>{suffix}<M>{middle}" if form == "psm" else f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc, n, form, len(prefix), len(middle), sha(out), sha(text)


TEXT = st.text(st.sampled_from(" \t\x0b\n\r\x1f\xa0ab<PSM>é中🙂\x00"), max_size=60)


@settings(max_examples=400, deadline=None)
@given(TEXT, st.integers(0, 70), st.integers(1, 7))
def test_rope_is_the_text(text, rank, leaf):
    tree, units = fim.rope(text, leaf), UNIT.findall(text)
    assert fim.flat(tree) == text == "".join(units) and (tree.chars, tree.units) == (len(text), len(units))
    for (one, two), place in ((fim.split_units(tree, rank), len("".join(units[:rank]))), (fim.split_chars(tree, rank), rank)):
        assert (fim.flat(one), fim.flat(two)) == (text[:place], text[place:])
        assert (one.chars, two.chars) == (len(text[:place]), len(text[place:])) and one.units + two.units == len(units)
        again = fim.joined(one, two)
        assert fim.flat(again) == text and (again.chars, again.units) == (tree.chars, tree.units)


@settings(max_examples=300, deadline=None)
@given(TEXT, st.integers(0, 70), st.integers(0, 70), st.sampled_from(["psm", "spm"]))
def test_the_way_back(text, a, b, form):
    text = re.sub("<[PSM]>", "", text)
    if not re.search("<[PSM]>", text):
        assert fim.restored(fim.rearranged(text, a, b, form)[0], form) == text


def test_long_texts_are_split_on_one_path():
    text = "word " * 200_000 + "x" * 300_000
    tree = fim.rope(text)
    depth = 0
    while isinstance(tree, fim.Node):
        tree, depth = tree.left, depth + 1
    assert depth <= 12 and fim.restored(fim.rearranged(text, 150_000, 3, "spm")[0], "spm") == text


def test_rows(spark):
    rng = random.Random(5)
    texts = ["", " ", "a", "<P>", "a <S", "<M> b", " a  b\tc\n", "<<P", "é中 🙂🙂 x\x00y", "\x1f \xa0 \x85"] + ["".join(rng.choice([" ", "\n", "ab", "<P", ">", "é"]) for _ in range(rng.randint(1, 40))) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, "other text of an id"), (7, "other text of an id"), (None, "no id here"), (None, None)]
    got = fim.round_trip(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted_rows(got) == sorted_rows(by_hand(*r) for r in rows)
    assert {r.form for r in got} == set(fim.FORMS)


def test_odd_rows_and_clashing_columns(spark):
    docs = odd(spark)
    for name in ("made", "form", "output", "n", "prefix_chars"):
        docs = docs.withColumn(name, F.lit("own"))
    assert sorted_rows(fim.round_trip(docs).collect()) == sorted_rows(by_hand(*r) for r in ODD)
    assert fim.round_trip(docs.limit(0)).count() == 0


def test_the_whole_table_and_other_shares(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted_rows(fim.round_trip(docs).collect()) == sorted_rows(by_hand(*r) for r in rows)
    always = fim.fill_in_middle(docs, 100, 0).collect()
    assert {r.form for r in always} == {"psm"} and {fim.restored(r.output, r.form) for r in always} == {t for _, t in rows}
