"""The pipeline's near-duplicate stage against the brute-force likeness of all pairs of texts."""

from __future__ import annotations

from itertools import combinations
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from tests.conftest import SF
from tests.llm.test_operators import ODD, odd, shingles, sorted_rows
from tidebook.llm import alike
from tidebook.llm.common import shared_root


def kept_by_hand(docs):
    """The smallest id of each group of rows that pairs of likeness 0.8 or more join."""
    sets, group = [set(shingles(t, 5)) for _, t in docs], list(range(len(docs)))
    for i, j in combinations(range(len(docs)), 2):
        a, b = sets[i], sets[j]
        if group[i] != group[j] and (a == b or (a and b and 5 * len(a & b) >= 4 * len(a | b))):
            group = [group[i] if g == group[j] else g for g in group]
    least = {}
    for (doc, _), g in zip(docs, group):
        least[g] = min((d for d in (doc, least.get(g)) if d is not None), default=None)
    return sorted_rows((d,) for d in set(least.values()))


def variants():
    """Texts of 100 to 400 words with copies that have one to twelve words changed or left out."""
    rng, out = np.random.default_rng(5), []
    word = lambda: f"w{rng.integers(30_000)}"
    for _ in range(25):
        base = [word() for _ in range(int(rng.integers(100, 400)))]
        out.append(" ".join(base))
        for changes in (1, 2, 4, 7, 12):
            copy = list(base)
            for at in rng.choice(len(copy), changes, replace=False).tolist():
                copy[at] = word() if at % 2 else ""
            out.append(" ".join(copy).upper() if changes == 2 else " ".join(copy))
    return [(5000 - n, t) for n, t in enumerate(out)]


def test_stage_equals_brute_force(spark):
    docs = [(r.doc_id + 10_000, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + variants() + ODD
    got = corpus_pipeline.keep_one_of_near_duplicates(spark, odd(spark, docs), SF)
    assert sorted_rows((r.doc_id,) for r in got.collect()) == kept_by_hand(docs)


@pytest.mark.parametrize("part", [8, 512])
def test_keys_of_many_nodes_are_whole(spark, part):
    """A large group in which most texts are alike only to the first one."""
    rng = np.random.default_rng(9)
    base = [f"b{i}" for i in range(70)]
    docs = [(0, " ".join(base))]
    for n in range(1, 61):
        copy = list(base)
        copy[int(rng.integers(5, 65))] = f"x{n}"
        docs.append((n, " ".join(copy + [f"y{n}"] * (n % 3))))
    got = alike.keep_one(spark.createDataFrame(docs, "doc_id long, text string"), part=part)
    assert sorted_rows((r.doc_id,) for r in got.collect()) == kept_by_hand(docs)


def test_pairs_are_exact():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 40, rng.integers(1, 40))).astype("<u8") for _ in range(120)]
    part, plain = rng.integers(0, 2, 120), [set(s.tolist()) for s in sets]
    for held in (None, part):
        want = {(i, j) for i, j in combinations(range(120), 2) if 5 * len(plain[i] & plain[j]) >= 4 * len(plain[i] | plain[j]) and (held is None or part[i] != part[j])}
        assert set(zip(*(x.tolist() for x in alike.alike(sets, 0.8, held)))) == want


def test_candidates_come_through_the_simhash_index(spark, monkeypatch):
    """Operator 6's index finds all alike pairs, also of tiny sets and in narrow files, and next to nothing else."""
    rng, asked = np.random.default_rng(31), []
    docs = variants()
    for n in range(40):  # sets of four and five shingles
        base = [f"s{n}_{i}" for i in range(9)]
        docs += [(9000 + 2 * n, " ".join(base[:8])), (9001 + 2 * n, " ".join(base))]
    docs += [(9500 + n, " ".join(f"z{rng.integers(30_000)}" for _ in range(40))) for n in range(400)]
    search = alike.filed_links
    monkeypatch.setattr(alike, "filed_links", lambda filed, radius: asked.append(filed.columns) or search(filed, radius))
    count, radius, blocks, width = alike.filing(200_000)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    printed = frame.select("doc_id", alike.shingled(frame["text"], count).alias("s")).select("doc_id", "s.node", "s.codes").persist()
    nodes, groups = {r.doc_id: r.node for r in printed.collect()}, {}
    for r in alike.candidates(printed, radius, blocks, width).collect():
        groups.setdefault(r.key, set()).add(r.node)
    printed.unpersist()
    found = {p for g in groups.values() for p in combinations(sorted(g), 2)}
    sets = [(nodes[d], set(shingles(t, 5))) for d, t in docs]
    pairs = [(tuple(sorted((n, m))), len(a & b) / len(a | b)) for (n, a), (m, b) in combinations(sets, 2) if n != m]
    assert asked == [["code", "file"]]
    near = {p for p, s in pairs if s >= 0.8}
    assert len(near) > 100 and near <= found
    assert len(found & {p for p, s in pairs if s < 0.3}) < 40


@pytest.mark.parametrize("nodes", [0, 1, 1023, 1024, 10**5, 10**7, 10**9])
def test_filing_misses_next_to_nothing(nodes):
    words, radius, blocks, width = alike.filing(nodes)
    assert nodes < 1024 << width and blocks * width <= 64
    assert (1 - alike.found_by_word(0.161, radius, blocks, width)) ** words < 1e-6
    assert (1 - alike.found_by_word(0.1875, radius, blocks, width)) ** (3 * words) < 1e-6


def test_found_by_word_is_what_codes_do():
    rng = np.random.default_rng(4)
    differ = rng.random((200_000, 64)) < 0.1515
    _, radius, blocks, width = alike.filing(200_000)
    clean = ~np.stack([differ[:, 64 * i // blocks : 64 * i // blocks + width].any(axis=1) for i in range(blocks)])
    got = (clean.any(axis=0) & (differ.sum(axis=1) <= radius)).mean()
    assert abs(got - alike.found_by_word(0.1515, radius, blocks, width)) < 0.005


def test_a_node_is_in_few_files():
    """112 rows a node at the check tool's large table were too many; words that are made and compared cost something too."""
    words, _, blocks, _ = alike.filing(220_497)
    assert words * blocks <= 72 and words <= 16


def test_only_near_members_of_a_group_stay(spark):
    """Before texts move: of a key's nodes those stay that have an alike one there, in blocks of one part and of two."""
    rng, sets = np.random.default_rng(8), {}
    for n in range(0, 200, 2):
        base = [f"k{n}_{i}" for i in range(120)]
        for m, words in enumerate((base, [*base[:118], "x", "y"])):
            sets[n + m] = alike.codes_of(alike.shingle_set(" ".join(words)), 8).tolist()
    for n in range(200, 260):  # alike to none
        sets[n] = alike.codes_of(alike.shingle_set(" ".join(f"r{rng.integers(10**6)}" for _ in range(80))), 8).tolist()
    codes = spark.createDataFrame(list(sets.items()), "node long, codes array<long>")
    groups = {1: range(260), 2: (0, 1), 3: (0, 2), 4: (200, 201, 0), 5: (4, 5, 230)}
    filed = spark.createDataFrame([(n, k) for k, g in groups.items() for n in g], "node long, key long")
    want = {(1, n) for n in range(200)} | {(2, 0), (2, 1), (5, 4), (5, 5)}
    for part in (4, 512):
        held = alike.Rounds(spark, "near-test")
        got = [tuple(r) for r in alike.near_candidates(filed, codes, 8, 0.8, part, held).collect()]
        held.forget_but(None)
        assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("likeness", [0.6, 0.8, 0.95])
def test_check_loses_no_alike_pair(likeness):
    bits = alike.check_bits(4, likeness)
    differ = np.random.default_rng(6).random((20_000, 256)) < alike.bit_rate(likeness) * alike.TINY_SETS
    assert (differ.sum(axis=1) <= bits).all()
    assert likeness < 0.8 or (np.random.default_rng(7).random((20_000, 256)) < 0.5).sum(axis=1).min() > bits - 8


def test_stage_leaves_no_tables_behind(spark):
    """Prints, candidates and blocks go once the kept rows are known."""
    root = Path(shared_root(spark).removeprefix("file:"))
    there = lambda: {p.name for p in root.iterdir() if p.name.startswith("alike-")}
    before = there()
    kept = alike.keep_one(spark.createDataFrame(variants() + ODD, "doc_id long, text string"))
    left = there() - before
    assert sorted_rows((r.doc_id,) for r in kept.collect()) == kept_by_hand(variants() + ODD)
    assert all(n.startswith("alike-components-") for n in left) and len(left) <= 1
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None


def test_plans_of_the_encoding_are_short(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").selectExpr("doc_id", "text", "'en' lang", "'s' source", "length(text) n_chars")
    assert len(corpus_pipeline.encode_bytes(spark, docs, SF)._jdf.queryExecution().toString()) <= corpus_pipeline.PLAN_CHARS
