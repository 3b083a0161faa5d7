"""The taker queries over all of lineitem, against a walk of each taker by hand."""

from __future__ import annotations

from collections import Counter, defaultdict

import pytest

from tests.conftest import SF
from tidebook.plans import queries


@pytest.fixture(scope="module")
def by_hand(spark):
    """Each row of lineitem as a taker, with its fills (price, quantity)."""
    books = defaultdict(list)
    for r in queries.resting(spark, SF).collect():
        books[r.symbol, r.side].append((r.price if r.side == "SELL" else -r.price, r.seq, r.remaining))
    books = {k: sorted(v) for k, v in books.items()}
    out = []
    rows, seen = spark.read.parquet(f"{SF}/lineitem.parquet").collect(), Counter()
    for r in sorted(rows, key=lambda r: (r.l_partkey, r.l_suppkey, r.l_quantity, r.l_returnflag, r.l_linestatus)):
        seen[r.l_orderkey, r.l_linenumber] += 1
        sells = r.l_returnflag == "R"
        limit, left, fills = (970 if sells else 1030) if r.l_linestatus == "F" else None, float(r.l_quantity * 20), []
        for key, _, size in books.get((f"S{r.l_partkey % 50}", "BUY" if sells else "SELL"), []):
            if left <= 0 or (limit is not None and (-key < limit if sells else key > limit)):
                break
            fills.append((abs(key), min(left, float(size))))
            left -= fills[-1][1]
        out.append((f"{r.l_orderkey}-{r.l_linenumber}-{seen[r.l_orderkey, r.l_linenumber]}", "SELL" if sells else "BUY", float(r.l_quantity * 20), left <= 1e-9, fills))
    return out


def test_whole_walk(spark, by_hand):
    want = defaultdict(lambda: [0, 0.0, 0.0])
    for taker, _, _, _, fills in by_hand:
        for price, size in fills:
            n = want[taker]
            n[0], n[1], n[2] = n[0] + 1, n[1] + size, n[2] + size * price
    got = queries.QUERIES["walk_book_fill"](spark, SF).collect()
    assert {r.taker_id: (r.n_fills, float(r.traded), float(r.notional)) for r in got} == {k: tuple(map(pytest.approx, v)) for k, v in want.items()}


def test_whole_check(spark, by_hand):
    assert len({t for t, *_ in by_hand}) == len(by_hand)
    want = defaultdict(lambda: [0, 0.0])
    for _, side, qty, whole, _ in by_hand:
        want[side, whole][0] += 1
        want[side, whole][1] += qty
    got = queries.QUERIES["fok_check"](spark, SF).collect()
    assert {(r.side, r.fok_ok): [r.n, float(r.qty)] for r in got} == {k: [v[0], pytest.approx(v[1])] for k, v in want.items()}
