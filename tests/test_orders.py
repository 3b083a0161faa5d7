"""Orders, risk, matching, messages and sessions against hand-made cases."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tidebook.functions import fixmsg, ticks
from tidebook.operators import depth, fixsession, lifetimes, matching, orders, risk, stats
from tidebook.plans import queries
from tidebook.schemas import COMMAND, EXECUTION, ORDER


def report(idx, kind, status, qty=0.0, px=None, cum=None, order="D05", text=""):
    return (idx, order, kind, status, "V1", f"E{idx}", float(qty), px, cum, text, idx)


def apply(spark, reports, qty=100.0):
    known = spark.createDataFrame([("D05", "SYM", "BUY", qty, 3450, "LIMIT", "DAY")], ORDER)
    return sorted(orders.apply_reports(known, spark.createDataFrame(reports, EXECUTION)).collect(), key=lambda r: r.idx)


def test_fills_average(spark):
    got = apply(spark, [report(1, "NEW", "NEW"), report(2, "TRADE", "PARTIALLY_FILLED", 40, 3450), report(3, "TRADE", "FILLED", 60, 3460)])
    assert got[-1].status == "FILLED" and got[-1].avg_px == 3456 and got[-1].cum_qty == 100 and not any(r.error for r in got)


@pytest.mark.parametrize(
    ("reports", "errors"),
    [
        ([report(1, "NEW", "NEW"), report(2, "CANCELED", "CANCELED"), report(3, "TRADE", "FILLED", 100, 1)], [None, None, "illegal_transition"]),
        ([report(1, "TRADE", "FILLED", 101, 1)], ["overfill"]),
        ([report(1, "TRADE", "FILLED", 0, None)], ["trade_without_quantity_or_price"]),
        ([report(1, "NEW", "NEW", cum=5.0)], ["cum_qty_mismatch"]),
        ([report(1, "NEW", "NEW"), report(2, "PENDING_CANCEL", "PENDING_CANCEL"), report(3, "TRADE", "PARTIALLY_FILLED", 10, 1), report(4, "CANCELED", "CANCELED", cum=10.0)], [None] * 4),
        ([report(1, "NEW", "NEW"), report(2, "TRADE", "FILLED", 500, 1), report(3, "TRADE", "FILLED", 100, 1)], [None, "overfill", None]),
        ([report(1, "NEW", "NEW", order="?")], ["unknown_order"]),
    ],
)
def test_refused_reports(spark, reports, errors):
    assert [r.error for r in apply(spark, reports)] == errors


def test_new_orders(spark):
    rows = [(1, None, 5.0, "LIMIT", 10), (2, "A", 1.0, "LIMIT", 10), (3, "A", 1.0, "LIMIT", 10), (4, "B", 0.0, "MARKET", None), (5, "C", 1.0, "LIMIT", None), (6, None, 2.0, "MARKET", None)]
    got = {r.idx: r for r in orders.new_orders(spark.createDataFrame(rows, "idx long, cl_ord_id string, qty double, ord_type string, price long")).collect()}
    assert [got[i].error for i in range(1, 7)] == [None, None, "duplicate id", "quantity must be positive", "limit order without price", None]
    assert got[1].cl_ord_id == "ORD-00000001" and got[6].cl_ord_id == "ORD-00000002"


def test_static_checks_in_their_order(spark):
    limits = risk.Limits(max_order_qty=100, price_collar_bps=100, lot_size=0.1, tick_size=5, allow_market=False, max_order_value=1e6)
    rows = [(0.0, 100, 100.0, False), (1.0, None, 100.0, True), (1.0, None, 100.0, False), (0.25, 100, 100.0, False), (0.3, 101, 100.0, False), (101.0, 100, 100.0, False), (1.0, 105, 100.0, False), (0.3, 100, 100.0, False), (1.0, 100, None, False)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, qty double, price long, mid double, is_market boolean")
    got = [r.check for r in risk.decisions(frame, risk.static_check(limits)).orderBy("i").collect()]
    assert got == ["qty_sign", "market_disabled", "missing_price", "lot_size", "tick_size", "max_order_qty", "price_collar", None, None]
    assert {r.check for r in risk.decisions(frame, risk.static_check(limits, killed=True)).collect()} == {"kill_switch"}
    engine = risk.RiskEngine(limits)
    assert got == [engine.check("BUY", q, p, m, k, 0.0, 0.0, 0.0, []) for q, p, m, k in rows]


def test_throttle_counts_accepted_messages_alone(spark):
    times = [0, 0.1, 0.2, 0.9, 1.15, 1.2, 9.0]
    frame = spark.createDataFrame([("S", i, float(t)) for i, t in enumerate(times)], "symbol string, idx long, t_s double")
    assert [r.accepted for r in risk.throttled(frame, 2).orderBy("idx").collect()] == [True, True, False, False, True, True, True]


def test_throttle_with_times_that_go_back(spark):
    rng = np.random.default_rng(4)
    times = np.cumsum(rng.choice([0.1, 0.5, 1.5, 40.0, -30.0], 400, p=[0.5, 0.2, 0.2, 0.05, 0.05])).tolist()
    frame = spark.createDataFrame([("S", i, t) for i, t in enumerate(times)], "symbol string, idx long, t_s double")
    one, want = risk.Throttle(2), []
    for t in times:
        want.append(one.accept(t))
    assert [r.accepted for r in risk.throttled(frame, 2, width=30).orderBy("idx").collect()] == want


def test_exposure_as_of_arrival(spark):
    rng = np.random.default_rng(5)
    changes = [(f"S{rng.integers(2)}", i, float(rng.integers(-5, 6)), float(rng.integers(0, 3)), float(rng.integers(0, 3)), int(rng.integers(-1, 2))) for i in range(200)]
    asked = [(f"S{rng.integers(2)}", int(rng.integers(0, 205)), n) for n in range(60)]
    got = orders.exposure_as_of(spark.createDataFrame(changes, "symbol string, idx long, d_position double, d_buy double, d_sell double, d_open int"), spark.createDataFrame(asked, "symbol string, idx long, n long"), width=20).collect()
    assert len(got) == len(asked)
    for r in got:
        held = [c for c in changes if c[0] == r.symbol and c[1] < r.idx]
        p, b, s, o = (sum(c[i] for c in held) for i in (2, 3, 4, 5))
        assert (r.position, r.max_long, r.max_short, r.n_open) == (p, p + b, p - s, o)


def test_self_trades(spark):
    working = spark.createDataFrame([("S", "SELL", 105), ("S", "SELL", None), ("S", "BUY", 95)], "symbol string, side string, price long")
    asked = spark.createDataFrame([("S", "BUY", 104), ("S", "BUY", 105), ("S", "SELL", 95), ("S", "SELL", 96), ("S", "BUY", None), ("T", "BUY", 500)], "symbol string, side string, price long")
    assert sorted((r.side, r.price) for r in risk.self_trades(asked, working).collect()) == [("BUY", 105), ("SELL", 95)]


START = [("add", None, "BUY", 50, 99), ("add", None, "BUY", 20, 100), ("add", None, "SELL", 15, 101), ("add", None, "SELL", 30, 102)]


def matched(spark, commands):
    rows = [("S", i, op, c, s, float(q), p, *((kind, tif) if op == "submit" else (None, None))) for i, (op, c, s, q, p, kind, tif) in enumerate([(*x, "LIMIT", "DAY") if len(x) == 5 else x for x in [*START, *commands]])]
    got = sorted(matching.match(spark.createDataFrame(rows, COMMAND)).collect(), key=lambda r: (r.idx, r.kind, r.n))
    return [(r.cl_ord_id, r.ord_status, r.last_qty, r.last_px, r.cum_qty) for r in got if r.kind == "report"], [(r.last_px, r.last_qty) for r in got if r.kind == "trade"]


def test_walks_the_book_and_rests(spark):
    reports, trades = matched(spark, [("submit", "A", "BUY", 50, 102), ("cancel", "A", None, 0, None)])
    assert trades == [(101, 15.0), (102, 30.0)]
    assert [r[1] for r in reports] == ["NEW", "PARTIALLY_FILLED", "PARTIALLY_FILLED", "CANCELED"] and reports[-1][4] == 45.0


def test_queue_position_and_flow_behind_it(spark):
    reports, _ = matched(spark, [("submit", "A", "BUY", 10, 100), ("cancel_ahead", None, "BUY", 12, 100), ("market", None, "SELL", 13, None)])
    assert [(r[0], r[1], r[2]) for r in reports if r[2] == r[2] and r[2]] == [("A", "PARTIALLY_FILLED", 5.0)]


@pytest.mark.parametrize(
    ("command", "last"),
    [
        (("submit", "A", "BUY", 20, 101, "LIMIT", "IOC"), "CANCELED"), (("submit", "A", "BUY", 46, None, "MARKET", "FOK"), "REJECTED"), (("submit", "A", "BUY", 45, None, "MARKET", "DAY"), "FILLED"),
        (("submit", "A", "BUY", 20, None, "LIMIT", "DAY"), "REJECTED"), (("cancel", "?", None, 0, None), "REJECTED"),
    ],
)
def test_order_kinds(spark, command, last):
    assert matched(spark, [command])[0][-1][1] == last


def test_walks_of_any_depth_equal_a_plain_walk(spark):
    rng = np.random.default_rng(9)
    rest = [("S", side, int(rng.integers(90, 100) + (11 if side == "SELL" else 0)), i, float(rng.integers(1, 30))) for i, side in enumerate(rng.choice(["BUY", "SELL"], 120))]
    takers = [(i, "S", str(rng.choice(["BUY", "SELL"])), float(rng.integers(0, 900)), None if rng.random() < 0.5 else int(rng.integers(88, 114))) for i in range(40)]
    want = []
    for taker, _, side, left, limit in takers:
        for _, own, price, seq, size in sorted((r for r in rest if r[1] != side), key=lambda r: (r[2] if side == "BUY" else -r[2], r[3])):
            if left <= 0 or (limit is not None and (price > limit if side == "BUY" else price < limit)):
                break
            want.append((taker, price, seq, min(left, size)))
            left -= size
    frames = spark.createDataFrame(takers, "taker_id long, symbol string, side string, qty double, limit_px long"), spark.createDataFrame(rest, "symbol string, side string, price long, seq long, remaining double")
    for step in (1, 7, 256):
        assert sorted(tuple(r) for r in depth.walk(*frames, ["symbol"], step).collect()) == sorted(want)


def test_static_walk_equals_the_venue(spark):
    venue_trades = matched(spark, [("submit", "A", "BUY", 33, 102, "LIMIT", "IOC")])[1]
    rest = spark.createDataFrame([("S", side, p, i, float(q)) for i, (_, _, side, q, p) in enumerate(START)], "symbol string, side string, price long, seq long, remaining double")
    taker = spark.createDataFrame([(1, "S", "BUY", 33.0, 102)], "taker_id long, symbol string, side string, qty double, limit_px long")
    assert sorted((r.price, r.fill) for r in depth.walk(taker, rest, ["symbol"]).collect()) == venue_trades
    assert depth.can_fill(taker, rest, ["symbol"]).first().fok_ok


def test_sums_of_walks_are_those_of_their_fills(spark):
    """Also with equal takers, empty sides, orders without size, and limits beyond and before all levels."""
    rng = np.random.default_rng(4)
    rest = [(s, side, int(rng.integers(90, 100) + (11 if side == "SELL" else 0)), i, float(rng.integers(0, 30))) for i, (s, side) in enumerate(zip(rng.choice(["S", "T"], 200), rng.choice(["BUY", "SELL"], 200))) if (s, side) != ("T", "BUY")]
    takers = [(i, str(rng.choice(["S", "T", "U"])), str(rng.choice(["BUY", "SELL"])), float(rng.choice([0, 1, 50, 50, 700, 9000, *rng.integers(0, 900, 3)])), None if rng.random() < 0.4 else int(rng.integers(85, 116))) for i in range(150)]
    frames = spark.createDataFrame(takers, "taker_id long, symbol string, side string, qty double, limit_px long"), spark.createDataFrame(rest, "symbol string, side string, price long, seq long, remaining double")
    fills = depth.walk(*frames, ["symbol"]).groupBy("taker_id").agg(F.count(F.lit(1)), F.sum("fill"), F.sum(F.col("fill") * F.col("price")))
    want = {r[0]: tuple(r)[1:] for r in fills.collect()}
    for n in (2, 10_000):
        assert {r.taker_id: (r.n_fills, r.traded, r.notional) for r in depth.traded(*frames, ["symbol"], n).collect()} == want
    assert {r.taker_id: (r.available, r.fok_ok) for r in depth.can_fill(*frames, ["symbol"]).collect()} == {t: (want.get(t, (0, 0.0))[1], want.get(t, (0, 0.0))[1] >= q) for t, _, _, q, _ in takers}


def test_lifetimes_are_whole_and_short(spark):
    rng = np.random.default_rng(2)
    spans = [(int(a), int(a + n)) for a, n in zip(rng.integers(0, 5000, 200), rng.integers(-2, 3000, 200))] + [(0, 1), (0, 4096), (1, 4097), (2**50, 2**50 + 10**6)]
    rows = spark.createDataFrame(spans, "a long, b long").select("a", "b", lifetimes.blocks(F.col("a"), F.col("b"), lifetimes.levels_for(F.lit(2**51))).alias("cut")).collect()
    for r in rows:
        held = sorted((x.block << lifetimes.BITS * x.level, (x.block + 1) << lifetimes.BITS * x.level) for x in r.cut)
        assert len(held) <= 14 * (max(1, r.b - r.a).bit_length() // lifetimes.BITS + 1)
        assert all(a[1] == b[0] for a, b in zip(held, held[1:])) and (held[0][0], held[-1][1]) == (r.a, r.b) if r.b > r.a else not held


def test_what_works_at_arrival_equals_all_pairs(spark):
    rng = np.random.default_rng(6)
    works = [(str(rng.choice(["S", "T"])), str(rng.choice(["BUY", "SELL"])), None if rng.random() < 0.1 else int(rng.integers(90, 110)), int(a := rng.integers(0, 400)), None if rng.random() < 0.2 else int(a + rng.integers(-1, 120))) for _ in range(60)]
    asks = [(str(rng.choice(["S", "T", "U"])), int(rng.integers(0, 500)), str(rng.choice(["BUY", "SELL"])), None if rng.random() < 0.1 else int(rng.integers(85, 115)), i) for i in range(200)]
    working = spark.createDataFrame(works, "symbol string, side string, price long, from_idx long, until_idx long")
    asked = spark.createDataFrame(asks, "symbol string, idx long, side string, price long, n long")
    lives = lambda s, side, i: [p for w, own, p, a, b in works if w == s and own == side and p is not None and a <= i and (b is None or i < b)]
    want = [n for s, i, side, p, n in asks if p is not None and any(p >= q if side == "BUY" else p <= q for q in lives(s, "SELL" if side == "BUY" else "BUY", i))]
    assert sorted(r.n for r in risk.self_trades_as_of(asked, working).collect()) == want
    quotes = {r.n: (r.bid, r.ask) for r in lifetimes.quotes_as_of(asked, working).collect()}
    assert quotes == {n: (max(lives(s, "BUY", i), default=None), min(lives(s, "SELL", i), default=None)) for s, i, _, _, n in asks}


@pytest.mark.parametrize("rows,batch", [(20_000, 10_000), (10, 7), (1, 1)])
def test_quotes_in_slices_and_parts_equal_all_pairs(spark, rows, batch):
    rng = np.random.default_rng(8)
    names = ["S", "T", None]
    # bursts and long lives; every third moment is asked for at one place
    works = [(names[rng.integers(0, 3)], None if rng.random() < 0.1 else float(rng.integers(90, 110)), int(a := rng.integers(0, 2000) if rng.random() < 0.5 else 700 + rng.integers(0, 5)), None if rng.random() < 0.2 else int(a + rng.integers(-1, 1500 if rng.random() < 0.3 else 20))) for _ in range(300)]
    asks = [(names[rng.integers(0, 3)], None if rng.random() < 0.05 else 703 if i % 3 == 0 else int(rng.integers(-5, 4000)), i) for i in range(400)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        standing, asked = spark.createDataFrame(works, "symbol string, price double, from_idx long, until_idx long"), spark.createDataFrame(asks, "symbol string, idx int, n long")
        out = lifetimes.least_as_of(asked, standing, ["symbol"], {"least": F.col("price"), "most": -F.col("price")}, rows)
        got = {r.n: (r.symbol, r.idx, r.least, r.most and -r.most) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert out.dtypes[:3] == asked.dtypes and len(got) == len(asks)
    for s, i, n in asks:
        stood = [p for w, p, a, b in works if s is not None and i is not None and w == s and p is not None and a <= i and (b is None or i < b)]
        assert got[n] == (s, i, min(stood, default=None), max(stood, default=None))


@pytest.mark.parametrize("name", ["quotes_as_of", "self_trade_as_of"])
def test_moments_and_lifetimes_are_sent_about_once(spark, name):
    sc, group = spark.sparkContext, f"sent-{name}"
    sc.setJobGroup(group, name)
    try:
        queries.QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    tracker, store = sc.statusTracker(), sc._jsc.sc().statusStore()
    stages = {i for job in tracker.getJobIdsForGroup(group) for i in tracker.getJobInfo(job).stageIds}
    sent = sum(store.lastStageAttempt(i).shuffleWriteRecords() for i in stages)
    rows = sum(spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("orders", "lineitem"))
    assert rows < sent < 4 * rows


def test_self_trades_of_many_at_one_moment(spark):
    working = spark.createDataFrame([("S", "SELL", 100, 0, 20), ("S", "SELL", 101, 0, None), ("S", "BUY", 90, 5, None), ("T", "SELL", 1, 0, None), (None, "SELL", 1, 0, None)], "symbol string, side string, price long, from_idx long, until_idx long")
    asks = [("S", "BUY", 100), ("S", "BUY", 99), ("S", "SELL", 90), ("S", "SELL", 91), ("S", None, 90), (None, "BUY", 100), ("S", "BUY", None)]
    asked = spark.createDataFrame([(i, s, side, p, t) for i, (s, side, p) in enumerate(asks) for t in [4, 19, 20] * 50], "n int, symbol string, side string, price long, idx long")
    got = {(r.n, r.idx): r["count"] for r in risk.self_trades_as_of(asked, working).groupBy("n", "idx").count().collect()}
    assert got == {(0, 4): 50, (0, 19): 50, (2, 19): 50, (2, 20): 50}


def test_quotes_of_nothing(spark):
    asked, standing = (spark.createDataFrame(rows, kind) for rows, kind in (([("S", 1), ("S", None), (None, 2)], "symbol string, idx long"), ([("S", "BUY", 5, 0, None)], "symbol string, side string, price long, from_idx long, until_idx long")))
    plain = lambda f: sorted(map(tuple, f.collect()), key=str)
    assert plain(lifetimes.quotes_as_of(asked, standing.where("false"))) == plain(asked.selectExpr("symbol", "idx", "null", "null", "null"))
    assert plain(lifetimes.quotes_as_of(asked.where("false"), standing)) == []
    assert plain(lifetimes.quotes_as_of(asked, standing)) == sorted([("S", 1, 5, None, None), ("S", None, None, None, None), (None, 2, None, None, None)], key=str)


def plainly_matched(commands):
    """The rules of price and time as they are written: all orders in one list, sorted anew for each command."""
    rest, out, counts, done = [], [], {"V": 0, "E": 0}, 1e-12

    def number(kind):
        counts[kind] += 1
        return f"{kind}{counts[kind]:08d}"

    for idx, op, name, side, qty, price, kind, tif in commands:
        made, trades = [], []

        def report(who, exec_type, status, made=made, **more):
            if who is not None:
                made.append((who, exec_type, status, number("E"), *(more.get(k) for k in ("order_id", "last_qty", "last_px", "cum_qty"))))

        def trade(who, order_id, left, made=made, trades=trades, side=side, price=price, report=report):
            for o in sorted((o for o in rest if o["side"] != side), key=lambda o: (o["price"] if side == "BUY" else -o["price"], o["n"])):
                if left <= done or (price is not None and (o["price"] > price if side == "BUY" else o["price"] < price)):
                    break
                size = min(left, o["left"])
                o["left"], left = o["left"] - size, left - size
                trades.append((o["price"], size, side))
                report(o["name"], "TRADE", "FILLED" if o["left"] <= done else "PARTIALLY_FILLED", order_id=o["id"], last_qty=size, last_px=o["price"])
                report(who, "TRADE", "FILLED" if left <= done else "PARTIALLY_FILLED", order_id=order_id, last_qty=size, last_px=o["price"])
            return left

        if op == "add":
            rest.append({"name": None, "id": None, "side": side, "price": price, "qty": qty, "left": qty, "n": idx})
        elif op == "market":
            price_of_flow = price
            assert price_of_flow is None
            trade(None, None, qty)
        elif op == "cancel_ahead":
            left = qty
            for o in sorted((o for o in rest if (o["side"], o["price"], o["name"]) == (side, price, None)), key=lambda o: o["n"]):
                size = min(left, o["left"])
                o["left"], left = o["left"] - size, left - size
        elif op == "cancel":
            found = [o for o in rest if o["name"] == name]
            if found:
                report(name, "CANCELED", "CANCELED", order_id=found[0]["id"], cum_qty=found[0]["qty"] - found[0]["left"])
                found[0]["left"] = 0.0
            else:
                report(name, "REJECTED", "REJECTED")
        else:
            depth_within = sum(o["left"] for o in rest if o["side"] != side and (price is None or (o["price"] <= price if side == "BUY" else o["price"] >= price)))
            if any(o["name"] == name for o in rest) or (kind == "LIMIT" and price is None) or (tif == "FOK" and depth_within < qty - done):
                report(name, "REJECTED", "REJECTED")
            else:
                order_id = number("V")
                report(name, "NEW", "NEW", order_id=order_id)
                left = trade(name, order_id, qty)
                if left > done and (kind == "MARKET" or tif in ("IOC", "FOK")):
                    report(name, "CANCELED", "CANCELED", order_id=order_id, cum_qty=qty - left)
                elif left > done:
                    rest.append({"name": name, "id": order_id, "side": side, "price": price, "qty": qty, "left": left, "n": idx})
        rest[:] = [o for o in rest if o["left"] > done]
        out += [(idx, "report", n, *m) for n, m in enumerate(made)] + [(idx, "trade", n, *t) for n, t in enumerate(trades)]
    return out


def as_plain(rows):
    clean = lambda v: None if isinstance(v, float) and v != v else v
    return [
        (r.idx, r.kind, r.n, *map(clean, (r.cl_ord_id, r.exec_type, r.ord_status, r.exec_id, r.order_id, r.last_qty, r.last_px, r.cum_qty) if r.kind == "report" else (r.last_px, r.last_qty, r.aggressor)))
        for r in sorted(rows, key=lambda r: (r.idx, r.kind, r.n))
    ]


def test_matching_equals_a_plain_list_of_orders(spark):
    rng, commands = np.random.default_rng(12), []
    for i in range(900):
        op = str(rng.choice(["add", "add", "submit", "submit", "submit", "market", "cancel", "cancel_ahead"]))
        price = None if op == "market" or (op == "submit" and rng.random() < 0.1) else int(rng.integers(95, 106))
        commands.append((i, op, f"c{int(rng.integers(0, i + 1)) if op == 'cancel' or rng.random() < 0.05 else i}", str(rng.choice(["BUY", "SELL"])), float(rng.choice([0.5, 1, 2, 7])), price, str(rng.choice(["LIMIT", "LIMIT", "MARKET"])), str(rng.choice(["DAY", "DAY", "IOC", "FOK"]))))
    frame = spark.createDataFrame([("S", *c) for c in commands], COMMAND)
    assert as_plain(matching.match(frame).collect()) == plainly_matched(commands)


def test_the_matching_query_equals_a_plain_list_of_orders(spark):
    seen = {}
    original = matching.match
    try:
        matching.match = lambda commands: seen.setdefault("rows", commands) and original(commands)
        got = queries.QUERIES["matching_fold"](spark, SF).collect()
    finally:
        matching.match = original
    commands = {}
    for r in sorted(seen["rows"].collect(), key=lambda r: r.idx):
        commands.setdefault(r.symbol, []).append((r.idx, r.op, r.cl_ord_id, r.side, r.qty, r.price, r.ord_type, r.tif))
    assert set(commands) == {r.symbol for r in got}
    for symbol, rows in commands.items():
        assert as_plain(r for r in got if r.symbol == symbol) == plainly_matched(rows)


# --- messages ---------------------------------------------------------------------------------------------------------


def framed(body, spark):
    fields = [tuple(p.split("=", 1)) for p in body.split("|")]
    return spark.range(1).select(fixmsg.encode(F.lit(fields[0][1]), [(int(t), F.lit(v)) for t, v in fields[1:]])).first()[0]


def decode(spark, raw):
    frame = spark.createDataFrame([(raw,)], "raw string").select(fixmsg.decoded(F.col("raw")).alias("m"))
    return frame.select("m.error", F.col("m.fields").alias("f")).first()


def test_frames_and_checksums(spark):
    raw = framed("35=0|49=A|56=B", spark)
    assert raw.startswith("8=FIX.4.4\x019=15\x0135=0\x01") and raw.endswith("\x01") and decode(spark, raw).error is None
    sums = spark.createDataFrame([("",), ("A",), ("\x01" * 256,), ("é",)], "t string").select(fixmsg.checksum(F.col("t"))).collect()
    assert [r[0] for r in sums] == ["000", "065", "000", None]
    assert decode(spark, framed("35=D|58=a=b", spark)).f[3].value == "a=b"


@pytest.mark.parametrize(
    ("change", "error"),
    [
        (lambda r: r[:-1], "no_trailing_soh"), (lambda r: "8=FIX.4.4\x01", "too_few_fields"), (lambda r: r.replace("49=A", "49A"), "field_without_equals"), (lambda r: r.replace("49=A", "x=A"), "tag_not_numeric"),
        (lambda r: r.replace("8=F", "7=F", 1), "begin_string_not_first"), (lambda r: r.replace("\x019=", "\x017=", 1), "body_length_not_second"), (lambda r: r.replace("\x0110=", "\x0111="), "checksum_not_last"),
        (lambda r: r.replace("49=A", "49=C"), "checksum_mismatch"),
    ],
)
def test_damaged_messages(spark, change, error):
    assert decode(spark, change(framed("35=0|49=A|56=B", spark))).error == error


def test_streams_cut_anywhere(spark):
    whole = framed("35=0|49=A|56=B", spark) + framed("35=D|58=8=FIX.4.4|11=1", spark) + framed("35=D|58=10=|11=1", spark)
    for cut in range(len(whole) + 1):
        first, rest = fixsession.split_stream(whole[:cut])
        second, left = fixsession.split_stream(rest + whole[cut:])
        assert "".join(first + second) == whole and len(first + second) == 3 and not left
    assert fixsession.split_stream("junk" + whole)[0][0].startswith("8=FIX")
    rows = spark.createDataFrame([("c", i, c) for i, c in enumerate(whole)], "conn string, idx long, raw string")
    assert "".join(r.message or "" for r in fixsession.split_streams(rows).orderBy("idx", "n").collect()) == whole


def test_decoding_equals_plain_expressions(spark):
    """Fields as the column expression splits them, and the error of a plain check of each message."""
    sound = framed("35=D|49=A|58=a=b|11=", spark)
    texts = [sound, sound[:-1], "", None, "\x01", "a\x01b\x01c\x01", "8=FIX.4.4\x019=x\x0110=000\x01", sound.replace("35=D", "35=É"), sound.replace("9=", "9=0"), sound.replace("49=A", " 49 =A"), sound.replace("49=A", "4294967299=A"), sound + "junk", sound.replace("11=", "=")]

    def plain(raw):
        parts = raw.split("\x01")
        halves = [p.split("=", 1) for p in parts[:-1]]
        number = lambda t: int(t) if t.strip().lstrip("+-").isdigit() and abs(int(t)) < 2**31 else None
        if not raw.endswith("\x01"):
            return "no_trailing_soh"
        if len(halves) < 3:
            return "too_few_fields"
        if any(len(h) == 1 for h in halves):
            return "field_without_equals"
        tags = [number(h[0]) for h in halves]
        if None in tags:
            return "tag_not_numeric"
        for place, tag, error in ((0, 8, "begin_string_not_first"), (1, 9, "body_length_not_second"), (-1, 10, "checksum_not_last")):
            if tags[place] != tag:
                return error
        prefix = raw[: len(raw) - len(parts[-2]) - 1]
        if not prefix.isascii() or f"{sum(prefix.encode()) % 256:03d}" != halves[-1][1]:
            return "checksum_mismatch"
        if number(halves[1][1]) is None:
            return "body_length_not_numeric"
        return None if number(halves[1][1]) == len(prefix) - len(parts[0]) - len(parts[1]) - 2 else "body_length_mismatch"

    resum = lambda t: t[: -len(t.split("\x01")[-2]) - 1] + f"10={sum(t[: -len(t.split(chr(1))[-2]) - 1].encode()) % 256:03d}\x01"
    texts += [resum(sound.replace("\x019=", "\x019=1")), resum(sound.replace("\x019=", "\x019=x")), resum(sound.replace("\x019=", "\x019=0"))]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, raw string").coalesce(1)
    for r in frame.select("raw", fixmsg.decoded(F.col("raw")).alias("m"), fixmsg.fields_of(F.col("raw")).alias("f")).collect():
        assert r.m.fields == r.f and r.m.error == (None if r.raw is None else plain(r.raw)), r.raw


def test_required_fields(spark):
    frame = spark.createDataFrame([(framed("35=0|49=A", spark),)], "raw string").withColumn("f", fixmsg.fields_of(F.col("raw")))
    assert frame.select(fixmsg.require(F.col("f"), 49)).first()[0] == "A"
    with pytest.raises(Exception, match="required tag 56"):
        frame.select(fixmsg.require(F.col("f"), 56)).collect()


def test_signed_fills(spark):
    frame = spark.createDataFrame([("BUY", 3.0), ("SELL", 2.0)], "side string, q double")
    assert [r[0] for r in frame.select(orders.signed_filled(F.col("side"), F.col("q"))).collect()] == [3.0, -2.0]


def test_utc_text(spark):
    assert spark.range(1).select(fixmsg.utc_timestamp(F.lit(1789291800123999999))).first()[0] == "20260913-09:30:00.123"


def active(heartbeat=30.0):
    s = fixsession.Session(fixsession.Rules(heartbeat=heartbeat))
    assert [o.kind for o in s.begin(0.0)] == ["A"] and s.hear("A", 1, {}, 0.0) == ([], False) and s.status == "ACTIVE"
    return s


def bodies(out):
    return [(o.kind, o.body) for o in out]


def test_numbers_out_of_turn():
    s = active()
    assert bodies(s.hear("D", 7, {}, 1.0)[0]) == [("2", {7: "2", 16: "0"})]
    assert s.hear("D", 7, {43: "Y"}, 1.0) == ([], False) and s.hear("D", 2, {}, 1.0) == ([], True)
    assert bodies(s.hear("D", None, {}, 1.0)[0]) == [("3", {58: "missing MsgSeqNum"})]
    out, deliver = s.hear("D", 1, {}, 1.0)
    assert bodies(out) == [("5", {58: "MsgSeqNum too low, expecting 3"})] and not deliver and s.status == "LOGOUT_SENT"


def test_resets_of_the_number():
    s = active()
    assert bodies(s.hear("4", 9, {36: "1"}, 1.0)[0]) == [("3", {45: "9", 58: "NewSeqNo below expected"})]
    assert bodies(s.hear("4", None, {36: "x"}, 1.0)[0]) == [("3", {58: "missing NewSeqNo"})]
    assert s.hear("4", 9, {36: "20"}, 1.0) == ([], False) and s.expected == 20


def test_clock():
    s = active()
    kinds = lambda at: [o.kind for o in s.wake(at)]
    assert kinds(29.9) == [] and kinds(31.0) == ["0"] and kinds(37.0) == ["1"] and kinds(38.0) == []
    assert s.hear("0", 2, {112: "other"}, 39.0) == ([], False) and s.test is not None
    assert s.hear("0", 3, {112: s.test}, 40.0) == ([], False) and s.test is None
    assert kinds(120.0) == ["0", "5"] and s.status == "DISCONNECTED" and kinds(500.0) == []


def test_session_messages_in_turn():
    s = active()
    assert bodies(s.hear("1", 2, {112: "ping"}, 1.0)[0]) == [("0", {112: "ping"})]
    assert bodies(s.hear("5", 3, {}, 1.0)[0]) == [("5", {58: "logout ack"})] and s.status == "DISCONNECTED"
    s = active()
    s.end(1.0)
    assert s.hear("5", 2, {}, 2.0) == ([], False)
    s = fixsession.Session()
    s.begin(0.0)
    assert s.hear("D", 1, {}, 0.0) == ([], True) and s.status == "ACTIVE"


def test_sent_again_in_islands():
    s = active()
    s.write("D", 1_000_000_000.25, {11: "x", 58: "a"})
    s.write("0", 3.0)
    s.write("D", 4.0, {11: "y"})
    s.write("0", 5.0)
    before = s.number
    again = s.again(1, 0, 6.0)
    assert [(o.kind, o.number, o.body.get(36)) for o in again] == [("4", 1, "2"), ("D", 2, None), ("4", 3, "4"), ("D", 4, None), ("4", 5, "6")] and s.number == before
    assert [(o.kind, o.number) for o in s.again(2, 2, 6.0)] == [("D", 2)] and s.again(9, 0, 6.0) == []
    first = again[1]
    assert first.body[43] == "Y" and first.body[122] == "20010909-01:46:40.250" and first.body[11] == "x"


def test_what_goes_out_again_is_framed_anew(spark):
    s = active()
    s.write("D", 1.0, {11: "x"})
    plain = [s.raw(o) for o in (*s.again(1, 0, 60.0), s.write("D", 2.0, {11: "y"}))]
    for raw in plain:
        assert decode(spark, raw).error is None
    again = decode(spark, plain[1]).f
    assert {f.tag: f.value for f in again}[122] == "19700101-00:00:01.000" and {f.tag: f.value for f in again}[52] == "19700101-00:01:00.000"


def test_a_logon_begins_a_session_of_its_own(spark):
    kind = "conn string, idx long, op string, t_s double, msg_type string, seq long, body map<int,string>"
    day = [("logon", 0.0, None, None, None), ("message", 1.0, "A", 1, {108: "10"}), ("send", 2.0, "D", None, {11: "x"}), ("message", 3.0, "D", 2, None), ("message", 4.0, "2", 3, {7: "1", 16: "0"}), ("poll", 17.0, None, None, None), ("logout", 18.0, None, None, None)]
    rows = [("c", d * 100 + i, op, d * 1000.0 + t, k, q, b) for d in range(3) for i, (op, t, k, q, b) in enumerate(day)]
    got = fixsession.run_sessions(spark.createDataFrame(rows, kind), width=10).collect()
    by_day = {}
    for r in sorted(got, key=lambda r: (r.idx, r.n)):
        by_day.setdefault(r.idx // 100, []).append((r.idx % 100, r.n, r.state, r.in_seq, r.out_seq, r.deliver, r.out_type, r.out_msg_seq))
    assert by_day[0] == by_day[1] == by_day[2]
    assert [x[6] for x in by_day[0]] == ["A", None, "D", None, "4", "D", "0", "1", "5"] and [x[5] for x in by_day[0]].count(True) == 1


def test_registered_sessions_against_a_plain_loop(spark):
    """Of the query's sessions: numbers go 1, 2, 3, then the fourth is missing for good, so all later ones are early."""
    got, want = {}, {}
    for r in queries.fix_session(spark, SF).collect():
        got.setdefault(r.conn, []).append((r.idx, r.n, r.in_seq, r.deliver, r.out_type))
    sent = {}
    for r in sorted(queries.sent(spark, SF).collect(), key=lambda r: r.seq):
        sent.setdefault(str(r.conn), []).append((r.seq, r.msg_type))
    for conn, log in sent.items():
        rows, expected, wrote, heard, tested, over = [(0, 0, 1, False, "A")], 1, 0.0, 0.0, False, False
        for seq, kind in log:
            if seq % 9 == 5:
                continue
            now, out, deliver = seq * 12.0, [], False
            if seq % 4 == 0:
                if not over:
                    if now - wrote >= 30:
                        out.append("0")
                    if now - heard >= 72:
                        out.append("5")
                        over = True
                    elif now - heard >= 36 and not tested:
                        out.append("1")
                        tested = True
            else:
                heard = now
                if seq == expected:
                    expected, deliver = expected + 1, kind == "D"
                else:
                    out.append("2")
            wrote = now if out else wrote
            rows += [(seq + 1, n, expected, deliver, o) for n, o in enumerate(out or [None])]
        want[conn] = rows
    assert {c: sorted(x, key=lambda r: r[:2]) for c, x in got.items()} == want


# --- numbers ----------------------------------------------------------------------------------------------------------


def test_regression_equals_the_matrix_form(spark):
    rng = np.random.default_rng(3)
    n = 300
    x = rng.normal(size=(n, 2))
    e = np.zeros(n)
    for i in range(1, n):
        e[i] = 0.6 * e[i - 1] + rng.normal()
    y = 1.5 + x @ [0.8, -2.0] + e
    frame = spark.createDataFrame([("g", i, float(y[i]), float(x[i, 0]), float(x[i, 1])) for i in range(n)] + [("h", 0, 1.0, 1.0, 1.0)], "g string, i long, y double, a double, b double")
    got = {r.g: r for r in stats.regress(frame, "y", ["a", "b"], ["g"], "i").collect()}
    X = np.column_stack([np.ones(n), x])
    inv = np.linalg.pinv(X.T @ X)
    beta = inv @ X.T @ y
    u = X * (y - X @ beta)[:, None]
    lags = int(np.floor(4 * (n / 100) ** (2 / 9)))
    S = u.T @ u
    for lag in range(1, lags + 1):
        G = u[lag:].T @ u[:-lag]
        S += (1 - lag / (lags + 1)) * (G + G.T)
    se = np.sqrt(np.diag(inv @ (S * n / (n - 3)) @ inv))
    assert got["g"].params == pytest.approx(beta) and got["g"].stderr == pytest.approx(se) and got["g"].hac_lags == lags
    assert got["g"].r_squared == pytest.approx(1 - ((y - X @ beta) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert got["h"].params is None and got["h"].r_squared is None


def test_quantiles(spark):
    frame = spark.createDataFrame([("s", i, i) for i in range(101)], "stage string, idx long, ns long")
    got = stats.latency_report(frame).first()
    assert (got.n, got.p50, got.max_ns, got.mean_ns) == (101, 50.0, 100.0, 50.0)
    assert stats.latency_report(frame, warmup=10).first().n == 91
    none = stats.quantiles(frame.where("false"), [], "ns", [0.5]).first()
    assert none.n == 0 and np.isnan(none.q[0])


@pytest.mark.parametrize("values", [[1.0], [1.0, 1.0, 1.0, 2.0], [0.1 * (i * 7919 % 1000) for i in range(1000)], [5.0] * 50 + [6.0]])
def test_quantiles_by_ranks_equal_numpy(spark, values):
    shares = [0.0, 0.05, 0.2, 0.5, 0.77, 0.999, 1.0]
    rows = [(k, v) for k in "ab" for v in values] + [("a", None), ("c", None)]
    got = {r.k: r for r in stats.quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", shares).collect()}
    for k in "ab":
        assert got[k].n == len(values) and got[k].q == pytest.approx(np.quantile(values, shares))
    assert got["c"].n == 0 and all(np.isnan(got["c"].q))
    whole = stats.quantiles(spark.createDataFrame(rows, "k string, v double"), [], "v", shares).first()
    assert whole.q == pytest.approx(np.quantile(values * 2, shares))


def test_measures(spark):
    frame = spark.createDataFrame([(100, 90.0, 102, 10.0), (100, 0.0, 102, 0.0), (None, 0.0, 102, 1.0), (102, 1.0, 102, 1.0)], "b long, bs double, a long, s double")
    got = frame.select(ticks.microprice(*map(F.col, ("b", "bs", "a", "s"))), ticks.mid(F.col("b"), F.col("a")), ticks.is_crossed(F.col("b"), F.col("a"))).collect()
    assert [tuple(r) for r in got] == [(pytest.approx(101.8), 101.0, False), (101.0, 101.0, False), (None, None, False), (102.0, 102.0, True)]
