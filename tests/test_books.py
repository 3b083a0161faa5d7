"""Books, gaps and flow against hand-made cases and a plain loop."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidebook.operators import book, epochs, ofi
from tidebook.operators.ordered import Running, numbered, ranged, rolling_mean, running, sliced
from tidebook.schemas import UPDATE


def update(idx, snapshot=False, seq=None, prev=None, bids=(), asks=(), symbol="S", ts=None):
    return ("v", symbol, idx, snapshot, seq, prev, None, ts if ts is not None else idx * 1000, [(p, float(s)) for p, s in bids], [(p, float(s)) for p, s in asks])


BASE = update(1, True, 1, None, [(100, 5), (99, 10), (98, 20)], [(102, 4), (103, 8), (104, 16)])


def run(spark, rows, strict=True, **more):
    audited = epochs.audit(spark.createDataFrame(rows, UPDATE), strict)
    return audited, {r.idx: r for r in book.top_of_book(audited, **more).collect()}


@pytest.mark.parametrize(
    ("delta", "want"),
    [
        (update(2, False, 2, 1, [(100, 7)]), (100, 7.0, 102, 4.0)), (update(2, False, 2, 1, [(100, 0)]), (99, 10.0, 102, 4.0)), (update(2, False, 2, 1, [(101, 3)]), (101, 3.0, 102, 4.0)),
        (update(2, True, 99, None, [(50, 1)], [(60, 1)]), (50, 1.0, 60, 1.0)), (update(2, False, None, None, [(100, 8)]), (100, 8.0, 102, 4.0)), (update(2, False, 2, 1, [(100, 1), (100, 9)]), (100, 9.0, 102, 4.0)),
        (update(2, False, 2, 1, [(100, float("nan"))]), (99, 10.0, 102, 4.0)),
    ],
)
def test_updates_of_the_base_book(spark, delta, want):
    top = run(spark, [BASE, delta])[1][2]
    assert (top.bid_px, top.bid_sz, top.ask_px, top.ask_sz) == want


def test_a_gap_lasts_until_the_next_snapshot(spark):
    rows = [update(0, False, 5, 4, [(1, 1)]), BASE, update(2, False, 5, 4, [(100, 999)]), update(3, False, 2, 1, [(101, 1)]), update(4, True, 9, None, [(1, 1)], [(3, 1)]), update(5, False, 10, 9, [(2, 1)])]
    audited, tops = run(spark, rows)
    assert {r.idx: r.applied for r in audited.collect()} == {0: False, 1: True, 2: False, 3: False, 4: True, 5: True}
    assert sorted(tops) == [1, 4, 5] and tops[5].bid_px == 2
    stats = epochs.gap_stats(audited).first()
    assert (stats.frames, stats.updates_applied, stats.snapshots_applied, stats.resyncs) == (6, 3, 2, 3)


def test_without_strict_sequences_a_gap_is_let_pass(spark):
    assert run(spark, [BASE, update(2, False, 99, 98, [(101, 3)])], strict=False)[1][2].bid_px == 101


def test_levels_beyond_the_depth_are_forgotten_for_good(spark):
    rows = [update(1, True, 1, None, [(100, 1), (99, 1)]), update(2, False, 2, 1, [(101, 1)]), update(3, False, 3, 2, [(101, 0)])]
    assert run(spark, rows, max_depth=2)[1][3].bid_px == 100
    rows.append(update(4, False, 4, 3, [(100, 0)]))
    assert run(spark, rows, max_depth=2)[1][4].bid_px is None
    assert run(spark, rows)[1][4].bid_px == 99


def test_average_depth_is_half_the_sum(spark):
    audited, tops = run(spark, [BASE], depth_levels=2)
    assert tops[1].depth == 13.5
    assert book.average_depth(book.final_levels(book.levels(audited)), 2).first().avg_depth == 13.5


def random_feed(seed, n=400):
    rng, rows, seq = random.Random(seed), [], 0
    for i in range(n):
        snapshot = i == 3 or rng.random() < 0.03
        seq += 1
        levels = [(rng.randint(90, 99), rng.randint(0, 3)) for _ in range(rng.randint(0, 3))]
        asks = [(rng.randint(100, 110), rng.randint(0, 3)) for _ in range(rng.randint(0, 3))]
        prev = None if rng.random() < 0.1 else seq - (1 if rng.random() < 0.97 else 2)
        rows.append(update(i, snapshot, None if rng.random() < 0.1 else seq, prev, levels, asks, ts=i * 1000 - (5000 if rng.random() < 0.05 else 0)))
    return rows


def loop(rows):
    """The order of arrival, one update at a time."""
    ready, last, bids, asks, out = False, None, {}, {}, {}
    for _, _, idx, snapshot, seq, prev, _, ts, b, a in rows:
        if snapshot:
            ready, last, bids, asks = True, None, {}, {}
        elif not ready or (prev is not None and last is not None and prev != last):
            ready, last = False, None
            continue
        for side, levels in ((bids, b), (asks, a)):
            for price, size in levels:
                if size > 0:
                    side[price] = size
                else:
                    side.pop(price, None)
        last = seq if seq is not None else last
        out[idx] = (ts, max(bids, default=None), bids[max(bids)] if bids else 0.0, min(asks, default=None), asks[min(asks)] if asks else 0.0)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_books_equal_a_plain_loop(spark, seed):
    rows = random_feed(seed)
    _, tops = run(spark, rows)
    assert {i: (r.recv_ts_ns, r.bid_px, r.bid_sz, r.ask_px, r.ask_sz) for i, r in tops.items()} == loop(rows)


def bucket_loop(tops, interval):
    out, t0, end, mid_start, last, ofi_sum, events, sizes, before = [], None, None, None, None, 0.0, 0, [], None
    rows = [tops[i] for i in sorted(tops)]
    close = lambda stop: out.append((start, stop, ofi_sum, last - mid_start, sum(sizes) / len(sizes), events)) if sizes else None
    for ts, bp, bs, ap, az in rows:
        if t0 is None:
            t0 = start = ts
            end = ts + interval
        while ts >= end:
            close(end)
            start, end, ofi_sum, events, sizes, mid_start = end, end + interval, 0.0, 0, [], last
        if before is not None:
            events += before != (bp, bs, ap, az)
            b0, s0, a0, z0 = before
            if None not in (bp, ap, b0, a0):
                ofi_sum += (bs if bp >= b0 else 0) - (s0 if bp <= b0 else 0) - (az if ap <= a0 else 0) + (z0 if ap >= a0 else 0)
        before = (bp, bs, ap, az)
        if bp is not None and ap is not None:
            last = (bp + ap) / 2
            sizes.append((bs + az) / 2)
            mid_start = last if mid_start is None else mid_start
    close(rows[-1][0])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_buckets_equal_a_plain_loop(spark, seed):
    rows = random_feed(seed)
    audited = epochs.audit(spark.createDataFrame(rows, UPDATE))
    flow = ofi.events(book.top_of_book(audited), width=50)
    got = ofi.buckets(flow, 7000).orderBy("start_ns").collect()
    want = bucket_loop(loop(rows), 7000)
    assert [(r.start_ns, r.end_ns, r.ofi, r.delta_mid, r.avg_depth, r.events) for r in got] == [pytest.approx(w) for w in want]


def test_bucket_arguments(spark):
    with pytest.raises(ValueError):
        ofi.buckets(spark.range(1), 0)


@pytest.mark.parametrize(
    ("after", "e"),
    [((100, 15, 102, 8), 5), ((100, 6, 102, 8), -4), ((101, 3, 102, 8), 3), ((99, 40, 102, 8), -10), ((100, 10, 102, 12), -4), ((100, 10, 102, 5), 3), ((100, 10, 101, 6), -6), ((100, 10, 103, 30), 8), ((101, 3, 103, 30), 11), ((100, 10, 102, 8), 0), ((None, 0, 102, 8), 0)],
)
def test_contributions(spark, after, e):
    rows = [("v", "S", 1, 1, 1, None, 100, 10.0, 102, 8.0, 0.0), ("v", "S", 1, 2, 2, None, after[0], float(after[1]), after[2], float(after[3]), 0.0)]
    got = {r.idx: r for r in ofi.events(spark.createDataFrame(rows, book.TOP)).collect()}
    assert got[1].e == 0 and not got[1].changed and got[2].e == e and got[2].changed == (after != (100, 10, 102, 8))


def test_running_values_over_slices_equal_windows(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), i, rng.choice([None, rng.randint(0, 9)])) for i in range(300)]
    frame = sliced(spark.createDataFrame(rows, "k string, o long, v long"), "o", 17)
    got = running(frame, ["k"], "o", {"s": Running("sum", F.col("v")), "m": Running("max", F.col("v")), "p": Running("last", F.col("v")), "l": Running("lag", F.col("v"))})
    seen = {}
    for r in got.orderBy("o").collect():
        past = seen.setdefault(r.k, [])
        known = [v for v in [*past, r.v] if v is not None]
        assert r.s == sum(known) and r.m == max(known, default=None)
        assert r.p == next((v for v in reversed(past) if v is not None), None) and r.l == (past[-1] if past else None)
        past.append(r.v)


def test_first_values_places_and_rolling_means_over_slices(spark):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), i, float(rng.randint(0, 9))) for i in range(400)]
    frame = spark.createDataFrame(rows, "k string, o long, v double")
    first = {r.o: r.f for r in running(sliced(frame, "o", 17), ["k"], "o", {"f": Running("first", F.col("v"))}).collect()}
    placed = {r.o: r.n for r in numbered(ranged(frame, ["k"], "o"), ["k"], "o", "n", keep=False).collect()}
    mean = {r.o: r.m for r in rolling_mean(frame, ["k"], "o", "v", 7, "m", width=50, block=20).collect()}
    seen = {}
    for k, o, v in rows:
        past = seen.setdefault(k, [])
        past.append(v)
        assert first[o] == past[0] and placed[o] == len(past) and mean[o] == pytest.approx(sum(past[-7:]) / len(past[-7:]))
    assert len(mean) == 400


def test_drained_flow_and_rates(spark):
    rows = random_feed(4)
    flow = ofi.events(book.top_of_book(epochs.audit(spark.createDataFrame(rows, UPDATE)))).persist()
    whole = flow.agg(F.sum("e").alias("e"), F.count_if("changed").alias("n")).first()
    drained = ofi.drained(flow, 50).collect()
    assert sum(r.ofi for r in drained) == pytest.approx(whole.e) and sum(r.events for r in drained) == whole.n and len(drained) > 1
    rates = ofi.rates(flow, 10_000).collect()
    assert sum(r.messages for r in rates) == flow.count() and all(r.per_sec == r.messages / 1e-5 for r in rates)


# --- long epochs ------------------------------------------------------------------------------------------------------


def hand_fold(rows, max_depth, depth_levels):
    """The book of one object, from the first snapshot on: no sequence is checked."""
    out, b = {}, None
    for _, symbol, idx, snapshot, *_, bids, asks in rows:
        if snapshot:
            b = book.Book(max_depth)
        if b is not None:
            b.apply(snapshot, bids, asks)
            out[idx] = (*b.bids.best(), *b.asks.best(), b.average_depth(depth_levels))
    return out


def long_feed(seed, n, snapshots=(), prices=12, quiet=0):
    """One symbol; levels near and far from the touch, deletes, equal prices in an update, one-sided updates."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        levels = lambda low: [(low + rng.randrange(prices), rng.choice([0, 0, 1, 2, 5, float("nan")])) for _ in range(rng.randrange(4))]
        rows.append(update(i, i == 0 or i in snapshots, i, i - 1, levels(100), levels(130)))
    return rows


@pytest.mark.parametrize(("max_depth", "piece"), [(None, 1), (None, 64), (1, 64), (3, 7), (50, 64), (3, 10_000)])
def test_pieces_of_an_epoch_are_folded_as_one(spark, max_depth, piece):
    rows = long_feed(piece, 300, snapshots={150, 151, 190})
    audited = epochs.audit(spark.createDataFrame(rows, UPDATE).repartition(3), width=50, piece=piece)
    got = {r.idx: (r.bid_px, r.bid_sz, r.ask_px, r.ask_sz, r.depth) for r in book.top_of_book(audited, max_depth, depth_levels=3).collect()}
    assert got == hand_fold(rows, max_depth, 3)


def test_a_gap_in_a_long_epoch_ends_all_later_pieces(spark):
    rows = [update(i, i == 2, i, i - 1 if i != 23 else 5, [(i % 7, 1)]) for i in range(60)]
    audited = epochs.audit(spark.createDataFrame(rows, UPDATE), width=9, piece=4)
    assert {r.idx for r in audited.where("applied").collect()} == set(range(2, 23))
    assert {r.idx: (r.piece, r.pieces, r.opens) for r in audited.where("idx in (2, 5, 6, 58)").collect()} == {2: (0, 15, False), 5: (0, 15, False), 6: (1, 15, True), 58: (14, 15, True)}
    assert {r.idx: r.bid_px for r in book.top_of_book(audited).collect()} == {i: min(6, i) if i < 9 else 6 for i in range(2, 23)}


def test_sequence_checks_do_not_depend_on_slices(spark):
    for seed in range(3):
        rows = random_feed(seed)
        want = {(r.idx, r.epoch, r.last_seq, r.applied) for r in epochs.audit(spark.createDataFrame(rows, UPDATE)).collect()}
        for width, piece in ((1, 1), (13, 5), (100, 1000)):
            assert {(r.idx, r.epoch, r.last_seq, r.applied) for r in epochs.audit(spark.createDataFrame(rows, UPDATE), width=width, piece=piece).collect()} == want


def test_a_symbol_without_snapshots_makes_many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = spark.createDataFrame(long_feed(5, 4000), UPDATE)
    folded = book.top_of_book(epochs.audit(rows, width=500, piece=500))
    parts = folded.select("idx", F.spark_partition_id().alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) >= 3 and max(r.n for r in parts) < 4000


def test_truncated_pieces_settle_though_every_guess_is_wrong(spark):
    """A level that was forgotten in the first piece is in every guess, and never written again."""
    rows = [update(0, True, 0, None, [(100, 1), (99, 1)]), update(1, False, 1, 0, [(101, 1)])] + [update(i, False, i, i - 1, [(101, 1 + i % 3)]) for i in range(2, 40)] + [update(40, False, 40, 39, [(101, 0), (100, 0)]), update(41, False, 41, 40, [(5, 1)])]
    audited = epochs.audit(spark.createDataFrame(rows, UPDATE), piece=4)
    got = {r.idx: r.bid_px for r in book.top_of_book(audited, max_depth=2).collect()}
    assert got[39] == 101 and got[40] is None and got[41] == 5
    assert book.top_of_book(audited).where("idx = 40").first().bid_px == 99
