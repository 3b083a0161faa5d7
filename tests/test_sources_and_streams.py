"""Captures, price texts, venues and streaming against batch."""

from __future__ import annotations

import gzip
import json
import random
from decimal import Decimal, InvalidOperation

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from tests.test_books import loop, random_feed
from tidebook.functions import ticks
from tidebook.operators import book, epochs, matching, ofi, orders, risk, stats
from tidebook.schemas import COMMAND, EXECUTION, UPDATE
from tidebook.sources import adapters, capture
from tidebook.streaming import live


def exact(text, decimals):
    try:
        value = Decimal(text.strip()) * 10**decimals
    except InvalidOperation:
        return None
    return int(value) if value.is_finite() and value == value.to_integral_value() and abs(value) < 2**63 else None


TEXTS = ["68123.45", "100", "1.5000", "1.005", "0", "00.00", "000123.4500", "1.", ".5", "1e5", "1_000", " 1.5", "1.5 ", "+1.5", "nan", "", "-2.50", "Infinity", "--1", "1.2.3", "999999999999.99"]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.decimals(allow_nan=False, allow_infinity=False, min_value=-(10**9), max_value=10**9, places=5).map(str), min_size=50, max_size=80), st.sampled_from([0, 1, 2, 4, 8]))
def test_ticks_are_exact(spark, drawn, decimals):
    texts = TEXTS + drawn
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(ticks.to_ticks(F.col("t"), decimals)).collect()
    assert [r[0] for r in got] == [exact(t, decimals) for t in texts]


def test_strict_ticks_raise(spark):
    with pytest.raises(Exception, match="not a price"):
        spark.createDataFrame([("x",)], "t string").select(ticks.to_ticks(F.col("t"), 2, strict=True)).collect()


def test_capture_round_trip(spark, tmp_path):
    raws = ['{"a": "é\\n"}', "pong", "x\ty"]
    frame = spark.createDataFrame([(i, 10 + i, r) for i, r in enumerate(raws)], "msg_idx long, recv_ns long, raw string")
    capture.write_capture(frame, str(tmp_path / "c"), "okx", "BTC-USDT", 1, 9)
    got = capture.read_capture(spark, str(tmp_path / "c")).orderBy("recv_ns").collect()
    assert [(r.recv_ns, r.raw) for r in got] == [(10 + i, r) for i, r in enumerate(raws)]
    headers = capture.capture_header(spark, str(tmp_path / "c")).collect()
    assert [(h.venue, h.symbol, h.format_version) for h in headers] == [("okx", "BTC-USDT", 1)]


def test_capture_lines(spark, tmp_path):
    lines = [json.dumps({"type": "header", "venue": "v"}), "", *(json.dumps({"type": "msg", "recv_ns": i, "raw": str(i)}) for i in range(2000))]
    with gzip.open(tmp_path / "a.jsonl.gz", "wt") as f:
        f.write("\n".join(lines))
    (tmp_path / "b.jsonl").write_text("\n".join([*lines, "{broken"]))
    got = capture.read_capture(spark, str(tmp_path / "a.jsonl.gz")).orderBy("msg_idx").collect()
    assert [r.recv_ns for r in got] == list(range(2000))
    with pytest.raises(Exception):
        capture.read_capture(spark, str(tmp_path / "b.jsonl")).collect()


def frames(spark, raws):
    return spark.createDataFrame([(i, 1000 + i, r) for i, r in enumerate(raws)], "msg_idx long, recv_ns long, raw string")


def test_okx_outcomes(spark):
    book_ = lambda data, channel="books": json.dumps({"arg": {"channel": channel, "instId": "X"}, "data": data})
    raws = [book_([{"bids": [["1.5", "2"], ["abc", "1"]], "ts": "5", "seqId": 7, "prevSeqId": 6}]), "pong", "", "{bad", '{"event":"error"}', book_([{}], "trades"), book_([1]), book_([{"ts": "x"}]), "[1]", None]
    got = {r.msg_idx: r for r in adapters.okx(frames(spark, raws), 1).collect()}
    assert [got[i].outcome for i in range(10)] == ["parsed", *["ignored"] * 5, "parse_error", "parse_error", "ignored", "ignored"]
    u = got[0].updates[0]
    assert (u.is_snapshot, u.seq, u.prev_seq, u.exchange_ts_ns, [tuple(x) for x in u.bids]) == (True, 7, 6, 5_000_000, [(15, 2.0)])


def test_bybit_numbers(spark):
    raws = [json.dumps({"topic": "orderbook.50.X", "type": kind, "data": {"s": "X", "u": u, "b": [["1", "1"]], "a": []}}) for kind, u in (("snapshot", 100), ("delta", 102), ("delta", 103))]
    for contiguous, want in ((True, [None, 101, 102]), (False, [None, 100, 102])):
        got = adapters.exploded(adapters.bybit(frames(spark, raws), 2, contiguous=contiguous)).orderBy("idx").collect()
        assert [r.prev_seq for r in got] == want and [r.seq for r in got] == [100, 102, 103]


@pytest.fixture(scope="module")
def feed(spark):
    """Two venues of one symbol, and a second symbol: rows in one order of arrival, with gaps and snapshots."""
    rows = []
    for n, (venue, symbol) in enumerate((("v", "S"), ("w", "S"), ("v", "T"))):
        rows += [(venue, symbol, r[2] * 3 + n, *r[3:]) for r in random_feed(n + 7, 300)]
    return rows


def alone(feed, venue, symbol):
    return loop([r for r in feed if r[:2] == (venue, symbol)])


def test_each_venue_keeps_its_own_book_and_flow(spark, feed):
    """Two venues that quote one symbol don't mix: each comes out as it does alone."""
    flow = ofi.events(book.top_of_book(epochs.audit(spark.createDataFrame(feed, UPDATE))))
    got, sums = {}, {}
    for r in ofi.cumulative(flow).collect():
        got.setdefault((r.venue, r.symbol), {})[r.idx] = (r.recv_ts_ns, r.bid_px, r.bid_sz, r.ask_px, r.ask_sz)
        sums.setdefault((r.venue, r.symbol), []).append((r.idx, r.e, r.ofi, r.events))
    assert got == {key: alone(feed, *key) for key in (("v", "S"), ("w", "S"), ("v", "T"))}
    for key, rows in sums.items():
        tops, total, n, before = got[key], 0.0, 0, None
        for idx, e, ofi_, events in sorted(rows):
            top = tops[idx][1:]
            want = live.flow(before, top) if before else 0.0
            total, n, before = total + want, n + (before is not None and top != before), top
            assert (e, ofi_, events) == (want, total, n)


def test_still_venues_of_one_symbol_have_no_flow(spark):
    rows = [(v, "S", i, i < 2, i, None, None, i, [(p, 5.0)], [(p + 2, 5.0)]) for i, (v, p) in enumerate([("a", 100), ("b", 200)] * 3)]
    got = ofi.events(book.top_of_book(epochs.audit(spark.createDataFrame(rows, UPDATE)))).collect()
    assert len(got) == 6 and {r.e for r in got} == {0.0} and not any(r.changed for r in got)
    assert {r.crossed_seen for r in book.crossings(book.top_of_book(epochs.audit(spark.createDataFrame(rows, UPDATE)))).collect()} == {0}


def test_books_go_through_the_wire(spark, feed):
    """Updates as frames of a venue and back give the same books."""
    updates = spark.createDataFrame([("okx", s, *r) for v, s, *r in feed if v == "v"], UPDATE)
    parsed = adapters.okx(adapters.to_okx_frames(updates, 1).withColumnRenamed("idx", "msg_idx"), 1)
    back = adapters.exploded(parsed).drop("idx").withColumnRenamed("msg_idx", "idx")
    tops = lambda frame: {(r.symbol, r.idx): (r.bid_px, r.bid_sz, r.ask_px, r.ask_sz) for r in book.top_of_book(epochs.audit(frame, strict=False)).collect()}
    assert tops(back) == tops(updates)


def test_ages_and_lags(spark):
    rows = [("v", "S", i, i == 0, i, None, None if i == 2 else 100 * i, 100 * i + 7, [], []) for i in range(3)]
    tops = book.top_of_book(epochs.audit(spark.createDataFrame(rows, UPDATE)))
    got = book.feed_age(tops, F.lit(1000)).first()
    assert (got.age_ns, got.lag_ns) == (793, None)
    assert book.feed_age(tops.where("idx < 2"), F.lit(1000)).first().lag_ns == 7


def test_recovery_from_lost_messages(spark):
    """100 of 20,000 deltas lost, a snapshot two events after each loss: two frames in each are dropped."""
    rows, seq = [("v", "S", 0, True, 0, None, None, 0, [(1, 1.0)], [(3, 1.0)])], 0
    for n in range(1, 20_001):
        seq += 1
        if n % 200 == 0:
            continue
        snapshot = n % 200 == 2 and n > 200
        rows.append(("v", "S", n, snapshot, seq, None if snapshot else seq - 1, None, n, [(1, float(n % 5 + 1))], []))
    stats_ = epochs.gap_stats(epochs.audit(spark.createDataFrame(rows, UPDATE))).first()
    assert (stats_.frames, stats_.snapshots_applied) == (19_901, 100) and stats_.updates_applied + stats_.resyncs == 19_901 and stats_.resyncs == 99


def test_replay_counts_frames(spark):
    book_ = lambda action, seq, prev, bids: json.dumps({"arg": {"channel": "books", "instId": "X"}, "action": action, "data": [{"bids": bids, "asks": [], "ts": "1", "seqId": seq, "prevSeqId": prev}]})
    raws = [book_("snapshot", 1, -1, [["1", "1"]]), "{garbage", book_("update", 2, 1, [["1", "2"]]), book_("update", 9, 8, [["1", "9"]]), book_("snapshot", 10, -1, [["1", "3"]]), '{"arg":{"channel":"books"},"data":[1]}']
    parsed = adapters.okx(frames(spark, raws), 1)
    got = epochs.replay_stats(parsed, epochs.audit(adapters.exploded(parsed))).first()
    assert (got.messages, got.ignored, got.parse_errors, got.updates, got.snapshots, got.resyncs) == (6, 1, 1, 3, 2, 1)


def test_streams_equal_batch(spark, feed, tmp_path):
    updates = spark.createDataFrame(feed, UPDATE)
    updates.orderBy("idx").repartitionByRange(4, "idx").write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(updates.schema).option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "in"))
    query = live.live_books(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).where("applied")
    batch = ofi.cumulative(ofi.events(book.top_of_book(epochs.audit(updates))))
    of = lambda frame: {(r.venue, r.symbol, r.idx): (r.bid_px, r.bid_sz, r.ask_px, r.ask_sz, r.e, r.ofi, r.events) for r in frame.collect()}
    assert of(got) == of(batch)


@pytest.mark.parametrize("interval", [3_000, 20_000])
def test_streamed_buckets_equal_batch(spark, feed, tmp_path, interval):
    """All but the last of a symbol, which is still open; late rows are in the feed."""
    updates = spark.createDataFrame(feed, UPDATE)
    batch = ofi.buckets(ofi.events(book.top_of_book(epochs.audit(updates))), interval).collect()
    last = {}
    for r in batch:
        last[r.venue, r.symbol] = max(r.start_ns, last.get((r.venue, r.symbol), r.start_ns))
    got = streamed(spark, updates, lambda stream: live.live_buckets(stream, interval), tmp_path)
    shown = lambda r: str(Row(**{c.split()[0]: float(v) if c.endswith("double") else v for c in live.BUCKETS.split(", ") for v in [r[c.split()[0]]]}))
    closed = sorted(shown(r) for r in batch if r.start_ns < last[r.venue, r.symbol])
    assert len(closed) > 5 and [x for x in got if x in set(closed)] == closed
    # a dropped last bucket leaves the one before it closed in the stream
    assert len(got) - len(closed) <= len(last)


def test_conflation_keeps_the_newest(spark, tmp_path):
    spark.createDataFrame([("a", 1, 5.0), ("a", 3, 7.0), ("b", 2, 1.0)], "symbol string, idx long, v double").write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema("symbol string, idx long, v double").parquet(str(tmp_path / "in"))
    live.latest_sink(stream, lambda frame, epoch: seen.extend(tuple(r) for r in frame.collect()), str(tmp_path / "check")).awaitTermination(60)
    assert sorted(seen) == [("a", 3, 7.0), ("b", 2, 1.0)]


def streamed(spark, frame, to, tmp_path):
    frame.orderBy("idx").repartitionByRange(3, "idx").write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "in"))
    to(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(120)
    return sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect()))


def test_streamed_orders_equal_batch(spark, tmp_path):
    rng = random.Random(3)
    known = spark.createDataFrame([(f"o{i}", "S", "BUY", 100.0) for i in range(5)], "cl_ord_id string, symbol string, side string, qty double")
    status = ["NEW", "PARTIALLY_FILLED", "FILLED", "CANCELED", "PENDING_CANCEL"]
    rows = []
    for i in range(60):
        s = rng.choice(status)
        trade = s in ("PARTIALLY_FILLED", "FILLED")
        rows.append((i, f"o{rng.randrange(6)}", "TRADE" if trade else s, s, "V", f"E{i}", float(rng.randrange(60)) if trade else 0.0, 10 if trade else None, None, "", i))
    reports = spark.createDataFrame(rows, EXECUTION)
    assert streamed(spark, reports, lambda stream: live.live_orders(stream, known), tmp_path) == sorted(map(str, orders.apply_reports(known, reports).collect()))


def test_streamed_matching_equals_batch(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), i, rng.choice(["add", "submit", "market", "cancel_ahead"]), f"c{i}", rng.choice(["BUY", "SELL"]), float(rng.randrange(1, 9)), rng.randrange(95, 106), "LIMIT", rng.choice(["DAY", "IOC", "FOK"])) for i in range(80)]
    commands = spark.createDataFrame(rows, COMMAND)
    assert streamed(spark, commands, live.live_matching, tmp_path) == sorted(map(str, matching.match(commands).collect()))


RISK = "symbol string, idx long, op string, cl_ord_id string, side string, qty double, price long, mid double, is_market boolean, t_s double"


def test_risk_at_arrival(spark, tmp_path):
    limits = risk.Limits(max_position=100, max_open_orders=2, max_messages_per_sec=3)
    step = lambda i, op, c=None, side=None, qty=0.0, price=None, t=0.0: ("S", i, op, c, side, qty, price, None, False, t)
    rows = [
        step(1, "order", "a", "BUY", 60.0, 10), step(2, "order", "b", "BUY", 60.0, 10), step(3, "order", "c", "SELL", 10.0, 10, 0.1), step(4, "order", "d", "SELL", 10.0, 11, 0.2), step(5, "order", "e", "BUY", 1.0, 9, 0.3),
        step(6, "fill", "a", "BUY", 60.0, 10, 0.4), step(7, "order", "f", "BUY", 41.0, 10, 5.0), step(8, "order", "g", "BUY", 1.0, 11, 5.0), step(9, "close", "d"), step(10, "order", "h", "BUY", 1.0, 11, 5.1),
        step(11, "kill"), step(12, "order", "i", "BUY", 1.0, 1, 9.0), step(13, "resume"), step(14, "order", "j", "BUY", 1.0, 1, 9.0),
    ]
    events = spark.createDataFrame(rows, RISK)
    batch = risk.gated(events, limits)
    got = {r.idx: r for r in batch.collect()}
    assert {i: r.check for i, r in got.items() if r.accepted is not None} == {1: None, 2: "max_position", 3: "self_trade", 4: None, 5: "max_open_orders", 7: "max_position", 8: "self_trade", 10: None, 12: "kill_switch", 14: None}
    assert (got[6].position, got[6].n_open, got[14].n_open) == (60.0, 1, 2)
    assert streamed(spark, events, lambda stream: live.live_risk(stream, limits), tmp_path) == sorted(map(str, batch.collect()))


def test_risk_throttle_counts_accepted_orders(spark):
    rows = [("S", i, "order", f"o{i}", "BUY", 1.0, 1, None, False, t) for i, t in enumerate([0.0, 0.1, 0.2, 0.9, 1.15])]
    got = risk.gated(spark.createDataFrame(rows, RISK), risk.Limits(max_messages_per_sec=2)).orderBy("idx").collect()
    assert [r.check for r in got] == [None, None, "throttle", "throttle", None]


def test_frames_of_any_number_of_updates_keep_their_order(spark):
    """Thousands of updates in a frame, frames without any, and frames that lie in many slices."""
    sizes = [0, 5000, 1, None, 1030, 1030, 0, 3]
    item = '{"bids":[["1","1"]],"asks":[],"ts":"1","seqId":"%d"}'
    rows = [(100 * i, i, '{"arg":{"channel":"%s","instId":"S"},"data":[%s]}' % ("other" if n is None else "books", ",".join(item % (i * 10_000 + k) for k in range(n or 0)))) for i, n in enumerate(sizes)]
    frames = spark.createDataFrame(rows, "msg_idx long, recv_ns long, raw string").repartition(3)
    for width in (1, 150, 10**6):
        got = [(r.idx, r.msg_idx, r.seq) for r in adapters.exploded(adapters.okx(frames), width=width).orderBy("idx").collect()]
        assert got == [(n, m, s) for n, (m, s) in enumerate((100 * i, i * 10_000 + k) for i, size in enumerate(sizes) for k in range(size or 0))]
    places = [(r.msg_idx, r.place) for r in adapters.updates_of(adapters.okx(frames)).orderBy("msg_idx", "place").collect()]
    assert places == [(100 * i, k) for i, size in enumerate(sizes) for k in range(size or 0)]


def test_frames_are_parsed_once_and_by_all_cores(spark):
    frames = spark.range(1000).coalesce(1).select(F.col("id").alias("msg_idx"), F.col("id").alias("recv_ns"), F.concat(F.lit('{"arg":{"channel":"books"},"data":[],"id":'), "id", F.lit("}")).alias("raw"))
    parsed = adapters.okx(frames)
    plan = parsed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json(") == 1 and parsed.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def within_rank_error(report, values, k=800):
    """Whether each percentile lies between the exact values at its rank less and plus the stated error."""
    values, error = sorted(values), 2.296 / k**0.9723
    for name, rank in stats.LATENCIES.items():
        low, high = (values[min(len(values) - 1, max(0, int(len(values) * x)))] for x in (rank - error, rank + error))
        assert low <= report[name] <= high, (name, low, report[name], high)
    assert (report["n"], report["max_ns"]) == (len(values), values[-1]) and report["mean_ns"] == pytest.approx(sum(values) / len(values))


def test_sketched_latencies_of_tables_and_streams(spark, tmp_path):
    rng = random.Random(8)
    samples = [(rng.choice(["parse", "apply"]), rng.lognormvariate(5, 2)) for _ in range(30_000)]
    frame = spark.createDataFrame(samples + [("parse", None), ("parse", float("nan")), ("idle", None)], "stage string, ns double").repartition(6)
    of = lambda stage: [v for s, v in samples if s == stage]
    whole = {r.stage: r for r in stats.latency_sketches(frame).collect()}
    halves = [stats.latency_sketches(frame.where(c)) for c in ("ns < 100", "NOT ns < 100 OR ns IS NULL")]
    merged = {r.stage: r for r in stats.merged_latencies(halves[0].unionByName(halves[1])).collect()}
    frame.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    query = stats.latency_sketches(stream).writeStream.format("memory").queryName("latencies").outputMode("complete").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    live_ = {r.stage: r for r in spark.table("latencies").collect()}
    for reports in (whole, merged, live_):
        assert set(reports) == {"parse", "apply", "idle"} and (reports["idle"].n, reports["idle"].p50, reports["idle"].mean_ns) == (0, None, None)
        for stage in ("parse", "apply"):
            within_rank_error(reports[stage], of(stage))
