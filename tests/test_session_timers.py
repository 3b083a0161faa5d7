"""Numbers that go on across logons, and sessions that the clock wakes, in batch and in a stream."""

from __future__ import annotations

import time
from types import SimpleNamespace

import pandas as pd

from tidebook.operators import fixsession
from tidebook.operators.fixsession import Rules, Session
from tidebook.streaming import live

EVENT = "conn string, idx long, op string, t_s double, msg_type string, seq long, body map<int,string>"


def test_numbers_go_on_across_logons(spark):
    """Three days of a connection against plain counts: nothing begins anew, and old messages can be asked for again."""
    rows, seq, number, want = [], 1, 1, []
    for day in range(3):
        t, at = day * 1000.0, day * 10
        rows += [("c", at, "logon", t, None, None, None), ("c", at + 1, "message", t + 1, "A", seq, {108: "10"}), ("c", at + 2, "send", t + 2, "D", None, {11: f"x{day}"}), ("c", at + 3, "message", t + 3, "D", seq + 1, None), ("c", at + 4, "logout", t + 4, None, None, None), ("c", at + 5, "message", t + 5, "5", seq + 2, None)]
        want += [("A", number), ("D", number + 1), ("5", number + 2)]
        seq, number = seq + 3, number + 3
    rows += [("c", 90, "logon", 9000.0, None, None, None), ("c", 91, "message", 9001.0, "A", seq, None), ("c", 92, "message", 9002.0, "2", seq + 1, {7: "1", 16: "0"})]
    got = sorted(fixsession.run_sessions(spark.createDataFrame(rows, EVENT), Rules(reset=False)).collect(), key=lambda r: (r.idx, r.n))
    assert [(r.out_type, r.out_msg_seq) for r in got if r.out_type and r.idx < 90] == want
    assert [r.deliver for r in got if r.idx % 10 == 3] == [True] * 3 and got[-1].in_seq == seq + 2
    again = [(r.out_type, r.out_msg_seq, r.out_body.get(11), r.out_body.get(36)) for r in got if r.idx == 92]
    assert again == [("4", 1, None, "2"), ("D", 2, "x0", None), ("4", 3, None, "5"), ("D", 5, "x1", None), ("4", 6, None, "8"), ("D", 8, "x2", None), ("4", 9, None, "11")]
    anew = fixsession.run_sessions(spark.createDataFrame(rows[:12], EVENT)).where("idx = 10").first()
    assert (anew.out_msg_seq, anew.in_seq) == (1, 1)


class Handle:
    """A store of one key, by hand."""

    def __init__(self):
        self.value, self.timers = None, set()

    def getValueState(self, name, schema):
        return SimpleNamespace(exists=lambda: self.value is not None, get=lambda: self.value, update=lambda v: setattr(self, "value", v))

    def listTimers(self):
        return iter(self.timers)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def registerTimer(self, at):
        self.timers.add(at)


def test_timers_by_a_clock_of_ones_own():
    """The one timer of a session says all that waking it at every millisecond would say."""
    for heard in ([], [1.5], [1.5, 7.0, 21.0, 40.0]):
        handle, processor = Handle(), live.TimedSessionProcessor(Rules(heartbeat=3.0))
        processor.init(handle)
        plain, got, want = Session(Rules(heartbeat=3.0)), [], []
        events = [("c", 0, "logon", 100.0, None, None, None), ("c", 1, "message", 100.1, "A", 1, {108: "3"}), *(("c", 2 + i, "message", 100.0 + t, "D", 2 + i, None) for i, t in enumerate(heard))]
        frame = pd.DataFrame(events, columns=["conn", "idx", "op", "t_s", "msg_type", "seq", "body"])
        places = {}
        for i, t in enumerate(frame["t_s"]):
            places.setdefault(round(t * 1000), []).append(i)
        for ms in range(100_000, 160_000):
            now = SimpleNamespace(getCurrentProcessingTimeInMs=lambda ms=ms: ms)
            for i in places.get(ms, []):
                some = frame.loc[[i]]
                got += [r for out in processor.handleInputRows(("c",), iter([some]), now) for r in out.itertuples(index=False) if r.out_type]
                want += [(None, o.kind, o.number) for o in fixsession.EVENTS[some.iloc[0]["op"]](plain, some.iloc[0])[0]]
            want += [(ms, o.kind, o.number) for o in plain.wake(ms / 1000)]
            for at in [t for t in handle.timers if t <= ms]:
                handle.deleteTimer(at)
                got += [r for out in processor.handleExpiredTimer(("c",), now, None) for r in out.itertuples(index=False)]
            assert len(handle.timers) <= 1
        assert [(r.out_type, r.out_msg_seq) for r in got] == [w[1:] for w in want]
        assert want[-1][1] == "5" and got[-1].state == "DISCONNECTED" and not handle.timers


def test_a_silent_stream_is_woken(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    begins = time.time() + 8  # by when the stream runs
    rows = [(c, i, op, begins, kind, seq, None) for c in "ab" for i, (op, kind, seq) in enumerate([("logon", None, None), ("message", "A", 1)])]
    spark.createDataFrame(rows, EVENT).write.parquet(str(tmp_path / "in"))
    stream = live.live_sessions(spark.readStream.schema(EVENT).parquet(str(tmp_path / "in")), Rules(heartbeat=2.0), timers=True)
    seen = []
    query = stream.writeStream.foreachBatch(lambda frame, epoch: seen.extend(frame.collect())).option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="500 milliseconds").start()
    try:
        end = time.time() + 60
        while time.time() < end and sum(r.out_type == "5" for r in seen) < 2 and query.isActive:
            time.sleep(0.5)
    finally:
        query.stop()
    for conn in "ab":
        out = sorted((r for r in seen if r.conn == conn and r.out_type), key=lambda r: r.out_msg_seq)
        assert [r.out_msg_seq for r in out] == list(range(1, len(out) + 1))
        assert out[0].out_type == "A" and out[0].idx == 0 and all(r.idx is None for r in out[1:])
        assert {"0", "1"} <= {r.out_type for r in out[1:-1]} and out[-1].out_type == "5" and out[-1].state == "DISCONNECTED"
