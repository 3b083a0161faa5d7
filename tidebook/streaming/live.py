"""Structured Streaming over the same steps as the batch jobs.

Order of arrival is the truth of a book, so there is no watermark on the path of books: a late time counts in the
bucket that arrival has reached. Each venue and symbol's book, flow sums and sequence state are one state value of a
stateful processor, kept by the state store and its checkpoints.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.book import Book, latest
from ..operators.epochs import KEYS
from ..operators.fixsession import SESSION, Rules, Session, session_rows, shown
from ..operators.matching import MATCHED, Venue
from ..operators.orders import REPORTED, report_row, with_orders
from ..operators.risk import GATED, Gate, Limits
from ..operators.rows import framed

LIVE = "venue string, symbol string, idx bigint, recv_ts_ns bigint, applied boolean, bid_px bigint, bid_sz double, ask_px bigint, ask_sz double, e double, ofi double, events bigint, resyncs bigint, updates bigint"


class LiveBook:
    """A venue and symbol's state: book, sequence check and flow sums. ``step`` takes one update."""

    def __init__(self, max_depth: int | None, strict: bool):
        self.book, self.strict = Book(max_depth), strict
        self.ready, self.seq, self.before = False, None, None
        self.ofi, self.events, self.resyncs, self.updates = 0.0, 0, 0, 0

    def step(self, r) -> tuple:
        seq = None if pd.isna(r.seq) else int(r.seq)
        prev = None if pd.isna(r.prev_seq) else int(r.prev_seq)
        gap = not r.is_snapshot and (not self.ready or self.strict and prev is not None and self.seq is not None and prev != self.seq)
        if gap:
            self.ready, self.seq = False, None
            self.book = Book(self.book.max_depth)
            self.resyncs += 1
            return (r.venue, r.symbol, r.idx, r.recv_ts_ns, False, None, 0.0, None, 0.0, 0.0, self.ofi, self.events, self.resyncs, self.updates)
        if r.is_snapshot:
            self.seq = None
        levels = lambda side: [(x["price"], x["size"]) for x in side] if side is not None else []
        self.book.apply(r.is_snapshot, levels(r.bids), levels(r.asks))
        self.ready, self.updates = True, self.updates + 1
        self.seq = self.seq if seq is None else seq
        top = (*self.book.bids.best(), *self.book.asks.best())
        e = 0.0
        if self.before is not None:
            e = flow(self.before, top)
            self.events += top != self.before
        self.ofi, self.before = self.ofi + e, top
        return (r.venue, r.symbol, r.idx, r.recv_ts_ns, True, *top, e, self.ofi, self.events, self.resyncs, self.updates)


def flow(p: tuple, c: tuple) -> float:
    """What the step between two tops (bid price, bid size, ask price, ask size) adds; 0 unless both are two-sided."""
    if None in (p[0], p[2], c[0], c[2]):
        return 0.0
    bid = (c[1] if c[0] >= p[0] else 0.0) - (p[1] if c[0] <= p[0] else 0.0)
    ask = (c[3] if c[2] <= p[2] else 0.0) - (p[3] if c[2] >= p[2] else 0.0)
    return bid - ask


class _Folded(StatefulProcessor):
    """A processor whose state is one pickled object, advanced row by row in order of idx."""

    schema: str

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "value binary")

    def close(self) -> None:
        pass

    def new(self):
        raise NotImplementedError

    def rows(self, state, r) -> list[tuple]:
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = pickle.loads(bytes(self.state.get()[0])) if self.state.exists() else self.new()
        # one key's rows of a micro-batch, which the trigger bounds, come in no order
        batch = pd.concat(list(rows)).sort_values("idx", kind="stable")
        out = [x for r in batch.itertuples(index=False) for x in self.rows(state, r)]
        self.state.update((pickle.dumps(state),))
        yield framed(out, self.schema)


class BookProcessor(_Folded):
    schema = LIVE

    def __init__(self, max_depth: int | None = None, strict: bool = True):
        self.max_depth, self.strict = max_depth, strict

    def new(self) -> LiveBook:
        return LiveBook(self.max_depth, self.strict)

    def rows(self, state: LiveBook, r) -> list[tuple]:
        return [state.step(r)]


BUCKETS = "venue string, symbol string, start_ns bigint, end_ns bigint, ofi double, delta_mid double, avg_depth double, events bigint, mid_start double, mid_end double"


class LiveBuckets:
    """A venue and symbol's book and the bucket that is open; see :func:`live_buckets`."""

    def __init__(self, interval_ns: int, max_depth: int | None, strict: bool):
        self.live, self.interval = LiveBook(max_depth, strict), interval_ns
        self.first = self.reached = self.at = self.last_mid = None
        self._open()

    def _open(self) -> None:
        self.ofi, self.events, self.depth, self.two_sided, self.first_mid, self.before = 0.0, 0, 0.0, 0, None, self.last_mid

    def _closed(self, venue: str, symbol: str) -> list[tuple]:
        if not self.two_sided:
            return []
        start, begins = self.first + self.at * self.interval, self.first_mid if self.before is None else self.before
        return [(venue, symbol, start, start + self.interval, self.ofi, self.last_mid - begins, self.depth / self.two_sided, self.events, begins, self.last_mid)]

    def step(self, r) -> list[tuple]:
        seen = self.live.events
        _, _, _, recv, applied, bid, bid_sz, ask, ask_sz, e, *_ = self.live.step(r)
        if not applied:
            return []
        out, recv = [], int(recv)
        if self.first is None:
            self.first = self.reached = recv
            self.at = 0
        self.reached = max(self.reached, recv)
        at = (self.reached - self.first) // self.interval
        if at > self.at:
            out = self._closed(r.venue, r.symbol)
            self.at = at
            self._open()
        self.ofi, self.events = self.ofi + e, self.events + self.live.events - seen
        if bid is not None and ask is not None:
            self.last_mid, self.depth, self.two_sided = (bid + ask) / 2.0, self.depth + (bid_sz + ask_sz) / 2.0, self.two_sided + 1
            self.first_mid = self.last_mid if self.first_mid is None else self.first_mid
        return out


class BucketProcessor(_Folded):
    schema = BUCKETS

    def __init__(self, interval_ns: int, max_depth: int | None = None, strict: bool = True):
        if interval_ns <= 0:
            raise ValueError("interval_ns must be positive")
        self.made = interval_ns, max_depth, strict

    def new(self) -> LiveBuckets:
        return LiveBuckets(*self.made)

    def rows(self, state: LiveBuckets, r) -> list[tuple]:
        return state.step(r)


class SessionProcessor(_Folded):
    schema = SESSION

    def __init__(self, rules: Rules = Rules()):
        self.rules_of = rules

    def new(self) -> Session:
        return Session(self.rules_of)

    def rows(self, state: Session, r) -> list[tuple]:
        return session_rows(state, r)


class TimedSessionProcessor(SessionProcessor):
    """Sessions that the clock wakes: each has one timer, at the time when it next has something to say."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.handle = handle

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield from super().handleInputRows(key, rows, timerValues)
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self._wake_when_due(pickle.loads(bytes(self.state.get()[0])))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        session = pickle.loads(bytes(self.state.get()[0]))
        out = shown(session, key[0], None, session.wake(timerValues.getCurrentProcessingTimeInMs() / 1000))
        self.state.update((pickle.dumps(session),))
        self._wake_when_due(session)
        yield framed(out, SESSION)

    def _wake_when_due(self, session: Session) -> None:
        if (due := session.due()) is not None:
            self.handle.registerTimer(math.floor(due * 1000) + 1)


class OrderProcessor(_Folded):
    schema = REPORTED

    def new(self) -> list:
        return [None]

    def rows(self, state: list, r) -> list[tuple]:
        return [report_row(state, r)]


class VenueProcessor(_Folded):
    schema = MATCHED

    def new(self) -> Venue:
        return Venue()

    def rows(self, state: Venue, r) -> list[tuple]:
        return state.rows(r)


class RiskProcessor(_Folded):
    schema = GATED

    def __init__(self, limits: Limits):
        self.limits = limits

    def new(self) -> Gate:
        return Gate(self.limits)

    def rows(self, state: Gate, r) -> list[tuple]:
        return [state.step(r)]


def live_books(updates: DataFrame, max_depth: int | None = None, strict: bool = True) -> DataFrame:
    """A streaming frame of updates to a row for each: the top of book, its flow contribution and running sums."""
    processor = BookProcessor(max_depth, strict)
    return updates.groupBy(*KEYS).transformWithStateInPandas(processor, LIVE, "append", "None")


def live_buckets(updates: DataFrame, interval_ns: int, max_depth: int | None = None, strict: bool = True) -> DataFrame:
    """A streaming frame of updates to buckets as :func:`ofi.buckets` makes them, each once arrival has passed its end.

    A late row counts in the bucket that arrival has reached, so no bucket is ever given out again. The bucket that is open
    when the stream ends, which the batch job ends at the last row, is kept in the state and not given out.
    """
    return updates.groupBy(*KEYS).transformWithStateInPandas(BucketProcessor(interval_ns, max_depth, strict), BUCKETS, "append", "None")


def live_sessions(events: DataFrame, rules: Rules = Rules(), timers: bool = False) -> DataFrame:
    """A stream of events to the rows of :func:`fixsession.run_sessions`.

    With ``timers`` heartbeats, test requests and the end of a silent session come by Spark's clock, also where no row
    arrives; such rows have a null idx. The events' ``t_s`` must then be seconds since 1970 by the same clock.
    """
    if timers:
        return events.groupBy("conn").transformWithStateInPandas(TimedSessionProcessor(rules), SESSION, "append", "ProcessingTime")
    return events.groupBy("conn").transformWithStateInPandas(SessionProcessor(rules), SESSION, "append", "None")


def live_orders(reports: DataFrame, orders: DataFrame) -> DataFrame:
    """A stream of execution reports, with a table of orders, to the order after each report and its error."""
    return with_orders(reports, orders).groupBy("cl_ord_id").transformWithStateInPandas(OrderProcessor(), REPORTED, "append", "None")


def live_matching(commands: DataFrame) -> DataFrame:
    """A stream of commands to the reports and trades that they cause."""
    return commands.groupBy("symbol").transformWithStateInPandas(VenueProcessor(), MATCHED, "append", "None")


def live_risk(events: DataFrame, limits: Limits) -> DataFrame:
    """A stream of orders, fills and their ends to a decision for each order, as :func:`risk.gated`."""
    return events.groupBy("symbol").transformWithStateInPandas(RiskProcessor(limits), GATED, "append", "None")


def latest_sink(live: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Gives ``write`` the newest row for each venue's symbol of every micro-batch: what came between is conflated away."""
    def each(batch: DataFrame, epoch: int) -> None:
        keys = [k for k in KEYS if k in batch.columns]
        write(latest(batch, keys, "idx", [c for c in batch.columns if c not in keys]), epoch)

    return live.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def raw_sink(messages: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Lands a stream of raw messages as gzipped JSON lines, payloads byte for byte."""
    writer = messages.writeStream.format("json").option("path", path).option("compression", "gzip").option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
