"""Checks before an order is sent: the first that fails, in a fixed order, names the rejection."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lifetimes import least_as_of
from .ordered import Running, running, sliced
from .rows import framed

#: The checks in their order.
CHECKS = (
    "kill_switch", "qty_sign", "market_disabled", "missing_price", "lot_size", "tick_size", "max_order_qty", "max_order_value",
    "price_collar", "max_position", "max_open_orders", "throttle", "self_trade",
)


@dataclass(frozen=True)
class Limits:
    """A limit of None is off. ``price_scale`` are the ticks of one unit of price."""

    max_order_qty: float | None = None
    max_order_value: float | None = None
    max_position: float | None = None
    price_collar_bps: float | None = None
    max_open_orders: int | None = None
    max_messages_per_sec: int | None = None
    tick_size: int | None = None
    lot_size: float | None = None
    allow_market: bool = True
    price_scale: float = 1.0


def static_check(limits: Limits, killed: bool = False) -> Column:
    """The first failing check that needs the order alone (qty, price, mid, is_market), else null."""
    qty, price, mid, market = (F.col(c) for c in ("qty", "price", "mid", "is_market"))
    check = F.when(F.lit(killed), "kill_switch").when(~F.coalesce(qty > 0, F.lit(False)), "qty_sign")
    if not limits.allow_market:
        check = check.when(market, "market_disabled")
    check = check.when(~market & price.isNull(), "missing_price")
    if limits.lot_size:
        check = check.when(F.abs(qty / limits.lot_size - F.rint(qty / limits.lot_size)) > 1e-9, "lot_size")
    if limits.tick_size:
        check = check.when(price % limits.tick_size != 0, "tick_size")
    if limits.max_order_qty is not None:
        check = check.when(qty > limits.max_order_qty, "max_order_qty")
    if limits.max_order_value is not None:
        check = check.when(qty * price / limits.price_scale > limits.max_order_value, "max_order_value")
    if limits.price_collar_bps is not None:
        check = check.when((mid > 0) & (F.abs(price - mid) / F.when(mid > 0, mid) * 10_000.0 > limits.price_collar_bps), "price_collar")
    return check


def position_check(limits: Limits) -> Column:
    """max_position or max_open_orders, given max_long, max_short and n_open as columns; else null."""
    check = F.when(F.lit(False), F.lit(""))
    if limits.max_position is not None:
        projected = F.when(F.col("side") == "BUY", F.col("max_long") + F.col("qty")).otherwise(F.col("max_short") - F.col("qty"))
        check = check.when(F.abs(projected) > limits.max_position, "max_position")
    if limits.max_open_orders is not None:
        check = check.when(F.col("n_open") >= limits.max_open_orders, "max_open_orders")
    return check


def self_trades(candidates: DataFrame, working: DataFrame) -> DataFrame:
    """The candidates that would hit an own working order of the other side.

    One number for each symbol and side decides it: the best price of the working orders there. So there is no
    join of pairs. A candidate without a price never crosses.
    """
    priced = working.where(F.col("price").isNotNull())
    best = priced.groupBy("symbol").agg(F.min(F.when(F.col("side") == "SELL", F.col("price"))).alias("_ask"), F.max(F.when(F.col("side") == "BUY", F.col("price"))).alias("_bid"))
    crosses = F.when(F.col("side") == "BUY", F.col("price") >= F.col("_ask")).otherwise(F.col("price") <= F.col("_bid"))
    return candidates.join(best, "symbol").where(crosses).drop("_ask", "_bid")


def self_trades_as_of(candidates: DataFrame, working: DataFrame) -> DataFrame:
    """The candidates (symbol, idx, side, price) that would hit an own order of the other side that works at their arrival.

    ``working``: symbol, side, price, from_idx and until_idx of all orders that ever worked; see :mod:`.lifetimes`.
    """
    # the best price of the other side is the least of these numbers, which a candidate must reach
    rank = lambda sells: F.when(sells, F.col("price")).otherwise(-F.col("price"))
    resting = working.withColumn("_rank", rank(F.col("side") == "SELL")).withColumn("side", F.when(F.col("side") == "SELL", "BUY").when(F.col("side") == "BUY", "SELL"))
    met = least_as_of(candidates, resting, ["symbol", "side"], {"_best": F.col("_rank")})
    return met.where(F.col("_best") <= rank(F.col("side") == "BUY")).select(*candidates.columns)


class Throttle:
    """Accepts at most ``limit`` messages within a second; only accepted ones count."""

    def __init__(self, limit: int, window: float = 1.0):
        self.limit, self.window, self.times = limit, window, deque()

    def accept(self, now: float) -> bool:
        while self.times and now - self.times[0] > self.window:
            self.times.popleft()
        if len(self.times) >= self.limit:
            return False
        self.times.append(now)
        return True


def throttled(messages: DataFrame, limit: int, key: str = "symbol", window: float = 1.0, width: int = 1_000_000) -> DataFrame:
    """Adds ``accepted``: whether a message is within the limit, in order of arrival (idx) for each key.

    What is accepted depends on what was, so this is a fold. A message that comes more than the window after all
    before it depends on none of them: a key's stream is cut there, and each stretch is folded by itself. A key
    that never pauses is one stretch, whose fold holds ``limit`` times and no rows.
    """
    timed = running(sliced(messages, "idx", width), [key], "idx", {"_t": Running("lag", F.col("t_s"))})
    latest = running(timed, [key], "idx", {"_latest": Running("max", F.col("_t"))}, keep=False)
    quiet = F.coalesce(F.col("t_s") - F.col("_latest") > window, F.lit(True))
    rows = running(latest, [key], "idx", {"_stretch": Running("sum", quiet.cast("bigint"))})
    names = [*messages.columns, "accepted"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in messages.schema) + ", accepted boolean"

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, throttle = None, None
        for frame in frames:
            accepted = []
            for k, stretch, t in zip(frame[key], frame["_stretch"], frame["t_s"]):
                if (k, stretch) != at:
                    at, throttle = (k, stretch), Throttle(limit, window)
                accepted.append(throttle.accept(t))
            yield frame.assign(accepted=accepted)[names]

    return rows.repartition(key, "_stretch").sortWithinPartitions(key, "_stretch", "idx").mapInPandas(fold, kinds)


def decisions(checked: DataFrame, check: Column) -> DataFrame:
    """Adds check (null if accepted) and accepted."""
    return checked.withColumn("check", check).withColumn("accepted", F.col("check").isNull())


def check_counts(decided: DataFrame) -> DataFrame:
    return decided.groupBy(F.coalesce("check", F.lit("accepted")).alias("check")).agg(F.count(F.lit(1)).alias("n"))


class RiskEngine:
    """All checks in their order for one order at a time."""

    def __init__(self, limits: Limits):
        self.limits, self.killed = limits, False
        self.throttle = Throttle(limits.max_messages_per_sec) if limits.max_messages_per_sec is not None else None

    def check(self, side: str, qty: float, price, mid, is_market: bool, now: float, max_long: float, max_short: float, working: list[tuple[str, int | None]]) -> str | None:
        """``working``: (side, price) of the symbol's working orders."""
        lim, priced = self.limits, price is not None
        lots = qty / lim.lot_size if lim.lot_size else 0.0
        rules = (
            ("kill_switch", lambda: self.killed), ("qty_sign", lambda: not qty > 0), ("market_disabled", lambda: is_market and not lim.allow_market),
            ("missing_price", lambda: not is_market and not priced), ("lot_size", lambda: bool(lim.lot_size) and abs(lots - round(lots)) > 1e-9),
            ("tick_size", lambda: priced and bool(lim.tick_size) and price % lim.tick_size != 0), ("max_order_qty", lambda: lim.max_order_qty is not None and qty > lim.max_order_qty),
            ("max_order_value", lambda: priced and lim.max_order_value is not None and qty * price / lim.price_scale > lim.max_order_value),
            ("price_collar", lambda: priced and lim.price_collar_bps is not None and mid is not None and mid > 0 and abs(price - mid) / mid * 10_000.0 > lim.price_collar_bps),
            ("max_position", lambda: lim.max_position is not None and abs(max_long + qty if side == "BUY" else max_short - qty) > lim.max_position),
            ("max_open_orders", lambda: lim.max_open_orders is not None and len(working) >= lim.max_open_orders),
        )
        failed = next((name for name, fails in rules if fails()), None)
        if failed:
            return failed
        if self.throttle and self.throttle.limit <= self._recent(now):
            return "throttle"
        if priced and any(s != side and p is not None and (price >= p if side == "BUY" else price <= p) for s, p in working):
            return "self_trade"
        if self.throttle:
            self.throttle.times.append(now)
        return None

    def _recent(self, now: float) -> int:
        times = self.throttle.times
        while times and now - times[0] > self.throttle.window:
            times.popleft()
        return len(times)


GATED = "symbol string, idx bigint, cl_ord_id string, check string, accepted boolean, position double, n_open bigint"


class Gate:
    """A symbol's state: its position and working orders as they stand when an order comes, and the checks' own.

    Accepted orders work from then on, so each decision rests on those before it.
    """

    def __init__(self, limits: Limits):
        self.engine, self.position, self.working = RiskEngine(limits), 0.0, {}

    def step(self, r) -> tuple:
        """Takes an event in: order, fill, close (of a working order), kill or resume."""
        check, price = None, None if pd.isna(r.price) else int(r.price)
        sums = {"BUY": 0.0, "SELL": 0.0}
        for side, left, _ in self.working.values():
            sums[side] += left
        if r.op == "order":
            mid, held = None if pd.isna(r.mid) else float(r.mid), [(side, p) for side, _, p in self.working.values()]
            check = self.engine.check(r.side, r.qty, price, mid, bool(r.is_market), r.t_s, self.position + sums["BUY"], self.position - sums["SELL"], held)
            if check is None:
                self.working[r.cl_ord_id] = (r.side, r.qty, price)
        elif r.op == "fill":
            self.position += r.qty if r.side == "BUY" else -r.qty
            if r.cl_ord_id in self.working:
                side, left, p = self.working.pop(r.cl_ord_id)
                if left - r.qty > 1e-9:
                    self.working[r.cl_ord_id] = (side, left - r.qty, p)
        elif r.op == "close":
            self.working.pop(r.cl_ord_id, None)
        elif r.op in ("kill", "resume"):
            self.engine.killed = r.op == "kill"
        else:
            raise ValueError(f"unknown event {r.op!r}")
        return (r.symbol, r.idx, r.cl_ord_id, check, check is None if r.op == "order" else None, self.position, len(self.working))


def gated(events: DataFrame, limits: Limits) -> DataFrame:
    """A row for each event (symbol, idx, op, cl_ord_id, side, qty, price, mid, is_market, t_s), in order of idx for each
    symbol: the check that an order failed, judged by what stood at its arrival, and position and working orders after it.

    What is accepted decides what works, so a symbol's events are one fold; symbols run in parallel.
    """

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        symbol, gate = object(), None
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                if r.symbol != symbol:
                    symbol, gate = r.symbol, Gate(limits)
                out.append(gate.step(r))
            yield framed(out, GATED)

    return events.repartition("symbol").sortWithinPartitions("symbol", "idx").mapInPandas(fold, GATED)
