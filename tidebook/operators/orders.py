"""Orders: the state machine of execution reports, fills, positions, exposure and profit."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ticks import sign
from .ordered import Running, running, sliced
from .rows import framed

#: The statuses that may follow each status of an order.
ALLOWED = {
    "PENDING_NEW": ("PENDING_NEW", "NEW", "REJECTED", "PARTIALLY_FILLED", "FILLED", "CANCELED", "EXPIRED"),
    "NEW": ("NEW", "PARTIALLY_FILLED", "FILLED", "CANCELED", "PENDING_CANCEL", "PENDING_REPLACE", "REPLACED", "EXPIRED", "REJECTED"),
    "PARTIALLY_FILLED": ("PARTIALLY_FILLED", "FILLED", "CANCELED", "PENDING_CANCEL", "PENDING_REPLACE", "REPLACED", "EXPIRED"),
    "PENDING_CANCEL": ("PENDING_CANCEL", "CANCELED", "PARTIALLY_FILLED", "FILLED", "NEW", "EXPIRED"),
    "PENDING_REPLACE": ("PENDING_REPLACE", "REPLACED", "PARTIALLY_FILLED", "FILLED", "CANCELED", "NEW", "EXPIRED"),
    "REPLACED": ("REPLACED",),
    "FILLED": (), "CANCELED": (), "REJECTED": (), "EXPIRED": (),
}
TERMINAL = ("FILLED", "CANCELED", "REJECTED", "EXPIRED", "REPLACED")
OVERFILL = 1e-9


def may_follow(before: Column, after: Column) -> Column:
    pairs = [f"{a}>{b}" for a, follow in ALLOWED.items() for b in follow]
    return F.concat_ws(">", before, after).isin(pairs)


def new_orders(requests: DataFrame, prefix: str = "ORD", order: str = "idx", width: int = 1_000_000) -> DataFrame:
    """Adds cl_ord_id where it is null, status PENDING_NEW, and error: why a request is no order, else null.

    Ids are numbered in the order of ``order``, over slices of it. Of repeated ids the first is an order.
    """
    counted = running(sliced(requests, order, width), [], order, {"_n": Running("sum", F.col("cl_ord_id").isNull().cast("bigint"))}).drop("_slice")
    named = counted.withColumn("cl_ord_id", F.coalesce("cl_ord_id", F.format_string(f"{prefix}-%08d", "_n")))
    # one row for each id, aggregated before the shuffle; the join can split an id that many requests have
    first = named.groupBy(F.col("cl_ord_id").alias("_id")).agg(F.min(order).alias("_first"))
    named = named.join(first, F.col("cl_ord_id") == F.col("_id"))
    error = (
        F.when(~F.coalesce(F.col("qty") > 0, F.lit(False)), "quantity must be positive")
        .when((F.col("ord_type") == "LIMIT") & F.col("price").isNull(), "limit order without price")
        .when(F.col(order) > F.col("_first"), "duplicate id")
    )
    return named.withColumn("error", error).withColumn("status", F.when(error.isNull(), "PENDING_NEW")).drop("_n", "_id", "_first")


class OrderState:
    """An order as its accepted reports leave it. Batch and streaming jobs share it."""

    __slots__ = ("status", "qty", "cum_qty", "avg_px", "order_id", "reject_reason", "rejected_transitions")

    def __init__(self, qty: float, status: str = "PENDING_NEW"):
        self.status, self.qty, self.cum_qty, self.avg_px = status, qty, 0.0, 0.0
        self.order_id = self.reject_reason = None
        self.rejected_transitions = 0

    @property
    def leaves_qty(self) -> float:
        return 0.0 if self.status in TERMINAL else max(0.0, self.qty - self.cum_qty)

    def apply(self, report) -> str | None:
        """Takes a report in; the error code if it is refused. A refused one may still have told the order's id."""
        if report.ord_status not in ALLOWED.get(self.status, ()):
            self.rejected_transitions += 1
            return "illegal_transition"
        if report.order_id:
            self.order_id = report.order_id
        if report.exec_type == "TRADE":
            if not report.last_qty > 0 or pd.isna(report.last_px):
                return "trade_without_quantity_or_price"
            if report.last_qty > self.leaves_qty + OVERFILL:
                return "overfill"
            total = self.avg_px * self.cum_qty + report.last_px * report.last_qty
            self.cum_qty += report.last_qty
            self.avg_px = total / self.cum_qty
        elif not pd.isna(report.cum_qty) and report.cum_qty != self.cum_qty:
            return "cum_qty_mismatch"
        if report.exec_type == "REJECTED":
            self.reject_reason = report.text
        self.status = report.ord_status
        return None


def report_row(held: list, r) -> tuple:
    """The row of one execution report. ``held`` has the order's state, made at the first report of a known order."""
    if held[0] is None and not pd.isna(r.order_qty):
        held[0] = OrderState(r.order_qty)
    error = "unknown_order" if held[0] is None else held[0].apply(r)
    s = held[0] or OrderState(0.0, None)
    return (r.idx, r.cl_ord_id, r.symbol, r.side, r.exec_type, r.last_qty, r.last_px, s.status, s.order_id, s.cum_qty, s.avg_px, s.reject_reason, error)


REPORTED = "idx bigint, cl_ord_id string, symbol string, side string, exec_type string, last_qty double, last_px bigint, status string, order_id string, cum_qty double, avg_px double, reject_reason string, error string"


def apply_reports(orders: DataFrame, reports: DataFrame) -> DataFrame:
    """A row for each execution report, in order of idx within its order: the order after it, and error.

    A refused report leaves the status as it was, so later ones are judged by the last accepted status. Reports
    of unknown orders have the error ``unknown_order``. Orders are independent: rows are sorted by order within
    partitions and streamed through the fold.
    """
    rows = with_orders(reports, orders)

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = object(), [None]
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                if r.cl_ord_id != key:
                    key, held = r.cl_ord_id, [None]
                out.append(report_row(held, r))
            if out:
                yield framed(out, REPORTED)

    return rows.repartition("cl_ord_id").sortWithinPartitions("cl_ord_id", "idx").mapInPandas(fold, REPORTED)


def with_orders(reports: DataFrame, orders: DataFrame) -> DataFrame:
    """Reports, of a stream or a batch, with symbol, side and order_qty of their order (null if it is unknown)."""
    known = orders.select("cl_ord_id", "symbol", "side", F.col("qty").alias("order_qty"))
    return reports.join(known, "cl_ord_id", "left")


def fills_of(applied: DataFrame) -> DataFrame:
    """The accepted trades: idx, cl_ord_id, symbol, side, qty and price."""
    return applied.where((F.col("exec_type") == "TRADE") & F.col("error").isNull()).select("idx", "cl_ord_id", "symbol", "side", F.col("last_qty").alias("qty"), F.col("last_px").alias("price"))


def latest_orders(orders: DataFrame, applied: DataFrame) -> DataFrame:
    """``orders`` with status, cum_qty and avg_px after the last report."""
    last = applied.groupBy("cl_ord_id").agg(F.max_by(F.struct("status", "cum_qty", "avg_px"), "idx").alias("_l"))
    joined = orders.drop("status", "cum_qty", "avg_px").join(last, "cl_ord_id", "left")
    return joined.select(*[c for c in orders.columns if c not in ("status", "cum_qty", "avg_px")], F.coalesce("_l.status", F.lit("PENDING_NEW")).alias("status"), F.coalesce("_l.cum_qty", F.lit(0.0)).alias("cum_qty"), F.coalesce("_l.avg_px", F.lit(0.0)).alias("avg_px"))


def leaves(status: Column, qty: Column, cum_qty: Column) -> Column:
    return F.when(status.isin(*TERMINAL), 0.0).otherwise(F.greatest(F.lit(0.0), qty - cum_qty))


def signed_filled(side: Column, cum_qty: Column) -> Column:
    """The filled quantity, negative for a sale."""
    return sign(side) * cum_qty


def working(orders: DataFrame) -> DataFrame:
    return orders.where(~F.col("status").isin(*TERMINAL))


def positions(fills: DataFrame) -> DataFrame:
    """Signed quantity for each symbol."""
    return fills.groupBy("symbol").agg(F.sum(sign(F.col("side")) * F.col("qty")).alias("position"))


def vwap(fills: DataFrame, keys: list[str]) -> DataFrame:
    """For each group the quantity filled and its average price."""
    out = fills.groupBy(*keys).agg(F.sum("qty").alias("cum_qty"), F.sum(F.col("price") * F.col("qty")).alias("notional"))
    return out.withColumn("avg_px", F.col("notional") / F.nullif(F.col("cum_qty"), F.lit(0.0)))


def exposure(fills: DataFrame, working_orders: DataFrame) -> DataFrame:
    """For each symbol the position, and the most long and most short it gets if all working orders fill.

    ``working_orders``: symbol, side and leaves_qty.
    """
    held = positions(fills)
    side = lambda s: F.sum(F.when(F.col("side") == s, F.col("leaves_qty")).otherwise(0.0))
    open_ = working_orders.groupBy("symbol").agg(side("BUY").alias("_buy"), side("SELL").alias("_sell"))
    joined = held.join(open_, "symbol", "full").fillna(0.0, ["position", "_buy", "_sell"])
    return joined.select("symbol", "position", (F.col("position") + F.col("_buy")).alias("max_long"), (F.col("position") - F.col("_sell")).alias("max_short"))


def exposure_as_of(changes: DataFrame, asked: DataFrame, width: int = 1_000_000) -> DataFrame:
    """``asked`` (symbol, idx and more) with position, max_long, max_short and n_open as they stood at each row's arrival.

    ``changes``: symbol, idx, and what a fill, a new order or its end adds: d_position, d_buy and d_sell (working
    quantity of either side) and d_open (working orders). A change counts for rows of a higher idx. Both streams
    are one order, summed up over slices of it.
    """
    deltas = ["d_position", "d_buy", "d_sell", "d_open"]
    # of one idx the question comes before the change
    both = changes.select("symbol", (F.col("idx") * 2 + 1).alias("_o"), *deltas).unionByName(asked.withColumn("_o", F.col("idx") * 2).withColumn("_asked", F.lit(True)), allowMissingColumns=True)
    sums = running(sliced(both, "_o", 2 * width), ["symbol"], "_o", {f"_{d}": Running("sum", F.col(d)) for d in deltas})
    out = sums.where("_asked").withColumn("position", F.col("_d_position").cast("double")).withColumn("n_open", F.col("_d_open").cast("bigint"))
    return out.select(*asked.columns, "position", (F.col("position") + F.col("_d_buy")).alias("max_long"), (F.col("position") - F.col("_d_sell")).alias("max_short"), "n_open")


def marked_profit(fills: DataFrame, marks: DataFrame) -> DataFrame:
    """For each symbol cash from fills plus the position at its mark (symbol, mark); null without a mark."""
    s = sign(F.col("side"))
    sums = fills.groupBy("symbol").agg(F.sum(-s * F.col("price") * F.col("qty")).alias("_cash"), F.sum(s * F.col("qty")).alias("position"))
    return sums.join(marks, "symbol", "left").select("symbol", "position", (F.col("_cash") + F.col("position") * F.col("mark")).alias("pnl"))


def bad_transitions(reports: DataFrame) -> DataFrame:
    """Adds before (the status of the report before, PENDING_NEW at first) and allowed, for streams without refusals."""
    w = Window.partitionBy("cl_ord_id").orderBy("idx")
    before = F.coalesce(F.lag("ord_status").over(w), F.lit("PENDING_NEW"))
    return reports.withColumn("before", before).withColumn("allowed", may_follow(F.col("before"), F.col("ord_status")))
