"""Level-2 books from audited updates.

A snapshot resets a book, so every epoch of a symbol is folded by itself and in parallel with the others. A long epoch
is folded in pieces, each from the book that stands when it begins: the last size written to each price by the pieces
before it, which is found by grouping and windows. The fold is one step function that the batch and the streaming jobs
share; it is needed where levels beyond a depth are forgotten for good. There a piece's first book is a guess, and pieces
whose guess was wrong are folded again. Without truncation, the levels' lifetimes give the same by windows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ticks import is_crossed
from ..schemas import TOP
from ..storage import cut
from .epochs import KEYS
from .rows import names_of


class Side:
    """One side of a book: prices in ascending order and their sizes."""

    __slots__ = ("is_bid", "prices", "sizes")

    def __init__(self, is_bid: bool):
        self.is_bid, self.prices, self.sizes = is_bid, [], {}

    def put(self, price: int, size: float) -> bool:
        """Sets a level, or deletes it if the size is not above zero; whether anything changed."""
        held = self.sizes.get(price)
        if size > 0:
            if held is None:
                insort(self.prices, price)
            self.sizes[price] = size
            return held != size
        if held is None:
            return False
        del self.sizes[price]
        self.prices.pop(bisect_left(self.prices, price))
        return True

    def best(self) -> tuple[int | None, float]:
        if not self.prices:
            return None, 0.0
        price = self.prices[-1 if self.is_bid else 0]
        return price, self.sizes[price]

    def top(self, n: int) -> list[tuple[int, float]]:
        chosen = self.prices[: -n - 1 : -1] if self.is_bid else self.prices[:n]
        return [(p, self.sizes[p]) for p in chosen]

    def forget_beyond(self, n: int) -> None:
        extra = len(self.prices) - n
        if extra > 0:
            gone = self.prices[:extra] if self.is_bid else self.prices[-extra:]
            self.prices = self.prices[extra:] if self.is_bid else self.prices[:-extra]
            for price in gone:
                del self.sizes[price]


class Book:
    """The state of a fold over the applied updates of an epoch."""

    __slots__ = ("bids", "asks", "max_depth", "no_op_deletes")

    def __init__(self, max_depth: int | None = None):
        self.bids, self.asks, self.max_depth, self.no_op_deletes = Side(True), Side(False), max_depth, 0

    def apply(self, is_snapshot: bool, bids, asks) -> None:
        """Takes an update in; ``bids`` and ``asks`` are pairs of price and size."""
        if is_snapshot:
            self.bids, self.asks = Side(True), Side(False)
        for side, levels in ((self.bids, bids), (self.asks, asks)):
            for price, size in levels:
                if not side.put(price, size) and not size > 0:
                    self.no_op_deletes += 1
            if self.max_depth is not None:
                side.forget_beyond(self.max_depth)

    def average_depth(self, n: int) -> float:
        """Half the sum of both sides' sizes over the best ``n`` levels."""
        return (sum(s for _, s in self.bids.top(n)) + sum(s for _, s in self.asks.top(n))) / 2.0


PIECE = [*KEYS, "epoch", "piece"]
STANDING = "array<struct<price:bigint,size:double>>"
#: The books that stand when pieces begin.
ENTRY = f"venue string, symbol string, epoch bigint, piece bigint, entry_bids {STANDING}, entry_asks {STANDING}"


def _written(applied: DataFrame) -> DataFrame:
    """The levels that the pieces of long epochs write, of each piece and price the last, and the piece that next does."""
    def of(side: str) -> Column:
        return F.transform(side, lambda x, i: F.struct(F.lit(side).alias("side"), i.alias("n"), x["price"].alias("price"), x["size"].alias("size")))

    sides = F.concat(of("bids"), of("asks"))
    rows = applied.where("pieces > 1").select(*PIECE, "pieces", "idx", F.explode(sides).alias("l")).select(*PIECE, "pieces", "idx", "l.*")
    last = rows.groupBy(*PIECE, "pieces", "side", "price").agg(F.max_by("size", F.struct("idx", "n")).alias("size"))
    return last.withColumn("next", F.lead("piece").over(Window.partitionBy(*KEYS, "epoch", "side", "price").orderBy("piece")))


def entry_books(applied: DataFrame, depth: int | None = None) -> DataFrame:
    """For each piece of a long epoch but the first the book that stands when it begins (see ``ENTRY``), in order of price;
    pieces that begin with an empty book are left out. With ``depth`` the best levels of it only.

    A level stands from the piece after the one that wrote it up to the one that next writes it.
    """
    standing = _written(applied).where((F.col("size") > 0) & ~F.isnan("size"))
    until = F.coalesce("next", F.col("pieces") - 1)
    rows = standing.where(until > F.col("piece")).select(*KEYS, "epoch", F.explode(F.sequence(F.col("piece") + 1, until)).alias("piece"), "side", "price", "size")

    def of(side: str) -> Column:
        levels_of = F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("price", "size"))))
        best = levels_of if depth is None else F.slice(levels_of, *((F.greatest(F.size(levels_of) - depth, F.lit(0)) + 1, F.lit(depth)) if side == "bids" else (1, depth)))
        return best.alias(f"entry_{side}")

    return rows.groupBy(*PIECE).agg(of("bids"), of("asks"))


def _prepared(applied: DataFrame, entries: DataFrame | None) -> DataFrame:
    """The rows that the folds read: place in the piece, update, keys and times. The first update of a piece also sets the
    levels of the book that it begins with, before its own."""
    if entries is not None:
        named = entries.select(*(F.col(c).alias(f"_of_{c}") for c in PIECE), "entry_bids", "entry_asks")
        applied = applied.join(named, F.expr(" AND ".join(["opens", *(f"{c} = _of_{c}" for c in PIECE)])), "left")
        applied = applied.withColumns({c: F.when(F.col(f"entry_{c}").isNull(), F.col(c)).otherwise(F.concat(f"entry_{c}", c)) for c in ("bids", "asks")})
    # one audit's columns: the join and this window keep what its window has dealt out
    rows = applied.withColumn("_place", F.row_number().over(Window.partitionBy(*KEYS, "epoch", "_part").orderBy("idx")))
    flat = [F.col(f"{c}.{x}").alias(f"{c}_{x}") for c in ("bids", "asks") for x in ("price", "size")]
    return rows.select("_place", "is_snapshot", *KEYS, "epoch", "idx", "recv_ts_ns", "exchange_ts_ns", "piece", *flat)


def _steps(batches: Iterator[pa.RecordBatch], max_depth: int | None) -> Iterator[tuple[pa.RecordBatch, Iterator[tuple]]]:
    """For each batch a pass over its rows: (row, the book after it, whether the book is another one, sides that changed)."""
    held: list[Book | None] = [None]
    for batch in batches:
        place, is_snapshot = (batch.column(i).to_numpy(zero_copy_only=False).tolist() for i in (0, 1))
        # prices and sizes lie flat, with the place where each row's begin
        bid_px, bid_sz, ask_px, ask_sz = (batch.column(i).values.to_numpy(zero_copy_only=False).tolist() for i in (9, 10, 11, 12))
        bid_at, ask_at = (batch.column(i).offsets.to_numpy().tolist() for i in (9, 11))

        def rows() -> Iterator[tuple]:
            for row, (n, new, b0, b1, a0, a1) in enumerate(zip(place, is_snapshot, bid_at, bid_at[1:], ask_at, ask_at[1:])):
                if n == 1:
                    held[0] = Book(max_depth)
                held[0].apply(new, zip(bid_px[b0:b1], bid_sz[b0:b1]) if b1 > b0 else (), zip(ask_px[a0:a1], ask_sz[a0:a1]) if a1 > a0 else ())
                yield row, held[0], new or n == 1, b1 > b0, a1 > a0

        yield batch, rows()


def _left_behind(applied: DataFrame, entries: DataFrame, max_depth: int) -> DataFrame:
    """The books after the pieces of long epochs, as those with which the next ones begin (see ``ENTRY``)."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, book = None, None

        def made() -> pa.RecordBatch:
            sides = ([{"price": p, "size": side.sizes[p]} for p in side.prices] for side in (book.bids, book.asks))
            return pa.RecordBatch.from_pylist([dict(zip(names_of(ENTRY), (*key[:3], key[3] + 1, *sides)))], ENTRY_ARROW)

        for batch, rows in _steps(batches, max_depth):
            keys = list(zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 8))))
            for row, now, another, _, _ in rows:
                if another and book is not None and keys[row] != key:
                    yield made()
                key, book = keys[row], now
        if book is not None:
            yield made()

    return _prepared(applied, entries).mapInArrow(fold, ENTRY)


_LEVELS = pa.list_(pa.struct([("price", pa.int64()), ("size", pa.float64())]))
ENTRY_ARROW = pa.schema([("venue", pa.string()), ("symbol", pa.string()), ("epoch", pa.int64()), ("piece", pa.int64()), ("entry_bids", _LEVELS), ("entry_asks", _LEVELS)])


def settled_books(applied: DataFrame, max_depth: int) -> DataFrame:
    """As :func:`entry_books`, where levels beyond ``max_depth`` are forgotten for good.

    What is forgotten depends on all that came before, so the best levels of the untruncated book are the first guess.
    Every piece is folded from its guess; where the book that it leaves isn't the one that the next piece began with, the
    next piece is folded again from that. A guess differs only by levels that were forgotten and never written again, so
    few pieces are folded twice; at worst one piece of an epoch is settled a round.
    """
    long = cut(applied.where("pieces > 1"))
    entries = cut(entry_books(long, max_depth))
    todo = long
    while not todo.isEmpty():
        left = _left_behind(todo, entries, max_depth).join(long.select(*PIECE).distinct(), PIECE, "left_semi")
        # pieces without a guess begin with an empty book
        met = left.join(entries.select(*PIECE, F.col("entry_bids").alias("b"), F.col("entry_asks").alias("a")), PIECE, "left")
        none = F.array().cast(STANDING)
        wrong = cut(met.where(~((F.coalesce("b", none) == F.col("entry_bids")) & (F.coalesce("a", none) == F.col("entry_asks")))).drop("a", "b"))
        entries = cut(entries.join(wrong, PIECE, "left_anti").unionByName(wrong))
        todo = long.join(wrong.select(*PIECE), PIECE, "left_semi")
    return entries


def top_of_book(audited: DataFrame, max_depth: int | None = None, depth_levels: int | None = None) -> DataFrame:
    """A row for each applied update: venue, symbol, epoch, idx, the times, best prices and sizes, and depth.

    depth is :meth:`Book.average_depth` of ``depth_levels``, null where that isn't given. The rows of a piece of an epoch
    are streamed in order through the fold, which holds one book at a time. They come that way out of the window that
    numbers them, which is the one that :func:`epochs.audit` has dealt them out for: no shuffle of its own.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bid, ask = (None, 0.0), (None, 0.0)
        for batch, rows in _steps(batches, max_depth):
            bp, bs, ap, az, depths = [], [], [], [], []
            for _, book, another, bids, asks in rows:
                if bids or another:
                    bid = book.bids.best()
                if asks or another:
                    ask = book.asks.best()
                bp.append(bid[0])
                bs.append(bid[1])
                ap.append(ask[0])
                az.append(ask[1])
                if depth_levels:
                    depths.append(book.average_depth(depth_levels))
            if bp:
                made = [pa.array(c, kind) for c, kind in zip((bp, bs, ap, az), (pa.int64(), pa.float64()) * 2)]
                held = [batch.column(i) for i in (2, 3, 4, 5, 6, 7)]
                yield pa.RecordBatch.from_arrays([*held, *made, pa.array(depths, pa.float64()) if depth_levels else pa.nulls(len(bp), pa.float64())], names=names_of(TOP))

    applied, entries = audited.where("applied"), None
    if not applied.where("pieces > 1").isEmpty():  # nothing is read where the audit saw no long epoch
        entries = entry_books(applied) if max_depth is None else settled_books(applied, max_depth)
    return _prepared(applied, entries).mapInArrow(fold, TOP)


def crossings(tops: DataFrame) -> DataFrame:
    """For each venue and symbol crossed_seen: how many updates left the book crossed or locked."""
    return tops.groupBy(*KEYS).agg(F.count_if(is_crossed(F.col("bid_px"), F.col("ask_px"))).alias("crossed_seen"))


def feed_age(tops: DataFrame, now_ns: Column) -> DataFrame:
    """For each venue and symbol the newest update's age and the venue's lag (receipt after the venue's own time; null
    where that is unknown), in nanoseconds."""
    newest = latest(tops, KEYS, "idx", ["recv_ts_ns", "exchange_ts_ns"])
    return newest.select(*KEYS, (now_ns - F.col("recv_ts_ns")).alias("age_ns"), (F.col("recv_ts_ns") - F.col("exchange_ts_ns")).alias("lag_ns"))


# --- levels by windows ------------------------------------------------------------------------------------------------


def levels(audited: DataFrame) -> DataFrame:
    """A row for each level of an applied update: the last of equal prices within an update counts.

    ``old_size`` is the size that the level had before in its epoch (0.0 if none), ``until`` the idx of the
    update that next sets it (null: the end of the epoch).
    """
    def of(side: str, column: str) -> Column:
        return F.transform(column, lambda x, i: F.struct(F.lit(side).alias("side"), i.alias("n"), x["price"].alias("price"), x["size"].alias("size")))

    sides = F.concat(of("BUY", "bids"), of("SELL", "asks"))
    rows = audited.where("applied").select(*KEYS, "epoch", "idx", F.explode(sides).alias("l")).select(*KEYS, "epoch", "idx", "l.*")
    w = Window.partitionBy(*KEYS, "epoch", "side", "price").orderBy("idx", "n")
    size = F.when((F.col("size") > 0) & ~F.isnan("size"), F.col("size")).otherwise(0.0)
    rows = rows.withColumn("size", size).withColumn("old_size", F.coalesce(F.lag("size").over(w), F.lit(0.0)))
    return rows.withColumn("until", F.lead("idx").over(w))


def no_op_deletes(level_rows: DataFrame) -> DataFrame:
    """For each venue and symbol the number of deletes of levels that were not there."""
    return level_rows.groupBy(*KEYS).agg(F.count_if((F.col("size") == 0) & (F.col("old_size") == 0)).alias("no_op_deletes"))


def final_levels(level_rows: DataFrame) -> DataFrame:
    """The levels that stand at the end of each symbol's last epoch."""
    last = level_rows.groupBy(*KEYS).agg(F.max("epoch").alias("epoch"))
    return level_rows.where(F.col("until").isNull() & (F.col("size") > 0)).join(last, [*KEYS, "epoch"], "left_semi").select(*KEYS, "side", "price", "size")


def ranked(standing: DataFrame, depth: int | None = None) -> DataFrame:
    """Adds ``level``, 1 for the best of a side; the best ``depth`` levels if given."""
    best_first = F.when(F.col("side") == "BUY", -F.col("price")).otherwise(F.col("price"))
    out = standing.withColumn("level", F.row_number().over(Window.partitionBy(*KEYS, "side").orderBy(best_first)).cast("bigint"))
    return out if depth is None else out.where(F.col("level") <= depth)


def cumulative_depth(standing: DataFrame) -> DataFrame:
    """Adds the running size outward from the touch."""
    w = Window.partitionBy(*KEYS, "side").orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    return ranked(standing).withColumn("cum_size", F.sum("size").over(w))


def average_depth(standing: DataFrame, n: int = 1) -> DataFrame:
    """For each symbol half the sum of both sides' sizes over the best ``n`` levels."""
    return ranked(standing, n).groupBy(*KEYS).agg((F.sum("size") / 2.0).alias("avg_depth"))


def size_at(standing: DataFrame, asked: DataFrame) -> DataFrame:
    """The size at each asked venue, symbol, side and price; 0.0 where there is no level."""
    return asked.join(standing, [*KEYS, "side", "price"], "left").withColumn("size", F.coalesce("size", F.lit(0.0)))


def ladder(standing: DataFrame, depth: int) -> DataFrame:
    """For each symbol the best levels of both sides as arrays, best first."""
    best = ranked(standing, depth)
    side = lambda s: F.transform(
        F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("level", "price", "size")))), lambda x: F.struct(x["price"].alias("price"), x["size"].alias("size"))
    )
    return best.groupBy(*KEYS).agg(side("BUY").alias("bids"), side("SELL").alias("asks"))


def latest(frame: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """The newest row for each key: all else is conflated away."""
    newest = frame.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col(order)).alias("_v"))
    return newest.select(*keys, *(F.col(f"_v.{v}").alias(v) for v in values))


def level_at(levels_column: Column, price: int) -> Column:
    """The size at a price in an array of levels; 0.0 if there is none."""
    return F.coalesce(F.get(F.filter(levels_column, lambda x: x["price"] == price), F.lit(0))["size"], F.lit(0.0))
