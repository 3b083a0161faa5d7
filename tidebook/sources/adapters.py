"""Venue adapters: raw frames to normalised book updates, as column expressions.

A frame is parsed (it holds updates), ignored (control traffic, other channels, text that isn't JSON) or a parse
error (an object of the channel that lacks the shape). Levels that can't be read are skipped, their frame kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ticks import to_ticks
from ..operators.ordered import Running, running, sliced

#: The channels of the first venue that carry books.
OKX_CHANNELS = ("books", "books-l2-tbt", "books50-l2-tbt", "books5")
ROWS = "array<array<string>>"
OKX = f"struct<arg:struct<channel:string,instId:string>,action:string,data:array<struct<bids:{ROWS},asks:{ROWS},ts:string,seqId:string,prevSeqId:string>>,_odd:string>"
#: Where a frame's text goes that doesn't have the shape.
ODD = "_odd"
BYBIT = f"struct<topic:string,type:string,ts:string,data:struct<s:string,b:{ROWS},a:{ROWS},u:string,seq:string>,_odd:string>"


def levels(rows: Column, decimals: int) -> Column:
    """[price, size, ...] texts as levels in ticks; those that can't be read are left out, as are sizes that aren't numbers."""
    made = F.transform(
        F.coalesce(rows, F.array().cast(ROWS)),
        lambda r: F.struct(to_ticks(F.get(r, F.lit(0)), decimals).alias("price"), F.trim(F.get(r, F.lit(1))).try_cast("double").alias("size")),
    )
    return F.filter(made, lambda x: x["price"].isNotNull() & x["size"].isNotNull())


def whole(text: Column) -> Column:
    """A lenient whole number: null if it is none."""
    return text.try_cast("bigint")


def _judged(frames: DataFrame, shape: str, judge: Callable[[Column], tuple[Column, Column]]) -> DataFrame:
    """Adds outcome and updates, as ``judge`` makes them of the parsed text.

    The text is parsed in a projection of its own, which the optimizer doesn't repeat, as its result is used repeatedly.
    """
    parsed = spread(frames).withColumn("_parsed", F.from_json("raw", shape, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": ODD}))
    outcome, updates = judge(F.col("_parsed"))
    judged = parsed.withColumn("outcome", outcome)
    return judged.select(*frames.columns, "outcome", F.when(F.col("outcome") == "parsed", updates).alias("updates"))


def spread(frames: DataFrame) -> DataFrame:
    """Frames in at least as many partitions as there are cores: a file of one row group is read by one task, and parsing is
    what takes long. Frames of streams, and those that lie in enough partitions, are left where they are."""
    if frames.isStreaming:
        return frames
    cores = frames.sparkSession.sparkContext.defaultParallelism
    return frames if frames.rdd.getNumPartitions() >= cores else frames.repartition(cores)


def _outcome(m: Column, wanted: Column, bad: Column) -> Column:
    # only an object that lacks the shape is parsed a second time
    sound = m[ODD].isNull() | F.try_parse_json("raw").isNotNull()
    is_object = F.coalesce(F.startswith(F.ltrim("raw"), F.lit("{")), F.lit(False)) & sound
    return F.when(~F.coalesce(is_object & wanted, F.lit(False)), "ignored").when(bad, "parse_error").otherwise("parsed")


def has(m: Column, name: str) -> Column:
    return m[name].isNotNull() | F.get_json_object("raw", f"$.{name}").isNotNull()


def okx(frames: DataFrame, decimals: int = 1, symbol: str = "BTC-USDT") -> DataFrame:
    """Adds outcome (parsed, ignored or parse_error) and updates, an array, to frames with recv_ns and raw.

    A frame without an action is a snapshot. All elements of its data share its kind. Times are milliseconds.
    """

    def judge(m: Column) -> tuple[Column, Column]:
        wanted = has(m, "data") & m["arg"]["channel"].isin(*OKX_CHANNELS)
        no_time = lambda d: d.isNull() | ((d["ts"] != "") & d["ts"].try_cast("bigint").isNull())
        bad = m["data"].isNull() | F.exists(m["data"], lambda d: F.coalesce(no_time(d), F.lit(False)))
        is_snapshot = F.coalesce(m["action"], F.lit("snapshot")) == "snapshot"
        ts = lambda d: F.nullif(F.nullif(d["ts"], F.lit("")).try_cast("bigint"), F.lit(0)) * F.lit(1_000_000)
        made = F.transform(
            m["data"],
            lambda d: F.struct(
                F.lit("okx").alias("venue"), F.coalesce(m["arg"]["instId"], F.lit(symbol)).alias("symbol"), is_snapshot.alias("is_snapshot"), whole(d["seqId"]).alias("seq"), whole(d["prevSeqId"]).alias("prev_seq"),
                ts(d).alias("exchange_ts_ns"), F.col("recv_ns").alias("recv_ts_ns"), levels(d["bids"], decimals).alias("bids"), levels(d["asks"], decimals).alias("asks"),
            ),
        )
        return _outcome(m, wanted, bad), made

    return _judged(frames, OKX, judge)


def bybit(frames: DataFrame, decimals: int = 2, symbol: str = "BTCUSDT", contiguous: bool = True, order: str = "msg_idx", width: int = 1_000_000) -> DataFrame:
    """As :func:`okx`, for the second venue: one update in each frame, whose ``u`` is the sequence number.

    The number before is null for a snapshot and ``u - 1`` for a delta; with ``contiguous`` left out it is the
    last one seen in order of ``order``, snapshots included.
    """

    def judge(m: Column) -> tuple[Column, Column]:
        wanted = F.startswith(F.coalesce(m["topic"], F.lit("")), F.lit("orderbook.")) & has(m, "data")
        bad = m["data"].isNull() | (m["ts"].isNotNull() & m["ts"].try_cast("bigint").isNull())
        u, is_snapshot = whole(m["data"]["u"]), F.coalesce(m["type"] == "snapshot", F.lit(False))
        ts = F.nullif(m["ts"].try_cast("bigint"), F.lit(0)) * F.lit(1_000_000)
        made = F.array(
            F.struct(
                F.lit("bybit").alias("venue"), F.coalesce(m["data"]["s"], F.lit(symbol)).alias("symbol"), is_snapshot.alias("is_snapshot"), u.alias("seq"), F.when(~is_snapshot, u - 1).alias("prev_seq"),
                ts.alias("exchange_ts_ns"), F.col("recv_ns").alias("recv_ts_ns"), levels(m["data"]["b"], decimals).alias("bids"), levels(m["data"]["a"], decimals).alias("asks"),
            ),
        )
        return _outcome(m, wanted, bad), made

    rows = _judged(frames, BYBIT, judge)
    if contiguous:
        return rows
    update = F.get("updates", F.lit(0))
    rows = running(sliced(rows.withColumn("_symbol", update["symbol"]), order, width), ["_symbol"], order, {"_seen": Running("last", update["seq"])})
    seen = F.transform("updates", lambda x: x.withField("prev_seq", F.when(~x["is_snapshot"], F.col("_seen"))))
    return rows.withColumn("updates", seen).drop("_seen", "_symbol", "_slice")


def updates_of(parsed: DataFrame, order: str = "msg_idx") -> DataFrame:
    """A row for each update of parsed frames, with msg_idx and place (in the frame, from 0)."""
    # frames that aren't parsed have no updates; the outer form keeps Spark from parsing for a filter first
    rows = parsed.select(F.col(order).alias("msg_idx"), F.posexplode_outer("updates").alias("place", "_u")).where(F.col("_u").isNotNull())
    return rows.select("msg_idx", "place", "_u.*")


def exploded(parsed: DataFrame, order: str = "msg_idx", width: int = 100_000) -> DataFrame:
    """A row for each update of parsed frames, with idx from 0 in order of arrival (frame, then place in it).

    Frames may hold any number of updates: idx is their running count, over slices of a numeric ``order``. The parsed
    frames are kept, so they are parsed once. An ``order`` that occurs repeatedly has no defined order of its own.
    """
    n = F.when(F.col("updates").isNotNull(), F.size("updates")).otherwise(0).cast("bigint")
    counted = running(sliced(parsed.select(F.col(order).alias("msg_idx"), "updates"), "msg_idx", width), [], "msg_idx", {"_upto": Running("sum", n)})
    rows = counted.select("msg_idx", (F.col("_upto") - n).alias("_before"), F.posexplode("updates").alias("_place", "_u"))
    return rows.select("msg_idx", (F.col("_before") + F.col("_place")).alias("idx"), "_u.*")


#: Venues by name; another venue is another function of frames.
ADAPTERS: dict[str, Callable[..., DataFrame]] = {"okx": okx, "bybit": bybit}


def to_okx_frames(updates: DataFrame, decimals: int = 1, channel: str = "books") -> DataFrame:
    """Normalised updates as frames of the first venue: idx, recv_ns and raw."""
    scale = 10**decimals

    def price(ticks: Column) -> Column:
        sign = F.when(ticks < 0, "-").otherwise("")
        size = F.abs(ticks)
        text = F.concat(sign, F.floor(size / scale).cast("bigint").cast("string"))
        return F.concat(text, F.lit("."), F.lpad((size % scale).cast("string"), decimals, "0")) if decimals else text

    rows = lambda c: F.transform(c, lambda x: F.array(price(x["price"]), F.format_string("%.4f", x["size"]), F.lit("0"), F.lit("1")))
    item = F.struct(rows("bids").alias("bids"), rows("asks").alias("asks"), F.coalesce((F.col("exchange_ts_ns") / 1_000_000).cast("bigint"), F.lit(0)).cast("string").alias("ts"), F.col("seq").alias("seqId"), F.coalesce("prev_seq", F.lit(-1)).alias("prevSeqId"))
    frame = F.struct(F.struct(F.lit(channel).alias("channel"), F.col("symbol").alias("instId")).alias("arg"), F.when(F.col("is_snapshot"), "snapshot").otherwise("update").alias("action"), F.array(item).alias("data"))
    return updates.select("idx", F.col("recv_ts_ns").alias("recv_ns"), F.to_json(frame).alias("raw"))
