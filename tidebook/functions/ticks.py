"""Exact conversion between price texts and ticks, and the measures of a top of book, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_ticks(text: Column, decimals: int, strict: bool = False) -> Column:
    """The price as a whole number of ticks of ``10 ** -decimals``.

    Texts that are no finite decimal number, that have significant digits beyond ``decimals``, or that don't
    fit a bigint give null; with ``strict`` they raise an error. White space around the number, a leading sign,
    an exponent and underscores between digits are accepted, as in decimal literals.
    """
    if not 0 <= decimals <= 18:
        raise ValueError("decimals must be between 0 and 18")
    trimmed = F.regexp_replace(F.trim(F.translate(text, "\t\n\r\f\x0b", "     ")), r"(?<=[0-9])_(?=[0-9])", "")
    shape = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]{1,3})?$"
    digits = F.regexp_replace(F.regexp_extract(trimmed, shape, 1), r"\.", "")
    fraction = F.length(F.regexp_extract(F.regexp_extract(trimmed, shape, 1), r"\.([0-9]*)$", 1))
    exponent = F.coalesce(F.regexp_extract(trimmed, r"[eE]([+-]?[0-9]+)$", 1).try_cast("int"), F.lit(0))
    # the number is digits * 10 ** shift in ticks
    shift = exponent - fraction + decimals
    whole = F.when(shift >= 0, F.concat(digits, F.repeat(F.lit("0"), F.least(shift, F.lit(40)))))
    kept = F.length(digits) + shift
    cut = F.when(kept <= 0, F.lit("0")).otherwise(F.substring(digits, F.lit(1), kept))
    dropped = F.when(kept <= 0, digits).otherwise(F.substring(digits, kept + 1, F.length(digits)))
    exact = F.when(shift >= 0, whole).when(F.regexp_replace(dropped, "0", "") == "", cut)
    plain = F.regexp_replace(exact, "^0+(?=[0-9])", "").try_cast("bigint")
    general = F.when(trimmed.rlike(shape), F.when(F.startswith(trimmed, F.lit("-")), -plain).otherwise(plain))
    ticks = F.when(text.rlike(r"\A[+-]?[0-9]+(\.[0-9]*)?\z"), _plain_ticks(text, decimals)).otherwise(general)
    if not strict:
        return ticks
    return F.when(ticks.isNotNull(), ticks).otherwise(F.raise_error(F.concat(F.lit("not a price: "), F.coalesce(text, F.lit("null")))).cast("bigint"))


def _plain_ticks(text: Column, decimals: int) -> Column:
    """Of a text of digits with at most a sign and a point: the common case, in few steps."""
    point = F.instr(text, ".")
    fraction = F.when(point > 0, F.substring(text, point + 1, F.length(text))).otherwise("")
    kept = F.rpad(F.substring(fraction, F.lit(1), F.lit(decimals)), decimals, "0") if decimals else F.lit("")
    exact = ~F.substring(fraction, F.lit(decimals + 1), F.length(text)).rlike("[1-9]")
    return F.when(exact, F.concat(F.substring_index(text, ".", 1), kept).try_cast("bigint"))


def to_price(ticks: Column, decimals: int) -> Column:
    """Ticks as an exact decimal."""
    return (ticks.cast("decimal(38,0)") / F.lit(10**decimals).cast("decimal(20,0)")).cast(f"decimal(38,{decimals})")


def to_float(ticks: Column, decimals: int) -> Column:
    return ticks / F.lit(float(10**decimals))


def sign(side: Column) -> Column:
    return F.when(side == "BUY", 1).otherwise(-1)


def opposite(side: Column) -> Column:
    return F.when(side == "BUY", "SELL").otherwise("BUY")


def is_two_sided(bid_px: Column, ask_px: Column) -> Column:
    return bid_px.isNotNull() & ask_px.isNotNull()


def mid(bid_px: Column, ask_px: Column) -> Column:
    """Null unless both sides are there."""
    return (bid_px + ask_px) / F.lit(2.0)


def spread(bid_px: Column, ask_px: Column) -> Column:
    return ask_px - bid_px


def microprice(bid_px: Column, bid_sz: Column, ask_px: Column, ask_sz: Column) -> Column:
    """The mid weighted by the sizes of the other side; the mid where there is no size."""
    total = bid_sz + ask_sz
    weighted = (bid_px * ask_sz + ask_px * bid_sz) / F.nullif(total, F.lit(0.0))
    return F.when(is_two_sided(bid_px, ask_px), F.when(total > 0, weighted).otherwise(mid(bid_px, ask_px)))


def is_crossed(bid_px: Column, ask_px: Column) -> Column:
    """Both sides there and the bid at or above the ask; a locked book counts."""
    return F.coalesce(bid_px >= ask_px, F.lit(False))


def check_integrity(frame, strict: bool = False):
    """Adds ``crossed``; with ``strict`` a crossed row fails the job."""
    crossed = is_crossed(F.col("bid_px"), F.col("ask_px"))
    if strict:
        crossed = F.when(crossed, F.raise_error(F.concat(F.lit("crossed book at idx "), F.col("idx").cast("string"))).cast("boolean")).otherwise(False)
    return frame.withColumn("crossed", crossed)
