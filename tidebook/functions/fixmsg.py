"""FIX 4.4 messages as column expressions: encoding, checksums, decoding and field access.

A message's fields are an array of tag and value, as their order and repeated tags matter.
"""

from __future__ import annotations

from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

SOH = "\x01"
BEGIN = "FIX.4.4"
FIELDS = "array<struct<tag:int,value:string>>"

#: Tags of the standard by name.
TAGS = {
    "Account": 1, "AvgPx": 6, "BeginSeqNo": 7, "BeginString": 8, "BodyLength": 9, "CheckSum": 10, "ClOrdID": 11, "CumQty": 14, "EndSeqNo": 16, "ExecID": 17,
    "LastPx": 31, "LastQty": 32, "MsgSeqNum": 34, "MsgType": 35, "NewSeqNo": 36, "OrderID": 37, "OrderQty": 38, "OrdStatus": 39, "OrdType": 40, "OrigClOrdID": 41,
    "PossDupFlag": 43, "Price": 44, "RefSeqNum": 45, "SenderCompID": 49, "SendingTime": 52, "Side": 54, "Symbol": 55, "TargetCompID": 56, "Text": 58, "TimeInForce": 59,
    "TransactTime": 60, "EncryptMethod": 98, "OrdRejReason": 103, "HeartBtInt": 108, "TestReqID": 112, "OrigSendingTime": 122, "GapFillFlag": 123, "ResetSeqNumFlag": 141,
    "ExecType": 150, "LeavesQty": 151,
}
#: Message types that belong to the session.
ADMIN_TYPES = ("0", "1", "2", "3", "4", "5", "A")


def byte_sum(text: Column) -> Column:
    """The sum of the bytes of an ASCII text; null if it has any other character."""

    @F.arrow_udf("bigint")
    def summed(texts: pa.Array) -> pa.Array:
        at, sums, odd = running_bytes(pc.fill_null(texts, ""))
        bad = (odd[at[1:]] > odd[at[:-1]]) | texts.is_null().to_numpy(zero_copy_only=False)
        return pa.array(sums[at[1:]] - sums[at[:-1]], mask=bad)

    return summed(text)


def running_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each text begins and the last one ends in the buffer that holds them one behind the other; the sums of the
    bytes before each place, and the numbers of those beyond ASCII."""
    held = texts.cast(pa.large_binary())
    _, offsets, data = held.buffers()
    at = np.frombuffer(offsets, np.int64, len(held) + 1, held.offset * 8) if len(held) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    upto = lambda x: np.r_[0, np.cumsum(x, dtype=np.int64)]
    return at - at[0], upto(data), upto(data > 127)


def checksum(text: Column) -> Column:
    """Three digits: the byte sum modulo 256."""
    return F.lpad((byte_sum(text) % 256).cast("string"), 3, "0")


def encode(msg_type: Column, fields: list[tuple[int, Column]]) -> Column:
    """A framed message; fields of null values are left out."""
    parts = [F.concat(F.lit(f"{tag}="), value.cast("string"), F.lit(SOH)) for tag, value in [(35, msg_type), *fields]]
    body = F.concat(*(F.coalesce(p, F.lit("")) for p in parts))
    head = F.concat(F.lit(f"8={BEGIN}{SOH}9="), F.length(body).cast("string"), F.lit(SOH), body)
    return F.concat(head, F.lit("10="), checksum(head), F.lit(SOH))


def fields_of(raw: Column) -> Column:
    """All fields in order; a part without ``=`` or a numeric tag has a null tag."""
    parts = F.split(raw, SOH)
    cut = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.transform(
        cut,
        lambda p: F.struct(
            F.when(F.instr(p, "=") > 0, F.substring_index(p, "=", 1)).try_cast("int").alias("tag"),
            F.when(F.instr(p, "=") > 0, F.substring(p, F.instr(p, "=") + 1, F.length(p))).alias("value"),
        ),
    )


def decoded(raw: Column) -> Column:
    """fields (as :func:`fields_of`), and error: the first thing that is wrong with a message, in a fixed order; null if
    it is sound. A null message has neither.

    A batch of messages is split, summed and judged as whole columns.
    """

    @F.arrow_udf(f"struct<fields:{FIELDS},error:string>")
    def of(texts: pa.Array) -> pa.Array:
        return decoded_array(texts)

    return of(raw)


def whole_numbers(texts: pa.Array, bits: int) -> pa.Array:
    """Texts of digits, with a sign and white space around at most, as numbers; null where they are none."""
    plain = pc.utf8_trim_whitespace(texts)
    fits = pc.fill_null(pc.match_substring_regex(plain, r"^[+-]?[0-9]{1,18}$"), False)
    number = pc.utf8_ltrim(pc.if_else(fits, plain, None), "+").cast(pa.int64())
    return pc.if_else(pc.less(pc.abs(number), 1 << bits - 1), number, None)


def decoded_array(texts: pa.Array) -> pa.StructArray:
    known, n_texts = texts.is_valid().to_numpy(zero_copy_only=False), len(texts)
    texts = pc.fill_null(texts, "").cast(pa.string())
    at, sums, odd = running_bytes(texts)
    parts = pc.split_pattern(texts, SOH)
    ends = np.cumsum(parts.value_lengths().to_numpy()).astype(np.int64)
    kept = np.ones(int(ends[-1]) if n_texts else 0, bool)
    kept[ends - 1] = False  # what follows the last mark
    fields = parts.flatten().filter(pa.array(kept))
    starts = np.r_[0, ends - np.arange(1, n_texts + 1)]
    sizes = np.diff(starts)
    # a field's tag and value, cut at its first sign of equality
    halves = pc.split_pattern(fields, "=", max_splits=1)
    lengths = halves.value_lengths().to_numpy()
    two, begin = lengths == 2, np.cumsum(lengths) - lengths
    half = halves.flatten()
    value = half.take(pa.array(begin + 1, mask=~two))
    tag = whole_numbers(half.take(pa.array(begin, mask=~two)), 32)
    tags, number = np.r_[pc.fill_null(tag, -1).to_numpy(zero_copy_only=False), -1].astype(np.int64), np.r_[~pc.is_null(tag).to_numpy(zero_copy_only=False), False]
    counted = lambda x: np.diff(np.r_[0, np.cumsum(x)][starts])
    first, last = np.minimum(starts[:-1], len(fields)), np.maximum(starts[1:] - 1, 0)
    second = np.minimum(first + 1, len(fields))
    width = np.r_[pc.binary_length(fields).to_numpy(zero_copy_only=False), 0].astype(np.int64) + 1
    # bytes before the last field, and from behind the second one to there
    trailer = np.maximum(at[1:] - width[last if len(fields) else np.zeros(n_texts, np.int64)], at[:-1])
    body = trailer - at[:-1] - width[first] - width[second]
    ascii_ = odd[trailer] == odd[at[:-1]]
    picked = lambda places: value.take(pa.array(np.minimum(places, max(0, len(fields) - 1)), mask=sizes < 3))
    given = pc.utf8_lpad(pa.array((sums[trailer] - sums[at[:-1]]) % 256).cast(pa.string()), 3, "0")
    right = pc.fill_null(pc.equal(picked(last), given), False).to_numpy(zero_copy_only=False) & ascii_
    declared = whole_numbers(picked(second), 63)
    has_length = pc.is_valid(declared).to_numpy(zero_copy_only=False)
    rules = (
        ("no_trailing_soh", ~pc.ends_with(texts, SOH).to_numpy(zero_copy_only=False)), ("too_few_fields", sizes < 3), ("field_without_equals", counted(~two) > 0), ("tag_not_numeric", counted(~number[:-1]) > 0),
        ("begin_string_not_first", tags[first] != 8), ("body_length_not_second", tags[second] != 9), ("checksum_not_last", tags[last] != 10), ("checksum_mismatch", ~right),
        ("body_length_not_numeric", ~has_length), ("body_length_mismatch", pc.fill_null(declared, 0).to_numpy(zero_copy_only=False) != body),
    )
    failed = np.select([x for _, x in rules], range(len(rules)), -1)
    names = pa.array([name for name, _ in rules])
    error = names.take(pa.array(failed, mask=(failed < 0) | ~known))
    made = pa.StructArray.from_arrays([tag.cast(pa.int32()), value], ["tag", "value"])
    lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), made, mask=pa.array(~known))
    return pa.StructArray.from_arrays([lists, error], ["fields", "error"])


def field(fields: Column, tag: int) -> Column:
    """The value of the first field of a tag; null if there is none."""
    return F.get(F.filter(fields, lambda f: f["tag"] == tag), F.lit(0))["value"]


def require(fields: Column, tag: int) -> Column:
    """As :func:`field`; a message that lacks the tag fails the job."""
    held = field(fields, tag)
    return F.when(held.isNotNull(), held).otherwise(F.raise_error(F.lit(f"required tag {tag} is missing")).cast("string"))


def framed_text(fields: list[tuple[int, str]]) -> str:
    """A framed message of fields, the first of them its type: what :func:`encode` makes, for folds."""
    body = "".join(f"{tag}={value}{SOH}" for tag, value in fields)
    text = f"8={BEGIN}{SOH}9={len(body)}{SOH}{body}"
    return f"{text}10={sum(text.encode('ascii')) % 256:03d}{SOH}"


def time_text(seconds: float) -> str:
    """Seconds since the epoch as UTC text with milliseconds, cut off."""
    ms = int(seconds * 1000 // 1)
    return f"{datetime.fromtimestamp(ms // 1000, timezone.utc):%Y%m%d-%H:%M:%S}.{ms % 1000:03d}"


def utc_timestamp(ns: Column) -> Column:
    """Nanoseconds as UTC text with milliseconds, cut off."""
    ms = (ns - F.pmod(ns, F.lit(1_000_000))) / F.lit(1_000_000)
    return F.date_format(F.timestamp_millis(ms.cast("bigint")), "yyyyMMdd-HH:mm:ss.SSS")
