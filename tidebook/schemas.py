"""Row types of the data model: prices are integer ticks, sizes doubles, times nanoseconds since the epoch."""

from __future__ import annotations

LEVELS = "array<struct<price:bigint,size:double>>"

#: A normalised book update. ``idx`` is the place in order of arrival, which alone decides.
UPDATE = f"venue string, symbol string, idx bigint, is_snapshot boolean, seq bigint, prev_seq bigint, exchange_ts_ns bigint, recv_ts_ns bigint, bids {LEVELS}, asks {LEVELS}"

#: A top-of-book observation: null prices and sizes of 0.0 stand for an empty side; depth is null where it isn't asked for.
TOP = "venue string, symbol string, epoch bigint, idx bigint, recv_ts_ns bigint, exchange_ts_ns bigint, bid_px bigint, bid_sz double, ask_px bigint, ask_sz double, depth double"

ORDER = "cl_ord_id string, symbol string, side string, qty double, price bigint, ord_type string, tif string"

EXECUTION = "idx bigint, cl_ord_id string, exec_type string, ord_status string, order_id string, exec_id string, last_qty double, last_px bigint, cum_qty double, text string, ts_ns bigint"

COMMAND = "symbol string, idx bigint, op string, cl_ord_id string, side string, qty double, price bigint, ord_type string, tif string"
