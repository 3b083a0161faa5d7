"""FIX sessions: cutting streams into messages, what a session answers, gaps and resends.

A session's answer follows from two tables: where a message's number stands against the expected one, and, for the
expected one, what its type asks for. Numbers begin anew at a logon, so each logon begins a session that is folded
by itself, and a connection's sessions run in parallel.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixmsg import ADMIN_TYPES, BEGIN, SOH, framed_text, time_text
from .ordered import Running, running, sliced
from .rows import framed

# --- streams --------------------------------------------------------------------------------------------------------

HEAD = re.compile(rf"8={re.escape(BEGIN)}{SOH}9=([0-9]{{1,9}}){SOH}")


def split_stream(text: str) -> tuple[list[str], str]:
    """The whole messages of what has been read, and what is left behind the last of them.

    A head declares where its body ends, and the message ends with the field that follows; values may look like
    heads or ends. What stands before a head, or has no number as its length, belongs to no message.
    """
    messages, done = [], 0
    while head := HEAD.search(text, done):
        body_end = head.end() + int(head[1])
        end = text.find(SOH, body_end) + 1 if body_end < len(text) else 0
        if not end:
            break
        messages.append(text[head.start() : end])
        done = end
    return messages, text[done:]


SPLIT = "conn string, idx bigint, n bigint, message string, remainder string"


def split_streams(reads: DataFrame) -> DataFrame:
    """The messages of each connection's reads (conn, idx, raw): conn, idx of the read that ended it, n, message.

    A row with a null message has the remainder after a connection's last read. A null read is empty. A task
    holds no more of a connection than its unfinished message.
    """

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conn = last = None
        left = ""
        for frame in frames:
            out = []
            for key, idx, raw in zip(frame["conn"], frame["idx"], frame["raw"]):
                if key != conn:
                    if last is not None:
                        out.append((conn, last, -1, None, left))
                    conn, left = key, ""
                messages, left = split_stream(left + (raw or ""))
                out.extend((conn, idx, n, m, None) for n, m in enumerate(messages))
                last = idx
            yield framed(out, SPLIT)
        if last is not None:
            yield framed([(conn, last, -1, None, left)], SPLIT)

    return reads.select("conn", "idx", "raw").repartition("conn").sortWithinPartitions("conn", "idx").mapInPandas(fold, SPLIT)


# --- what a session answers ---------------------------------------------------------------------------------------


class Out(NamedTuple):
    """A message that goes out; body holds tags and values, ``at`` its seconds."""

    kind: str
    number: int
    body: dict[int, str]
    at: float


@dataclass(frozen=True)
class Rules:
    """Silence, in heartbeats, after which the other side is tested and after which the session ends.

    Without ``reset`` numbers, and the log of what may be asked for again, go on across logons.
    """

    heartbeat: float = 30.0
    test_after: float = 1.2
    end_after: float = 2.4
    sender: str = "TIDE"
    target: str = "VENUE"
    reset: bool = True


@dataclass
class Session:
    """A session from its logon on. ``log`` holds the application messages that may be asked for again."""

    rules: Rules = Rules()
    status: str = "DISCONNECTED"
    expected: int = 1
    number: int = 1
    heartbeat: float = 0.0
    wrote_at: float = 0.0
    heard_at: float = 0.0
    test: str | None = None
    log: dict[int, Out] = field(default_factory=dict)

    def write(self, kind: str, at: float, body: dict[int, str] | None = None) -> Out:
        out = Out(kind, self.number, dict(body or {}), at)
        if kind not in ADMIN_TYPES:
            self.log[out.number] = out
        self.number, self.wrote_at = self.number + 1, at
        return out

    def begin(self, at: float) -> list[Out]:
        """Numbers begin at 1, and nothing of an earlier session is known any more; or else numbers and log go on."""
        carried = {} if self.rules.reset else {"expected": self.expected, "number": self.number, "log": self.log}
        self.__init__(self.rules, **carried)
        self.status, self.heartbeat, self.heard_at = "LOGON_SENT", self.rules.heartbeat, at
        return [self.write("A", at, {98: "0", 108: str(int(self.heartbeat))})]

    def end(self, at: float, reason: str = "") -> list[Out]:
        self.status = "LOGOUT_SENT"
        return [self.write("5", at, {58: reason} if reason else None)]

    def wake(self, at: float) -> list[Out]:
        """What the clock alone calls for."""
        if self.status not in ("ACTIVE", "LOGON_SENT"):
            return []
        out, beats = [], (at - self.heard_at) / self.heartbeat if self.heartbeat else 0.0
        if at - self.wrote_at >= self.heartbeat:
            out.append(self.write("0", at))
        if beats >= self.rules.end_after:
            out += self.end(at, "no inbound traffic")
            self.status = "DISCONNECTED"
        elif beats >= self.rules.test_after and self.test is None:
            self.test = f"TR{self.number}"
            out.append(self.write("1", at, {112: self.test}))
        return out

    def due(self) -> float | None:
        """When the clock next calls for something if nothing else happens; None where it never does."""
        if self.status not in ("ACTIVE", "LOGON_SENT") or self.heartbeat <= 0:
            return None
        silence = self.rules.test_after if self.test is None else self.rules.end_after
        return min(self.wrote_at + self.heartbeat, self.heard_at + silence * self.heartbeat)

    def hear(self, kind: str, number: int | None, body: dict[int, str], at: float) -> tuple[list[Out], bool]:
        """What goes out in answer to a message, and whether it is for the application."""
        self.heard_at = at
        if kind == "4":  # a reset says which number comes next, whatever its own
            return self.moved(number, whole(body.get(36)), at), False
        place = standing(number, self.expected, body.get(43) == "Y")
        if place != "next":
            return OUT_OF_TURN[place](self, at), False
        self.expected += 1
        if kind in IN_TURN:
            return IN_TURN[kind](self, body, at), False
        if self.status == "LOGON_SENT":
            self.status = "ACTIVE"
        return [], True

    def moved(self, number: int | None, to: int | None, at: float) -> list[Out]:
        if to is not None and to >= self.expected:
            self.expected = to
            return []
        why = "missing NewSeqNo" if to is None else "NewSeqNo below expected"
        return [self.write("3", at, ({} if number is None else {45: str(number)}) | {58: why})]

    def again(self, first: int, last: int, at: float) -> list[Out]:
        """Numbers ``first`` to ``last`` (0: all) again, using up no number: the application's messages, marked as
        possible copies with the time they first went out, and one gap fill for what lies between two of them."""
        newest = self.number - 1
        last = newest if last == 0 else min(last, newest)
        islands = [n for n in sorted(self.log) if first <= n <= last]
        out, edges = [], [first - 1, *islands, last + 1]
        for before, n in zip(edges, edges[1:]):
            if n - before > 1:
                out.append(Out("4", before + 1, {43: "Y", 123: "Y", 36: str(n)}, at))
            if n in self.log and n <= last:
                kept = self.log[n]
                out.append(Out(kept.kind, n, kept.body | {43: "Y", 122: time_text(kept.at)}, at))
        self.wrote_at = at if out else self.wrote_at
        return out

    def raw(self, out: Out) -> str:
        """The message as it goes out: length and checksum are those of this text, also of one that goes out again."""
        head = [(35, out.kind), (49, self.rules.sender), (56, self.rules.target), (34, str(out.number)), (52, time_text(out.at))]
        return framed_text([*head, *sorted(out.body.items(), key=lambda x: (x[0] not in (43, 122), x[0]))])


def standing(number: int | None, expected: int, copy: bool) -> str:
    """Where a number stands: absent, next, early, late, or a copy that says nothing new."""
    if number is None:
        return "absent"
    return "next" if number == expected else "copy" if copy else "early" if number > expected else "late"


#: What a message out of turn is answered with.
OUT_OF_TURN: dict[str, Callable[[Session, float], list[Out]]] = {
    "absent": lambda s, at: [s.write("3", at, {58: "missing MsgSeqNum"})],
    "copy": lambda s, at: [],
    "early": lambda s, at: [s.write("2", at, {7: str(s.expected), 16: "0"})],
    "late": lambda s, at: s.end(at, f"MsgSeqNum too low, expecting {s.expected}"),
}


def _logged_on(s: Session, body: dict[int, str], at: float) -> list[Out]:
    s.status, s.heartbeat = "ACTIVE", float(whole(body.get(108)) or s.heartbeat)
    return []


def _heartbeat(s: Session, body: dict[int, str], at: float) -> list[Out]:
    s.test = None if s.test == body.get(112) else s.test
    return []


def _logged_out(s: Session, body: dict[int, str], at: float) -> list[Out]:
    answer = [] if s.status == "LOGOUT_SENT" else [s.write("5", at, {58: "logout ack"})]
    s.status = "DISCONNECTED"
    return answer


#: What a session message in turn is answered with; all other types are the application's.
IN_TURN: dict[str, Callable[[Session, dict[int, str], float], list[Out]]] = {
    "A": _logged_on,
    "0": _heartbeat,
    "1": lambda s, body, at: [s.write("0", at, {112: body.get(112, "")})],
    "2": lambda s, body, at: s.again(whole(body.get(7)) or 1, whole(body.get(16)) or 0, at),
    "5": _logged_out,
}


def whole(text: str | None) -> int | None:
    return int(text) if text is not None and re.fullmatch(r"\s*[+-]?[0-9]+\s*", text) else None


#: What an event of a session's log does.
EVENTS: dict[str, Callable[[Session, object], tuple[list[Out], bool]]] = {
    "logon": lambda s, r: (s.begin(r.t_s), False),
    "logout": lambda s, r: (s.end(r.t_s), False),
    "poll": lambda s, r: (s.wake(r.t_s), False),
    "send": lambda s, r: ([s.write(r.msg_type, r.t_s, _body(r))], False),
    "message": lambda s, r: s.hear(r.msg_type, None if pd.isna(r.seq) else int(r.seq), _body(r), r.t_s),
}


def _body(r) -> dict[int, str]:
    return {} if r.body is None else dict(r.body)


SESSION = "conn string, idx bigint, n bigint, state string, in_seq bigint, out_seq bigint, deliver boolean, out_type string, out_msg_seq bigint, out_body map<int,string>, out_raw string"


def session_rows(session: Session, r) -> list[tuple]:
    """The rows of one event: one for each message that goes out, or one with a null out_type where none does."""
    out, deliver = EVENTS[r.op](session, r)
    return shown(session, r.conn, r.idx, out, deliver) or [(r.conn, r.idx, 0, session.status, session.expected, session.number, deliver, None, None, None, None)]


def shown(session: Session, conn: str, idx: int | None, out: list[Out], deliver: bool = False) -> list[tuple]:
    state = (session.status, session.expected, session.number, deliver)
    return [(conn, idx, n, *state, o.kind, o.number, o.body, session.raw(o)) for n, o in enumerate(out)]


def run_sessions(events: DataFrame, rules: Rules = Rules(), width: int = 1_000_000) -> DataFrame:
    """Sessions driven by events (conn, idx, op, t_s, msg_type, seq, body), op being logon, logout, poll, send or
    message, in order of idx for each conn.

    Sessions of a connection are told apart by a running count of its logons over slices of the order, and each
    is folded by itself. Events before the first logon meet a session that isn't connected. Where numbers go on
    across logons (``rules.reset`` is false) a session rests on all before it, so a connection is one fold.
    """

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, session = None, None
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                if (r.conn, r.session) != key:
                    key, session = (r.conn, r.session), Session(rules)
                rows.extend(session_rows(session, r))
            yield framed(rows, SESSION)

    if not rules.reset:
        return events.withColumn("session", F.lit(0)).repartition("conn").sortWithinPartitions("conn", "idx").mapInPandas(fold, SESSION)
    counted = running(sliced(events, "idx", width), ["conn"], "idx", {"session": Running("sum", (F.col("op") == "logon").cast("bigint"))}).drop("_slice")
    return counted.repartition("conn", "session").sortWithinPartitions("conn", "session", "idx").mapInPandas(fold, SESSION)


# --- gaps and resends of a log ------------------------------------------------------------------------------------


def sequence_gaps(messages: DataFrame, conn: str = "conn", order: str = "idx", seq: str = "seq", width: int = 1_000_000) -> DataFrame:
    """The rows before which sequence numbers are missing: expected and missing (how many)."""
    rows = running(sliced(messages, order, width), [conn], order, {"_last": Running("lag", F.col(seq))})
    rows = rows.withColumn("expected", F.col("_last") + 1).drop("_last", "_slice")
    return rows.where(F.col(seq) > F.col("expected")).withColumn("missing", F.col(seq) - F.col("expected"))


def resend_plan(sent: DataFrame, conn: str = "conn", seq: str = "seq", kind: str = "msg_type", width: int = 1_000_000) -> DataFrame:
    """How a log of sent messages is sent again: each application message by itself, each run of others as one
    gap fill. conn, begin_seq, new_seq (the number after it) and action (resend or gap_fill)."""
    admin = F.col(kind).isin(*ADMIN_TYPES)
    rows = running(sliced(sent, seq, width), [conn], seq, {"_run": Running("sum", (~admin).cast("bigint"))}).withColumn("_admin", admin)
    rows = rows.withColumn("_group", F.when(F.col("_admin"), F.struct(F.lit(0).alias("a"), F.col("_run").alias("b"))).otherwise(F.struct(F.lit(1).alias("a"), F.col(seq).alias("b"))))
    out = rows.groupBy(conn, "_group").agg(F.min(seq).alias("begin_seq"), (F.max(seq) + 1).alias("new_seq"), F.first("_admin").alias("_admin"))
    return out.select(conn, "begin_seq", "new_seq", F.when(F.col("_admin"), "gap_fill").otherwise("resend").alias("action"))
