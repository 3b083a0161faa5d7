"""Benchmark decontamination with a generalised suffix automaton.

The automaton holds every run of words of every benchmark item. A text's words stream through it; at each word
it knows the longest run ending there that occurs in some item. Where that is at least a window long, the
window's words are hit and the state's items are those that hold the window. An item shorter than a window is
a window by itself.

A run can only match where each pair of neighbouring words is also a pair in some item, so only such stretches
are streamed; this changes no result.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES, free_name, materialise, only, texts_of


def words_of(text: str | None) -> list[bytes]:
    """``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased, as UTF-8; null has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


class _Builder:
    """States and transitions while the automaton grows: numbers in arrays, and one map for all transitions."""

    def __init__(self) -> None:
        self.link, self.length = array("i", [-1]), array("i", [0])
        self.to: dict[int, int] = {}  # state << 32 | word: the next state
        # the transitions of a state are a chain, for copies of it
        self.head, self.word, self.after = array("i", [-1]), array("i"), array("i")

    def add(self, state: int, c: int, target: int) -> None:
        self.to[state << 32 | c] = target
        self.word.append(c)
        self.after.append(self.head[state])
        self.head[state] = len(self.word) - 1

    def state(self, length: int, link: int) -> int:
        self.link.append(link)
        self.length.append(length)
        self.head.append(-1)
        return len(self.link) - 1

    def copied(self, p: int, c: int, q: int) -> int:
        """A copy of q for the runs that also occur elsewhere; the way there from p and its suffixes leads to it."""
        copy, t = self.state(self.length[p] + 1, self.link[q]), self.head[q]
        while t >= 0:
            self.add(copy, self.word[t], self.to[q << 32 | self.word[t]])
            t = self.after[t]
        self.link[q] = copy
        while p >= 0 and self.to.get(p << 32 | c) == q:
            self.to[p << 32 | c] = copy
            p = self.link[p]
        return copy

    def extended(self, last: int, c: int) -> int:
        q = self.to.get(last << 32 | c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self.copied(last, c, q)
        new, p = self.state(self.length[last] + 1, 0), last
        while p >= 0 and p << 32 | c not in self.to:
            self.add(p, c, new)
            p = self.link[p]
        if p >= 0:
            q = self.to[p << 32 | c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self.copied(p, c, q)
        return new


class Automaton:
    """A generalised suffix automaton over word numbers, with the items of each state, in flat arrays."""

    def __init__(self, window: int, items: list[tuple[str, list[bytes]]]):
        self.window, self.vocabulary = window, {}
        coded = [(i, array("i", [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words])) for i, words in items if words]
        grown = _Builder()
        for _, codes in coded:
            last = 0
            for c in codes:
                last = grown.extended(last, c)
        self.link, self.length, names = grown.link, grown.length, [i for i, _ in coded]
        held_state, held_item, stamp = array("i"), array("i"), array("i", [-1]) * len(self.link)
        self.short: dict[int, list[tuple[int, str]]] = defaultdict(list)
        for n, (item, codes) in enumerate(coded):
            at = 0
            for c in codes:
                at = grown.to[at << 32 | c]
                u = self.window_state(at)
                if u and stamp[u] != n:
                    stamp[u] = n
                    held_state.append(u)
                    held_item.append(n)
            if len(codes) < window:
                self.short[at].append((len(codes), item))
        self.single = any(n == 1 for x in self.short.values() for n, _ in x)
        self.least = min([window, *(n for x in self.short.values() for n, _ in x)])
        size = len(self.vocabulary)
        pairs = [np.frombuffer(codes, np.int32).astype(np.int64) for _, codes in coded]
        self.pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *(p[:-1] * size + p[1:] for p in pairs)]))
        # transitions, sorted by state and word
        keys = np.fromiter(grown.to.keys(), np.int64, len(grown.to))
        targets = np.fromiter(grown.to.values(), np.int32, len(grown.to))
        del grown
        order = np.argsort(keys)
        self.keys, self.targets = array("q", keys[order].tobytes()), array("i", targets[order].tobytes())
        # of each window's state the numbers of its items, one behind the other
        state = np.frombuffer(held_state, np.int32)
        order = np.argsort(state, kind="stable")
        self.held, self.items = array("i", state[order].tobytes()), array("i", np.frombuffer(held_item, np.int32)[order].tobytes())
        self.names = names

    def window_state(self, u: int) -> int:
        """The state of a run's last ``window`` words, given a state of a run at least as long; 0 if there is none."""
        if self.length[u] < self.window:
            return 0
        while self.length[self.link[u]] >= self.window:
            u = self.link[u]
        return u

    def next(self, state: int, c: int) -> int:
        """The state after one more word; -1 if there is none."""
        key = state << 32 | c
        i = bisect_left(self.keys, key)
        return self.targets[i] if i < len(self.keys) and self.keys[i] == key else -1

    def items_of(self, state: int) -> set[str]:
        a, b = bisect_left(self.held, state), bisect_right(self.held, state)
        return {self.names[i] for i in self.items[a:b]}

    @property
    def n_bytes(self) -> int:
        """About what it takes in memory."""
        flat = sum(x.itemsize * len(x) for x in (self.link, self.length, self.keys, self.targets, self.held, self.items)) + self.pairs.nbytes
        return flat + sum(160 + len(w) for w in self.vocabulary)

    def stretches(self, words: list[bytes]) -> list[tuple[int, int, np.ndarray]]:
        """(start, end, word numbers) of the stretches that can hold a window."""
        get = self.vocabulary.get
        codes = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        known = codes >= 0
        if not known.any():
            return []
        if self.single:
            inside = np.flatnonzero(np.diff(np.concatenate([[0], known.view(np.int8), [0]])))
            return [(a, b, codes[a:b]) for a, b in zip(inside[::2], inside[1::2])]
        pair = codes[:-1] * len(self.vocabulary) + codes[1:]
        ok = known[:-1] & known[1:]
        if len(self.pairs):
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            ok &= self.pairs[at] == pair
        else:
            ok[:] = False
        edge = np.flatnonzero(np.diff(np.concatenate([[0], ok.view(np.int8), [0]])))
        return [(a, b + 1, codes[a : b + 1]) for a, b in zip(edge[::2], edge[1::2]) if b + 1 - a >= self.least]

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """The maximal stretches of hit words as (start, end), and the items with a window in the text."""
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        for start, _, codes in self.stretches(words):
            state = held = 0
            for i, c in enumerate(codes.tolist(), start):
                following = self.next(state, c)
                while state and following < 0:
                    state = self.link[state]
                    held = self.length[state]
                    following = self.next(state, c)
                if following >= 0:
                    state = following
                    held += 1
                reach = 0
                if held >= self.window:
                    found |= self.items_of(self.window_state(state))
                    reach = self.window
                if self.short:
                    u = state
                    while u > 0:
                        for n, item in self.short.get(u, ()):
                            if n <= held:
                                found.add(item)
                                reach = max(reach, n)
                        u = self.link[u]
                if reach:
                    a = i + 1 - reach
                    while spans and spans[-1][1] >= a:
                        a = min(a, spans.pop()[0])
                    spans.append((a, i + 1))
        return spans, found


HITS = "struct<n_words:bigint,starts:array<int>,ends:array<int>,items:array<string>>"


def hits(text: Column, automaton: Broadcast) -> Column:
    """n_words, and the starts, ends (in words) and items of the hit stretches. A worker loads the automaton once."""

    @F.arrow_udf(HITS)
    def matched(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts_of(texts):
            words = words_of(t)
            spans, found = automaton.value.match(words)
            rows.append({"n_words": len(words), "starts": [int(a) for a, _ in spans], "ends": [int(b) for _, b in spans], "items": sorted(found)})
        kind = pa.struct([("n_words", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])
        return pa.array(rows, kind)

    # a filter on the hits must not match every text a second time
    return matched.asNondeterministic()(text)


#: Words of a block's items: an automaton of random words of this number takes less than 200 MB, and less than
#: 500 MB while it is built (``tests/llm``).
BLOCK_WORDS = 800_000


def automata(benchmark: DataFrame, window: int = 10, block_words: int = BLOCK_WORDS) -> Iterator[Automaton]:
    """Automata over the items, each of at most ``block_words`` words (or one item).

    Items come to the driver one partition at a time, so at most a partition and a block are held there.
    """
    block, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("i"), "text").toLocalIterator():
        words = words_of(row["text"])
        if block and size + len(words) > block_words:
            yield Automaton(window, block)
            block, size = [], 0
        if words and row["i"] is not None:
            block.append((row["i"], words))
            size += len(words)
    yield Automaton(window, block)


def with_hits(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", window: int = 10, block_words: int = BLOCK_WORDS, out: str = "hit") -> DataFrame:
    """``docs`` with a struct column of n_words, starts, ends and items (see :func:`hits`).

    A benchmark of up to ``block_words`` words is one automaton, broadcast to the executors. A larger one is taken
    in blocks of that size: all texts are matched with each block in turn, the hits are written to the shared
    folder by digest of the text, united, and joined back. Null texts have no words; repeated rows stay.
    """
    text = F.col(text_column)
    parts = map(docs.sparkSession.sparkContext.broadcast, automata(benchmark, window, block_words))
    first = next(parts)
    second = next(parts, None)
    if second is None:
        return docs.withColumn(out, hits(text, first))
    digest = F.sha2(F.coalesce(text, F.lit("")), 256)
    written = None
    for automaton in (x for group in ([first, second], parts) for x in group):
        some = docs.select(digest.alias("digest"), hits(text, automaton).alias("h")).where(F.size("h.starts") > 0)
        some = materialise(some, "decontamination")
        written = some if written is None else written.unionByName(some)
    # one row for each digest and block; copies of a text have equal hits
    one = written.groupBy("digest", F.col("h.starts").alias("starts"), F.col("h.ends").alias("ends"), F.col("h.items").alias("items")).agg(F.lit(1))
    flat = one.groupBy("digest").agg(
        F.flatten(F.collect_list(F.arrays_zip("starts", "ends"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    union = F.aggregate(
        F.array_sort("spans"),
        F.array().cast("array<struct<starts:int,ends:int>>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["ends"] >= s["starts"]),
            F.concat(
                F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
                F.array(F.struct(F.try_element_at(acc, F.lit(-1))["starts"].alias("starts"), F.greatest(F.try_element_at(acc, F.lit(-1))["ends"], s["ends"]).alias("ends"))),
            ),
        ).otherwise(F.concat(acc, F.array(s))),
    )
    key, other, spans, items = own = [free_name([*docs.columns, out], f"{out}_{n}_") for n in ("key", "digest", "spans", "items")]
    united = flat.select(F.col("digest").alias(other), union.alias(spans), F.col("items").alias(items))
    joined = docs.withColumn(key, digest).join(united, F.col(key) == F.col(other), "left")
    words = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), lambda w: w != "")).cast("bigint")
    empty = F.array().cast("array<int>")
    return joined.withColumn(
        out,
        F.struct(
            words.alias("n_words"), F.coalesce(F.col(f"{spans}.starts"), empty).alias("starts"),
            F.coalesce(F.col(f"{spans}.ends"), empty).alias("ends"), F.coalesce(F.col(items), F.array().cast("array<string>")).alias("items"),
        ),
    ).drop(*own)


def report(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for each row of ``docs``.

    A null or empty text has no words and no hits, and so has a text without words. Items without words, or
    with a null id, have no windows. Items of equal text all count; repeated rows and null ids of ``docs``
    stay. Other columns are neither read nor returned.
    """
    found = with_hits(docs.select("doc_id", "text"), benchmark, "text", window, block_words)
    n_hit = F.aggregate(F.zip_with("hit.ends", "hit.starts", lambda b, a: b - a), F.lit(0).cast("bigint"), lambda x, y: x + y)
    return found.select(
        "doc_id",
        F.col("hit.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("hit.items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("hit.items")), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


_WORD = re.compile(rb"[^ ]+")


def cut(text: str, starts: list[int], ends: list[int], least: int) -> str:
    """The text without the stretches of at least ``least`` words."""
    data = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in _WORD.finditer(data.translate(WORD_BYTES))]
    out, at = [], 0
    for a, b in zip(starts, ends):
        if b - a >= least:
            out.append(data[at : places[a][0]])
            at = places[b - 1][1]
    return b"".join([*out, data[at:]]).decode("utf-8", "surrogatepass")


def remove_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = 10, least_span: int = 1, most_coverage: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with the same columns, without the benchmark's passages.

    A document of whose words more than ``most_coverage`` are hit goes. From the others every hit stretch of
    at least ``least_span`` words is cut out of the text, and ``n_chars``, if there is such a column, is set
    anew. All other rows stay as they are: null and empty texts have no words and so no hits, and repeated rows
    and null ids stay. An empty benchmark, or an empty table, changes nothing.
    """
    columns, held = docs.columns, free_name(docs.columns, "_decontamination_hit")
    found = with_hits(docs, benchmark, "text", window, block_words, held)
    n_hit = F.aggregate(F.zip_with(f"{held}.ends", f"{held}.starts", lambda b, a: b - a), F.lit(0), lambda x, y: x + y)

    @F.arrow_udf("string")
    def cleaned(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([t.as_py() if not s["starts"].values else cut(t.as_py(), s["starts"].as_py(), s["ends"].as_py(), least_span) for t, s in zip(texts, spans)], pa.string())

    left = found.where(n_hit <= most_coverage * F.greatest(F.col(f"{held}.n_words"), F.lit(1))).withColumn("text", cleaned(F.col("text"), F.col(held)))
    if "n_chars" in columns:
        left = left.withColumn("n_chars", F.when(F.size(f"{held}.starts") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return only(left, columns)

