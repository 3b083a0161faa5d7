"""Byte-level BPE encoding and decoding by a rank file.

Texts are taken in blocks of bounded size, and a block's texts are coded by its distinct words: a word that is a
token has its id, any other a number in the block. The other words of up to a thousand blocks meet by the words'
hash, where each distinct one is encoded once: Spark's higher-order functions fold the ranked merges over its
bytes with a literal map from pairs of tokens to ranks. The ids go back to the blocks by their numbers, packed,
and the texts take the ids of their words. Decoding joins the pieces of the ids.

Texts are shuffled once, in coded form. Groups are bounded: by the characters of a block, and by the blocks that
share a hash's words. A word that is in every text occurs once in each block.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import batches_of, column, materialise, release

#: Fixed value: the pattern by which the rank files' texts are split before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Bits of an id, and the rank of a pair that is no token. The fold's numbers hold a rank, a place of 8 bits and an id.
ID_BITS = 20
NONE, PLACE_AT = 1 << ID_BITS, ID_BITS


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a file with a base64 token and a rank on each line; the rank is the id."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    if max(ranks.values(), default=0) >= NONE - 1 or any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError(f"a rank file holds all single bytes, and ids below {NONE - 1:,}")
    return ranks


def edge_of(path: str) -> int:
    """The id, above all others, that stands beside a word's first and last token."""
    return max(read_ranks(path).values()) + 1


# --- splitting texts into words -------------------------------------------------------------------------------


@lru_cache(maxsize=1)
def _splitters() -> tuple[re.Pattern, re.Pattern, regex.Pattern]:
    """What tells that a text has characters from U+0250 on, the pattern for the others, and the general one.

    Both patterns are the fixed one; the first names the classes' characters below U+0250, which is faster.
    """
    low = [chr(c) for c in range(0x250)]
    inside = lambda kind: "".join(f"\\u{ord(c):04x}" for c in low if regex.match(kind, c))
    letters, numbers, spaces = inside(r"\p{L}"), inside(r"\p{N}"), inside(r"\p{White_Space}")
    plain = PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{numbers}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]")
    plain = plain.replace(r"(?!\S)", f"(?![^{spaces}])").replace(r"\s", f"[{spaces}]")
    general = PATTERN.replace(r"[^\s", r"[^\p{White_Space}").replace(r"(?!\S)", r"(?!\P{White_Space})").replace(r"\s", r"\p{White_Space}")
    return re.compile("[^\\u0000-\\u024f]"), re.compile(plain), regex.compile(general)


def split_words(text: str) -> list[str]:
    high, plain, general = _splitters()
    return general.findall(text) if high.search(text) else plain.findall(text)


# --- merging ----------------------------------------------------------------------------------------------------


@lru_cache(maxsize=4)
def _pair_map(path: str) -> str:
    """The literal map from pairs of ids to the rank of their joined bytes, as JSON.

    The pairs of a left id are a row of the table whose columns are right ids. All rows lie over each other in
    one array, each moved so far that no two entries meet: the entry of a pair is at ``moved[left] + right`` and
    holds ``left << ID_BITS | rank``, so that an entry of another row is told apart.
    """
    ranks = read_ranks(path)
    rows: dict[int, list[tuple[int, int]]] = {}
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            if token[:i] in ranks and token[i:] in ranks:
                rows.setdefault(ranks[token[:i]], []).append((ranks[token[i:]], rank))
    edge = edge_of(path)
    moved, taken = [0] * (edge + 1), np.zeros(sum(map(len, rows.values())) * 2 + 4 * edge, bool)
    entries: list[tuple[int, int]] = []
    low = at = size = 0  # below low all is taken; a row begins where the last one of its size was laid
    for left, row in sorted(rows.items(), key=lambda x: (-len(x[1]), x[0])):
        rights = np.array(sorted(r for r, _ in row))
        while taken[low]:
            low += 1
        fits, at, size = [], at if len(row) == size > 1 else low, len(row)
        while not len(fits):
            starts = at + np.flatnonzero(~taken[at : at + 1024]) - rights[0]
            fits = starts[~taken[starts[:, None] + rights].any(axis=1)]
            at += 0 if len(fits) else 1024
        moved[left] = int(fits[0])
        taken[moved[left] + rights] = True
        entries += [(moved[left] + right, left << ID_BITS | rank) for right, rank in row]
    table = [-1] * (max((x for x, _ in entries), default=0) + 1)
    for x, entry in entries:
        table[x] = entry
    return json.dumps({"moved": moved, "table": table}, separators=(",", ":"))


def merged(word: Column, path: str) -> Column:
    """The ids of a word of up to 255 bytes, a binary, by :func:`merged_bytes`."""
    code = lambda i: F.ascii(F.decode(F.substring(word, i, F.lit(1)), "ISO-8859-1"))
    return merged_bytes(F.when(F.length(word) == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(1), F.length(word)), code)), path)


def merged_bytes(word: Column, path: str) -> Column:
    """The ids of a word of up to 255 bytes, an array of numbers that may be signed: the pair of the lowest rank is merged, the leftmost of equal ones first, again and again.

    The fold's state is an array with a number for each token, rank, place and id from the high bits down: the rank of the
    token joined with the one after it, the place of its first byte, and its id. So the least number is the pair
    that comes next. Before the first token and after the last stands an edge that joins with nothing.
    """
    tables = F.from_json(F.lit(_pair_map(path)), "struct<moved:array<int>,table:array<bigint>>")
    single = read_ranks(path)
    by_byte = F.from_json(F.lit(json.dumps([single[bytes([b])] for b in range(256)])), "array<bigint>")
    id_of = lambda number: number.bitwiseAND(NONE - 1)

    def folded(table: Column) -> Column:
        def rank(left: Column, right: Column) -> Column:
            entry = F.get(table["table"], (F.get(table["moved"], left.cast("int")) + right).cast("int"))
            known = lambda e: F.when(F.shiftright(e, ID_BITS) == left, e.bitwiseAND(NONE - 1)).otherwise(F.lit(NONE).cast("bigint"))
            return named(entry, known)

        def number(rank_: Column, rest: Column) -> Column:
            return F.shiftleft(rank_, PLACE_AT + 8).bitwiseOR(rest)

        def merge(numbers: Column, least: Column, at: Column) -> Column:
            """``at``: the place in the array, from 1, of the left token."""

            def joined(new: Column) -> Column:
                before, after = F.get(numbers, at - 2), F.get(numbers, at + 1)
                left = named(before, lambda b: number(rank(id_of(b), new), b.bitwiseAND((1 << PLACE_AT + 8) - 1)))
                own = number(rank(new, id_of(after)), least.bitwiseAND(0xFF << PLACE_AT).bitwiseOR(new))
                return F.flatten(F.array(F.slice(numbers, F.lit(1), at - 2), F.array(left, own), F.slice(numbers, at + 2, F.lit(256))))

            return named(F.shiftright(least, PLACE_AT + 8), joined)

        def step(numbers: Column, _: Column) -> Column:
            merge_at = lambda least: named(F.array_position(numbers, least).cast("int"), lambda at: merge(numbers, least, at))
            return named(F.array_min(numbers), lambda least: F.when(least < NONE << PLACE_AT + 8, merge_at(least)).otherwise(numbers))

        edge = F.array(F.lit(edge_of(path)).cast("bigint"))
        ids = F.concat(edge, F.transform(word, lambda b: F.get(by_byte, b.cast("int").bitwiseAND(0xFF))), edge)
        start = named(ids, lambda x: F.transform(x, lambda id_, i: number(rank(id_, F.get(x, i + 1)), F.shiftleft(i.cast("bigint"), PLACE_AT).bitwiseOR(id_))))
        end = F.aggregate(F.slice(word, F.lit(2), F.lit(255)), start, step)  # as many steps as there are pairs
        return named(end, lambda x: F.transform(F.slice(x, F.lit(2), F.size(x) - 2), lambda n: id_of(n).cast("int")))

    return F.when(F.size(word) == 0, F.array().cast("array<int>")).otherwise(named(tables, folded))


def named(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def merged_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same ids by a heap, for words so long that a fold, quadratic in their length, would not do."""
    n = len(word)
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    rank = lambda i: ranks.get(word[i : end[after[i]]]) if after[i] < n else None
    heap = [(r, i, end[after[i]]) for i in range(n) if (r := rank(i)) is not None]
    heapq.heapify(heap)
    gone = bytearray(n)
    while heap:
        r, i, until = heapq.heappop(heap)
        if gone[i] or after[i] >= n or end[after[i]] != until or rank(i) != r:
            continue
        j = after[i]
        gone[j], end[i], after[i] = 1, end[j], after[j]
        if after[i] < n:
            before[after[i]] = i
        for k in (before[i], i):
            if k >= 0 and (x := rank(k)) is not None:
                heapq.heappush(heap, (x, k, end[after[k]]))
    return [ranks[word[i : end[i]]] for i in range(n) if not gone[i]]


# --- encoding ---------------------------------------------------------------------------------------------------

BLOCK, PART, ROW, COUNT, DATA = "_bpe_block", "_bpe_part", "_bpe_row", "_bpe_count", "_bpe_data"
LIST, BYTES = pa.list_(pa.int32()), pa.list_(pa.int8())
#: Parts that a block's words are dealt into by hash.
PARTS = 128
#: Codes that are packed together.
PACKED = 500_000


class _Codes(dict):
    """From words to codes: below ``first`` a code is an id, from there on it is the place of a word in ``new``."""

    def __init__(self, known: dict[str, int], first: int):
        super().__init__(known)
        self.first, self.new = first, []

    def __missing__(self, word: str) -> int:
        self[word] = code = self.first + len(self.new)
        self.new.append(word)
        return code


def pack(items: list[bytes]) -> bytes:
    """Byte strings as one compressed byte string."""
    lengths = np.fromiter(map(len, items), "<u4", len(items))
    return zstandard.compress(np.uint32(len(items)).tobytes() + lengths.tobytes() + b"".join(items), 3)


def unpack(data: bytes) -> list[bytes]:
    data = zstandard.decompress(data)
    n = int(np.frombuffer(data, "<u4", 1)[0])
    ends = np.cumsum(np.frombuffer(data, "<u4", n, 4), dtype=np.int64) + 4 + 4 * n
    starts = np.r_[4 + 4 * n, ends[:-1]] if n else ends
    return [data[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


def _rows(schema: pa.Schema, n: int, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


#: What a row adds to its block besides its text, so that a block of empty texts is bounded as well.
ROW_CHARS = 64


def _coded(path: str, text_column: str, kept: list[str], schema: pa.Schema, block_chars: int):
    """Texts to a row for each text, without a part, and a row for each part of a block's words.

    The codes of some texts are packed together in the row of the first of them; every row has its text's count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = read_ranks(path)
        first = max(ranks.values()) + 1
        known = {}
        for token, rank in ranks.items():
            try:
                known[token.decode()] = rank
            except UnicodeDecodeError:
                pass
        block = TaskContext.get().partitionId() << 20

        def whole(codes: _Codes, held: list[tuple[dict, list[np.ndarray]]]) -> Iterator[pa.RecordBatch]:
            words = [w.encode() for w in codes.new]
            used = [c[c >= first] - first for _, texts in held for c in texts]
            counts = np.bincount(np.concatenate([*used, np.zeros(0, np.int32)]), minlength=len(words))
            del used
            part = np.fromiter((xxhash.xxh32_intdigest(w) % PARTS for w in words), np.int64, len(words))
            # frequent words first, so that most codes are small; texts sort as their bytes do, and faster
            rank = np.empty(len(words), np.int64)
            rank[sorted(range(len(words)), key=codes.new.__getitem__)] = np.arange(len(words))
            order = np.lexsort((rank, -counts, part))
            edges = np.searchsorted(part[order], np.arange(PARTS + 1))
            place = np.empty(len(words), np.int64)
            place[order] = first + (np.arange(len(words)) - edges[part[order]]) * PARTS + part[order]
            edges = edges.tolist()
            filled = [(p, [words[i] for i in order[a:b].tolist()]) for p, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
            if filled:
                n = len(filled)
                yield _rows(schema, n, **{BLOCK: pa.array([block] * n, pa.int64()), PART: pa.array([p for p, _ in filled], pa.int32()), DATA: pa.array([pack(w) for _, w in filled], pa.binary())})
            row = 0
            for columns, texts in held:
                sizes, data, at = [len(c) for c in texts], [None] * len(texts), 0
                while at < len(texts):
                    start, size = at, 0
                    while at < len(texts) and (size < PACKED or at == start):
                        size += sizes[at]
                        at += 1
                    c = np.concatenate(texts[start:at])
                    new = c >= first
                    c[new] = place[c[new] - first]
                    # the low bytes of all codes, then the next ones: alike bytes compress better
                    data[start] = zstandard.compress(c.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 3)
                n = len(texts)
                numbers = pa.array(range(row, row + n), pa.int32())
                row += n
                yield _rows(schema, n, **columns, **{BLOCK: pa.array([block] * n, pa.int64()), ROW: numbers, COUNT: pa.array(sizes, pa.int32()), DATA: pa.array(data, pa.binary())})

        codes, held, chars = _Codes(known, first), [], 0
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_column))
            at = 0
            while at < len(batch):
                start, coded = at, []
                while at < len(batch) and (chars < block_chars or not coded):
                    text = texts[at].as_py() or ""
                    words = split_words(text)
                    coded.append(np.fromiter(map(codes.__getitem__, words), np.int32, len(words)))
                    chars += len(text) + ROW_CHARS
                    at += 1
                held.append(({c: batch.column(batch.schema.get_field_index(c)).slice(start, at - start) for c in kept}, coded))
                if chars >= block_chars:
                    yield from whole(codes, held)
                    codes, held, chars, block = _Codes(known, first), [], 0, block + 1
                    release()
        if held:
            yield from whole(codes, held)
        del codes, held
        release()

    return run


WORDS = "words array<array<tinyint>>, given array<array<int>>, block bigint, part int, numbers binary"


def _distinct(path: str, fold_bytes: int):
    """Packed words of many blocks to rows of distinct words, then a row of numbers for each block; group by group."""
    kind = pa.schema([("words", pa.list_(BYTES)), ("given", pa.list_(LIST)), ("block", pa.int64()), ("part", pa.int32()), ("numbers", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, group, numbers, members = read_ranks(path), None, {}, []

        def whole() -> Iterator[pa.RecordBatch]:
            words = list(numbers)
            for at in range(0, len(words), 1024):
                some = words[at : at + 1024]
                given = [merged_long(w, ranks) if len(w) > fold_bytes else None for w in some]
                short = [w if g is None else b"" for w, g in zip(some, given)]
                ends = np.cumsum([0, *map(len, short)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(short), np.int8)))
                yield _rows(kind, 1, words=pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), lists), given=pa.array([given], pa.list_(LIST)))
            for block, part, own in members:
                yield _rows(kind, 1, block=pa.array([block]), part=pa.array([part], pa.int32()), numbers=pa.array([own], pa.binary()))

        for batch in batches:
            for block, part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if group != (key := (block >> 26, (block & 0xFFFFF) >> 4, part)):
                    yield from whole()
                    group, numbers, members = key, {}, []
                members.append((block, part, np.array([numbers.setdefault(w, len(numbers)) for w in unpack(data.as_py())], "<u4").tobytes()))
        yield from whole()
        numbers, members = {}, []
        release()

    return run


class _Lists:
    """Lists of ids that come in parts, and the joined ids of any choice of them."""

    def __init__(self, parts: list[pa.Array]):
        lists = pa.concat_arrays(parts) if parts else pa.array([], LIST)
        self.sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.flat = lists.flatten().to_numpy(zero_copy_only=False)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def joined(self, places: np.ndarray) -> np.ndarray:
        lengths = self.sizes[places]
        begins = np.cumsum(lengths) - lengths
        shifts = (self.starts[places] - begins).astype(np.int32)  # a block's ids are fewer than 2**31
        return self.flat[np.arange(int(lengths.sum()), dtype=np.int32) + np.repeat(shifts, lengths)]


def packed_ids(path: str) -> str:
    """The numbers that hold any id of the file."""
    return "<u2" if edge_of(path) <= 1 << 16 else "<u4"


def _answered(batches: Iterator[pa.RecordBatch], id_kind: str) -> Iterator[pa.RecordBatch]:
    """Rows of merged words, then of numbers, to a packed row of ids for each block and part."""
    kind = pa.schema([(BLOCK, pa.int64()), (PART, pa.int32()), (DATA, pa.binary())])
    parts, lists = [], None
    for batch in batches:
        for i, block in enumerate(batch.column(1).to_pylist()):
            if block is None:  # words
                if lists is not None:
                    parts, lists = [], None
                parts.append(batch.column(0)[i].values)
                continue
            lists = lists or _Lists(parts)
            places = np.frombuffer(batch.column(3)[i].as_py(), "<u4").astype(np.int64)
            sizes, ids = lists.sizes[places].astype("<u4"), lists.joined(places).astype(id_kind)
            data = zstandard.compress(np.uint32(len(places)).tobytes() + sizes.tobytes() + ids.tobytes(), 3)
            yield pa.RecordBatch.from_arrays([pa.array([block]), batch.column(2).slice(i, 1), pa.array([data], pa.binary())], schema=kind)
    parts, lists = [], None
    release()


def _assembled(first: int, id_kind: str, finish: Callable[[pa.Table, pa.ListArray], pa.Table]):
    """A block's texts, as coded, and its ids, part by part, to what ``finish`` makes of the rows and their ids."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        release()  # what the group before has left
        parts, starts = [], np.zeros(PARTS, np.int64)
        for part, data in zip(answers[PART].to_pylist(), answers[DATA]):
            raw = zstandard.decompress(data.as_py())
            n = int(np.frombuffer(raw, "<u4", 1)[0])
            starts[part] = sum(map(len, parts))
            flat = np.frombuffer(raw, id_kind, -1, 4 + 4 * n).astype(np.int32)
            parts.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.frombuffer(raw, "<u4", n, 4))], pa.int32()), pa.array(flat)))
        lists = _Lists(parts)
        texts = texts.sort_by(ROW).combine_chunks()
        counts, packed = texts[COUNT].to_numpy(), texts[DATA].drop_null()
        # a row with codes begins a group of texts
        begins = [*np.flatnonzero(texts[DATA].is_valid()).tolist(), len(texts)]
        ids, ends = [], [np.zeros(1, np.int64)]
        for data, a, b in zip(packed, begins, begins[1:]):
            raw = np.frombuffer(zstandard.decompress(data.as_py()), np.uint8)
            codes = np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
            new = codes >= first
            number = codes[new] - first
            places = starts[number % PARTS] + number // PARTS
            lengths = np.ones(len(codes), np.int64)
            lengths[new] = lists.sizes[places]
            is_new = np.repeat(new, lengths)
            out = np.empty(len(is_new), np.int32)
            out[is_new] = lists.joined(places)
            out[~is_new] = codes[~new]
            ids.append(out)
            upto = np.r_[0, np.cumsum(lengths)]
            ends.append(ends[-1][-1] + upto[np.cumsum(counts[a:b])])
        flat = np.concatenate([*ids, np.zeros(0, np.int32)])
        return finish(texts, pa.ListArray.from_arrays(pa.array(np.concatenate(ends), pa.int32()), pa.array(flat, pa.int32())))

    return run


def _encoded(docs: DataFrame, path: str, text_column: str, kept: list[str], finish: Callable[[list[pa.ChunkedArray], pa.ListArray], pa.Table], result: T.StructType, block_chars: int, fold_bytes: int) -> DataFrame:
    """``finish`` makes the result of the columns ``kept``, in their order, and the lists of ids."""
    names = [f"_kept_{i}" for i in range(len(kept))]  # the table's own names may be any
    fields = [T.StructField(n, docs.schema[c].dataType, True) for n, c in zip(names, kept)]
    own = [T.StructField(BLOCK, T.LongType()), T.StructField(PART, T.IntegerType()), T.StructField(ROW, T.IntegerType()), T.StructField(COUNT, T.IntegerType()), T.StructField(DATA, T.BinaryType())]
    kind = T.StructType([*fields, *own])
    source = docs.select(*(column(c).alias(n) for n, c in zip(names, kept)), column(text_column).cast("string").alias("_text"))
    # filed by block, so the texts needn't be shuffled again to meet their ids
    with batches_of(docs.sparkSession, 1000):
        coded = materialise(source.mapInArrow(_coded(path, "_text", names, to_arrow_schema(kind), block_chars), kind), "bpe-coded", bucket=BLOCK)

    # up to 64 partitions of 16 blocks share the words of a part
    group = [F.shiftright(BLOCK, 26).alias("_g"), F.shiftright(F.col(BLOCK).bitwiseAND(0xFFFFF), 4).alias("_h")]
    words = coded.where(F.col(PART).isNotNull()).select(BLOCK, PART, DATA, *group).repartition("_g", "_h", PART).sortWithinPartitions("_g", "_h", PART, BLOCK)
    distinct = words.select(BLOCK, PART, DATA).mapInArrow(_distinct(path, fold_bytes), WORDS)
    ids = F.zip_with("words", "given", lambda w, g: F.when(g.isNull(), merged_bytes(w, path)).otherwise(g))
    folded = distinct.select(F.when(F.col("block").isNull(), ids).alias("ids"), "block", "part", "numbers")
    id_kind = packed_ids(path)
    answered = folded.mapInArrow(lambda batches: _answered(batches, id_kind), f"{BLOCK} bigint, {PART} int, {DATA} binary")

    texts = coded.where(F.col(PART).isNull()).drop(PART)
    return texts.groupBy(BLOCK).cogroup(answered.groupBy(BLOCK)).applyInArrow(_assembled(edge_of(path), id_kind, lambda texts, ids: finish([texts[n] for n in names], ids)), result)


def encode(docs: DataFrame, path: str, text_column: str = "text", out: str = "token_ids", block_chars: int = 6_000_000, fold_bytes: int = 64) -> DataFrame:
    """``docs`` without the text, with ``out``, the text's ids as array<int>.

    One row for each row, with all other columns as they are (a column of the name ``out`` gives way). Null and
    empty texts have no ids. Texts are whole; no special token is known. ``block_chars`` bounds the texts that a
    task holds at once (one text at least), ``fold_bytes`` (at most 250) the words that are folded in Spark;
    longer words are merged by a heap, with equal results. Rank files may have up to a million ids.
    """
    kept = [c for c in docs.columns if c not in (text_column, out)]
    result = T.StructType([*(T.StructField(c, docs.schema[c].dataType, True) for c in kept), T.StructField(out, T.ArrayType(T.IntegerType()))])
    arrow = to_arrow_schema(result)

    def finish(columns: list[pa.ChunkedArray], ids: pa.ListArray) -> pa.Table:
        return pa.Table.from_arrays([*columns, ids], schema=arrow)

    return _encoded(docs, path, text_column, kept, finish, result, block_chars, fold_bytes)


def decode_lists(lists: pa.ListArray, path: str) -> Iterator[memoryview]:
    """The joined pieces of each list's ids (of a null list nothing)."""
    ranks = read_ranks(path)
    pieces = [None] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token
    ids = lists.flatten()
    joined = pa.array(pieces, pa.large_binary()).take(ids)  # the pieces lie one after the other in one buffer
    if joined.null_count:
        raise ValueError("an id has no piece")
    _, offsets, data = joined.buffers()
    at = np.frombuffer(offsets, np.int64, len(ids) + 1, joined.offset * 8) if len(ids) else np.zeros(1, np.int64)
    view, end = memoryview(data or b""), 0
    for size in lists.value_lengths().fill_null(0).to_pylist():
        end += size
        yield view[at[end - size] : at[end]]


def decode(ids: Column, path: str) -> Column:
    """The joined bytes of ids; null of null. An id that the rank file lacks raises an error."""

    @F.arrow_udf("binary")
    def joined(lists: pa.Array) -> pa.Array:
        return pa.array((bytes(text) if known else None for text, known in zip(decode_lists(lists, path), lists.is_valid().to_pylist())), pa.binary())

    return joined(ids)


def round_trip(docs: DataFrame, path: str, block_chars: int = 6_000_000, fold_bytes: int = 64) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers) and decoded_sha256 (of
    the bytes that the ids decode to), both lower-case hex, for each row of ``docs``.

    Texts are encoded as by :func:`encode`; the digests are made where the ids are. Null and empty texts have 0
    tokens and the digests of nothing; repeated rows and null ids stay. Other columns are neither read nor
    returned.
    """
    result = T.StructType([docs.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def finish(columns: list[pa.ChunkedArray], ids: pa.ListArray) -> pa.Table:
        flat, ends = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4", copy=False), ids.offsets.to_numpy()
        packed = [hashlib.sha256(flat[a:b]).hexdigest() for a, b in zip(ends, ends[1:])]
        decoded = []
        for at in range(0, len(ids), 512):  # so that little decoded text is held at once
            decoded += [hashlib.sha256(text).hexdigest() for text in decode_lists(ids.slice(at, 512), path)]
        return pa.table({"doc_id": columns[0], "n_tokens": ids.value_lengths().cast(pa.int64()), "ids_sha256": pa.array(packed, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())})

    return _encoded(docs.select("doc_id", "text"), path, "text", ["doc_id"], finish, result, block_chars, fold_bytes)
