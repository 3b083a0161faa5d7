"""Near-duplicates by SimHash, searched through a hierarchical index in Gray order.

Two fingerprints that differ in at most ``r`` bits agree in at least ``k`` of ``r + k`` blocks of bits, so each
distinct fingerprint is filed under its bits of every ``k`` blocks. How many blocks a file's name takes, and how
many bits of each, follows from the number of fingerprints, so that a file holds a few thousand at any size. A
distributed sort by file and Gray rank puts a file's fingerprints, alike ones beside each other, into runs. A run
is indexed: groups of neighbours share a node that holds the bits all of them agree in (a mask and a pattern),
groups of nodes share upper nodes, and a node keeps only what its parent doesn't hold. A search begins at the first
level whose nodes can exceed ``r``, adds up differences on the way down and drops a whole group once they do. A file of more than one run is searched run against
run, where the runs' own top nodes first rule out pairs of runs.

Only a spanning forest of a run's links leaves it. Copies are one fingerprint, so no group of copies is large
here, and nothing but counts reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialise, only, texts_of
from .components import components

#: A-Z lower-cased, all else as it is.
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

U64 = np.uint64


def shingle_hashes(text: str, words: int, seed: int) -> np.ndarray:
    """XXH64 of each run of so many words, joined by single spaces; of all words if there are fewer."""
    found = text.encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split()
    if not found:
        return np.zeros(0, U64)
    line, digest = b" ".join(found), xxhash.xxh64_intdigest
    n = max(1, len(found) - words + 1)
    starts, at = [], 0
    for w in found:
        starts.append(at)
        at += len(w) + 1
    ends = [s - 1 for s in starts[words:]] + [len(line)] if len(found) >= words else [len(line)]
    return np.fromiter((digest(line[a:b], seed) for a, b in zip(starts, ends)), U64, n)


def fingerprint_of(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; 0 of none. As a signed number of 64 bits."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    over = bits.sum(0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(over, bitorder="little").view("<i8")[0])


def fingerprint(text: Column, words: int = 4, seed: int = 42) -> Column:
    """The SimHash of a text as a bigint; 0 for null, empty and blank texts."""

    @F.arrow_udf("bigint")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array((fingerprint_of(shingle_hashes(t, words, seed)) for t in texts_of(texts)), pa.int64())

    return of(text)


def hexed(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# --- the index over a run -----------------------------------------------------------------------------------------


class GrayIndex:
    """A hierarchical index over codes in Gray order.

    ``levels``, from the top down, hold for each node the bits that its codes agree in and its parent doesn't
    hold, and the pattern of these bits. The last level is the codes themselves.
    """

    def __init__(self, codes: np.ndarray, fan: int = 4):
        self.seen = self.ruled_out = 0
        self.fan, masks, values = fan, [np.full(len(codes), ~U64(0))], [codes.astype(U64)]
        while len(masks[-1]) > fan:
            m, v, starts = masks[-1], values[-1], np.arange(0, len(masks[-1]), fan)
            first = np.repeat(v[starts], np.diff(np.r_[starts, len(v)]))
            agreed = np.bitwise_and.reduceat(m & ~(v ^ first), starts)
            masks.append(agreed)
            values.append(v[starts] & agreed)
        self.whole = masks, values = masks[::-1], values[::-1]
        self.levels = [(masks[0], values[0] & masks[0])]
        for (above, m, v) in zip(masks, masks[1:], values[1:]):
            rest = m & ~np.repeat(above, fan)[: len(m)]
            self.levels.append((rest, v & rest))

    def first_level(self, radius: int) -> int:
        """The first level whose nodes agree in more than twice the radius' bits: nodes above it would rule out next to nothing."""
        return next(i for i, m in enumerate(self.whole[0]) if np.bitwise_count(m).mean() > min(2 * radius, 63))

    @property
    def top(self) -> tuple[int, int]:
        """The bits that all codes agree in, and their pattern."""
        masks, values = self.levels[0]
        agreed = np.bitwise_and.reduce(masks & ~(values ^ values[0]))
        return int(agreed), int(values[0] & agreed)

    def search(self, queries: np.ndarray, radius: int, after: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(place of the query, place of the code) of all pairs that differ in at most ``radius`` bits.

        With ``after`` the queries are the codes from that place on, and only codes behind a query are searched.
        ``seen`` and ``ruled_out`` count the nodes looked at, and the codes of groups that were dropped whole.
        """
        first = self.first_level(radius)
        covers = self.fan ** (len(self.levels) - 1 - first)
        start = 0 if after is None else (after + 1) // covers  # no node before it has a code behind a query
        mask, value = (x[first][start:] for x in self.whole)
        apart = np.bitwise_count((queries[:, None] ^ value) & mask)
        near = apart <= radius
        if after is not None:
            there = (np.arange(start, start + len(mask)) + 1) * covers > np.arange(len(queries))[:, None] + after + 1
            near &= there
        seen = near.size if after is None else int(np.count_nonzero(there))
        self.seen += seen
        self.ruled_out += covers * (seen - int(np.count_nonzero(near))) if covers > 1 else 0
        q, node = np.nonzero(near)
        spent, node = apart[q, node].astype(np.int64), node + start
        for mask, value in self.levels[first + 1 :]:
            q, spent = np.repeat(q, self.fan), np.repeat(spent, self.fan)
            node = (node[:, None] * self.fan + np.arange(self.fan)).ravel()
            covers //= self.fan
            there = node < len(mask)
            if after is not None:
                there &= (node + 1) * covers > q + after + 1
            q, spent, node = q[there], spent[there], node[there]
            spent = spent + np.bitwise_count((queries[q] ^ value[node]) & mask[node])
            near = spent <= radius
            self.seen += len(near)
            self.ruled_out += covers * int(len(near) - np.count_nonzero(near)) if covers > 1 else 0
            q, node, spent = q[near], node[near], spent[near]
        return q, node


def unite(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Gives linked places the smallest label of either, in place."""
    while len(a):
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while (labels[labels] != labels).any():
            labels[:] = labels[labels]


QUERIES_AT_ONCE = 256


def link_run(codes: np.ndarray, radius: int) -> np.ndarray:
    """For each code of a run the place of the first code that it is linked with over others of the run."""
    index, labels = GrayIndex(codes), np.arange(len(codes))
    for at in range(0, len(codes), QUERIES_AT_ONCE):
        q, found = index.search(codes[at : at + QUERIES_AT_ONCE], radius, after=at)
        unite(labels, q + at, found)
    return labels


def link_runs(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as pairs of codes, of the links between two runs."""
    both, labels, index = np.concatenate([left, right]), np.arange(len(left) + len(right)), GrayIndex(right)
    for at in range(0, len(left), QUERIES_AT_ONCE):
        q, found = index.search(left[at : at + QUERIES_AT_ONCE], radius)
        unite(labels, q + at, found + len(left))
    tied = np.flatnonzero(labels != np.arange(len(labels)))
    return both[tied], both[labels[tied]]


# --- files and runs -----------------------------------------------------------------------------------------------


def gray_rank(code: Column) -> Column:
    """The place of a code in the Gray sequence (as a signed number, which only shifts the order's start)."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code


def filing(codes: int, radius: int, per_file: int) -> tuple[int, int]:
    """How many blocks name a file and how many bits each of them has, for about so many codes to a file."""
    bits = max(0, (codes // per_file).bit_length())
    if not bits:
        return 0, 0
    for blocks in range(1, 64 - radius):
        width = -(-bits // blocks)
        if width <= 64 // (radius + blocks):
            return blocks, width
    raise ValueError("no filing for this radius")


def files(code: Column, radius: int, blocks: int, width: int) -> Column:
    """The files of a code: numbers made of the choice of blocks and the code's bits in them."""
    n = radius + blocks
    bits = [F.shiftrightunsigned(code, 64 * i // n).bitwiseAND((1 << width) - 1) for i in range(n)]
    out = []
    for i, chosen in enumerate(combinations(range(n), blocks)):
        name = F.lit(i << blocks * width).cast("bigint")
        for place, c in enumerate(chosen):
            name = name.bitwiseOR(F.shiftleft(bits[c], place * width))
        out.append(name)
    return F.array(*out)


#: A link (a, b), or a run (file, number, mask, pattern, codes) that may have to be held against others of its file.
FOUND = "a bigint, b bigint, file bigint, run bigint, mask bigint, pattern bigint, codes binary"
FOUND_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("file", pa.int64()), ("run", pa.int64()), ("mask", pa.int64()), ("pattern", pa.int64()), ("codes", pa.binary())])
#: Codes that a file holds on average (at most, and at least half as many), and those of a run at most.
PER_FILE, RUN_CODES = 2048, 8192


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _link_files(radius: int, most: int):
    def links(file: np.ndarray, codes: np.ndarray) -> pa.RecordBatch | None:
        """A spanning forest of the links within each file of the given rows, which are sorted by file."""
        labels = np.arange(len(codes))
        starts = np.flatnonzero(np.r_[True, file[1:] != file[:-1]])
        sizes = np.diff(np.r_[starts, len(file)])
        for at, size in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
            labels[at : at + size] = link_run(codes[at : at + size], radius) + at
        tied = np.flatnonzero(labels != np.arange(len(labels)))
        return _rows(a=codes[tied], b=codes[labels[tied]]) if len(tied) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held_file, held = np.zeros(0, np.int64), np.zeros(0, U64)
        first_file, cut = None, set()

        def whole_run(file: int, codes: np.ndarray) -> pa.RecordBatch:
            nonlocal number
            number += 1
            mask, pattern = GrayIndex(codes).top
            return _rows(file=[file], run=[number], mask=[_signed(mask)], pattern=[_signed(pattern)], codes=[codes.astype("<u8").tobytes()])

        def settle(file: np.ndarray, codes: np.ndarray, last: bool) -> Iterator[pa.RecordBatch]:
            """Whole files; the first and the last of a partition may go on in another one."""
            if (found := links(file, codes)) is not None:
                yield found
            edges = {first_file, int(file[-1]) if last else None} | cut
            for f in sorted(e for e in edges if e is not None):
                a, b = np.searchsorted(file, [f, f + 1]).tolist()
                if b > a:
                    yield whole_run(f, codes[a:b])

        for batch in batches:
            held_file = np.concatenate([held_file, batch.column(0).to_numpy()])
            held = np.concatenate([held, batch.column(1).to_numpy().view(U64)])
            if not len(held_file):
                continue
            if first_file is None:
                first_file = int(held_file[0])
            at = int(np.searchsorted(held_file, held_file[-1]))  # the last file may go on in the next batch
            if at:
                yield from settle(held_file[:at], held[:at], False)
                held_file, held = held_file[at:], held[at:]
            while len(held) >= most:  # a file of more than one run
                cut = {int(held_file[0])}
                yield from settle(held_file[:most], held[:most], False)
                held_file, held = held_file[most:], held[most:]
        if len(held_file):
            yield from settle(held_file, held, True)

    return run


def _rows(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    as_array = lambda f: pa.array(columns[f.name].view(np.int64) if isinstance(columns[f.name], np.ndarray) else columns[f.name], f.type)
    return pa.RecordBatch.from_arrays([as_array(f) if f.name in columns else pa.nulls(n, f.type) for f in FOUND_ARROW], schema=FOUND_ARROW)


def _link_pairs(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for batch in batches:
            for left, right in zip(batch.column(0), batch.column(1)):
                a, b = link_runs(np.frombuffer(left.as_py(), "<u8"), np.frombuffer(right.as_py(), "<u8"), radius)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=kind)

    return run


def code_links(codes: DataFrame, radius: int = 4, run_codes: int = RUN_CODES, per_file: int = PER_FILE) -> DataFrame:
    """(a, b): links that join the same codes as all pairs with at most ``radius`` differing bits do.

    ``codes`` has one bigint column ``code`` of distinct values. Links of a code with itself, and links that
    follow from others of their run, are left out; no two codes are joined otherwise.
    """
    return filed_links(codes.select("code", F.explode(files(F.col("code"), radius, *filing(codes.count(), radius, per_file))).alias("file")), radius, run_codes)


def filed_links(filed: DataFrame, radius: int, run_codes: int = RUN_CODES) -> DataFrame:
    """(a, b): links that join, within each file, the same codes as all its pairs with at most ``radius`` differing bits do.

    ``filed`` has distinct rows of two bigints, ``code`` and ``file``. Of a file in one run all codes that are joined
    have one ``b``; of two runs the codes that are joined across them.
    """
    ordered = filed.withColumn("rank", gray_rank(F.col("code"))).repartitionByRange("file", "rank").sortWithinPartitions("file", "rank").select("file", "code")
    found = materialise(ordered.mapInArrow(_link_files(radius, run_codes), FOUND), "simhash-runs")
    near = found.where("a IS NOT NULL").select("a", "b")
    runs = found.where("run IS NOT NULL")
    # files that have more than one run; their top nodes are small, so runs are ruled out before codes move
    tops = runs.select("file", "run", "mask", "pattern")
    other = tops.select(F.col("file").alias("_file"), F.col("run").alias("other"), F.col("mask").alias("_mask"), F.col("pattern").alias("_pattern"))
    shared = F.col("pattern").bitwiseXOR(F.col("_pattern")).bitwiseAND(F.col("mask").bitwiseAND(F.col("_mask")))
    pairs = tops.join(other, (F.col("file") == F.col("_file")) & (F.col("run") < F.col("other")) & (F.bit_count(shared) <= radius)).select("run", "other")
    left = runs.select("run", F.col("codes").alias("left"))
    right = runs.select(F.col("run").alias("other"), F.col("codes").alias("right"))
    across = pairs.join(left, "run").join(right, "other").select("left", "right").mapInArrow(_link_pairs(radius), "a bigint, b bigint")
    return near.unionByName(across).distinct()


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, seed: int = 42, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, fingerprint (bigint) and component_id for each row of ``docs``.

    component_id is the smallest id of the rows that are reachable over links of at most ``radius`` differing
    bits. Null, empty and blank texts have the fingerprint 0 and link like any other. Rows with a null id stay
    and link, but name a component only where no row of it has an id (then component_id is null). Repeated rows
    stay. Other columns are neither read nor returned.
    """
    return _labelled(docs.select(F.col(id_column).alias("doc_id"), fingerprint(F.col(text_column), words, seed).alias("fingerprint")), radius).select(
        F.col("doc_id").alias(id_column), "fingerprint", "component_id"
    )


def _labelled(printed: DataFrame, radius: int) -> DataFrame:
    """Adds root (a fingerprint) and component_id to rows with doc_id and fingerprint."""
    printed = materialise(printed, "simhash-prints")
    # one row for each distinct fingerprint, aggregated before the shuffle
    codes = materialise(printed.groupBy(F.col("fingerprint").alias("code")).agg(F.min("doc_id").alias("least")), "simhash-codes")
    roots = components(code_links(codes.select("code"), radius), "simhash-components")
    rooted = codes.join(roots, codes["code"] == roots["node"], "left").select("code", "least", F.coalesce("root", "code").alias("root"))
    # written, so that the join has a plain shuffle on either side and can split a root that many codes have
    named = materialise(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-named")
    labels = rooted.select("code", "root").join(named, "root")
    # a fingerprint may have a third of all rows: the skewed side is split by the join, the other has one row for it
    return printed.join(labels, printed["fingerprint"] == labels["code"], "left").drop("code")


def keep_one(docs: DataFrame, words: int = 4, radius: int = 4, seed: int = 42) -> DataFrame:
    """``docs`` with the same columns, of each component only the row of the smallest doc_id.

    Among rows of that id the one of the smallest hash of the text stays, and one of repeated rows; rows with a
    null id stay only where no row of their component has one.
    """
    printed = docs.select("doc_id", fingerprint(F.col("text"), words, seed).alias("fingerprint"), text_digest().alias("digest"))
    return first_of_each(docs, _labelled(printed, radius))


def text_digest() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.col("text").isNull())


def first_of_each(docs: DataFrame, rooted: DataFrame) -> DataFrame:
    """The rows of ``docs`` that :func:`keep_one` keeps; ``rooted`` has doc_id, digest and root of each row."""
    columns = docs.columns
    kept_id, kept_digest, repeated_id, own_digest = (free_name(columns, n) for n in ("_kept_id", "_kept_digest", "_repeated_id", "_simhash_digest"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")
    first = rooted.groupBy("root").agg(F.min(order).alias("first"))
    kept = materialise(first.select("first.doc_id", "first.digest").distinct().select(F.col("doc_id").alias(kept_id), F.col("digest").alias(kept_digest)), "simhash-kept")
    marked = docs.withColumn(own_digest, text_digest()).join(kept, F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.col(own_digest) == F.col(kept_digest)), "left_semi")
    repeated = materialise(docs.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(repeated_id)), "simhash-repeated")
    if repeated.isEmpty():
        return only(marked, columns)
    marked = materialise(marked, "simhash-marked")
    is_repeated = F.col("doc_id").eqNullSafe(F.col(repeated_id))
    once = marked.join(repeated, is_repeated, "left_anti")
    more = marked.join(repeated, is_repeated, "left_semi").dropDuplicates(["doc_id", own_digest])
    return only(once.unionByName(more), columns)
