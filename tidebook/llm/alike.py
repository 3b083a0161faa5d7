"""Near-duplicates by operator 6's SimHash index, each link checked by the exact Jaccard likeness of word shingle sets.

Texts with equal sets are one node. A node has several SimHash words of 64 bits, made of its set. Each word is filed
under several of its blocks of bits, as in :mod:`simhash`, and the index in Gray order finds what lies within
some bits in a file. Which nodes meet there is a candidate group. Most meet by chance, more of them the more texts
there are; so a group first keeps only the nodes that have another one of it near by four words at once, and no text
moves for the others. What stays is held against each other by whole sets, and only pairs that are alike enough are
linked. :func:`filing` takes as many words as make a miss improbable for the number of texts; its docstring has the
figures. Groups of the same nodes are compared once. The nodes of a group are dealt into parts, and every two parts
are one block, so no task holds a whole group, and no pair leaves a task: only a spanning forest of a block's links
does. Intermediate tables go as soon as the kept rows are known, shuffles with the job that made them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts_of, tidied
from .components import Rounds, components
from .simhash import LOWER_BYTES, U64, files, filed_links, first_of_each, shingle_hashes, text_digest, unite

WORDS, LIKENESS, SEED, PART = 5, 0.8, 42, 1024

#: Codes that a file holds on average at most; the bits of a word that may differ are one of these numbers.
PER_FILE, RADII = 1024, range(8, 14)
#: What a row of a file and a candidate by chance cost, in words of a text. A word is made and told from others.
FILED, CHANCE = 0.5, 12
#: The words by which nodes of a group are compared before their texts are, and the share of alike pairs that may be missed there.
CHECKED, CHECK_MISSED = 4, 1e-9
#: Of pairs at the least likeness, the share that may be missed; and by how much more of their bits small sets may differ.
MISSED, SMALL_SETS = 1e-6, 1.07
#: Sets of at most so many shingles have three times as many words: those of four and five differ in 0.1875 of their bits,
#: which is less than so much more.
TINY, TINY_SETS = 5, 1.25
#: A factor for each word, which mixes the hashes anew.
_ODD = np.random.default_rng(23).integers(0, 2**63, 4096, dtype=U64) * U64(2) + U64(1)


def shingle_set(text: str, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    return np.unique(shingle_hashes(text, words, seed))


def codes_of(hashes: np.ndarray, count: int) -> np.ndarray:
    """``count`` SimHash words of a set, three times as many of a tiny one: the bits that over half of its hashes have, mixed anew for each word."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    count *= 3 if len(hashes) <= TINY else 1
    ones = np.zeros(count * 64, np.int64)
    for at in range(0, len(hashes), 255):  # sums of 255 bits fit into a byte
        x = hashes[at : at + 255, None]
        x = (x ^ x >> U64(33)) * _ODD[:count]
        x = (x ^ x >> U64(32)) * U64(0x9E3779B97F4A7C15)
        x ^= x >> U64(29)
        bits = np.unpackbits(x.astype("<u8").view(np.uint8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8").astype(np.int64)


def found_by_word(rate: float, radius: int, blocks: int, width: int) -> float:
    """The probability that two codes, each bit of which differs at ``rate``, meet in a file and lie within the radius there."""
    found = 0.0
    for d in range(radius + 1):
        clean = lambda j: math.comb(64 - j * width, d) / math.comb(64, d)  # noqa: B023, E731
        some = sum((-1) ** (j + 1) * math.comb(blocks, j) * clean(j) for j in range(1, blocks + 1))
        found += math.comb(64, d) * rate**d * (1 - rate) ** (64 - d) * some
    return found


def filing(nodes: int, likeness: float = LIKENESS) -> tuple[int, int, int, int]:
    """How many words a node has, the bits of a word that may differ, how many blocks of a word name a file, and their bits.

    Two sets of likeness ``s`` and equal size differ in acos(2 s / (1 + s)) / pi of their bits: 0.151 at 0.8. Small sets
    differ in up to 0.161 of them, all but those of four and five shingles, and sets of unequal size in fewer. So many
    words are taken that of pairs at ``likeness`` exactly less than one in a million is missed; those more alike are
    missed less. Words, and so rows, grow slowly with the nodes; of all ways to file them the cheapest is taken.
    """
    rate = bit_rate(likeness) * SMALL_SETS
    width = (nodes // PER_FILE).bit_length()
    ways = []
    for radius in RADII:
        near = sum(math.comb(64 - width, d) for d in range(radius + 1)) / 2 ** (64 - width)
        for blocks in range(1, min(64 // width, 16) + 1 if width else 2):
            words = math.ceil(math.log(MISSED) / math.log(1 - found_by_word(rate, radius, blocks, width)))
            ways.append((words * (1 + blocks * (FILED + CHANCE * nodes / 2**width * near)), words, radius, blocks))
    return *min(ways)[1:], width


def bit_rate(likeness: float) -> float:
    """The share of bits in which large sets of equal size and this likeness differ."""
    return math.acos(2 * likeness / (1 + likeness)) / math.pi


def check_bits(words: int, likeness: float = LIKENESS) -> int:
    """The bits of so many words that alike sets may differ in: all but ``CHECK_MISSED`` of them do, tiny ones included."""
    rate, bits, seen, chance = bit_rate(likeness) * TINY_SETS, 64 * words, -1, 1.0
    while chance > CHECK_MISSED:
        seen += 1
        chance = sum(math.comb(bits, d) * rate**d * (1 - rate) ** (bits - d) for d in range(seen + 1, bits + 1))
    return seen


def packed_words(text: str) -> bytes:
    """A text's lower-cased words, compressed: a third of the size of its hashes, which :func:`set_of` makes again."""
    return zstandard.compress(b" ".join(text.encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split()), 3)


def set_of(packed: bytes, words: int, seed: int) -> np.ndarray:
    return shingle_set(zstandard.decompress(packed).decode("utf-8", "surrogatepass"), words, seed)


SHINGLED = "struct<node: bigint, packed: binary, codes: array<bigint>>"


def shingled(text: Column, count: int, words: int = WORDS, seed: int = SEED) -> Column:
    """A text's node (a hash of its set), its packed words, and its SimHash words (none without words); null, empty and blank texts are one node."""

    @F.arrow_udf(SHINGLED)
    def of(texts: pa.Array) -> pa.Array:
        nodes, packed, codes = [], [], []
        for t in texts_of(texts):
            hashes = shingle_set(t, words, seed)
            packed.append(packed_words(t))
            nodes.append(xxhash.xxh64_intdigest(hashes.astype("<u8").tobytes(), seed))
            codes.append(codes_of(hashes, count))
        ends = np.cumsum([0, *map(len, codes)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *codes])))
        return pa.StructArray.from_arrays([pa.array(np.array(nodes, U64).view(np.int64)), pa.array(packed, pa.binary()), lists], ["node", "packed", "codes"])

    return of(text)


def alike(sets: list[np.ndarray], likeness: float, part: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of sets whose exact Jaccard likeness is at least so much; with ``part`` only of two parts."""
    share, sizes = Fraction(str(likeness)), np.array([len(s) for s in sets])
    tokens, doc = np.unique(np.concatenate(sets), return_inverse=True)[1], np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(tokens, kind="stable")
    posted, counts = doc[order], np.bincount(tokens)
    starts, ends = np.cumsum(counts) - counts, np.cumsum(sizes)
    left, right = [], []
    for i in range(len(sets) - 1):
        own = tokens[ends[i] - sizes[i] : ends[i]]
        own = own[counts[own] > 1]
        n = counts[own]
        places = np.repeat(starts[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(posted[places], minlength=len(sets))[i + 1 :]
        near = both * share.denominator >= (sizes[i] + sizes[i + 1 :] - both) * share.numerator
        if part is not None:
            near &= part[i + 1 :] != part[i]
        found = np.flatnonzero(near) + i + 1
        left.append(np.full(len(found), i))
        right.append(found)
    return np.concatenate(left), np.concatenate(right)


LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])
MEMBER = pa.schema([("key", pa.int64()), ("node", pa.int64())])


def _each_block(then: Callable[[tuple, list[tuple]], Iterator[pa.RecordBatch]]):
    """Rows (key, p, q, part, node, what), sorted by block (key, p, q), to what ``then`` makes of each block's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []
        for batch in batches:
            key, p, q, *rest = (c.to_pylist() for c in batch.columns)
            for block, row in zip(zip(key, p, q), zip(*rest)):
                if block != at:
                    if len(rows) > 1:
                        yield from then(at, rows)
                    at, rows = block, []
                rows.append(row)
        if len(rows) > 1:
            yield from then(at, rows)

    return run


def _link_blocks(likeness: float, words: int, seed: int):
    """A block's nodes and packed words to a spanning forest of its links."""

    def links(block: tuple, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        part, nodes = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.int64)
        a, b = alike([set_of(r[2], words, seed) for r in rows], likeness, part if block[1] != block[2] else None)
        labels = np.arange(len(rows))
        unite(labels, a, b)
        tied = np.flatnonzero(labels != np.arange(len(labels)))
        if len(tied):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[tied]), pa.array(nodes[labels[tied]])], schema=LINK)

    return _each_block(links)


def _near_in_blocks(bits: int):
    """A block's nodes and first words to the nodes that differ in at most so many bits from another one."""

    def near(block: tuple, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if len(rows) == 2:  # most are such
            (_, a, x), (_, b, y) = rows
            found = np.array([a, b] if sum((v ^ w & _ALL).bit_count() for v, w in zip(_unsigned(x), y)) <= bits else [], np.int64)
        else:
            part, nodes, codes = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
            other, close = np.arange(len(rows)), np.zeros(len(rows), bool)
            for at in range(0, len(rows), 256):
                some = slice(at, at + 256)
                apart = sum(np.bitwise_count((own[some, None] ^ own).view(U64)).astype(np.int16) for own in codes.T.copy())
                # of one part's block all others count, of two parts' block those of the other part
                met = part[some, None] != part if block[1] != block[2] else other[some, None] != other
                close[some] = ((apart <= bits) & met).any(axis=1)
            found = nodes[close]
        if len(found):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), block[0])), pa.array(found)], schema=MEMBER)

    return _each_block(near)


_ALL = (1 << 64) - 1


def _unsigned(codes: list[int]) -> Iterator[int]:
    return (c & _ALL for c in codes)


def distinct_nodes(printed: DataFrame, held: Rounds) -> DataFrame:
    """(node, codes): one row for each node that has words; texts of one node have the same."""
    return held.keep(printed.where(F.size("codes") > 0).groupBy("node").agg(F.first("codes").alias("codes")))


def candidates(printed: DataFrame, radius: int, blocks: int, width: int, held: Rounds | None = None) -> DataFrame:
    """(node, key): nodes that the index finds near each other have a key in common, and so have nodes of one code.

    ``printed`` has node and codes, and nodes may repeat. Codes of two words are equal by chance only, which costs a
    comparison, so a key is a code: the first of a run that the others are joined with, or one that several nodes have.
    """
    held = held or Rounds(printed.sparkSession, "alike-candidates")
    coded = printed.select("node", F.posexplode("codes").alias("word", "code"))
    named = held.keep(coded.groupBy("word", "code").agg((F.min("node") < F.max("node")).alias("shared")))
    # a block's number takes six bits above the block's own
    name = F.explode(files(F.col("code"), blocks - 1, 1, width)).alias("name")
    filed = named.select("code", "word", name).select("code", F.shiftleft(F.col("word").cast("bigint"), width + 6).bitwiseOR(F.col("name")).alias("file"))
    links = held.keep(filed_links(filed, radius))
    shared = named.where("shared").select("code", F.col("code").alias("key"))
    keys = links.select(F.col("a").alias("code"), F.col("b").alias("key")).unionByName(links.select(F.col("b").alias("code"), F.col("b").alias("key"))).unionByName(shared).distinct()
    return coded.select("node", "code").join(keys, "code").select("node", "key").distinct()


def dealt(filed: DataFrame, part: int, held: Rounds) -> DataFrame:
    """(key, p, q, part, node): the blocks of each group of (node, key), one group of those of the same nodes."""
    # a key's nodes are told by their number, two sums of hashes, and the first and last of them
    told = [F.count(F.lit(1)).alias("nodes"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"), F.min("node").alias("low"), F.max("node").alias("high")]
    same = filed.groupBy("key").agg(*told).where("nodes > 1").groupBy("nodes", "x", "y", "low", "high").agg(F.min("key").alias("key"))
    shared = held.keep(same.select("key", F.ceil(F.col("nodes") / part).cast("int").alias("parts")))
    members = filed.join(shared, "key").withColumn("part", F.pmod(F.xxhash64("node", "key"), "parts").cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return held.keep(members.select("key", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "node"))


def by_block(members: DataFrame, whats: DataFrame, what: str) -> DataFrame:
    rows = members.join(whats, "node").select("key", "p", "q", "part", "node", what)
    return rows.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "node")


def near_candidates(filed: DataFrame, codes: DataFrame, count: int, likeness: float, part: int, held: Rounds) -> DataFrame:
    """The rows of (node, key) whose node is near another one of the key by its first words; ``codes`` has node and codes."""
    words = min(count, CHECKED)
    checks = codes.select("node", F.slice("codes", 1, words).alias("check"))
    return by_block(dealt(filed, 8 * part, held), checks, "check").mapInArrow(_near_in_blocks(check_bits(words, likeness)), "key bigint, node bigint").distinct()


def set_links(printed: DataFrame, count: int, radius: int, blocks: int, width: int, words: int = WORDS, likeness: float = LIKENESS, seed: int = SEED, part: int = PART, held: Rounds | None = None) -> DataFrame:
    """(a, b): links that join the same nodes as all pairs of at least so much likeness do.

    ``printed`` has node, packed and codes (:func:`shingled`), and nodes may repeat.
    """
    held = held or Rounds(printed.sparkSession, "alike-links")
    nodes = distinct_nodes(printed, held)
    filed = held.keep(candidates(nodes, radius, blocks, width, held))
    near = held.keep(near_candidates(filed, nodes, count, likeness, part, held))
    members = dealt(near, part, held)
    wanted = members.select("node").distinct()
    # texts of one node have equal sets, so any of them will do
    sets = printed.select("node", "packed").join(wanted, "node", "left_semi").groupBy("node").agg(F.min("packed").alias("packed"))
    return by_block(members, sets, "packed").mapInArrow(_link_blocks(likeness, words, seed), "a bigint, b bigint")


def keep_one(docs: DataFrame, words: int = WORDS, likeness: float = LIKENESS, seed: int = SEED, part: int = PART) -> DataFrame:
    """``docs`` with the same columns, of each group only the row of the smallest doc_id.

    A group is what is reachable over pairs whose sets of lower-cased word shingles have a Jaccard likeness of at
    least ``likeness``. Null, empty and blank texts are alike; a text of fewer words is a shingle of all of them.
    Of rows of one id, and of rows without an id, the same stay as in :func:`simhash.keep_one`.
    """
    held = Rounds(docs.sparkSession, "alike")
    with tidied(docs.sparkSession):
        count, radius, blocks, width = filing(docs.count(), likeness)
        printed = docs.select("doc_id", text_digest().alias("digest"), shingled(F.col("text"), count, words, seed).alias("s"))
        printed = held.keep(printed.select("doc_id", "digest", "s.node", "s.packed", "s.codes"))
        roots = components(set_links(printed, count, radius, blocks, width, words, likeness, seed, part, held), "alike-components").withColumnRenamed("node", "_node")
        rooted = printed.select("doc_id", "digest", "node").join(roots, F.col("node") == F.col("_node"), "left")
        kept = first_of_each(docs, rooted.select("doc_id", "digest", F.coalesce("root", "node").alias("root")))
        held.forget_but(None)
    return kept
