"""Fill-in-the-middle: a text's middle is moved behind its prefix and suffix, on a rope.

A text is held as a balanced tree whose leaves are short pieces; every node caches how many code points lie below it and
how many units begin there. Splitting at a unit's rank goes down one path and cuts one leaf; joining makes a node. So a
text is split into prefix, middle and suffix at two ranks, and the three trees are joined in another order with sentinels
between them. The way back splits the output's tree at the sentinels' places, which are ranks of code points.

Units are words with the white space before them, and what white space is left at the end. A unit begins at the text's
first code point and wherever white space follows something else, so a leaf's count needs one code point before it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The sentinels of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")
#: Code points of a leaf.
LEAF = 1024
FORMS = ("plain", "psm", "spm")


@dataclass(frozen=True, slots=True)
class Leaf:
    """``starts``: where in the piece units begin, ascending."""

    text: str
    starts: np.ndarray

    @property
    def chars(self) -> int:
        return len(self.text)

    @property
    def units(self) -> int:
        return len(self.starts)


@dataclass(frozen=True, slots=True)
class Node:
    left: Leaf | Node
    right: Leaf | Node
    chars: int
    units: int


Rope = Leaf | Node
EMPTY = Leaf("", np.zeros(0, np.int32))


def joined(left: Rope, right: Rope) -> Rope:
    if not left.chars:
        return right
    return left if not right.chars else Node(left, right, left.chars + right.chars, left.units + right.units)


def unit_starts(text: str) -> np.ndarray:
    """The places of the code points at which units begin."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = (codes == 0x20) | (codes - np.uint32(0x09) < 5)  # unsigned, so that smaller ones are far above
    return np.flatnonzero(np.concatenate([[len(text) > 0], blank[1:] & ~blank[:-1]])[: len(text)])


def rope(text: str, leaf: int = LEAF) -> Rope:
    """A balanced tree over a text."""
    starts = unit_starts(text)
    edges = np.arange(0, len(text) + leaf, leaf)
    at = np.searchsorted(starts, edges)
    level: list[Rope] = [Leaf(text[i : i + leaf], starts[a:b] - i) for i, a, b in zip(edges[:-1].tolist(), at.tolist(), at[1:].tolist())]
    while len(level) > 1:
        level = [joined(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else EMPTY


def _cut(leaf: Leaf, place: int) -> tuple[Rope, Rope]:
    k = int(np.searchsorted(leaf.starts, place))
    return Leaf(leaf.text[:place], leaf.starts[:k]), Leaf(leaf.text[place:], leaf.starts[k:] - place)


def _split(tree: Rope, rank: int, by: str) -> tuple[Rope, Rope]:
    """The tree before and from the code point, or the unit's beginning, of a rank from 0."""
    passed: list[tuple[Node, bool]] = []
    while isinstance(tree, Node):
        here = getattr(tree.left, by)
        goes_left = rank < here
        passed.append((tree, goes_left))
        tree, rank = (tree.left, rank) if goes_left else (tree.right, rank - here)
    if rank >= getattr(tree, by):
        before, after = tree, EMPTY
    else:
        before, after = _cut(tree, rank if by == "chars" else int(tree.starts[rank]))
    for node, went_left in reversed(passed):
        if went_left:
            after = joined(after, node.right)
        else:
            before = joined(node.left, before)
    return before, after


def split_units(tree: Rope, units: int) -> tuple[Rope, Rope]:
    """The first so many units, and the rest."""
    return _split(tree, units, "units")


def split_chars(tree: Rope, chars: int) -> tuple[Rope, Rope]:
    """The first so many code points, and the rest."""
    return _split(tree, chars, "chars")


def pieces(tree: Rope) -> Iterator[str]:
    waiting = [tree]
    while waiting:
        t = waiting.pop()
        if isinstance(t, Node):
            waiting += (t.right, t.left)
        else:
            yield t.text


def flat(tree: Rope) -> str:
    return "".join(pieces(tree))


def sentinel(text: str) -> Leaf:
    """A leaf that isn't a unit's."""
    return Leaf(text, np.zeros(0, np.int32))


def rearranged(text: str, cut_a: int, cut_b: int, form: str) -> tuple[str, int, int]:
    """The output, and the code points of prefix and middle; the prefix ends after the smaller number of units."""
    first, suffix = split_units(rope(text), max(cut_a, cut_b))
    prefix, middle = split_units(first, min(cut_a, cut_b))
    parts = ((PREFIX, prefix), (SUFFIX, suffix), (MIDDLE, middle)) if form == "psm" else ((SUFFIX, suffix), (PREFIX, prefix), (MIDDLE, middle))
    out: Rope = EMPTY
    for mark, part in parts:
        out = joined(out, joined(sentinel(mark), part))
    return flat(out), prefix.chars, middle.chars


def restored(output: str, form: str) -> str:
    """The text that :func:`rearranged` was given, of its output and form alone.

    A text with a sentinel stays plain, and no two sentinels can overlap, so each is found where it was put.
    """
    if form == "plain":
        return output
    second, third = (SUFFIX, MIDDLE) if form == "psm" else (PREFIX, MIDDLE)
    tree, width = rope(output), len(PREFIX)
    a = output.index(second, width)
    b = output.index(third, a + width)
    head, last = split_chars(tree, b)
    head, mid = split_chars(head, a)
    one, two, middle = (split_chars(t, width)[1] for t in (head, mid, last))
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    return flat(joined(prefix, joined(middle, suffix)))


TRANSFORMED = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
_KIND = pa.struct([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def transformed(text: Column, draws: list[Column], fim_percent: int = 50, spm_percent: int = 80) -> Column:
    """A struct: n (units), form, prefix_chars and middle_chars (null if plain) and output.

    ``draws`` are four numbers from 0 of each row: where to cut twice, whether to, and in which form. A text stays plain if
    it is empty or null, holds a sentinel, or its third draw isn't below ``fim_percent`` of a hundred; the form is spm if
    the fourth is below ``spm_percent``, else psm. Null draws count as 0.
    """

    @F.arrow_udf(f"struct<{', '.join(c.replace(' ', ':', 1) for c in TRANSFORMED.split(', '))}>")
    def make(texts: pa.Array, a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
        rows = []
        for t, *h in zip(texts, *(x.to_pylist() for x in (a, b, c, d))):
            value, h = t.as_py() or "", [x or 0 for x in h]
            n = len(unit_starts(value))
            if not value or h[2] % 100 >= fim_percent or any(s in value for s in SENTINELS):
                rows.append((n, "plain", None, None, value))
                continue
            form = "spm" if h[3] % 100 < spm_percent else "psm"
            out, in_prefix, in_middle = rearranged(value, h[0] % (n + 1), h[1] % (n + 1), form)
            rows.append((n, form, in_prefix, in_middle, out))
        columns = list(zip(*rows)) if rows else [()] * 5
        return pa.StructArray.from_arrays([pa.array(v, f.type) for v, f in zip(columns, _KIND)], fields=list(_KIND))

    return make(text, *draws)


def original(output: Column, form: Column) -> Column:
    """The text of an output and its form; null where either is null."""

    @F.arrow_udf("string")
    def make(outputs: pa.Array, forms: pa.Array) -> pa.Array:
        return pa.array([None if f is None or not o.is_valid else restored(o.as_py(), f) for o, f in zip(outputs, forms.to_pylist())], pa.string())

    return make(output, form)


def draws(id_column: str, seed: int = 42) -> list[Column]:
    """Four whole numbers below 2 to the 32nd of a row's id: groups of the SHA-256 of the seed and the id as text; a null
    id counts as the empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def fill_in_middle(docs: DataFrame, fim_percent: int = 50, spm_percent: int = 80, seed: int = 42) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output for each row of ``docs``; see :func:`transformed`.

    Repeated rows are cut alike; rows without an id too, as if their id were the empty text. Null texts count as empty and
    give an empty plain output; an empty table gives no rows. Other columns are neither read nor returned.
    """
    made = docs.select("doc_id", transformed(F.col("text"), draws("doc_id", seed), fim_percent, spm_percent).alias("made"))
    return made.select("doc_id", "made.*")


def round_trip(docs: DataFrame) -> DataFrame:
    """:func:`fill_in_middle` with the digests of the output and of the text that is restored from output and form."""
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    rows = fill_in_middle(docs)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(original(F.col("output"), F.col("form"))).alias("restored_sha256"))
