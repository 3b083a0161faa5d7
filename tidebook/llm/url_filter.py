"""URL filtering by pattern rules that are indexed by their rarest literal token.

A rule is a regular expression over ``host || path``. Its syntax tree tells which literal tokens (runs of a-z and
0-9 after lower-casing) a URL that it fits holds as whole tokens: some for each way through the alternatives. The
rule is filed under the rarest token of each way, as counted over all URLs. A URL's tokens fetch the rules filed
under them, and only these run their regular expression. Everything runs in one projection inside the JVM: no
shuffle, no join and no Python. The table of rules is part of the plan, so its size is bounded (``MOST_BYTES``).
"""

from __future__ import annotations

import json
import re
import string
import warnings
import zlib
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import groupby
from re import _constants as ops
from re import _parser as syntax

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

TOKEN = "[a-z0-9]+"
LETTERS = frozenset(string.ascii_letters + string.digits)
#: Bytes of all rules' patterns and names together, which are a table of the plan; more is an error.
MOST_BYTES = 4 << 20
#: Ways through a pattern's alternatives that are told apart; further alternatives count as unknown text.
MOST_WAYS = 64

# --- the literal tokens of a pattern --------------------------------------------------------------------------------

#: What a way through a pattern holds beside letters and digits: something else that is certain, or unknown text.
BREAK, GAP = "-", "*"
EDGES = {ops.AT_BEGINNING, ops.AT_BEGINNING_STRING, ops.AT_END, ops.AT_END_STRING, ops.AT_BOUNDARY}
CLASSES = {ops.CATEGORY_SPACE: "", ops.CATEGORY_DIGIT: string.digits, ops.CATEGORY_WORD: LETTERS, ops.CATEGORY_NOT_SPACE: LETTERS, ops.CATEGORY_NOT_DIGIT: string.ascii_letters, ops.CATEGORY_NOT_WORD: ""}


def _letters_of(items) -> set[str]:
    """The letters and digits that a bracketed set holds."""
    held, negated = set(), False
    for op, value in items:
        if op is ops.NEGATE:
            negated = True
        elif op is ops.LITERAL:
            held.add(chr(value))
        elif op is ops.RANGE:
            held |= {c for c in LETTERS if value[0] <= ord(c) <= value[1]}
        else:
            held |= set(CLASSES[value])
    return LETTERS - held if negated else held & LETTERS


def _ways(tree) -> list[str]:
    """Each way through a sequence as a text of lower-cased letters and digits, breaks and gaps."""
    out = [""]
    for op, value in tree:
        if op is ops.LITERAL:
            more = [chr(value).lower() if chr(value) in LETTERS else BREAK]
        elif op is ops.IN:
            more = [GAP if _letters_of(value) else BREAK]
        elif op is ops.AT and value in EDGES:
            more = [BREAK]
        elif op is ops.SUBPATTERN:
            more = _ways(value[3])
        elif op is ops.ATOMIC_GROUP:
            more = _ways(value)
        elif op is ops.BRANCH:
            more = [w for branch in value[1] for w in _ways(branch)]
        elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT, ops.POSSESSIVE_REPEAT):
            least, most, inner = value
            more = _ways(inner)
            if most != 1 and set(more) != {BREAK}:  # what is repeated may follow itself
                more = [GAP + w + GAP for w in more]
            more = more if least else ["", *more]
        else:
            more = [GAP]
        more = list(dict.fromkeys(more))
        out = [a + b for a in out for b in (more if len(out) * len(more) <= MOST_WAYS else [GAP])]
    return out


def required_tokens(regex: str) -> list[tuple[str, ...]]:
    """For each way through a pattern the whole tokens that all URLs hold which it fits in this way.

    A pattern that can't be read here, as it uses syntax that only Java has, has one way without tokens: it is tried
    on every URL. So is one whose flags change what a letter fits beyond A-Z.
    """
    readable = re.sub(r"\\(.)", lambda m: r"\Z" if m[1] == "z" else m[0], regex, flags=re.S)
    if "&&" in regex or re.search(r"\(\?[a-zA-Z]*[uUx]", regex):
        return [()]
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")  # sets within sets mean something else in Java
            ways = _ways(syntax.parse(readable))
    except (re.error, FutureWarning, DeprecationWarning, KeyError, OverflowError, RecursionError):
        return [()]
    found = []
    for way in ways:
        way = GAP + way + GAP
        runs = ["".join(g) for _, g in groupby(way, key=lambda c: c in LETTERS)]  # letters and others take turns
        whole = [r for before, r, after in zip(runs, runs[1:], runs[2:]) if r[0] in LETTERS and before[-1] == BREAK and after[0] == BREAK]
        found.append(tuple(dict.fromkeys(whole)))
    return list(dict.fromkeys(found))


# --- rules ----------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class UrlRule:
    """``shown`` rules put their name in the result; the rank decides among several that fit (highest wins)."""

    name: str
    action: str
    regex: str
    rank: int
    shown: bool = True

    @property
    def ways(self) -> list[tuple[str, ...]]:
        return required_tokens(self.regex)


def host_path_rule(text: str, action: str) -> UrlRule:
    """A rule such as ``example.com/en/7``: the host and its subdomains, paths that start with ``/en/7``."""
    host, slash, path = text.partition("/")
    host, path = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), slash + path
    escape = lambda s: re.sub(r"([^A-Za-z0-9/_-])", r"\\\1", s)
    return UrlRule(text, action, rf"\A(?:[^/]*\.)?{escape(host)}" + (escape(path) if path else r"(?:/|\z)"), 1_000_000 + len(text))


def pattern_rule(name: str, action: str, regex: str) -> UrlRule:
    """A rule by a pattern as the JVM reads it; a longer one goes before a shorter one, and any host rule before both."""
    return UrlRule(name, action, regex, min(len(regex), 999_999), shown=False)


#: The rules of the filter by itself, used where no host rule fits.
PATTERN_RULES = (
    pattern_rule("spam host", "block", r"\A(?:[^/]*\.)?spam-[^/.]+\."),
    pattern_rule("casino host", "block", r"\A(?:[^/]*[.-])?casino[.-]"),
    pattern_rule("login form", "block", r"/wp-login\.php\z"),
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.regexp_extract(_rest(url), r"\A([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"\A[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def token_counts(pages: DataFrame, url: str, tokens: Sequence[str]) -> dict[str, int]:
    """In how many URLs each of the rules' tokens occurs, over all rows. One number for each token comes back."""
    if not tokens:
        return {}
    found = F.array_distinct(F.regexp_extract_all(ascii_lower(F.col(url)), F.lit(f"({TOKEN})"), 1))
    rows = pages.select(F.explode(found).alias("token")).where(F.col("token").isin(list(tokens))).groupBy("token").count().collect()
    return {r["token"]: r["count"] for r in rows}


def rule_index(rules: Sequence[UrlRule], counts: dict[str, int]) -> tuple[Column, int]:
    """A literal hash table from the rarest token to the rules filed under it, and its size.

    A rule is filed under one token for each way through its pattern; ways without a token are filed under the
    empty token, which every URL has. Rules of more than ``MOST_BYTES`` together are an error.
    """
    taken = sum(len(r.regex.encode()) + len(r.name.encode()) for r in rules)
    if taken > MOST_BYTES:
        raise ValueError(f"rules take {taken} bytes, more than {MOST_BYTES}")
    size = 1 << max(3, (2 * len(rules)).bit_length())
    table: list[list[dict]] = [[] for _ in range(size)]
    for r in rules:
        for token in {min(way, key=lambda t: (counts.get(t, 0), t), default="") for way in r.ways}:
            table[zlib.crc32(token.encode()) % size].append({"token": token, "rank": r.rank, "name": r.name if r.shown else None, "action": r.action, "regex": r.regex})
    text = json.dumps(table)
    kind = "array<array<struct<token:string,rank:int,name:string,action:string,regex:string>>>"
    return F.from_json(F.lit(text), kind), size


def judge_urls(pages: DataFrame, rules: Sequence[UrlRule], default: str = "allow", id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """One row for each row of ``pages``: the id, host, path, rule and verdict.

    The fitting rule of the highest rank gives the verdict; ``rule`` is its name if it is a shown one. Where
    none fits, ``rule`` is null and the verdict is ``default``. A null or empty URL, or one without ``://``,
    has an empty host and path. Rows are judged one by one, so repeated rows and null ids stay; other columns
    of ``pages`` are neither read nor returned.
    """
    counts = token_counts(pages, url_column, sorted({t for r in rules for way in r.ways for t in way}))
    index, size = rule_index(rules, counts)
    url = F.coalesce(F.col(url_column), F.lit(""))
    parts = pages.select(F.col(id_column), host_of(url).alias("host"), path_of(url).alias("path"))
    subject = F.concat("host", "path")
    tokens = F.array_distinct(F.concat(F.regexp_extract_all(ascii_lower(subject), F.lit(f"({TOKEN})"), 1), F.array(F.lit(""))))
    fetched = F.flatten(F.transform(tokens, lambda t: F.filter(F.get(index, (F.crc32(t) % size).cast("int")), lambda r: r["token"] == t)))
    fitting = F.filter(fetched, lambda r: F.regexp_like(subject, r["regex"]))
    best = F.array_max(F.transform(fitting, lambda r: F.struct(r["rank"].alias("rank"), r["action"].alias("action"), r["name"].alias("name"))))
    return parts.withColumn("best", best).select(
        id_column, "host", "path", F.col("best.name").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict")
    )
