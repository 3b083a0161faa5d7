"""Personal data in texts: fixed patterns, and a bidirectional LSTM with a CRF for what is written otherwise.

The patterns find e-mail addresses, IP addresses, card numbers and phone numbers in their plain form; each is matched in
time proportional to the text. The tagger reads characters and finds the same kinds in other writings, such as
``ann (at) mail (dot) example (dot) org`` or a phone number without its plus. Texts are cut into windows that overlap by
more than the longest span; every window is decoded by itself, and all windows of a text are then reconciled: a span's
weight is its mean over the windows that hold it whole, spans are checked by their kind (a card's digits must pass Luhn's
test), and of those left the set of the greatest weight without overlaps stays. What the patterns find stays in any case.

A span of any kind holds a digit or a mark that stands for the at sign, so a window without either can't give one; such
windows needn't be decoded, and the result is that of decoding all.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import first_by_hash
from .taggers import Tagger, best_tags, character_ids, marginals, scores_of, train

#: The kinds in their order.
KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

# --- patterns ---------------------------------------------------------------------------------------------------------

#: What may stand in an address before its at sign, and what must follow.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Runs that can't be matched in two ways, so none is read more than once.
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits_of(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def passes_luhn(digits: str) -> bool:
    doubled = [int(c) * 2 for c in digits[-2::-2]]
    return (sum(int(c) for c in digits[-1::-2]) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            free = found.end()
            yield start, free
        at = text.find("@", max(at + 1, free))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _quads(text: str) -> Iterator[tuple[int, int]]:
    for run in DOTTED.finditer(text):
        parts, at = run.group().split("."), run.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(map(_small, four)):
                yield at, at + size
            at += size + 1


def base_spans(text: str) -> list[Span]:
    """What the patterns find: leftmost and without overlaps for each kind, by kind and then start."""
    out: list[Span] = [("email", a, b) for a, b in _addresses(text)]
    out += [("ip", a, b) for a, b in _quads(text)]
    for m in DIGITS.finditer(text):
        if m.end() - m.start() >= 13:
            digits = digits_of(m.group())
            if 13 <= len(digits) <= 19 and passes_luhn(digits):
                out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m.group())) <= 15]
    return out


# --- spans of the tagger ----------------------------------------------------------------------------------------------

#: Tags: none, then the first and the further characters of each kind.
TAGS = 1 + 2 * len(KINDS)
#: Code points of a window, from one window to the next, and of the longest span that the tagger may find.
WINDOW, STRIDE, LONGEST = 160, 64, 64
#: Windows that are decoded together, and how sure of every character of a span the windows must be on average.
TOGETHER, SURE = 256, 0.5

AT = r"(?:@|[(\[{<]\s?(?:at|@)\s?[)\]}>]|\s+at\s+)"
DOT = r"(?:\s*[(\[{<]\s*(?:dot|\.)\s*[)\]}>]\s*|\s+dot\s+|\s*\.\s*)"
#: An address in any writing: words, a mark for the at sign, and at least two words with dots or their marks between.
ADDRESS = re.compile(rf"(?i)[\w.%+-]+(?:{DOT}[\w%+-]+)*\s*{AT}\s*[\w-]+(?:{DOT}[\w-]+)*{DOT}[a-z]{{2,}}")
#: What every span holds. White space around a plain "at" is common in prose, so a "dot" must follow it.
SIGNS = re.compile(r"[0-9@０-９＠]")
BRACKETED, SPELLED = re.compile(r"(?i)[(\[{<]\s?at\s?[)\]}>]"), re.compile(r"(?i)\sat\s(?=[^\n]{1,60}?\bdot\b)")
FULL_WIDTH = {0xFF10 + i: str(i) for i in range(10)} | {0xFF0E: ".", 0xFF0B: "+", 0xFF20: "@", 0xFF0D: "-"}
#: Dates, which look like numbers with separators.
DATE = re.compile(r"(?:(?:19|20)[0-9]{2}\D(?:0?[1-9]|1[0-2])\D(?:0?[1-9]|[12][0-9]|3[01])|(?:0?[1-9]|[12][0-9]|3[01])\D(?:0?[1-9]|[12][0-9]|3[01])\D(?:19|20)[0-9]{2})(?![0-9])")


def is_sound(kind: str, text: str) -> bool:
    """Whether a span's text can be of its kind, however it is written."""
    plain = text.translate(FULL_WIDTH)
    if kind == "email":
        if "@" not in plain and not BRACKETED.search(plain) and not re.search(r"(?i)\sat\s.*\bdot\b", plain):
            return False
        return ADDRESS.fullmatch(plain) is not None
    if kind == "ip":
        parts = re.findall("[0-9]+", plain)
        return len(parts) == 4 and all(map(_small, parts)) and not re.search(r"(?i)[a-ce-np-su-z]", plain)
    digits = digits_of(plain)
    if re.search(r"[^\W\d_]", plain):
        return False
    return 13 <= len(digits) <= 19 and passes_luhn(digits) if kind == "card" else 9 <= len(digits) <= 15 and not DATE.match(plain)


def sign_places(text: str) -> list[int]:
    """The places of all digits and marks that stand for the at sign."""
    places = [m.start() for m in SIGNS.finditer(text)]
    places += [m.start() for m in BRACKETED.finditer(text)]
    if "dot" in text.lower():
        places += [m.start() for m in SPELLED.finditer(text)]
    return places


def windows_of(text: str, every: bool = False) -> list[int]:
    """Where the windows begin that hold a sign, or all windows."""
    last = max(0, -(-(len(text) - WINDOW) // STRIDE))
    if every:
        return [STRIDE * k for k in range(last + 1)]
    chosen: set[int] = set()
    for p in sign_places(text):
        chosen.update(range(max(0, -(-(p - WINDOW + 1) // STRIDE)), min(last, p // STRIDE) + 1))
    return [STRIDE * k for k in sorted(chosen)]


def _tagged_runs(tags: np.ndarray) -> Iterator[Span]:
    start, kind = -1, 0
    for place, tag in enumerate([*tags.tolist(), 0]):
        if start >= 0 and tag != 2 + 2 * kind:
            yield KINDS[kind], start, place
            start = -1
        if tag and tag % 2:
            start, kind = place, (tag - 1) // 2


def decoded(model: Tagger, texts: list[tuple[str, int, int]]) -> Iterator[list[tuple[Span, float]]]:
    """Of windows (text, where it begins in its whole, length of the whole) the spans, by their place in the whole, and
    how likely the least likely of their characters is. Spans that a window's edge cuts are left out."""
    for at in range(0, len(texts), TOGETHER):
        some = texts[at : at + TOGETHER]
        ids = np.zeros((len(some), max(len(t) for t, _, _ in some)), np.int16)
        for row, (t, _, _) in enumerate(some):
            ids[row, : len(t)] = character_ids(t)
        scores = scores_of(model, ids)
        tags, likely = best_tags(model, scores), marginals(model, scores)
        taken = np.take_along_axis(likely, tags[:, :, None], 2)[..., 0]
        for row, (t, begins, whole) in enumerate(some):
            yield [
                ((kind, begins + a, begins + b), float(taken[a:b, row].min()))
                for kind, a, b in _tagged_runs(tags[: len(t), row])
                if b - a <= LONGEST and (a > 0 or begins == 0) and (b < len(t) or begins + b == whole)
            ]


def trimmed(text: str, span: Span) -> Span:
    """Without white space and closing punctuation at the ends."""
    kind, a, b = span
    while a < b and (text[a].isspace() or text[a] in ",;:"):
        a += 1
    while a < b and (text[b - 1].isspace() or text[b - 1] in ",;:.!"):
        b -= 1
    return kind, a, b


def reconciled(text: str, base: list[Span], found: list[list[tuple[Span, float]]], begins: list[int]) -> list[Span]:
    """The spans that all windows together add to those of the patterns.

    A span's weight is the mean over the windows that hold it whole, 0 for those that don't find it. Spans that overlap
    one of the patterns' are left out. Of the rest, the set of the greatest weight without overlaps stays.
    """
    weight: dict[Span, float] = {}
    for spans in found:
        for span, sure in spans:
            span = trimmed(text, span)
            weight[span] = weight.get(span, 0.0) + sure
    whole = len(text)
    taken = sorted((a, b) for _, a, b in base)
    starts, reach = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    out = []
    for (kind, a, b), total in weight.items():
        holders = sum(1 for w in range(STRIDE * max(0, -(-(b - WINDOW) // STRIDE)), a + 1, STRIDE) if w in begins and (b < w + WINDOW or b == whole) and (a > w or w == 0))
        sure, earlier = total / max(1, holders), bisect_left(starts, b)
        if sure >= SURE and is_sound(kind, text[a:b]) and not (earlier and reach[earlier - 1] > a):
            out.append((b, a, kind, sure))
    out.sort()
    best: list[tuple[float, tuple]] = [(0.0, ())]  # weight so far, and the chain of spans taken
    ends = [0]
    for b, a, kind, sure in out:
        before = bisect_right(ends, a) - 1
        taking = best[before][0] + sure
        ends.append(b)
        best.append((taking, (best[before][1], (kind, a, b))) if taking > best[-1][0] else best[-1])
    chain, kept = best[-1][1], []
    while chain:
        chain, span = chain
        kept.append(span)
    return kept[::-1]


def find(texts: list[str], model: Tagger | None, every: bool = False) -> list[list[tuple[str, int, int, bool]]]:
    """For each text its spans by kind and start, and whether the tagger added them. ``every`` decodes all windows."""
    out, waiting, held = [], [], []
    base = [base_spans(t) for t in texts]

    def settle() -> None:
        given = decoded(model, [(texts[i][w : w + WINDOW], w, len(texts[i])) for i, begins in waiting for w in begins])
        for i, begins in waiting:
            found = [next(given) for _ in begins]
            held.append((i, reconciled(texts[i], base[i], found, set(begins))))
        waiting.clear()

    n = 0
    for i, t in enumerate(texts if model is not None else ()):
        begins = windows_of(t, every)
        if begins:
            waiting.append((i, begins))
            n += len(begins)
        if n >= TOGETHER:
            settle()
            n = 0
    settle()
    added = dict(held)
    for i in range(len(texts)):
        spans = [(*s, False) for s in base[i]] + [(*s, True) for s in added.get(i, ())]
        out.append(sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))
    return out


# --- labelled spans ---------------------------------------------------------------------------------------------------

#: Plain words for texts where a table gives none.
FILLER = "the report of this year was sent to all who had asked for it and then put on file with the others. some of them were late, but most came in time; we thank you for that and wait to hear what you think about the plan".split()
#: Words that stand before an item; most items have none.
CUES = {
    "email": ("mail", "e-mail:", "write to", "contact", "Kontakt:", "correo", "reply to", "From:"), "ip": ("host", "server", "ip", "address", "from", "ping"),
    "card": ("card", "card no.", "visa", "carte", "Karte", "tarjeta", "pay with"), "phone": ("call", "tel", "tel.", "phone:", "Telefon", "fax", "mobile", "WhatsApp", "numéro", "llame al"),
}
#: Writings of at sign and dot, of a card's gaps, and of phone numbers (N any digit, Z not zero).
MARKS = (("@", "."), (" at ", " dot "), ("(at)", "(dot)"), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" [at] ", " [dot] "), (" [at] ", "."), ("(at)", "."), ("[at]", "."), (" @ ", "."), ("@", "[.]"), ("@", " . "), ("{at}", "{dot}"), (" AT ", " DOT "), (" (at) ", "."), ("[@]", "[.]"), ("(@)", "."))
QUAD_MARKS = (".", "[.]", "(.)", " . ", "[dot]", " dot ", "(dot)", " [.] ")
GAPS = ("", " ", "-", ".", "/", "  ", " - ", "_", " ", "–", " / ", ":")
PHONES = (
    "+Z (NNN) 555-NNNN", "+ZN NNN NNN NNNN", "(NNN) NNN-NNNN", "(NNN) NNN NNNN", "(NNN)NNN-NNNN", "NNN-NNN-NNNN", "NNN.NNN.NNNN", "1-NNN-NNN-NNNN", "1 (NNN) NNN-NNNN", "1.NNN.NNN.NNNN", "0NN NNNN NNNN", "0NNN NNNNNN",
    "00ZN NNN NNNNNNN", "00 ZN NN NNNN NNNN", "00ZN-NNN-NNNNNN", "0NNN/NNNNNNN", "0NN/NNN NN NN", "+ZN/NNN/NNNNNNN", "+ ZN NNN NNN NNN", "0Z NN NN NN NN", "0Z-NN-NN-NN-NN", "0Z/NN/NN/NN/NN", "(0NN) NNNN-NNNN", "(0NNN) NNNNNN",
    "+Z‑NNN‑NNN‑NNNN", "NNN – NNN – NNNN", "NNN / NNN / NNNN", "(0) NN NNNN NNNN",
)
#: Writings that are phone numbers only behind a cue.
CUED_PHONES = ("NNN NNN NNN", "0NNNNNNNNN", "ZNNNNNNNNN", "NNN NNN NNNN", "NNN NN NN NN")
#: Items that aren't personal data: dates, amounts, versions, codes, formulas, mentions. H stands for a hex digit, W for a word.
OTHERS = (
    "20NN-0Z-1Z", "1Z.0Z.20NN", "0Z/1Z/19NN", "20NN-0Z-1Z 1Z:NN:NN", "1Z:NN", "1Z:NN:NN", "Z,NNN,NNN.NN", "Z.NNN.NNN,NN", "Z NNN NNN", "$NNN.NN", "NN%", "v1.N.NN", "Z.NN.N", "version Z.N.N-rcN", "Version 2.0", "BY-NC 4.0", "NNNNNNNN", "NNNNNNNNNN",
    "NNNNNNNNNNNN", "NNNNNNNNNNNNNNNN", 'token = "HHHHHHHHHHHHHHHHHHHHHHHHHHHHHHHHHHHHHHHH"', "HHHHHHHH-HHHH-4HHH-HHHH-HHHHHHHHHHHH", "sha HHHHHHHHHHHH", "0xHHHHHHHH", "NN x NN = NNNN", "NNN-NNN", "1NNN-1NNN", "pp. NNN-NNN", "No. NNNNN", "no. NNN-NNNNNN", "ISBN 97Z-N-NNN-NNNNN-N", "ISSN NNNN-NNNN", "NN.NNNN, -NN.NNNN",
    "N-N", "N/N", "#NNNN", "@W", "@W_NN", "W@W", "W @ N.N each", "W at W", "W at NN", "W at the dot W", "W (at W)", "look at the W dot", "N + N", "NN NN NN", "NNNN | NNNN | NNNN", "(NNN)", "[NN]", "NN.N.N", "art. NN.N", "W-NNN-NN", "WNN", "SKU NNN-NNN-NN", "ref NNNN/NNNN/NN", "1NNN 1NNN 20NN", "NN kg", "NN°C",
    "order NNN-NNNNNNN-NNNNNNN", "id NNNNNNNNN", "case NN-NNNN", "NN,NN,NN", "Z.Z.Z", "N.N.N.NNNN", "W.W.W", "W . W", "https://W.W/NNNN", "www.W.org", "W.txt", "NNNNNN.NNNN", "NNN.NN.NN-NN",
)


def _filled(r: random.Random, form: str, word) -> str:
    pick = {"N": "0123456789", "Z": "123456789", "H": "0123456789abcdef"}
    parts = re.split(r"(\bW|W\b|W(?=[-.@_N]))", form)
    return "".join(word() if p == "W" else "".join(r.choice(pick[c]) if c in "NZ" or (c == "H" and "HHH" in form) else c for c in p) for p in parts)


def _item(r: random.Random, word) -> tuple[str | None, str, str]:
    """Kind (None: not personal data), cue and text of an item."""
    kind = r.choice((*KINDS, "phone", "email", None, None, None))
    if kind is None:
        return None, "", _filled(r, r.choice(OTHERS), word)
    plain, cue = r.random() < 0.3, r.choice(CUES[kind]) + " " if r.random() < 0.35 else ""
    if kind == "email":
        at, dot = MARKS[0] if plain else r.choice(MARKS)
        local = r.choice((".", "_", "-", "")).join(word() for _ in range(r.choice((1, 1, 2)))) + (f"{r.choice(('', '.'))}{r.randrange(100)}" if r.random() < 0.4 else "")
        labels = [word() + (str(r.randrange(10)) if r.random() < 0.3 else "") for _ in range(r.choice((1, 1, 2)))] + [r.choice(("com", "org", "net", "de", "fr", "es", "io", "co", "edu", "info"))]
        if dot not in (".", " . ", "[.]"):
            local = local.replace(".", dot) if r.random() < 0.5 else local
        return kind, cue, local + at + dot.join(labels)
    if kind == "ip":
        return kind, cue, ("." if plain else r.choice(QUAD_MARKS)).join(str(r.randrange(256)) for _ in range(4))
    if kind == "card":
        sizes = r.choice(((4, 4, 4, 4), (4, 4, 4, 4), (4, 6, 5), (4, 4, 5), (6, 10)))
        digits = "".join(r.choice("0123456789") for _ in range(sum(sizes) - 1))
        digits = r.choice("3456") + digits[1:]
        digits += next(c for c in "0123456789" if passes_luhn(digits + c))
        ends = np.cumsum((0, *sizes))
        return kind, cue, (r.choice(GAPS[:3]) if plain else r.choice(GAPS)).join(digits[a:b] for a, b in zip(ends, ends[1:]))
    if r.random() < 0.15:
        return kind, r.choice(CUES[kind]) + " ", _filled(r, r.choice(CUED_PHONES), word)
    return kind, cue, _filled(r, PHONES[0] if plain else r.choice(PHONES), word)


def labelled_texts(contexts: list[str], n: int, seed: int = 3) -> list[tuple[str, list[Span]]]:
    """``n`` texts with the spans that were written into them, in the words of ``contexts``.

    Items are made by the forms above, with the noise of the corpus around some: tables, marks behind words, capitals.
    """
    r = random.Random(seed)
    sources = [w for w in (c.split() for c in contexts) if w] or [FILLER]
    short = [re.sub(r"\W|\d", "", w).lower() for s in sources for w in s[:40]]
    short = [w for w in short if 1 < len(w) < 12 and w.isascii()] or FILLER[:20]
    word = lambda: r.choice(short)
    out = []
    for _ in range(n):
        source, style = r.choice(sources), r.random()
        tail, gap = (r.choice(("!!", "***", "$$$", "%%%", "&&&", "###")), " ") if style < 0.1 else ("", " | " if style < 0.16 else " ")
        text, spans = "", []
        for _ in range(r.choice((0, 1, 1, 1, 2))):
            at = r.randrange(len(source))
            text += gap.join(w + tail for w in source[at : at + r.randrange(0, 9)]) + gap
            text = text if text.strip() else ""
            kind, cue, item = _item(r, word)
            text += cue + r.choice(("", "", "", "", "(", '"', "<") if kind != "phone" else ("",))
            if kind:
                spans.append((kind, len(text), len(text) + len(item)))
            text += item + (tail or r.choice(("", "", "", ",", ".", ";", ")", "\n"))) + gap
        at = r.randrange(len(source))
        text += gap.join(w + tail for w in source[at : at + r.randrange(0, 9)])
        out.append((text.upper() if r.random() < 0.08 and len(text.upper()) == len(text) else text, spans))
    return out


def _rows(labelled: list[tuple[str, list[Span]]], width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Character ids and tags of one window of each text; long texts are cut anywhere."""
    rng = random.Random(seed)
    ids, tags = np.zeros((len(labelled), width), np.int16), np.zeros((len(labelled), width), np.int64)
    for row, (text, spans) in enumerate(labelled):
        begins = rng.randrange(max(1, len(text) - width + 1))
        piece = text[begins : begins + width]
        ids[row, : len(piece)] = character_ids(piece)
        for kind, a, b in spans:
            a, b = max(0, a - begins), min(len(piece), b - begins)
            if a < b:
                tags[row, a:b] = 2 + 2 * KINDS.index(kind)
                tags[row, a] = 1 + 2 * KINDS.index(kind)
    return ids, tags


def follow() -> tuple[np.ndarray, np.ndarray]:
    """Which tag may follow which, and which may come first: a further character needs one of its kind before it."""
    allowed, first = np.ones((TAGS, TAGS)), np.ones(TAGS)
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        allowed[:, inside] = 0
        allowed[[inside - 1, inside], inside] = 1
        first[inside] = 0
    return allowed, first


def fit(labelled: list[tuple[str, list[Span]]], width: int = 96, seed: int = 5) -> Tagger | None:
    """Trains a tagger on texts and their spans; None without texts."""
    if not labelled:
        return None
    return train(*_rows(labelled, width, seed), *follow(), seed=seed)


#: Pieces of the corpus that training takes its words from, their code points, and how many labelled texts are made.
CONTEXTS, CONTEXT, LABELLED = 400, 400, 16_000


def fit_on(docs: DataFrame, contexts: int = CONTEXTS, labelled: int = LABELLED) -> Tagger | None:
    """A tagger trained on ``labelled`` texts that are made in the words of ``contexts`` pieces of the documents.

    The pieces, of ``CONTEXT`` code points at a place of the id's hash, are all that the driver gets, whatever the table's
    size; where there are none, built-in words serve. Signs in them are cut out, so no data of theirs count as none.
    """
    known = docs.where(F.col("doc_id").isNotNull() & (F.length("text") > 0))
    chosen = F.broadcast(first_by_hash(known.select("doc_id"), ["doc_id"], contexts).distinct())  # at most ``contexts`` rows
    place = F.pmod(F.xxhash64("doc_id"), F.length("text")) + 1
    pieces = known.join(chosen, "doc_id").select("doc_id", F.substring("text", place.cast("int"), F.lit(CONTEXT)).alias("piece"))
    rows = pieces.orderBy(F.xxhash64("doc_id"), "doc_id", "piece").limit(contexts).collect()
    return fit(labelled_texts([re.sub(r"\S*[0-9@]\S*", "", r["piece"]) for r in rows], labelled))


# --- columns ----------------------------------------------------------------------------------------------------------

SPANS = "array<struct<kind:string,start:int,end:int,added:boolean>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("added", pa.bool_())]))


def personal_spans(text: Column, model: Tagger | None) -> Column:
    """The spans of a text by kind and start, in code points, the end exclusive; ``added`` are those of the tagger.

    Null and empty texts have none; without a model there are those of the patterns only.
    """

    @F.arrow_udf(SPANS)
    def spans(texts: pa.Array) -> pa.Array:
        found = find([t.as_py() or "" for t in texts], model)
        return pa.array([[dict(zip(("kind", "start", "end", "added"), s)) for s in row] for row in found], _SPAN)

    return spans(text)


def scan(docs: DataFrame, model: Tagger | None) -> DataFrame:
    """doc_id and spans for each row of ``docs``; repeated rows and null ids stay. Other columns are neither read nor
    returned."""
    return docs.select("doc_id", personal_spans(F.col("text"), model).alias("spans"))


def masked(text: str, spans: list[tuple]) -> str:
    """The text with ``<KIND>`` in place of every span; of spans that overlap, the whole stretch under the first's kind."""
    out, at = [], 0
    for kind, a, b, *_ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, model: Tagger | None) -> DataFrame:
    """``docs`` with all their columns, personal data in the texts replaced by their kinds; null texts stay null."""

    @F.arrow_udf("string")
    def replaced(texts: pa.Array) -> pa.Array:
        values = [t.as_py() for t in texts]
        return pa.array([None if t is None else masked(t, s) for t, s in zip(values, find([t or "" for t in values], model))], pa.string())

    return docs.withColumn("text", replaced(F.col("text")))


def report(docs: DataFrame, contexts: int = CONTEXTS, labelled: int = LABELLED) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (what the patterns find), base_sha256, spans (all, as kind:start:end by kind
    and start) and n_added for each row of ``docs``, with a tagger trained by :func:`fit_on`."""
    rows = scan(docs, fit_on(docs, contexts, labelled))
    own = F.filter("spans", lambda s: ~s["added"])
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.filter(own, lambda s: s["kind"] == kind)
    counts = [F.size(of(k)).cast("bigint").alias(f"n_{k}") for k in KINDS]
    return rows.select("doc_id", *counts, F.sha2(text(own).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda s: s["added"])).cast("bigint").alias("n_added"))
