"""Personal data: patterns against plain expressions, the tagger against hand-written texts, windows against none."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import SF
from tests.llm.test_operators import ODD, odd
from tidebook.llm import pii, queries, taggers

#: Written by hand, and by none of the forms that make the labelled texts: a text, the kind and the span.
FOUND = [
    ("please write to jane.doe (at) acme (dot) org before friday", "email", "jane.doe (at) acme (dot) org"),
    ("Reach me: bob[at]mail[dot]example[dot]com thanks", "email", "bob[at]mail[dot]example[dot]com"),
    ("send it to anna at example dot com please", "email", "anna at example dot com"),
    ("you can mail john.smith42 [at] company.co if needed", "email", "john.smith42 [at] company.co"),
    ("contact: info @ shop.example.org today", "email", "info @ shop.example.org"),
    ("his address is m.weber(at)uni-bonn.de and", "email", "m.weber(at)uni-bonn.de"),
    ("write me at sam@mail[.]example[.]net ok", "email", "sam@mail[.]example[.]net"),
    ("MAIL: KATE (AT) EXAMPLE (DOT) COM", "email", "KATE (AT) EXAMPLE (DOT) COM"),
    ("support{at}helpdesk{dot}io answers", "email", "support{at}helpdesk{dot}io"),
    ("the host 10[.]0[.]12[.]7 was down", "ip", "10[.]0[.]12[.]7"),
    ("we saw 192 . 168 . 1 . 20 in the log", "ip", "192 . 168 . 1 . 20"),
    ("ping 8[dot]8[dot]4[dot]4 first", "ip", "8[dot]8[dot]4[dot]4"),
    ("from 203(.)0(.)113(.)9 again", "ip", "203(.)0(.)113(.)9"),
    ("card 4111.1111.1111.1111 expires", "card", "4111.1111.1111.1111"),
    ("he paid with 5500/0000/0000/0004 and left", "card", "5500/0000/0000/0004"),
    ("visa 4012_8888_8888_1881 ok", "card", "4012_8888_8888_1881"),
    ("number 3782 - 822463 - 10005 is his", "card", "3782 - 822463 - 10005"),
    ("use 4242  4242  4242  4242 for tests", "card", "4242  4242  4242  4242"),
    ("call (212) 555-0187 after six", "phone", "(212) 555-0187"),
    ("my number is 415-555-2671, ask for Al", "phone", "415-555-2671"),
    ("tel. 030/1234567 Berlin", "phone", "030/1234567"),
    ("Telefon 0171 5557713 abends", "phone", "0171 5557713"),
    ("appelez le 06 12 34 56 78 demain", "phone", "06 12 34 56 78"),
    ("fax: 0044 20 7946 0958.", "phone", "0044 20 7946 0958"),
    ("dial 1-800-555-0199 now", "phone", "1-800-555-0199"),
    ("text me on 212.555.0134 or", "phone", "212.555.0134"),
    ("ring 020 7946 0991 and wait", "phone", "020 7946 0991"),
    ("mobile 555 867 5309 works", "phone", "555 867 5309"),
    ("Kontakt: petra.k (at) firma (dot) de, danke", "email", "petra.k (at) firma (dot) de"),
    ("escriba a luis at correo dot es hoy", "email", "luis at correo dot es"),
    ("old address was tom_b[at]host.net and", "email", "tom_b[at]host.net"),
    ("reply to: sue @ mail.example.com.", "email", "sue @ mail.example.com"),
    ("route via 172[.]16[.]254[.]1 only", "ip", "172[.]16[.]254[.]1"),
    ("server 10 . 20 . 30 . 40 answered", "ip", "10 . 20 . 30 . 40"),
    ("his Karte 4539/1488/0343/6467 was lost", "card", "4539/1488/0343/6467"),
    ("tarjeta 6011.0009.9013.9424 caduca", "card", "6011.0009.9013.9424"),
    ("Tel: (030) 9876 5432 werktags", "phone", "(030) 9876 5432"),
    ("llame al 0034 912 345 678 ya", "phone", "0034 912 345 678"),
    ("numéro 01-44-55-66-77 à Paris", "phone", "01-44-55-66-77"),
    ("office 646-555-0143 or home 646-555-0177", "phone", "646-555-0177"),
    ("WhatsApp 0176/4455667 bitte", "phone", "0176/4455667"),
    ("call me at 1 (303) 555-0166", "phone", "1 (303) 555-0166"),
]
#: Texts without personal data.
CLEAN = [
    "on 2021-05-12 10:30:45 the job ended",
    "version 2.0.1 of the Apache License, Version 2.0",
    "the total was 1,234,567.89 dollars",
    "see pages 100-200 and 345-678",
    "between 1990 and 1995, or 1999-2004",
    'token = "0b96a8c8d79c4a5085c919698889f59b72ab7bb6"',
    "meet at noon at the dot on the map",
    "look at the dot com boom of 1999",
    "follow @ann_smith on the site",
    "3 apples @ 2.50 each, 12 pears",
    "build 20210512.1234 passed",
    "id 123e4567-e89b-12d3-a456-426614174000",
    "he scored 12, 15, 17 and 20 points",
    "ISBN 978-3-16-148410-0 was printed",
    "12 x 34 = 408 and 7 x 8 = 56",
    "coordinates 48.8584, 2.2945 in Paris",
    "the year 2001, 2002, 2003, 2004",
    "10 000 000 people live there",
    "invoice 4711-0815 is open",
    "Licensed under CC BY-NC 4.0.",
    "section 3.2.1 and table 4.5.6",
    "run at 12:30:15.250 on 01.02.2003",
    "0x7fff5fbff8c0 is the address",
    "order 9807915762804490 shipped",
    "rows 12 | 345 | 6789 | 10",
    "temperature was -12.5 at 6:00 and 7.5 at 12:00",
    "we were at home and at work",
    "a ratio of 3:2 or 16:9",
    "pi is 3.14159265358979 about",
    "phone me later today",
    "chapter 12 verse 34",
    "$1,200.00 per month",
    "the at sign and the dot",
    "user at host said hello",
    "sha256 e3b0c44298fc1c149afbf4c8996fb924",
    "lot 123-45 and part 67-890",
    "won 3-1 and 2-0 on 14/07/2019",
    "serial AB-123-456-789 was stamped",
    "the 2nd, 3rd and 14th of May",
    "5 + 7 = 12 and 100 - 58 = 42",
    "flight LH 1234 at gate 56",
    "from 9 at night to 6 at dawn",
    "posted by @tom99 and @eva",
    "price: 49.99 or 3 for 120.00",
    "ip law and card games by phone",
    "1. one 2. two 3. three 4. four 5. five",
    "he was at the dot when it rang",
    "bytes 00 01 02 03 ff fe",
    "kernel 5.15.0-91-generic on x86_64",
    "row 17, seat 42, block 103",
    "2020 2021 2022 2023 2024 were dry",
    "DIN 5008, RFC 2616 and ISO 8601",
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d // 10 + d % 10
    return total % 10 == 0


def by_pattern(text):
    """The patterns as they are stated, whatever their cost."""
    def all_of(pattern, sound):
        return [m.span() for m in re.finditer(pattern, text) if sound(m.group())]

    number = lambda s: re.sub("[^0-9]", "", s)
    found = {
        "email": all_of(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": all_of(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": all_of(r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(number(s)) <= 19 and luhn(number(s))),
        "phone": all_of(r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(number(s)) <= 15),
    }
    return [(kind, a, b) for kind in ("email", "ip", "card", "phone") for a, b in found[kind]]


@settings(max_examples=600, deadline=None)
@given(st.one_of(
    st.text(st.sampled_from("ab1@.-_ é%+\n"), max_size=40), st.text(st.sampled_from("0125. "), max_size=40), st.text(st.sampled_from("0123456789 -"), min_size=10, max_size=60), st.text(st.sampled_from("+0123 ().-x"), max_size=50),
))
def test_patterns(text):
    assert pii.base_spans(text) == by_pattern(text)


def test_patterns_on_planted_items():
    rng = random.Random(8)
    for _ in range(400):
        card = "".join(rng.choice("0123456789") for _ in range(rng.randint(11, 20)))
        items = ["a.b@c-d.e.f", "x@y", "@z.w", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "01.02.003.0004", card, "-".join(card), " ".join(card), "+1 (017) 555-7713", "+12345678", "+1+2 345 678 90", "++49 30 1234567)", "4111 1111 1111 1111"]
        text = "".join(rng.choice(items) + rng.choice(["", " ", ".", "-", "@", "\n", "é", ", "]) for _ in range(rng.randint(1, 8)))
        assert pii.base_spans(text) == by_pattern(text)


def test_patterns_are_read_once():
    """Texts that take a backtracking search forever."""
    for piece in ("a", "1", "1.", "1 ", "+1", "a.", "@a", "a@", "+1("):
        pii.base_spans(piece * 300_000)
    assert pii.base_spans("a" * 300_000 + "@b.c") == [("email", 0, 300_004)]


# --- the network ------------------------------------------------------------------------------------------------------


def small_model(seed=0, hidden=4):
    model = taggers.fresh(*pii.follow(), hidden, np.random.default_rng(seed))
    return taggers.Tagger(*(np.array(x, float) for x in (*model.learned().values(), model.allowed, model.allowed_first)))


def test_slopes_are_those_of_the_loss():
    model, rng = small_model(), np.random.default_rng(1)
    ids, tags = pii._rows(pii.labelled_texts([], 5, 1), 24, 1)
    slopes = taggers.loss_and_slopes(model, ids, tags)[1]
    for name, value in model.learned().items():
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in value.shape)
            if name == "inputs":
                at = (at[0], int(ids[0, 5]), at[2])
            kept, sides = value[at], []
            for step in (1e-5, -1e-5):
                value[at] = kept + step
                sides.append(taggers.loss_and_slopes(model, ids, tags)[0])
            value[at] = kept
            assert abs((sides[0] - sides[1]) / 2e-5 - slopes[name][at]) < 1e-6


def test_best_tags_and_marginals_are_those_of_all_sequences():
    model = small_model(3)
    model.moves[:] = np.random.default_rng(2).normal(size=model.moves.shape)
    ids = taggers.character_ids("a1@b")[None]
    scores = taggers.scores_of(model, ids)
    weighed = {}
    for way in itertools.product(range(pii.TAGS), repeat=4):
        if model.allowed_first[way[0]] and all(model.allowed[a, b] for a, b in zip(way, way[1:])):
            weighed[way] = model.first[way[0]] + sum(scores[t, 0, k] for t, k in enumerate(way)) + sum(model.moves[a, b] for a, b in zip(way, way[1:]))
    assert tuple(taggers.best_tags(model, scores)[:, 0]) == max(weighed, key=weighed.get)
    total = np.logaddexp.reduce(list(weighed.values()))
    want = np.zeros((4, pii.TAGS))
    for way, w in weighed.items():
        want[np.arange(4), way] += np.exp(w - total)
    np.testing.assert_allclose(taggers.marginals(model, scores)[:, 0], want, atol=1e-9)
    loss = taggers.loss_and_slopes(model, ids, np.array([[0, 1, 2, 0]]))[0]
    assert abs(loss - (total - weighed[0, 1, 2, 0])) < 1e-9


# --- the tagger -------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model(spark):
    """As the registered query trains it, on another table than the texts below."""
    return pii.fit_on(spark.read.parquet(f"{SF}/documents.parquet"))


def test_hand_written_texts(model):
    spans = pii.find([t for t, _, _ in FOUND], model)
    hits = [any(s[:3] == (kind, t.index(v), t.index(v) + len(v)) and s[3] for s in found) for (t, kind, v), found in zip(FOUND, spans)]
    false = [t for t, found in zip(CLEAN, pii.find(CLEAN, model)) if any(s[3] for s in found)]
    assert not any(by_pattern(t)[:1] == [(k, t.index(v), t.index(v) + len(v))] for t, k, v in FOUND)
    assert sum(hits) >= 0.9 * len(FOUND), [t for (t, _, _), hit in zip(FOUND, hits) if not hit]
    assert len(false) <= 0.05 * len(CLEAN), false


def test_labelled_texts_that_were_not_learned(model):
    held = pii.labelled_texts([], 600, seed=77)
    want = {(i, *s) for i, (_, spans) in enumerate(held) for s in spans}
    got = {(i, *s[:3]) for i, found in enumerate(pii.find([t for t, _ in held], model)) for s in found}
    assert len(want & got) >= 0.9 * len(want) and len(want & got) >= 0.9 * len(got)


def test_found_wherever_windows_end(model):
    item = "ann.lee (at) example (dot) org"
    words = "the plan of this year was sent to all who had asked for it and then put on file with the others some of them were late but most came in time and we thank you "
    for before in range(0, 400, 7):
        text = (words * 4)[:before] + " write to " + item + " soon " + words * 3
        at = text.index(item)
        assert [s for s in pii.find([text], model)[0] if s[3]] == [("email", at, at + len(item), True)], before


def test_windows_without_signs_need_not_be_decoded(spark, model):
    texts = [t for t, _, _ in FOUND] + CLEAN + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()] + [" ".join(t for t, _, _ in FOUND)]
    assert pii.find(texts, model) == pii.find(texts, model, every=True)
    assert sum(len(pii.windows_of(t)) for t in texts[-60:-1]) < 0.2 * sum(len(pii.windows_of(t, True)) for t in texts[-60:-1])


def test_reconciled_windows():
    text = "x" * 400
    a, b, c = ("phone", 70, 80), ("phone", 75, 95), ("email", 90, 100)
    # a and b overlap, b and c too: a and c together weigh more
    sound, pii.is_sound = pii.is_sound, lambda kind, text: True
    try:
        found = [[(a, 0.8), (b, 0.9), (c, 0.7)], [(a, 0.8), (b, 0.9), (c, 0.7)]]
        assert pii.reconciled(text, [], found, {0, 64}) == [a, c]
        assert pii.reconciled(text, [("card", 79, 91)], found, {0, 64}) == []
        assert pii.reconciled(text, [], [[(a, 0.9)], []], {0, 64}) == []  # one of two windows doesn't see it
        assert pii.reconciled(text, [], [[(a, 0.9)], [(a, 0.2)]], {0, 64}) == [a]
    finally:
        pii.is_sound = sound


# --- rows -------------------------------------------------------------------------------------------------------------


def shown(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def check_rows(rows, model):
    """Rows of a report against the patterns as stated and the tagger over all windows."""
    for text, r in rows:
        base = by_pattern(text or "")
        every = [s[:3] for s in pii.find([text or ""], model, every=True)[0]]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in base) for k in pii.KINDS)
        assert r.base_sha256 == hashlib.sha256(shown(base).encode()).hexdigest() and r.spans == shown(every)
        assert set(base) <= set(every) and r.n_added == len(every) - len(base)


def test_the_query(spark, model):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op13_pii(spark, SF).collect()
    assert len(got) == len(texts) and sum(len(by_pattern(t or "")) for t in texts.values()) > 3
    check_rows([(texts[r.doc_id], r) for r in got], model)


def test_odd_rows_and_clashing_columns(spark):
    docs = odd(spark, [*ODD, (6, "call 212-555-0134 or a@b.c"), (6, "call 212-555-0134 or a@b.c")])
    for name in ("spans", "piece", "added", "kind", "n_email"):
        docs = docs.withColumn(name, F.lit("own"))
    got = pii.report(docs, labelled=64)
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]
    rows = got.collect()
    assert len(rows) == len(ODD) + 2 and [r.n_email for r in rows if r.doc_id == 6] == [1, 1]
    assert {(r.n_email, r.spans) for r in rows if r.doc_id in (None, 1)} == {(0, "")}
    assert pii.report(docs.limit(0), labelled=64).count() == 0


def test_masks(spark, model):
    docs = odd(spark, [(1, "call (212) 555-0187 after six, or a.b@c.de!"), (2, None), (3, "")])
    got = {r.doc_id: r for r in pii.mask(docs, model).collect()}
    assert got[1].text == "call <PHONE> after six, or <EMAIL>!" and got[2].text is None and got[3].text == "" and got[1].token == "own"
    assert pii.masked("abcdef", [("ip", 1, 4), ("card", 2, 5)]) == "a<IP>f"
