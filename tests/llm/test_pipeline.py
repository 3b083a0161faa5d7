"""Every stage of the pipeline, on its own input, against a plain version."""

from __future__ import annotations

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import SF
from tests.llm.test_operators import ITEMS, ODD, hits_by_hand, odd, shingles, sorted_rows
from tidebook.llm import bpe, decontamination, quality, secrets
from tidebook.llm.common import materialise


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        made = materialise(stage(spark, docs, SF), f"test-{name}")
        out.append((name, docs, made))
        docs = made
    return {name: (before, after) for name, before, after in out}


def test_order_and_columns(spark, stages):
    assert list(stages) == ["quality", "near-duplicates", "decontamination", "secrets", "encoding"]
    for name, (before, after) in stages.items():
        assert before.columns == ["doc_id", "text", "lang", "source", "n_chars"] and (name == "encoding" or after.columns == before.columns)


def test_quality(spark, stages):
    before, after = stages["quality"]
    scored = quality.score_quality(before, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in scored if r.score >= 0.3} and after.count() < before.count()


def test_near_duplicates(stages):
    """One row, of the smallest id, stays of each group over all pairs of an exact likeness of 0.8 or more."""
    before, after = stages["near-duplicates"]
    rows = sorted((r.doc_id, frozenset(shingles(r.text, 5))) for r in before.collect())
    root = {doc: doc for doc, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(rows):
        for b, y in rows[i + 1 :]:
            if 4 * max(len(x), len(y)) <= 5 * min(len(x), len(y)) and len(x & y) * 5 >= len(x | y) * 4:
                root[max(find(a), find(b))] = min(find(a), find(b))
    assert {r.doc_id for r in after.collect()} == {find(doc) for doc, _ in rows}


def test_decontamination(spark, stages):
    before, after = stages["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {r.doc_id: r.text for r in after.collect()}
    for r in before.collect():
        n_words, n_hit, *_ = hits_by_hand(r.text, items)
        assert (r.doc_id in left) == (n_hit <= 0.5 * max(n_words, 1))
        if n_hit == 0:
            assert left[r.doc_id] == r.text
        elif r.doc_id in left:
            assert hits_by_hand(left[r.doc_id], items)[0] == n_words - n_hit


def test_secrets(stages):
    before, after = stages["secrets"]
    forest = secrets.fit_forest(dictionary_path=public_tokenizers.path("byte_bpe_50k.tiktoken"))
    left = {r.doc_id: r for r in after.collect()}
    for r in before.collect():
        text = r.text
        for s in reversed([s for s in secrets.scored([r.text], [r.source], forest)[0] if s["score"] >= 0.5]):
            text = text[: s["start"]] + "[secret]" + text[s["end"] :]
        assert left[r.doc_id].text == text and left[r.doc_id].n_chars == len(text)


def test_encoding(stages):
    before, after = stages["encoding"]
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    ids = {r.doc_id: list(r.token_ids) for r in after.collect()}
    assert ids == {r.doc_id: encoding.encode_ordinary(r.text) for r in before.collect()}


def test_odd_rows_and_no_rows(spark):
    docs = odd(spark)
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        none = stage(spark, docs.limit(0), SF)
        assert none.count() == 0
        out = stage(spark, docs, SF)
        assert out.count() >= 1 and (name == "encoding" or sorted_rows([out.columns]) == sorted_rows([docs.columns]))
    assert ITEMS and ODD


#: The names of all helper columns of the stages, and names that need quoting.
HELPERS = ("_kept_id", "_Kept_Digest", "_repeated_id", "_simhash_digest", "_decontamination_hit", "_decontamination_hit_key_", "_decontamination_hit_digest_", "_decontamination_hit_spans_", "_decontamination_hit_items_", "_secret_scan_cleaned", "_found", "_text_digest", "_decoded", "_bpe_block", "_bpe_part", "_bpe_row", "_bpe_count", "_bpe_data", "_kept_0", "_text", "_node", "root", "first", "a.b", "c`d")


def test_columns_of_helpers_names_stay(spark):
    docs, own = odd(spark), {}
    for i, name in enumerate(HELPERS):
        docs = docs.withColumn(name, F.lit(f"own {i}"))
        own[name] = f"own {i}"
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        kept = [c for c in docs.columns if c != "text"] + ["token_ids"] if name == "encoding" else docs.columns
        rows = out.collect()
        assert sorted(out.columns) == sorted(kept) and rows
        assert all({n: r[n] for n in own} == own for r in rows)


def test_blocks_of_a_benchmark_keep_columns(spark):
    docs = odd(spark, [(1, "keep this a b c d e f g h i j k l and that " + "more " * 30), *ODD])
    for name in HELPERS:
        docs = docs.withColumn(name, F.lit("own"))
    items = spark.createDataFrame([(i, f"{i} a b c d e f g h i j k l") for i in range(4)], "item_id long, text string")
    out = decontamination.remove_benchmark(docs, items, block_words=20)
    assert out.columns == docs.columns and all(r[n] == "own" for r in out.collect() for n in HELPERS)
    assert out.where("doc_id = 1 AND text LIKE 'keep this%and that%' AND text NOT LIKE '%c d e%'").count() == 1
