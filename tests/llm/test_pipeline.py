"""The pipeline's stages, each held against brute force on its own input."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_near_copies import brute_kept
from tests.llm.test_operators import brute_hits
from tidemark.llm import mixing, quality
from tidemark.llm.storage import materialised, shared_path


@pytest.fixture(scope="module")
def stages(spark, sf):
    """(docs before, rows after) of each stage."""
    docs, out, at = spark.read.parquet(f"{sf}/documents.parquet"), [], shared_path(spark, "test")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = materialised(stage(spark, docs, sf), f"{at}/{k}")
        out.append((docs, after))
        docs = after
    return out


def test_columns(stages):
    for before, after in stages[:-1]:
        assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"] and 0 < after.count()


def test_quality_stage(spark, sf, stages):
    before, after = stages[0]
    model = quality.train(before, spark.read.parquet(f"{sf}/labels.parquet"))
    want = {r.doc_id for r in before.collect() if quality.probability(model, *quality.features((r.text or "").encode())) >= 0.5}
    rows = {r.doc_id: r for r in before.collect()}
    assert {r.doc_id for r in after.collect()} == want and all(r == rows[r.doc_id] for r in after.collect())


def test_duplicate_stage(stages):
    before, after = stages[1]
    rows = {r.doc_id: r for r in before.collect()}
    want = brute_kept([(r.doc_id, r.text) for r in rows.values()])
    got = after.collect()
    assert sorted(r.doc_id for r in got) == want and all(r == rows[r.doc_id] for r in got)


def test_benchmark_stage(spark, sf, stages):
    before, after = stages[2]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = {r.doc_id: r for r in after.collect()}
    for r in before.collect():
        words, hit, _ = brute_hits(r.text, items)
        assert (r.doc_id in kept) == (not (hit and 20 * len(hit) >= len(words)))
        if r.doc_id in kept:
            assert hit or kept[r.doc_id] == r
            assert kept[r.doc_id].n_chars == len(kept[r.doc_id].text)
            assert not brute_hits(kept[r.doc_id].text, items)[1]


def test_mixing_stage(stages):
    before, after = stages[3]
    want = {r.doc_id: r.copies for r in mixing.mix_copies(before).collect() if r.size and r.copies}
    assert Counter(r.doc_id for r in after.select("doc_id").collect()) == Counter(want)


def test_token_stage(stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    before, after = stages[4]
    plain, at = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    texts = sorted((r.doc_id, r.text) for r in before.collect())
    for (doc_id, text), r in zip(texts, after.orderBy("start").collect(), strict=True):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 1]
        assert tuple(r) == (doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_run_is_the_stages(spark, sf, stages):
    assert Counter(map(tuple, corpus_pipeline.run(spark, sf).collect())) == Counter(map(tuple, stages[-1][1].collect()))


def test_stages_take_awkward_rows(spark, docs, sf):
    """Nulls, empty and very long texts, repeats and extra columns pass through every stage."""
    at = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = materialised(stage(spark, at, sf), shared_path(spark, "awkward"))
        assert k == 4 or after.columns == at.columns
        # The first stage's verdict on made-up words does not matter here: all rows go on.
        at = after if k else at
    assert at.count() > 0
    assert at.columns[0] == "doc_id"


@pytest.mark.parametrize("kind", ["string", "int"])
def test_stages_take_other_ids(spark, docs, sf, kind):
    at = docs.withColumn("doc_id", F.col("doc_id").cast(kind))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = materialised(stage(spark, at, sf), shared_path(spark, "ids"))
        assert after.schema["doc_id"].dataType == at.schema["doc_id"].dataType
        at = after if k else at
    assert at.count() > 0


def test_stages_take_nothing(spark, empty, sf):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0
