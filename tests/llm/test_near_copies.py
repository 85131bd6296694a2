"""The pipeline's near-duplicates stage on planted copies, against brute force over 5-word shingle sets."""

import random
from collections import Counter

import numpy as np

import corpus_pipeline
from tests.llm.conftest import prose
from tidemark.llm import near_copies


def brute_kept(made, least=0.8):
    """Smallest doc_id of each component."""
    sets = {}
    for k, text in made:
        words = (text or "").lower().split()
        sets[k] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted({find(k) for k in root})


def edited(seed, words, n):
    """n single words replaced, far from each other."""
    r, out = random.Random(seed), list(words)
    for at in r.sample(range(3, len(words) - 3, 7), n):
        out[at] = f"other{seed}"
    return " ".join(out)


def stage(spark, made):
    docs = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    return sorted(r.doc_id for r in corpus_pipeline.one_of_each(spark, docs, "").collect())


def test_planted_copies_between_08_and_097(spark):
    made = []
    for k in range(40):
        words = prose(1000 + k, 300).split()
        made += [(10 * k, " ".join(words))] + [(10 * k + j, edited(j, words, n)) for j, n in ((1, 1), (2, 5), (3, 6), (4, 9), (5, 14))]
    want = brute_kept(made)
    assert 80 <= len(want) < 160
    assert stage(spark, made) == want


def test_large_group_of_loose_copies(spark):
    """More than a band's all-pairs limit, with copies of copies that only some of the group reach."""
    words = prose(7, 120).split()
    made = [(k, edited(k, words, k % 6)) for k in range(6 * near_copies.PAIRS_UP_TO)] + [(1000 + k, prose(k, 120)) for k in range(20)]
    want = brute_kept(made)
    assert len(want) > 30
    assert stage(spark, made) == want


def test_stage_on_the_documents(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = brute_kept([tuple(r) for r in rows])
    assert stage(spark, rows) == want and len(want) < len(Counter(r.text for r in rows))


def test_awkward_rows(spark):
    long = prose(99, 20_000)
    made = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "ONE  two"), (6, "one"), (7, long), (8, long + " end"), (9, "a b c d e"), (9, "a b c d e")]
    assert stage(spark, made) == [1, 4, 6, 7, 9]


def test_candidates_share_golay_keys():
    """Equal exact parts and segments at most two bits apart share a key; pairs at about 0.8 share one, unlike texts none."""
    r = np.random.default_rng(3)
    exact = r.integers(0, 1 << 63, (500, near_copies.BANDS), np.uint64)
    words = r.integers(0, 1 << 23, (500, near_copies.BANDS))
    near = words ^ (1 << r.integers(0, 23, words.shape)) ^ (1 << r.integers(0, 23, words.shape))
    a, b = (set(zip(*(x.tolist() for x in near_copies.golay_keys(exact, w)))) for w in (words, near))
    assert {row for _, row in a & b} == set(range(500)) and len(a) <= 6 * words.size
    for k in range(20):
        text = prose(k, 300).split()
        sets = [near_copies.shingles(t.encode(), 5) for t in (" ".join(text), edited(k, text, 6), prose(1000 + k, 300))]
        bits = [np.bitwise_count((near_copies.segments(sets[0]) ^ near_copies.segments(x)).astype(np.uint32)).sum() / (23 * near_copies.BANDS) for x in sets[1:]]
        assert bits[0] < 0.25 and 0.4 < bits[1] < 0.6
