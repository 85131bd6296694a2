"""Two tokenizers aligned by segments, against whole texts tokenised and aligned one by one."""

import hashlib
import itertools
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm import entries, token_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "a  b", " a", "  a", "a ", "a  ", " ", "   ", "\n", "a\n b", "a \n b", "a\n\n  b c", "a\tb \t c", "a\xa0 b\xa0\xa0 c à b", "à é ", "x<|endoftext|> y <s> </s> <0x0A>", "a▁b", "a ▁ b", "▁", "a\x00b c",
    "１２ ３", "日本語 の テキスト。 これは", "👩‍👩‍👧 ok 👍🏽 👍", "é́ ﬁ", "it's we'll 123 4567 don't", "​ x  y　 z", "ßẞ ſ ŉ", "a" * 3000 + " " + "é" * 500, "<unk> x", "x\r\n y\x0b z\x1f q", "!!! ... ??? ----", "1 2  3   4    5", "﻿x �",
]


def by_hand(texts):
    """Per text: tokens, groups, links, digest and pairs, each text as a whole."""
    a, b = token_alignment.ByteLevel(A), token_alignment.Pieces(B)
    made, in_docs = [], Counter()
    for text in texts:
        ids = [t.encode(" " + text) if text else [] for t in (a, b)]
        if any(b"".join(t.entries[k] for k in found) != (" " + text).encode() for t, found in zip((a, b), ids)) if text else True:
            made.append(([], [], [], Counter()))
            continue
        ends = [{e: n for n, e in enumerate(itertools.accumulate(len(t.entries[k]) for k in found), 1)} for t, found in zip((a, b), ids)]
        both, groups = sorted(ends[0].keys() & ends[1].keys()), []
        start = [0, 0]
        for end in both:
            stop = [e[end] for e in ends]
            groups.append(tuple(found[s:e] for found, s, e in zip(ids, start, stop)))
            start = stop
        links = Counter()
        for x, y in groups:
            links.update((i, j) for i in x for j in y)
        in_docs.update(links.keys())
        made.append((*ids, groups, links))
    most = defaultdict(int)
    for (i, _), n in in_docs.items():
        most[i] = max(most[i], n)
    out = []
    for x, y, groups, links in made:
        shown = ";".join(f"{','.join(map(str, i))}|{','.join(map(str, j))}" for i, j in groups)
        best = sum(n for (i, j), n in links.items() if in_docs[i, j] == most[i])
        total = sum(n * in_docs[p] for p, n in links.items())
        out.append((len(x), len(y), len(groups), sum(links.values()), best, total, hashlib.sha256(shown.encode()).hexdigest() if groups else ""))
    return out, [g for _, _, g, _ in made]


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_cuts_are_proved():
    a, b = token_alignment.ByteLevel(A), token_alignment.Pieces(B)
    cuts = token_alignment.Cuts(a, b)
    assert cuts.never <= {" ", "\xa0"} and not cuts.bytes
    for text in ODD:
        found = cuts.segments(text)
        assert " ".join(found) == text
        for t in (a, b):
            assert [k for s in found for k in t.encode(" " + s)] == t.encode(" " + text), text


def test_entries_that_span_spaces_forbid_cuts():
    class Made:
        entries = [b"x y", "é ".encode(), b"\x99 z", b" a"]

    cuts = token_alignment.Cuts(Made())
    assert cuts.never == {"x", "é"} and cuts.bytes == {0x99}
    assert cuts.segments("ax b é c d") == ["ax b", "é c", "d"]
    assert cuts.segments("e’ f g") == ["e’ f", "g"]
    assert cuts.segments("a b ") == ["a", "b "]


def test_groups_of_many_tokens():
    """Links of a large group are counted, not listed: the same either way."""
    import numpy as np

    stream = np.array([2, 4, 2, 2, 3, 5, 5, 8, 9], "<i4")
    found = []
    for most in (1 << 12, 2):
        old, token_alignment.LARGE = token_alignment.LARGE, most
        try:
            entries_ = token_alignment.Entries(np.array([0]), np.array([len(stream)]), stream)
            pair, links, ends = entries_.pairs()
        finally:
            token_alignment.LARGE = old
        total = Counter()
        for p, n in zip(pair.tolist(), links.tolist()):
            total[p] += n
        found.append(total)
        assert entries_.links.tolist() == [13] == [sum(total.values())] and ends.tolist() == [len(pair)]
        assert entries_.texts() == [b"1,2,1,1|1,2,2;4|4"] and entries_.groups.tolist() == [2]
    assert found[0] == found[1] and found[0][(1 << 32) + 2] == 6


@pytest.mark.parametrize("chunk", [60, 1 << 24])
def test_against_whole_texts(spark, chunk):
    texts = [*ODD, None, "", *ODD[:5]] + [" ".join(ODD[k % len(ODD)] for k in range(j, j + 3)) for j in range(0, len(ODD), 4)]
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id int, text string, codes string").repartition(3)
    got = token_alignment.report(docs, A, B, chunk)
    assert got.schema["doc_id"].dataType.simpleString() == "int"
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in got.collect()}
    want, _ = by_hand(texts)
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        assert got[k] == want[k], repr(t)


def test_groups_themselves(spark):
    docs = spark.createDataFrame(list(enumerate([*ODD, None])), "doc_id long, text string").repartition(2)
    got = {r.doc_id: [(list(g.a), list(g.b)) for g in r.groups] for r in token_alignment.alignments(docs, A, B).collect()}
    assert got == dict(enumerate([[(list(i), list(j)) for i, j in g] for g in by_hand([*ODD, None])[1]]))


def test_other_ids_repeats_and_no_rows(spark, docs, rows, empty):
    got = token_alignment.report(docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")), A, B, 5000).collect()
    want, _ = by_hand([r[1] for r in rows])
    name = lambda k: None if k is None else f"d{k}"
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(repr((name(r[0]), *w)) for r, w in zip(rows, want))
    assert token_alignment.report(empty, A, B).count() == 0 == token_alignment.alignments(empty, A, B).count()


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        token_alignment.ByteLevel(public_tokenizers.path("word_bpe_49k.json"))


def test_query(spark, sf):
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want, _ = by_hand([r.text for r in texts])
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in entries.op13_token_alignment(spark, sf).collect()}
    assert got == {r.doc_id: w for r, w in zip(texts, want)}
