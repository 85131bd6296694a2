"""The divergence audit against counts by hand, and its SQL."""

import re
from collections import Counter, defaultdict

import duckdb
import pytest

from tidemark.llm import divergence, entries

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_hand(rows, least: int, top: int):
    """Dense: every kept term of every group, by the definition."""
    counts, docs, groups = Counter(), Counter(), defaultdict(set)
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        found = Counter(TERM.findall((text or "").translate(LOWER)))
        docs.update((lang, t) for t in found)
        for t, n in found.items():
            counts[lang, source, t] += n
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for (x, t), n in docs.items() if x == lang and n >= least)
        share = lambda of: {t: 1 + 10**9 * (of[t] + 5) // (sum(of.values()) + 5 * len(kept)) for t in kept}  # noqa: B023, E731
        of = {s: {t: counts[lang, s, t] for t in kept} for s in sources}
        p, q = {s: share(of[s]) for s in sources}, share({t: sum(of[s][t] for s in sources) for t in kept})
        ranked = lambda found: enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode())), 1)
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            out += [(lang, s, "pair", o, v, k) for k, (o, v) in ranked(pairs)]
            terms = [(t, p[s][t] - q[t]) for t in kept if of[s][t] and p[s][t] > q[t]]
            out += [(lang, s, "term", t, v, k) for k, (t, v) in ranked(terms) if k <= top]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("least, top", [(1, 5), (3, 50), (1000, 5)])
def test_against_counts_by_hand(docs, rows, least, top):
    more = [(60, "ÄÖ äö ÄÖ Zebra_zebra[zebra]", None, "src0", 1), (61, "Zebra \x00 zebra", None, None, 1), (62, "1 2 3", "xx", "only", 1)]
    more = more * 3
    both = docs.select("doc_id", "text", "lang", "source", "size", "key", "n").unionByName(docs.sparkSession.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long"), allowMissingColumns=True)
    assert found(divergence.audit(both, least, top)) == by_hand([*rows, *more], least, top)


def test_many_sources_with_shared_and_own_terms(spark, empty):
    """Terms of both sources, of one, and of neither."""
    rows = [(k, " ".join(f"{'abcdefgh'[(k * j) % 8]}{'uvw'[j % 3]}" for j in range(k % 9)) + " common", "en", f"s{k % 7}", 1) for k in range(80)]
    made = spark.createDataFrame(rows, empty.schema).repartition(5)
    assert found(divergence.audit(made, 4, 3)) == by_hand(rows, 4, 3)


def test_no_rows_and_no_pairs(spark, empty):
    assert found(divergence.audit(empty)) == []
    one = spark.createDataFrame([(1, "a b a", "en", "s", 1)], empty.schema)
    assert found(divergence.audit(one, 1)) == by_hand([(1, "a b a", "en", "s", 1)], 1, 50) == []


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(divergence, "LONG", 10)
    text = "abcdefghijklmnop qr stu   vwxyz" * 3 + "x" * 40
    parts = list(divergence._cut(text))
    assert "".join(parts) == text and len(parts) > 3
    assert [t for p in parts for t in TERM.findall(p)] == TERM.findall(text)
    assert list(divergence._cut("x" * 100)) == ["x" * 100]


def test_counts_pass_on_when_too_many_are_held(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(divergence, "HELD", 3)
    monkeypatch.setattr(divergence, "SLICE", 4)
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 6), pa.array(["s", "t"] * 3), pa.array(["a b", "c d", "a b", "e f", "a g", "d"])], ["lang", "source", "text"])
    got = pa.Table.from_batches(divergence.count_terms(iter([batch]))).to_pylist()
    total = Counter()
    for r in got:
        total[r["source"], r["term"]] += r["n"]
    assert total == {("s", "a"): 3, ("s", "b"): 2, ("s", "g"): 1, ("t", "c"): 1, ("t", "d"): 2, ("t", "e"): 1, ("t", "f"): 1} and len(got) > 7


def test_query_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    got = entries.op12_divergence(spark, sf)
    assert dict(got.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}
    assert found(got) == sorted(con.execute(entries.ORACLE_SQL["op12_divergence"]).fetchall())
