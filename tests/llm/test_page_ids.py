"""Pages with ids of several types, clashing columns and repeated rows."""

import hashlib
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.llm import url_filter, warc

NAMES = {
    "string": lambda k: ["", "a b/ü?>", "%", "10", "9"][k] if k < 5 else f"p{k:03d}",
    "int": lambda k: k * 7 - 20,
    "decimal(12,2)": lambda k: Decimal(k) / 4 - 2,
}
CLASH = ("digest", "captured", "first", "run", "path", "at", "f", "w", "host", "score", "rule", "a.b")


def pages(spark, kind):
    name = NAMES[kind]
    rows = [(name(k), f"http://h{k % 3}.org/{k % 2}", "same page " * 200 if k % 4 == 0 else f"<p>{k}") for k in range(30)]
    rows += [(None, None, None), (None, "http://h0.org/", "same page " * 200), (name(8), "http://h2.org/0", "same page " * 200), (name(3), "x", "")]
    made = spark.createDataFrame(rows, f"page_id {kind}, url string, html string")
    return rows, made.select("*", *[F.lit("clash").alias(c) for c in CLASH]).repartition(3)


@pytest.mark.parametrize("kind", sorted(NAMES))
def test_archives_keep_the_type_of_ids(spark, tmp_path, kind):
    rows, made = pages(spark, kind)
    got = warc.archive(made, folder=f"file://{tmp_path}/w")
    assert got.schema["page_id"].dataType.simpleString() == kind == got.schema["refers_to"].dataType.simpleString()
    ids = [k for k, _, html in rows if (html or "").startswith("same") and k is not None]
    top, want = max(ids, key=lambda k: k.encode() if isinstance(k, str) else k), Counter()
    for k, _, html in rows:
        data = (html or "").encode()
        again = len(data) >= 1000 and k != top
        want[k, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", top if again else None] += 1
    assert Counter(map(tuple, got.collect())) == want
    history = spark.read.parquet(f"file://{tmp_path}/w/_history")
    assert history.schema["page_id"].dataType.simpleString() == kind and history.count() == len(rows)


@pytest.mark.parametrize("kind", sorted(NAMES))
def test_urls_are_judged_whatever_the_ids(spark, kind):
    rows, made = pages(spark, kind)
    got = url_filter.judge(made)
    assert got.schema["page_id"].dataType.simpleString() == kind
    assert Counter((r.page_id, r.rule) for r in got.collect()) == Counter((k, "org/" if u and u.startswith("http://h") else None) for k, u, _ in rows)
