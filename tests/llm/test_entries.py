"""The registered queries: columns, types, and what the learned ones get right on documents kept out of learning."""

import numpy as np
import pytest

from tidemark.llm import entries

WANT = {
    "op1_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op2_token_files": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op3_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op4_media": {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"},
    "op5_url_filter": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op6_decontaminate": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    "op7_warc": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op8_line_dedup": {"doc_id": "bigint", "n_lines": "bigint", "n_dropped": "bigint", "kept_sha256": "string"},
    "op9_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op10_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
}


@pytest.mark.parametrize("name", sorted(WANT))
def test_query(spark, sf, name):
    got = entries.QUERIES[name](spark, sf)
    assert WANT[name].items() <= dict(got.dtypes).items()
    key = next(iter(WANT[name]))
    table = spark.read.parquet(f"{sf}/{'pages' if key == 'page_id' else 'documents'}.parquet")
    found = sorted(r[0] for r in got.select(key).collect())
    assert found == sorted(r[0] for r in table.select(key).collect())


def test_languages_of_held_out_documents(spark):
    at = "/root/testdata/sf0.01"
    got = entries.op3_language(spark, at).where("held_out").join(spark.read.parquet(f"{at}/documents.parquet").where("lang is not null").select("doc_id", "lang"), "doc_id").collect()
    assert len(got) > 250 and sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97


def test_quality_of_held_out_documents(spark):
    at = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{at}/labels.parquet").where("quality is not null").select("doc_id", "quality")
    got = entries.op9_quality(spark, at).where("held_out").join(labels, "doc_id").collect()
    good, bad = (np.array([r.score for r in got if r.quality == k]) for k in (1, 0))
    assert len(good) > 50 and len(bad) > 5
    assert (good[:, None] > bad).mean() > 0.95 and np.mean([r.predicted == r.quality for r in got]) > 0.9
