"""Watermarks, seeks and SQL text: no session."""

import dataclasses
import json
from datetime import datetime
from decimal import Decimal

import pytest
from hypothesis import given
from hypothesis import strategies as some

from tidemark import spec as sp
from tidemark.functions import sqltext, watermark
from tidemark.operators import seek
from tidemark.plans.pipeline import groups, is_auth_error
from tidemark.plans.validate import findings

ORDERS = sp.TargetSpec("orders", "SELECT ORDER_ID, UPDATED_AT, AMOUNT FROM ORDERS WHERE /*WM*/", "T_ORDERS", "UPDATED_AT", ("ORDER_ID",), pageSize=10_000)


@pytest.mark.parametrize("last, lookback, first, want", [
    (None, None, True, "1970-01-01 00:00:00.000000"),
    (None, 15, True, "1970-01-01 00:00:00.000000"),
    ("2025-11-03 18:20:07", None, True, "2025-11-03 18:20:07.000000"),
    ("2025-11-03 18:20:07", 95, True, "2025-11-03 16:45:07.000000"),
    ("2024-03-01 00:10:00", 20, True, "2024-02-29 23:50:00.000000"),
    ("2025-11-03 18:20:07", 95, False, "2025-11-03 18:20:07.000000"),
    ("2025-11-03 18:20:07.987654", 1, True, "2025-11-03 18:19:07.000000"),
    ("2025-11-03 18:20:07", 0, True, "2025-11-03 18:20:07.000000"),
])
def test_effective_watermark(last, lookback, first, want):
    spec = dataclasses.replace(ORDERS, lookbackMinutes=lookback)
    held = watermark.parse(last, sp.TIMESTAMP) if last else None
    assert watermark.render(watermark.effective(spec, held, first)) == want


@pytest.mark.parametrize("text", ["2026-04-17", "2026-04-17T10:00:00", "2026-04-17 10:00:00.1234567", "", "x"])
def test_timestamp_text_is_strict(text):
    with pytest.raises(ValueError):
        watermark.parse(text, sp.TIMESTAMP)


def test_number_watermarks():
    assert watermark.render(watermark.parse("90071992547409931", sp.NUMBER)) == "90071992547409931"
    assert watermark.render(Decimal("1.50")) == "1.5"
    with pytest.raises(ValueError):
        watermark.parse("7,5", sp.NUMBER)


@given(some.datetimes(min_value=datetime(1900, 1, 1), max_value=datetime(2100, 1, 1)))
def test_timestamps_round_trip(at):
    assert watermark.parse(watermark.render(at), sp.TIMESTAMP) == at


def test_first_page_predicate():
    assert seek.after(ORDERS, datetime(2026, 4, 17)) == "UPDATED_AT > CAST('2026-04-17 00:00:00.000000' AS timestamp_ntz)"


def test_seek_expands_all_keys():
    spec = dataclasses.replace(ORDERS, keyColumns=("A", "B"))
    text = seek.after(spec, datetime(2026, 4, 17), (1, None), {"A": "bigint", "B": "string"})
    assert text.count(" OR ") == 2 and "A = CAST('1' AS bigint) AND B > CAST(NULL AS string)" in text


def test_unpaged_targets_ignore_keys():
    assert " OR " not in seek.after(dataclasses.replace(ORDERS, pageSize=None), datetime(2026, 4, 17), (1,))


def test_literals_are_quoted():
    assert seek.literal("it's \\", "string") == "CAST('it\\'s \\\\' AS string)"


@pytest.mark.parametrize("query", ["SELECT a FROM t", "SELECT a FROM t WHERE /*WM*/ OR /*WM*/"])
def test_exactly_one_marker(query):
    with pytest.raises(ValueError):
        sqltext.with_predicate(query, "1 = 1")


def test_marker_among_predicates():
    assert sqltext.with_predicate("SELECT * FROM x WHERE a = 1 AND /*WM*/ AND s = 'A'", "w > 1 OR k > 2") == "SELECT * FROM x WHERE a = 1 AND (w > 1 OR k > 2) AND s = 'A'"


def test_column_lists():
    assert sqltext.insert_columns("INSERT /*+ APPEND */ INTO S (A, B) VALUES (?, ?)") == ["A", "B"]
    assert sqltext.insert_columns("DELETE FROM s") is None
    assert sqltext.select_columns("select t.a, b\nfrom t") == ["a", "b"]


def test_hints_and_placeholders():
    assert sqltext.without_hints("INSERT /*+ PARALLEL(4) */ INTO x") == "INSERT INTO x" and sqltext.without_hints("SELECT /* kept */ 1") == "SELECT /* kept */ 1"
    assert sqltext.placeholders("INSERT INTO x (a, b) VALUES (?, '?', ?) -- ?\n/* ? */") == 2 and sqltext.placeholders("SELECT 1") == 0


def test_statements_keep_the_semicolon_of_a_block():
    assert sqltext.statement(" SELECT 1 ; \n") == "SELECT 1" and sqltext.statement("SELECT 1") == "SELECT 1"
    assert sqltext.statement("-- first\n/* DECLARE; */ begin x; END;\n").endswith("END;")
    assert sqltext.statement("/* BEGIN */ CREATE VIEW v AS SELECT 1;").endswith("SELECT 1")
    assert sqltext.first_word("--a") == "" and sqltext.first_word("Declare x") == "DECLARE"


@pytest.mark.parametrize("changes, about", [
    ({"sourceQuery": "SELECT ORDER_ID, UPDATED_AT FROM ORDERS"}, "must contain"),
    ({"sourceQuery": "DELETE FROM ORDERS WHERE /*WM*/"}, "must begin with SELECT"),
    ({"watermarkColumn": "OTHER"}, "is not in sourceQuery SELECT list"),
    ({"keyColumns": ("ID",)}, "is not in sourceQuery SELECT list"),
    ({"keyColumns": ()}, "must contain at least one"),
    ({"watermarkType": "STRING"}, "must be 'TIMESTAMP' or 'NUMBER'"),
    ({"initialWm": "2026-04-17"}, "does not parse as TIMESTAMP"),
    ({"watermarkType": "NUMBER", "initialWm": "x"}, "is not a valid number"),
    ({"pageSize": 0}, "pageSize must be positive"),
    ({"lookbackMinutes": -10}, "lookbackMinutes must be >= 0"),
    ({"insertColumns": ("A", "B")}, "does not match sourceQuery SELECT count"),
    ({"merge": ()}, "at least one clause"),
    ({"merge": (sp.Clause("not_matched", "update"),)}, "merge cannot update"),
    ({"watermarkType": "NUMBER", "initialWm": "0", "lookbackMinutes": 5}, "needs a TIMESTAMP"),
])
def test_findings(changes, about):
    assert any(about in f.message for f in findings([dataclasses.replace(ORDERS, **changes)]))


def test_valid_and_collected_findings():
    assert findings([ORDERS]) == []
    bad = dataclasses.replace(ORDERS, pageSize=0, lookbackMinutes=-1, keyColumns=(), initialWm="x")
    assert len(findings([bad])) >= 4
    assert [f.target for f in findings([ORDERS, ORDERS])] == [None]


def test_config_is_strict():
    data = {"name": "a", "sourceQuery": "SELECT a FROM t WHERE /*WM*/", "targetTable": "t", "watermarkColumn": "a", "keyColumns": ["a"]}
    assert sp.load(json.dumps({"targets": [data]})).targets[0].keyColumns == ("a",)
    for changed in ({**data, "nope": 1}, {k: v for k, v in data.items() if k != "name"}):
        with pytest.raises(ValueError):
            sp.load(json.dumps({"targets": [changed]}))


@pytest.mark.parametrize("text, is_auth", [("HTTP 401", True), ("Unauthorized", True), ("Token expired", True), ("SESSION gone", True), ("Login required", True), ("ORA-00904", False), ("", False)])
def test_auth_errors(text, is_auth):
    assert is_auth_error(RuntimeError(text)) is is_auth


def test_auth_errors_in_causes():
    try:
        try:
            raise ValueError("token expired")
        except ValueError as inner:
            raise RuntimeError("page failed") from inner
    except RuntimeError as e:
        assert is_auth_error(e) and is_auth_error(RuntimeError("x"), (RuntimeError,))
    assert not is_auth_error(None)


def test_groups_run_in_order():
    named = lambda n, g: dataclasses.replace(ORDERS, name=n, group=g)
    got = groups([named("u1", None), named("b", 2), named("a", 1), named("c", 2), named("u2", None)])
    assert [[s.name for s in g] for g in got] == [["a"], ["b", "c"], ["u1"], ["u2"]]
