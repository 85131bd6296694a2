"""MERGE, INSERT and SELECT texts."""

import dataclasses
import json

import pytest
from pyspark.sql import functions as F

from tidemark import queries
from tidemark.functions import statements
from tidemark.operators import merge as mg
from tidemark.plans.validate import findings
from tidemark.spec import UPSERT, Clause, load

TEXT = load(queries._AS_TEXT).targets[0]


def test_merge_text_to_clauses(spark):
    got = statements.merge(
        "MERGE INTO a.b.T t USING S s ON (t.ID = s.id AND s.K2 = t.K2) WHEN MATCHED AND s.GONE = 'Y' THEN DELETE "
        "WHEN MATCHED AND t.N < s.N THEN UPDATE SET t.N = s.N, M = coalesce(t.M, s.M, 0) WHEN NOT MATCHED THEN INSERT (ID, K2, N) VALUES (ID, s.K2, greatest(N, 1))"
    )
    assert (got.target, got.staging, got.keys) == ("a.b.T", "S", ("ID", "K2"))
    assert [(c.when, c.do) for c in got.clauses] == [("matched", "delete"), ("matched", "update"), ("not_matched", "insert")]
    assert got.clauses[0].condition == "(src.GONE = 'Y')" and got.clauses[1].condition == "(tgt.N < src.N)"
    assert got.clauses[1].columns == {"N": "src.N", "M": "coalesce(tgt.M, src.M, 0)"}
    assert got.clauses[2].columns == {"ID": "src.ID", "K2": "src.K2", "N": "greatest(src.N, 1)"}


def test_merge_text_without_aliases_and_with_stars(spark):
    got = statements.merge("MERGE INTO t USING s ON t.id = s.id WHEN MATCHED THEN UPDATE SET * WHEN NOT MATCHED AND s.v > 0 THEN INSERT *")
    assert got.clauses == (Clause("matched", "update"), Clause("not_matched", "insert", "(src.v > 0)"))


@pytest.mark.parametrize(
    "text, about",
    [
        ("DELETE FROM t", "not a MERGE"), ("MERGE t", "PARSE"), ("MERGE INTO t USING t ON t.id = t.id WHEN MATCHED THEN DELETE", "different names"),
        ("MERGE INTO t USING s ON t.id = s.other WHEN MATCHED THEN DELETE", "equal columns"), ("MERGE INTO t USING s ON t.id > s.id WHEN MATCHED THEN DELETE", "equal columns"),
        ("MERGE INTO t USING s ON t.id = s.id WHEN MATCHED AND v > 1 THEN DELETE", "must name its table"), ("MERGE INTO t USING (SELECT 1 AS id) s ON t.id = s.id WHEN MATCHED THEN DELETE", "two named tables"),
        ("MERGE INTO t USING s ON t.id = s.id WHEN NOT MATCHED BY SOURCE THEN DELETE", "BY SOURCE"), ("MERGE INTO t USING s ON t.id = s.id OR s.x = 1 WHEN MATCHED THEN DELETE", "equal columns"),
    ],
)
def test_what_a_merge_text_cannot_say(spark, text, about):
    with pytest.raises(statements.StatementError, match=about):
        statements.merge(text)


def test_text_and_clauses_merge_alike(spark):
    target = spark.createDataFrame([(1, 5, "a"), (2, 6, "b"), (3, None, None)], "id long, n long, v string")
    page = spark.createDataFrame([(2, 60, "B"), (3, 1, "C"), (4, 0, "D"), (5, 9, None)], "id long, n long, v string")
    text = statements.merge("MERGE INTO T x USING S y ON x.ID = y.ID WHEN MATCHED AND y.N > 50 THEN DELETE WHEN MATCHED THEN UPDATE SET x.V = concat(y.V, '''', x.ID) WHEN NOT MATCHED AND y.N > 0 THEN INSERT (ID, N) VALUES (y.ID, y.N)")
    clauses = [Clause("matched", "delete", "src.n > 50"), Clause("matched", "update", columns={"v": "concat(src.v, \"'\", tgt.id)"}), Clause("not_matched", "insert", "src.n > 0", {"id": "src.id", "n": "src.n"})]
    got, want = mg.apply_merge(target, page, text.keys, text.clauses).collect(), mg.apply_merge(target, page, ["id"], clauses).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == 3


def test_insert_text(spark):
    assert statements.insert("INSERT /*+ APPEND_VALUES */ INTO STG (A, B) VALUES (?, ?)") == statements.Insert("STG", ("A", "B"), 2)
    assert statements.insert("INSERT INTO s.STG VALUES (?, '?', ?) -- ?") == statements.Insert("s.STG", (), 2)
    with pytest.raises(statements.StatementError):
        statements.insert("SELECT 1")


def test_select_list(spark):
    names = lambda q: statements.select_list(q + " WHERE /*WM*/")
    assert names("SELECT t.A, b AS C, coalesce(x, y) z, `odd, name` FROM t") == ["A", "C", "z", "odd, name"]
    assert names("SELECT * FROM t") == ["*"] and names("SELECT concat(a, ',', b) AS ab, (SELECT max(q) FROM u) AS m FROM t") == ["ab", "m"]
    assert statements.select_list("WITH u AS (SELECT a FROM t WHERE /*WM*/) SELECT a, count(*) AS n FROM u GROUP BY a ORDER BY a LIMIT 3") == ["a", "n"]
    with pytest.raises(statements.StatementError):
        statements.select_list("DELETE FROM t WHERE /*WM*/")


@pytest.mark.parametrize(
    "changes, about",
    [
        ({"targetInsert": "UPDATE STG_ORDERS SET x = 1"}, "must be an INSERT"),
        ({"stagingTable": "OTHER"}, "targetInsert should reference stagingTable 'OTHER'"),
        ({"targetInsert": "INSERT INTO STG_ORDERS VALUES (?, ?, ?, ?)"}, "could not parse column list"),
        ({"targetInsert": "INSERT INTO STG_ORDERS (a, b) VALUES (?, ?, ?)"}, "placeholder count (3) does not match column list size (2)"),
        ({"targetInsert": "INSERT INTO STG_ORDERS (a, b) VALUES (?, ?)"}, "column count (2) does not match sourceQuery SELECT count (4)"),
        ({"targetMerge": "UPDATE T_ORDERS SET x = 1"}, "must be a MERGE"),
        ({"stagingTable": "OTHER"}, "targetMerge should reference stagingTable 'OTHER'"),
        ({"targetTable": "OTHER"}, "targetMerge should reference targetTable 'OTHER'"),
        ({"targetMerge": "MERGE INTO T_ORDERS t USING STG_ORDERS s ON t.A = s.B WHEN MATCHED THEN DELETE"}, "equal columns"),
        ({"sourceQuery": "SELECT concat(a, ',', b) AS O_ORDERKEY, c FROM orders WHERE /*WM*/"}, "'O_ORDERDATE' is not in"),
        ({"schema": "loose"}, "schema must be"), ({"publish": "never"}, "publish must be"),
    ],
)
def test_findings_about_texts(spark, changes, about):
    assert any(about in f.message for f in findings([dataclasses.replace(TEXT, **changes)]))


def test_a_right_configuration_has_no_findings(spark):
    assert findings([TEXT]) == []


def test_texts_and_their_parts_exclude_each_other():
    data = json.loads(queries._AS_TEXT)["targets"][0]
    for more in ({"insertColumns": ["a"]}, {"merge": []}, {"mergeKeys": ["a"]}):
        with pytest.raises(ValueError, match="not both"):
            load(json.dumps({"targets": [data | more]}))


def test_what_a_batch_may_hold():
    assert mg.repeatable(UPSERT, ["id"]) and mg.repeatable(UPSERT[::-1], ["id"])
    resolved = statements.resolved
    assert mg.repeatable([Clause("matched", "update", columns={"v": "src.v"}), Clause("not_matched", "insert", columns={"ID": "src.id", "v": "src.v"})], ["id"])
    assert not mg.repeatable([Clause("matched", "update", columns={"v": "src.v"}), Clause("not_matched", "insert")], ["id"])
    assert not mg.repeatable([Clause("matched", "update", columns={"v": "src.v + tgt.v"}), Clause("not_matched", "insert", columns={"v": "src.v"})], ["id"])
    assert not mg.repeatable([UPSERT[0]], ["id"]) and not mg.repeatable([Clause("matched", "update", "src.v > 1"), UPSERT[1]], ["id"])
    assert resolved(queries.ORDERS) == queries.ORDERS


def test_unknown_columns_of_a_merge_fail(spark):
    target = spark.createDataFrame([(1, 2)], "id long, v long")
    with pytest.raises(Exception, match="nothing"):
        mg.apply_merge(target, target, ["id"], statements.merge("MERGE INTO t USING s ON t.id = s.id WHEN MATCHED THEN UPDATE SET v = s.nothing").clauses).select(F.col("v")).collect()
