"""What the control surface says of staging, and the time of fetches that find nothing."""

import datetime

from tidemark.plans import http_api
from tidemark.plans.pipeline import Engine
from tidemark.plans.runner import RunManager
from tidemark.spec import PipelineSpec, TargetSpec

ROWS = [(k, datetime.datetime(2024, 1, 1, k), f"{k},5") for k in range(4)]
SPEC = TargetSpec(
    "staged", "SELECT id, at, price FROM priced WHERE /*WM*/", "T_PRICED", "at", ("id",), stagingTable="STG_PRICED", pageSize=2,
    targetInsert="INSERT INTO STG_PRICED (ID, CHANGED, PRICE) VALUES (?, ?, ?)", types={"PRICE": "decimal(8,2)"}, formats={"NLS_NUMERIC_CHARACTERS": ",."},
    targetMerge="MERGE INTO T_PRICED t USING STG_PRICED s ON t.ID = s.ID WHEN MATCHED THEN UPDATE SET t.PRICE = s.PRICE WHEN NOT MATCHED THEN INSERT (ID, PRICE) VALUES (s.ID, s.PRICE)",
)


def test_ddl_of_staging_and_target(spark, tmp_path):
    spark.createDataFrame(ROWS, "id long, at timestamp_ntz, price string").createOrReplaceTempView("priced")
    manager = RunManager(Engine(spark, f"file://{tmp_path}"), PipelineSpec((SPEC,)))
    ask = lambda: http_api.answer(manager, "GET", "/api/targets/staged/ddl")[1]
    before = ask()
    assert before["stagingDdl"] == "CREATE TABLE STG_PRICED (\n  ID NUMBER,\n  CHANGED TIMESTAMP,\n  PRICE NUMBER(8,2)\n)" and not before["stagingTableExists"] and not before["targetTableExists"]
    assert manager.engine.run_target(SPEC)
    after = ask()
    assert after["stagingTableExists"] and after["targetTableExists"] and "PRICE NUMBER(8,2)" in after["targetDdl"] and "CHANGED" not in after["targetDdl"]
    spark.catalog.dropTempView("priced")
    gone = ask()
    assert gone["stagingDdl"].startswith("-- not readable") and gone["targetDdl"] == after["targetDdl"]


def test_empty_fetches_are_timed(spark, tmp_path):
    spark.createDataFrame(ROWS, "id long, at timestamp_ntz, price string").createOrReplaceTempView("priced")
    engine = Engine(spark, f"file://{tmp_path}")
    assert engine.run_target(SPEC) and [e["event"] for e in engine.events] == ["page", "page", "fetch", "run"]
    assert engine.run_target(SPEC) and [e["event"] for e in engine.events][4:] == ["fetch", "run"]
    lines = engine.totals.lines()
    assert 'etl_page_duration_seconds_count{target="staged"} 4' in lines and 'etl_rows_loaded_total{target="staged"} 4' in lines
