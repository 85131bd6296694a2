"""The fitting sample of the language operator where ids are missing or repeated."""

from pyspark.sql import functions as F

from tidemark.llm import language


def test_rows_without_ids_do_not_swamp_the_sample(spark):
    for doc_id in ("CAST(NULL AS LONG)", "7L"):
        rows = spark.range(3000).selectExpr(f"{doc_id} AS doc_id", "'en' AS lang", "concat('text ', id) AS text")
        got = language.sample(rows, 300).groupBy("calibrates").agg(F.count(F.lit(1)).alias("n")).collect()
        assert len(got) == 2 and 200 <= sum(r.n for r in got) <= 400
