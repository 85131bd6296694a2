import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(["ka", "lo", "mi", "ren", "tu", "sé", "ß", "xo"]) for _ in range(r.randint(1, 4))) for _ in range(n))


LONG = prose(99, 60_000)


def documents() -> list[tuple]:
    """Nulls in every column, empty and very long texts, repeated rows, copies, ties."""
    rows = [(k, prose(k, 20 + k), "en", f"src{k % 3}", None) for k in range(30)]
    rows += [(30, None, None, None, None), (31, "", "", "", 0), (32, " \t\n\r\x0b\x0c ", "en", "src0", 7), (33, LONG, "de", "src1", len(LONG))]
    rows += [(34, prose(5, 25), "en", "src2", 1), (35, prose(5, 25), "en", "src2", 1), (36, prose(5, 24) + " zz", "en", "src0", 1)]
    rows += [(37, "same line\n" * 3 + "own 37", "en", "src0", 1)] + [(k, f"Same Line \nother {k % 2}\n\nown {k}", "en", "src1", 1) for k in range(38, 50)]
    return rows + [(50, "x y", "en", "src1", 3), (51, "x", "en", "src1", 1), (7, prose(7, 27), "en", "src1", None), (None, "no id here at all", "en", "src0", None)]


@pytest.fixture(scope="session")
def rows():
    return documents()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With columns whose names the operators use for their own."""
    from pyspark.sql import functions as F

    made = spark.createDataFrame(rows, SCHEMA)
    extra = ("size", "copies", "row", "fp", "component_id", "score", "spans", "items", "kept", "key", "target", "name", "n_words", "body", "lines", "n")
    odd = [F.lit("dot").alias("a.b"), F.lit("quote").alias("c`d"), F.create_map(F.lit("k"), F.lit("v")).alias("tags")]
    return made.select("*", *[F.lit("clash").alias(c) for c in extra], *odd).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
