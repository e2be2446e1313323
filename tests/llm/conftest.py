import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def folder():
    return DATA


@pytest.fixture(scope="session")
def given():
    return lambda sql: duckdb.sql(sql.replace("{", f"'{DATA}/").replace("}", ".parquet'")).fetchall()


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Null and empty texts, null and repeated ids, repeated rows, a long text, columns named like those of operators."""
    passage = " ".join(f"w{k}" for k in range(60))
    rows = [
        (1, None), (2, ""), (3, "   \n\t "), (4, passage), (5, passage), (5, passage), (None, passage), (None, None),
        (6, "one two"), (7, "One TWO"), (8, "a " * 200), (9, " ".join(f"x{k % 997}y{k // 997}" for k in range(30_000))),
        (10, "é ü 中文   x"), (11, passage + " tail of its own that goes on"), (8, "another text of the same id"),
        (12, "!!! ???"), (13, "nul \x00 inside"),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS).repartition(3)
    clash = docs.selectExpr("*", "'x' _chunk", "1 n_words", "2 score", "array(3) spans", "4 kept_text", "5 key", "6 label", "7 held_out")
    return rows, docs, clash


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
