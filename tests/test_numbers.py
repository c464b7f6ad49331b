"""Places of doubles, as DuckDB has them."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from keylingo import plans
from keylingo.functions.numbers import rounded


def test_rounds_as_sql_does(spark):
    draw = random.Random(7)
    values = [k / n for n in (128, 640, 3200, 16000) for k in range(0, n, 3)] + [draw.uniform(-3, 3) for _ in range(5000)]
    values += [-x for x in values[:3000]] + [0.0, -0.0, -3e-7, 3e-7, 4.9999999e-7, 1e300, 2.0**60 + 4096, float("inf"), float("-inf"), float("nan"), None]
    made = spark.createDataFrame([(n, x) for n, x in enumerate(values)], "n long, x double").coalesce(1)
    got = {r["n"]: r for r in made.select("n", rounded("x", 6).alias("six"), rounded(F.col("x"), 9).alias("nine")).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE v (n BIGINT, x DOUBLE)")
    con.executemany("INSERT INTO v VALUES (?, ?)", list(enumerate(values)))
    for n, six, nine in con.execute("SELECT n, round(x, 6), round(x, 9) FROM v").fetchall():
        assert (repr(got[n]["six"]), repr(got[n]["nine"])) == (repr(six), repr(nine)), values[n]


@pytest.mark.parametrize("known", [41, 323])
def test_shares_that_end_in_five(spark, tmp_path, known):
    """Of 640 words 41 are 0.0640625, a double a little under it: SQL rounds it down."""
    con = duckdb.connect()
    text = "known " * known + "x " * (640 - known)
    con.execute(f"COPY (SELECT i AS doc_id, '{text}' AS text, 'en' AS lang, 'a' AS source, 1::BIGINT AS n_chars FROM range(1, 13) r(i)) TO '{tmp_path}/documents.parquet'")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    for name in ("j7_word_confidence",):
        df = plans.queries()[name](spark, str(tmp_path))
        assert sorted(map(tuple, df.select("doc_id", "lang", "word_conf").collect())) == sorted(con.execute(plans.oracle_sql()[name]).fetchall())
