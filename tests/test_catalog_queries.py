import os

import duckdb
import pytest

from filescope.plans import catalog_queries as cq
from filescope.plans import surface_queries as sq

QUERIES, SQL = cq.queries() | sq.queries(), cq.oracle_sql() | sq.oracle_sql()

DIR = "/root/testdata/sf0.01"
TABLES = "documents pages benchmark labels".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")
@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    a = QUERIES[name](spark, DIR).toPandas()
    b = duck.sql(SQL[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns) and len(a) == len(b) > 0
    a, b = (x[cols].astype(str).sort_values(cols).reset_index(drop=True) for x in (a, b))
    assert (a == b).all().all()


def test_families_are_the_same_as_columns(spark):
    from pyspark.sql import functions as F

    from filescope.functions.previews import family, family_of

    names = ["a.rs", "Makefile", "x/Gemfile", ".gitignore", "a/.gitignore", "b.PY", "b.py/", "c", "c.", ".py", "d.tar.gz", "e.ps1", "f.json", ""]
    assert {r[0]: r[1] for r in spark.createDataFrame([(n,) for n in names], "p string").select("p", family_of(F.col("p"))).collect()} == {n: family(n) for n in names}


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")
def test_preview_code(spark):
    from filescope.functions.previews import code_lines, family

    texts = {r[0]: r[1] for r in cq._entries(spark, DIR, "text").select("path", "text").collect()}
    for r in cq.queries()["preview_code"](spark, DIR).limit(50).collect():
        start, lines = code_lines(texts[r["path"]].removesuffix("\n").split("\n"), family(r["path"]), 3)
        assert (start, "\n".join(lines)) == (r["start"], r["lines"])


def test_names_agree():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= len(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    if os.path.isdir(entry.SMOKE_DIR):
        assert entry.entry(spark).columns == ["path", "size", "tokens_est", "kind"]
