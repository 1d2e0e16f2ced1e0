"""Every query that has SQL gives the rows DuckDB gives, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
CORE = [m for m in entry._modules() if not m.__name__.startswith("sievework.llm")]
NAMES = [n for m in CORE for n in m.SQL]


def cell(x):
    if hasattr(x, "tolist"):
        x = x.tolist()
    if x is None or (not isinstance(x, list) and x != x):
        return "null"
    if isinstance(x, float):
        return repr(round(x, 6) + 0.0)
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(cell, x)) + "]"
    return str(x)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(map(cell, r)) for r in df.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, con, name):
    got, want = entry.queries()[name](spark, SF).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.astype(object).where(got.notna(), None)) == rows(want.astype(object).where(want.notna(), None))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", [n for m in CORE for n in m.QUERIES if n not in m.SQL])
def test_same_rows_whatever_the_partitions(spark, name):
    """Queries without SQL give rows, and the very same ones when the work is cut up otherwise."""
    first = rows(entry.queries()[name](spark, SF).toPandas())
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        for k, v in zip(before, ("7", "65536", "37"), strict=True):
            spark.conf.set(k, v)
        again = rows(entry.queries()[name](spark, SF).toPandas())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert first and first == again


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_bootstrap_by_suite_has_the_operators_defaults(spark):
    from pyspark.sql import functions as F

    from sievework.operators.metrics import bootstrap_ci
    from sievework.plans.evaluation import _ev

    want = bootstrap_ci(_ev(spark, SF), ["system_name", "suite"], F.md5("state"), draws=1000, blocks=4096)
    assert rows(entry.queries()["e10_bootstrap_by_suite"](spark, SF).toPandas()) == rows(want.toPandas())
