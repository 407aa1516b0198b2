"""Each core query at the smallest scale: its SQL gives the same rows; those without SQL run."""

import math
import os

import pytest

from evigrain import queries as core

duckdb = pytest.importorskip("duckdb")


def rounded(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 8)
    return v if isinstance(v, (int, str, bool, type(None))) else str(v)


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(rounded(r[i]) for i in order) for r in rows), key=repr), [columns[i] for i in order]


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for f in os.listdir(small):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{small}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_same_rows_as_sql(spark, small, con, name):
    df = core.QUERIES[name](spark, small)
    got = rows_of([tuple(r) for r in df.collect()], df.columns)
    r = con.execute(core.SQL[name])
    assert got == rows_of(r.fetchall(), [c[0] for c in r.description])


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.SQL)))
def test_runs(spark, small, name):
    df = core.QUERIES[name](spark, small)
    assert len(set(df.columns)) == len(df.columns)
    assert df.count() > 0


def test_same_rows_under_another_partitioning(spark, small):
    def run(n):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        return {name: rows_of([tuple(r) for r in core.QUERIES[name](spark, small).collect()], [""] * len(core.QUERIES[name](spark, small).columns))[0] for name in ("dedup_winners", "bm25_topk", "span_merge", "retrieve_hybrid")}

    a, b = run("3"), run("8")
    assert a == b


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
