"""Every query with SQL against DuckDB on the same tables; the rest must run."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_points

OWN = {**entry_points.descriptive.QUERIES, **entry_points.networks.QUERIES, **entry_points.effects.QUERIES, **entry_points.searches.QUERIES}
SQL = entry_points.oracle_sql()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6) + 0.0
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


def same(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    rel = con.sql(sql)
    at = [rel.columns.index(c) for c in cols]
    assert sorted(rel.columns) == cols
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(OWN))
def test_query(spark, sf_dir, name):
    if name in SQL:
        same(spark, sf_dir, OWN[name], SQL[name])
    else:
        assert OWN[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
