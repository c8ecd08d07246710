"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from tessera.plans import nested_queries, queries, rule_queries, run_queries, source_queries

PARTS = (queries, source_queries, rule_queries, nested_queries, run_queries)
QUERIES = {name: query for part in PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in PARTS for name, sql in part.ORACLES.items()}

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    made = duckdb.connect()
    for name in os.listdir(SF):
        made.execute(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return made


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = con.execute(ORACLES[name])
    names, rows = [d[0] for d in want.description], want.fetchall()
    assert sorted(names) == cols
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    stated = {r[0]: r[1] for r in con.execute("describe " + ORACLES[name]).fetchall()}
    assert {c: kinds.get(t, t) for c, t in got.dtypes if t in kinds} == {c: stated[c] for c, t in got.dtypes if t in kinds}
    mine = sorted(tuple(map(plain, (r[c] for c in cols))) for r in got.collect())
    assert mine == sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in rows)


def test_validate_violations_of_wide_brands(spark, tmp_path):
    """More than 10,000 parts of a brand break a rule of tables, which the SQL of this query does not ask for."""
    con = duckdb.connect()
    con.execute(f"copy (select * replace (p_partkey + 200 * i as p_partkey, 'Brand#1' as p_brand) from '{SF}/part.parquet', range(51) r(i)) to '{tmp_path}/part.parquet' (format parquet)")
    con.execute(f"create view part as select * from '{tmp_path}/part.parquet'")
    want = con.execute(f'select entity, rule, "column", detail from ({ORACLES["validate_violations"]})').fetchall()
    got = QUERIES["validate_violations"](spark, str(tmp_path)).select("entity", "rule", "column", "detail").collect()
    assert sorted(tuple(map(plain, r)) for r in got) == sorted(tuple(map(plain, r)) for r in want)
