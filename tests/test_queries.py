"""Every query with SQL gives what its SQL gives, over the smallest tables."""

import math
import os

import duckdb
import pytest

from citeweave.oracles import ORACLES
from citeweave.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(norm(r[c]) for c in columns) for r in df.collect()]
    cursor = db.execute(ORACLES[name])
    found = [d[0] for d in cursor.description]
    assert sorted(found) == columns
    at = [found.index(c) for c in columns]
    expected = [tuple(norm(r[k]) for k in at) for r in cursor.fetchall()]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(got, key=key) == sorted(expected, key=key)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["catalog_upsert", "catalog_insert_or_ignore"])
def test_ties_go_by_place_in_the_files(spark, tmp_path, name):
    """Lines with the same order and number, in two files of which the second is larger, so that Spark reads it first."""
    con = duckdb.connect()
    line = "i % 50 as l_orderkey, 100 * {f} + i as l_partkey, cast(1 as int) as l_linenumber, chr(cast(65 + (i + {f}) % 26 as int)) as l_returnflag"
    os.mkdir(tmp_path / "lineitem.parquet")
    for f, n in ((1, 400), (2, 9000)):
        con.execute(f"copy (select {line.format(f=f)} from range({n}) t(i)) to '{tmp_path}/lineitem.parquet/{f}.parquet'")
    con.execute(f"copy (select cast(7 as bigint) as o_orderkey, 'F' as o_orderstatus) to '{tmp_path}/orders.parquet'")
    con.execute(f"create view lineitem as select * from read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    con.execute(f"create view orders as select * from read_parquet('{tmp_path}/orders.parquet')")
    df = QUERIES[name](spark, str(tmp_path))
    got = sorted(tuple(r) for r in df.collect())
    assert got == sorted(con.sql(f"select {', '.join(df.columns)} from ({ORACLES[name]})").fetchall())


@pytest.mark.parametrize("name, costly", [("title_similarity", ("regexp", "array_intersect")), ("one_edit", ("levenshtein",))])
def test_pairs_are_measured_by_value(spark, tmp_path, name, costly):
    """Nothing costly is left to do for each pair of keys; repeated keys and values, empty ones and nulls lose no pair."""
    con = duckdb.connect()
    names = "['hot bolt', 'hot bolts', 'red bolt', 'red', '', 'Reds of the ring'][1 + i % 6]"
    con.execute(f"copy (select cast(i // 2 * 2 as bigint) as p_partkey, {names} as p_name, 'b' || i % 2 as p_brand, ['LARGE', 'of the', null][1 + i % 3] as p_type, cast(case when i % 11 > 0 then 1 end as int) as p_size from range(300) t(i)) to '{tmp_path}/part.parquet'")
    con.execute(f"create view part as select * from read_parquet('{tmp_path}/part.parquet')")
    df = QUERIES[name](spark, str(tmp_path))
    per_pair = df._jdf.queryExecution().optimizedPlan().toString().split("Generate explode")[0]
    assert not any(c in per_pair for c in costly)
    condition = "a.p_brand = b.p_brand and a.p_size = b.p_size and a.p_partkey < b.p_partkey"
    keys = con.sql(f"select a.p_partkey, b.p_partkey from part a join part b on {condition}").fetchall()
    assert sorted((r.a_key, r.b_key) for r in df.collect()) == sorted(keys)


def test_search_plan_explodes_a_stage(spark):
    """The planner filters an exploded column beforehand and would find the plan anew for that."""
    plan = QUERIES["search_plan"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan and "explode(plan" in plan
