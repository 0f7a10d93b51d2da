"""Every query with SQL against an independent engine, and all others for rows and repeatable results."""

import datetime
import decimal
import math

import pytest

import __spark_entry__
from quillspark.registry import REGISTRY

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def other():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, decimal.Decimal):
        return "decimal", str(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


def rows_of(rows):
    return sorted((tuple(plain(v) for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", [n for n, e in REGISTRY.items() if e.sql])
def test_same_rows_as_sql(spark, other, name):
    df = REGISTRY[name].run(spark, SF)
    cursor = other.execute(REGISTRY[name].sql)
    names = [c[0] for c in cursor.description]
    columns = sorted(df.columns)
    assert sorted(names) == columns
    place = [names.index(c) for c in columns]
    assert rows_of(df.select(*columns).collect()) == rows_of([[r[i] for i in place] for r in cursor.fetchall()])


@pytest.mark.parametrize("name", [n for n, e in REGISTRY.items() if not e.sql and "stream" not in n and "sketch" not in n])
def test_other_queries_repeat(spark, name):
    first = rows_of(REGISTRY[name].run(spark, SF).collect())
    assert first == rows_of(REGISTRY[name].run(spark, SF).collect())
    assert first


def test_entry_points(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_no_query_of_the_library_multiplies_whole_tables(spark):
    for name in ("fuzzy_lexicon_match", "uncovered_boxes", "box_iou_pairs", "history_join", "semi_join", "as_of_join"):
        plan = REGISTRY[name].run(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name


def test_filters_and_columns_reach_the_scan(spark):
    plan = REGISTRY["time_range"].run(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderdate)" in plan and "o_comment" not in plan


def test_a_page_is_dealt_once(spark):
    plan = REGISTRY["layout_roles"].run(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2
