"""Every registered query is well formed; a sample of them is compared with its SQL on the smallest data."""
from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["ag01_stage_counts", "wn09_label_runs", "cm07_ee_twist_tool", "rs03_output_clock", "lb02_grasp_labels", "gt02_kinematic_reasons", "wn28_greedy_packing",
          "jn11_asof_backward", "sy01_sy02_sy03_scenarios", "st04_live_runs", "flagship_verdicts"]


@pytest.fixture(scope="module")
def oracle(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(r[i] + 0.0) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, small, oracle, name):
    df = entry.queries()[name](spark, small)
    cur = oracle.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(cur.fetchall(), columns)


def test_placed_drops_of_every_object_equal_their_sql(spark, small, oracle):
    df = entry.queries()["lb18_placed_drops"](spark, small)
    cur = oracle.execute(entry.oracle_sql()["lb18_placed_drops"])
    columns = [d[0] for d in cur.description]
    rows = df.collect()
    assert plain([tuple(r) for r in rows], df.columns) == plain(cur.fetchall(), columns) and {r.object for r in rows} > {"click"}


def test_every_query_has_sql_or_a_reason():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 150


def test_entry_is_stable(spark):
    df = entry.entry(spark)
    assert df.columns == ["episode", "rows", "held_rows", "segments", "worst_speed", "passed"]


def test_plans_have_no_python_rows_and_no_cross_joins(spark, small):
    for name in ("wn09_label_runs", "ag05_failure_reasons", "jn16_nearest_object", "so05_prefix_cover", "cm06_ee_delta_base"):
        plan = entry.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_ledger_joins_pass_the_driver_by(spark, small):
    """Catalogue, ledger and listing grow with the tables: no side of their joins is broadcast."""
    from trajlake.plans import all_queries
    for name in ("jn04_ledger_verification", "jn02_jn03_identified_files"):
        assert "BroadcastHashJoin" not in all_queries()[name].build(spark, small)._jdf.queryExecution().executedPlan().toString()
