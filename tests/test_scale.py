"""Scale properties: a hot user, and the shape of the physical plans."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from relaylens.operators.funnel import ordered_funnel, ordered_funnel_skew_safe
from relaylens.params import FunnelSpec
from relaylens.plans.oracle import funnel_ctes
from relaylens.sources.events import load_events
from tests.conftest import SF001, SF01


@pytest.fixture(scope="module")
def hot_dir(spark, tmp_path_factory):
    """sf0.01 events with a third of the users folded into user 0, which then
    holds a third of all rows."""
    d = tmp_path_factory.mktemp("hot")
    ev = spark.read.parquet(os.path.join(SF01, "events.parquet"))
    hot = ev.withColumn("user_id", F.when(F.col("user_id") < 50, F.lit(0)).otherwise(F.col("user_id")))
    hot.coalesce(1).write.parquet(str(d / "events.parquet"))
    share = hot.where(F.col("user_id") == 0).count() / hot.count()
    assert 0.3 < share < 0.37
    return str(d)


@pytest.mark.parametrize("plan", ["window", "window-24h", "window-6h", "skew-safe"])
def test_hot_user_funnel_matches_oracle(spark, hot_dir, plan):
    if plan == "skew-safe":
        spec = FunnelSpec()
        df = ordered_funnel_skew_safe(load_events(spark, hot_dir, spec.steps), spec)
    else:
        spec = FunnelSpec(split_hours={"window": None, "window-24h": 24, "window-6h": 6}[plan])
        df = ordered_funnel(load_events(spark, hot_dir, spec.steps), spec)
    got = sorted((r.send_id, r.depth, r.click_ts, r.signup_ts, r.purchase_ts) for r in df.collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{hot_dir}/events.parquet')")
    want = sorted(
        con.execute(f"WITH {funnel_ctes(spec)} SELECT send_id, depth, click_ts, signup_ts, purchase_ts FROM f").fetchall()
    )
    assert got == want


def _plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


BATCH = [n for n in E.oracle_sql() if not n.startswith("stream") and n != "recorded_metrics"]


@pytest.mark.parametrize("name", BATCH)
def test_no_cross_or_nested_loop_join(spark, name):
    plan = _plan(E.queries()[name](spark, SF001))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def _exchanges(plan: str) -> list[str]:
    return [line for line in plan.splitlines() if "Exchange " in line]


def test_funnel_plan_and_pushdown(spark):
    """One shuffle to deduplicate (on the event), one for the window; the
    type filter reaches the scan, and neither ``value`` nor the raw
    ``props`` passes the first shuffle."""
    from relaylens.sources.events import step_events

    spec = FunnelSpec()
    df = ordered_funnel(step_events(spark, SF001, spec.steps), spec)
    plan = _plan(df)
    shuffles = _exchanges(plan)
    assert len(shuffles) == 2
    assert "hashpartitioning(user_id" in shuffles[0] and "slice" in shuffles[0] and "hashpartitioning(event_id" in shuffles[1]
    assert "Join" not in plan
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "In(event_type, [click,purchase,signup,view])" in scan
    assert "value" not in scan.split("ReadSchema:")[1]


def test_last_touch_reads_two_types(spark):
    scan = next(line for line in _plan(E.queries()["last_touch"](spark, SF001)).splitlines() if "FileScan" in line)
    assert "In(event_type, [purchase,view])" in scan


def test_funds_trend_reads_each_input_once(spark):
    plan = _plan(E.queries()["funds_trend"](spark, SF001))
    assert plan.count("FileScan") == 2


@pytest.mark.parametrize("name", ["funnel_by_segment", "funds_by_segment"])
def test_rollup_sits_above_a_reduced_aggregate(spark, name):
    lines = [x for x in _plan(E.queries()[name](spark, SF001)).splitlines() if any(k in x for k in ("Expand", "Join", "HashAggregate"))]
    at = next(i for i, x in enumerate(lines) if "Expand" in x)
    below = lines[at + 1 :]
    assert "HashAggregate" in below[0] and any("Join" in x for x in below)


@pytest.mark.parametrize("later", [1, 2, 3, 4])
def test_as_of_plan_is_linear_in_the_steps(spark, later):
    """The shuffles of a round do not depend on how many came before."""
    spec = FunnelSpec(steps=("view", "click", "signup", "purchase", "error")[: later + 1])
    plan = _plan(ordered_funnel_skew_safe(load_events(spark, SF001, spec.steps), spec))
    assert len(_exchanges(plan)) == 3 and plan.count("Window ") == 2


@pytest.mark.parametrize("name", ["daily_funds", "funds_trend", "funds_by_month", "month_to_date", "funds_headline"])
def test_day_level_funds_skip_the_party_join(spark, name):
    plan = _plan(E.queries()[name](spark, SF001))
    assert "o_orderkey" not in plan  # lineitem is never joined to orders


def test_funnel_jobs_on_a_hot_user_match_oracle(spark, hot_dir):
    """The jobs built on the funnel, and both plans of B1 and B6, on a table
    where one user holds a third of all events."""
    q, sql = E.queries(), E.oracle_sql()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{hot_dir}/events.parquet')")
    from tools.parity import rows_of

    names = ["funnel_summary", "funnel_by_day", "time_to_convert", "drop_off", "funnel_sends_skew_safe"]
    for name in names + ["last_touch_skew_safe", "funds_per_send"]:
        df = q[name](spark, hot_dir)
        cur = con.execute(sql[name])
        d_cols = [d[0] for d in cur.description]
        assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(d_cols, cur.fetchall()), name


def test_skew_safe_plan_shape(spark, hot_dir):
    plan = _plan(E.queries()["funnel_sends_skew_safe"](spark, hot_dir))
    assert "Join" not in plan and "CartesianProduct" not in plan
    assert plan.count("Window ") == 2  # the last round's slice window and its summary
    assert "Window " in _plan(E.queries()["last_touch_skew_safe"](spark, hot_dir))
