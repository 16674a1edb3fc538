"""Labeling: one path, broadcast or shuffled by Spark's own choice; distributions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from trafficlab.functions.timecols import millis
from trafficlab.operators import flows as FW
from trafficlab.operators import labels as LB
from trafficlab.operators.position import bucketize
from trafficlab.sources.tables import agm_schedule, attack_schedule, pkt_user, table
from trafficlab.plans.q_labels import pair_flows
from tests.conftest import SF01


def _rows(df, cols):
    return {tuple(r) for r in df.select(*cols).collect()}


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    yield lambda: spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def _plain_label(windows, mode, src, dst, t, end):
    hit = []
    for name, a, b, t0, t1, priority in windows:
        if t0 is None or t1 is None or t is None:
            continue
        if mode == "AGM":
            if a == src and t < t1 and end > t0:
                hit.append((priority, name))
        elif ((a, b) == (src, dst) or mode == "5tuplebi" and (b, a) == (src, dst)) and t0 <= t < t1:
            hit.append((priority, name))
    return min(hit)[1] if hit else "Normal"


def test_interval_index_equals_a_walk_over_all_windows(spark):
    import random

    r = random.Random(6)
    windows = []
    for i in range(120):
        t0 = r.choice([None, r.randint(0, 500)] if i % 20 == 0 else [r.randint(0, 500)])
        windows.append((f"w{i % 30}", r.choice("ab"), r.choice("xy"), t0, None if t0 is None else t0 + r.choice([0, 1, 5, 40, 400]), r.randint(0, 4)))
    windows += windows[:5]
    flows = [(i, r.choice("abc"), r.choice("xyz"), r.choice([None, t]) if i % 40 == 0 else t, t + r.choice([1, 60])) for i, t in enumerate(r.choices(range(-5, 950), k=400))]
    flows += [(1000 + i, b, a, t, e) for i, a, b, t, e in flows[:100]]
    sched = spark.createDataFrame(windows, "attack string, src string, dst string, t0 long, t1 long, priority int")
    df = spark.createDataFrame(flows, "id long, s string, d string, t long, e long")
    for mode in ("5tuple", "5tuplebi", "AGM"):
        got = {x["id"]: (x["Attack"], x["Label"]) for x in LB.label_flows(df, sched, mode, src="s", dst="d", start="t", end="e").collect()}
        want = {i: _plain_label(windows, mode, a, b, t, e) for i, a, b, t, e in flows}
        assert got == {i: (w, int(w != "Normal")) for i, w in want.items()}, mode


def test_many_windows_on_one_address_cost_little_more(spark):
    import time

    def seconds(n):
        sched = spark.range(n).selectExpr("concat('w', id) as attack", "'a' as src", "'x' as dst", "id * 10 as t0", "id * 10 + 12 as t1", "1 as priority")
        sched = spark.createDataFrame(sched.toPandas())
        df = spark.range(20_000).selectExpr("id", "'a' as s", "'x' as d", f"id * 7919 % {10 * n} as t")
        out = LB.label_flows(df, sched, "5tuple", src="s", dst="d", start="t")
        t0 = time.perf_counter()
        assert out.where("Label = 1").count() == 20_000
        return time.perf_counter() - t0
    seconds(100)
    few, many = seconds(1000), seconds(100_000)
    assert many < 3 * few + 6  # a walk over every window would take 100 times as long


def test_shuffled_join_equals_broadcast(spark, no_broadcast):
    flows = pair_flows(spark, SF01)
    sched = attack_schedule(spark, SF01)
    cols = FW.FIVE_TUPLE + ["session", "Attack", "Label"]
    small = {m: LB.label_flows(flows, sched, m) for m in ("5tuple", "5tuplebi")}
    want = {m: _rows(d, cols) for m, d in small.items()}
    assert all(d.where(F.col("Label") == 1).count() > 0 for d in small.values())
    no_broadcast()
    for m in want:
        large = LB.label_flows(flows, sched, m)
        assert "SortMergeJoin" in large._jdf.queryExecution().executedPlan().toString()
        assert _rows(large, cols) == want[m]


def test_agm_overlap(spark, no_broadcast):
    f = FW.agm_flow_id(pkt_user(spark, SF01), 5 * 86400).groupBy("src", "win").agg(
        F.min("ts").alias("flow_start"), F.max("ts").alias("flow_end"))
    sched = agm_schedule(spark, SF01)
    args = dict(src="src", start="flow_start", end="flow_end")
    want = _rows(LB.label_flows(f, sched, "AGM", **args), ["src", "win", "Attack", "Label"])
    no_broadcast()
    assert _rows(LB.label_flows(f, sched, "AGM", **args), ["src", "win", "Attack", "Label"]) == want


def test_one_row_out_per_flow_and_any_time_type(spark):
    t = dt.datetime(2024, 1, 1, 8)
    hour = dt.timedelta(hours=1)
    flows = spark.createDataFrame([("a", "b", t + 2 * hour)] * 3 + [("a", "b", t + 9 * hour), ("a", None, t), ("b", "a", t + hour)],
                                  "sourceIPAddress string, destinationIPAddress string, flow_start timestamp_ntz")
    sched = spark.createDataFrame([("DoS", "a", "b", t, t + 8 * hour, 2), ("Scan", "a", "b", t + hour, t + 3 * hour, 1),
                                   ("Bot", "a", "b", t + hour, t + 3 * hour, 1)],
                                  "attack string, src string, dst string, t0 timestamp_ntz, t1 timestamp_ntz, priority int")
    got = sorted(r["Attack"] for r in LB.label_flows(flows, sched, "5tuple").collect())
    assert got == ["Bot"] * 3 + ["Normal"] * 3
    assert LB.label_flows(flows, sched, "5tuplebi").where("Label = 1").count() == 4
    ms = flows.withColumn("flow_start", millis(F.col("flow_start")))
    sched_ms = sched.withColumns({"t0": millis(F.col("t0")), "t1": millis(F.col("t1"))})
    assert sorted(r["Attack"] for r in LB.label_flows(ms, sched_ms, "5tuple").collect()) == got


def test_label_plan_has_no_exchange_after_the_join(spark):
    df = LB.label_flows(pair_flows(spark, SF01), attack_schedule(spark, SF01), "5tuple")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "Exchange" not in plan[:plan.index("HashJoin")]


def test_quantiles_with_one_heavy_value(spark):
    x = spark.range(20000).select(F.when(F.col("id") % 10 > 0, 0.0).otherwise(F.col("id").cast("double")).alias("x"),
                                  F.lit(None).cast("double").alias("y"))
    got = {r["column"]: r for r in LB.describe(x, ["x", "y"]).collect()}
    want = x.select("x").toPandas()["x"].quantile([0.25, 0.5, 0.75]).tolist()
    assert [got["x"]["p25"], got["x"]["p50"], got["x"]["p75"]] == want and got["x"]["count"] == 20000
    assert got["y"]["count"] == 0 and got["y"]["p50"] is None
    # the scan runs over counted values: the heavy one is a single row
    counted = x.groupBy("x").count()
    sizes = [r["count"] for r in bucketize(counted, ["x"], 16).groupBy("_tl_bucket").count().collect()]
    assert len(sizes) > 8 and max(sizes) < 2001 / 4
    li = table(spark, SF01, "lineitem").select("l_quantity").toPandas()["l_quantity"]
    q = LB.exact_quantiles(table(spark, SF01, "lineitem"), ["l_quantity"], [0.1, 0.9]).first()
    assert [q["q0"], q["q1"]] == pytest.approx(li.quantile([0.1, 0.9]).tolist())
