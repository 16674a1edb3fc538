"""Plan shape: no single-partition exchange on packet rows, broadcasts where
the side is bounded, pushdown and pruning at the scan."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from tests.conftest import SF001


def _plan(df):
    df.write.format("noop").mode("overwrite").save()  # final adaptive plan
    return df._jdf.queryExecution().executedPlan().toString()


def test_position_has_no_single_partition_on_rows(spark):
    from trafficlab.operators.sampling import with_position
    from trafficlab.sources.tables import pkt_user
    df = with_position(pkt_user(spark, SF001))
    plan = _plan(df)
    # SinglePartition may only appear on the per-bucket summary, never before
    # the row window: the row window partitions by the bucket
    assert "hashpartitioning(_tl_bucket" in plan


def test_label_join_is_broadcast(spark):
    df = E.queries()["label_5tuple"](spark, SF001)
    assert "BroadcastHashJoin" in _plan(df)


def test_scan_prunes_columns_and_pushes_filters(spark):
    from trafficlab.sources.tables import table
    li = table(spark, SF001, "lineitem").where(F.col("l_quantity") > 10).select("l_orderkey")
    plan = li._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,10.0)]" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_no_python_udf_on_main_path(spark):
    for key in ["pkt_every_nth", "flow_decaying", "agm_vector", "caia_vector"]:
        plan = _plan(E.queries()[key](spark, SF001))
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, key


def test_session_summary_reuses_row_shuffle(spark):
    df = E.queries()["idle_sessions"](spark, SF001)
    df.collect()  # the collected plan is the final adaptive plan
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan
    assert "ReusedExchange" in plan
