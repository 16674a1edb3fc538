"""U4: a user's own flow cutter, batch and stream."""

import datetime as dt
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF001
from trafficlab.operators import flows as FW
from trafficlab.operators.cutters import IdleCutter, cut_flows
from trafficlab.session import scratch_path
from trafficlab.sources.tables import pkt_pair
from trafficlab.streaming import streams as ST


def count_cutter(n):
    """A new flow after every ``n`` packets, or at a packet of 0 octets (a local class travels by value)."""
    class CountCutter:
        def begin(self):
            return 0, 0

        def cut(self, state, packets):
            number, held = state
            flows = []
            for octets in packets["octets"]:
                if held and (held == n or octets == 0):
                    number, held = number + 1, 0
                held += 1
                flows.append(number)
            return np.array(flows, dtype=np.int64), (number, held)
    return CountCutter()


def test_idle_cutter_equals_the_built_in_one(spark):
    packets = FW.with_canonical_key(pkt_pair(spark, SF001))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # keys are cut between batches
    try:
        got = {r["packet_no"]: r["flow"] for r in cut_flows(packets, FW.FIVE_TUPLE, IdleCutter(6 * 3600)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {r["packet_no"]: r["session"] for r in FW.sessionize(packets, FW.FIVE_TUPLE, 6 * 3600).collect()}
    assert got == want and max(got.values()) > 3


def test_stream_cutter_equals_batch(spark):
    t0 = dt.datetime(2024, 1, 1)
    r = random.Random(2)
    rows = [(r.choice(["a", "b"]), i, t0 + dt.timedelta(minutes=i), r.choice([0, 5, 6, 7, 8])) for i in range(60)]
    df = spark.createDataFrame(rows, "src string, packet_no long, ts timestamp, octets long")
    src, out, ck = (scratch_path(spark, f"cut-{x}") for x in ("in", "out", "ck"))
    for part in ([i for i in range(60) if i < 40 and i % 3], [i for i in range(60) if i >= 40 or i % 3 == 0]):
        df.where(F.col("packet_no").isin(part)).coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)
    ST.append_end_marker(df, src)
    ST.run_append(ST.cut_stream(ST.packet_stream(spark, src, df.schema), ["src"], count_cutter(4), "1 day"), out, ck)
    got = {x["packet_no"]: x["flow"] for x in spark.read.parquet(out).collect()}
    assert got == {x["packet_no"]: x["flow"] for x in cut_flows(df, ["src"], count_cutter(4)).collect()} and len(got) == 60


def test_wrong_answers_raise(spark):
    class Falling(IdleCutter):
        def cut(self, state, packets):
            return -super().cut(state, packets)[0] - 1, state

    df = spark.createDataFrame([("a", 1, dt.datetime(2024, 1, 1))], "src string, packet_no long, ts timestamp")
    with pytest.raises(Exception, match="never falling"):
        cut_flows(df, ["src"], Falling(1)).collect()
    assert cut_flows(df.limit(0), ["src"], IdleCutter(1)).count() == 0
