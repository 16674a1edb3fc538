"""Flow specs: both envelopes, canonical names, user functions."""

from pyspark.sql import functions as F

import datetime as dt

import pytest

from trafficlab.operators import flows as FW
from trafficlab.operators.flowspec import FlowSpec, agm_spec, caia_spec, extract_flows, feature_name, register_flow_function


def test_envelopes_and_names():
    flat = FlowSpec.from_json({"features": agm_spec().features, "key_features": agm_spec().key_features})
    inner = {"features": caia_spec().features, "key_features": caia_spec().key_features, "bidirectional": True, "idle_timeout": 300}
    v2 = FlowSpec.from_json({"version": "v2", "preprocessing": {"flows": [inner]}})
    assert not flat.bidirectional and flat.window_seconds() == 10
    assert v2.bidirectional and v2.idle_timeout == 300
    assert feature_name({"apply": [{"min": ["ipTotalLength"]}, "forward"]}) == "apply(min(ipTotalLength),forward)"


def test_user_function(spark):
    register_flow_function("range", lambda v, c: F.max(v) - F.min(v))
    spec = FlowSpec.from_json({"features": ["sourceIPAddress", {"range": ["ipTTL"]}, {"min": ["ipTTL"]},
                                            {"max": ["ipTTL"]}],
                               "bidirectional": False, "key_features": ["sourceIPAddress", "__timeWindow60s"]})
    t = dt.datetime(2024, 1, 1)
    rows = [("a", i, t + dt.timedelta(seconds=i), 60 + i % 3, 10) for i in range(9)]
    df = spark.createDataFrame(rows, "src string, packet_no long, ts timestamp, ttl long, octets long")
    r = extract_flows(df, spec).collect()[0]
    assert r["range(ipTTL)"] == r["max(ipTTL)"] - r["min(ipTTL)"] == 2


def test_deviation_of_large_values_with_a_small_spread(spark):
    spec = FlowSpec.from_json({"features": ["sourceIPAddress", {"stdev": ["octetTotalCount"]}, {"mean": ["octetTotalCount"]}, {"stdev": ["ipTTL"]}],
                               "bidirectional": False, "key_features": ["sourceIPAddress", "__timeWindow60s"]})
    t = dt.datetime(2024, 1, 1)
    rows = [(k, i, t + dt.timedelta(seconds=i), None if k == "b" else 60, 10 ** 9 + (-1) ** i) for k in "ab" for i in range(10)] + [(None, 30, t, 5, 7)]
    df = spark.createDataFrame(rows, "src string, packet_no long, ts timestamp, ttl long, octets long").repartition(4)
    got = {r["sourceIPAddress"]: r for r in extract_flows(df, spec).collect()}
    assert abs(got["a"]["stdev(octetTotalCount)"] - (10 / 9) ** 0.5) < 1e-7 and got["a"]["mean(octetTotalCount)"] == 1e9
    assert got["a"]["stdev(ipTTL)"] == 0.0 and got["b"]["stdev(ipTTL)"] is None
    assert got[None]["stdev(octetTotalCount)"] == 0.0


def _packets(spark, seconds, sport=1, dport=2, src="a", dst="b"):
    t = dt.datetime(2024, 1, 1)
    rows = [("c", i, t + dt.timedelta(seconds=s), src, dst, sport, dport, 6, 64, 10, 10, "S") for i, s in enumerate(seconds)]
    return spark.createDataFrame(rows, "capture string, packet_no long, ts timestamp_ntz, src string, dst string, sport long, dport long, proto long, ttl long, octets long, ip_len long, flags string")


def test_timeouts_cut_inside_a_window(spark):
    p = _packets(spark, [0, 10, 1000, 1010, 2000])
    assert extract_flows(p, agm_spec(3600)).count() == 1
    assert extract_flows(p, agm_spec(3600, idle=300)).count() == 3
    slow = _packets(spark, range(0, 2400, 60))
    assert extract_flows(slow, agm_spec(7200, idle=300, active=1800)).count() == 2
    assert extract_flows(slow, caia_spec(300)).count() == 1
    assert extract_flows(slow, caia_spec(300, active=1800)).count() == 2


def test_unsupported_features_raise(spark):
    p = _packets(spark, [0])
    with pytest.raises(ValueError):
        extract_flows(p, FlowSpec([{"apply": [{"median": ["ipTTL"]}, "forward"]}], ["sourceIPAddress", "__timeWindow10s"]))
    with pytest.raises(ValueError):
        extract_flows(p, FlowSpec([{"apply": [{"accumulate": ["ipTTL"]}, "backward"]}], ["sourceIPAddress", "__timeWindow10s"]))
    with pytest.raises(ValueError):
        extract_flows(p, FlowSpec([{"apply": [{"median": ["ipTTL"]}, "forward"]}], [], True))
    with pytest.raises(ValueError):
        extract_flows(p, FlowSpec([{"apply": [{"accumulate": ["none"]}, "forward"]}], [], True))
    with pytest.raises(ValueError):
        FlowSpec.from_json({"features": [], "key_features": [], "rate_limit": 3})


def test_accumulate(spark):
    there, back = _packets(spark, [0, 20, 40]), _packets(spark, [10, 30], 2, 1, "b", "a").withColumn("ttl", F.lit(None).cast("long"))
    p = there.unionByName(back.withColumn("packet_no", F.col("packet_no") + 10))
    lists = [{"apply": [{"accumulate": [a]}, d]} for a in ("ipTTL", "tcpSynTotalCount", "_interPacketTimeSeconds") for d in ("forward", "backward")]
    r = extract_flows(p, FlowSpec(["sourceIPAddress", *lists], [], True, 1800, 300)).collect()
    assert [tuple(x) for x in r] == [("a", [64, 64, 64], [None, None], [1, 1, 1], [1, 1], [None, 20.0, 20.0], [None, 20.0])]
    spec = FlowSpec(["sourceIPAddress", {"apply": [{"accumulate": ["destinationTransportPort"]}, "forward"]}], ["sourceIPAddress", "__timeWindow60s"], False, 1800, 300)
    assert sorted((x[1], x[2]) for x in extract_flows(p, spec).collect()) == [("a", [2, 2, 2]), ("b", [1, 1])]


def test_vector_cuts_long_flows(spark):
    slow = _packets(spark, range(0, 2400, 60))
    assert FW.caia_vector(slow).count() == 2
    assert FW.caia_vector(slow, active_seconds=None).count() == 1


def test_traffic_without_ports_is_kept(spark):
    p = _packets(spark, range(40)).unionByName(_packets(spark, range(40), None, None)).unionByName(_packets(spark, range(5), None, None, "z", "z"))
    keyed = FW.with_canonical_key(p)
    assert keyed.where("a_side is null").count() == 0
    assert FW.with_direction(keyed, FW.FIVE_TUPLE).count() == 85
    slow = list(range(0, 2400, 60))
    both = _packets(spark, slow).unionByName(_packets(spark, slow, None, None))
    cut = FW.active_timeout(FW.with_canonical_key(both), FW.FIVE_TUPLE, 300, 1800)
    assert cut.count() == 80
    assert sorted(r["n"] for r in cut.groupBy("a_port").agg(F.countDistinct("subflow").alias("n")).collect()) == [2, 2]
