"""Flag tie rule, modes, stdev and flow vectors on micro fixtures."""

import datetime as dt

from pyspark.sql import functions as F

from trafficlab.operators import flows as FW
from trafficlab.functions.flags import FLAG_LETTERS


def _flags(spark, combos):
    rows = [("f", i, c) for i, c in enumerate(combos)]
    df = spark.createDataFrame(rows, "src string, packet_no long, flags string")
    r = FW.flag_summary(df, ["src"]).collect()[0]
    return {c for c in FLAG_LETTERS if r[c] == 1}, r["modeCount(_tcpFlags)"], r["distinct(_tcpFlags)"]


def test_flag_tie_rule(spark):
    assert _flags(spark, ["S", "S", "A"])[0] == {"S"}
    assert _flags(spark, ["SA", "SA", "A", "A"])[0] == {"A"}
    assert _flags(spark, ["SA", "PA"])[0] == {"A"}
    assert _flags(spark, ["S", "A"])[0] == {"S", "A"}
    assert _flags(spark, ["A", ""])[0] == set()
    letters, mc, dist = _flags(spark, ["", ""])
    assert letters == set() and mc == 2 and dist == 1


def test_modes(spark):
    df = spark.createDataFrame([("f", 0, 2, "b"), ("f", 1, 1, "a"), ("f", 2, 2, "a"), ("f", 3, 1, "b")],
                               "src string, packet_no long, v long, s string").withColumn("ts", F.col("packet_no"))
    assert FW.mode_numeric(df, ["src"], "v").collect()[0]["mode(v)"] == 1
    assert FW.mode_text(df, ["src"], "s").collect()[0]["mode(s)"] == "b"


def test_single_packet_flow(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", "b", 1, 2, 6, 0, t, 100, 140, "S", "x", 60)],
                               "src string, dst string, sport long, dport long, proto long, packet_no long, "
                               "ts timestamp, octets long, ip_len long, flags string, capture string, ttl long")
    r = FW.caia_vector(df, 300, num_buckets=2).collect()[0]
    assert r["count(packetTotalCount,forward)"] == 1
    assert r["count(packetTotalCount,backward)"] == 0
    assert r["stdev(ipTotalLength,forward)"] == 0.0
    assert r["min(_interPacketTimeSeconds,forward)"] is None
    assert r["min(ipTotalLength,backward)"] is None


def test_flow_counts_add_up(spark):
    from trafficlab.sources.tables import pkt_pair
    from tests.conftest import SF001
    p = pkt_pair(spark, SF001)
    v = FW.caia_vector(p, 6 * 3600, active_seconds=None)
    tot = v.agg(F.sum("count(packetTotalCount,forward)") + F.sum("count(packetTotalCount,backward)")).first()[0]
    assert tot == p.count()


def test_agm_timeouts_reduce_to_windows(spark):
    """With timeouts longer than the window, the cut changes nothing."""
    from trafficlab.sources.tables import pkt_user
    from tests.conftest import SF001
    p = pkt_user(spark, SF001)
    plain = {tuple(r) for r in FW.agm_vector(p, 86400).collect()}
    cut = FW.agm_vector(p, 86400, idle_seconds=10 * 86400, active_seconds=20 * 86400)
    assert {tuple(r) for r in cut.collect()} == plain
    # a short idle timeout splits flows: never fewer flows than windows
    short = FW.agm_vector(p, 86400, idle_seconds=3600)
    assert short.count() >= len(plain)


def _plain_active(rows, idle, active):
    """(key, n) -> (session, subflow) by walking each key's packets in order."""
    out = {}
    for key in {k for k, _, _ in rows}:
        last = start = None
        s = -1
        for t, n in sorted((t, n) for k, n, t in rows if k == key):
            if last is None or t - last > idle:
                s, sub, start = s + 1, 0, t
            elif t - start > active:
                sub, start = sub + 1, t
            out[key, n] = (s, sub)
            last = t
    return out


def test_active_timeout_equals_a_walk(spark):
    import random

    r = random.Random(4)
    rows, n = [], 0
    for key in ("a", "b", None, "hot"):
        t = 0
        for _ in range(900 if key == "hot" else 120):
            t += r.choice([0, 1, 3, 10, 10, 40, 99, 100] + [101] * (key != "hot"))
            rows.append((key, n, t))
            n += 1
    base = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(k, i, base + dt.timedelta(seconds=t)) for k, i, t in rows], "k string, packet_no long, ts timestamp_ntz")
    for idle, active in ((100, 300), (100, 30), (1000, 7), (100, 10_000_000)):
        sizes = []
        out = FW.active_timeout(df, ["k"], idle, active, num_buckets=5, flow_start="f", on_round=sizes.append).collect()
        got = {(x["k"], x["packet_no"]): (x["session"], x["subflow"]) for x in out}
        assert got == _plain_active(rows, idle, active)
        first = {}
        for x in out:
            key = (x["k"], x["session"], x["subflow"])
            first[key] = min(first.get(key, x["ts"]), x["ts"])
        assert all(x["f"] == first[x["k"], x["session"], x["subflow"]] for x in out)
        assert sizes[-1] == 0
        if (idle, active) == (100, 300):
            # once blocks are longer than the entry zone every round holds about half of the one before
            assert len(sizes) > 4 and all(b <= 0.75 * a for a, b in zip(sizes[1:], sizes[2:]))


def test_active_timeout_scans_whole_packets_once(spark, monkeypatch):
    """Behind the sessions' scan only the packets that may be cuts are scanned, and then the cuts alone."""
    base = dt.datetime(2024, 1, 1)
    rows = [("long", i, base + dt.timedelta(seconds=10 * i)) for i in range(1000)]
    rows += [("short", 1000 + 3 * i + j, base + dt.timedelta(seconds=1000 * i + 10 * j)) for i in range(200) for j in range(3)]
    df = spark.createDataFrame(rows, "k string, packet_no long, ts timestamp_ntz").withColumn("payload", F.lit("x"))
    scanned = []

    def scan(d, *args, **kwargs):
        scanned.append((d.count(), "payload" in d.columns))
        return keyed_scan(d, *args, **kwargs)

    keyed_scan = FW.keyed_scan
    monkeypatch.setattr(FW, "keyed_scan", scan)
    out = FW.active_timeout(df, ["k"], 100, 300, num_buckets=5)
    assert out.where("k = 'long'").agg(F.max("subflow")).first()[0] == 32 and out.where("k = 'short'").agg(F.max("subflow")).first()[0] == 0
    # the long session's packets behind 300 s and their probes, and a probe of every session's first packet
    assert scanned == [(1600, True), (2 * 969 + 201, False), (33, False)]


def test_caia_vector_aggregates_by_hash(spark, monkeypatch):
    """Flows are a hash aggregate (no sort of all packets), and the scan takes the columns it needs."""
    from trafficlab.sources.tables import pkt_pair
    from tests.conftest import SF001
    cols = []
    keyed_scan = FW.keyed_scan
    monkeypatch.setattr(FW, "keyed_scan", lambda d, *a, **k: cols.append(set(d.columns)) or keyed_scan(d, *a, **k))
    v = FW.caia_vector(pkt_pair(spark, SF001), 6 * 3600, active_seconds=24 * 3600)
    plan = v._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    assert not cols[0] & {"capture", "ttl", "src", "dst", "sport", "dport"}
    ends = v.select("sourceIPAddress", "sourceTransportPort", "destinationIPAddress", "destinationTransportPort").collect()
    assert len(ends) > 0 and all({r[0][0], r[2][0]} == {"c", "s"} and (r[1] >= 50000) == (r[0][0] == "c") for r in ends)
