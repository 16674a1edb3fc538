"""Sampling predicates: golden micro cases and properties."""

from pyspark.sql import functions as F

from trafficlab.operators import sampling as S


def _flow(spark, n):
    return spark.createDataFrame([(1, i, i) for i in range(n)], "flow long, ts long, packet_no long")


def _kept(spark, mode, n, length=12):
    out = S.sample_flow(_flow(spark, length), "flow", mode, n, order=["ts", "packet_no"], num_partitions=3)
    return sorted(r.pos for r in out.collect())


def test_flow_modes_micro(spark):
    assert _kept(spark, "every_nth", 2) == [0, 2, 4, 6, 8, 10]
    assert _kept(spark, "take_skip", 2) == [0, 1, 4, 5, 8, 9]
    assert _kept(spark, "first_n", 3) == [0, 1, 2]
    assert _kept(spark, "decaying", 5) == [0, 1, 2, 3, 4, 9, 10, 11]
    assert _kept(spark, "decaying", 5, 20) == [0, 1, 2, 3, 4, 9, 10, 11, 14]
    assert _kept(spark, "every_nth", 1) == list(range(12))


def test_decaying_bursts():
    assert S.decaying_bursts(5) == [(0, 5), (9, 12), (14, 15)]
    assert S.decaying_bursts(1) == [(0, 1)]


def test_packet_sampling_counts(spark):
    p = spark.range(0, 23).select(F.col("id").alias("packet_no"), F.col("id").alias("ts"))
    s5 = S.sample_packets(p, "every_nth", 4)
    assert sorted(r.pos for r in s5.collect()) == [0, 4, 8, 12, 16, 20]
    s7 = S.sample_packets(p, "srs_per_block", 2, split=5)
    assert s7.count() == S.expected_sample_count(23, "srs_per_block", 2, split=5) == 4 * 3 + 2
    s6 = S.sample_packets(p, "n_of_N", 3)  # blocks of 9; tail block of 5 drawn from 9 slots
    per_block = {}
    for r in s6.collect():
        per_block.setdefault(r.pos // 9, []).append(r.pos)
    assert len(per_block[0]) == 3 and len(per_block[1]) == 3 and len(per_block.get(2, [])) <= 3


def test_sampled_subset_and_dropped_complement(spark):
    from trafficlab.sources.tables import pkt_user
    from tests.conftest import SF001
    p = pkt_user(spark, SF001)
    s = S.sample_packets(p, "every_nth", 3)
    d = S.dropped_packets(p, s)
    assert s.count() + d.count() == p.count()
    assert s.join(p, "packet_no", "left_anti").count() == 0


def test_partition_invariance(spark):
    from trafficlab.sources.tables import pkt_order, ORDER_SORT
    from tests.conftest import SF001
    o = pkt_order(spark, SF001)
    a = {tuple(r) for r in S.sample_flow(o, "l_orderkey", "take_skip", 2, order=ORDER_SORT, num_partitions=1)
         .select("l_orderkey", "l_linenumber", "l_partkey", "pos").collect()}
    b = {tuple(r) for r in S.sample_flow(o.repartition(7), "l_orderkey", "take_skip", 2, order=ORDER_SORT,
                                         num_partitions=64).select("l_orderkey", "l_linenumber", "l_partkey", "pos").collect()}
    assert a == b


def test_first_n_uses_group_limit(spark):
    out = S.sample_flow(_flow(spark, 30), "flow", "first_n", 3, order=["ts", "packet_no"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_user_rule(spark):
    # Keep positions whose square is below 30 (0..5)
    out = S.sample_flow(_flow(spark, 12), "flow", lambda pos, n: pos * pos < n, 30, order=["ts", "packet_no"])
    assert sorted(r.pos for r in out.collect()) == [0, 1, 2, 3, 4, 5]


def test_n_one_is_identity_and_first_n_idempotent(spark):
    from trafficlab.sources.tables import pkt_user, pkt_order, ORDER_SORT
    from tests.conftest import SF001
    p = pkt_user(spark, SF001)
    total = p.count()
    assert S.sample_packets(p, "every_nth", 1).count() == total
    assert S.sample_packets(p, "srs_per_block", 1).count() == total
    o = pkt_order(spark, SF001)
    assert S.sample_flow(o, "l_orderkey", "every_nth", 1, order=ORDER_SORT).count() == o.count()
    once = S.sample_flow(o, "l_orderkey", "first_n", 2, order=ORDER_SORT).drop("pos")
    twice = S.sample_flow(once, "l_orderkey", "first_n", 2, order=ORDER_SORT).drop("pos")
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    assert {tuple(r) for r in once.select(*cols).collect()} == {tuple(r) for r in twice.select(*cols).collect()}


def test_n_of_big_n_takes_one_scan_and_equals_a_draw_of_all_slots(spark):
    import hashlib

    for total, n in ((0, 3), (5, 3), (9, 3), (41, 4), (230, 10), (7, 1)):
        p = spark.range(total).select(F.col("id").alias("packet_no"), F.col("id").alias("ts"))
        got = sorted(r["pos"] for r in S.sample_packets(p, "n_of_N", n, seed=5).collect())
        big, want = n * n, []
        for b in range(-(-total // big)):
            slots = sorted(range(b * big, b * big + big), key=lambda q: hashlib.md5(f"5:{q}".encode()).hexdigest())[:n]
            want += [q for q in slots if q < total]
        assert got == sorted(want)
    plan = S.sample_packets(p, "n_of_N", 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan and "Generate" not in plan
