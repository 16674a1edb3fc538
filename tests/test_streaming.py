"""Streaming: batch equality, restart from checkpoint, late packets."""

import datetime as dt

from pyspark.sql import functions as F

from trafficlab.session import scratch_path
from trafficlab.streaming import streams as ST
from trafficlab.streaming.stateful import cut


def _packets(spark, rows):
    return spark.createDataFrame(rows, "src string, packet_no long, ts timestamp, octets long")


def test_sampler_carry_and_restart(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", i, t0 + dt.timedelta(minutes=i), 1) for i in range(20)]
    df = _packets(spark, rows)
    src = scratch_path(spark, "s-in")
    ST.stage_files(df, src, "ts", 3)
    out, ck = scratch_path(spark, "s-out"), scratch_path(spark, "s-ck")
    s = ST.sample_stream(ST.packet_stream(spark, src, df.schema), "src", "every_nth", 3)
    ST.run_append(s, out, ck)
    got = sorted(r.packet_no for r in spark.read.parquet(out).collect())
    assert got == [0, 3, 6, 9, 12, 15, 18]          # counter carried across the 3 files
    # restart on the same checkpoint: nothing is processed twice
    s2 = ST.sample_stream(ST.packet_stream(spark, src, df.schema), "src", "every_nth", 3)
    ST.run_append(s2, out, ck)
    assert sorted(r.packet_no for r in spark.read.parquet(out).collect()) == got


def test_late_packets_do_not_disturb_on_time_windows(spark):
    t0 = dt.datetime(2024, 1, 10)
    early = _packets(spark, [("a", i, t0 + dt.timedelta(days=i), 1) for i in range(5)])
    late = _packets(spark, [("a", 99, t0 - dt.timedelta(days=5), 1)])
    src = scratch_path(spark, "late-in")
    import time
    early.coalesce(1).write.parquet(src)
    time.sleep(1.1)
    late.coalesce(1).write.mode("append").parquet(src)
    out, ck = scratch_path(spark, "late-out"), scratch_path(spark, "late-ck")
    s = ST.windowed_flows(ST.packet_stream(spark, src, early.schema), "src", "1 day", watermark="1 day")
    ST.run_update_log(s.select("src", F.col("w.start").alias("start"), "packets"), out, ck)
    rows = ST.latest_rows(spark, out, ["src", "start"]).collect()
    # Spark guarantees that data within the watermark delay is aggregated;
    # a packet older than the watermark may or may not be (it is never
    # merged into an evicted window).  Every on-time packet is counted once.
    on_time = [r for r in rows if r.start >= t0]
    assert sum(r.packets for r in on_time) == 5
    assert all(r.packets == 1 for r in rows)


def test_late_rows_are_data(spark):
    import time

    t0 = dt.datetime(2024, 1, 10)
    src = scratch_path(spark, "late2-in")
    batches = [[(0, 0), (1, 50)], [(2, 25), (3, 100), (4, 26)], [(5, 76), (6, 75), (7, 74), (8, None)], [(9, 200)]]
    schema = _packets(spark, [("a", 0, t0, 1)]).schema

    def arrive(part):
        rows = [("a", n, None if h is None else t0 + dt.timedelta(hours=h), 1) for n, h in part]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)
    out, ck = scratch_path(spark, "late2-out"), scratch_path(spark, "late2-ck")
    for part in batches[:3]:
        arrive(part)
    run = lambda: ST.run_split_late(ST.packet_stream(spark, src, schema), out, ck, "25 hours")
    assert run() == 1  # 74 h lies behind 100 - 25; 25 h does not lie behind 50 - 25
    arrive(batches[3])
    assert run() == 0  # a restart goes on with the old watermark
    rows = spark.read.parquet(out).collect()
    assert sorted(r["packet_no"] for r in rows) == list(range(10))
    assert [r["packet_no"] for r in rows if r["late"]] == [7]


def test_waiting_packets_are_written_once_and_survive_a_restart(spark):
    t0 = dt.datetime(2024, 1, 1)
    df = _packets(spark, [("a", i, t0 + dt.timedelta(minutes=i), 1) for i in range(60)])
    src, out, ck = scratch_path(spark, "wait-in"), scratch_path(spark, "wait-out"), scratch_path(spark, "wait-ck")

    def run():
        s = ST.sample_stream(ST.packet_stream(spark, src, df.schema), "src", "n_of_N", 3, watermark="10 days")
        q = s.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start()
        q.awaitTermination()
        return [p["stateOperators"][0]["numRowsUpdated"] for p in q.recentProgress if p["numInputRows"]]
    import time
    for i in range(0, 50, 10):
        df.where(f"packet_no between {i} and {i + 9}").coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)
    updated = run()
    assert len(updated) == 5 and max(updated[1:]) <= updated[0]  # the fifth batch writes no more than the first
    df.where("packet_no >= 50").coalesce(1).write.mode("append").parquet(src)
    time.sleep(1.1)
    ST.append_end_marker(df, src, after="30 days")
    run()
    got = sorted(r["pos"] for r in spark.read.parquet(out).collect())
    keep = ST._n_of_n_kept(3, 1000)
    import numpy as np
    assert got == np.flatnonzero(keep(np.arange(60))).tolist()


def test_block_choice_equals_the_batch_sampler(spark):
    import numpy as np
    from trafficlab.operators import sampling as S
    for n in (2, 3, 7):
        p = spark.range(3 * n * n + 2).select(F.col("id").alias("packet_no"), F.col("id").alias("ts"))
        batch = sorted(r["pos"] for r in S.sample_packets(p, "n_of_N", n, seed=9).collect())
        assert np.flatnonzero(ST._n_of_n_kept(n, 9)(np.arange(3 * n * n + 2))).tolist() == batch
    assert len(ST._block_choice(100, 9, 2)) == 100


def test_windowed_stream_equals_batch(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(f"s{i % 3}", i, t0 + dt.timedelta(hours=7 * i), i) for i in range(40)]
    df = _packets(spark, rows)
    src = scratch_path(spark, "w-in")
    ST.stage_files(df, src, "ts", 3)
    out, ck = scratch_path(spark, "w-out"), scratch_path(spark, "w-ck")
    s = ST.windowed_flows(ST.packet_stream(spark, src, df.schema), "src", "2 days")
    s = s.select("src", F.col("w.start").alias("start"), "packets", "octets")
    ST.run_update_log(s, out, ck)
    got = {(r.src, r.packets, r.octets) for r in ST.latest_rows(spark, out, ["src", "start"]).collect()}
    batch = df.groupBy("src", F.window("ts", "2 days")).agg(F.count(F.lit(1)).alias("p"), F.sum("octets").alias("o"))
    assert got == {(r.src, r.p, r.o) for r in batch.collect()}


def test_stream_scoring_equals_batch(spark):
    from trafficlab.operators import ml as M
    from trafficlab.operators.prep import assemble
    data = spark.createDataFrame([(i, float(i % 3 == 0), float(i % 7), float(i % 5)) for i in range(120)],
                                 "vec_id long, label double, a double, b double")
    feats = assemble(data, ["a", "b"]).select("vec_id", "label", "features")
    model = M.fit_forest(feats, num_trees=5, max_depth=4)
    src = scratch_path(spark, "score-in")
    feats.write.parquet(src)
    s = spark.readStream.schema(feats.schema).option("maxFilesPerTrigger", 1).parquet(src)
    out, ck = scratch_path(spark, "score-out"), scratch_path(spark, "score-ck")
    ST.run_append(ST.score_stream(model, s).select("vec_id", "prediction"), out, ck)
    streamed = {tuple(r) for r in spark.read.parquet(out).collect()}
    batch = {tuple(r) for r in model.transform(feats).select("vec_id", "prediction").collect()}
    assert streamed == batch and len(batch) == 120


def _stage_parts(spark, df, parts, name):
    """Files arriving in the given order, then the end marker."""
    import time
    src = scratch_path(spark, name)
    for nos in parts:
        df.where(F.col("packet_no").isin(nos)).coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)
    ST.append_end_marker(df, src, after="30 days")
    return src


def _run(spark, stream, name):
    out = scratch_path(spark, f"{name}-out")
    ST.run_append(stream, out, scratch_path(spark, f"{name}-ck"))
    return spark.read.parquet(out).where("src is not null")


def test_packets_out_of_order_give_the_batch_flows(spark):
    t0 = dt.datetime(2024, 1, 1)
    seconds = [0, 50, 40, 120, 300, 310, 320, 390, 395]
    df = _packets(spark, [("a", i, t0 + dt.timedelta(seconds=s), 1) for i, s in enumerate(seconds)]
                  + [("b", 100 + i, t0 + dt.timedelta(seconds=10 * i), None) for i in range(30)])
    src = _stage_parts(spark, df, [[0, 1, *range(100, 130, 2)], [2, 3, 7, *range(101, 130, 2)], [4, 5, 6, 8]], "ooo-in")
    flows = ST.timeout_flows(ST.packet_stream(spark, src, df.schema), ["src"], 75, 100, watermark="1 day")
    got = sorted((r.src, r.flowStartMilliseconds // 1000 - int(t0.replace(tzinfo=dt.timezone.utc).timestamp()), r.packets, r.octets)
                 for r in _run(spark, flows, "ooo").collect())
    # a: 120 s is past the active limit of the flow begun at 0, the gap before 300 s past the idle one
    assert got == [("a", 0, 3, 3), ("a", 120, 1, 1), ("a", 300, 5, 5),
                   ("b", 0, 11, 0), ("b", 110, 11, 0), ("b", 220, 8, 0)]


def test_flow_cut_equals_a_loop_over_packets():
    import numpy as np
    rng = np.random.default_rng(3)
    for _ in range(200):
        us = np.sort(rng.integers(0, 400, rng.integers(1, 40)))
        octets = rng.integers(0, 9, len(us))
        want, cur = [], None
        for u, o in zip(us.tolist(), octets.tolist()):
            if cur and (u - cur[1] > 20 or u - cur[0] > 60):
                want.append(tuple(cur))
                cur = None
            cur = cur or [u, u, 0, 0]
            cur[1], cur[2], cur[3] = u, cur[2] + 1, cur[3] + o
        half = len(us) // 2
        first, flow = cut(us[:half], octets[:half], None, 20, 60)
        rest, flow = cut(us[half:], octets[half:], flow, 20, 60)
        assert first + rest + [flow] == want + [tuple(cur)]


def test_sampler_in_event_time_with_idle_sessions(spark):
    t0 = dt.datetime(2024, 1, 1)
    minutes = [0, 1, 2, 3, 4, 5, 200, 201, 202, 203]
    df = _packets(spark, [("a", i, t0 + dt.timedelta(minutes=m), 1) for i, m in enumerate(minutes)])
    src = _stage_parts(spark, df, [[0, 2, 5], [1, 3, 4], [7, 9], [6, 8]], "idle-in")
    s = ST.sample_stream(ST.packet_stream(spark, src, df.schema), "src", "every_nth", 2, watermark="10 minutes", idle_seconds=3600)
    out, ck = scratch_path(spark, "idle-out"), scratch_path(spark, "idle-ck")
    q = (s.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", ck)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = sorted((r.packet_no, r.pos) for r in spark.read.parquet(out).where("src is not null").collect())
    assert got == [(0, 0), (2, 2), (4, 4), (6, 0), (8, 2)]
    assert ST.dropped_rows(q) == 0
    # idle keys have left the state, timers included; the end marker never enters it
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 0
