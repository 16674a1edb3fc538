"""Streaming state is kept per bucket of keys: many keys, the results of the batch walk."""

import datetime as dt
import time

from trafficlab.session import scratch_path
from trafficlab.streaming import streams as ST
from trafficlab.streaming.stateful import BUCKETS

T0 = dt.datetime(2024, 1, 1)
KEYS = 1500


def _many(spark):
    """1,500 keys, one of them NULL, six packets each over six days, in three files."""
    rows = [(None if k == 7 else f"k{k}", k * 10 + i, T0 + dt.timedelta(hours=h, minutes=k % 90), k + i)
            for k in range(KEYS) for i, h in enumerate((0, 5, 40, 45, 100, 140))]
    return rows, spark.createDataFrame(rows, "src string, packet_no long, ts timestamp, octets long")


def _run(spark, stream, name):
    out = scratch_path(spark, f"{name}-out")
    q = (stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", scratch_path(spark, f"{name}-ck"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out).where("packet_no is not null" if "packet_no" in stream.columns else "true").collect(), q.recentProgress


def _staged(spark, df, name, marker=True):
    src = scratch_path(spark, name)
    for days in ("0 and 1", "2 and 3", "4 and 6"):
        df.where(f"datediff(ts, timestamp'2024-01-01') between {days}").coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)
    if marker:
        ST.append_end_marker(df, src)
    return src


def test_idle_sampler_writes_buckets_not_packets(spark):
    rows, df = _many(spark)
    src = _staged(spark, df, "bk-idle")
    s = ST.sample_stream(ST.packet_stream(spark, src, df.schema), "src", "every_nth", 2, watermark="1 day", idle_seconds=86400)
    got, progress = _run(spark, s, "bk-idle")
    want = set()
    for k in range(KEYS):
        pos, last = 0, None
        for key, no, ts, _ in rows[6 * k:6 * k + 6]:
            pos = 0 if last is None or ts - last > dt.timedelta(days=1) else pos + 1
            last = ts
            if pos % 2 == 0:
                want.add((key, no, pos))
    assert {(r["src"], r["packet_no"], r["pos"]) for r in got} == want and len(got) == len(want)
    states = [p["stateOperators"][0] for p in progress]
    # waiting packets, place, table and timer of a bucket; one and more per packet before
    assert max(p["numRowsUpdated"] for p in states) <= 5 * (BUCKETS + 1)
    assert states[-1]["numRowsTotal"] == 0


def test_arrival_sampler_keeps_one_table_per_bucket(spark):
    rows, df = _many(spark)
    src = _staged(spark, df, "bk-arr", marker=False)
    for mode, n, kept in (("every_nth", 4, (0, 4)), ("first_n", 2, (0, 1))):
        got, progress = _run(spark, ST.sample_stream(ST.packet_stream(spark, src, df.schema), "src", mode, n), f"bk-{mode}")
        want = {(rows[6 * k + i][0], rows[6 * k + i][1], i) for k in range(KEYS) for i in kept}
        assert {(r["src"], r["packet_no"], r["pos"]) for r in got} == want and len(got) == len(want)
        assert progress[-1]["stateOperators"][0]["numRowsTotal"] <= BUCKETS + 1  # one row per key before


def test_flows_of_many_keys(spark):
    rows, df = _many(spark)
    src = _staged(spark, df, "bk-flow")
    got, progress = _run(spark, ST.timeout_flows(ST.packet_stream(spark, src, df.schema), ["src"], 6 * 3600, 86400), "bk-flow")
    ms = lambda t: int(t.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    want = set()
    for k in range(KEYS):
        p = rows[6 * k:6 * k + 6]
        want |= {(p[i][0], ms(p[i][2]), n, sum(x[3] for x in p[i:i + n])) for i, n in ((0, 2), (2, 2), (4, 1), (5, 1))}
    flows = {(r["src"], r["flowStartMilliseconds"], r["packets"], r["octets"]) for r in got}
    assert flows == want and len(got) == len(want)
    assert max(p["stateOperators"][0]["numRowsUpdated"] for p in progress) <= 5 * (BUCKETS + 1)
