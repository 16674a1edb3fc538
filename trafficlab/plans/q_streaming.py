"""Streaming queries (T*): each runs a Structured Streaming job to completion
over the driver's tables staged as arriving files, then returns the sink's
content as a batch DataFrame; the oracle is the matching batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.timecols import col_micros, millis
from ..operators import flows as FW
from ..sources.tables import attack_schedule, pkt_pair, pkt_user
from ..streaming import streams as ST
from .oracle_views import with_views
from .q_flows import ACTIVE_S, ACTIVE_SELECT, IDLE_S, KEY5, KEYED_SQL, WINDOW_S, _WIN_US
from .q_labels import _labeled_cte
from .registry import REGISTRY
from .registry import register

SLICES = 4
DAY_US = 86_400_000_000


def _stage(spark, df, name, copies=1):
    path = ST.fresh_dir(spark, f"in-{name}")
    if copies == 1:
        ST.stage_files(df, path, "ts", SLICES)
    else:
        us = col_micros(df, "ts")
        lo_us, hi_us = df.agg(F.min(us), F.max(us)).first()
        hi_us += 1
        step = (hi_us - lo_us + SLICES - 1) // SLICES
        import time
        for i in range(SLICES):
            part = df.where((us >= lo_us + i * step) & (us < lo_us + (i + 1) * step)).repartition(1)
            for _ in range(copies):
                part.write.mode("append").parquet(path)
                time.sleep(1.1)
    return path


def _updates(spark, stream, keys, name):
    out = ST.fresh_dir(spark, f"out-{name}")
    ST.run_update_log(stream, out, ST.fresh_dir(spark, f"ckpt-{name}"))
    return ST.latest_rows(spark, out, keys)


def _appended(spark, stream, name):
    out = ST.fresh_dir(spark, f"out-{name}")
    ST.run_append(stream, out, ST.fresh_dir(spark, f"ckpt-{name}"))
    return spark.read.parquet(out)


@register("stream_agm", with_views("pkt_user") + f"""
SELECT src, CAST(floor(epoch_us(ts) / {_WIN_US}) AS BIGINT) AS win, count(*) AS packets,
       CAST(sum(octets) AS BIGINT) AS octets, (epoch_us(min(ts)) // 1000) AS flowStartMilliseconds
FROM pkt_user GROUP BY 1, 2""")
def q_stream_agm(spark, sf):
    p = pkt_user(spark, sf)
    path = _stage(spark, p, "agm")
    s = ST.windowed_flows(ST.packet_stream(spark, path, p.schema), "src", f"{WINDOW_S} seconds")
    s = s.select("src", (F.unix_micros(F.col("w.start")) / F.lit(_WIN_US)).cast("long").alias("win"),
                 "packets", F.col("octets").cast("long").alias("octets"),
                 F.unix_millis("first_ts").alias("flowStartMilliseconds"))
    return _updates(spark, s, ["src", "win"], "agm")


@register("stream_sliding", with_views("pkt_user") + f"""
SELECT src, w_start, count(*) AS packets, CAST(sum(octets) AS BIGINT) AS octets FROM (
  SELECT src, octets, (epoch_us(ts) // {DAY_US}) * {DAY_US // 1000} AS w_start FROM pkt_user
  UNION ALL
  SELECT src, octets, (epoch_us(ts) // {DAY_US} - 1) * {DAY_US // 1000} AS w_start FROM pkt_user)
GROUP BY 1, 2""")
def q_stream_sliding(spark, sf):
    p = pkt_user(spark, sf)
    path = _stage(spark, p, "sliding")
    s = ST.windowed_flows(ST.packet_stream(spark, path, p.schema), "src", "2 days", "1 day")
    s = s.select("src", F.unix_millis(F.col("w.start")).alias("w_start"), "packets",
                 F.col("octets").cast("long").alias("octets"))
    return _updates(spark, s, ["src", "w_start"], "sliding")


@register("stream_sessions", with_views("pkt_pair", extra=KEYED_SQL) + f"""
SELECT {KEY5}, (epoch_us(min(ts)) // 1000) AS flowStartMilliseconds, count(*) AS packets,
       CAST(sum(octets) AS BIGINT) AS octets FROM sess GROUP BY {KEY5}, session""")
def q_stream_sessions(spark, sf):
    p = FW.with_canonical_key(pkt_pair(spark, sf))
    path = _stage(spark, p, "sessions")
    ST.append_end_marker(p, path)
    s = ST.session_flows(ST.packet_stream(spark, path, p.schema), FW.FIVE_TUPLE, "6 hours")
    s = s.select(*FW.FIVE_TUPLE, F.unix_millis("first_ts").alias("flowStartMilliseconds"), "packets",
                 F.col("octets").cast("long").alias("octets"))
    # append mode emits a session once the watermark passes it; the end
    # marker closes the sessions still open when the capture ends
    return _appended(spark, s, "sessions").where(F.col("a_ip").isNotNull())


_USER_POS = "up AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY ts, packet_no) - 1 AS pos FROM pkt_user)"


@register("stream_sampler", with_views("pkt_user", extra=_USER_POS) + "SELECT packet_no, src, pos FROM up WHERE pos % 3 = 0")
def q_stream_sampler(spark, sf):
    p = pkt_user(spark, sf)
    path = _stage(spark, p, "sampler")
    s = ST.sample_stream(ST.packet_stream(spark, path, p.schema), "src", "every_nth", 3)
    return _appended(spark, s, "sampler").select("packet_no", "src", "pos")


@register("stream_first_n", with_views("pkt_user", extra=_USER_POS) + "SELECT packet_no, src, pos FROM up WHERE pos < 5")
def q_stream_first_n(spark, sf):
    p = pkt_user(spark, sf)
    path = _stage(spark, p, "firstn")
    s = ST.sample_stream(ST.packet_stream(spark, path, p.schema), "src", "first_n", 5)
    return _appended(spark, s, "firstn").select("packet_no", "src", "pos")


@register("stream_n_of_N", with_views("pkt_user", extra=_USER_POS + """,
blocks AS (SELECT DISTINCT src, pos // 9 AS blk FROM up),
slots AS (SELECT src, blk, unnest(range(blk * 9, blk * 9 + 9)) AS pos FROM blocks),
chosen AS (SELECT src, pos FROM (SELECT src, pos, row_number() OVER (PARTITION BY src, blk
             ORDER BY md5('1000:' || CAST(pos AS VARCHAR)), pos) AS r FROM slots) WHERE r <= 3)""")
          + "SELECT u.packet_no, u.src, u.pos FROM up u JOIN chosen c ON u.src = c.src AND u.pos = c.pos")
def q_stream_n_of_n(spark, sf):
    p = pkt_user(spark, sf)
    path = _stage(spark, p, "nofn")
    s = ST.sample_stream(ST.packet_stream(spark, path, p.schema), "src", "n_of_N", 3)
    return _appended(spark, s, "nofn").select("packet_no", "src", "pos")


_USER_SESSION_POS = f"""
ug AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > {DAY_US} THEN 1 ELSE 0 END AS cut
       FROM pkt_user WINDOW w AS (PARTITION BY src ORDER BY ts, packet_no)),
us AS (SELECT *, sum(cut) OVER (PARTITION BY src ORDER BY ts, packet_no ROWS UNBOUNDED PRECEDING) AS session FROM ug),
up AS (SELECT *, row_number() OVER (PARTITION BY src, session ORDER BY ts, packet_no) - 1 AS pos FROM us)"""


@register("stream_sampler_idle", with_views("pkt_user", extra=_USER_SESSION_POS) + "SELECT packet_no, src, pos FROM up WHERE pos % 2 = 0")
def q_stream_sampler_idle(spark, sf):
    p = pkt_user(spark, sf)
    path = _stage(spark, p, "sampler-idle")
    ST.append_end_marker(p, path)
    s = ST.sample_stream(ST.packet_stream(spark, path, p.schema), "src", "every_nth", 2, watermark="1 day", idle_seconds=86400)
    return _appended(spark, s, "sampler-idle").where(F.col("src").isNotNull()).select("packet_no", "src", "pos")


@register("stream_label", _labeled_cte(True) + f"""SELECT {KEY5}, (epoch_us(flow_start) // 1000) AS flowStartMilliseconds,
  Attack, Label FROM labeled""")
def q_stream_label(spark, sf):
    p = FW.with_canonical_key(pkt_pair(spark, sf))
    path = _stage(spark, p, "label")
    ST.append_end_marker(p, path)
    flows = ST.session_flows(ST.packet_stream(spark, path, p.schema), FW.FIVE_TUPLE, "6 hours")
    flows = flows.select(*FW.FIVE_TUPLE, F.unix_millis("first_ts").alias("flowStartMilliseconds"))
    sched = attack_schedule(spark, sf)
    sched = sched.withColumns({"t0": millis(F.col("t0")), "t1": millis(F.col("t1"))})
    labeled = ST.label_stream(flows, sched, "5tuplebi", src="a_ip", dst="b_ip", start="flowStartMilliseconds")
    return _appended(spark, labeled, "label").where(F.col("a_ip").isNotNull())


@register("stream_time_slots", with_views("pkt_user")
          + f"SELECT DISTINCT src, CAST(floor(epoch_us(ts) / {DAY_US}) AS BIGINT) AS slot FROM pkt_user")
def q_stream_time_slots(spark, sf):
    p = pkt_user(spark, sf)
    path = _stage(spark, p, "slots")
    s = ST.time_slots(ST.packet_stream(spark, path, p.schema), "src", 86400)
    return _appended(spark, s, "slots").select("src", "slot")


@register("stream_dedup", with_views("pkt_user") + "SELECT packet_no FROM pkt_user")
def q_stream_dedup(spark, sf):
    p = pkt_user(spark, sf)
    path = _stage(spark, p, "dedup", copies=2)
    s = ST.dedup_packets(ST.packet_stream(spark, path, p.schema))
    return _appended(spark, s, "dedup").select("packet_no")


@register("stream_scoring")
def q_stream_scoring(spark, sf):
    from .q_ml import _forest
    model, test = _forest(spark, sf, trees=20)
    rows = test.select("vec_id", "label", "features")
    path = ST.fresh_dir(spark, "in-scoring")
    rows.write.parquet(path)
    s = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = ST.fresh_dir(spark, "out-scoring")
    ST.run_scored(model, s, out, ST.fresh_dir(spark, "ckpt-scoring"),
                  ["vec_id", F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction")])
    return spark.read.parquet(out).drop("batch")


_ACTIVE_SQL = REGISTRY["active_sessions"].sql.replace(ACTIVE_SELECT, f"""SELECT {KEY5}, (epoch_us(min(ts)) // 1000) AS flowStartMilliseconds,
  count(*) AS packets, CAST(sum(octets) AS BIGINT) AS octets FROM sub GROUP BY {KEY5}, session, subflow""")


@register("stream_active_flows", _ACTIVE_SQL)
def q_stream_active_flows(spark, sf):
    p = FW.with_canonical_key(pkt_pair(spark, sf))
    path = _stage(spark, p, "active")
    ST.append_end_marker(p, path)
    s = ST.timeout_flows(ST.packet_stream(spark, path, p.schema), FW.FIVE_TUPLE, IDLE_S, ACTIVE_S)
    return _appended(spark, s, "active").where(F.col("a_ip").isNotNull())


_LATE_DELAY = "1 day"


@register("stream_late", with_views("pkt_user", extra=f"""
s AS (SELECT *, (epoch_us(ts) - min(epoch_us(ts)) OVER ()) // greatest(1, (max(epoch_us(ts)) OVER () - min(epoch_us(ts)) OVER () + 4) // 4) AS slice FROM pkt_user),
m AS (SELECT max(epoch_us(ts)) - {DAY_US} AS mark FROM s WHERE slice IN (0, 2))""")
          + "SELECT packet_no, src, slice = 1 AND epoch_us(ts) < mark AS late FROM s, m")
def q_stream_late(spark, sf):
    """The second quarter of the capture arrives after the third."""
    p = pkt_user(spark, sf)
    path = ST.stage_files(p, ST.fresh_dir(spark, "in-late"), "ts", 4, arrival=(0, 2, 1, 3))
    out = ST.fresh_dir(spark, "out-late")
    ST.run_split_late(ST.packet_stream(spark, path, p.schema), out, ST.fresh_dir(spark, "ck-late"), _LATE_DELAY)
    return spark.read.parquet(out).select("packet_no", "src", "late")
