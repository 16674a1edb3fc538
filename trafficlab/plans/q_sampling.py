"""Queries for scans, sampling (C*) and set operations on packets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sampling as S
from ..sources.tables import ORDER_SORT, pkt_order, pkt_user, table
from .oracle_views import ORDER_SORT as SQL_ORDER_SORT
from .oracle_views import with_views
from .registry import register

# Parameters of the registered queries (the reference's grid uses n in 1..N;
# these exercise every branch on the driver's tables).
N_PKT = 7
N_OF_N = 3
SEED = S.DEFAULT_SEED
SPLIT = S.DEFAULT_SPLIT
SLOT_S = 3600
N_FLOW = 2
N_FIRST = 3
N_DECAY = 3
CHUNK = 100_000

POS_SQL = "pos AS (SELECT *, row_number() OVER (ORDER BY ts, packet_no) - 1 AS pos FROM pkt_user)"
FPOS_SQL = (f"fpos AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {SQL_ORDER_SORT}) - 1 AS pos "
            f"FROM pkt_order)")
FPOS_DIR_SQL = (f"fposd AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, direction ORDER BY {SQL_ORDER_SORT}) - 1 AS pos "
                f"FROM pkt_order)")
FLOW_OUT = "l_orderkey, l_linenumber, l_partkey, l_suppkey, direction, pos"


@register("packets_scan", with_views("pkt_user") + "SELECT * FROM pkt_user")
def q_packets_scan(spark, sf):
    return pkt_user(spark, sf)


@register("packet_position", with_views("pkt_user", extra=POS_SQL) + "SELECT packet_no, ts, pos FROM pos")
def q_packet_position(spark, sf):
    return S.with_position(pkt_user(spark, sf)).select("packet_no", "ts", "pos")


@register("pkt_every_nth", with_views("pkt_user", extra=POS_SQL)
          + f"SELECT packet_no, ts, src, pos FROM pos WHERE pos % {N_PKT} = 0")
def q_pkt_every_nth(spark, sf):
    return S.sample_packets(pkt_user(spark, sf), "every_nth", N_PKT).select("packet_no", "ts", "src", "pos")


_NN = N_OF_N * N_OF_N


@register("pkt_n_of_N", with_views("pkt_user", extra=POS_SQL + f""",
blocks AS (SELECT DISTINCT pos // {_NN} AS blk FROM pos),
slots AS (SELECT blk, unnest(range(blk * {_NN}, blk * {_NN} + {_NN})) AS pos FROM blocks),
chosen AS (SELECT pos FROM (SELECT pos, row_number() OVER (PARTITION BY blk
             ORDER BY md5('{SEED}:' || CAST(pos AS VARCHAR)), pos) AS r FROM slots) WHERE r <= {N_OF_N})""")
          + "SELECT packet_no, ts, pos FROM pos WHERE pos IN (SELECT pos FROM chosen)")
def q_pkt_n_of_n(spark, sf):
    return S.sample_packets(pkt_user(spark, sf), "n_of_N", N_OF_N, seed=SEED).select("packet_no", "ts", "pos")


@register("pkt_srs_block", with_views("pkt_user", extra=POS_SQL) + f"""
SELECT packet_no, ts, pos FROM (
  SELECT packet_no, ts, pos,
         row_number() OVER (PARTITION BY pos // {SPLIT} ORDER BY md5('{SEED}:' || CAST(pos AS VARCHAR)), pos) AS r,
         count(*) OVER (PARTITION BY pos // {SPLIT}) AS c
  FROM pos) WHERE r <= ceil(c / {N_PKT})""")
def q_pkt_srs_block(spark, sf):
    return S.sample_packets(pkt_user(spark, sf), "srs_per_block", N_PKT, seed=SEED, split=SPLIT) \
        .select("packet_no", "ts", "pos")


@register("pkt_time_based", with_views("pkt_user") + f"""
SELECT slot, packet_no, ts, src FROM (
  SELECT CAST(floor(epoch_us(ts) / {SLOT_S * 1_000_000}) AS BIGINT) AS slot, packet_no, ts, src,
         row_number() OVER (PARTITION BY floor(epoch_us(ts) / {SLOT_S * 1_000_000}) ORDER BY ts, packet_no) AS r
  FROM pkt_user) WHERE r = 1""")
def q_pkt_time_based(spark, sf):
    return S.sample_packets(pkt_user(spark, sf), "time_based", SLOT_S).select("slot", "packet_no", "ts", "src")


def _flow_sample(spark, sf, mode, n, key=("l_orderkey",)):
    return S.sample_flow(pkt_order(spark, sf), list(key), mode, n, order=ORDER_SORT) \
        .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "direction", "pos")


@register("flow_every_nth", with_views("pkt_order", extra=FPOS_SQL)
          + f"SELECT {FLOW_OUT} FROM fpos WHERE pos % {N_FLOW} = 0")
def q_flow_every_nth(spark, sf):
    return _flow_sample(spark, sf, "every_nth", N_FLOW)


@register("flow_take_skip", with_views("pkt_order", extra=FPOS_SQL)
          + f"SELECT {FLOW_OUT} FROM fpos WHERE (pos // {N_FLOW}) % 2 = 0")
def q_flow_take_skip(spark, sf):
    return _flow_sample(spark, sf, "take_skip", N_FLOW)


@register("flow_first_n", with_views("pkt_order", extra=FPOS_SQL)
          + f"SELECT {FLOW_OUT} FROM fpos WHERE pos < {N_FIRST}")
def q_flow_first_n(spark, sf):
    return _flow_sample(spark, sf, "first_n", N_FIRST)


def _decay_sql(n: int) -> str:
    terms = [f"(pos >= {lo} AND pos < {hi})" for lo, hi in S.decaying_bursts(n)]
    return " OR ".join(terms)


@register("flow_decaying", with_views("pkt_order", extra=FPOS_SQL)
          + f"SELECT {FLOW_OUT} FROM fpos WHERE {_decay_sql(N_DECAY)}")
def q_flow_decaying(spark, sf):
    return _flow_sample(spark, sf, "decaying", N_DECAY)


@register("flow_every_nth_bidir", with_views("pkt_order", extra=FPOS_DIR_SQL)
          + f"SELECT {FLOW_OUT} FROM fposd WHERE pos % {N_FLOW} = 0")
def q_flow_every_nth_bidir(spark, sf):
    return _flow_sample(spark, sf, "every_nth", N_FLOW, key=("l_orderkey", "direction"))


@register("sample_identity", with_views("pkt_order")
          + "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, octets FROM pkt_order")
def q_sample_identity(spark, sf):
    return S.sample_flow(pkt_order(spark, sf), "l_orderkey", "every_nth", 0) \
        .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "octets")


@register("verify_sample_count", with_views("pkt_user", extra=POS_SQL + f""",
e AS (SELECT count(*) AS total FROM pos),
s5 AS (SELECT count(*) AS actual FROM pos WHERE pos % {N_PKT} = 0),
s7 AS (SELECT count(*) AS actual FROM (
  SELECT pos, row_number() OVER (PARTITION BY pos // {SPLIT} ORDER BY md5('{SEED}:' || CAST(pos AS VARCHAR)), pos) AS r,
         count(*) OVER (PARTITION BY pos // {SPLIT}) AS c FROM pos) WHERE r <= ceil(c / {N_PKT}))""") + f"""
SELECT 'every_nth' AS mode, total, CAST(ceil(total / {N_PKT}) AS BIGINT) AS expected, actual FROM e, s5
UNION ALL
SELECT 'srs_per_block' AS mode, total,
       CAST(floor(total / {SPLIT}) * {-(-SPLIT // N_PKT)} + ceil((total - floor(total / {SPLIT}) * {SPLIT}) / {N_PKT}) AS BIGINT) AS expected,
       actual FROM e, s7""")
def q_verify_sample_count(spark, sf):
    p = pkt_user(spark, sf)
    a = S.verify_sample(p, S.sample_packets(p, "every_nth", N_PKT), "every_nth", N_PKT)
    b = S.verify_sample(p, S.sample_packets(p, "srs_per_block", N_PKT, seed=SEED, split=SPLIT),
                        "srs_per_block", N_PKT, split=SPLIT)
    return a.unionByName(b)


@register("sample_counts", with_views("pkt_order", extra=FPOS_DIR_SQL) + f"""
SELECT l_orderkey, count(*) FILTER (WHERE direction = 'f') AS n_forward,
       count(*) FILTER (WHERE direction = 'b') AS n_backward
FROM fposd WHERE pos % {N_FLOW} = 0 GROUP BY l_orderkey""")
def q_sample_counts(spark, sf):
    s = S.sample_flow(pkt_order(spark, sf), ["l_orderkey", "direction"], "every_nth", N_FLOW, order=ORDER_SORT)
    return S.sample_counts(s, ["l_orderkey"])


@register("sample_totals", with_views("pkt_order", extra=FPOS_DIR_SQL) + f"""
SELECT direction, count(*) AS packets FROM fposd WHERE pos % {N_FLOW} = 0 GROUP BY ROLLUP (direction)""")
def q_sample_totals(spark, sf):
    s = S.sample_flow(pkt_order(spark, sf), ["l_orderkey", "direction"], "every_nth", N_FLOW, order=ORDER_SORT)
    return S.sample_totals(s)


@register("preview_topk", with_views("pkt_user", extra=POS_SQL)
          + f"SELECT packet_no, ts, pos FROM pos WHERE pos % {N_PKT} = 0 ORDER BY ts, packet_no LIMIT 20")
def q_preview_topk(spark, sf):
    s = S.sample_packets(pkt_user(spark, sf), "every_nth", N_PKT)
    return S.preview(s, 20).select("packet_no", "ts", "pos")


@register("dropped_packets", with_views("pkt_user", extra=POS_SQL)
          + f"SELECT packet_no, ts FROM pos WHERE pos % {N_PKT} <> 0")
def q_dropped_packets(spark, sf):
    p = pkt_user(spark, sf)
    return S.dropped_packets(p, S.sample_packets(p, "every_nth", N_PKT)).select("packet_no", "ts")


@register("packet_counts", with_views("pkt_user")
          + "SELECT capture, count(*) AS packets FROM pkt_user GROUP BY capture")
def q_packet_counts(spark, sf):
    return S.packet_counts(pkt_user(spark, sf), ["capture"])


@register("block_counts", with_views("pkt_user", extra=POS_SQL)
          + f"SELECT pos // {SPLIT} AS block, count(*) AS packets FROM pos GROUP BY 1")
def q_block_counts(spark, sf):
    p = S.with_position(pkt_user(spark, sf))
    return S.packet_counts(p.withColumn("block", F.floor(F.col("pos") / SPLIT).cast("long")), ["block"])


@register("chunk_id", f"""
SELECT pos // {CHUNK} AS chunk, count(*) AS rows_in_chunk, sum(l_quantity) AS qty FROM (
  SELECT l_quantity, row_number() OVER (ORDER BY l_orderkey, {SQL_ORDER_SORT}) - 1 AS pos FROM lineitem)
GROUP BY 1""")
def q_chunk_id(spark, sf):
    li = table(spark, sf, "lineitem")
    c = S.with_chunk_id(li, ["l_orderkey"] + ORDER_SORT, CHUNK)
    return c.groupBy("chunk").agg(F.count(F.lit(1)).alias("rows_in_chunk"), F.sum("l_quantity").alias("qty"))


@register("truncate_payload", "SELECT page_id, substring(html, 1, 127) AS payload, length(html) AS orig_len FROM pages")
def q_truncate_payload(spark, sf):
    pages = table(spark, sf, "pages")
    return S.truncate_payload(pages, "html", 127).select("page_id", F.col("html").alias("payload"),
                                                         F.col("orig_len"))


@register("union_captures", with_views("pkt_user", extra="""
mon AS (SELECT * FROM pkt_user WHERE capture IN ('Monday', 'Tuesday', 'Wednesday')),
rest AS (SELECT * FROM pkt_user WHERE capture NOT IN ('Monday', 'Tuesday', 'Wednesday'))""")
          + "SELECT capture, count(*) AS packets, CAST(sum(octets) AS BIGINT) AS octets FROM "
            "(SELECT * FROM mon UNION ALL SELECT * FROM rest) GROUP BY capture")
def q_union_captures(spark, sf):
    p = pkt_user(spark, sf)
    early = ["Monday", "Tuesday", "Wednesday"]
    parts = [p.where(F.col("capture").isin(early)), p.where(~F.col("capture").isin(early))]
    u = S.union_captures(parts)
    return u.groupBy("capture").agg(F.count(F.lit(1)).alias("packets"), F.sum("octets").cast("long").alias("octets"))


SMALL_CHUNK = 7_000


@register("chunk_id_many", f"""
SELECT pos // {SMALL_CHUNK} AS chunk, count(*) AS rows_in_chunk, sum(l_quantity) AS qty FROM (
  SELECT l_quantity, row_number() OVER (ORDER BY l_orderkey, {SQL_ORDER_SORT}) - 1 AS pos FROM lineitem)
GROUP BY 1""")
def q_chunk_id_many(spark, sf):
    c = S.with_chunk_id(table(spark, sf, "lineitem"), ["l_orderkey"] + ORDER_SORT, SMALL_CHUNK)
    return c.groupBy("chunk").agg(F.count(F.lit(1)).alias("rows_in_chunk"), F.sum("l_quantity").alias("qty"))
