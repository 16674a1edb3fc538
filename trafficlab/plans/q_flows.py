"""Queries for flow collection (F*), flags and the two feature vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import flags as FL
from ..functions.timecols import millis
from ..operators import flows as FW
from ..operators import sampling as S
from ..schema import AGM_ORDER, CAIA_ORDER
from ..sources.tables import ORDER_SORT, pkt_order, pkt_pair, pkt_user
from .oracle_views import ORDER_SORT as SQL_ORDER_SORT
from .oracle_views import with_views
from .registry import register, round_doubles

# The driver's events are hours apart per user, so the reference's 300 s idle
# timeout would make every flow one packet: the registered queries use 6 h
# idle and 5-day windows (FIXTURES.md §7); the operators take any value.
IDLE_S = 6 * 3600
WINDOW_S = 5 * 86400
_IDLE_US = IDLE_S * 1_000_000
_WIN_US = WINDOW_S * 1_000_000

KEY5 = "a_ip, a_port, b_ip, b_port, proto"
KEYED_SQL = f"""
keyed AS (SELECT *, (src < dst) OR (src = dst AND sport <= dport) AS a_side,
  CASE WHEN (src < dst) OR (src = dst AND sport <= dport) THEN src ELSE dst END AS a_ip,
  CASE WHEN (src < dst) OR (src = dst AND sport <= dport) THEN sport ELSE dport END AS a_port,
  CASE WHEN (src < dst) OR (src = dst AND sport <= dport) THEN dst ELSE src END AS b_ip,
  CASE WHEN (src < dst) OR (src = dst AND sport <= dport) THEN dport ELSE sport END AS b_port
  FROM pkt_pair),
lagged AS (SELECT *, lag(ts) OVER (PARTITION BY {KEY5} ORDER BY ts, packet_no) AS prev_ts FROM keyed),
sess AS (SELECT * EXCLUDE (prev_ts), CAST(sum(CASE WHEN prev_ts IS NULL OR epoch_us(ts) - epoch_us(prev_ts) > {_IDLE_US}
                THEN 1 ELSE 0 END) OVER (PARTITION BY {KEY5} ORDER BY ts, packet_no
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - 1 AS session FROM lagged)"""


def _pair_sessions(spark, sf):
    return FW.sessionize(FW.with_canonical_key(pkt_pair(spark, sf)), FW.FIVE_TUPLE, IDLE_S)


@register("caia_flow_keys", with_views("pkt_pair", extra=KEYED_SQL)
          + f"SELECT packet_no, {KEY5}, a_side FROM keyed")
def q_caia_flow_keys(spark, sf):
    return FW.with_canonical_key(pkt_pair(spark, sf)).select("packet_no", *FW.FIVE_TUPLE, "a_side")


@register("idle_sessions", with_views("pkt_pair", extra=KEYED_SQL) + f"""
SELECT {KEY5}, session, count(*) AS packets, min(ts) AS flow_start, max(ts) AS flow_end
FROM sess GROUP BY {KEY5}, session""")
def q_idle_sessions(spark, sf):
    return FW.flow_summary(_pair_sessions(spark, sf), FW.FIVE_TUPLE + ["session"])


@register("flow_direction", with_views("pkt_pair", extra=KEYED_SQL + f""",
firsts AS (SELECT {KEY5}, session, src AS f_src, sport AS f_sport FROM (
  SELECT *, row_number() OVER (PARTITION BY {KEY5}, session ORDER BY ts, packet_no) AS rn FROM sess) WHERE rn = 1)""")
          + f"""SELECT s.packet_no, s.session, CASE WHEN s.src = f.f_src AND s.sport = f.f_sport THEN 'f' ELSE 'b' END AS direction
FROM sess s JOIN firsts f USING ({KEY5}, session)""")
def q_flow_direction(spark, sf):
    d = FW.with_direction(_pair_sessions(spark, sf), FW.FIVE_TUPLE + ["session"])
    return d.select("packet_no", "session", "direction")


@register("inter_packet_time", with_views("pkt_user") + """
SELECT packet_no, src, round((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY src ORDER BY ts, packet_no))) / 1000000.0, 6) AS ipt
FROM pkt_user""")
def q_inter_packet_time(spark, sf):
    return round_doubles(FW.with_ipt(pkt_user(spark, sf), ["src"]).select("packet_no", "src", "ipt"))


ACTIVE_S = 24 * 3600
_ACTIVE_US = ACTIVE_S * 1_000_000
# flows of a session: a chain of cuts, each the first packet later than the one before plus the timeout
ACTIVE_CTES = f""",
sp AS (SELECT *, row_number() OVER (PARTITION BY {KEY5}, session ORDER BY ts, packet_no) - 1 AS pos FROM sess),
nx AS (SELECT p.{KEY5.replace(', ', ', p.')}, p.session, p.pos,
              (SELECT count(*) FROM sp q WHERE q.a_ip = p.a_ip AND q.a_port = p.a_port AND q.b_ip = p.b_ip
                 AND q.b_port = p.b_port AND q.proto = p.proto AND q.session = p.session
                 AND epoch_us(q.ts) <= epoch_us(p.ts) + {_ACTIVE_US}) AS nxt FROM sp p),
cuts AS (SELECT {KEY5}, session, pos FROM sp WHERE pos = 0
         UNION
         SELECT n.{KEY5.replace(', ', ', n.')}, n.session, n.nxt FROM cuts c JOIN nx n
           ON n.a_ip = c.a_ip AND n.a_port = c.a_port AND n.b_ip = c.b_ip AND n.b_port = c.b_port
          AND n.proto = c.proto AND n.session = c.session AND n.pos = c.pos),
flagged AS (SELECT s.*, CASE WHEN c.pos IS NULL THEN 0 ELSE 1 END AS is_cut FROM sp s LEFT JOIN cuts c
            USING ({KEY5}, session, pos)),
sub AS (SELECT *, CAST(sum(is_cut) OVER (PARTITION BY {KEY5}, session ORDER BY pos
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - 1 AS subflow FROM flagged)"""


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def _caia_sql(keep_sql: str | None = None, active: bool = False, digits: int = 6, skip: tuple = ()) -> str:
    keep = f" AND ({keep_sql})" if keep_sql else ""
    sides = {"a": "a_side" + keep, "b": "NOT a_side" + keep}
    aggs = []
    for s, cond in sides.items():
        aggs += [
            f"count(*) FILTER (WHERE {cond}) AS {s}_packetTotalCount",
            f"CAST(coalesce(sum(octets) FILTER (WHERE {cond}), 0) AS BIGINT) AS {s}_octetTotalCount",
            f"count(*) FILTER (WHERE {cond} AND contains(flags, 'S')) AS {s}_tcpSynTotalCount",
            f"count(*) FILTER (WHERE {cond} AND contains(flags, 'A')) AS {s}_tcpAckTotalCount",
            f"count(*) FILTER (WHERE {cond} AND contains(flags, 'F')) AS {s}_tcpFinTotalCount",
            f"count(*) FILTER (WHERE {cond} AND contains(flags, 'C')) AS {s}__tcpCwrTotalCount",
        ]
        for stat, col in (("ipTotalLength", "CAST(ip_len AS DOUBLE)"), ("_interPacketTimeSeconds", "ipt")):
            aggs += [
                f"min({col}) FILTER (WHERE {cond}) AS {s}_min_{stat}",
                f"avg({col}) FILTER (WHERE {cond}) AS {s}_mean_{stat}",
                f"max({col}) FILTER (WHERE {cond}) AS {s}_max_{stat}",
                f"CASE WHEN count({col}) FILTER (WHERE {cond}) = 1 THEN 0.0 WHEN count({col}) FILTER (WHERE {cond}) > 1 "
                f"THEN stddev_samp({col}) FILTER (WHERE {cond}) END AS {s}_stdev_{stat}",
            ]
    base, cut = "sess", ""
    if active:
        base, cut = "flow", ACTIVE_CTES + ", flow AS (SELECT * REPLACE (session * 1000000 + subflow AS session) FROM sub)"
    extra = KEYED_SQL + cut + f""",
ipts AS (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY {KEY5}, session, a_side ORDER BY ts, packet_no))) / 1000000.0 AS ipt,
         row_number() OVER (PARTITION BY {KEY5}, session, a_side ORDER BY ts, packet_no) - 1 AS dpos FROM {base}),
firsts AS (SELECT {KEY5}, session, ts AS f_ts, src AS f_src, dst AS f_dst, sport AS f_sport, dport AS f_dport, a_side AS f_a FROM (
  SELECT *, row_number() OVER (PARTITION BY {KEY5}, session ORDER BY ts, packet_no) AS rn FROM {base}) WHERE rn = 1),
agg AS (SELECT {KEY5}, session, {", ".join(aggs)} FROM ipts GROUP BY {KEY5}, session)"""
    sel = ["(epoch_us(f_ts) // 1000) AS flowStartMilliseconds", "f_src AS sourceIPAddress", "f_dst AS destinationIPAddress",
           "f_sport AS sourceTransportPort", "f_dport AS destinationTransportPort", "proto AS protocolIdentifier"]
    for name in CAIA_ORDER[6:]:
        fn, rest = name.split("(", 1)
        attr, direction = rest[:-1].split(",")
        col = attr if fn == "count" else f"{fn}_{attr}"
        fw, bw = (f"a_{col}", f"b_{col}") if direction == "forward" else (f"b_{col}", f"a_{col}")
        expr = f"CASE WHEN f_a THEN {fw} ELSE {bw} END"
        if fn != "count":
            expr = f"round({expr}, {digits if fn == 'stdev' else 6})"
        if name not in skip:
            sel.append(f'{expr} AS "{name}"')
    sql = with_views("pkt_pair", extra=extra) + f"SELECT {', '.join(sel)} FROM agg JOIN firsts USING ({KEY5}, session)"
    return _recursive(sql) if active else sql


@register("caia_vector", _caia_sql())
def q_caia_vector(spark, sf):
    return round_doubles(FW.caia_vector(pkt_pair(spark, sf), IDLE_S, active_seconds=None))


# Means of few inter-packet times lie on halves of microseconds, where the last
# bit decides the rounding: caia_vector compares them, this key leaves them out.
_HALVES = ("mean(_interPacketTimeSeconds,forward)", "mean(_interPacketTimeSeconds,backward)")


@register("caia_vector_active", _caia_sql(active=True, digits=4, skip=_HALVES))
def q_caia_vector_active(spark, sf):
    v = FW.caia_vector(pkt_pair(spark, sf), IDLE_S, active_seconds=ACTIVE_S)
    v = v.select(*[F.round(F.col(f"`{c}`"), 4).alias(c) if c.startswith("stdev") else F.col(f"`{c}`")
                   for c in v.columns if c not in _HALVES])
    return round_doubles(v)


_AGM_NUM = {"sourceTransportPort": "sport", "destinationTransportPort": "dport",
            "protocolIdentifier": "proto", "ipTTL": "ttl", "octetTotalCount": "octets"}

def agm_base_sql(keep_sql: str | None = None) -> str:
    """AGM level-1 CTEs; ``keep_sql`` (on ``fpos``) samples each flow's packets."""
    kept = f"(SELECT * FROM f WHERE {keep_sql})" if keep_sql else "f"
    return f"""
f AS (SELECT src, CAST(floor(epoch_us(ts) / {_WIN_US}) AS BIGINT) AS win, ts, packet_no, sport, dport, proto, ttl, octets, dst,
      CASE WHEN flags IS NULL OR flags = '' THEN '0' ELSE flags END AS combo,
      row_number() OVER (PARTITION BY src, CAST(floor(epoch_us(ts) / {_WIN_US}) AS BIGINT) ORDER BY ts, packet_no) - 1 AS fpos
      FROM pkt_user),
t0s AS (SELECT src, win, min(ts) AS t0 FROM f GROUP BY src, win),
long AS ({" UNION ALL ".join(
    [f"SELECT src, win, '{a}' AS attr, {c} AS v, CAST(NULL AS VARCHAR) AS s, ts, packet_no FROM {kept}" for a, c in _AGM_NUM.items()]
    + [f"SELECT src, win, 'destinationIPAddress', CAST(NULL AS BIGINT), dst, ts, packet_no FROM {kept}",
       f"SELECT src, win, '_tcpFlags', CAST(NULL AS BIGINT), combo, ts, packet_no FROM {kept}"])}),
l1 AS (SELECT src, win, attr, v, s, count(*) AS c, min(ts) AS first_ts FROM long GROUP BY src, win, attr, v, s),
ranked AS (SELECT *, row_number() OVER (PARTITION BY src, win, attr ORDER BY c DESC, v ASC) AS rk,
                  max(c) OVER (PARTITION BY src, win, attr) AS mc FROM l1),
tied AS (SELECT src, win, s AS combo FROM ranked WHERE attr = '_tcpFlags' AND c = mc),
zero AS (SELECT src, win, bool_or(combo = '0') AS has_zero FROM tied GROUP BY src, win),
letters AS (SELECT src, win, unnest(string_split(combo, '')) AS letter FROM tied),
lc AS (SELECT src, win, letter, count(*) AS n FROM letters WHERE letter IN ('N','C','E','U','S','R','F','P','A') GROUP BY ALL),
lw AS (SELECT src, win, letter FROM (SELECT *, max(n) OVER (PARTITION BY src, win) AS mx FROM lc) WHERE n = mx),
fl AS (SELECT z.src, z.win, z.has_zero, {", ".join(f"max(CASE WHEN lw.letter = '{c}' THEN 1 ELSE 0 END) AS L_{c}" for c in FL.FLAG_LETTERS)}
       FROM zero z LEFT JOIN lw ON z.src = lw.src AND z.win = lw.win GROUP BY z.src, z.win, z.has_zero)"""


AGM_BASE_SQL = agm_base_sql()


def _agm_sql(keep_sql: str | None = None) -> str:
    lvl2 = ["src", "win", "count(*) FILTER (WHERE attr = 'protocolIdentifier') AS dummy"]
    lvl2 = ["src", "win",
            "CAST(sum(c) FILTER (WHERE attr = 'protocolIdentifier') AS BIGINT) AS packetTotalCount"]
    for a in list(_AGM_NUM) + ["destinationIPAddress", "_tcpFlags"]:
        lvl2 += [f"count(*) FILTER (WHERE attr = '{a}') AS \"distinct({a})\"",
                 f"max(c) FILTER (WHERE attr = '{a}') AS \"modeCount({a})\""]
        if a in _AGM_NUM:
            lvl2.append(f"max(v) FILTER (WHERE attr = '{a}' AND rk = 1) AS \"mode({a})\"")
    extra = agm_base_sql(keep_sql) + f""",
v2 AS (SELECT v.*, t0s.t0 FROM (SELECT {", ".join(lvl2)} FROM ranked GROUP BY src, win) v JOIN t0s USING (src, win))"""
    sel = []
    for c in AGM_ORDER:
        if c == "flowStartMilliseconds":
            sel.append("(epoch_us(t0) // 1000) AS flowStartMilliseconds")
        elif c == "sourceIPAddress":
            sel.append("v2.src AS sourceIPAddress")
        elif c in FL.FLAG_LETTERS:
            sel.append(f"CAST(CASE WHEN fl.has_zero THEN 0 ELSE fl.L_{c} END AS INTEGER) AS {c}")
        else:
            sel.append(f'"{c}"')
    return (with_views("pkt_user", extra=extra)
            + f"SELECT {', '.join(sel)} FROM v2 JOIN fl ON v2.src = fl.src AND v2.win = fl.win")


@register("agm_vector", _agm_sql())
def q_agm_vector(spark, sf):
    return FW.agm_vector(pkt_user(spark, sf), WINDOW_S)


@register("agm_vector_sampled", _agm_sql().replace(
    "FROM pkt_user)", f"FROM (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY ts, packet_no) - 1 AS pos "
                      f"FROM pkt_user) WHERE pos % 2 = 0))", 1))
def q_agm_vector_sampled(spark, sf):
    return FW.agm_vector(S.sample_packets(pkt_user(spark, sf), "every_nth", 2).drop("pos"), WINDOW_S)


@register("agm_window_flows", with_views("pkt_user") + f"""
SELECT src, CAST(floor(epoch_us(ts) / {_WIN_US}) AS BIGINT) AS win, (epoch_us(min(ts)) // 1000) AS flowStartMilliseconds,
       count(*) AS packetTotalCount, CAST(sum(octets) AS BIGINT) AS octetTotalCount
FROM pkt_user GROUP BY 1, 2""")
def q_agm_window_flows(spark, sf):
    return FW.agm_window_flows(pkt_user(spark, sf), WINDOW_S)


_WIN_SQL = f"CAST(floor(epoch_us(ts) / {_WIN_US}) AS BIGINT)"


@register("agm_distinct", with_views("pkt_user") + f"""
SELECT src, {_WIN_SQL} AS win, count(DISTINCT dport) AS "distinct(dport)", count(DISTINCT dst) AS "distinct(dst)",
       count(DISTINCT ttl) AS "distinct(ttl)" FROM pkt_user GROUP BY 1, 2""")
def q_agm_distinct(spark, sf):
    f = FW.agm_flow_id(pkt_user(spark, sf), WINDOW_S)
    return f.groupBy("src", "win").agg(F.count_distinct("dport").alias("distinct(dport)"),
                                       F.count_distinct("dst").alias("distinct(dst)"),
                                       F.count_distinct("ttl").alias("distinct(ttl)"))


_MODE_NUM_SQL = f"""
SELECT src, win, v AS "mode(dport)", c AS "modeCount(dport)", nd AS "distinct(dport)" FROM (
  SELECT *, row_number() OVER (PARTITION BY src, win ORDER BY c DESC, v ASC) AS rk,
         count(*) OVER (PARTITION BY src, win) AS nd FROM (
    SELECT src, {_WIN_SQL} AS win, dport AS v, count(*) AS c FROM pkt_user GROUP BY 1, 2, 3)) WHERE rk = 1"""


@register("agm_mode_numeric", with_views("pkt_user") + _MODE_NUM_SQL)
def q_agm_mode_numeric(spark, sf):
    return FW.mode_numeric(FW.agm_flow_id(pkt_user(spark, sf), WINDOW_S), ["src", "win"], "dport")


@register("agm_mode_count", with_views("pkt_user") + f"""
SELECT src, {_WIN_SQL} AS win, max(c) AS "modeCount(ttl)" FROM (
  SELECT src, ts, ttl, count(*) OVER (PARTITION BY src, {_WIN_SQL}, ttl) AS c FROM pkt_user) GROUP BY 1, 2""")
def q_agm_mode_count(spark, sf):
    m = FW.mode_numeric(FW.agm_flow_id(pkt_user(spark, sf), WINDOW_S), ["src", "win"], "ttl")
    return m.select("src", "win", "modeCount(ttl)")


@register("agm_mode_text", with_views("pkt_user") + f"""
SELECT src, win, dst AS "mode(dst)", c AS "modeCount(dst)", nd AS "distinct(dst)" FROM (
  SELECT *, row_number() OVER (PARTITION BY src, win ORDER BY c DESC, first_ts ASC, first_no ASC) AS rk,
         count(*) OVER (PARTITION BY src, win) AS nd FROM (
    SELECT src, {_WIN_SQL} AS win, dst, count(*) AS c, min(ts) AS first_ts, arg_min(packet_no, ts) AS first_no
    FROM pkt_user GROUP BY 1, 2, 3)) WHERE rk = 1""")
def q_agm_mode_text(spark, sf):
    return FW.mode_text(FW.agm_flow_id(pkt_user(spark, sf), WINDOW_S), ["src", "win"], "dst")


@register("agm_flag_mode", with_views("pkt_user", extra=AGM_BASE_SQL) + f"""
SELECT fl.src, fl.win, {", ".join(f"CAST(CASE WHEN fl.has_zero THEN 0 ELSE fl.L_{c} END AS INTEGER) AS {c}" for c in FL.FLAG_LETTERS)},
       m."distinct(_tcpFlags)", m."modeCount(_tcpFlags)"
FROM fl JOIN (SELECT src, win, count(*) AS "distinct(_tcpFlags)", max(c) AS "modeCount(_tcpFlags)"
              FROM l1 WHERE attr = '_tcpFlags' GROUP BY src, win) m ON fl.src = m.src AND fl.win = m.win""")
def q_agm_flag_mode(spark, sf):
    return FW.flag_summary(FW.agm_flow_id(pkt_user(spark, sf), WINDOW_S), ["src", "win"])


@register("flag_onehot", with_views("pkt_user") + "SELECT packet_no, "
          + ", ".join(f"CAST(contains(flags, '{c}') AS INTEGER) AS {c}" for c in FL.FLAG_LETTERS) + " FROM pkt_user")
def q_flag_onehot(spark, sf):
    p = pkt_user(spark, sf)
    return p.select("packet_no", *[v.alias(k) for k, v in FL.flags_onehot(F.col("flags")).items()])


@register("flag_bitmask", with_views("pkt_user") + "SELECT packet_no, flags, CAST("
          + " + ".join(f"CASE WHEN contains(flags, '{c}') THEN {w} ELSE 0 END" for c, w in FL.FLAG_WEIGHTS.items())
          + " AS BIGINT) AS mask FROM pkt_user")
def q_flag_bitmask(spark, sf):
    p = pkt_user(spark, sf)
    return p.select("packet_no", "flags", FL.flags_to_int(F.col("flags")).alias("mask"))


ACC_SQL = f"""
acc AS (SELECT l_orderkey, '[' || string_agg(CAST(octets AS VARCHAR), ' ' ORDER BY {SQL_ORDER_SORT}) || ']' AS octets_list,
               '[' || string_agg(CASE WHEN flags = 'N' THEN '' ELSE flags END, ' ' ORDER BY {SQL_ORDER_SORT}) || ']' AS flags_list,
               count(*) AS packets
        FROM pkt_order GROUP BY l_orderkey)"""


def _accumulated(spark, sf):
    o = pkt_order(spark, sf).withColumn("flag_text", F.when(F.col("flags") == "N", F.lit("")).otherwise(F.col("flags")))
    acc = FW.accumulate(o, ["l_orderkey"], ["octets", "flag_text"], order=ORDER_SORT)
    return acc.select(
        "l_orderkey",
        F.concat(F.lit("["), F.array_join(F.col("`accumulate(octets)`").cast("array<string>"), " "), F.lit("]")).alias("octets_list"),
        F.concat(F.lit("["), F.array_join(F.col("`accumulate(flag_text)`"), " "), F.lit("]")).alias("flags_list"),
        F.size("`accumulate(octets)`").cast("long").alias("packets"))


@register("accumulate_list", with_views("pkt_order", extra=ACC_SQL) + "SELECT * FROM acc")
def q_accumulate_list(spark, sf):
    return _accumulated(spark, sf)


ACTIVE_SELECT = f"""SELECT {KEY5}, session, subflow, count(*) AS packets, min(ts) AS flow_start, max(ts) AS flow_end
FROM sub GROUP BY {KEY5}, session, subflow"""


@register("active_sessions", _recursive(with_views("pkt_pair", extra=KEYED_SQL + ACTIVE_CTES))
          + ACTIVE_SELECT)
def q_active_sessions(spark, sf):
    p = FW.with_canonical_key(pkt_pair(spark, sf))
    a = FW.active_timeout(p.select(*FW.FIVE_TUPLE, *FW.PACKET_ORDER), FW.FIVE_TUPLE, IDLE_S, ACTIVE_S)
    return a.groupBy(*FW.FIVE_TUPLE, "session", "subflow").agg(
        F.count(F.lit(1)).alias("packets"), F.min("ts").alias("flow_start"), F.max("ts").alias("flow_end"))


AGM_IDLE_S = 12 * 3600


@register("agm_idle_flows", with_views("pkt_user") + f"""
, w AS (SELECT *, CAST(floor(epoch_us(ts) / {_WIN_US}) AS BIGINT) AS win FROM pkt_user),
lg AS (SELECT *, lag(ts) OVER (PARTITION BY src, win ORDER BY ts, packet_no) AS prev_ts FROM w),
se AS (SELECT *, CAST(sum(CASE WHEN prev_ts IS NULL OR epoch_us(ts) - epoch_us(prev_ts) > {AGM_IDLE_S * 1_000_000} THEN 1 ELSE 0 END)
         OVER (PARTITION BY src, win ORDER BY ts, packet_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - 1 AS session FROM lg)
SELECT src, win, session, (epoch_us(min(ts)) // 1000) AS flowStartMilliseconds, count(*) AS packetTotalCount,
       CAST(sum(octets) AS BIGINT) AS octetTotalCount FROM se GROUP BY src, win, session""".replace("\\n, w AS", ",\\nw AS"))
def q_agm_idle_flows(spark, sf):
    f = FW.agm_flow_id(pkt_user(spark, sf), WINDOW_S, idle_seconds=AGM_IDLE_S)
    return f.groupBy("src", "win", "session").agg(
        millis(F.min("ts")).alias("flowStartMilliseconds"),
        F.count(F.lit(1)).alias("packetTotalCount"), F.sum("octets").cast("long").alias("octetTotalCount"))


FS_CAIA = ("first_n", 9)
FS_AGM = ("every_nth", 2)


@register("caia_vector_flow_sampled", _caia_sql(f"dpos < {FS_CAIA[1]}"))
def q_caia_vector_flow_sampled(spark, sf):
    return round_doubles(FW.caia_vector(pkt_pair(spark, sf), IDLE_S, flow_sampling=FS_CAIA, active_seconds=None))


@register("agm_vector_flow_sampled", _agm_sql(f"fpos % {FS_AGM[1]} = 0"))
def q_agm_vector_flow_sampled(spark, sf):
    return FW.agm_vector(pkt_user(spark, sf), WINDOW_S, flow_sampling=FS_AGM)
