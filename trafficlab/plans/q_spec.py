"""Queries for declarative flow specs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.flowspec import FlowSpec, agm_spec, caia_spec, extract_flows, feature_name
from ..schema import CAIA_ORDER
from ..sources.tables import pkt_pair, pkt_user
from .oracle_views import with_views
from .q_flows import AGM_BASE_SQL, AGM_IDLE_S, IDLE_S, KEY5, KEYED_SQL, WINDOW_S, _WIN_US, _caia_sql
from .registry import register, round_doubles

AGM_SPEC = agm_spec()
CAIA_SPEC = caia_spec()


def _spec_agm_sql() -> str:
    cols = ["v2.win AS timeWindow"]
    for f in AGM_SPEC.features:
        name = feature_name(f)
        if name == "flowStartMilliseconds":
            cols.append("(epoch_us(t0) // 1000) AS flowStartMilliseconds")
        elif name == "sourceIPAddress":
            cols.append("v2.src AS sourceIPAddress")
        elif name == "packetTotalCount":
            cols.append("packetTotalCount")
        else:
            cols.append(f'"{name}"')
    lvl2 = ["src", "win", "CAST(sum(c) FILTER (WHERE attr = 'protocolIdentifier') AS BIGINT) AS packetTotalCount",
            "min(first_ts) AS t0"]
    attrs = ["destinationIPAddress", "sourceTransportPort", "destinationTransportPort", "protocolIdentifier",
             "ipTTL", "_tcpFlags", "octetTotalCount"]
    for a in attrs:
        modecol = "s" if a in ("destinationIPAddress", "_tcpFlags") else "v"
        lvl2 += [f"count(*) FILTER (WHERE attr = '{a}') AS \"distinct({a})\"",
                 f"max({modecol}) FILTER (WHERE attr = '{a}' AND rk2 = 1) AS \"mode({a})\"",
                 f"max(c) FILTER (WHERE attr = '{a}') AS \"modeCount({a})\""]
    extra = AGM_BASE_SQL + f""",
r2 AS (SELECT *, row_number() OVER (PARTITION BY src, win, attr ORDER BY c DESC, v ASC, first_ts ASC) AS rk2 FROM l1),
v2 AS (SELECT {", ".join(lvl2)} FROM r2 GROUP BY src, win)"""
    return with_views("pkt_user", extra=extra) + f"SELECT {', '.join(cols)} FROM v2"


@register("spec_agm", _spec_agm_sql())
def q_spec_agm(spark, sf):
    return extract_flows(pkt_user(spark, sf), AGM_SPEC, window_seconds=WINDOW_S)


MOMENTS_SPEC = FlowSpec.from_json({
    "features": ["sourceIPAddress", "packetTotalCount", {"mean": ["octetTotalCount"]}, {"stdev": ["octetTotalCount"]}, {"stdev": ["ipTTL"]}],
    "bidirectional": False, "key_features": ["sourceIPAddress", "__timeWindow10s"]})


@register("spec_moments", with_views("pkt_user") + f"""
SELECT epoch_us(ts) // {_WIN_US} AS "timeWindow", src AS "sourceIPAddress", count(*) AS "packetTotalCount", round(avg(octets), 6) AS "mean(octetTotalCount)",
  round(coalesce(stddev_samp(octets), 0), 6) AS "stdev(octetTotalCount)", round(coalesce(stddev_samp(ttl), 0), 6) AS "stdev(ipTTL)"
FROM pkt_user GROUP BY ALL""")
def q_spec_moments(spark, sf):
    return round_doubles(extract_flows(pkt_user(spark, sf), MOMENTS_SPEC, window_seconds=WINDOW_S))


def _spec_caia_sql() -> str:
    sql = _caia_sql()
    for name in CAIA_ORDER[6:]:
        fn, rest = name.split("(", 1)
        attr, d = rest[:-1].split(",")
        spec_name = f"apply({attr},{d})" if fn == "count" else f"apply({fn}({attr}),{d})"
        sql = sql.replace(f'AS "{name}"', f'AS "{spec_name}"')
    return sql


@register("spec_caia", _spec_caia_sql())
def q_spec_caia(spark, sf):
    return round_doubles(extract_flows(pkt_pair(spark, sf), CAIA_SPEC, idle_seconds=IDLE_S))


_USER_FLOWS = f"""
w AS (SELECT *, CAST(floor(epoch_us(ts) / {_WIN_US}) AS BIGINT) AS win FROM pkt_user),
lg AS (SELECT *, lag(ts) OVER (PARTITION BY src, win ORDER BY ts, packet_no) AS prev_ts FROM w),
se AS (SELECT *, sum(CASE WHEN prev_ts IS NULL OR epoch_us(ts) - epoch_us(prev_ts) > {AGM_IDLE_S * 1_000_000} THEN 1 ELSE 0 END)
         OVER (PARTITION BY src, win ORDER BY ts, packet_no) AS session FROM lg)"""
_WINDOW_KEYS = ["sourceIPAddress", f"__timeWindow{WINDOW_S}s"]
TIMEOUT_SPEC = FlowSpec.from_json({
    "features": ["flowStartMilliseconds", "sourceIPAddress", {"distinct": ["destinationIPAddress"]}, {"modeCount": ["ipTTL"]},
                 {"max": ["octetTotalCount"]}, "packetTotalCount", "octetTotalCount"],
    "idle_timeout": AGM_IDLE_S, "bidirectional": False, "key_features": _WINDOW_KEYS})


@register("spec_agm_timeouts", with_views("pkt_user", extra=_USER_FLOWS + """,
ttl AS (SELECT src, win, session, max(n) AS top FROM (
  SELECT src, win, session, ttl, count(*) AS n FROM se GROUP BY ALL) GROUP BY ALL)""") + """
SELECT win AS timeWindow, (epoch_us(min(ts)) // 1000) AS flowStartMilliseconds, src AS sourceIPAddress,
  count(DISTINCT dst) AS "distinct(destinationIPAddress)", any_value(top) AS "modeCount(ipTTL)",
  CAST(max(octets) AS DOUBLE) AS "max(octetTotalCount)", count(*) AS packetTotalCount, CAST(sum(octets) AS BIGINT) AS octetTotalCount
FROM se JOIN ttl USING (src, win, session) GROUP BY src, win, session""")
def q_spec_agm_timeouts(spark, sf):
    return extract_flows(pkt_user(spark, sf), TIMEOUT_SPEC)


def _listed(df, names):
    """Arrays as text, for the comparison with SQL."""
    return df.withColumns({n: F.array_join(F.transform(F.col(f"`{n}`"), lambda x: x.cast("string")), ",", "-") for n in names})


def _forward(*attrs):
    return [{"apply": [{"accumulate": [a]}, "forward"]} for a in attrs]


AGM_LIST_SPEC = FlowSpec.from_json({
    "features": ["flowStartMilliseconds", "sourceIPAddress", *_forward("destinationIPAddress", "sourceTransportPort", "ipTTL", "octetTotalCount")],
    "idle_timeout": AGM_IDLE_S, "bidirectional": False, "key_features": _WINDOW_KEYS})


@register("spec_accumulate_agm", with_views("pkt_user", extra=_USER_FLOWS)
          + "SELECT win AS timeWindow, (epoch_us(min(ts)) // 1000) AS flowStartMilliseconds, src AS sourceIPAddress, "
          + ", ".join(f"string_agg(CAST({c} AS VARCHAR), ',' ORDER BY ts, packet_no) AS \"apply(accumulate({a}),forward)\"" for a, c in
                      (("destinationIPAddress", "dst"), ("sourceTransportPort", "sport"), ("ipTTL", "ttl"), ("octetTotalCount", "octets")))
          + " FROM se GROUP BY src, win, session")
def q_spec_accumulate_agm(spark, sf):
    return _listed(extract_flows(pkt_user(spark, sf), AGM_LIST_SPEC), [feature_name(f) for f in AGM_LIST_SPEC.features[2:]])


_SIDE_LISTS = {"octetTotalCount": "CAST(octets AS VARCHAR)", "tcpSynTotalCount": "CASE WHEN contains(flags, 'S') THEN '1' ELSE '0' END",
               "ipTotalLength": "CAST(ip_len AS VARCHAR)"}
CAIA_LIST_SPEC = FlowSpec.from_json({"version": "v2", "preprocessing": {"flows": [{
    "features": ["flowStartMilliseconds", "sourceIPAddress", "destinationIPAddress", "sourceTransportPort", "destinationTransportPort",
                 "protocolIdentifier", *[{"apply": [{"accumulate": [a]}, d]} for d in ("forward", "backward") for a in _SIDE_LISTS]],
    "idle_timeout": IDLE_S, "bidirectional": True,
    "key_features": ["sourceIPAddress", "destinationIPAddress", "protocolIdentifier", "sourceTransportPort", "destinationTransportPort"]}]}})


@register("spec_accumulate_caia", with_views("pkt_pair", extra=KEYED_SQL + f""",
firsts AS (SELECT {KEY5}, session, min(ts) AS f_ts, arg_min(src, (ts, packet_no)) AS f_src, arg_min(dst, (ts, packet_no)) AS f_dst,
  arg_min(sport, (ts, packet_no)) AS f_sport, arg_min(dport, (ts, packet_no)) AS f_dport, arg_min(a_side, (ts, packet_no)) AS f_a
  FROM sess GROUP BY {KEY5}, session)""")
          + "SELECT (epoch_us(any_value(f_ts)) // 1000) AS flowStartMilliseconds, any_value(f_src) AS sourceIPAddress, "
          "any_value(f_dst) AS destinationIPAddress, any_value(f_sport) AS sourceTransportPort, any_value(f_dport) AS destinationTransportPort, "
          "proto AS protocolIdentifier, "
          + ", ".join(f"coalesce(string_agg({sql}, ',' ORDER BY ts, packet_no) FILTER (WHERE a_side {op} f_a), '') AS \"apply(accumulate({a}),{d})\""
                      for d, op in (("forward", "="), ("backward", "<>")) for a, sql in _SIDE_LISTS.items())
          + f" FROM sess JOIN firsts USING ({KEY5}, session) GROUP BY {KEY5}, session")
def q_spec_accumulate_caia(spark, sf):
    return _listed(extract_flows(pkt_pair(spark, sf), CAIA_LIST_SPEC), [feature_name(f) for f in CAIA_LIST_SPEC.features[6:]])
