"""DuckDB twins of the stand-in views in ``trafficlab.sources.tables``.

Each oracle query starts with ``WITH`` + the views it needs, so the oracle
reads only the driver's pre-registered base tables.
"""

from __future__ import annotations

EVENT_BASE = """
ev_base AS (
  SELECT dayname(ts) AS capture, event_id AS packet_no, ts, user_id, event_type,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
         CAST(round(value * 100) AS BIGINT) AS octets,
         CASE event_type WHEN 'click' THEN 'S' WHEN 'view' THEN 'A' WHEN 'error' THEN 'SA'
                         WHEN 'purchase' THEN 'PA' ELSE '' END AS flags
  FROM events)"""

PKT_USER = """
pkt_user AS (
  SELECT capture, packet_no, ts, 'u' || CAST(user_id AS VARCHAR) AS src,
         'h' || CAST(k % 8 AS VARCHAR) AS dst,
         CAST(1024 + packet_no % 4 AS BIGINT) AS sport, k AS dport,
         CAST(CASE WHEN event_type = 'signup' THEN 17 ELSE 6 END AS BIGINT) AS proto,
         CAST(60 + k % 5 AS BIGINT) AS ttl, octets, octets + 40 AS ip_len, flags
  FROM ev_base)"""

PKT_PAIR = """
pkt_pair AS (
  SELECT capture, packet_no, ts,
         CASE WHEN packet_no % 2 = 0 THEN 'c' || CAST(user_id % 10 AS VARCHAR) ELSE 's' || CAST(k % 2 AS VARCHAR) END AS src,
         CASE WHEN packet_no % 2 = 0 THEN 's' || CAST(k % 2 AS VARCHAR) ELSE 'c' || CAST(user_id % 10 AS VARCHAR) END AS dst,
         CAST(CASE WHEN packet_no % 2 = 0 THEN 50000 + user_id % 10 ELSE CASE WHEN k % 2 = 0 THEN 80 ELSE 443 END END AS BIGINT) AS sport,
         CAST(CASE WHEN packet_no % 2 = 0 THEN CASE WHEN k % 2 = 0 THEN 80 ELSE 443 END ELSE 50000 + user_id % 10 END AS BIGINT) AS dport,
         CAST(6 AS BIGINT) AS proto, CAST(60 + k % 5 AS BIGINT) AS ttl, octets, octets + 40 AS ip_len, flags
  FROM ev_base)"""

PKT_ORDER = """
pkt_order AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice,
         CAST(l_quantity AS BIGINT) AS octets, l_returnflag AS flags,
         CASE WHEN l_linestatus = 'O' THEN 'f' ELSE 'b' END AS direction,
         l_suppkey AS dst
  FROM lineitem)"""

ORDER_SORT = "l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice"

_VIEWS = {"ev_base": EVENT_BASE, "pkt_user": PKT_USER, "pkt_pair": PKT_PAIR, "pkt_order": PKT_ORDER}
_DEPS = {"pkt_user": ["ev_base"], "pkt_pair": ["ev_base"]}


def with_views(*names: str, extra: str = "") -> str:
    """``WITH`` clause holding the named views (and their dependencies)."""
    ordered: list[str] = []
    for n in names:
        for d in _DEPS.get(n, []):
            if d not in ordered:
                ordered.append(d)
        if n not in ordered:
            ordered.append(n)
    parts = [_VIEWS[n].strip() for n in ordered]
    if extra:
        parts.append(extra.strip())
    return "WITH " + ",\n".join(parts) + "\n"

SCHEDULE = """
days AS (SELECT DISTINCT date_trunc('day', ts) AS day FROM events),
sched AS (
  SELECT 'DoS' AS attack, 'c' || CAST(datediff('day', DATE '1970-01-01', day) % 10 AS VARCHAR) AS src,
         's' || CAST(datediff('day', DATE '1970-01-01', day) % 2 AS VARCHAR) AS dst,
         day + INTERVAL 8 HOUR AS t0, day + INTERVAL 16 HOUR AS t1, 1 AS priority FROM days
  UNION ALL
  SELECT 'PortScan', 'c' || CAST((datediff('day', DATE '1970-01-01', day) + 3) % 10 AS VARCHAR), 's1',
         day, day + INTERVAL 12 HOUR, 2 FROM days),
agm_sched AS (
  SELECT 'Botnet' AS attack, 'u' || CAST(datediff('day', DATE '1970-01-01', day) % 50 AS VARCHAR) AS src,
         day AS t0, day + INTERVAL 1 DAY AS t1, 1 AS priority FROM days)"""
