"""Queries for column helpers (B1, B5, B6), array functions (S3-S6) and the
CAIA sub-vectors (F8-F11), PCA fit and forest shape."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.flags import parse_flag_list
from ..operators import columns as C
from ..operators import flows as FW
from ..schema import CAIA_ORDER
from ..sources.tables import pkt_pair, table
from .oracle_views import ORDER_SORT as SQL_ORDER_SORT
from .oracle_views import with_views
from .q_flows import IDLE_S, _accumulated, _caia_sql
from .registry import register, round_doubles

LI_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
           "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@register("select_keyword", "SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem")
def q_select_keyword(spark, sf):
    return C.columns_like(table(spark, sf, "lineitem"), "key")


@register("drop_strings", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, "
          "l_discount, l_tax, l_shipdate FROM lineitem")
def q_drop_strings(spark, sf):
    return C.drop_string_columns(table(spark, sf, "lineitem"))


_PAIR_COLS = ["capture", "packet_no", "ts", "src", "dst", "sport", "dport", "proto", "ttl", "octets", "ip_len", "flags"]


@register("drop_constant", with_views("pkt_pair") + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) <= 1 AS dropped FROM pkt_pair" for c in _PAIR_COLS))
def q_drop_constant(spark, sf):
    return C.constant_profile(pkt_pair(spark, sf), _PAIR_COLS)


@register("parse_flag_list", with_views("pkt_order") + f"""
SELECT l_orderkey, count(*) AS n_slots, count(*) FILTER (WHERE flags = 'N') AS n_nontcp,
       string_agg(CASE WHEN flags = 'N' THEN '0' ELSE flags END, ',' ORDER BY {SQL_ORDER_SORT}) AS flags_parsed
FROM pkt_order GROUP BY l_orderkey""")
def q_parse_flag_list(spark, sf):
    acc = _accumulated(spark, sf)
    arr = parse_flag_list(F.col("flags_list"), F.col("packets"))
    return acc.select("l_orderkey", F.size(arr).cast("long").alias("n_slots"),
                      F.size(F.filter(arr, lambda x: x == "0")).cast("long").alias("n_nontcp"),
                      F.array_join(arr, ",").alias("flags_parsed"))


_FPOS = (f"fpos AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {SQL_ORDER_SORT}) - 1 AS pos FROM pkt_order)")


@register("array_sample_every_nth", with_views("pkt_order", extra=_FPOS) + f"""
SELECT l_orderkey, string_agg(CAST(octets AS VARCHAR), ' ' ORDER BY pos) AS sampled FROM fpos WHERE pos % 2 = 0 GROUP BY l_orderkey""")
def q_array_sample_every_nth(spark, sf):
    acc = _accumulated(spark, sf)
    arr = A.every_nth(A.parse_number_list(F.col("octets_list"), "long"), 2)
    return acc.select("l_orderkey", F.array_join(arr.cast("array<string>"), " ").alias("sampled"))


@register("array_sample_first_n", with_views("pkt_order", extra=_FPOS) + f"""
SELECT l_orderkey, string_agg(CAST(octets AS VARCHAR), ' ' ORDER BY pos) AS sampled FROM fpos WHERE pos < 3 GROUP BY l_orderkey""")
def q_array_sample_first_n(spark, sf):
    acc = _accumulated(spark, sf)
    arr = A.first_n(A.parse_number_list(F.col("octets_list"), "long"), 3)
    return acc.select("l_orderkey", F.array_join(arr.cast("array<string>"), " ").alias("sampled"))


@register("array_stats", with_views("pkt_order") + """
SELECT l_orderkey, count(*) AS n, round(CAST(sum(octets) AS DOUBLE), 6) AS sum, CAST(min(octets) AS DOUBLE) AS min,
       CAST(max(octets) AS DOUBLE) AS max, round(avg(octets), 6) AS mean, count(DISTINCT octets) AS "distinct"
FROM pkt_order GROUP BY l_orderkey""")
def q_array_stats(spark, sf):
    acc = _accumulated(spark, sf)
    st = A.array_stats(A.parse_number_list(F.col("octets_list"), "long"))
    return round_doubles(acc.select("l_orderkey", *[v.alias(k) for k, v in st.items()]))


_COUNT_COLS = [c for c in CAIA_ORDER if c.startswith("count(")]
_STAT_COLS = [c for c in CAIA_ORDER[6:] if not c.startswith("count(")]
_FLOWKEY = ["flowStartMilliseconds", "sourceIPAddress", "destinationIPAddress", "sourceTransportPort", "destinationTransportPort"]


def _caia_subset(cols):
    """The CAIA oracle with an outer projection onto ``cols``."""
    sql = _caia_sql()
    head, body = sql.rsplit("SELECT ", 1)
    quoted = ", ".join(f'"{c}"' for c in _FLOWKEY + cols)
    return f"{head}SELECT {quoted} FROM (SELECT {body})"


@register("caia_counts", _caia_subset(_COUNT_COLS))
def q_caia_counts(spark, sf):
    v = FW.caia_vector(pkt_pair(spark, sf), IDLE_S, active_seconds=None)
    return v.select(*[F.col(f"`{c}`") for c in _FLOWKEY + _COUNT_COLS])


@register("caia_stats", _caia_subset(_STAT_COLS))
def q_caia_stats(spark, sf):
    v = round_doubles(FW.caia_vector(pkt_pair(spark, sf), IDLE_S, active_seconds=None))
    return v.select(*[F.col(f"`{c}`") for c in _FLOWKEY + _STAT_COLS])
