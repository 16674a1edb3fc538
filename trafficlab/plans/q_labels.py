"""Queries for labeling (E1-E3) and exploratory distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import flows as FW
from ..operators import labels as LB
from ..sources.tables import agm_schedule, attack_schedule, pkt_pair, pkt_user, table
from .oracle_views import SCHEDULE, with_views
from .q_flows import KEY5, KEYED_SQL, IDLE_S, WINDOW_S, _WIN_US
from .registry import register, round_doubles

FLOWS_SQL = KEYED_SQL + f""",
pflows AS (SELECT {KEY5}, session, arg_min(src, (ts, packet_no)) AS sourceIPAddress,
                  arg_min(dst, (ts, packet_no)) AS destinationIPAddress,
                  min(ts) AS flow_start, max(ts) AS flow_end, count(*) AS packets
           FROM sess GROUP BY {KEY5}, session),""" + SCHEDULE


def pair_flows(spark, sf):
    """Bidirectional flows of ``pkt_pair`` with the first packet's addresses."""
    s = FW.sessionize(FW.with_canonical_key(pkt_pair(spark, sf)), FW.FIVE_TUPLE, IDLE_S)
    g = s.groupBy(*FW.FIVE_TUPLE, "session").agg(
        F.min(F.struct("ts", "packet_no", "src", "dst")).alias("_f"),
        F.min("ts").alias("flow_start"), F.max("ts").alias("flow_end"),
        F.count(F.lit(1)).alias("packets"))
    return g.select(*FW.FIVE_TUPLE, "session", F.col("_f.src").alias("sourceIPAddress"),
                    F.col("_f.dst").alias("destinationIPAddress"), "flow_start", "flow_end", "packets")


def _labeled(spark, sf, mode):
    return LB.label_flows(pair_flows(spark, sf), attack_schedule(spark, sf), mode)


def _label_sql(bidir: bool) -> str:
    sch = "sched" if not bidir else "(SELECT * FROM sched UNION ALL SELECT attack, dst, src, t0, t1, priority FROM sched)"
    return with_views("pkt_pair", extra=FLOWS_SQL) + f"""
SELECT f.{KEY5.replace(', ', ', f.')}, f.session, coalesce(m.attack, 'Normal') AS Attack,
       CAST(CASE WHEN m.attack IS NULL THEN 0 ELSE 1 END AS INTEGER) AS Label
FROM pflows f LEFT JOIN (
  SELECT * FROM (SELECT f.{KEY5.replace(', ', ', f.')}, f.session, s.attack,
                        row_number() OVER (PARTITION BY f.{KEY5.replace(', ', ', f.')}, f.session ORDER BY s.priority, s.attack) AS rn
                 FROM pflows f JOIN {sch} s ON f.sourceIPAddress = s.src AND f.destinationIPAddress = s.dst
                   AND f.flow_start >= s.t0 AND f.flow_start < s.t1) WHERE rn = 1) m
USING ({KEY5}, session)"""


@register("label_5tuple", _label_sql(False))
def q_label_5tuple(spark, sf):
    return _labeled(spark, sf, "5tuple").select(*FW.FIVE_TUPLE, "session", "Attack", "Label")


@register("label_5tuplebi", _label_sql(True))
def q_label_5tuplebi(spark, sf):
    return _labeled(spark, sf, "5tuplebi").select(*FW.FIVE_TUPLE, "session", "Attack", "Label")


_AGM_FLOWS_SQL = f"""
aflows AS (SELECT src, CAST(floor(epoch_us(ts) / {_WIN_US}) AS BIGINT) AS win, min(ts) AS flow_start, max(ts) AS flow_end
           FROM pkt_user GROUP BY 1, 2),""" + SCHEDULE


@register("label_agm", with_views("pkt_user", extra=_AGM_FLOWS_SQL) + """
SELECT f.src, f.win, coalesce(m.attack, 'Normal') AS Attack, CAST(CASE WHEN m.attack IS NULL THEN 0 ELSE 1 END AS INTEGER) AS Label
FROM aflows f LEFT JOIN (
  SELECT * FROM (SELECT f.src, f.win, s.attack, row_number() OVER (PARTITION BY f.src, f.win ORDER BY s.priority, s.attack) AS rn
                 FROM aflows f JOIN agm_sched s ON f.src = s.src AND f.flow_start < s.t1 AND f.flow_end > s.t0) WHERE rn = 1) m
USING (src, win)""")
def q_label_agm(spark, sf):
    f = FW.agm_flow_id(pkt_user(spark, sf), WINDOW_S).groupBy("src", "win").agg(
        F.min("ts").alias("flow_start"), F.max("ts").alias("flow_end"))
    lab = LB.label_flows(f, agm_schedule(spark, sf), "AGM", src="src", start="flow_start", end="flow_end")
    return lab.select("src", "win", "Attack", "Label")


def _labeled_cte(bidir: bool = False) -> str:
    """The 5-tuple labeled flows as one more CTE after the flow views."""
    body = _label_sql(bidir)
    head, sel = body.rsplit("\nSELECT f.", 1)
    return head + ",\nlabeled AS (SELECT p.*, l.Attack, l.Label FROM pflows p JOIN (SELECT f." + sel + f") l USING ({KEY5}, session))\n"


@register("attack_distribution", _labeled_cte() + "SELECT Attack, Label, count(*) AS n FROM labeled GROUP BY Attack, Label")
def q_attack_distribution(spark, sf):
    return LB.distribution(_labeled(spark, sf, "5tuple"), ["Attack", "Label"])


@register("attack_rollup", _labeled_cte()
          + "SELECT dayname(flow_start) AS capture, Attack, count(*) AS n FROM labeled GROUP BY ROLLUP (dayname(flow_start), Attack)")
def q_attack_rollup(spark, sf):
    lab = _labeled(spark, sf, "5tuple").withColumn("capture", F.date_format("flow_start", "EEEE"))
    return LB.distribution_rollup(lab, ["capture", "Attack"])


@register("ip_distribution", _labeled_cte()
          + "SELECT sourceIPAddress, Label, count(*) AS n FROM labeled GROUP BY sourceIPAddress, Label")
def q_ip_distribution(spark, sf):
    return LB.distribution(_labeled(spark, sf, "5tuple"), ["sourceIPAddress", "Label"])


_DESCRIBE_COLS = ["l_quantity", "l_extendedprice", "l_discount"]


@register("describe", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(CAST(count({c}) AS DOUBLE), 6) AS count, round(avg({c}), 6) AS mean, "
    f"round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS p25, "
    f"round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.75), 6) AS p75, round(max({c}), 6) AS max "
    f"FROM lineitem" for c in _DESCRIBE_COLS))
def q_describe(spark, sf):
    return round_doubles(LB.describe(table(spark, sf, "lineitem"), _DESCRIBE_COLS))


@register("extreme_flows", with_views("pkt_pair", extra=FLOWS_SQL) + f"""
SELECT (SELECT min(packets) FROM pflows) AS min_packets,
       (SELECT a_ip FROM pflows ORDER BY packets, {KEY5}, session LIMIT 1) AS min_a_ip,
       (SELECT session FROM pflows ORDER BY packets, {KEY5}, session LIMIT 1) AS min_session,
       (SELECT max(packets) FROM pflows) AS max_packets,
       (SELECT a_ip FROM pflows ORDER BY packets DESC, {KEY5}, session LIMIT 1) AS max_a_ip,
       (SELECT session FROM pflows ORDER BY packets DESC, {KEY5}, session LIMIT 1) AS max_session""")
def q_extreme_flows(spark, sf):
    e = LB.extreme_flows(pair_flows(spark, sf), "packets", FW.FIVE_TUPLE + ["session"])
    return e.select("min_packets", F.col("min_flow.a_ip").alias("min_a_ip"),
                    F.col("min_flow.session").alias("min_session"), "max_packets",
                    F.col("max_flow.a_ip").alias("max_a_ip"), F.col("max_flow.session").alias("max_session"))
