"""Packet and flow views over the driver's tables (FIXTURES.md §7).

The reference reads packet captures through external tools; here a packet
is a row.  Three stand-in views map the driver's tables to the packet
schema (``capture, packet_no, ts, src, dst, sport, dport, proto, ttl,
octets, ip_len, flags``):

* ``pkt_user``  – ``events``; source = user (AGM flows, packet sampling)
* ``pkt_pair``  – ``events``; client/server pairs seen in both directions
  (bidirectional 5-tuple flows, labeling)
* ``pkt_order`` – ``lineitem``; flow = order (per-flow sampling)

Every expression here has a twin in ``trafficlab.plans.oracle_views``; the
two must stay in step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# Event type -> TCP flag letters ('' = non-TCP packet).
EVENT_FLAGS = {"click": "S", "view": "A", "error": "SA", "purchase": "PA", "signup": ""}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _flags_from_event(c: Column) -> Column:
    out = None
    for ev, fl in EVENT_FLAGS.items():
        out = (F.when(c == ev, F.lit(fl)) if out is None else out.when(c == ev, F.lit(fl)))
    return out.otherwise(F.lit(""))


def _event_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    octets = F.round(F.col("value") * 100).cast("long")
    return ev.select(
        F.date_format("ts", "EEEE").alias("capture"),
        F.col("event_id").alias("packet_no"),
        F.col("ts"),
        F.col("user_id"),
        F.col("event_type"),
        k.alias("k"),
        octets.alias("octets"),
        _flags_from_event(F.col("event_type")).alias("flags"),
    )


def pkt_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _event_base(spark, sf_dir)
    return b.select(
        "capture", "packet_no", "ts",
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("src"),
        F.concat(F.lit("h"), (F.col("k") % 8).cast("string")).alias("dst"),
        (F.lit(1024) + F.col("packet_no") % 4).cast("long").alias("sport"),
        F.col("k").alias("dport"),
        F.when(F.col("event_type") == "signup", F.lit(17)).otherwise(F.lit(6)).cast("long").alias("proto"),
        (F.lit(60) + F.col("k") % 5).cast("long").alias("ttl"),
        "octets",
        (F.col("octets") + 40).alias("ip_len"),
        "flags",
    )


def pkt_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _event_base(spark, sf_dir)
    client = F.concat(F.lit("c"), (F.col("user_id") % 10).cast("string"))
    server = F.concat(F.lit("s"), (F.col("k") % 2).cast("string"))
    cport = (F.lit(50000) + F.col("user_id") % 10).cast("long")
    sport = F.when(F.col("k") % 2 == 0, F.lit(80)).otherwise(F.lit(443)).cast("long")
    even = F.col("packet_no") % 2 == 0
    return b.select(
        "capture", "packet_no", "ts",
        F.when(even, client).otherwise(server).alias("src"),
        F.when(even, server).otherwise(client).alias("dst"),
        F.when(even, cport).otherwise(sport).alias("sport"),
        F.when(even, sport).otherwise(cport).alias("dport"),
        F.lit(6).cast("long").alias("proto"),
        (F.lit(60) + F.col("k") % 5).cast("long").alias("ttl"),
        "octets",
        (F.col("octets") + 40).alias("ip_len"),
        "flags",
    )


# order of packets inside an order-flow; (l_orderkey, l_linenumber) alone is not unique
ORDER_SORT = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]


def pkt_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", *ORDER_SORT,
        F.col("l_quantity").cast("long").alias("octets"),
        F.col("l_returnflag").alias("flags"),
        F.when(F.col("l_linestatus") == "O", F.lit("f")).otherwise(F.lit("b")).alias("direction"),
        F.col("l_suppkey").alias("dst"),
    )


def attack_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attack schedule derived from the capture days (the original labeler is
    external): every day a 'DoS' window 08:00-16:00 from client c(d % 10) to
    server s(d % 2), and a 'PortScan' window 00:00-12:00 from client
    c((d + 3) % 10) to server s1, where d = days since 1970-01-01."""
    days = table(spark, sf_dir, "events").select(F.date_trunc("day", "ts").alias("day")).distinct()
    d = F.datediff(F.to_date("day"), F.lit("1970-01-01").cast("date")).cast("long")
    dos = days.select(F.lit("DoS").alias("attack"),
                      F.concat(F.lit("c"), (d % 10).cast("string")).alias("src"),
                      F.concat(F.lit("s"), (d % 2).cast("string")).alias("dst"),
                      (F.col("day") + F.expr("INTERVAL 8 HOURS")).alias("t0"),
                      (F.col("day") + F.expr("INTERVAL 16 HOURS")).alias("t1"),
                      F.lit(1).alias("priority"))
    scan = days.select(F.lit("PortScan").alias("attack"),
                       F.concat(F.lit("c"), ((d + 3) % 10).cast("string")).alias("src"),
                       F.lit("s1").alias("dst"),
                       F.col("day").alias("t0"),
                       (F.col("day") + F.expr("INTERVAL 12 HOURS")).alias("t1"),
                       F.lit(2).alias("priority"))
    return dos.unionByName(scan)


def agm_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-source schedule for AGM labeling: every day a 'Botnet' window
    (whole day) from user u(d % 50)."""
    days = table(spark, sf_dir, "events").select(F.date_trunc("day", "ts").alias("day")).distinct()
    d = F.datediff(F.to_date("day"), F.lit("1970-01-01").cast("date")).cast("long")
    return days.select(F.lit("Botnet").alias("attack"),
                       F.concat(F.lit("u"), (d % 50).cast("string")).alias("src"),
                       F.lit(None).cast("string").alias("dst"),
                       F.col("day").alias("t0"),
                       (F.col("day") + F.expr("INTERVAL 1 DAYS")).alias("t1"),
                       F.lit(1).alias("priority"))
