"""Column orders of the two feature vectors and the packet schema."""

from __future__ import annotations

from pyspark.sql import types as T

PACKET_SCHEMA = T.StructType([
    T.StructField("capture", T.StringType()),
    T.StructField("packet_no", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("src", T.StringType()),
    T.StructField("dst", T.StringType()),
    T.StructField("sport", T.LongType()),
    T.StructField("dport", T.LongType()),
    T.StructField("proto", T.LongType()),
    T.StructField("ttl", T.LongType()),
    T.StructField("octets", T.LongType()),
    T.StructField("ip_len", T.LongType()),
    T.StructField("flags", T.StringType()),
])

# CAIA feature vector, 34 columns in this order.
CAIA_HEAD = ["flowStartMilliseconds", "sourceIPAddress", "destinationIPAddress",
             "sourceTransportPort", "destinationTransportPort", "protocolIdentifier"]
CAIA_COUNTS = ["packetTotalCount", "octetTotalCount", "tcpSynTotalCount",
               "tcpAckTotalCount", "tcpFinTotalCount", "_tcpCwrTotalCount"]
CAIA_STATS = ["ipTotalLength", "_interPacketTimeSeconds"]
CAIA_STAT_FUNCS = ["min", "mean", "max", "stdev"]
DIRECTIONS = ["forward", "backward"]


def caia_order() -> list[str]:
    cols = list(CAIA_HEAD)
    for d in DIRECTIONS:
        cols += [f"count({c},{d})" for c in CAIA_COUNTS]
        for s in CAIA_STATS:
            cols += [f"{fn}({s},{d})" for fn in CAIA_STAT_FUNCS]
    return cols


CAIA_ORDER = caia_order()

# AGM feature vector, 31 columns in this order.
AGM_NUMERIC = ["sourceTransportPort", "destinationTransportPort", "protocolIdentifier",
               "ipTTL", "octetTotalCount"]
AGM_ORDER = (["flowStartMilliseconds", "N", "C", "E", "U", "S", "R", "F", "P", "A",
              "sourceIPAddress", "distinct(_tcpFlags)", "modeCount(_tcpFlags)"]
             + [f"{fn}({a})" for a in AGM_NUMERIC for fn in ("distinct", "mode", "modeCount")]
             + ["distinct(destinationIPAddress)", "modeCount(destinationIPAddress)",
                "packetTotalCount"])

# packet column -> exporter attribute name
AGM_ATTR_SOURCE = {"sourceTransportPort": "sport", "destinationTransportPort": "dport",
                   "protocolIdentifier": "proto", "ipTTL": "ttl", "octetTotalCount": "octets"}
