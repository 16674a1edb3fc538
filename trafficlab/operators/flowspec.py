"""declarative flow feature specs -> DataFrame aggregates.

A spec lists the features of a flow (plain names such as
``packetTotalCount``, functions such as ``{"modeCount": ["ipTTL"]}`` and the
direction wrapper ``{"apply": [feature, "forward"]}``), the key features,
``bidirectional`` and the timeouts.  Both envelopes are read: the flat one
and ``{"version": "v2", "preprocessing": {"flows": [...]}}``.

The compiler produces ordinary Spark aggregates: unidirectional specs go
through the two-level (flow, attribute, value) count table (distinct, mode,
modeCount, min / mean / max / stdev all come from it), bidirectional specs
through per-direction conditional aggregates over the flows of both timeouts.
``{"apply": [{"accumulate": [attribute]}, direction]}`` keeps the packets'
values in time order as one array (NULLs included), so the packets of such a
flow must fit into a row.  Anything else in a spec raises an error.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.flags import flag_combo
from ..functions.stats import stdev0
from ..functions.timecols import is_ntz, millis
from ..schema import CAIA_COUNTS, CAIA_HEAD, CAIA_STAT_FUNCS, CAIA_STATS, DIRECTIONS
from . import flows as FW

# Exporter attribute name -> packet column.
ATTRIBUTES = {
    "sourceIPAddress": "src", "destinationIPAddress": "dst", "sourceTransportPort": "sport",
    "destinationTransportPort": "dport", "protocolIdentifier": "proto", "ipTTL": "ttl",
    "octetTotalCount": "octets", "ipTotalLength": "ip_len", "_tcpFlags": "flags",
    "_interPacketTimeSeconds": "ipt",
}
TEXT_ATTRIBUTES = {"sourceIPAddress", "destinationIPAddress", "_tcpFlags"}
# Per-packet counters (name -> flag letter, '' = every packet).
COUNTERS = {"packetTotalCount": "", "tcpSynTotalCount": "S", "tcpAckTotalCount": "A",
            "tcpFinTotalCount": "F", "_tcpCwrTotalCount": "C"}


# User flow functions for unidirectional specs.  A function receives the
# distinct values of the attribute in the flow and their counts (both
# NULL outside the attribute) and returns an aggregate Column.
USER_FUNCTIONS: dict[str, Any] = {}


def register_flow_function(name: str, fn) -> None:
    """Make ``{"<name>": [attribute]}`` usable in a spec."""
    USER_FUNCTIONS[name] = fn


@dataclass
class FlowSpec:
    features: list[Any]
    key_features: list[str]
    bidirectional: bool = False
    active_timeout: float | None = None
    idle_timeout: float | None = None
    extra: dict = field(default_factory=dict)

    @classmethod
    def from_json(cls, src: str | Path | dict) -> "FlowSpec":
        if isinstance(src, dict):
            d = src
        else:
            d = json.loads(Path(src).read_text())
        if d.get("version") == "v2":
            d = d["preprocessing"]["flows"][0]
        unknown = set(d) - {"features", "key_features", "bidirectional", "active_timeout", "idle_timeout"}
        if unknown:
            raise ValueError(f"unsupported spec fields {sorted(unknown)}")
        return cls(features=list(d["features"]), key_features=list(d.get("key_features", [])),
                   bidirectional=bool(d.get("bidirectional", False)),
                   active_timeout=d.get("active_timeout"), idle_timeout=d.get("idle_timeout"))

    def window_seconds(self) -> int | None:
        for k in self.key_features:
            m = re.fullmatch(r"__timeWindow(\d+)s", k)
            if m:
                return int(m.group(1))
        return None


def agm_spec(window_seconds: int = 10, idle: float | None = None, active: float | None = None) -> FlowSpec:
    """Per source address and time window: distinct, mode and modeCount of every other attribute."""
    counted = [a for a in ATTRIBUTES if a not in ("sourceIPAddress", "ipTotalLength", "_interPacketTimeSeconds")]
    features = ["flowStartMilliseconds", "sourceIPAddress"]
    features += [{fn: [a]} for a in counted for fn in ("distinct", "mode", "modeCount")]
    return FlowSpec(features + ["packetTotalCount"], ["sourceIPAddress", f"__timeWindow{window_seconds}s"], False, active, idle)


def caia_spec(idle: float | None = 300, active: float | None = None) -> FlowSpec:
    """Both directions of a 5-tuple: counters and statistics of each direction."""
    inner = list(CAIA_COUNTS) + [{fn: [s]} for s in CAIA_STATS for fn in CAIA_STAT_FUNCS]
    return FlowSpec(CAIA_HEAD + [{"apply": [f, d]} for d in DIRECTIONS for f in inner], CAIA_HEAD[1:], True, active, idle)


def feature_name(f: Any) -> str:
    """Canonical text of a feature: 'modeCount(ipTTL)', 'apply(min(ipTotalLength),forward)'."""
    if isinstance(f, str):
        return f
    (fn, args), = f.items()
    return f"{fn}({','.join(feature_name(a) for a in args)})"


def _attr_col(attr: str) -> Column:
    col = ATTRIBUTES[attr]
    if attr == "_tcpFlags":
        return flag_combo(F.col("flags"))
    return F.col(col)


def extract_flows(packets: DataFrame, spec: FlowSpec, window_seconds: int | None = None,
                  idle_seconds: float | None = None) -> DataFrame:
    """Compile ``spec`` and run it on packets (idle timeout / window overridable).

    A unidirectional spec without an idle timeout is cut by its window only; an
    active timeout cuts on top of the idle one.
    """
    if spec.bidirectional:
        return _bidirectional(packets, spec, idle_seconds or spec.idle_timeout or 300)
    return _unidirectional(packets, spec, window_seconds or spec.window_seconds() or 10, idle_seconds or spec.idle_timeout)


def _unidirectional(packets: DataFrame, spec: FlowSpec, window_seconds: int, idle_seconds: float | None = None) -> DataFrame:
    keys = [ATTRIBUTES[k] for k in spec.key_features if not k.startswith("__timeWindow")]
    if spec.active_timeout and not idle_seconds:
        idle_seconds = window_seconds  # a window holds no longer gap
    if idle_seconds and keys != ["src"]:
        raise ValueError("timeouts inside a window need the source address as the only key")
    flows = FW.agm_flow_id(packets, window_seconds, idle_seconds, spec.active_timeout if idle_seconds else None)
    fkeys = keys + [c for c in ("win", "session", "subflow") if c in flows.columns]
    funcs = [f for f in spec.features if isinstance(f, dict)]
    arrays = [f for f in funcs if _accumulated(f)]
    if arrays:
        if len(arrays) < len(funcs) or any(f["apply"][1] != "forward" for f in arrays):
            raise ValueError("a unidirectional spec takes accumulate in the forward direction, and no other function beside it")
        parts = sorted({_accumulated(f) for f in arrays})
        g = flows.groupBy(*fkeys).agg(F.min("ts").alias("_t0"), F.count(F.lit(1)).alias("_pk"), F.sum("octets").alias("_oc"),
                                      _packet_list(parts).alias("_list"))
        g = g.withColumns({feature_name(f): _values("_list", _accumulated(f)) for f in arrays})
        return _select_unidirectional(g, spec, packets, keys)
    for f in funcs:
        (fn, args), = f.items()
        if len(args) != 1 or not isinstance(args[0], str):
            raise ValueError(f"unsupported feature {feature_name(f)!r} in a unidirectional spec")
    attrs = sorted({a for f in funcs for a in next(iter(f.values()))}, key=str)
    items = []
    for a in attrs:
        txt = a in TEXT_ATTRIBUTES
        v = F.lit(None).cast("double") if txt else _attr_col(a).cast("double")
        s = _attr_col(a).cast("string") if txt else F.lit(None).cast("string")
        items.append(F.struct(F.lit(a).alias("attr"), v.alias("v"), s.alias("s")))
    aggs: list[Column] = [F.min("_t0").alias("_t0"), F.sum("_pk").alias("_pk"), F.sum("_oc").alias("_oc")]
    if items:
        long = flows.select(*fkeys, "ts", "packet_no", "octets",
                            F.posexplode(F.array(*items)).alias("_i", "x"))
        lvl1 = long.groupBy(*fkeys, F.col("x.attr").alias("attr"), F.col("x.v").alias("v"), F.col("x.s").alias("s")).agg(
            F.count(F.lit(1)).alias("c"), F.min("ts").alias("first_ts"),
            F.min(F.struct("ts", "packet_no")).alias("first_seen"),
            F.min(F.when(F.col("_i") == 0, F.col("ts"))).alias("_t0"),
            F.sum(F.when(F.col("_i") == 0, 1).otherwise(0)).alias("_pk"),
            F.sum(F.when(F.col("_i") == 0, F.col("octets")).otherwise(0)).alias("_oc"))
    else:
        lvl1 = flows.groupBy(*fkeys).agg(F.min("ts").alias("_t0"), F.count(F.lit(1)).alias("_pk"),
                                          F.sum("octets").alias("_oc"))
    moments: dict[str, Column] = {}
    for f in funcs:
        (fn, (a,)), = f.items()
        on = F.col("attr") == a
        txt = a in TEXT_ATTRIBUTES
        name = feature_name(f)
        val = F.col("s") if txt else F.col("v")
        if fn == "distinct":
            aggs.append(F.count(F.when(on, 1)).alias(name))
        elif fn == "modeCount":
            aggs.append(F.max(F.when(on, F.col("c"))).alias(name))
        elif fn == "mode":
            if txt:
                aggs.append(F.min_by(F.when(on, val), F.when(on, F.struct(-F.col("c"), F.col("first_seen")))).alias(name))
            else:
                aggs.append(F.max_by(F.when(on, val), F.when(on, F.struct(F.col("c"), -val))).cast("long").alias(name))
        elif fn in ("min", "max"):
            aggs.append((F.min if fn == "min" else F.max)(F.when(on, val)).alias(name))
        elif fn == "mean":
            aggs.append(F.try_divide(F.sum(F.when(on, val * F.col("c"))), F.sum(F.when(on, F.col("c"))).cast("double")).alias(name))
        elif fn == "stdev":
            # count, mean and centred second moment of the packets, merged pairwise from the map tasks on:
            # sums of squares would lose the digits of large values with a small spread
            moments[name] = stdev0(_attr_col(a).cast("double"))
        elif fn in USER_FUNCTIONS:
            aggs.append(USER_FUNCTIONS[fn](F.when(on, val), F.when(on, F.col("c"))).alias(name))
        else:
            raise ValueError(f"unsupported function {fn!r} in a unidirectional spec")
    grouped = lvl1.groupBy(*fkeys).agg(*aggs) if items else lvl1
    if moments:
        spread = flows.groupBy(*fkeys).agg(*[c.alias(name) for name, c in moments.items()])
        grouped = FW._key_join(grouped, spread, fkeys, "inner")
    return _select_unidirectional(grouped, spec, packets, keys)


def _select_unidirectional(grouped: DataFrame, spec: FlowSpec, packets: DataFrame, keys: list[str]) -> DataFrame:
    plain = {"flowStartMilliseconds": millis(F.col("_t0"), is_ntz(packets, "ts")),
             "packetTotalCount": F.col("_pk").cast("long"),
             "octetTotalCount": F.col("_oc").cast("long")}
    for k, col in zip([k for k in spec.key_features if not k.startswith("__timeWindow")], keys):
        plain[k] = F.col(col)
    sel = [F.col("win").alias("timeWindow")]
    for f in spec.features:
        name = feature_name(f)
        sel.append(plain[name].alias(name) if isinstance(f, str) else F.col(f"`{name}`"))
    return grouped.select(*sel)


def _accumulated(feature: Any) -> str | None:
    """The attribute of ``{"apply": [{"accumulate": [attribute]}, direction]}``."""
    if isinstance(feature, dict) and "apply" in feature and isinstance(feature["apply"][0], dict):
        (fn, args), = feature["apply"][0].items()
        if fn == "accumulate":
            if len(args) != 1 or args[0] not in ATTRIBUTES.keys() | COUNTERS.keys():
                raise ValueError(f"unsupported feature {feature_name(feature)!r}")
            return args[0]
    return None


def _packet_value(attr: str) -> Column:
    if attr in COUNTERS:
        letter = COUNTERS[attr]
        return F.lit(1) if not letter else F.coalesce(F.col("flags").contains(letter), F.lit(False)).cast("int")
    return _attr_col(attr)


def _packet_list(attrs: list[str], cond: Column | None = None) -> Column:
    """The packets (those meeting ``cond``) in time order, as one array of their values."""
    row = F.struct("ts", "packet_no", *[_packet_value(a).alias(a) for a in attrs])
    return F.array_sort(F.collect_list(row if cond is None else F.when(cond, row)))


def _values(listed: str, attr: str) -> Column:
    return F.transform(F.col(f"`{listed}`"), lambda x: x[attr])


def _side_expr(feature: Any, cond: Column, flags: Column) -> Column:
    """Aggregate of one (non-apply) feature over the packets matching ``cond``."""
    if isinstance(feature, str):
        if feature in COUNTERS:
            letter = COUNTERS[feature]
            hit = cond if not letter else cond & flags.contains(letter)
            return F.count(F.when(hit, 1))
        if feature == "octetTotalCount":
            return F.coalesce(F.sum(F.when(cond, F.col("octets"))), F.lit(0)).cast("long")
        raise ValueError(f"unsupported directional feature {feature!r}")
    (fn, (a,)), = feature.items()
    v = F.when(cond, F.col(ATTRIBUTES[a]).cast("double"))
    known = {"min": F.min, "max": F.max, "mean": F.avg, "stdev": stdev0}
    if fn not in known:
        raise ValueError(f"unsupported directional function {fn!r}")
    return known[fn](v)


def _bidirectional(packets: DataFrame, spec: FlowSpec, idle_seconds: float) -> DataFrame:
    ipt, fkey = FW.bidirectional_flows(packets, idle_seconds, spec.active_timeout or None)
    flags = F.col("flags")
    aggs = [F.min(F.struct("ts", "packet_no", "src", "dst", "sport", "dport", "a_side")).alias("_first")]
    parts = sorted({_accumulated(f) for f in spec.features if _accumulated(f)})
    if parts:
        aggs += [_packet_list(parts, F.col("a_side")).alias("_a_list"), _packet_list(parts, ~F.col("a_side")).alias("_b_list")]
    for f in spec.features:
        if isinstance(f, dict) and "apply" in f and not _accumulated(f):
            inner = f["apply"][0]
            name = feature_name(f)
            aggs.append(_side_expr(inner, F.col("a_side"), flags).alias(f"a:{name}"))
            aggs.append(_side_expr(inner, ~F.col("a_side"), flags).alias(f"b:{name}"))
    g = ipt.groupBy(*fkey).agg(*aggs)
    first = F.col("_first")
    fwd_is_a = first["a_side"]
    plain = {"flowStartMilliseconds": millis(first["ts"], is_ntz(packets, "ts")),
             "sourceIPAddress": first["src"], "destinationIPAddress": first["dst"],
             "sourceTransportPort": first["sport"], "destinationTransportPort": first["dport"],
             "protocolIdentifier": F.col("proto")}
    sel = []
    for f in spec.features:
        name = feature_name(f)
        if isinstance(f, str):
            sel.append(plain[name].alias(name))
        elif "apply" not in f or f["apply"][1] not in ("forward", "backward"):
            raise ValueError(f"unsupported feature {name!r} in a bidirectional spec")
        else:
            attr = _accumulated(f)
            a, b = (_values("_a_list", attr), _values("_b_list", attr)) if attr else (F.col(f"`a:{name}`"), F.col(f"`b:{name}`"))
            fwd = f["apply"][1] == "forward"
            sel.append(F.when(fwd_is_a, a if fwd else b).otherwise(b if fwd else a).alias(name))
    return g.select(*sel)
