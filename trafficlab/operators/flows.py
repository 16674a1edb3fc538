"""Flow collection: sessions, direction, inter-packet time, CAIA and AGM vectors.

A flow is a grouped aggregate over packets.  Everything that depends on
packet order (idle-timeout sessions, inter-packet times) goes through the
skew-safe :func:`keyed_scan`; everything else is a hash aggregate with a
map-side partial step, so one huge flow never lands in one task.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.flags import flag_combo, flag_mode_letters
from ..functions.stats import stdev0
from ..functions.timecols import is_ntz, micros, millis
from ..schema import AGM_ATTR_SOURCE, AGM_NUMERIC, AGM_ORDER, CAIA_ORDER
from ..session import drop_staged, staged
from .position import keyed_scan

PACKET_ORDER = ["ts", "packet_no"]
FIVE_TUPLE = ["a_ip", "a_port", "b_ip", "b_port", "proto"]
_PROBE = 1 << 62  # above every packet number


def _micros(ts: Column, ntz: bool = True) -> Column:
    """Epoch microseconds (time-zone free for NTZ packet times)."""
    return micros(ts, ntz)


def _ntz(df: DataFrame, col: str = "ts") -> bool:
    return is_ntz(df, col)


def with_canonical_key(packets: DataFrame) -> DataFrame:
    """both directions of a 5-tuple get the same key (ordered endpoints).

    ``a_side`` is true when the packet travels from endpoint a to endpoint b.
    """
    # endpoints compare with NULL below every value, so the flag is never NULL (traffic without ports)
    end = lambda ip, port: F.struct(F.col(ip).alias("ip"), F.col(port).alias("port"))
    src_first = end("src", "sport") <= end("dst", "dport")
    return packets.withColumns({
        "a_ip": F.when(src_first, F.col("src")).otherwise(F.col("dst")),
        "a_port": F.when(src_first, F.col("sport")).otherwise(F.col("dport")),
        "b_ip": F.when(src_first, F.col("dst")).otherwise(F.col("src")),
        "b_port": F.when(src_first, F.col("dport")).otherwise(F.col("sport")),
        "a_side": src_first,
    })


def _key_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on flow keys that may be NULL; the key columns come from ``left``."""
    r = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    out = left.join(r, on=[F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys], how=how)
    return out.drop(*[f"_r_{k}" for k in keys])


def sessionize(packets: DataFrame, keys: Sequence[str], idle_seconds: float,
               order: Sequence[str] = PACKET_ORDER, ts_col: str = "ts",
               out: str = "session", num_buckets: int | None = None,
               keep_bucket: bool = False) -> DataFrame:
    """idle timeout.  A gap strictly greater than ``idle_seconds`` starts a
    new flow; ``out`` is the 0-based flow number inside ``keys``.  One
    skew-safe scan: the first packet of each piece is fixed up with the last
    packet time of the key's previous piece."""
    return keyed_scan(packets, list(keys), list(order), pos_col=None,
                      gap_session=(out, ts_col, idle_seconds), num_buckets=num_buckets,
                      keep_bucket=keep_bucket)


def with_ipt(packets: DataFrame, keys: Sequence[str], order: Sequence[str] = PACKET_ORDER,
             ts_col: str = "ts", out: str = "ipt", num_buckets: int | None = None,
             keep_bucket: bool = False) -> DataFrame:
    """seconds since the previous packet with the same ``keys``; NULL for
    the first one (Q19)."""
    lagged = keyed_scan(packets, list(keys), list(order), pos_col=None,
                        lags={"_prev_ts": ts_col}, num_buckets=num_buckets, keep_bucket=keep_bucket)
    z = _ntz(packets, ts_col)
    ipt = (_micros(F.col(ts_col), z) - _micros(F.col("_prev_ts"), z)) / F.lit(1_000_000.0)
    return lagged.withColumn(out, ipt).drop("_prev_ts")


def bidirectional_flows(packets: DataFrame, idle_seconds: float, active_seconds: float | None = None,
                        num_buckets: int | None = None, scan_again: bool = False, cols: Sequence[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Packets with their bidirectional flow and ``ipt``, the seconds since the
    flow's previous packet in the same direction, and the names of the flow key.

    One scan per 5-tuple gives the session, its start and the previous packet of
    either direction; a previous packet before the flow's start is none of its.
    ``_p`` is the packet's number inside its 5-tuple; ``cols`` are the other
    packet columns wanted behind key, side and order (all if not given).
    ``scan_again`` prepares for another scan on the flow key: it keeps the bucket
    or, behind an active timeout, writes the flows."""
    keyed = with_canonical_key(packets)
    if cols is not None:
        keyed = keyed.select(*FIVE_TUPLE, "a_side", *PACKET_ORDER, *cols)
    keyed = keyed.withColumns({"_ta": F.when(F.col("a_side"), F.col("ts")), "_tb": F.when(~F.col("a_side"), F.col("ts"))})
    lasts = {"_pa": "_ta", "_pb": "_tb"}
    if active_seconds is None:
        fkey = FIVE_TUPLE + ["session"]
        flows = keyed_scan(keyed, FIVE_TUPLE, PACKET_ORDER, pos_col="_p", gap_session=("session", "ts", idle_seconds),
                           session_start="_fstart", lasts=lasts, num_buckets=num_buckets, keep_bucket=scan_again)
    else:
        fkey = FIVE_TUPLE + ["session", "subflow"]
        flows = active_timeout(keyed, FIVE_TUPLE, idle_seconds, active_seconds, num_buckets=num_buckets, lasts=lasts, flow_start="_fstart", pos_col="_p")
        flows = staged(flows, "flows") if scan_again else flows
    z = _ntz(packets)
    before = F.when(F.col("a_side"), F.col("_pa")).otherwise(F.col("_pb"))
    ipt = F.when(before >= F.col("_fstart"), (_micros(F.col("ts"), z) - _micros(before, z)) / F.lit(1_000_000.0))
    return flows.withColumn("ipt", ipt).drop("_ta", "_tb", "_pa", "_pb", "_fstart"), fkey


def caia_vector(packets: DataFrame, idle_seconds: float = 300, num_buckets: int | None = None,
                flow_sampling: tuple | None = None, active_seconds: float | None = 1800) -> DataFrame:
    """bidirectional 5-tuple flows cut by the idle and the active timeout
    (``active_seconds=None``: by the idle timeout only) -> 34 columns.

    Forward is the orientation of the flow's first packet.  Per direction:
    packet, octet, SYN, ACK, FIN, CWR counts (0 when the direction is absent)
    and min / mean / max / stdev (N-1, one value -> 0, absent -> NULL) of the
    IP total length and of the inter-packet time.

    ``flow_sampling = (mode, n)`` samples each direction of each flow by
    packet position (modes 1-4, C6) after the flows and inter-packet times
    are built from all packets; counts and statistics then use the kept
    packets, the flow start and addresses the whole flow.
    """
    ipt, fkey = bidirectional_flows(packets, idle_seconds, active_seconds, num_buckets, flow_sampling is not None, ["octets", "ip_len", "flags"])
    keep = F.lit(True)
    if flow_sampling is not None:
        from .sampling import FLOW_MODES, keep_predicate
        mode, n = flow_sampling
        mode = FLOW_MODES.get(mode, mode) if isinstance(mode, int) else mode
        ipt = keyed_scan(ipt, fkey + ["a_side"], PACKET_ORDER, pos_col="_dpos", num_buckets=num_buckets)
        keep = keep_predicate(F.col("_dpos"), mode, n)
    f = F.col("flags")
    # the first packet's number and side as one long, its addresses from the key: structs and texts
    # in the buffer would make it a sort aggregate over all packets
    aggs = [F.min(F.col("_p") * 2 + F.when(F.col("a_side"), 0).otherwise(1)).alias("_first"), F.min("ts").alias("_t0")]
    for side, cond in (("a", F.col("a_side") & keep), ("b", ~F.col("a_side") & keep)):
        def on(x, cond=cond):
            return F.when(cond, x)
        aggs += [
            F.count(on(F.lit(1))).alias(f"{side}_packetTotalCount"),
            F.coalesce(F.sum(on(F.col("octets"))), F.lit(0)).cast("long").alias(f"{side}_octetTotalCount"),
            F.count(on(F.when(f.contains("S"), 1))).alias(f"{side}_tcpSynTotalCount"),
            F.count(on(F.when(f.contains("A"), 1))).alias(f"{side}_tcpAckTotalCount"),
            F.count(on(F.when(f.contains("F"), 1))).alias(f"{side}_tcpFinTotalCount"),
            F.count(on(F.when(f.contains("C"), 1))).alias(f"{side}__tcpCwrTotalCount"),
        ]
        for stat, col in (("ipTotalLength", F.col("ip_len").cast("double")), ("_interPacketTimeSeconds", F.col("ipt"))):
            v = on(col)
            aggs += [F.min(v).alias(f"{side}_min({stat})"), F.avg(v).alias(f"{side}_mean({stat})"),
                     F.max(v).alias(f"{side}_max({stat})"), stdev0(v).alias(f"{side}_stdev({stat})")]
    flows = ipt.groupBy(*fkey).agg(*aggs)
    fwd_is_a = F.col("_first") % 2 == 0
    out = {
        "flowStartMilliseconds": millis(F.col("_t0"), _ntz(packets)),
        "sourceIPAddress": F.when(fwd_is_a, F.col("a_ip")).otherwise(F.col("b_ip")),
        "destinationIPAddress": F.when(fwd_is_a, F.col("b_ip")).otherwise(F.col("a_ip")),
        "sourceTransportPort": F.when(fwd_is_a, F.col("a_port")).otherwise(F.col("b_port")),
        "destinationTransportPort": F.when(fwd_is_a, F.col("b_port")).otherwise(F.col("a_port")),
        "protocolIdentifier": F.col("proto"),
    }
    for name in CAIA_ORDER:
        if name in out:
            continue
        fn, rest = name.split("(", 1)
        attr, direction = rest[:-1].split(",")
        side_name = attr if fn == "count" else f"{fn}({attr})"
        a_col, b_col = F.col(f"`a_{side_name}`"), F.col(f"`b_{side_name}`")
        fwd = direction == "forward"
        out[name] = F.when(fwd_is_a, a_col if fwd else b_col).otherwise(b_col if fwd else a_col)
    return flows.select(*[out[c].alias(c) for c in CAIA_ORDER])


def agm_flow_id(packets: DataFrame, window_seconds: int, idle_seconds: float | None = None,
                active_seconds: float | None = None) -> DataFrame:
    """unidirectional flow = source address + tumbling time window.

    With ``idle_seconds`` (and ``active_seconds``) the timeouts also cut
    inside a window (the 3600 s spec: 300 s idle, 1800 s active); the flow
    key then gains ``session`` (and ``subflow``)."""
    win = F.floor(_micros(F.col("ts"), _ntz(packets)) / F.lit(window_seconds * 1_000_000)).cast("long")
    out = packets.withColumn("win", win)
    if idle_seconds is None:
        return out
    if active_seconds is None:
        return sessionize(out, ["src", "win"], idle_seconds)
    return active_timeout(out, ["src", "win"], idle_seconds, active_seconds)


def agm_flow_keys(flows: DataFrame) -> list[str]:
    return [c for c in ("src", "win", "session", "subflow") if c in flows.columns]


def agm_long_counts(packets: DataFrame, flow_cols: Sequence[str], keep: Column | None = None) -> DataFrame:
    """Level 1 of the AGM aggregate: (flow, attribute, value) -> count.

    The packet table is unpivoted to one row per (packet, attribute) and
    counted with a map-side partial aggregate; distinct, mode and modeCount
    of every attribute then come from this table in one more aggregate.
    """
    num = [F.struct(F.lit(a).alias("attr"), F.col(src).cast("long").alias("v"),
                    F.lit(None).cast("string").alias("s")) for a, src in AGM_ATTR_SOURCE.items()]
    txt = [F.struct(F.lit("destinationIPAddress").alias("attr"), F.lit(None).cast("long").alias("v"),
                    F.col("dst").alias("s")),
           F.struct(F.lit("_tcpFlags").alias("attr"), F.lit(None).cast("long").alias("v"),
                    flag_combo(F.col("flags")).alias("s"))]
    keep = F.lit(True) if keep is None else keep
    long = packets.select(*flow_cols, "ts", "packet_no", keep.alias("_keep"), F.explode(F.array(*num, *txt)).alias("x"))
    return (long.groupBy(*flow_cols, F.col("x.attr").alias("attr"), F.col("x.v").alias("v"),
                         F.col("x.s").alias("s"))
            .agg(F.count(F.when(F.col("_keep"), 1)).alias("c"), F.min("ts").alias("t0"),
                 F.min(F.when(F.col("_keep"), F.struct("ts", "packet_no"))).alias("first_seen")))


def agm_vector(packets: DataFrame, window_seconds: int = 10, idle_seconds: float | None = None,
               active_seconds: float | None = None, flow_sampling: tuple | None = None) -> DataFrame:
    """AGM vector (31 columns) per source address and time window.

    Numeric mode ties go to the smallest value; the flag letters follow the
    F17 tie rule.  ``flowStartMilliseconds`` is the first packet's time.
    """
    flows = agm_flow_id(packets, window_seconds, idle_seconds, active_seconds)
    fkeys = agm_flow_keys(flows)
    keep = None
    if flow_sampling is not None:
        # per-flow sampling of the accumulated packets (flow-sampled AGM):
        # the flow start stays the first packet of the whole flow
        from .sampling import FLOW_MODES, keep_predicate
        mode, n = flow_sampling
        mode = FLOW_MODES.get(mode, mode) if isinstance(mode, int) else mode
        flows = keyed_scan(flows, fkeys, PACKET_ORDER, pos_col="_fpos")
        keep = keep_predicate(F.col("_fpos"), mode, n)
    lvl1 = agm_long_counts(flows, fkeys, keep)
    # values seen only in dropped packets have c = 0: they count for the
    # flow start (t0) but not for distinct / mode / modeCount
    present = F.col("c") > 0
    attr = F.col("attr")
    aggs = [F.min("t0").alias("_t0"),
            F.sum(F.when(attr == "protocolIdentifier", F.col("c"))).cast("long").alias("packetTotalCount")]
    for a in AGM_NUMERIC:
        on = (attr == a) & present
        aggs += [
            F.count(F.when(on, 1)).alias(f"distinct({a})"),
            F.max_by(F.when(on, F.col("v")), F.when(on, F.struct(F.col("c"), -F.col("v")))).alias(f"mode({a})"),
            F.max(F.when(on, F.col("c"))).alias(f"modeCount({a})"),
        ]
    on = (attr == "destinationIPAddress") & present
    aggs += [F.count(F.when(on, 1)).alias("distinct(destinationIPAddress)"),
             F.max(F.when(on, F.col("c"))).alias("modeCount(destinationIPAddress)")]
    on = (attr == "_tcpFlags") & present
    aggs += [F.count(F.when(on, 1)).alias("distinct(_tcpFlags)"),
             F.max(F.when(on, F.col("c"))).alias("modeCount(_tcpFlags)"),
             F.collect_list(F.when(on, F.struct(F.col("c"), F.col("s").alias("combo")))).alias("_combos")]
    vec = lvl1.groupBy(*fkeys).agg(*aggs)
    letters = flag_mode_letters(F.col("_combos"), F.col("modeCount(_tcpFlags)"))
    out = {"flowStartMilliseconds": millis(F.col("_t0"), _ntz(packets)),
           "sourceIPAddress": F.col("src")}
    out.update(letters)
    return vec.select(*[(out[c] if c in out else F.col(f"`{c}`")).alias(c) for c in AGM_ORDER])


def agm_window_flows(packets: DataFrame, window_seconds: int) -> DataFrame:
    """F1 + F8/F9 minimum slice: packets and octets per source and window."""
    flows = agm_flow_id(packets, window_seconds)
    return (flows.groupBy("src", "win")
            .agg(millis(F.min("ts"), _ntz(packets)).alias("flowStartMilliseconds"),
                 F.count(F.lit(1)).alias("packetTotalCount"),
                 F.sum("octets").cast("long").alias("octetTotalCount")))


def accumulate(packets: DataFrame, keys: Sequence[str], cols: Sequence[str],
               order: Sequence[str] = PACKET_ORDER) -> DataFrame:
    """ordered list of attributes per flow (only when arrays are wanted)."""
    ordered = [F.col(o).alias(f"_o{i}") for i, o in enumerate(order)]
    aggs = [F.transform(F.array_sort(F.collect_list(F.struct(*ordered, F.col(c).alias("v")))),
                        lambda x: x["v"]).alias(f"accumulate({c})") for c in cols]
    return packets.groupBy(*keys).agg(*aggs)


def with_direction(packets: DataFrame, flow_keys: Sequence[str], out: str = "direction") -> DataFrame:
    """'f' when the packet has the orientation of its flow's first packet,
    else 'b'.  The first packet comes from a (partial) aggregate per flow and
    is joined back on the flow key."""
    firsts = packets.groupBy(*flow_keys).agg(
        F.min(F.struct("ts", "packet_no", "src", "sport")).alias("_f"))
    j = _key_join(packets, firsts, list(flow_keys), "inner")
    fwd = F.col("src").eqNullSafe(F.col("_f.src")) & F.col("sport").eqNullSafe(F.col("_f.sport"))
    return j.withColumn(out, F.when(fwd, F.lit("f")).otherwise(F.lit("b"))).drop("_f")


def flow_summary(sessions: DataFrame, flow_keys: Sequence[str]) -> DataFrame:
    """Packets, first and last packet time per flow."""
    return sessions.groupBy(*flow_keys).agg(
        F.count(F.lit(1)).alias("packets"),
        F.min("ts").alias("flow_start"),
        F.max("ts").alias("flow_end"))


def mode_text(packets: DataFrame, flow_keys: Sequence[str], col: str,
              order: Sequence[str] = PACKET_ORDER) -> DataFrame:
    """F16: most frequent text value per flow; a tie goes to the value seen first."""
    lvl1 = packets.groupBy(*flow_keys, col).agg(
        F.count(F.lit(1)).alias("c"),
        F.min(F.struct(*[F.col(o) for o in order])).alias("first_seen"))
    return lvl1.groupBy(*flow_keys).agg(
        F.min_by(F.col(col), F.struct(-F.col("c"), F.col("first_seen"))).alias(f"mode({col})"),
        F.max("c").alias(f"modeCount({col})"),
        F.count(F.lit(1)).alias(f"distinct({col})"))


def mode_numeric(packets: DataFrame, flow_keys: Sequence[str], col: str) -> DataFrame:
    """numeric mode (tie -> smallest), modeCount and distinct per flow,
    from one two-level partial aggregate."""
    lvl1 = packets.groupBy(*flow_keys, col).agg(F.count(F.lit(1)).alias("c"))
    return lvl1.groupBy(*flow_keys).agg(
        F.max_by(F.col(col), F.struct(F.col("c"), -F.col(col))).alias(f"mode({col})"),
        F.max("c").alias(f"modeCount({col})"),
        F.count(F.lit(1)).alias(f"distinct({col})"))


def flag_summary(packets: DataFrame, flow_keys: Sequence[str], flags_col: str = "flags") -> DataFrame:
    """per flow the flag combination modeCount / distinct and the one-hot
    letters chosen by the tie rule."""
    combo = flag_combo(F.col(flags_col))
    lvl1 = packets.groupBy(*flow_keys, combo.alias("combo")).agg(F.count(F.lit(1)).alias("c"))
    lvl2 = lvl1.groupBy(*flow_keys).agg(
        F.max("c").alias("modeCount(_tcpFlags)"),
        F.count(F.lit(1)).alias("distinct(_tcpFlags)"),
        F.collect_list(F.struct("c", "combo")).alias("_combos"))
    letters = flag_mode_letters(F.col("_combos"), F.col("modeCount(_tcpFlags)"))
    return lvl2.select(*flow_keys, *[v.alias(k) for k, v in letters.items()],
                       "distinct(_tcpFlags)", "modeCount(_tcpFlags)")


def flow_ids(keys: Sequence[str]) -> dict[str, Column]:
    """Two hashes that stand for a session in the pointer tables (16 bytes; NULL keys included)."""
    cols = [F.col(f"`{k}`") for k in keys]
    return {"_h1": F.xxhash64(*cols), "_h2": F.xxhash64(F.lit(1), *cols)}


def cut_chain(nodes: DataFrame, active_us: int, idle_us: int, on_round=None) -> DataFrame:
    """The packets (``_p``, ``_rel``) of each session at which the active timeout
    cuts, its first packet included; sessions without a cut have no rows.

    ``nodes``, a staged table: ``_h1, _h2`` (the session), ``_p`` (a packet's
    number), ``_rel`` (microseconds since the session's first packet) and ``_at,
    _at_rel``, the same of the first packet more than ``active_us`` later.
    The cuts are the chain first -> next(first) -> ...; it is found by contraction:

    * Time is cut into blocks, ``active`` long at level 0 and twice as long at
      each further level.  A packet's pointer leads to the first element of its
      chain behind its block; at level 0 that is the next one, for a chain steps
      further than ``active``.
    * Level k + 1 joins two blocks.  A pointer from the left one into the right
      one is followed once more, any other stays.  Packets of a session are at
      most ``idle`` apart, so a chain enters a block within its first
      ``active + idle``; only packets there keep a pointer, so the rounds halve
      once blocks are longer than that, and a session leaves with its last block.
    * Downwards, the element that enters a block enters its left half (and its
      pointer may enter the right half) or its right half.  A block of level 0
      holds one element at most: all cuts are known.

    ``on_round`` is called with the number of pointers of each level (tests)."""
    sk = ["_h1", "_h2"]
    zone = active_us + idle_us
    now = nodes
    entries = nodes.where("_rel = 0").groupBy(*sk).agg(F.min("_p").alias("_p")).withColumn("_rel", F.lit(0).cast("long"))
    levels, size = [], active_us
    while True:
        n = now.count()  # of a written table
        if on_round is not None:
            on_round(n)
        levels.append((now, f"(_rel div {size}) % 2 = 0 and _at_rel div {size} = _rel div {size} + 1"))
        if n == 0:
            break
        into_right = levels[-1][1]
        size *= 2
        kept = now.where(f"_rel % {size} < {zone}")
        further = now.select(*sk, F.col("_p").alias("_at"), F.col("_at").alias("_far"), F.col("_at_rel").alias("_far_rel"))
        followed = kept.where(into_right).join(further, sk + ["_at"]) \
                       .select(*sk, "_p", "_rel", F.col("_far").alias("_at"), F.col("_far_rel").alias("_at_rel"))
        now = staged(kept.where(f"not ({into_right})").unionByName(followed), "active-level")
    for level, into_right in reversed(levels[:-1]):
        right = F.when(F.expr(into_right), F.struct(F.col("_at").alias("_p"), F.col("_at_rel").alias("_rel")))
        entries = entries.join(level.drop("_rel"), sk + ["_p"], "left").select(
            *sk, F.inline(F.array_compact(F.array(F.struct("_p", "_rel"), right))))
    cuts = staged(entries, "active-cuts")
    drop_staged(*(level for level, _ in levels))
    return cuts


def active_timeout(packets: DataFrame, keys: Sequence[str], idle_seconds: float, active_seconds: float,
                   order: Sequence[str] = PACKET_ORDER, ts_col: str = "ts",
                   num_buckets: int | None = None, lasts: dict[str, str] | None = None,
                   flow_start: str | None = None, pos_col: str | None = None, on_round=None) -> DataFrame:
    """idle sessions cut again by the active timeout.

    Inside an idle session a new flow starts at the first packet whose time
    exceeds the current flow's start by more than ``active_seconds``.  The next
    packet after t + active comes from one skew-safe scan over packets and probe
    rows; the chain of cuts from a session's first packet is found by
    :func:`cut_chain`.  Only a session's first packet and those more than
    ``active_seconds`` behind it can be cuts and take part, and the rounds carry
    16-byte hashes of the key, never packets.  A flow is at most
    ``active_seconds`` long, so each slot of that length holds one cut at most and
    meets two flows at most: a packet finds its flow by its session and slot.
    Adds ``session`` and ``subflow`` (0-based inside the session); ``lasts`` as in
    ``keyed_scan`` within ``keys``, ``flow_start`` names a column for the flow's
    first time, ``pos_col`` one for the packet's number within ``keys``.
    """
    if active_seconds <= 0:
        raise ValueError("the active timeout must be positive")
    keys, order = list(keys), list(order)
    sk = ["_h1", "_h2"]
    active_us, idle_us = int(active_seconds * 1_000_000), int(idle_seconds * 1_000_000)
    z = _ntz(packets, ts_col)
    # the session table feeds several branches: written once
    scanned = keyed_scan(packets, keys, order, pos_col="_p", gap_session=("session", ts_col, idle_seconds),
                         session_start="_begin", lasts=lasts, num_buckets=num_buckets, write="active-sessions")
    rel = _micros(F.col(ts_col), z) - _micros(F.col("_begin"), z)
    sess = scanned.withColumns({**flow_ids([*keys, "session"]), "_rel": rel})

    slim = sess.select(*sk, "_p", "_rel")
    slim = staged(slim.where(f"_rel = 0 or _rel > {active_us}"), "active-times")
    # latest first: the packet passed last before a probe is the first one behind its time;
    # at one time probes come before packets
    seen = F.struct(F.col("_p").alias("_at"), F.col("_rel").alias("_at_rel"))
    probes = slim.select(*sk, (-F.col("_rel") - active_us).alias("_t"), (-F.col("_p") - _PROBE).alias("_n"), F.lit(None).cast("struct<_at:bigint,_at_rel:bigint>").alias("_seen"))
    both = slim.where(f"_rel > {active_us}").select(*sk, (-F.col("_rel")).alias("_t"), (-F.col("_p")).alias("_n"), seen.alias("_seen")).unionByName(probes)
    found = keyed_scan(both, sk, ["_t", "_n"], pos_col=None, lasts={"_next": "_seen"}, num_buckets=num_buckets, write="active-probes")
    nodes = staged(found.where("_seen is null and _next is not null")
                   .select(*sk, (-F.col("_n") - _PROBE).alias("_p"), (-F.col("_t") - active_us).alias("_rel"), "_next.*"), "active-next")
    cuts = cut_chain(nodes, active_us, idle_us, on_round)

    # a slot's cut with the flow before it, or the flow that reaches into a slot without one
    numbered = keyed_scan(cuts, sk, ["_p"], pos_col="_n", lags={"_before": "_rel"}, leads={"_after": "_rel"}, num_buckets=num_buckets)
    slot = F.expr(f"_rel div {active_us}")
    own = F.struct(slot.alias("_slot"), F.col("_p").alias("_cut"), F.col("_n").alias("_sub"), F.col("_rel").alias("_cut_rel"), F.col("_before").alias("_old_rel"))
    none = F.lit(None).cast("long")
    reach = F.struct((slot + 1).alias("_slot"), none.alias("_cut"), (F.col("_n") + 1).alias("_sub"), none.alias("_cut_rel"), F.col("_rel").alias("_old_rel"))
    alone = F.coalesce(F.expr(f"_after div {active_us}") > slot + 1, F.lit(True))
    slots = staged(numbered.select(*sk, F.inline(F.array_compact(F.array(own, F.when(alone, reach))))), "active-slots")
    flows = sess.withColumn("_slot", slot).join(slots, [*sk, "_slot"], "left")
    new = F.col("_p") >= F.col("_cut")
    flows = flows.withColumn("subflow", F.coalesce(F.when(new, F.col("_sub")).otherwise(F.col("_sub") - 1), F.lit(0).cast("long")))
    if flow_start:
        start_rel = F.coalesce(F.when(new, F.col("_cut_rel")).otherwise(F.col("_old_rel")), F.lit(0).cast("long"))
        flows = flows.withColumn("_start_rel", start_rel).withColumn(
            flow_start, F.expr("_begin + make_dt_interval(0, 0, 0, cast(cast(_start_rel as decimal(18,0)) / 1000000 as decimal(18,6)))"))
    if pos_col:
        flows = flows.withColumn(pos_col, F.col("_p"))
    made = ["session", *(lasts or {}), "subflow", *([flow_start] if flow_start else []), *([pos_col] if pos_col else [])]
    return flows.select(*[c for c in packets.columns if c not in made], *made)
