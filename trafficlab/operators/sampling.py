"""Packet sampling (modes 5-8) and per-flow sampling (modes 1-4).

Every sampler is a predicate on a packet's 0-based position ``pos`` — in the
whole capture (packet sampling) or inside its flow (flow sampling) — so the
result does not depend on how packets are split into files or partitions.
Positions come from :func:`trafficlab.operators.position.keyed_scan`, which
splits hot flows over many tasks.  Random samplers rank by
``md5('<seed>:<pos>')``: reproducible in any engine and for any layout.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .position import keyed_position

# Sampling mode numbers and names as the reference numbers them.
FLOW_MODES = {1: "every_nth", 2: "take_skip", 3: "first_n", 4: "decaying"}
PACKET_MODES = {5: "every_nth", 6: "n_of_N", 7: "srs_per_block", 8: "time_based"}
DEFAULT_SEED = 1000
DEFAULT_SPLIT = 5000
PACKET_ORDER = ("ts", "packet_no")


def decaying_bursts(n: int) -> list[tuple[int, int]]:
    """Kept position ranges [lo, hi) of mode 4: take n, skip n-1, take n-2, ..."""
    out = []
    r = 0
    while n - 2 * r > 0:
        lo = r * (2 * n + 1 - 2 * r)
        out.append((lo, lo + n - 2 * r))
        r += 1
    return out


def keep_predicate(pos: Column, mode, n: int) -> Column:
    """Boolean column: keep the packet at 0-based position ``pos``.

    ``mode`` may also be a user rule (U1): a callable ``(pos, n) -> Column``."""
    if callable(mode):
        return mode(pos, n)
    if n == 0:
        return F.lit(True)
    if mode == "every_nth":
        return F.pmod(pos, F.lit(n)) == 0
    if mode == "take_skip":
        return F.pmod(F.floor(pos / F.lit(n)), F.lit(2)) == 0
    if mode == "first_n":
        return pos < n
    if mode == "decaying":
        cond = F.lit(False)
        for lo, hi in decaying_bursts(n):
            cond = cond | pos.between(lo, hi - 1)
        return cond
    raise ValueError(f"unknown flow sampling mode {mode!r}")


def _mode_name(mode, table) -> str:
    return table[mode] if isinstance(mode, int) else mode


def sample_flow(packets: DataFrame, key: Sequence[str] | str, mode, n: int,
                order: Sequence[str] = PACKET_ORDER, pos_col: str = "pos",
                num_partitions: int | None = None) -> DataFrame:
    """Per-flow sampling (modes 1-4); ``key`` may include the direction.

    ``n == 0`` returns the input unchanged (C5).  ``first_n`` uses
    ``row_number() <= n``: Spark plans a partial ``WindowGroupLimit`` before
    the shuffle, so a hot flow ships at most n rows per map task.
    """
    mode = mode if callable(mode) else _mode_name(mode, FLOW_MODES)
    if n == 0 and not callable(mode):
        return packets
    keys = [key] if isinstance(key, str) else list(key)
    if mode == "first_n":
        w = Window.partitionBy(*keys).orderBy(*order)
        # filter on the rank itself so Catalyst infers the group limit
        return (packets.withColumn("_rn", F.row_number().over(w))
                .where(F.col("_rn") <= n)
                .withColumn(pos_col, (F.col("_rn") - 1).cast("long")).drop("_rn"))
    positioned = keyed_position(packets, keys, list(order), pos_col, num_partitions)
    return positioned.where(keep_predicate(F.col(pos_col), mode, n))


def with_position(packets: DataFrame, order: Sequence[str] = PACKET_ORDER,
                  pos_col: str = "pos", num_partitions: int | None = None) -> DataFrame:
    """0-based position of every packet in the whole capture."""
    return keyed_position(packets, None, list(order), pos_col, num_partitions)


def _hash_rank_key(seed: int, pos: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), pos.cast("string")))


def sample_packets(packets: DataFrame, mode, n: int, seed: int = DEFAULT_SEED,
                   split: int = DEFAULT_SPLIT, order: Sequence[str] = PACKET_ORDER,
                   pos_col: str = "pos", slot_seconds: int | None = None,
                   num_partitions: int | None = None) -> DataFrame:
    """Packet sampling over the whole capture (modes 5-8).

    * ``every_nth`` (5): positions 0, n, 2n, ...
    * ``n_of_N`` (6): in each block of N = n*n positions keep the n whose
      hash rank is lowest; the last block draws from all N slots as if it
      were full, so fewer than n may survive there.
    * ``srs_per_block`` (7): in each block of ``split`` packets keep the
      ceil(c/n) packets of lowest hash rank (c = packets in the block).
    * ``time_based`` (8): the first packet of every ``slot_seconds`` slot
      (default n seconds).
    """
    mode = _mode_name(mode, PACKET_MODES)
    if n == 0:
        return packets
    if mode == "time_based":
        return first_per_slot(packets, slot_seconds or n, order)
    pos = F.col(pos_col)
    positioned = with_position(packets, order, pos_col, num_partitions)
    if mode == "every_nth":
        return positioned.where(F.pmod(pos, F.lit(n)) == 0)
    if mode == "n_of_N":
        # complete blocks rank their packets; the tail block, which lacks slots, keeps the packets up to
        # the n-th lowest rank of all its slots, found once (on the block's first row)
        big_n = n * n
        place = lambda p: F.struct(_hash_rank_key(seed, p).alias("h"), p.alias("p"))
        block = Window.partitionBy("_blk")
        slots = F.sequence(F.col("_blk") * big_n, F.col("_blk") * big_n + big_n - 1)
        lowest = F.get(F.array_sort(F.transform(slots, place)), F.lit(n - 1))
        ranked = positioned.withColumns({"_blk": F.floor(pos / big_n), "_place": place(pos)}).withColumns({
            "_r": F.row_number().over(block.orderBy("_place")), "_c": F.count(F.lit(1)).over(block)})
        last = F.max(F.when((F.col("_r") == 1) & (F.col("_c") < big_n), lowest)).over(block)
        kept = F.when(F.col("_c") == big_n, F.col("_r") <= n).otherwise(F.col("_place") <= F.col("_last"))
        return ranked.withColumn("_last", last).where(kept).drop("_blk", "_place", "_r", "_c", "_last")
    if mode == "srs_per_block":
        blk = F.floor(pos / split)
        w = Window.partitionBy("_blk").orderBy(_hash_rank_key(seed, pos), pos)
        return (positioned.withColumn("_blk", blk)
                .withColumn("_r", F.row_number().over(w))
                .withColumn("_c", F.count(F.lit(1)).over(Window.partitionBy("_blk")))
                .where(F.col("_r") <= F.ceil(F.col("_c") / F.lit(n)))
                .drop("_blk", "_r", "_c"))
    raise ValueError(f"unknown packet sampling mode {mode!r}")


def first_per_slot(packets: DataFrame, seconds: int, order: Sequence[str] = PACKET_ORDER,
                   ts_col: str = "ts") -> DataFrame:
    """Mode 8: the first packet of each time slot, by a partial aggregate.

    ``min(struct(order..., row))`` is combined map-side, so a slot that holds
    a third of the capture still ships one row per map task.
    """
    from ..functions.timecols import col_micros
    slot = F.floor(col_micros(packets, ts_col) / F.lit(seconds * 1_000_000))
    cols = packets.columns
    best = (packets.groupBy(slot.alias("slot"))
            .agg(F.min(F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
                                F.struct(*cols).alias("_row"))).alias("_m")))
    return best.select("slot", *[F.col(f"_m._row.{c}").alias(c) for c in cols])


def dropped_packets(packets: DataFrame, sampled: DataFrame, key: str = "packet_no") -> DataFrame:
    """Packets that the sampler did not keep (anti join on the packet id)."""
    return packets.join(sampled.select(key), on=key, how="left_anti")


def expected_sample_count(total: int, mode, n: int, split: int = DEFAULT_SPLIT) -> int:
    """C12 formula: mode 5 ceil(N/n); mode 7 sum of ceil(block/n)."""
    mode = _mode_name(mode, PACKET_MODES)
    if n == 0:
        return total
    if mode == "every_nth":
        return math.ceil(total / n)
    if mode == "srs_per_block":
        full, rest = divmod(total, split)
        return full * math.ceil(split / n) + (math.ceil(rest / n) if rest else 0)
    raise ValueError(mode)


def verify_sample(packets: DataFrame, sampled: DataFrame, mode, n: int,
                  split: int = DEFAULT_SPLIT) -> DataFrame:
    """C12 as a DataFrame: expected vs actual count, computed from the data."""
    mode = _mode_name(mode, PACKET_MODES)
    counts = (packets.select(F.lit(1).alias("_t"), F.lit(0).alias("_a"))
              .unionByName(sampled.select(F.lit(0).alias("_t"), F.lit(1).alias("_a")))
              .agg(F.sum("_t").cast("long").alias("total"), F.sum("_a").cast("long").alias("actual")))
    if mode == "every_nth":
        expected = F.ceil(F.col("total") / F.lit(n))
    elif mode == "srs_per_block":
        full = F.floor(F.col("total") / split)
        rest = F.col("total") - full * split
        expected = full * F.lit(math.ceil(split / n)) + F.ceil(rest / F.lit(n))
    else:
        raise ValueError(mode)
    return counts.select(F.lit(mode).alias("mode"), F.col("total"),
                         expected.cast("long").alias("expected"), F.col("actual"))


def sample_counts(sampled: DataFrame, flow_keys: Sequence[str], direction_col: str = "direction") -> DataFrame:
    """Sampled packets per flow and direction (forward 'f' / backward 'b')."""
    d = F.col(direction_col)
    return sampled.groupBy(*flow_keys).agg(
        F.count(F.when(d == "f", 1)).alias("n_forward"),
        F.count(F.when(d == "b", 1)).alias("n_backward"))


def sample_totals(sampled: DataFrame, direction_col: str = "direction") -> DataFrame:
    """Sampled packets per direction plus the grand total (rollup row)."""
    return sampled.rollup(direction_col).agg(F.count(F.lit(1)).alias("packets"))


def preview(sampled: DataFrame, k: int = 20, order: Sequence[str] = PACKET_ORDER) -> DataFrame:
    """C14: the first k rows in packet order (TakeOrderedAndProject)."""
    return sampled.orderBy(*order).limit(k)


def packet_counts(packets: DataFrame, by: Sequence[str]) -> DataFrame:
    """Packet count per capture / block."""
    return packets.groupBy(*by).agg(F.count(F.lit(1)).alias("packets"))


def with_chunk_id(df: DataFrame, order: Sequence[str], chunk_rows: int = 100_000,
                  out: str = "chunk", num_partitions: int | None = None) -> DataFrame:
    """A3: chunk number = floor(row position / chunk_rows) in ``order``."""
    pos = keyed_position(df, None, list(order), "_chunk_pos", num_partitions)
    return pos.withColumn(out, F.floor(F.col("_chunk_pos") / chunk_rows).cast("long")).drop("_chunk_pos")


def truncate_payload(df: DataFrame, col: str, keep: int = 127) -> DataFrame:
    """Keep the first ``keep`` characters of the payload column."""
    return df.withColumn("orig_len", F.length(col).cast("long")).withColumn(col, F.substring(col, 1, keep))


def union_captures(parts: Sequence[DataFrame]) -> DataFrame:
    """Concatenate captures, aligning columns by name."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
