"""Structured Streaming versions of the flow and sampling operators.

Packets arrive as files (``readStream`` + ``maxFilesPerTrigger``); flows are
windowed / session-windowed aggregates with a watermark; duplicates are
dropped within the watermark; labeling is a stream-static join; scoring is a
stateless transform.

The timeout cutter and the event-time samplers are processors of
:mod:`.stateful` on ``transformWithState``: packets wait in the key's map state
until the watermark has passed their slot and are then taken in event-time
order, so the result does not depend on the order of arrival within the
watermark delay.  A sampler without a watermark keeps one counter per key, in
one table per bucket of keys (``applyInPandasWithState``).

Aggregates run in ``update`` mode: every micro-batch appends its changed
rows, tagged with the batch id, through ``foreachBatch``; state older than
the watermark is evicted, so state stays bounded.  ``latest_rows`` turns the
update log into the final table (last version of each key) with a partial
aggregate.  Event time must be ``TIMESTAMP`` (``withWatermark`` rejects
``TIMESTAMP_NTZ``), so packet times are cast on the way in.
"""

from __future__ import annotations

import hashlib
import heapq
import time
from functools import lru_cache
from typing import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.timecols import col_micros, micros
from ..operators.cutters import Cutter
from ..operators.labels import label_flows
from ..session import scratch_path
from .stateful import (BUCKET, FlowCutter, Sampler, UserCutter, bucket_of, count_on, key_codes, pack, slot_micros, unpack,
                       use_rocksdb)


# ---------------------------------------------------------------- sources
def stage_files(df: DataFrame, path: str, slice_col: str, slices: int, arrival: Sequence[int] | None = None) -> str:
    """Write ``df`` as ``slices`` files in time order, or in the order
    ``arrival`` of the slices (one append each), so a file source sees them
    arrive one after the other (T1 test input)."""
    us = col_micros(df, slice_col)
    lo_us, hi_us = df.agg(F.min(us), F.max(us)).first()
    if lo_us is None:
        return path
    hi_us += 1
    step = max(1, (hi_us - lo_us + slices - 1) // slices)
    for i in arrival or range(slices):
        part = df.where((us >= F.lit(lo_us + i * step)) & (us < F.lit(lo_us + (i + 1) * step)))
        # read, cut out and built by all tasks; one only writes the file
        part.repartition(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # distinct modification times keep the arrival order
    return path


def append_end_marker(df: DataFrame, path: str, after: str = "30 days", ts_col: str = "ts",
                      key_col: str = "src") -> str:
    """End-of-input marker for a bounded replay: one row, all columns NULL
    except an event time ``after`` the last packet.  It moves the watermark
    past every open window / session so append mode emits them; its own
    group (NULL key) is filtered from the output by the caller."""
    last = df.agg(F.max(ts_col).alias("_m"))
    marker = last.select(*[(F.col("_m") + F.expr(f"INTERVAL {after}")).cast(f.dataType).alias(f.name)
                           if f.name == ts_col else F.lit(None).cast(f.dataType).alias(f.name)
                           for f in df.schema.fields])
    marker.coalesce(1).write.mode("append").parquet(path)
    time.sleep(1.1)
    return path


def packet_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1,
                  ts_col: str = "ts") -> DataFrame:
    """Streaming packet source.  Event time must be a zoned TIMESTAMP for
    watermarks; an NTZ wall clock is mapped to the same epoch (as UTC), not
    through the session time zone."""
    s = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path))
    if isinstance(schema[ts_col].dataType, T.TimestampNTZType):
        return s.withColumn(ts_col, F.timestamp_micros(micros(F.col(ts_col), ntz=True)))
    return s


# ---------------------------------------------------------------- sinks
def run_update_log(stream: DataFrame, out_path: str, checkpoint: str) -> None:
    """Run to completion (availableNow), appending each batch's updated
    rows with its batch id to Parquet; restartable from ``checkpoint``."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("append").parquet(out_path)
    q = (stream.writeStream.outputMode("update").foreachBatch(write)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def run_split_late(stream: DataFrame, out_path: str, checkpoint: str, watermark: str, ts_col: str = "ts") -> int:
    """Every row of the stream, with ``late`` telling whether it came behind
    the watermark: earlier than the greatest event time of all previous batches
    less the delay.  That is the watermark Spark holds for the batch, so ``late``
    names the rows an aggregate may drop, which Spark itself only counts.

    A batch is one folder that a repeated batch overwrites; its greatest time is
    kept beside it, so a restart goes on with the same watermark.  Returns the
    number of late rows written by this run."""
    spark = stream.sparkSession
    delay_us = int(pd.Timedelta(watermark).total_seconds() * 1e6)
    late = 0

    def write(batch: DataFrame, batch_id: int) -> None:
        nonlocal late
        sp = batch.sparkSession
        marks = f"{out_path}-marks"
        before = None
        if batch_id > 0:
            seen = sp.read.schema("batch bigint, max_us bigint").parquet(marks).where(F.col("batch") < batch_id)
            before = seen.agg(F.max("max_us")).first()[0]
        us = F.unix_micros(ts_col)
        behind = F.lit(False) if before is None else F.coalesce(us < F.lit(before - delay_us), F.lit(False))
        folder = f"{out_path}/batch={batch_id}"
        batch.withColumn("late", behind).write.mode("overwrite").parquet(folder)
        told = sp.read.schema(batch.schema.add("late", "boolean")).parquet(folder).agg(F.max(us), F.count(F.when(F.col("late"), 1))).first()
        sp.createDataFrame([(batch_id, told[0])], "_b bigint, max_us bigint").select(F.col("_b").alias("batch"), "max_us") \
          .coalesce(1).write.mode("overwrite").parquet(f"{marks}/_b={batch_id}")
        late += told[1]

    q = (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return late


def dropped_rows(query) -> int:
    """Rows that the stateful operators of a streaming query dropped behind the watermark."""
    return sum(int(op["numRowsDroppedByWatermark"]) for p in query.recentProgress for op in p["stateOperators"])


def run_append(stream: DataFrame, out_path: str, checkpoint: str) -> dict:
    """Append-mode Parquet sink with checkpoint (exactly-once file sink)."""
    q = (stream.writeStream.outputMode("append").format("parquet").option("path", out_path)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q.lastProgress or {}


def latest_rows(spark: SparkSession, out_path: str, keys: Sequence[str]) -> DataFrame:
    """Final table from an update log: the row of the highest batch per key."""
    log = spark.read.parquet(out_path)
    vals = [c for c in log.columns if c not in keys and c != "_batch"]
    best = log.groupBy(*keys).agg(F.max_by(F.struct(*vals), F.col("_batch")).alias("_v"))
    return best.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in vals])


# ---------------------------------------------------------------- operators
def windowed_flows(packets: DataFrame, key: str, window: str, slide: str | None = None,
                   watermark: str = "1 day") -> DataFrame:
    """Packets, octets and first packet time per key and (tumbling or
    sliding) window, with a watermark."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return (packets.withWatermark("ts", watermark)
            .groupBy(key, w.alias("w"))
            .agg(F.count(F.lit(1)).alias("packets"), F.sum("octets").alias("octets"),
                 F.min("ts").alias("first_ts")))


def session_flows(packets: DataFrame, keys: Sequence[str], gap: str, watermark: str = "1 day") -> DataFrame:
    """T4: flows cut by the idle timeout (``session_window``)."""
    return (packets.withWatermark("ts", watermark)
            .groupBy(*keys, F.session_window("ts", gap).alias("s"))
            .agg(F.count(F.lit(1)).alias("packets"), F.sum("octets").alias("octets"),
                 F.min("ts").alias("first_ts")))


@lru_cache(maxsize=4096)
def _block_choice(n: int, seed: int, block: int) -> np.ndarray:
    """The n positions of lowest md5('seed:pos') in a block of n*n, by a heap of n entries.

    The choice depends on the block alone: a worker finds it once for all its keys and batches."""
    rank = lambda q: (hashlib.md5(f"{seed}:{q}".encode()).hexdigest(), q)
    return np.array(heapq.nsmallest(n, range(block * n * n, (block + 1) * n * n), key=rank), np.int64)


def _n_of_n_kept(n: int, seed: int):
    """Which positions are kept: in each block of N = n*n positions the n of
    lowest hash (the rule of the batch sampler, so a key's state is its position counter)."""
    def keep(pos: np.ndarray) -> np.ndarray:
        blocks = np.unique(pos // (n * n)).tolist()
        chosen = [_block_choice(n, seed, b) for b in blocks]
        return np.isin(pos, np.concatenate(chosen)) if chosen else np.zeros(0, bool)
    return keep


def _keep_rule(mode: str, n: int, seed: int) -> Callable[[np.ndarray], np.ndarray]:
    if mode == "every_nth":
        return lambda pos: pos % n == 0
    if mode == "first_n":
        return lambda pos: pos < n
    if mode == "n_of_N":
        return _n_of_n_kept(n, seed)
    raise ValueError(mode)


def sample_stream(packets: DataFrame, key: str, mode: str, n: int,
                  order: Sequence[str] = ("ts", "packet_no"), seed: int = 1000,
                  watermark: str | None = None, idle_seconds: float | None = None) -> DataFrame:
    """Per-key sampler with the packet counter carried in state
    across micro-batches: ``every_nth`` keeps positions 0, n, 2n ...,
    ``first_n`` the first n packets of the key, ``n_of_N`` n hash-ranked
    positions of every block of n*n.  (A single global counter
    would serialise the stream, so the carry is per key.)

    With a ``watermark`` packets are numbered in event-time order as the
    watermark passes them; without one, as a live sampler does, in order of
    arrival.  With ``idle_seconds`` (needs a watermark) a longer gap starts the
    count anew and a key idle for so long leaves the state; without it the
    counter of every key is kept for good, so keys must be bounded.
    """
    if idle_seconds is not None and watermark is None:
        raise ValueError("idle_seconds needs a watermark")
    out_schema = T.StructType(packets.schema.fields + [T.StructField("pos", T.LongType())])
    names = [f.name for f in out_schema.fields]
    keep = _keep_rule(mode, n, seed)
    idle_us = None if idle_seconds is None else int(idle_seconds * 1e6)
    src = packets.withColumns({"_us": F.unix_micros("ts"), BUCKET: bucket_of([key])})

    if watermark is None:
        def by_arrival(_, pdfs, state):
            kept = unpack(state.get[0]) if state.exists else None
            frames = [p for p in pdfs if len(p)]
            if frames:
                rows = pd.concat(frames, ignore_index=True)
                code, keys = key_codes(kept, rows, [key])
                rows = rows.assign(_code=code).sort_values(["_code", *order], kind="mergesort", ignore_index=True)
                # arrival counts, not time: a packet may come without one
                pos, table = count_on(np.zeros(len(rows), np.int64), rows["_code"].to_numpy(np.int64), keys, kept, None)
                state.update((pack(table),))
                yield rows.assign(pos=pos)[keep(pos)][names]
        return src.groupBy(BUCKET).applyInPandasWithState(by_arrival, out_schema, "counters binary", "append", "NoTimeout")

    use_rocksdb(packets.sparkSession)
    sampler = Sampler(src.columns, [key], slot_micros(watermark), order, names, keep, idle_us)
    return src.withWatermark("ts", watermark).groupBy(BUCKET).transformWithStateInPandas(sampler, out_schema, "Append", "EventTime")


def cut_stream(packets: DataFrame, keys: Sequence[str], cutter: Cutter, watermark: str, order: Sequence[str] = ("ts", "packet_no"),
               out: str = "flow", idle_seconds: float | None = None) -> DataFrame:
    """U4 on a stream: ``cut_flows`` in event time, as the watermark passes the packets.

    With ``idle_seconds`` a key idle for so long leaves the state and its flows
    are numbered from 0 again; without it the state of every key is kept."""
    use_rocksdb(packets.sparkSession)
    src = packets.withColumns({"_us": F.unix_micros("ts"), BUCKET: bucket_of(keys)})
    out_schema = T.StructType(packets.schema.fields + [T.StructField(out, T.LongType())])
    idle_us = None if idle_seconds is None else int(idle_seconds * 1e6)
    processor = UserCutter(src.columns, keys, slot_micros(watermark), order, cutter, out_schema.names, out, idle_us)
    return src.withWatermark("ts", watermark).groupBy(BUCKET).transformWithStateInPandas(processor, out_schema, "Append", "EventTime")


def time_slots(packets: DataFrame, key: str, seconds: int, watermark: str = "1 day") -> DataFrame:
    """One packet per (key, time slot), duplicates dropped within the watermark."""
    slot = F.floor(F.unix_micros("ts") / F.lit(seconds * 1_000_000)).cast("long")
    return (packets.withColumn("slot", slot).withWatermark("ts", watermark)
            .dropDuplicatesWithinWatermark([key, "slot"]))


def dedup_packets(packets: DataFrame, id_col: str = "packet_no", watermark: str = "1 day") -> DataFrame:
    """Drop repeated packets (same id) within the watermark."""
    return packets.withWatermark("ts", watermark).dropDuplicatesWithinWatermark([id_col])


def score_stream(model, stream: DataFrame) -> DataFrame:
    """Stateless model scoring on a stream, by a forest that every task can hold."""
    return model.transform(stream)


def run_scored(model, stream: DataFrame, out_path: str, checkpoint: str, columns: Sequence) -> None:
    """Run to completion (availableNow); each batch meets the forest's subtrees in a
    distributed join, so the forest may be of any size.  A batch is one folder
    (``batch=<id>``) that a repeated batch overwrites."""
    def write(batch: DataFrame, batch_id: int) -> None:
        model.transform(batch).select(*columns).write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")
    q = (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def label_stream(flows: DataFrame, schedule: DataFrame, mode: str, **names) -> DataFrame:
    """Labels of a stream of flows; the folded schedule is the static side (see ``label_flows``)."""
    return label_flows(flows, schedule, mode, **names)


def fresh_dir(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, name)


def timeout_flows(packets: DataFrame, keys: Sequence[str], idle_seconds: float, active_seconds: float,
                  watermark: str = "1 day") -> DataFrame:
    """T5: flows per key cut by the idle and the active timeout, with the
    open flow (start, last, packets, octets) kept in state.  A packet more
    than ``idle`` after the last one or more than ``active`` after the flow
    start closes the flow; an event-time timer closes it when the watermark
    leaves no packet that could continue it.  Packets are taken in event-time
    order as the watermark passes them, so packets out of order within the
    delay give the batch result.
    Output: keys, flowStartMilliseconds, packets, octets."""
    keys = list(keys)
    key_fields = [packets.schema[k] for k in keys]
    out_schema = T.StructType(key_fields + [T.StructField("flowStartMilliseconds", T.LongType()),
                                            T.StructField("packets", T.LongType()),
                                            T.StructField("octets", T.LongType())])
    idle_us, active_us = int(idle_seconds * 1e6), int(active_seconds * 1e6)
    names = [f.name for f in out_schema.fields]

    use_rocksdb(packets.sparkSession)
    src = packets.select(*keys, "ts", "packet_no", "octets", F.unix_micros("ts").alias("_us"), bucket_of(keys).alias(BUCKET)).withWatermark("ts", watermark)
    cutter = FlowCutter(src.columns, keys, slot_micros(watermark), idle_us, active_us, names)
    return src.groupBy(BUCKET).transformWithStateInPandas(cutter, out_schema, "Append", "EventTime")
