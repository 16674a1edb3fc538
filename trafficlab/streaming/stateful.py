"""Keyed processors with list-like and timed state (``transformWithState``).

Keys are dealt to ``BUCKETS`` buckets by hash (:func:`bucket_of`) and Spark keeps
state per bucket: a call works through all keys of a bucket at once with arrays,
so its cost is per bucket, not per key.  What is kept of each key (a counter, an
open flow) is one row of the bucket's table.

A packet waits in its bucket's map state until the watermark has passed its time
slot; then it is taken in event-time order.  A batch writes its new packets in
chunks of neighbouring slots, at most ``CHUNK_ROWS`` packets each; a chunk is read
when its first slot is due, and what is not due of it is written again.  So the
state written per batch grows with the new packets and one chunk per batch, not
with the packets that wait.  Slots are a sixteenth of the watermark's delay, so
results come at most that much later.

An event-time timer per bucket wakes it when its next slot is due or one of its
flows can no longer grow; a key without waiting packets, open flow or counter
leaves the state, and so does a bucket without keys.  Time-to-live, which exists
for processing time only, is not needed.

The state lives in RocksDB (``transformWithState`` needs it): on local disk with
change logs in the checkpoint, so keys need not fit into memory.  The packets of
one bucket that a watermark step makes due must fit into a task.  Keys with NULLs
have buckets of their own per NULL column, so whole-number keys stay exact.

A row without a packet number is an end-of-input marker: it moves the watermark.
"""

from __future__ import annotations

import io
import pickle
from typing import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.cutters import checked

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SLOTS_PER_DELAY = 16
BUCKETS = 512
CHUNK_ROWS = 4096
BUCKET = "_bucket"


def use_rocksdb(spark: SparkSession) -> None:
    """The state store these processors need, for streams started from now on."""
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def slot_micros(watermark: str) -> int:
    """Length of a slot for a watermark's delay (``1 day``, ``10 minutes``)."""
    return max(1, int(pd.Timedelta(watermark).total_seconds() * 1e6) // SLOTS_PER_DELAY)


def bucket_of(keys: Sequence[str]) -> Column:
    """The bucket of a key: its hash and which of its columns are NULL."""
    nulls = sum((F.col(k).isNull().cast("long") * F.lit(1 << i) for i, k in enumerate(keys)), F.lit(0))
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)) * F.lit(1 << len(keys)) + nulls


def pack(rows: pd.DataFrame) -> bytes:
    sink = io.BytesIO()
    data = pa.Table.from_pandas(rows, preserve_index=False)
    with pa.ipc.new_stream(sink, data.schema) as out:
        out.write_table(data)
    return sink.getvalue()


def unpack(packed: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(packed)).read_pandas()


def key_codes(kept: pd.DataFrame | None, rows: pd.DataFrame, keys: list[str]) -> tuple[np.ndarray, pd.DataFrame]:
    """Number of each row's key, and the keys in this order: those of ``kept`` (one row each) come first."""
    both = rows[keys] if kept is None else pd.concat([kept[keys], rows[keys]], ignore_index=True) if len(rows) else kept[keys]
    code = both.groupby(keys, dropna=False, sort=False).ngroup().to_numpy(np.int64)
    first = np.unique(code, return_index=True)[1]
    return code[0 if kept is None else len(kept):], both.iloc[first].reset_index(drop=True)


class InEventTime(StatefulProcessor):
    """Base: hands the packets of a bucket's keys to ``take`` as the watermark passes them.

    Packets carry ``_us``, their time in microseconds."""

    def __init__(self, columns: list[str], keys: Sequence[str], slot_us: int, order: Sequence[str], idle_us: int | None):
        self.columns, self.keys, self.slot_us, self.order, self.idle_us = columns, list(keys), slot_us, list(order), idle_us

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "first bigint, last bigint, part bigint", "rows binary")
        # up to where the bucket is worked off; number of the next part; first waiting slot; the timer set
        self.place = handle.getValueState("place", "done bigint, part bigint, first bigint, timer bigint")
        # one row per key with ``last``, the time of its last packet, and what the subclass keeps
        self.kept = handle.getValueState("kept", "rows binary")

    # -- what a subclass adds
    def take(self, rows: pd.DataFrame, code: np.ndarray, keys: pd.DataFrame, kept: pd.DataFrame | None) -> tuple[list[pd.DataFrame], pd.DataFrame]:
        """Results of packets (sorted by key number ``code``, then time) and the kept table after them, one row per key of ``keys``."""
        raise NotImplementedError

    def left(self, gone: pd.DataFrame) -> list[pd.DataFrame]:
        """Results of the kept rows of keys that can no longer grow."""
        return []

    # -- called by Spark
    def handleInputRows(self, key, rows, timerValues):
        frames = list(rows)
        done, part, first, timer = self._read()
        fresh = pd.concat(frames, ignore_index=True).set_axis(self.columns, axis=1)  # names with a leading _ do not arrive
        fresh = fresh[fresh[self.order[-1]].notna() & (fresh["_us"] > done)]
        if not len(fresh) and not self.place.exists():
            return
        slots = fresh["_us"].to_numpy(np.int64) // self.slot_us
        now = slots < self._edge(timerValues)
        later = fresh[~now].sort_values("_us", kind="mergesort")
        for i in range(0, len(later), CHUNK_ROWS):
            chunk = later.iloc[i:i + CHUNK_ROWS]
            slot = self._wait(chunk, part)
            part += 1
            first = slot if first is None else min(first, slot)
        yield from self._advance(timerValues, done, part, first, timer, [fresh[now]] if now.any() else [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        done, part, first, _ = self._read()
        yield from self._advance(timerValues, done, part, first, None, [])

    def close(self) -> None:
        pass

    # -- the work
    def _read(self):
        return tuple(self.place.get()) if self.place.exists() else (-1, 0, None, None)

    def _edge(self, timerValues) -> int:
        """Slots before it are complete."""
        return timerValues.getCurrentWatermarkInMs() * 1000 // self.slot_us

    def _wait(self, chunk: pd.DataFrame, part: int) -> int:
        """Write packets in time order; their first slot."""
        slot = int(chunk["_us"].iloc[0]) // self.slot_us
        self.waiting.updateValue((slot, int(chunk["_us"].iloc[-1]) // self.slot_us, part), (pack(chunk),))
        return slot

    def _ready(self, edge: int, first: int | None) -> tuple[list[pd.DataFrame], int | None]:
        """Waiting packets of the slots before ``edge``, and the first slot still waiting."""
        if first is None or first >= edge:
            return [], first
        ready, firsts = [], []
        for k in [tuple(k) for k in self.waiting.keys()]:
            if k[0] >= edge:
                firsts.append(k[0])
                continue
            chunk = unpack(self.waiting.getValue(k)[0])
            self.waiting.removeKey(k)
            if k[1] >= edge:
                n = int(np.searchsorted(chunk["_us"].to_numpy(np.int64), edge * self.slot_us))
                firsts.append(self._wait(chunk.iloc[n:], k[2]))
                chunk = chunk.iloc[:n]
            ready.append(chunk)
        return ready, min(firsts, default=None)

    def _advance(self, timerValues, done, part, first, timer, ready):
        edge = self._edge(timerValues)
        passed = max(done, edge * self.slot_us - 1)
        waited, first = self._ready(edge, first)
        ready = ready + waited
        kept = unpack(self.kept.get()[0]) if self.kept.exists() else None
        had, results = kept is not None, []
        if ready:
            rows = pd.concat(ready, ignore_index=True)
            code, keys = key_codes(kept, rows, self.keys)
            rows = rows.assign(_code=code).sort_values(["_code", "_us", *self.order], kind="mergesort", ignore_index=True)
            results, kept = self.take(rows, rows["_code"].to_numpy(np.int64), keys, kept)
        changed = bool(ready)
        if kept is not None and self.idle_us is not None:
            over = kept["last"].to_numpy(np.int64) + self.idle_us <= passed
            if over.any():
                results += self.left(kept[over])
                kept, changed = kept[~over], True
        yield from (r for r in results if len(r))
        if kept is not None and not len(kept):
            kept = None
        if changed and kept is not None:
            self.kept.update((pack(kept),))
        elif changed and had:
            self.kept.clear()
        ends = [] if first is None else [(first + 1) * self.slot_us]
        if kept is not None and self.idle_us is not None:
            ends.append(((int(kept["last"].min()) + self.idle_us) // self.slot_us + 1) * self.slot_us)
        if not ends and kept is None:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.place.clear()
            return
        wanted = -(-min(ends) // 1000) if ends else None
        if wanted != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if wanted is not None:
                self.handle.registerTimer(wanted)
        self.place.update((passed, part, first, wanted))


class Sampler(InEventTime):
    """Positions of a key's packets in event-time order, kept by ``keep(positions)``.

    With ``idle_us`` a longer gap starts the count anew and a key idle for so
    long leaves the state; without it the counter stays."""

    def __init__(self, columns: list[str], keys: Sequence[str], slot_us: int, order: Sequence[str], names: list[str],
                 keep: Callable[[np.ndarray], np.ndarray], idle_us: int | None):
        super().__init__(columns, keys, slot_us, order, idle_us)
        self.names, self.keep = names, keep

    def take(self, rows, code, keys, kept):
        pos, table = count_on(rows["_us"].to_numpy(np.int64), code, keys, kept, self.idle_us)
        return [rows.assign(pos=pos)[self.keep(pos)][self.names]], table


class FlowCutter(InEventTime):
    """T5: flows cut by the idle and the active timeout; the open one is kept as (start, last, packets, octets)."""

    def __init__(self, columns: list[str], keys: Sequence[str], slot_us: int, idle_us: int, active_us: int, names: list[str]):
        super().__init__(columns, keys, slot_us, ["packet_no"], idle_us)
        self.active_us, self.names = active_us, names

    def take(self, rows, code, keys, kept):
        us, octets = rows["_us"].to_numpy(np.int64), rows["octets"].fillna(0).to_numpy(np.int64)
        flow = [None] * len(keys)
        if kept is not None:
            flow[:len(kept)] = zip(*(kept[c].tolist() for c in ("start", "last", "packets", "octets")))
        at, closed = [], []
        for k, i, j in key_runs(code):
            ended, flow[k] = cut(us[i:j], octets[i:j], flow[k], self.idle_us, self.active_us)
            at += [k] * len(ended)
            closed += ended
        table = keys.assign(**{c: np.array(v, np.int64) for c, v in zip(("start", "last", "packets", "octets"), zip(*flow))})
        ended = pd.DataFrame(closed, columns=["start", "last", "packets", "octets"], dtype=np.int64)
        return self.left(pd.concat([keys.iloc[at].reset_index(drop=True), ended], axis=1)), table

    def left(self, gone):
        data = [*(gone[k] for k in self.keys), gone["start"] // 1000, gone["packets"], gone["octets"]]
        return [pd.concat(data, axis=1).set_axis(self.names, axis=1)] if len(gone) else []


class UserCutter(InEventTime):
    """U4: a user's cutter; its state is kept pickled.  With ``idle_us`` a key idle for so long leaves and begins anew."""

    def __init__(self, columns: list[str], keys: Sequence[str], slot_us: int, order: Sequence[str], cutter, names: list[str], out: str,
                 idle_us: int | None):
        super().__init__(columns, keys, slot_us, order, idle_us)
        self.cutter, self.names, self.out = cutter, names, out

    def take(self, rows, code, keys, kept):
        states, last = [None] * len(keys), np.zeros(len(keys), np.int64)
        known = 0 if kept is None else len(kept)
        if known:
            states[:known], last[:known] = kept["state"].tolist(), kept["last"]
        results = []
        packets = rows.drop(columns="_code").rename(columns={"_us": "us"})
        for k, i, j in key_runs(code):
            part = packets.iloc[i:j]
            flows, state = self.cutter.cut(pickle.loads(states[k]) if k < known else self.cutter.begin(), part)
            states[k], last[k] = pickle.dumps(state), part["us"].iloc[-1]
            results.append(part.assign(**{self.out: checked(flows, part)})[self.names])
        return results, keys.assign(state=states, last=last)


def key_runs(code: np.ndarray):
    """(key number, from, to) of the runs of one key in rows sorted by key number."""
    at = np.flatnonzero(np.diff(code, prepend=-1))
    return zip(code[at].tolist(), at.tolist(), [*at[1:].tolist(), len(code)])


def count_on(us: np.ndarray, code: np.ndarray, keys: pd.DataFrame, kept: pd.DataFrame | None, idle_us: int | None):
    """Position of each packet in its key (sorted by key number, then time) and the
    counters after them: ``seen`` packets, the last at ``last``.  A packet more
    than ``idle_us`` after the one before it in its key has position 0."""
    seen, last = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    known = 0 if kept is None else len(kept)
    if known:
        seen[:known], last[:known] = kept["seen"], kept["last"]
    at = np.arange(len(us), dtype=np.int64)
    head = np.diff(code, prepend=-1) != 0
    # the place in the arrays where the count of the packet's session began
    begin = np.where(head, at - seen[code], at)
    starts = head.copy()
    if idle_us is not None:
        before = np.where(head, np.where(code < known, last[code], us), np.concatenate([us[:1], us[:-1]]))
        gap = us - before > idle_us
        begin[gap] = at[gap]
        starts |= gap
    pos = at - begin[np.maximum.accumulate(np.where(starts, at, 0))]
    tail = np.append(np.flatnonzero(head)[1:] - 1, len(us) - 1)
    seen[code[tail]], last[code[tail]] = pos[tail] + 1, us[tail]
    return pos, keys.assign(seen=seen, last=last)


def cut(us: np.ndarray, octets: np.ndarray, flow: tuple | None, idle_us: int, active_us: int):
    """Flows closed by the packets at ``us`` (sorted) and the flow left open,
    each (start, last, packets, octets); one step per flow, not per packet."""
    closed = []
    gaps = np.append(np.flatnonzero(np.diff(us) > idle_us) + 1, len(us))
    total = np.concatenate([[0], np.cumsum(octets)])
    i = 0
    while i < len(us):
        if flow is not None and (us[i] - flow[1] > idle_us or us[i] - flow[0] > active_us):
            closed.append(flow)
            flow = None
        start, _, packets, size = flow or (int(us[i]), 0, 0, 0)
        j = min(int(gaps[np.searchsorted(gaps, i, "right")]), int(np.searchsorted(us, start + active_us, "right")))
        flow = (start, int(us[j - 1]), packets + j - i, size + int(total[j] - total[i]))
        i = j
    return closed, flow
