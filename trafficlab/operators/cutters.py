"""U4: a user's own flow cutter, on batch packets and on a stream.

A cutter is Python code that sees a key's packets in time order and tells which
flow each belongs to.  It has two methods:

* ``begin()`` gives the state of a key that has no packet yet (picklable, small);
* ``cut(state, packets)`` takes that state and the next packets of the key, a
  pandas frame in time order with ``us`` (microseconds since the epoch) beside the
  packet columns, and returns the flow number of each packet (whole numbers from
  0 on, never falling) and the new state.

A key's packets come in several calls, cut anywhere, so a cutter must carry all
it needs in the state.  Memory: a task holds one Arrow batch of packets
(``spark.sql.execution.arrow.maxRecordsPerBatch``) and one key's state, however
many packets the key has; on a stream, the packets of one key and time slot.  A
key is worked through by one task, since its cuts follow from each other: cutters
that built-in functions can express (idle and active timeouts) have operators
without that limit in :mod:`.flows`.
"""

from __future__ import annotations

from typing import Any, Protocol, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.timecols import col_micros


class Cutter(Protocol):
    def begin(self) -> Any: ...

    def cut(self, state: Any, packets: pd.DataFrame) -> tuple[np.ndarray, Any]: ...


class IdleCutter:
    """Example: a gap of more than ``seconds`` starts a new flow (the same as F4)."""

    def __init__(self, seconds: float):
        self.gap_us = int(seconds * 1_000_000)

    def begin(self):
        return None, 0

    def cut(self, state, packets):
        last, number = state
        us = packets["us"].to_numpy(np.int64)
        before = np.concatenate([[us[0] if last is None else last], us[:-1]])
        flows = number + np.cumsum(us - before > self.gap_us)
        return flows, (int(us[-1]), int(flows[-1]))


def checked(flows: np.ndarray, packets: pd.DataFrame) -> np.ndarray:
    """The cutter's answer, or an error that names the mistake."""
    flows = np.asarray(flows)
    if flows.shape != (len(packets),) or not np.issubdtype(flows.dtype, np.integer) or (len(flows) and (flows[0] < 0 or (np.diff(flows) < 0).any())):
        raise ValueError("a cutter returns one whole number per packet, from 0 on and never falling")
    return flows


def cut_flows(packets: DataFrame, keys: Sequence[str], cutter: Cutter, order: Sequence[str] = ("ts", "packet_no"),
              ts_col: str = "ts", out: str = "flow", num_partitions: int | None = None) -> DataFrame:
    """Packets with the flow number ``out`` that ``cutter`` gives them within ``keys``.

    One shuffle by key; inside a partition the sorted packets stream through the
    cutter.  NULL keys are a key of their own; a packet without a time comes first
    in its key and has ``us`` 0."""
    keys = list(keys)
    n = int(num_partitions or packets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # two hashes stand for the key: a batch is split where they change
    timed = packets.withColumns({"us": F.coalesce(col_micros(packets, ts_col), F.lit(0)), "_k1": F.xxhash64(*keys), "_k2": F.xxhash64(F.lit(1), *keys)})
    rows = timed.repartition(n, "_k1", "_k2").sortWithinPartitions("_k1", "_k2", *order)
    schema = T.StructType([*packets.schema.fields, T.StructField(out, T.LongType())])
    names = packets.columns

    def run(batches):
        now, state = None, None
        for pdf in batches:
            k = pdf[["_k1", "_k2"]].to_numpy()
            cuts = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
            for i, j in zip([0, *cuts], [*cuts, len(pdf)]):
                if i == j:
                    continue
                if now is None or (k[i] != now).any():
                    now, state = k[i], cutter.begin()
                part = pdf.iloc[i:j].drop(columns=["_k1", "_k2"])
                flows, state = cutter.cut(state, part)
                yield part[names].assign(**{out: checked(flows, part)})

    return rows.mapInPandas(run, schema)
