"""Skew-safe ordered scan within keys: position, running sums and lag.

``keyed_scan`` gives every row its 0-based position inside its key (the
packet number inside a flow, or inside the whole capture when ``keys`` is
empty), optional running (inclusive) sums of numeric columns and optional
previous-row values (lag 1), in the order ``order``.

A plain ``Window.partitionBy(key).orderBy(...)`` puts a whole key into one
task, so one hot flow holding a third of the packets becomes one task; a
bare ``Window.orderBy`` is worse (``Exchange SinglePartition``).  Instead:

1. ``bucketize`` cuts the order of ``keys + order`` into ``num_buckets``
   ranges.  The bounds are a Spark aggregate over the rows whose hash falls
   below (``SAMPLE_PER_BUCKET`` * buckets / rows): a pure function of the
   data, evaluated inside the query.  They come back to the rows as one
   broadcast row, and a row finds its range by a search of log4(buckets)
   generated steps.  A hot key is split over many buckets, because the bounds
   also cut inside the order.
2. Built-in windows over ``(bucket, keys)`` number the rows and keep running
   sums / lag inside each piece (bounded by the bucket size).
3. Only a key that a bound cuts continues in another bucket, so only the rows
   of those keys (``_tl_open``, one key per bound) are summarised: rows, sums,
   first and last values of each piece.  Windows over the pieces of a key (at
   most ``num_buckets``) give the carry-in of the piece that continues it.
4. The carry-in is added through a broadcast join on ``(bucket, key)``;
   the broadcast side holds at most one row per bound (and refinement).

Building a scan runs no job and collects nothing: bounds, pieces and rows are
one lazy plan, and what the caller does not select is never read or shuffled.
The summary reads its few columns a second time instead of sharing the rows'
exchange.  Where most rows lie in cut keys (few, hot keys), ``write`` stages the
rows behind the windows instead, and the summary is the last row of each piece.

Because the bucket is computed from the row itself, every re-execution of
any branch (or a retried task) sees the same pieces: the result does not
depend on exchange reuse, partitioning or input file layout.  The order must
be total (unique) within each key; every caller ends ``order`` with a unique
column.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.timecols import micros
from ..session import staged

SAMPLE_PER_BUCKET = 64
_B = "_tl_bucket"
_OPEN = "_tl_open"
_INTEGRAL = (T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.BooleanType)


def _to_list(x) -> list[str]:
    if x is None:
        return []
    if isinstance(x, str):
        return [x]
    return list(x)


def _unmoved(c: Column) -> Column:
    """The same value, formally non-deterministic: a filter on it stays above the
    projections that compute its inputs instead of repeating them for each use."""
    return F.when(F.spark_partition_id() >= 0, c)


def _bounds(df: DataFrame, cols: Sequence[str], n_buckets: int) -> DataFrame:
    """One row: the sorted distinct bounds (at most ``n_buckets - 1`` structs of ``cols``).

    The sample is the rows whose hash is small enough, so it needs no seed and
    is the same in every execution; its size grows with the buckets only."""
    key = F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(cols)])
    slim = df.select(key.alias("_k"))
    share = F.lit(float(n_buckets * SAMPLE_PER_BUCKET)) / F.greatest(F.lit(1), df.agg(F.count(F.lit(1))).scalar())
    drawn = slim.withColumn("_h", _unmoved(F.xxhash64("_k") / F.lit(2.0 ** 64) + F.lit(0.5))).where(F.col("_h") < share)
    found = drawn.agg(F.sort_array(F.collect_list("_k")).alias("_s"))
    cut = F.transform(F.sequence(F.lit(1), F.lit(n_buckets - 1)), lambda i: F.get("_s", F.floor(i * F.size("_s") / n_buckets).cast("int")))
    return found.select(F.when(F.size("_s") > 0, F.array_distinct(cut)).otherwise(F.array().cast(found.schema["_s"].dataType)).alias("_tl_bounds"))


def bucketize(df: DataFrame, cols: Sequence[str], num_buckets: int | None = None, n_keys: int = 0) -> DataFrame:
    """Add the bucket column: ranges of ``cols`` cut at sampled bounds, and
    ``_tl_open``: whether a bound cuts the row's key (its first ``n_keys`` columns).

    Scans whose keys refine the leading bucket columns and whose order
    follows (e.g. flow key + session + direction, ordered by time) can
    reuse the same bucket column, and with it the same shuffle."""
    n_b = int(num_buckets or df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if n_b <= 1:
        return df.withColumns({_B: F.lit(0), _OPEN: F.lit(False)})
    key = F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(cols)])
    found = df.withColumn("_tl_key", key).join(F.broadcast(_bounds(df, cols, n_b)))
    # four-way search: each step is a projection of its own, so that the generated code holds
    # the step once; beyond the last bound ``get`` is NULL, which counts as above the key
    levels = 0
    while 4 ** levels < n_b:
        levels += 1
    found = found.withColumn(_B, F.lit(0))
    for level in reversed(range(levels)):
        step = 4 ** level
        below = [F.when(F.get("_tl_bounds", F.col(_B) + F.lit(j * step - 1)) <= F.col("_tl_key"), step).otherwise(0) for j in (1, 2, 3)]
        found = found.withColumn(_B, F.col(_B) + below[0] + below[1] + below[2])
    at_bound = F.lit(n_keys == 0)
    for side in (-1, 0) if n_keys else ():
        bound = F.get("_tl_bounds", F.col(_B) + F.lit(side)) if side == 0 else F.when(F.col(_B) > 0, F.get("_tl_bounds", F.col(_B) - 1))
        same = bound.isNotNull()
        for i in range(n_keys):
            same = same & bound[f"k{i}"].eqNullSafe(F.col(f"`{cols[i]}`"))
        at_bound = at_bound | same
    return found.withColumn(_OPEN, _unmoved(at_bound)).drop("_tl_key", "_tl_bounds")


def keyed_scan(df: DataFrame, keys: Sequence[str] | str | None, order: Sequence[str] | str,
               pos_col: str | None = "pos", sums: dict[str, str] | None = None,
               lags: dict[str, str] | None = None, gap_session: tuple[str, str, float] | None = None,
               leads: dict[str, str] | None = None, maxs: dict[str, str] | None = None,
               lasts: dict[str, str] | None = None, session_start: str | None = None,
               num_buckets: int | None = None, keep_bucket: bool = False, write: str | None = None) -> DataFrame:
    """Add ``pos_col`` (0-based position within ``keys`` by ``order``).

    ``sums`` maps output name -> numeric input column (running inclusive sum
    within the key; NULL counts as 0).  ``lags`` maps output name -> input
    column whose previous-row value within the key is wanted (NULL on the
    key's first row), ``leads`` the same for the next row, ``lasts`` for the
    nearest earlier row where the column is not NULL, ``maxs`` to the
    column whose running inclusive maximum is wanted (NULLs left out).  ``gap_session = (out, ts_col, seconds)`` numbers the
    sessions inside the key (0-based): a gap strictly greater than
    ``seconds`` starts a new one; ``session_start`` names a column for the
    time of the session's first row.

    If ``df`` already carries a bucket column (``bucketize`` or an earlier
    scan with ``keep_bucket=True``), it is reused; otherwise the input is
    bucketed on ``keys + order``.

    ``write`` names a table in the checkpoint folder for the rows with what each
    piece alone gives (runs at once): for a result used several times.
    """
    keys = _to_list(keys)
    order = _to_list(order)
    sums = dict(sums or {})
    lags = dict(lags or {})
    leads = dict(leads or {})
    maxs = dict(maxs or {})
    lasts = dict(lasts or {})
    fields = {f.name: f.dataType for f in df.schema.fields}
    d = df if _B in df.columns else bucketize(df, keys + order, num_buckets, len(keys))
    base_cols = [c for c in df.columns if c not in (_B, _OPEN)]

    # ``_tl_open`` follows from bucket and key; as part of the window key it lets a filter on it pass below the shuffle
    w = Window.partitionBy(_B, _OPEN, *keys).orderBy(*order)
    w_run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    w_before = w.rowsBetween(Window.unboundedPreceding, -1)
    local = {"_tl_lpos": F.row_number().over(w) - 1}
    for name, c in sums.items():
        zero = F.lit(0) if isinstance(fields[c], _INTEGRAL) else F.lit(0.0)
        local[f"_tl_s_{name}"] = F.sum(F.coalesce(F.col(c), zero)).over(w_run)
    for name, c in lags.items():
        local[f"_tl_l_{name}"] = F.lag(F.col(c), 1).over(w)
    for name, c in lasts.items():
        local[f"_tl_p_{name}"] = F.last(F.col(c), ignorenulls=True).over(w_before)
    for name, c in leads.items():
        local[f"_tl_f_{name}"] = F.lead(F.col(c), 1).over(w)
    if leads or write:
        local["_tl_end"] = F.lead(F.lit(1), 1).over(w).isNull()
    if write:
        local |= {f"_tl_b_{name}": F.first(F.col(c)).over(w_run) for name, c in leads.items()}
    for name, c in maxs.items():
        local[f"_tl_m_{name}"] = F.max(F.col(c)).over(w_run)
    if gap_session:
        g_out, g_ts, g_sec = gap_session
        gap_us = F.lit(int(g_sec * 1_000_000))
        g_prev = F.lag(F.col(g_ts), 1).over(w)
        g_ntz = isinstance(fields[g_ts], T.TimestampNTZType)
        local["_tl_gstart"] = F.when(g_prev.isNull() | (micros(F.col(g_ts), g_ntz) - micros(g_prev, g_ntz) > gap_us), 1).otherwise(0)
    rows = d.withColumns(local)
    if gap_session:
        # a piece's first row counts as a start here; the carry-in may take that back
        begin = F.when((F.col("_tl_gstart") == 1) & (F.col("_tl_lpos") > 0), F.col(g_ts))
        rows = rows.withColumns({"_tl_gcum": F.sum("_tl_gstart").over(w_run), "_tl_gbegin": F.last(begin, ignorenulls=True).over(w_run),
                                 "_tl_gfirst": F.first(F.col(g_ts)).over(w_run)})

    if write:
        rows = staged(rows, write)

    # one row per (bucket, key) piece of a key that a bound cuts
    at = F.struct(*[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)])
    piece_aggs = [F.count(F.lit(1)).alias("_n"),
                  *[F.sum(F.col(c)).alias(f"_ks_{name}") for name, c in sums.items()],
                  *[F.max(F.col(c)).alias(f"_km_{name}") for name, c in maxs.items()],
                  *[F.max_by(F.col(c), at).alias(f"_kl_{name}") for name, c in lags.items()],
                  *[F.min_by(F.col(c), at).alias(f"_kf_{name}") for name, c in leads.items()],
                  *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(f"_kp_{name}") for name, c in lasts.items()]]
    if gap_session:
        piece_aggs += [F.min_by(F.col(g_ts), at).alias("_t0"), F.max_by(F.col(g_ts), at).alias("_t1"), F.sum("_tl_gstart").alias("_gst"),
                       F.max_by(begin, F.when(begin.isNotNull(), at)).alias("_gb")]
    if write:
        # the piece's last row has its sums and its last values
        whole = {"_n": F.col("_tl_lpos") + 1, **{f"_ks_{name}": F.col(f"_tl_s_{name}") for name in sums}, **{f"_km_{name}": F.col(f"_tl_m_{name}") for name in maxs},
                 **{f"_kl_{name}": F.col(c) for name, c in lags.items()}, **{f"_kf_{name}": F.col(f"_tl_b_{name}") for name in leads},
                 **{f"_kp_{name}": F.coalesce(F.col(c), F.col(f"_tl_p_{name}")) for name, c in lasts.items()}}
        if gap_session:
            whole |= {"_t0": F.col("_tl_gfirst"), "_t1": F.col(g_ts), "_gst": F.col("_tl_gcum"), "_gb": F.col("_tl_gbegin")}
        pieces = rows.where(F.col(_OPEN) & F.col("_tl_end")).select(_B, *keys, *[v.alias(k) for k, v in whole.items()])
    else:
        pieces = (rows if gap_session else d).where(_OPEN).groupBy(_B, *keys).agg(*piece_aggs)
    wk = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(_B)   # pieces of one key: <= num_buckets rows
    before = wk.rowsBetween(Window.unboundedPreceding, -1)
    off = {"_has_prev": F.lag(F.lit(1), 1).over(wk).isNotNull(),
           "_off_n": F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("long")}
    for name, c in sums.items():
        off[f"_off_{name}"] = F.sum(f"_ks_{name}").over(before)
    for name in lags:
        off[f"_carry_{name}"] = F.lag(F.col(f"_kl_{name}"), 1).over(wk)
    for name in lasts:
        off[f"_past_{name}"] = F.last(F.col(f"_kp_{name}"), ignorenulls=True).over(before)
    for name in maxs:
        off[f"_max_{name}"] = F.max(f"_km_{name}").over(before)
    for name in leads:
        off[f"_next_{name}"] = F.lead(F.col(f"_kf_{name}"), 1).over(wk)
    if leads:
        off["_has_next"] = F.lead(F.lit(1), 1).over(wk).isNotNull()
    pieces = pieces.withColumns(off)
    if gap_session:
        prev_t = F.lag(F.col("_t1"), 1).over(wk)
        fis = F.when(prev_t.isNull() | (micros(F.col("_t0"), g_ntz) - micros(prev_t, g_ntz) > gap_us), 1).otherwise(0)
        pieces = pieces.withColumn("_fis", fis)
        pieces = pieces.withColumn("_true_st", F.col("_gst") - 1 + F.col("_fis"))
        pieces = pieces.withColumn("_begin", F.coalesce("_gb", F.when(F.col("_fis") == 1, F.col("_t0"))))
        pieces = pieces.withColumns({"_off_sess": F.coalesce(F.sum("_true_st").over(before), F.lit(0)),
                                     "_off_begin": F.last("_begin", ignorenulls=True).over(before)})
    keep = [F.col(_B).alias("_ob"), *[F.col(k).alias(f"_ok_{i}") for i, k in enumerate(keys)], "_off_n"]
    keep += [f"_off_{name}" for name in sums] + [f"_carry_{name}" for name in lags] + [f"_past_{name}" for name in lasts]
    keep += [f"_max_{name}" for name in maxs] + [f"_next_{name}" for name in leads]
    if gap_session:
        keep += ["_fis", "_off_sess", "_off_begin"]
    # at most one open key per bucket boundary (per refinement of it) has a
    # predecessor piece (or a successor), so this table is bounded by the bucket count
    offsets = pieces.where("_has_prev or _has_next" if leads else "_has_prev").select(*keep)
    if write:
        offsets = staged(offsets, f"{write}-pieces")

    cond = rows[_B] == offsets["_ob"]
    for i, k in enumerate(keys):
        cond = cond & rows[k].eqNullSafe(offsets[f"_ok_{i}"])
    joined = rows.join(F.broadcast(offsets), on=cond, how="left")
    matched = F.col("_ob").isNotNull()
    out_cols = {}
    if pos_col:
        out_cols[pos_col] = F.col("_tl_lpos") + F.coalesce(F.col("_off_n"), F.lit(0))
    for name, c in sums.items():
        zero = F.lit(0) if isinstance(fields[c], _INTEGRAL) else F.lit(0.0)
        out_cols[name] = F.col(f"_tl_s_{name}") + F.coalesce(F.col(f"_off_{name}"), zero)
    for name in lags:
        out_cols[name] = F.when(matched & (F.col("_tl_lpos") == 0), F.col(f"_carry_{name}")) \
            .otherwise(F.col(f"_tl_l_{name}"))
    for name in lasts:
        out_cols[name] = F.coalesce(F.col(f"_tl_p_{name}"), F.col(f"_past_{name}"))
    for name in maxs:
        out_cols[name] = F.greatest(F.col(f"_tl_m_{name}"), F.col(f"_max_{name}"))
    for name in leads:
        out_cols[name] = F.when(matched & F.col("_tl_end"), F.col(f"_next_{name}")).otherwise(F.col(f"_tl_f_{name}"))
    if gap_session:
        fis_c = F.coalesce(F.col("_fis"), F.lit(1))
        out_cols[gap_session[0]] = (F.coalesce(F.col("_off_sess"), F.lit(0)) + F.col("_tl_gcum")
                                    - (F.lit(1) - fis_c) - 1).cast("long")
        if session_start:
            out_cols[session_start] = F.coalesce(F.col("_tl_gbegin"), F.when(fis_c == 0, F.col("_off_begin")), F.col("_tl_gfirst"))
    extra = [F.col(_B), F.col(_OPEN)] if keep_bucket else []
    return joined.select(*[F.col(f"`{c}`") for c in base_cols], *extra,
                         *[v.alias(k) for k, v in out_cols.items()])


def keyed_position(df: DataFrame, keys, order, pos_col: str = "pos",
                   num_buckets: int | None = None) -> DataFrame:
    """0-based position inside ``keys`` by ``order`` (skew-safe)."""
    return keyed_scan(df, keys, order, pos_col=pos_col, num_buckets=num_buckets)


def global_position(df: DataFrame, order, pos_col: str = "pos",
                    num_buckets: int | None = None) -> DataFrame:
    """0-based position over the whole input (C0), without a single-partition window."""
    return keyed_scan(df, None, order, pos_col=pos_col, num_buckets=num_buckets)
