"""Labeling: flows <-> attack schedule by addresses and time (E1-E3), plus
the exploratory distributions over labeled flows (H8-H10, R7).

An attack window stands once in every time slot that it meets; slots are as long
as the average window, so there are at most two rows per window on average.  The
windows of one (address key, slot) are folded into one row, so a plain left join
on addresses and the flow's slot meets at most one row per flow, which holds only
the windows near the flow: a hot address is many rows, no flow is multiplied, none
is merged, nothing is shuffled after the join.  In ``AGM`` mode a flow may span
slots; there a row holds all windows of a source.  Windows are sorted by start,
each with the greatest end up to it (an interval index): two binary searches
bound those that can hold the flow's time.
Spark chooses the join: it broadcasts a schedule below its own size limit and
shuffles both sides otherwise (with skew splitting of hot addresses).  The
windows of one row (see above) must fit into it.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.timecols import micros
from .position import keyed_scan

NORMAL = "Normal"


def _number(time: Column, kinds: Sequence[T.DataType]) -> Column:
    """A time as a number (timestamps: microseconds), alike for columns of the given kinds,
    which meet as Spark compares them: without a zone only if none of them has one."""
    if all(isinstance(k, T.TimestampNTZType) for k in kinds):
        return micros(time, ntz=True)
    if any(isinstance(k, (T.TimestampType, T.TimestampNTZType)) for k in kinds):
        return F.unix_micros(time.cast("timestamp"))
    return time.cast("double")


def _how_many(array: str, holds) -> Column:
    """Length of the front part of a sorted array for whose elements ``holds``: a binary search."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(30))])
    return F.aggregate(steps, F.lit(0), lambda p, s: F.when((p + s <= F.size(array)) & holds(F.get(array, p + s - 1)), p + s).otherwise(p))


def label_flows(flows: DataFrame, schedule: DataFrame, mode: str,
                src: str = "sourceIPAddress", dst: str = "destinationIPAddress",
                start: str = "flow_start", end: str | None = None) -> DataFrame:
    """Add ``Attack`` (schedule name or 'Normal') and ``Label`` (1/0).

    * ``5tuple``: flow src/dst equal schedule src/dst, start in [t0, t1)
    * ``5tuplebi``: the same in either orientation
    * ``AGM``: source equal, flow window [start, end) overlaps [t0, t1)

    Several matches: the one with the lowest ``priority`` (then name) wins.
    Every flow row comes out once, repeated rows included.  Times may have any
    ordered type (timestamps, milliseconds), the same on both sides.
    """
    if mode not in ("5tuple", "5tuplebi", "AGM"):
        raise ValueError(f"unknown labeling mode {mode!r}")
    # a window without both ends holds no time
    sched = schedule.where("t0 is not null and t1 is not null").select(F.col("src").alias("_src"), F.col("dst").alias("_dst"), "t0", "t1", "priority", "attack")
    if mode == "5tuplebi":
        sched = sched.unionByName(sched.withColumns({"_src": F.col("_dst"), "_dst": F.col("_src")}))
    keys = ["_src"] if mode == "AGM" else ["_src", "_dst"]
    sched = sched.select(*keys, "t0", "t1", "priority", "attack").distinct()
    if mode != "AGM":
        kinds = [schedule.schema["t0"].dataType, schedule.schema["t1"].dataType, flows.schema[start].dataType]
        first, last = _number(F.col("t0"), kinds), _number(F.col("t1"), kinds)
        # the average window (one number about the schedule)
        length = F.lit(max(1.0, float(sched.agg(F.avg(F.when(last > first, last - first))).first()[0] or 1.0)))
        slots = F.sequence(F.floor(first / length).cast("long"), F.floor(last / length).cast("long"))
        sched = sched.where(first < last).withColumn("_slot", F.explode(slots))
        keys.append("_slot")
    upto = Window.partitionBy(*keys).orderBy("t0", "t1", "priority", "attack").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    indexed = sched.withColumn("ends", F.max("t1").over(upto))
    folded = indexed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("t0", "t1", "priority", "attack", "ends"))).alias("_ws"))
    cond = F.col(src) == F.col("_src")
    if mode != "AGM":
        cond = cond & (F.col(dst) == F.col("_dst")) & (F.floor(_number(F.col(start), kinds) / length).cast("long") == F.col("_slot"))
    t = F.col(start)

    def hit(w):
        if mode == "AGM":
            return (t < w["t1"]) & (F.col(end) > w["t0"])
        return (t >= w["t0"]) & (t < w["t1"])
    begun = _how_many("_ws", lambda w: w["t0"] < F.col(end) if mode == "AGM" else w["t0"] <= t)
    over = _how_many("_ws", lambda w: w["ends"] <= t)
    # only the windows between are touched (``slice`` would convert the whole array for each flow)
    near = F.filter(F.transform(F.sequence(over, begun - 1), lambda i: F.get("_ws", i)), hit)
    best = F.when(F.col("_ws").isNotNull() & (begun > over), F.array_min(F.transform(near, lambda w: F.struct(w["priority"], w["attack"]))))
    found = flows.join(folded, on=cond, how="left").withColumn("_best", best)
    return found.withColumns({"Attack": F.coalesce(F.col("_best.attack"), F.lit(NORMAL)),
                              "Label": F.when(F.col("_best").isNotNull(), 1).otherwise(0)}).drop("_best", "_ws", *keys)


def distribution(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """H8/H9: row counts per value combination."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def distribution_rollup(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """H8: per capture, per attack and the totals in one pass (rollup)."""
    return df.rollup(*cols).agg(F.count(F.lit(1)).alias("n"))


def exact_quantiles(df: DataFrame, cols: Sequence[str], qs: Sequence[float]) -> DataFrame:
    """Exact quantiles (linear interpolation, as pandas), one row per column
    with values: ``column``, ``q0``, ``q1``, ...

    All columns are unpivoted and counted by value, with a map-side partial
    count, so a value that fills the column is one row.  The skew-safe scan
    then runs over the distinct values: no task holds a whole column.
    """
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("value"))
                                         for c in cols])).alias("x")).select("x.*").where("value is not null")
    values = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("_n"))
    upto = keyed_scan(values, ["column"], ["value"], pos_col=None, sums={"_upto": "_n"})
    total = values.groupBy("column").agg(F.sum("_n").alias("_total"))
    ranked = upto.join(F.broadcast(total), "column")  # one row per column
    aggs = []
    for i, q in enumerate(qs):
        h = (F.col("_total") - 1) * F.lit(float(q))

        def at(pos):
            return F.max(F.when((pos < F.col("_upto")) & (pos >= F.col("_upto") - F.col("_n")), F.col("value")))
        lo, hi, frac = at(F.floor(h)), at(F.ceil(h)), F.max(h - F.floor(h))
        aggs.append((lo + (hi - lo) * frac).alias(f"q{i}"))
    return ranked.groupBy("column").agg(*aggs)


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, mean, std, min, quartiles (exact, linear), max per column;
    one row per column.  Moments are one partial aggregate, quartiles come
    from :func:`exact_quantiles`."""
    rows = []
    for c in cols:
        x = F.col(f"`{c}`").cast("double")
        rows.append(F.struct(F.lit(c).alias("column"), F.count(x).cast("double").alias("count"), F.avg(x).alias("mean"),
                             F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max")))
    moments = df.agg(F.array(*rows).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    quartiles = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    return moments.join(quartiles, "column", "left").select(
        "column", "count", "mean", "std", "min", F.col("q0").alias("p25"), F.col("q1").alias("p50"), F.col("q2").alias("p75"), "max")


def extreme_flows(flows: DataFrame, count_col: str, key: Sequence[str]) -> DataFrame:
    """Fewest / most packets per flow and the flow that has them
    (ties -> smallest key)."""
    kc = F.struct(*[F.col(k) for k in key])
    return flows.agg(
        F.min(count_col).alias("min_packets"),
        F.min_by(kc, F.struct(F.col(count_col), kc)).alias("min_flow"),
        F.max(count_col).alias("max_packets"),
        F.min_by(kc, F.struct(-F.col(count_col), kc)).alias("max_flow"))
