"""Experiment evaluation: run times, resource use, ranges, scaling, scores,
ranking, bundles, grid and as-of segment assignment (I*, R*, E5-E8).

Runs, marks and resource samples are DataFrames keyed by ``run_id``; every
per-run quantity is an aggregate, every global range is a one-row aggregate
joined back by broadcast.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .position import global_position, keyed_scan

RUN_NAME = r"^(.+)_mode(\d+)_vector(\d+)_steps(\d+)_(\w+)$"
METRICS = ["f1", "recall", "runtime", "speed", "ram", "instances", "model_size"]


def parse_run_name(df: DataFrame, col: str = "folder") -> DataFrame:
    """Folder name -> file, mode, vector, steps, sampling (Q18: any digit count)."""
    c = F.col(col)
    return df.withColumns({
        "p_file": F.regexp_extract(c, RUN_NAME, 1),
        "p_mode": F.regexp_extract(c, RUN_NAME, 2).cast("int"),
        "p_vector": F.regexp_extract(c, RUN_NAME, 3).cast("int"),
        "p_steps": F.regexp_extract(c, RUN_NAME, 4).cast("int"),
        "p_sampling": F.regexp_extract(c, RUN_NAME, 5),
    })


def run_times(marks: DataFrame) -> DataFrame:
    """runtime = last + 1 - first mark; classification time = last -
    second-last mark (the same time if two marks share the last one).  Two
    partial aggregates, no per-run sort."""
    last = marks.groupBy("run_id").agg(F.min("epochtime").alias("first"), F.max("epochtime").alias("last"))
    at_last = F.col("epochtime") == F.col("last")
    t = marks.join(last, on="run_id").groupBy("run_id", "first", "last").agg(
        F.sum(at_last.cast("long")).alias("_ties"), F.max(F.when(~at_last, F.col("epochtime"))).alias("_before"))
    second = F.when(F.col("_ties") > 1, F.col("last")).otherwise(F.col("_before"))
    return t.select("run_id", (F.col("last") + 1 - F.col("first")).alias("runtime"),
                    (F.col("last") - second).alias("classtime"))


def max_ram(resources: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """Maximum used memory per run in MB (/1000^2), over the samples inside the run if ``marks`` are given."""
    if marks is not None:
        resources = clip_to_run(resources, marks)
    return resources.groupBy("run_id").agg((F.max("used") / F.lit(1e6)).alias("ram"))


def relative_time(log: DataFrame, ts: str = "epochtime") -> DataFrame:
    """I4: seconds since the run's first mark (per-run min joined back)."""
    start = log.groupBy("run_id").agg(F.min(ts).alias("_t0"))
    return log.join(start, on="run_id").withColumn("rel", F.col(ts) - F.col("_t0")).drop("_t0")


def segment_durations(marks: DataFrame) -> DataFrame:
    """Distance from each mark to the next mark of the same run; marks at
    one time follow each other by segment, then status."""
    following = keyed_scan(marks, ["run_id"], ["epochtime", "segment", "status"], pos_col=None, leads={"_next": "epochtime"})
    return following.withColumn("duration", F.col("_next") - F.col("epochtime")).drop("_next")


def clip_to_run(log: DataFrame, marks: DataFrame, ts: str = "epoch") -> DataFrame:
    """Keep resource samples with first mark <= ts <= last mark + 1."""
    b = marks.groupBy("run_id").agg(F.min("epochtime").alias("_lo"), (F.max("epochtime") + 1).alias("_hi"))
    return log.join(b, on="run_id").where(F.col(ts).between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def asof_segment(log: DataFrame, marks: DataFrame, ts: str = "epoch") -> DataFrame:
    """Each resource sample gets the segment of the last mark at or before
    it: an as-of join as union and running maximum over the run's time order.
    Of several marks at one time the last by segment counts."""
    a = log.select("run_id", F.col(ts).cast("double").alias("_t"), F.lit(1).alias("_is_log"), F.lit("").alias("_seg"))
    b = marks.select("run_id", F.col("epochtime").cast("double").alias("_t"), F.lit(0).alias("_is_log"), F.col("segment").alias("_seg"))
    u = a.unionByName(b).withColumn("_mark", F.when(F.col("_is_log") == 0, F.struct("_t", "_seg")))
    last = keyed_scan(u, ["run_id"], ["_t", "_is_log", "_seg"], pos_col=None, maxs={"_last": "_mark"})
    return last.where(F.col("_is_log") == 1).select("run_id", F.col("_t").alias("epoch"), F.col("_last._seg").alias("segment"))


def run_metrics(runs: DataFrame, marks: DataFrame, resources: DataFrame, reports: DataFrame) -> DataFrame:
    """Runs with runtime, classtime, speed (I3), ram, f1, recall, instances, model_size."""
    t = run_times(marks)
    r = max_ram(resources, marks)
    m = runs.join(t, "run_id", "left").join(r, "run_id", "left").join(reports, "run_id", "left")
    return m.withColumn("speed", F.try_divide(F.col("instances").cast("double"), F.col("classtime")))


def _const_join(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach a one-row aggregate to every row (broadcast hash join on a constant key)."""
    return (df.withColumn("_one", F.lit(1))
            .join(F.broadcast(one_row.withColumn("_one", F.lit(1))), on="_one").drop("_one"))


def metric_ranges(metrics: DataFrame, by: Sequence[str] = (), cols: Sequence[str] = METRICS) -> DataFrame:
    """Min and max of each metric, globally or per family."""
    aggs = []
    for c in cols:
        aggs += [F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}")]
    return metrics.groupBy(*by).agg(*aggs) if by else metrics.agg(*aggs)


def minmax_scale(metrics: DataFrame, cols: Sequence[str] = METRICS, by: Sequence[str] = (),
                 prefix: str = "s_") -> DataFrame:
    """(x - min) / (max - min); equal min and max -> NULL (Q16)."""
    rng = metric_ranges(metrics, by, cols)
    j = metrics.join(F.broadcast(rng), on=list(by)) if by else _const_join(metrics, rng)
    for c in cols:
        j = j.withColumn(f"{prefix}{c}", F.try_divide(F.col(c) - F.col(f"min_{c}"), F.col(f"max_{c}") - F.col(f"min_{c}")))
    return j.drop(*[f"{m}_{c}" for c in cols for m in ("min", "max")])


def score_runs(metrics: DataFrame) -> DataFrame:
    """Composite scores P1-P4 (global scaling s, per-family scaling f).

    D = s(runtime) + s(speed) + s(ram); P1 = (s(f1) + s(recall)) / D;
    P2 = P1 * f(instances); P3 = (f(f1) + f(recall)) / D * f(instances);
    P4 = (f(f1) + f(recall) + f(instances)) / D.  Faster classification
    raises ``speed`` and so lowers the scores (Q17, kept as in the source).
    """
    g = minmax_scale(metrics, METRICS, (), "s_")
    f = minmax_scale(g, ["f1", "recall", "instances"], ["family"], "f_")
    d = F.col("s_runtime") + F.col("s_speed") + F.col("s_ram")
    p1 = F.try_divide(F.col("s_f1") + F.col("s_recall"), d)
    return f.withColumns({
        "P1": p1,
        "P2": p1 * F.col("f_instances"),
        "P3": F.try_divide(F.col("f_f1") + F.col("f_recall"), d) * F.col("f_instances"),
        "P4": F.try_divide(F.col("f_f1") + F.col("f_recall") + F.col("f_instances"), d),
    })


def rank_runs(scores: DataFrame, by: str = "P2") -> DataFrame:
    """Rank by score, descending (dense rank; NULL scores last)."""
    keyed = scores.withColumns({"_isnull": F.col(by).isNull().cast("int"), "_neg": -F.col(by)})
    pos = global_position(keyed, ["_isnull", "_neg", "run_id"], "_pos")
    return pos.withColumn("rank", (F.col("_pos") + 1).cast("long")).drop("_isnull", "_neg", "_pos")


def top_runs(scores: DataFrame, k: int = 5, by: str = "P2") -> DataFrame:
    """R2: the k best runs (TakeOrderedAndProject)."""
    return scores.orderBy(F.desc_nulls_last(by), "run_id").limit(k)


# Roman digits for units, tens, hundreds and thousands.
_ROMAN = [["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"],
          ["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"],
          ["", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"],
          ["", "M", "MM", "MMM"]]


def roman(n: Column) -> Column:
    """Integer 1..3999 -> roman numeral; NULL beyond, where there is none."""
    parts = []
    for i, digits in reversed(list(enumerate(_ROMAN))):
        d = F.floor(n / F.lit(10 ** i)) % 10 if i < 3 else F.floor(n / F.lit(1000))
        parts.append(F.get(F.array(*[F.lit(x) for x in digits]), d.cast("int")))
    return F.concat(*parts)


def assign_ids(runs: DataFrame) -> DataFrame:
    """Number runs AGM first, then CAIA, by sampling and folder; R4 label."""
    fam = F.when(F.col("family") == "AGM", 0).otherwise(1)
    p = global_position(runs.withColumn("_fam", fam), ["_fam", "sampling", "folder", "run_id"], "_pos")
    return p.withColumn("id", (F.col("_pos") + 1).cast("long")).withColumn("roman", roman(F.col("id"))) \
            .drop("_fam", "_pos")


def radar_profile(metrics: DataFrame, axes: Sequence[str] = ("f1", "recall", "instances", "speed", "runtime", "ram")) -> DataFrame:
    """Percent of the maximum for each axis, long form (run, axis, pct)."""
    mx = metrics.agg(*[F.max(a).alias(f"_mx_{a}") for a in axes])
    j = _const_join(metrics, mx)
    items = [F.struct(F.lit(a).alias("axis"), (F.try_divide(F.col(a).cast("double"), F.col(f"_mx_{a}")) * 100).alias("pct"))
             for a in axes]
    return j.select("run_id", F.explode(F.array(*items)).alias("x")).select("run_id", "x.axis", "x.pct")


def baseline_compare(metrics: DataFrame, col: str = "f1") -> DataFrame:
    """Every sampled run next to the unsampled run (steps = 0) of the same
    vector; one baseline per vector (the lowest run id), so no pair blow-up.
    A run whose vector has no unsampled run keeps NULLs."""
    base = (metrics.where(F.col("steps") == 0).groupBy("vector")
            .agg(F.min_by(F.struct(F.col("run_id").alias("base_run"), F.col(col).alias(f"base_{col}")), F.col("run_id")).alias("_b"))
            .select("vector", "_b.*"))
    s = metrics.where(F.col("steps") > 0).join(F.broadcast(base), on="vector", how="left")
    return s.select("run_id", "vector", "steps", col, "base_run", f"base_{col}",
                    (F.col(col) - F.col(f"base_{col}")).alias(f"delta_{col}"))


def bundles(metrics: DataFrame) -> DataFrame:
    """Per (vector, mode) the runs' count and mean f1, with the vector's
    unsampled baseline run."""
    base = metrics.where(F.col("steps") == 0).groupBy("vector").agg(F.min("run_id").alias("baseline_run"))
    g = metrics.where(F.col("steps") > 0).groupBy("vector", "mode").agg(
        F.count(F.lit(1)).alias("runs"), F.avg("f1").alias("mean_f1"))
    return g.join(F.broadcast(base), on="vector", how="left")


def bundle_rows(metrics: DataFrame) -> DataFrame:
    """The runs of every (vector, mode) bundle: its sampled runs and the
    vector's unsampled runs, which belong to every bundle of the vector."""
    names = metrics.where(F.col("steps") > 0).select("vector", F.col("mode").alias("bundle_mode")).distinct()
    sampled = metrics.where(F.col("steps") > 0).withColumn("bundle_mode", F.col("mode"))
    unsampled = metrics.where(F.col("steps") == 0).join(names, on="vector")
    return sampled.unionByName(unsampled.select(*sampled.columns))


def bundles_by_steps(metrics: DataFrame, steps: int) -> DataFrame:
    """Runs with the given steps, ordered by (sampling, vector)."""
    return metrics.where(F.col("steps") == steps).orderBy("sampling", "vector", "run_id")


def experiment_grid(files: DataFrame, vectors: Sequence[int], modes: Sequence[int],
                    steps: Sequence[int], vector_limit: int = 5, mode_limit: int = 5) -> DataFrame:
    """E5: file x vector x mode x steps minus implausible pairs (a flow vector
    with a packet mode or the reverse).  The small configuration lists are
    exploded per file, so no join is needed."""
    g = files.select("file", F.explode(F.array(*[F.lit(v) for v in vectors])).alias("vector"))
    g = g.select("file", "vector", F.explode(F.array(*[F.lit(m) for m in modes])).alias("mode"))
    g = g.select("file", "vector", "mode", F.explode(F.array(*[F.lit(s) for s in steps])).alias("steps"))
    return g.where((F.col("vector") < vector_limit) == (F.col("mode") < mode_limit))


def pending_runs(grid: DataFrame, runs: DataFrame) -> DataFrame:
    """Grid entries without a run yet (anti join)."""
    return grid.join(runs.select("file", "vector", "mode", "steps").distinct(),
                     on=["file", "vector", "mode", "steps"], how="left_anti")


def run_dimensions(runs: DataFrame, col: str) -> DataFrame:
    """Distinct sorted values of one dimension."""
    return runs.select(col).distinct().orderBy(col)


def parse_list(text: Column, elem_type: str = "double") -> Column:
    """I7/S1: '[a, b c]' -> array (NULL stays NULL)."""
    inner = F.regexp_replace(text, r"^\s*\[|\]\s*$", "")
    parts = F.split(F.trim(inner), r"[,\s]+")
    return F.transform(F.filter(parts, lambda x: x != ""), lambda x: x.cast(elem_type))
