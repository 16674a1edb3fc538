"""Experiment run logs (D12-D15) derived from the driver's ``events`` table.

The reference evaluates folders of CSV logs written by its own runs.  Here
the same tables are derived from data so the evaluation work grows with it:
one run per user, the user's events are the stage marks (``segment`` =
event type), each mark also gives one resource sample, and a rule-based
classification of the user's events (truth: ``error``; prediction:
``value > 25``) gives the run's report.  Readers for real log folders are in
``trafficlab.sources.files``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timecols import col_micros
from .tables import table

# Vector number -> family (vectors 1-3, 6-8 are AGM; 4-5 CAIA).
VECTOR_FAMILY = {1: "AGM", 2: "AGM", 3: "AGM", 4: "CAIA", 5: "CAIA", 6: "AGM", 7: "AGM", 8: "AGM"}
# The stand-in grid of vectors, modes and steps.
RUN_VECTORS = [1, 4, 5, 6]
FLOW_RUN_MODES = [1, 3]
PACKET_RUN_MODES = [5, 7]
RUN_STEPS = [0, 2, 5, 9]
PRED_THRESHOLD = 25.0


def _pick(values, idx):
    out = None
    for i, v in enumerate(values):
        out = F.when(idx == i, F.lit(v)) if out is None else out.when(idx == i, F.lit(v))
    return out


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per run: run_id, file, vector, mode, steps, sampling, folder, family."""
    ev = table(spark, sf_dir, "events")
    u = F.col("run_id")
    vector = _pick(RUN_VECTORS, u % 4)
    sel = F.expr("(run_id div 4) % 2")
    mode = F.when(vector < 5, _pick(FLOW_RUN_MODES, sel)).otherwise(_pick(PACKET_RUN_MODES, sel))
    steps = _pick(RUN_STEPS, F.expr("(run_id div 8) % 4"))
    g = ev.groupBy(F.col("user_id").alias("run_id")).agg(F.min("ts").alias("_t0"))
    r = g.select("run_id", F.date_format("_t0", "EEEE").alias("file"),
                 vector.cast("int").alias("vector"), mode.cast("int").alias("mode"), steps.cast("int").alias("steps"))
    r = r.withColumn("sampling", F.when(F.col("mode") < 5, F.lit("flowsampling")).otherwise(F.lit("packetsampling")))
    r = r.withColumn("folder", F.concat_ws("", "file", F.lit("_mode"), "mode", F.lit("_vector"), "vector",
                                           F.lit("_steps"), "steps", F.lit("_"), "sampling"))
    fam = None
    for v, f in VECTOR_FAMILY.items():
        fam = F.when(F.col("vector") == v, F.lit(f)) if fam is None else fam.when(F.col("vector") == v, F.lit(f))
    return r.withColumn("family", fam)


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage marks: run_id, epochtime (s), script, segment, status."""
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("user_id").alias("run_id"),
                     (col_micros(ev, "ts") / F.lit(1e6)).alias("epochtime"),
                     F.lit("classify").alias("script"),
                     F.col("event_type").alias("segment"),
                     F.when(F.col("event_id") % 2 == 0, F.lit("start")).otherwise(F.lit("end")).alias("status"))


def resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resource samples: run_id, epoch (s), used / total (bytes)."""
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("user_id").alias("run_id"),
                     (col_micros(ev, "ts") / F.lit(1e6) + F.lit(0.5)).alias("epoch"),
                     (F.col("value") * F.lit(1e6)).alias("used"),
                     F.lit(16e9).alias("total"))


def run_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per run: f1, recall (class 1), instances, model_size."""
    ev = table(spark, sf_dir, "events")
    y = F.col("event_type") == "error"
    p = F.col("value") > PRED_THRESHOLD
    g = ev.groupBy(F.col("user_id").alias("run_id")).agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"),
        F.count(F.lit(1)).alias("instances"))
    prec = F.coalesce(F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fp")).cast("double")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fn")).cast("double")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0))
    return g.select("run_id", f1.alias("f1"), rec.alias("recall"), "instances",
                    (F.col("instances") / F.lit(100.0)).alias("model_size"))
