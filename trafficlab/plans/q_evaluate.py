"""Queries for experiment evaluation (I*, R*, E5-E8, A7, B9, B13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as EV
from ..sources import runlogs as RL
from .q_flows import _accumulated
from .oracle_views import with_views
from .q_flows import ACC_SQL
from .registry import register, round_doubles

RUNS_SQL = """WITH
runs0 AS (SELECT user_id AS run_id, dayname(min(ts)) AS file FROM events GROUP BY user_id),
runs1 AS (SELECT run_id, file, CAST(CASE run_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 4 WHEN 2 THEN 5 ELSE 6 END AS INTEGER) AS vector,
                 CAST(CASE (run_id // 8) % 4 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 5 ELSE 9 END AS INTEGER) AS steps FROM runs0),
runs2 AS (SELECT *, CAST(CASE WHEN vector < 5 THEN (CASE (run_id // 4) % 2 WHEN 0 THEN 1 ELSE 3 END)
                              ELSE (CASE (run_id // 4) % 2 WHEN 0 THEN 5 ELSE 7 END) END AS INTEGER) AS mode FROM runs1),
runs AS (SELECT run_id, file, vector, mode, steps, CASE WHEN mode < 5 THEN 'flowsampling' ELSE 'packetsampling' END AS sampling,
                file || '_mode' || mode || '_vector' || vector || '_steps' || steps || '_' ||
                  (CASE WHEN mode < 5 THEN 'flowsampling' ELSE 'packetsampling' END) AS folder,
                CASE WHEN vector IN (4, 5) THEN 'CAIA' ELSE 'AGM' END AS family FROM runs2),
marks AS (SELECT user_id AS run_id, epoch_us(ts) / 1e6 AS epochtime, 'classify' AS script, event_type AS segment,
                 CASE WHEN event_id % 2 = 0 THEN 'start' ELSE 'end' END AS status FROM events),
res AS (SELECT user_id AS run_id, epoch_us(ts) / 1e6 + 0.5 AS epoch, value * 1e6 AS used, 16e9 AS total FROM events),
rep AS (SELECT user_id AS run_id, count(*) FILTER (WHERE event_type = 'error' AND value > 25) AS tp,
               count(*) FILTER (WHERE event_type <> 'error' AND value > 25) AS fp,
               count(*) FILTER (WHERE event_type = 'error' AND NOT value > 25) AS fn, count(*) AS instances FROM events GROUP BY user_id),
rep2 AS (SELECT run_id, instances, instances / 100.0 AS model_size, coalesce(tp / nullif(tp + fp, 0), 0.0) AS prec,
                coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall FROM rep),
rep3 AS (SELECT run_id, instances, model_size, recall, coalesce(2 * prec * recall / nullif(prec + recall, 0), 0.0) AS f1 FROM rep2),
lastm AS (SELECT run_id, min(epochtime) AS first, max(epochtime) AS last FROM marks GROUP BY run_id),
prevm AS (SELECT run_id, epochtime AS second_last FROM (SELECT run_id, epochtime, row_number() OVER (PARTITION BY run_id ORDER BY epochtime DESC) AS rn FROM marks) WHERE rn = 2),
times AS (SELECT run_id, last + 1 - first AS runtime, last - second_last AS classtime FROM lastm LEFT JOIN prevm USING (run_id)),
ram AS (SELECT run_id, max(used) / 1e6 AS ram FROM res JOIN lastm USING (run_id) WHERE epoch BETWEEN first AND last + 1 GROUP BY run_id),
metrics AS (SELECT r.*, t.runtime, t.classtime, ram.ram, rep3.f1, rep3.recall, rep3.instances, rep3.model_size,
                   CASE WHEN t.classtime = 0 THEN NULL ELSE rep3.instances / t.classtime END AS speed
            FROM runs r LEFT JOIN times t USING (run_id) LEFT JOIN ram USING (run_id) LEFT JOIN rep3 USING (run_id))"""

M = EV.METRICS


def _scaled_sql(cols, by=None, prefix="s_", src="metrics"):
    if by:
        rng = ", ".join(f"min({c}) OVER (PARTITION BY {by}) AS mn_{c}, max({c}) OVER (PARTITION BY {by}) AS mx_{c}" for c in cols)
    else:
        rng = ", ".join(f"min({c}) OVER () AS mn_{c}, max({c}) OVER () AS mx_{c}" for c in cols)
    sc = ", ".join(f"CASE WHEN mx_{c} - mn_{c} = 0 THEN NULL ELSE ({c} - mn_{c}) / (mx_{c} - mn_{c}) END AS {prefix}{c}" for c in cols)
    return f"(SELECT *, {sc} FROM (SELECT *, {rng} FROM {src}))"


SCORES_SQL = RUNS_SQL + f""",
g AS {_scaled_sql(M)},
gs AS (SELECT * EXCLUDE ({", ".join(f"mn_{c}, mx_{c}" for c in M)}) FROM g),
f AS {_scaled_sql(["f1", "recall", "instances"], "family", "f_", "gs")},
scores AS (SELECT *, CASE WHEN s_runtime + s_speed + s_ram = 0 THEN NULL ELSE (s_f1 + s_recall) / (s_runtime + s_speed + s_ram) END AS P1,
  CASE WHEN s_runtime + s_speed + s_ram = 0 THEN NULL ELSE (f_f1 + f_recall) / (s_runtime + s_speed + s_ram) END * f_instances AS P3,
  CASE WHEN s_runtime + s_speed + s_ram = 0 THEN NULL ELSE (f_f1 + f_recall + f_instances) / (s_runtime + s_speed + s_ram) END AS P4
  FROM f),
scores2 AS (SELECT *, P1 * f_instances AS P2 FROM scores)"""


def metrics(spark, sf):
    return EV.run_metrics(RL.runs(spark, sf), RL.marks(spark, sf), RL.resources(spark, sf), RL.run_reports(spark, sf))


@register("parse_run_name", RUNS_SQL + f"""
SELECT run_id, folder, regexp_extract(folder, '{EV.RUN_NAME}', 1) AS p_file,
  CAST(regexp_extract(folder, '{EV.RUN_NAME}', 2) AS INTEGER) AS p_mode, CAST(regexp_extract(folder, '{EV.RUN_NAME}', 3) AS INTEGER) AS p_vector,
  CAST(regexp_extract(folder, '{EV.RUN_NAME}', 4) AS INTEGER) AS p_steps, regexp_extract(folder, '{EV.RUN_NAME}', 5) AS p_sampling FROM runs""")
def q_parse_run_name(spark, sf):
    return EV.parse_run_name(RL.runs(spark, sf)).select("run_id", "folder", "p_file", "p_mode", "p_vector", "p_steps", "p_sampling")


@register("run_times", RUNS_SQL + " SELECT run_id, round(runtime, 6) AS runtime, round(classtime, 6) AS classtime FROM times")
def q_run_times(spark, sf):
    return round_doubles(EV.run_times(RL.marks(spark, sf)))


@register("run_speed", RUNS_SQL + " SELECT run_id, instances, round(speed, 6) AS speed FROM metrics")
def q_run_speed(spark, sf):
    return round_doubles(metrics(spark, sf).select("run_id", "instances", "speed"))


@register("relative_time", RUNS_SQL + " SELECT run_id, round(epochtime, 6) AS epochtime, round(epochtime - min(epochtime) OVER (PARTITION BY run_id), 6) AS rel FROM marks")
def q_relative_time(spark, sf):
    return round_doubles(EV.relative_time(RL.marks(spark, sf)).select("run_id", "epochtime", "rel"))


@register("segment_durations", RUNS_SQL + """ SELECT run_id, round(epochtime, 6) AS epochtime, segment,
  round(lead(epochtime) OVER (PARTITION BY run_id ORDER BY epochtime, segment, status) - epochtime, 6) AS duration FROM marks""")
def q_segment_durations(spark, sf):
    return round_doubles(EV.segment_durations(RL.marks(spark, sf)).select("run_id", "epochtime", "segment", "duration"))


@register("max_ram", RUNS_SQL + " SELECT run_id, round(ram, 6) AS ram FROM ram")
def q_max_ram(spark, sf):
    return round_doubles(EV.max_ram(RL.resources(spark, sf), RL.marks(spark, sf)))


@register("clip_log", RUNS_SQL + """ SELECT r.run_id, round(r.epoch, 6) AS epoch, round(r.used / 1e6, 6) AS used_mb
  FROM res r JOIN lastm l USING (run_id) WHERE r.epoch BETWEEN l.first AND l.last + 1""")
def q_clip_log(spark, sf):
    c = EV.clip_to_run(RL.resources(spark, sf), RL.marks(spark, sf))
    return round_doubles(c.select("run_id", "epoch", (F.col("used") / F.lit(1e6)).alias("used_mb")))


@register("asof_segment", RUNS_SQL + """ SELECT r.run_id, round(r.epoch, 6) AS epoch,
  (SELECT m.segment FROM marks m WHERE m.run_id = r.run_id AND m.epochtime <= r.epoch ORDER BY m.epochtime DESC LIMIT 1) AS segment FROM res r""")
def q_asof_segment(spark, sf):
    return round_doubles(EV.asof_segment(RL.resources(spark, sf), RL.marks(spark, sf)))


@register("parse_list_max", with_views("pkt_order", extra=ACC_SQL)
          + "SELECT l_orderkey, CAST(max(octets) AS DOUBLE) AS max_octets, count(*) AS n FROM pkt_order GROUP BY l_orderkey")
def q_parse_list_max(spark, sf):
    acc = _accumulated(spark, sf)
    arr = EV.parse_list(F.col("octets_list"))
    return acc.select("l_orderkey", F.array_max(arr).alias("max_octets"), F.size(arr).cast("long").alias("n"))


_RANGE_COLS = ", ".join(f"round(min({c}), 6) AS min_{c}, round(max({c}), 6) AS max_{c}" for c in M)


@register("metric_ranges", RUNS_SQL + f" SELECT {_RANGE_COLS} FROM metrics")
def q_metric_ranges(spark, sf):
    return round_doubles(EV.metric_ranges(metrics(spark, sf)))


@register("metric_ranges_family", RUNS_SQL + f" SELECT family, {_RANGE_COLS} FROM metrics GROUP BY family")
def q_metric_ranges_family(spark, sf):
    return round_doubles(EV.metric_ranges(metrics(spark, sf), ["family"]))


@register("metric_scaled", RUNS_SQL + f",\ng AS {_scaled_sql(M)} SELECT run_id, " + ", ".join(f"round(s_{c}, 6) AS s_{c}" for c in M) + " FROM g")
def q_metric_scaled(spark, sf):
    s = EV.minmax_scale(metrics(spark, sf))
    return round_doubles(s.select("run_id", *[f"s_{c}" for c in M]))


@register("run_scores", SCORES_SQL + " SELECT run_id, round(P1, 6) AS P1, round(P2, 6) AS P2, round(P3, 6) AS P3, round(P4, 6) AS P4 FROM scores2")
def q_run_scores(spark, sf):
    return round_doubles(EV.score_runs(metrics(spark, sf)).select("run_id", "P1", "P2", "P3", "P4"))


@register("run_ranking", SCORES_SQL + " SELECT run_id, round(P2, 6) AS P2, row_number() OVER (ORDER BY P2 IS NULL, P2 DESC, run_id) AS rank FROM scores2")
def q_run_ranking(spark, sf):
    return round_doubles(EV.rank_runs(EV.score_runs(metrics(spark, sf))).select("run_id", "P2", "rank"))


@register("run_top5", SCORES_SQL + " SELECT run_id, round(P2, 6) AS P2 FROM scores2 ORDER BY P2 DESC NULLS LAST, run_id LIMIT 5")
def q_run_top5(spark, sf):
    return round_doubles(EV.top_runs(EV.score_runs(metrics(spark, sf)), 5).select("run_id", "P2"))


def _roman_sql(n: str) -> str:
    parts = []
    for i, digits in reversed(list(enumerate(EV._ROMAN))):
        d = f"(({n} // {10 ** i}) % 10)" if i < 3 else f"({n} // 1000)"
        arr = "[" + ", ".join(f"'{x}'" for x in digits) + "]"
        parts.append(f"{arr}[{d} + 1]")
    return " || ".join(parts)


IDS_SQL = RUNS_SQL + """,
ids AS (SELECT run_id, row_number() OVER (ORDER BY CASE WHEN family = 'AGM' THEN 0 ELSE 1 END, sampling, folder, run_id) AS id FROM runs)"""


@register("run_ids", IDS_SQL + f" SELECT run_id, id, {_roman_sql('id')} AS roman FROM ids")
def q_run_ids(spark, sf):
    return EV.assign_ids(RL.runs(spark, sf)).select("run_id", "id", "roman")


_AXES = ["f1", "recall", "instances", "speed", "runtime", "ram"]


@register("radar_profile", RUNS_SQL + " " + " UNION ALL ".join(
    f"SELECT run_id, '{a}' AS axis, round(CASE WHEN max({a}) OVER () = 0 THEN NULL ELSE {a} / max({a}) OVER () END * 100, 6) AS pct FROM metrics"
    for a in _AXES))
def q_radar_profile(spark, sf):
    return round_doubles(EV.radar_profile(metrics(spark, sf), _AXES))


@register("baseline_compare", RUNS_SQL + """,
base AS (SELECT vector, arg_min(run_id, run_id) AS base_run, arg_min(f1, run_id) AS base_f1 FROM metrics WHERE steps = 0 GROUP BY vector)
SELECT m.run_id, m.vector, m.steps, round(m.f1, 6) AS f1, b.base_run, round(b.base_f1, 6) AS base_f1, round(m.f1 - b.base_f1, 6) AS delta_f1
FROM metrics m LEFT JOIN base b USING (vector) WHERE m.steps > 0""")
def q_baseline_compare(spark, sf):
    return round_doubles(EV.baseline_compare(metrics(spark, sf)))


@register("run_bundles", RUNS_SQL + """,
base AS (SELECT vector, min(run_id) AS baseline_run FROM metrics WHERE steps = 0 GROUP BY vector)
SELECT g.vector, g.mode, g.runs, round(g.mean_f1, 6) AS mean_f1, base.baseline_run FROM (
  SELECT vector, mode, count(*) AS runs, avg(f1) AS mean_f1 FROM metrics WHERE steps > 0 GROUP BY vector, mode) g
LEFT JOIN base USING (vector)""")
def q_run_bundles(spark, sf):
    return round_doubles(EV.bundles(metrics(spark, sf)))


@register("run_bundle_rows", RUNS_SQL + """ SELECT vector, CAST(bundle_mode AS INTEGER) AS bundle_mode, run_id, round(f1, 6) AS f1 FROM (
  SELECT vector, mode AS bundle_mode, run_id, f1 FROM metrics WHERE steps > 0
  UNION ALL SELECT u.vector, b.mode, u.run_id, u.f1 FROM metrics u
    JOIN (SELECT DISTINCT vector, mode FROM metrics WHERE steps > 0) b USING (vector) WHERE u.steps = 0)""")
def q_run_bundle_rows(spark, sf):
    rows = EV.bundle_rows(metrics(spark, sf)).select("vector", F.col("bundle_mode").cast("int").alias("bundle_mode"), "run_id", "f1")
    return round_doubles(rows)


@register("run_bundles_steps", RUNS_SQL + " SELECT run_id, sampling, vector, round(f1, 6) AS f1 FROM metrics WHERE steps = 5")
def q_run_bundles_steps(spark, sf):
    return round_doubles(EV.bundles_by_steps(metrics(spark, sf), 5).select("run_id", "sampling", "vector", "f1"))


@register("comparison_table", IDS_SQL + f""" SELECT m.run_id, {_roman_sql('i.id')} AS roman,
  CASE WHEN m.family = 'CAIA' THEN 'CAIA' ELSE 'AGM10s' END AS vector_label, m.sampling,
  CASE WHEN m.steps = 0 THEN 'unsampled' ELSE 'n = ' || m.steps END AS steps_label,
  round(m.f1, 4) AS f1, round(m.recall, 4) AS recall, round(m.runtime, 2) AS runtime, round(m.ram, 2) AS ram
FROM metrics m JOIN ids i USING (run_id)""")
def q_comparison_table(spark, sf):
    m = metrics(spark, sf)
    ids = EV.assign_ids(RL.runs(spark, sf)).select("run_id", "roman")
    t = m.join(ids, on="run_id").select(
        "run_id", "roman", F.when(F.col("family") == "CAIA", F.lit("CAIA")).otherwise(F.lit("AGM10s")).alias("vector_label"),
        "sampling", F.when(F.col("steps") == 0, F.lit("unsampled")).otherwise(F.concat(F.lit("n = "), F.col("steps").cast("string"))).alias("steps_label"),
        F.round("f1", 4).alias("f1"), F.round("recall", 4).alias("recall"), F.round("runtime", 2).alias("runtime"),
        F.round("ram", 2).alias("ram"))
    return t


GRID_VECTORS = list(range(1, 9))
GRID_MODES = list(range(1, 9))
GRID_SQL = RUNS_SQL + f""",
grid AS (SELECT f.file, v.vector, m.mode, s.steps FROM (SELECT DISTINCT file FROM runs) f,
  (SELECT unnest({GRID_VECTORS}) AS vector) v, (SELECT unnest({GRID_MODES}) AS mode) m, (SELECT unnest({RL.RUN_STEPS}) AS steps) s
  WHERE (v.vector < 5) = (m.mode < 5))"""


def _grid(spark, sf):
    files = RL.runs(spark, sf).select("file").distinct()
    return EV.experiment_grid(files, GRID_VECTORS, GRID_MODES, RL.RUN_STEPS)


@register("experiment_grid", GRID_SQL + " SELECT file, CAST(vector AS INTEGER) AS vector, CAST(mode AS INTEGER) AS mode, CAST(steps AS INTEGER) AS steps FROM grid")
def q_experiment_grid(spark, sf):
    g = _grid(spark, sf)
    return g.select("file", *[F.col(c).cast("int").alias(c) for c in ("vector", "mode", "steps")])


@register("pending_runs", GRID_SQL + """ SELECT file, CAST(vector AS INTEGER) AS vector, CAST(mode AS INTEGER) AS mode,
  CAST(steps AS INTEGER) AS steps FROM grid g WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.file = g.file AND r.vector = g.vector
  AND r.mode = g.mode AND r.steps = g.steps)""")
def q_pending_runs(spark, sf):
    p = EV.pending_runs(_grid(spark, sf), RL.runs(spark, sf))
    return p.select("file", *[F.col(c).cast("int").alias(c) for c in ("vector", "mode", "steps")])


@register("run_dimensions", RUNS_SQL + " SELECT DISTINCT steps FROM runs")
def q_run_dimensions(spark, sf):
    return EV.run_dimensions(RL.runs(spark, sf), "steps")
