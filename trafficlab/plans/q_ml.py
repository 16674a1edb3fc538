"""Queries for the model, predictions and metrics (H*, R6, E4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ml as M
from ..operators import prep as P
from .q_labels import _labeled, _labeled_cte
from .q_prep import EMB_COLS, embeddings_wide
from .registry import register, round_doubles
from ..sources.tables import table

# rule-based prediction on documents (truth = labels.quality)
RULE_CHARS = 2000
PRED_SQL = f"""WITH p AS (SELECT d.doc_id, d.lang, l.quality AS label,
  CASE WHEN d.n_chars >= {RULE_CHARS} THEN 1 ELSE 0 END AS prediction
  FROM documents d JOIN labels l USING (doc_id))
"""


def doc_predictions(spark, sf):
    d = table(spark, sf, "documents")
    lab = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    return d.join(lab, on="doc_id", how="inner").select(
        "doc_id", "lang", "label", F.when(F.col("n_chars") >= RULE_CHARS, 1).otherwise(0).alias("prediction"))


@register("confusion_matrix", PRED_SQL + "SELECT label, count(*) FILTER (WHERE prediction = 0) AS pred_0, "
          "count(*) FILTER (WHERE prediction = 1) AS pred_1 FROM p GROUP BY label")
def q_confusion(spark, sf):
    return M.confusion(doc_predictions(spark, sf))


def _report_sql() -> str:
    base = PRED_SQL + """, c AS (SELECT count(*) FILTER (WHERE label = 0 AND prediction = 0) AS n00,
  count(*) FILTER (WHERE label = 0 AND prediction = 1) AS n01, count(*) FILTER (WHERE label = 1 AND prediction = 0) AS n10,
  count(*) FILTER (WHERE label = 1 AND prediction = 1) AS n11 FROM p),
k AS (SELECT '0' AS class, coalesce(n00 / nullif(n00 + n10, 0), 0) AS precision, coalesce(n00 / nullif(n00 + n01, 0), 0) AS recall,
             n00 + n01 AS support FROM c
      UNION ALL SELECT '1', coalesce(n11 / nullif(n11 + n01, 0), 0), coalesce(n11 / nullif(n11 + n10, 0), 0), n10 + n11 FROM c),
kf AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM k),
tot AS (SELECT n00 + n01 + n10 + n11 AS n, coalesce((n00 + n11) / nullif(n00 + n01 + n10 + n11, 0), 0) AS acc FROM c)
"""
    return base + """SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
  CAST(support AS BIGINT) AS support FROM kf
UNION ALL SELECT 'accuracy', round(acc, 6), round(acc, 6), round(acc, 6), n FROM tot
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), (SELECT n FROM tot) FROM kf
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / (SELECT n FROM tot), 6),
  round(sum(recall * support) / (SELECT n FROM tot), 6), round(sum(f1 * support) / (SELECT n FROM tot), 6), (SELECT n FROM tot) FROM kf"""


@register("classification_report", _report_sql())
def q_classification_report(spark, sf):
    return round_doubles(M.classification_report(doc_predictions(spark, sf)))


@register("accuracy", PRED_SQL + "SELECT round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM p")
def q_accuracy(spark, sf):
    return round_doubles(M.accuracy(doc_predictions(spark, sf)))


@register("pred_join", PRED_SQL + "SELECT d.doc_id, d.source, p.label, p.prediction FROM documents d JOIN p USING (doc_id)")
def q_pred_join(spark, sf):
    pred = doc_predictions(spark, sf).select("doc_id", "label", "prediction")
    return M.with_predictions(table(spark, sf, "documents").select("doc_id", "source"), pred, key="doc_id")


FLOW_RULE = 50


def _flow_pred(spark, sf):
    lab = _labeled(spark, sf, "5tuple")
    return lab.withColumn("prediction", F.when(F.col("packets") >= FLOW_RULE, 1).otherwise(0))


@register("fn_by_attack", _labeled_cte() + f"SELECT Attack, count(*) AS n FROM labeled WHERE Label = 1 AND packets < {FLOW_RULE} GROUP BY Attack")
def q_fn_by_attack(spark, sf):
    return M.misclassified(_flow_pred(spark, sf), "fn")


@register("fp_by_attack", _labeled_cte() + f"SELECT Attack, count(*) AS n FROM labeled WHERE Label = 0 AND packets >= {FLOW_RULE} GROUP BY Attack")
def q_fp_by_attack(spark, sf):
    return M.misclassified(_flow_pred(spark, sf), "fp")


def _forest(spark, sf, trees=M.NUM_TREES):
    w = P.split_train_test(embeddings_wide(spark, sf), ["vec_id"])
    data = P.assemble(w, EMB_COLS).withColumn("label", F.col("label").cast("double"))
    train = data.where(F.col("part") == "train")
    test = data.where(F.col("part") == "test")
    return M.fit_forest(train, num_trees=trees), test


@register("rf_fit")
def q_rf_fit(spark, sf):
    model, _ = _forest(spark, sf)
    return M.forest_shape(spark, model)


@register("rf_predict")
def q_rf_predict(spark, sf):
    model, test = _forest(spark, sf)
    return M.predict(model, test).select("vec_id", F.col("label").cast("int").alias("label"),
                                         F.col("prediction").cast("int").alias("prediction"))


@register("feature_importance")
def q_feature_importance(spark, sf):
    model, _ = _forest(spark, sf, trees=20)
    return M.importance_ranking(spark, model, EMB_COLS)


@register("forest_shape")
def q_forest_shape(spark, sf):
    model, _ = _forest(spark, sf)
    shape = M.forest_shape(spark, model)
    return shape.agg(F.count(F.lit(1)).alias("trees"), F.max("depth").alias("max_depth"),
                     F.max("leaves").alias("max_leaves"))


@register("experiment_report")
def q_experiment_report(spark, sf):
    """The study end to end on one configuration: flow-sampled CAIA vectors
    (first 9 packets per direction), 5-tuple labels, 70/30 split, per-part
    mean imputation, scaler fitted on train, PCA to 90 % variance, forest,
    classification report on the test part."""
    from ..operators import flows as FW
    from ..operators import labels as LB
    from ..schema import CAIA_ORDER
    from ..sources.tables import attack_schedule, pkt_pair
    from .q_flows import FS_CAIA, IDLE_S
    vec = FW.caia_vector(pkt_pair(spark, sf), IDLE_S, flow_sampling=FS_CAIA, active_seconds=None)
    feats = [c for c in CAIA_ORDER if c not in ("flowStartMilliseconds", "sourceIPAddress", "destinationIPAddress")]
    flows = vec.withColumn("flow_start", F.col("flowStartMilliseconds"))
    key = ["sourceIPAddress", "destinationIPAddress", "sourceTransportPort", "destinationTransportPort",
           "protocolIdentifier", "flowStartMilliseconds"]
    from ..functions.timecols import millis
    sched = attack_schedule(spark, sf).withColumn("t0", millis(F.col("t0"))).withColumn("t1", millis(F.col("t1")))
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    # several fits read the labeled vectors: cut the lineage once
    lab = LB.label_flows(flows, sched, "5tuple").checkpoint()
    split = P.split_train_test(lab, key)
    clean = {c: f"f{i}" for i, c in enumerate(feats)}
    data = split.select(*[F.col(f"`{c}`").cast("double").alias(a) for c, a in clean.items()], "part",
                        F.col("Label").cast("double").alias("label"))
    cols = list(clean.values())
    data = P.impute_mean(data, cols, by="part").na.fill(0.0, subset=cols).checkpoint()
    train = data.where(F.col("part") == "train")
    stats = P.fit_scaler(train, cols)
    scaled = P.apply_scaler(data, stats, cols)
    k, _ = P.pca_components(scaled.where(F.col("part") == "train"), cols, 0.90)
    pca = P.fit_pca(scaled.where(F.col("part") == "train"), cols, k)
    projected = P.apply_pca(pca, scaled, cols).select(F.col("pca").alias("features"), "label", "part").checkpoint()
    model = M.fit_forest(projected.where(F.col("part") == "train"))
    pred = M.predict(model, projected.where(F.col("part") == "test"))
    return round_doubles(M.classification_report(pred))
