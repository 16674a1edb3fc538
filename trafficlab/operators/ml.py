"""Model and metrics: random forest, confusion matrix, classification report,
accuracy, forest shape, misclassifications and feature importance."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Forest settings of the reference (100 trees, no depth limit;
# Spark's deepest allowed tree is 30).
NUM_TREES = 100
MAX_DEPTH = 30


def fit_forest(df: DataFrame, features: str = "features", label: str = "label",
               num_trees: int = NUM_TREES, max_depth: int = MAX_DEPTH, seed: int = 1):
    """H1: distributed random forest (sqrt features per split), see ``forest.py``."""
    from . import forest
    return forest.fit(df, features, label, num_trees, max_depth, seed)


def predict(model, df: DataFrame, out: str = "prediction") -> DataFrame:
    """H2: batch or streaming scoring."""
    return model.transform(df).withColumnRenamed("prediction", out) if out != "prediction" else model.transform(df)


def confusion(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """H3: rows = true class, columns pred_0 / pred_1 (zero filled)."""
    p = F.col(prediction).cast("int")
    return pred.groupBy(F.col(label).cast("int").alias("label")).agg(
        F.count(F.when(p == 0, 1)).alias("pred_0"), F.count(F.when(p == 1, 1)).alias("pred_1"))


def classification_report(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """H4: precision / recall / f1 / support for classes 0 and 1 plus the
    accuracy, macro avg and weighted avg rows (0/0 -> 0)."""
    y = F.col(label).cast("int")
    p = F.col(prediction).cast("int")
    c = pred.agg(*[F.count(F.when((y == a) & (p == b), 1)).alias(f"n{a}{b}") for a in (0, 1) for b in (0, 1)])
    z = F.lit(0.0)

    def div(a, b):
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), z)
    rows = []
    for k in (0, 1):
        tp = F.col(f"n{k}{k}")
        fp = F.col(f"n{1 - k}{k}")
        fn = F.col(f"n{k}{1 - k}")
        prec = div(tp, tp + fp)
        rec = div(tp, tp + fn)
        f1 = div(2 * prec * rec, prec + rec)
        rows.append((str(k), prec, rec, f1, (tp + fn)))
    total = F.col("n00") + F.col("n01") + F.col("n10") + F.col("n11")
    acc = div(F.col("n00") + F.col("n11"), total)
    rows.append(("accuracy", acc, acc, acc, total))
    rows.append(("macro avg", (rows[0][1] + rows[1][1]) / 2, (rows[0][2] + rows[1][2]) / 2,
                 (rows[0][3] + rows[1][3]) / 2, total))
    w0, w1 = div(rows[0][4], total), div(rows[1][4], total)
    rows.append(("weighted avg", rows[0][1] * w0 + rows[1][1] * w1, rows[0][2] * w0 + rows[1][2] * w1,
                 rows[0][3] * w0 + rows[1][3] * w1, total))
    return c.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("class"), a.alias("precision"), b.alias("recall"), d.alias("f1"),
                 e.cast("long").alias("support")) for n, a, b, d, e in rows])).alias("x")).select("x.*")


def accuracy(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """H5."""
    return pred.agg(F.avg((F.col(label).cast("int") == F.col(prediction).cast("int")).cast("double")).alias("accuracy"))


def forest_shape(spark: SparkSession, model) -> DataFrame:
    """H6: depth and leaves of every tree."""
    return model.shape()


def misclassified(pred: DataFrame, kind: str, label: str = "Label", prediction: str = "prediction",
                  by: str = "Attack") -> DataFrame:
    """H7: false negatives ('fn') or false positives ('fp') per attack type."""
    y = F.col(label).cast("int")
    p = F.col(prediction).cast("int")
    cond = (y == 1) & (p == 0) if kind == "fn" else (y == 0) & (p == 1)
    return pred.where(cond).groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def importance_ranking(spark: SparkSession, model, names: Sequence[str]) -> DataFrame:
    """Feature importances in percent, highest first."""
    imp = model.featureImportances
    rows = [(n, float(v) * 100.0) for n, v in zip(names, imp)]
    df = spark.createDataFrame(rows, "feature string, importance double")
    return df.orderBy(F.desc("importance"), "feature")


def with_predictions(rows: DataFrame, pred: DataFrame, key: str = "row_id") -> DataFrame:
    """Attach predictions to the original rows (inner join on the row id)."""
    return rows.join(pred, on=key, how="inner")


def save_model(model, path: str) -> None:
    """A9."""
    model.save(path)


def load_model(path: str):
    from . import forest
    return forest.load(SparkSession.active(), path)
