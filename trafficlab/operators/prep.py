"""Preprocessing: split, missing values, infinities, type narrowing, scaling, PCA.

Every statistic is one distributed aggregate (partial + final); the values
are then applied as literals in a projection, so the scoring plan is a plain
narrow map over the rows.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .position import keyed_position

TEST_SIZE = 0.30
SPLIT_SEED = 1
CHUNK_ROWS = 100_000

# Integer types tried when narrowing, smallest first (Q11).
INT_RANGES = [("tinyint", -128, 127), ("smallint", -32768, 32767),
              ("int", -2147483648, 2147483647), ("bigint", -(2 ** 63), 2 ** 63 - 1)]


def split_train_test(df: DataFrame, order: Sequence[str], test_size: float = TEST_SIZE,
                     seed: int = SPLIT_SEED, chunk_rows: int = CHUNK_ROWS,
                     part_col: str = "part") -> DataFrame:
    """G1: inside each chunk of ``chunk_rows`` rows (row order ``order``) the
    ceil(test_size * c) rows with the lowest hash rank md5('seed:row_id') form
    the test part.  Chunks are bounded, so the window groups are too."""
    pos = keyed_position(df, None, list(order), "row_id")
    chunk = F.floor(F.col("row_id") / chunk_rows)
    w = Window.partitionBy("_chunk").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("row_id").cast("string"))),
                                            F.col("row_id"))
    return (pos.withColumn("_chunk", chunk)
            .withColumn("_r", F.row_number().over(w))
            .withColumn("_c", F.count(F.lit(1)).over(Window.partitionBy("_chunk")))
            .withColumn(part_col, F.when(F.col("_r") <= F.ceil(F.col("_c").cast("decimal(20,0)")
                                                          * F.lit(str(test_size)).cast("decimal(12,6)")), F.lit("test"))
                        .otherwise(F.lit("train")))
            .drop("_chunk", "_r", "_c"))


def _missing(c: Column, dt: T.DataType) -> Column:
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def nan_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Number of missing (NULL or NaN) values per column, long form."""
    types = {f.name: f.dataType for f in df.schema.fields}
    aggs = [F.count_if(_missing(F.col(c), types[c])).alias(c) for c in cols]
    wide = df.agg(*aggs)
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("long").alias("n_missing"))
                                           for c in cols])).alias("x")).select("x.*")


def column_means(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean of every column (NaN and NULL ignored)."""
    aggs = [F.avg(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))).alias(c) for c in cols]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def impute_mean(df: DataFrame, cols: Sequence[str], by: str = "part") -> DataFrame:
    """Fill missing values with the mean of the row's own part (Q12).

    The means table has one row per part; it is broadcast (bounded by the
    number of parts)."""
    means = column_means(df, cols, [by]).select(by, *[F.col(c).alias(f"_m_{c}") for c in cols])
    j = df.join(F.broadcast(means), on=by, how="left")
    return j.select(*[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.col(f"_m_{c}")).alias(c)
                      if c in cols else F.col(c) for c in df.columns])


def fill_constant(df: DataFrame, cols: Sequence[str], value: float) -> DataFrame:
    """NULL and NaN -> ``value``."""
    return df.na.fill(value, subset=list(cols))


def replace_inf(df: DataFrame, cols: Sequence[str], how: str = "mean") -> DataFrame:
    """Replace +/-Inf by 0 or by the mean / min / max / std of the finite
    values of the column (Q13: both signs)."""
    fin = {c: F.when(~F.col(c).isin(float("inf"), float("-inf")), F.col(c)) for c in cols}
    fn = {"mean": F.avg, "min": F.min, "max": F.max, "std": F.stddev_samp}
    if how == "zero":
        vals = {c: F.lit(0.0) for c in cols}
        return df.select(*[F.when(F.col(c).isin(float("inf"), float("-inf")), vals[c]).otherwise(F.col(c)).alias(c)
                           if c in cols else F.col(c) for c in df.columns])
    # one row of statistics (one value per column): applied as literals
    stats = df.agg(*[fn[how](fin[c]).alias(c) for c in cols]).first()
    return df.select(*[F.when(F.col(c).isin(float("inf"), float("-inf")), F.lit(stats[c]).cast("double"))
                       .otherwise(F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])


def narrow_types(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per numeric column its range and the smallest type that holds it
    (integral values only; others stay 'double'), long form."""
    aggs = []
    for c in cols:
        x = F.col(c)
        aggs += [F.min(x).cast("double").alias(f"{c}__min"), F.max(x).cast("double").alias(f"{c}__max"),
                 F.count_if(x.cast("double") != F.floor(x.cast("double"))).alias(f"{c}__frac")]
    wide = df.agg(*aggs)
    rows = []
    for c in cols:
        lo, hi, frac = F.col(f"{c}__min"), F.col(f"{c}__max"), F.col(f"{c}__frac")
        t = F.lit("double")
        for name, a, b in reversed(INT_RANGES):
            t = F.when((frac == 0) & (lo >= a) & (hi <= b), F.lit(name)).otherwise(t)
        rows.append(F.struct(F.lit(c).alias("column"), lo.alias("min"), hi.alias("max"), t.alias("type")))
    return wide.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def narrow(df: DataFrame, cols: Sequence[str], floats: bool = False) -> DataFrame:
    """G7 applied: every column cast to the type ``narrow_types`` found (one
    row per column, collected); with ``floats`` other doubles become float32,
    which rounds them to 24 bits."""
    types = {r["column"]: r["type"] for r in narrow_types(df, cols).collect()}
    found = {c: "float" if floats and t == "double" else t for c, t in types.items()}
    return apply_narrowing(df, found)


def split_xy(df: DataFrame, label: str, drop: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """The feature columns (without ``drop``) and the label column."""
    return df.drop(label, *drop), df.select(label)


def apply_narrowing(df: DataFrame, types: dict[str, str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast(t) for c, t in types.items()})


def fit_scaler(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean and population std per column (std 0 -> 1), long form."""
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"{c}__mean"), F.stddev_pop(x).alias(f"{c}__std")]
    wide = df.agg(*aggs)
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"{c}__mean").alias("mean"),
                 F.when(F.col(f"{c}__std") == 0, F.lit(1.0)).otherwise(F.col(f"{c}__std")).alias("std"))
        for c in cols])).alias("x")).select("x.*")


def apply_scaler(df: DataFrame, stats: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x - mean) / std with the fitted statistics.  ``stats`` has one row
    per column (bounded by the feature count), so it is collected once and
    applied as literals: the scoring plan stays a narrow projection."""
    s = {r["column"]: (r["mean"], r["std"]) for r in stats.collect()}
    return df.withColumns({c: (F.col(c).cast("double") - F.lit(s[c][0])) / F.lit(s[c][1]) for c in cols})


def covariance(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """G11 first stage: population covariance of every column pair, long form."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    wide = df.agg(*[F.covar_pop(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}__{b}") for a, b in pairs])
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("c1"), F.lit(b).alias("c2"), F.col(f"{a}__{b}").alias("cov")) for a, b in pairs]))
        .alias("x")).select("x.*")


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="keep").transform(df)


def pca_components(df: DataFrame, cols: Sequence[str], target: float = 0.90,
                   features: str = "features") -> tuple[int, list[float]]:
    """Smallest k whose cumulative explained variance ratio reaches
    ``target`` (the fit is distributed; the d <= few-dozen ratios are small)."""
    from pyspark.ml.feature import PCA
    d = len(cols)
    model = PCA(k=d, inputCol=features, outputCol="_pca").fit(assemble(df, cols, features).select(features))
    ratios = list(model.explainedVariance.toArray())
    total = 0.0
    for i, r in enumerate(ratios):
        total += r
        if total >= target - 1e-12:
            return i + 1, ratios
    return d, ratios


def fit_pca(df: DataFrame, cols: Sequence[str], k: int, features: str = "features", out: str = "pca"):
    """PCA fit (exact covariance, distributed)."""
    from pyspark.ml.feature import PCA
    return PCA(k=k, inputCol=features, outputCol=out).fit(assemble(df, cols, features).select(features))


def apply_pca(model, df: DataFrame, cols: Sequence[str], features: str = "features") -> DataFrame:
    """Project (input is already centred by the scaler)."""
    return model.transform(assemble(df, cols, features))


def ceil_int(x: float) -> int:
    return int(math.ceil(x))
