"""Queries for preprocessing (G*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import prep as P
from ..sources.tables import ORDER_SORT, table
from .oracle_views import ORDER_SORT as SQL_ORDER_SORT
from .registry import register, round_doubles

LI_KEY = ["l_orderkey"] + ORDER_SORT
def _split_sql(chunk_rows: int) -> str:
    return f"""
pos AS (SELECT *, row_number() OVER (ORDER BY l_orderkey, {SQL_ORDER_SORT}) - 1 AS row_id FROM lineitem),
split AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY row_id // {chunk_rows}
                          ORDER BY md5('{P.SPLIT_SEED}:' || CAST(row_id AS VARCHAR)), row_id)
                        <= ceil(count(*) OVER (PARTITION BY row_id // {chunk_rows}) * {P.TEST_SIZE})
                   THEN 'test' ELSE 'train' END AS part FROM pos)"""


SPLIT_SQL = _split_sql(P.CHUNK_ROWS)
DOC_SQL = """
dl AS (SELECT d.doc_id, d.lang, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)),
dpos AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS row_id FROM dl),
dsplit AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY row_id // 100000
                          ORDER BY md5('1:' || CAST(row_id AS VARCHAR)), row_id)
                        <= ceil(count(*) OVER (PARTITION BY row_id // 100000) * 0.3)
                   THEN 'test' ELSE 'train' END AS part FROM dpos)"""
SCALE_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
INF_SQL = ("CASE WHEN l_discount = 0 THEN CAST('inf' AS DOUBLE) WHEN l_tax = 0 THEN CAST('-inf' AS DOUBLE) "
           "ELSE l_extendedprice * l_discount END")


def docs_labeled(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    lab = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    return d.join(lab, on="doc_id", how="left")


def docs_split(spark, sf):
    return P.split_train_test(docs_labeled(spark, sf), ["doc_id"])


@register("train_test_split", f"WITH {SPLIT_SQL} SELECT row_id, part, l_orderkey, l_linenumber FROM split")
def q_train_test_split(spark, sf):
    return P.split_train_test(table(spark, sf, "lineitem"), LI_KEY).select("row_id", "part", "l_orderkey", "l_linenumber")


SMALL_CHUNK = 7_000


@register("train_test_split_many", f"WITH {_split_sql(SMALL_CHUNK)} SELECT row_id, part, l_orderkey, l_linenumber FROM split")
def q_train_test_split_many(spark, sf):
    split = P.split_train_test(table(spark, sf, "lineitem"), LI_KEY, chunk_rows=SMALL_CHUNK)
    return split.select("row_id", "part", "l_orderkey", "l_linenumber")


@register("split_sizes", f"WITH {SPLIT_SQL} SELECT part, count(*) AS n FROM split GROUP BY part")
def q_split_sizes(spark, sf):
    s = P.split_train_test(table(spark, sf, "lineitem"), LI_KEY)
    return s.groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@register("nan_profile", f"WITH {DOC_SQL} " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS n_missing FROM dl" for c in ["quality", "toxic", "n_chars"]))
def q_nan_profile(spark, sf):
    return P.nan_profile(docs_labeled(spark, sf), ["quality", "toxic", "n_chars"])


@register("column_means", f"WITH {DOC_SQL} SELECT round(avg(quality), 6) AS quality, round(avg(toxic), 6) AS toxic, "
          "round(avg(n_chars), 6) AS n_chars FROM dl")
def q_column_means(spark, sf):
    return round_doubles(P.column_means(docs_labeled(spark, sf), ["quality", "toxic", "n_chars"]))


@register("impute_mean", f"WITH {DOC_SQL} SELECT doc_id, part, "
          "round(coalesce(CAST(quality AS DOUBLE), avg(quality) OVER (PARTITION BY part)), 6) AS quality, "
          "round(coalesce(CAST(toxic AS DOUBLE), avg(toxic) OVER (PARTITION BY part)), 6) AS toxic FROM dsplit")
def q_impute_mean(spark, sf):
    out = P.impute_mean(docs_split(spark, sf), ["quality", "toxic"], by="part")
    return round_doubles(out.select("doc_id", "part", "quality", "toxic"))


@register("fill_constant", f"WITH {DOC_SQL} SELECT doc_id, coalesce(quality, 0) AS quality, coalesce(toxic, 0) AS toxic FROM dl")
def q_fill_constant(spark, sf):
    return P.fill_constant(docs_labeled(spark, sf), ["quality", "toxic"], 0).select("doc_id", "quality", "toxic")


def _inf_table(spark, sf):
    li = table(spark, sf, "lineitem")
    x = (F.when(F.col("l_discount") == 0, F.lit(float("inf")))
         .when(F.col("l_tax") == 0, F.lit(float("-inf")))
         .otherwise(F.col("l_extendedprice") * F.col("l_discount")))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", x.alias("x"))


def _inf_sql(fn: str) -> str:
    return (f"WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, {INF_SQL} AS x FROM lineitem), "
            f"s AS (SELECT {fn}(x) FILTER (WHERE NOT isinf(x)) AS v FROM t) "
            "SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN isinf(x) THEN s.v ELSE x END, 6) AS x FROM t, s")


@register("replace_inf_mean", _inf_sql("avg"))
def q_replace_inf_mean(spark, sf):
    return round_doubles(P.replace_inf(_inf_table(spark, sf), ["x"], "mean"))


@register("replace_inf_max", _inf_sql("max"))
def q_replace_inf_max(spark, sf):
    return round_doubles(P.replace_inf(_inf_table(spark, sf), ["x"], "max"))


NARROW_COLS = ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_discount"]


def _narrow_sql() -> str:
    parts = []
    for c in NARROW_COLS:
        t = "'double'"
        for name, a, b in reversed(P.INT_RANGES):
            t = (f"CASE WHEN count(*) FILTER (WHERE CAST({c} AS DOUBLE) <> floor(CAST({c} AS DOUBLE))) = 0 "
                 f"AND min({c}) >= {a} AND max({c}) <= {b} THEN '{name}' ELSE {t} END")
        parts.append(f"SELECT '{c}' AS \"column\", CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, "
                     f"{t} AS type FROM lineitem")
    return " UNION ALL ".join(parts)


@register("narrow_types", _narrow_sql())
def q_narrow_types(spark, sf):
    return P.narrow_types(table(spark, sf, "lineitem"), NARROW_COLS)


@register("scaler_fit", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(avg({c}), 6) AS mean, "
    f"round(CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END, 6) AS std FROM lineitem" for c in SCALE_COLS))
def q_scaler_fit(spark, sf):
    return round_doubles(P.fit_scaler(table(spark, sf, "lineitem"), SCALE_COLS))


@register("scaler_transform", "WITH s AS (SELECT " + ", ".join(
    f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS s_{c}" for c in SCALE_COLS)
    + " FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, " + ", ".join(
    f"round(({c} - m_{c}) / s_{c}, 6) AS {c}" for c in SCALE_COLS) + " FROM lineitem, s")
def q_scaler_transform(spark, sf):
    li = table(spark, sf, "lineitem")
    stats = P.fit_scaler(li, SCALE_COLS)
    return round_doubles(P.apply_scaler(li, stats, SCALE_COLS).select("l_orderkey", "l_linenumber", "l_partkey", *SCALE_COLS))


@register("pca_cov", " UNION ALL ".join(
    f"SELECT '{a}' AS c1, '{b}' AS c2, round(covar_pop({a}, {b}), 6) AS cov FROM lineitem"
    for i, a in enumerate(SCALE_COLS) for b in SCALE_COLS[i:]))
def q_pca_cov(spark, sf):
    return round_doubles(P.covariance(table(spark, sf, "lineitem"), SCALE_COLS))


EMB_DIM = 64


def embeddings_wide(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(EMB_DIM)])


EMB_COLS = [f"e{i}" for i in range(EMB_DIM)]


@register("pca_k")
def q_pca_k(spark, sf):
    k, ratios = P.pca_components(embeddings_wide(spark, sf), EMB_COLS, 0.90)
    rows = [(i + 1, float(r), k) for i, r in enumerate(ratios)]
    return spark.createDataFrame(rows, "component int, ratio double, k int")


@register("pca_transform")
def q_pca_transform(spark, sf):
    w = embeddings_wide(spark, sf)
    stats = P.fit_scaler(w, EMB_COLS)
    scaled = P.apply_scaler(w, stats, EMB_COLS)
    k, _ = P.pca_components(scaled, EMB_COLS, 0.90)
    model = P.fit_pca(scaled, EMB_COLS, k)
    out = P.apply_pca(model, scaled, EMB_COLS)
    from pyspark.ml.functions import vector_to_array
    return out.select("vec_id", vector_to_array("pca").alias("pca"))


@register("pca_fit")
def q_pca_fit(spark, sf):
    w = embeddings_wide(spark, sf)
    scaled = P.apply_scaler(w, P.fit_scaler(w, EMB_COLS), EMB_COLS)
    k, _ = P.pca_components(scaled, EMB_COLS, 0.90)
    model = P.fit_pca(scaled, EMB_COLS, k)
    pc = model.pc.toArray()
    rows = [(j, i, float(pc[i, j])) for j in range(pc.shape[1]) for i in range(pc.shape[0])]
    return spark.createDataFrame(rows, "component int, feature int, loading double")


@register("pca_rotation", """WITH v AS (SELECT vec_id, unnest(embedding) AS x FROM embeddings)
SELECT vec_id, round(sum(CAST(x AS DOUBLE) * x), 4) AS squared_norm FROM v GROUP BY vec_id""")
def q_pca_rotation(spark, sf):
    """A projection on all components is a rotation: it keeps each row's norm."""
    from pyspark.ml.functions import vector_to_array
    w = embeddings_wide(spark, sf)
    out = P.apply_pca(P.fit_pca(w, EMB_COLS, EMB_DIM), w, EMB_COLS).select("vec_id", vector_to_array("pca").alias("pca"))
    norm = F.aggregate("pca", F.lit(0.0), lambda a, x: a + x * x)
    return out.select("vec_id", F.round(norm, 4).alias("squared_norm"))


@register("pca_variances", "SELECT round(" + " + ".join(f"var_samp(embedding[{i + 1}])" for i in range(EMB_DIM))
          + ", 4) AS total_variance FROM embeddings")
def q_pca_variances(spark, sf):
    """The variances along all components add up to the trace of the covariance."""
    from pyspark.ml.functions import vector_to_array
    w = embeddings_wide(spark, sf)
    out = P.apply_pca(P.fit_pca(w, EMB_COLS, EMB_DIM), w, EMB_COLS).select(vector_to_array("pca").alias("pca"))
    total = sum((F.var_samp(F.col("pca")[i]) for i in range(EMB_DIM)), F.lit(0.0))
    return out.agg(F.round(total, 4).alias("total_variance"))


def _type_counts_sql() -> str:
    return "SELECT " + ", ".join(f"CAST(sum({c}) AS DOUBLE) AS {c}" for c in NARROW_COLS) + " FROM lineitem"


@register("narrow_apply", _type_counts_sql())
def q_narrow_apply(spark, sf):
    """G7 applied: sums over the narrowed columns are those of the originals."""
    li = P.narrow(table(spark, sf, "lineitem"), NARROW_COLS)
    return li.agg(*[F.sum(F.col(c).cast("double")).alias(c) for c in NARROW_COLS])
