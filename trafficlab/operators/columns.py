"""Column selection helpers."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def columns_like(df: DataFrame, keyword: str, prefix: bool = False) -> DataFrame:
    """B1: keep the columns whose name contains (or starts with) ``keyword``."""
    cols = [c for c in df.columns if (c.startswith(keyword) if prefix else keyword in c)]
    return df.select(*[F.col(f"`{c}`") for c in cols])


def drop_string_columns(df: DataFrame) -> DataFrame:
    """Drop every STRING column (schema only, no data pass)."""
    return df.select(*[F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, T.StringType)])


def constant_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One pass of min / max per column; a column is constant when all
    its non-NULL values are equal (or it is all NULL), like ``nunique() <= 1``."""
    cols = list(cols or df.columns)
    wide = df.agg(*[F.min(F.col(f"`{c}`")).alias(f"_mn{i}") for i, c in enumerate(cols)],
                  *[F.max(F.col(f"`{c}`")).alias(f"_mx{i}") for i, c in enumerate(cols)])
    items = [F.struct(F.lit(c).alias("column"),
                      (F.col(f"_mn{i}").isNull() | (F.col(f"_mn{i}") == F.col(f"_mx{i}"))).alias("dropped"))
             for i, c in enumerate(cols)]
    return wide.select(F.explode(F.array(*items)).alias("x")).select("x.*")


def drop_constant_columns(df: DataFrame) -> DataFrame:
    """Drop the constant columns (the profile is one row per column)."""
    drop = [r["column"] for r in constant_profile(df).collect() if r["dropped"]]
    return df.drop(*drop)


def rename_features(df: DataFrame, mapping: dict[str, str] | None = None, replace: tuple[str, str] | None = None) -> DataFrame:
    """B2: bulk rename by a map, or by a string replacement in every name."""
    m = dict(mapping or {})
    if replace:
        old, new = replace
        m.update({c: c.replace(old, new) for c in df.columns if old in c})
    return df.withColumnsRenamed(m)


def project_vector(df: DataFrame, family: str) -> DataFrame:
    """The fixed ordered projection of a feature vector ('AGM' / 'CAIA'),
    keeping ``Attack`` and ``Label`` (last) when present."""
    from ..schema import AGM_ORDER, CAIA_ORDER
    order = AGM_ORDER if family.upper() == "AGM" else CAIA_ORDER
    tail = [c for c in ("Attack", "Label") if c in df.columns]
    return df.select(*[F.col(f"`{c}`") for c in order + tail])
