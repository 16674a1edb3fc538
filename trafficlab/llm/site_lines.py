"""Line dedup by site-relative frequency.

For each host, a line's ratio is the number of the host's pages that contain
it over the number of the host's pages.  Lines above the boilerplate ratio
(on at least ``min_pages`` pages) are dropped from every page of that host.
DataFrame operations only.

The counts come from one row per (page, distinct line), pre-aggregated before
the shuffle.  A host's boilerplate list is bounded: at most
(lines per page) / ratio lines can exceed the ratio, so it is folded to one
array row per host and joined to the pages; Spark broadcasts or splits that
join from the written list's real size.  No line row is joined back.

Cases: lines are compared without surrounding spaces; blank lines are kept and
not counted; a null host is a host of its own; a null text stays null (0
lines); an empty table gives no rows; repeated rows count as pages each; other
columns are carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import staged

P = "__line_"


def _key(line: Column) -> Column:
    """128 bits of a trimmed line; null if blank."""
    t = F.trim(line)
    return F.when(t != "", F.struct(F.xxhash64(t).alias("a"), F.xxhash64(F.lit(1), t).alias("b")))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate(docs: DataFrame, host: str, ratio: float, min_pages: int) -> DataFrame:
    """One row per host that has boilerplate: ``__line_host`` and the array ``__line_keys``."""
    pages = docs.groupBy(F.col(host).alias(f"{P}host")).agg(F.count("*").alias(f"{P}pages"))
    hits = (
        docs.select(
            F.col(host).alias(f"{P}host"),
            F.explode(F.array_distinct(F.transform(_lines(F.col("text")), _key))).alias(f"{P}key"),
        )
        .where(F.col(f"{P}key").isNotNull())
        .groupBy(f"{P}host", f"{P}key")
        .agg(F.count("*").alias(f"{P}hits"))
        .where(F.col(f"{P}hits") >= min_pages)
    )
    return (
        hits.alias("h")
        .join(pages.alias("p"), F.col(f"h.{P}host").eqNullSafe(F.col(f"p.{P}host")))
        .where(F.col(f"{P}hits") > F.lit(ratio) * F.col(f"{P}pages"))
        .groupBy(F.col(f"h.{P}host").alias(f"{P}host"))
        .agg(F.collect_list(f"{P}key").alias(f"{P}keys"))
    )


def drop_site_lines(docs: DataFrame, host: str = "source", ratio: float = 0.1, min_pages: int = 3) -> DataFrame:
    """``docs`` with boilerplate lines removed from ``text``, plus n_lines and n_dropped."""
    found = staged(boilerplate(docs, host, ratio, min_pages), "site-lines")
    old = F.coalesce(_lines(F.col("text")), F.array().cast("array<string>"))
    lines = F.col(f"{P}lines")
    bad = F.coalesce(F.col(f"{P}keys"), F.array().cast("array<struct<a:bigint,b:bigint>>"))
    kept = F.when(F.size(bad) == 0, lines).otherwise(
        F.filter(lines, lambda x: ~F.coalesce(F.array_contains(bad, _key(x)), F.lit(False))))
    carry = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    return (
        docs.join(found, docs[host].eqNullSafe(found[f"{P}host"]), "left")
        .withColumn(f"{P}lines", old)
        .withColumn(f"{P}kept", kept)
        .select(
            *carry,
            F.when(F.col("text").isNotNull(), F.array_join(F.col(f"{P}kept"), "\n")).alias("text"),
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(f"{P}kept")).cast("long").alias("n_dropped"),
        )
    )
