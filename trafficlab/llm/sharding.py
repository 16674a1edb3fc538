"""Sharding by bytes: contiguous, balanced shards from global prefix sums.

Rows are ordered by ``doc_id`` (nulls first) and range-partitioned.  Each
partition's byte and row totals give the partition's offset (a window over
one row per partition); a running sum inside the partition completes every
row's global prefix.  A row goes to the shard in whose equal share of the
bytes its midpoint lies, so shards are contiguous and differ from the target
by at most one document.  DataFrame operations only.

Cases: a null text has no bytes (size 16) and checksum 0; a null doc_id sorts
first; equal ids are ordered by checksum and arrival, so repeated rows get
different slots; an empty table gives no rows; a single very long document
may fill a shard and leave its neighbours short.  Extra columns are carried;
internal columns start with ``__shard_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import default_partitions, staged

#: Bytes counted for each row besides its text.
ROW_BYTES = 16
P = "__shard_"


def row_bytes(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(ROW_BYTES)).cast("long")


def text_crc32(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def shard_by_bytes(docs: DataFrame, n_shards: int, carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns of ``docs`` (default: all) plus size, text_crc32, law, shard, slot, grown_shard.

    Columns of ``docs`` with one of these names are replaced.
    """
    spark = docs.sparkSession
    names = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    carry = [c for c in (carry if carry is not None else docs.columns) if c not in names]
    base = docs.select(
        *carry,
        F.col("doc_id").alias(f"{P}id"),
        row_bytes(F.col("text")).alias("size"),
        text_crc32(F.col("text")).alias("text_crc32"),
        F.monotonically_increasing_id().alias(f"{P}tie"),
    )
    order = [F.col(f"{P}id").asc_nulls_first(), F.col("text_crc32"), F.col(f"{P}tie")]
    ranged = staged(
        base.repartitionByRange(default_partitions(spark), *order).withColumn(f"{P}pid", F.spark_partition_id()),
        "shard-ranges",
    )
    # one row per partition: bounded by the partition count, not by the rows
    totals = ranged.groupBy(f"{P}pid").agg(F.sum("size").alias(f"{P}bytes"), F.count("*").alias(f"{P}rows"))
    before = Window.orderBy(f"{P}pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        f"{P}pid",
        F.coalesce(F.sum(f"{P}bytes").over(before), F.lit(0)).alias(f"{P}bytes0"),
        F.coalesce(F.sum(f"{P}rows").over(before), F.lit(0)).alias(f"{P}rows0"),
        F.sum(f"{P}bytes").over(Window.partitionBy()).alias(f"{P}total"),
    )
    run = Window.partitionBy(f"{P}pid").orderBy(*order)

    def placed(rows: DataFrame) -> DataFrame:
        at = rows.withColumns({
            f"{P}run": F.sum("size").over(run.rowsBetween(Window.unboundedPreceding, 0)),
            f"{P}rn": F.row_number().over(run),
        }).join(F.broadcast(offsets), f"{P}pid")
        return at.withColumns({
            f"{P}row": F.col(f"{P}rows0") + F.col(f"{P}rn") - 1,
            # twice the midpoint, so that all arithmetic stays in whole numbers
            "shard": F.least(
                F.lit(n_shards - 1),
                F.expr(f"((2 * ({P}bytes0 + {P}run) - size) * {n_shards}) div (2 * {P}total)"),
            ).cast("int"),
        })

    slim = ranged.select(f"{P}pid", f"{P}id", "size", "text_crc32", f"{P}tie")
    first = placed(slim).groupBy("shard").agg(F.min(f"{P}row").alias(f"{P}first"))  # n_shards rows
    return (
        placed(ranged)
        .join(F.broadcast(first), "shard")
        .select(
            *carry, "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col(f"{P}row") - F.col(f"{P}first")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
