"""File sources and sinks: packets, flow CSVs, run logs, resource logs,
run metadata, results and models (A1, A2, A4-A10)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import PACKET_SCHEMA

RUN_NAME = r"([^/]+)_mode(\d+)_vector(\d+)_steps(\d+)_(\w+)"


def read_packets(spark: SparkSession, path: str, fmt: str = "parquet",
                 mapping: dict[str, str] | None = None, schema: T.StructType = PACKET_SCHEMA) -> DataFrame:
    """A1: packets with an explicit schema; ``mapping`` renames source columns
    (source name -> packet column) before the fixed projection."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("ignoreLeadingWhiteSpace", True)
    df = reader.load(path)
    if mapping:
        df = df.withColumnsRenamed(mapping)
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns
                       else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])


def read_flows(spark: SparkSession, path: str | Sequence[str], cols: Sequence[str] | None = None,
               schema: T.StructType | None = None, encoding: str = "UTF-8") -> DataFrame:
    """A2/A4: flow CSV(s) with header, leading spaces skipped, optional column
    subset (pruned at the scan); globs and lists of files are concatenated."""
    r = (spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True)
         .option("encoding", encoding))
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    df = r.csv(path if isinstance(path, str) else list(path))
    return df.select(*[F.col(f"`{c}`") for c in cols]) if cols else df


def write_flows(df: DataFrame, path: str, partition_by: Sequence[str] = (), fmt: str = "parquet",
                mode: str = "overwrite") -> None:
    """A5: flow sink, partitioned by e.g. capture / mode / vector / steps."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def write_run_info(spark: SparkSession, path: str, info: dict) -> None:
    """Append one row of run metadata (sampling settings, PCA variance ...)."""
    spark.createDataFrame([tuple(info.values())], list(info.keys())).write.mode("append").parquet(path)


def read_runs(spark: SparkSession, root: str, file_name: str = "*.csv") -> DataFrame:
    """Every run folder's CSVs with the run parsed from the folder name
    (``_metadata.file_path``)."""
    df = (spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True)
          .csv(f"{root.rstrip('/')}/*/{file_name}").select("*", "_metadata.file_path"))
    p = F.col("file_path")
    return df.withColumns({
        "folder": F.regexp_extract(p, r"/([^/]+)/[^/]+$", 1),
        "file": F.regexp_extract(p, RUN_NAME, 1),
        "mode": F.regexp_extract(p, RUN_NAME, 2).cast("int"),
        "vector": F.regexp_extract(p, RUN_NAME, 3).cast("int"),
        "steps": F.regexp_extract(p, RUN_NAME, 4).cast("int"),
        "sampling": F.regexp_extract(p, RUN_NAME, 5),
    }).drop("file_path")


def read_resource_log(spark: SparkSession, path: str, cols: Sequence[str] | None = None) -> DataFrame:
    """Resource logs (text lines, then numeric ones; fields split on ','
    or tab).

    Each file's names come from its own header, its last text line with
    several fields.  A name that comes again gets ``_2``, ``_3`` ... (memory
    ``used``, then swap ``used_2``).  The result has ``source`` (file), the
    ``cols`` asked for (all names of all files, sorted, if not given) as
    doubles; a column that a file lacks is NULL.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("source"),
                                       F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))
    fields = F.transform(F.split("value", r"[,\t]"), lambda x: F.trim(F.regexp_replace(x, '"', "")))
    lines = raw.select("source", "_block", "_line", fields.alias("_fields"))
    numeric = F.col("_fields")[0].rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?$")
    text = lines.where(~numeric & (F.size("_fields") > 1))
    header = text.groupBy("source").agg(F.max_by("_fields", F.struct("_block", "_line")).alias("_h"))
    named = F.transform("_h", lambda x, i: F.concat(x, F.when(
        F.size(F.filter(F.slice("_h", 1, i), lambda y: y == x)) > 0,
        F.concat(F.lit("_"), (F.size(F.filter(F.slice("_h", 1, i), lambda y: y == x)) + 1).cast("string"))).otherwise("")))
    header = header.select("source", named.alias("_names"))
    if cols is None:
        cols = [r[0] for r in header.select(F.explode("_names").alias("n")).distinct().orderBy("n").collect() if r[0]]
    j = lines.where(numeric).join(header, "source")
    at = [F.try_element_at("_fields", F.nullif(F.array_position("_names", F.lit(c)), F.lit(0)).cast("int")).try_cast("double").alias(c) for c in cols]
    return j.select("source", *at)


def write_results(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """A10: result tables (run summary, classification report)."""
    write_flows(df.coalesce(1) if fmt == "csv" else df, path, fmt=fmt)
