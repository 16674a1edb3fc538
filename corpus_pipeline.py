"""Corpus pipeline: toxicity, near-dedup, benchmark decontamination, mixing, sharding.

Each stage works on all rows its predecessor kept, read back from Parquet.
All stages but the last return the columns of ``documents``; the last one adds
size, text_crc32, law, shard, slot and grown_shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from trafficlab.llm import decontam, minhash, mixing, sharding, toxicity
from trafficlab.llm.common import default_partitions, staged, table

#: Similarity of near duplicates in percent.
NEAR_PERCENT = 80
SHARDS = 40

#: The model and the near-duplicate links have no SQL form.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    net = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, net).where("predicted = 0").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays; rows without a doc_id stay, repeated rows of a doc_id go."""
    kept = minhash.near_duplicates(docs, NEAR_PERCENT).where("kept and doc_id is not null").select("doc_id").distinct()
    known = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns)
    return known.unionByName(docs.where("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.find_contamination(docs, table(spark, sf_dir, "benchmark")).where("not contaminated").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document appears once for each copy of which at least half is taken, shuffled inside the mix's shards."""
    pieces = mixing.mix(docs).where("head and 2 * full >= size")
    cell = F.substring("shuffle_key", 1, 2)
    dealt = pieces.repartition(default_partitions(spark), "shard", cell).sortWithinPartitions("shard", "shuffle_key")
    return dealt.select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(docs, SHARDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
