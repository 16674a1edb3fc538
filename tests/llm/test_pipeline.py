"""The pipeline on sf0.001, stage by stage, against brute force."""

from __future__ import annotations

import sys

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

import corpus_pipeline as cp  # noqa: E402

from test_llm import brute_components  # noqa: E402
from trafficlab.llm.common import staged  # noqa: E402

SF001 = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    bench = [r["text"] for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(cp.STAGES):
        before = docs.select("doc_id", "text", "source").collect()
        docs = staged(stage(spark, docs, SF001), "test")
        after = docs.collect()
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "near_dedup":
            low, _ = brute_components(before, cp.NEAR_PERCENT)
            assert sorted(r["doc_id"] for r in after) == sorted(i for i, c in low.items() if i == c)
        elif name == "decontamination":
            gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
            assert gone == {r["doc_id"] for r in before if any(b in r["text"] for b in bench)}
        elif name == "mixing":
            assert {r["doc_id"] for r in after} <= {r["doc_id"] for r in before}
            count = {}
            for r in after:
                count[r["doc_id"]] = count.get(r["doc_id"], 0) + 1
            assert max(count.values()) <= 3
        elif name == "sharding":
            assert len(after) == len(before)
            assert {r["shard"] for r in after} <= set(range(cp.SHARDS))
