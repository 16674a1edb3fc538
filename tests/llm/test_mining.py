"""Resampling, token counts and hard negatives against plain versions over whole inputs."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from trafficlab.llm import hard_negatives, resample, token_counts
from trafficlab.llm.common import utf8

from test_llm import empty, hostile, prose

SF001 = "/root/testdata/sf0.001"


# ---------------------------------------------------------------- resampling
def plain_features(text, ngrams, buckets):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return [zlib.crc32(" ".join(w[i:i + n]).encode()) % buckets for n in range(1, ngrams + 1) for i in range(len(w) - n + 1)], len(w)


def plain_resample(docs, target, percent, min_words, buckets, seed=7):
    s, t = [0] * buckets, [0] * buckets
    for out, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            for b in plain_features(x, 2, buckets)[0]:
                out[b] += 1
    gain = [math.floor(1000 * math.log((t[i] + 1) * (sum(s) + buckets) / ((s[i] + 1) * (sum(t) + buckets)))) for i in range(buckets)]
    rows = []
    for i, x in docs:
        f, n = plain_features(x, 2, buckets)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32))), n])
    enough = sorted((r for r in rows if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(enough):
        r.append(k + 1 if k < len(enough) * percent // 100 else None)
    return sorted(map(str, (tuple(r[:4]) + ((r[5] if len(r) > 5 else None),) for r in rows)))


@pytest.mark.parametrize("chunk", [1, 9, 60, 1 << 20])
@pytest.mark.parametrize("ngrams", [1, 2, 3])
def test_features_equal_plain_ones(chunk, ngrams):
    r = random.Random(3)
    parts = ["a", "B", "zz9", " ", "  ", "é", "漢字", "\x00", "-", "x" * 70, "\n", "Straße"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 60))) for _ in range(80)] + [None, ""]
    got = [([], [0]) for _ in texts]
    for doc, bucket, owner in resample.Features(10_000, ngrams, chunk).batches(*utf8(pa.array(texts))):
        for d, b in zip(doc.tolist(), bucket.tolist()):
            got[d][0].append(b)
        for d in owner.tolist():
            got[d][1][0] += 1
    assert [(sorted(f), n) for f, (n,) in got] == [(sorted(f), n) for f, n in (plain_features(t, ngrams, 10_000) for t in texts)]


def test_resample_hostile(spark):
    docs, rows = hostile(spark)
    docs = docs.withColumnRenamed("shard", "weight")  # clashes with a made column
    target = [prose(3, 90), None, "", "漢字 naïve one two three", "漢字 naïve one two three"]
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    for chunk, percent in ((1 << 20, 40), (300, 100)):
        out = resample.resample(docs, bench, percent=percent, min_words=3, buckets=512, carry=["doc_id", "weight"], chunk_bytes=chunk)
        assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        assert sorted(str(tuple(r)) for r in out.collect()) == plain_resample([r[:2] for r in rows], target, percent, 3, 512)
    assert resample.resample(empty(spark), bench).count() == 0
    none = resample.resample(docs, bench.limit(0), min_words=3, buckets=512, carry=["doc_id"])
    assert sorted(str(tuple(r)) for r in none.collect()) == plain_resample([r[:2] for r in rows], [], 25, 3, 512)


def test_resample_draws_the_target(spark):
    near = [(i, " ".join(random.Random(i).choices(["ka", "lo", "mi"], k=40))) for i in range(200)]
    far = [(1000 + i, " ".join(random.Random(i).choices(["ten", "sor", "ve"], k=40))) for i in range(600)]
    docs = spark.createDataFrame(near + far, "doc_id bigint, text string")
    bench = spark.createDataFrame([(t,) for _, t in near[:20]], "text string")
    drawn = [r["doc_id"] for r in resample.resample(docs, bench, carry=["doc_id"]).where("rank is not null").collect()]
    assert len(drawn) == 200 and sum(i < 1000 for i in drawn) > 150


# ---------------------------------------------------------------- token counts
def library_counts(name, texts):
    path = public_tokenizers.path(name)
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        return [len(model.encode(t or "", add_special_tokens=False).ids) for t in texts]
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    return [len(model.encode(t or "")) for t in texts]


PARTS = [" ", "  ", "\n", "\t", "a", "Zb", "don't", "'s", "12", "3", "!!", "...", "<|endoftext|>", "漢字", "。", "é", " ", "’", "²", "_", "🙂", "<|", "<s>", "▁"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_split_texts_have_the_whole_texts_counts(name):
    r = random.Random(5)
    texts = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 50))) for _ in range(600)] + [None, "", " ", "a" * 5000, prose(1, 3000), "漢" * 3000]
    want = library_counts(name, texts)
    for piece, batch in ((1, 50), (7, 1000), (100, 1 << 20)):
        counter = token_counts.Counter(public_tokenizers.path(name), piece, batch)
        assert counter.cut is not None
        assert len(list(counter.pieces(prose(1, 3000)))) > 50
        assert counter.counts(texts).tolist() == want


def test_encoder_calls_hold_equal_bytes():
    counter = token_counts.Counter(public_tokenizers.path("byte_bpe_50k.json"), 500, 4000)
    sizes, encode = [], counter.encode
    counter.encode = lambda texts: sizes.append(sum(map(len, texts))) or encode(texts)
    counter.counts([prose(1, 5000), "x", prose(2, 300)] * 3)
    assert max(sizes) <= 2 * 4000 and min(sizes) >= 1000


def test_count_tokens_hostile(spark):
    docs, rows = hostile(spark)
    docs = docs.withColumnRenamed("shard", "n_bytes")
    out = token_counts.count_tokens(docs, limit=100, piece_chars=200)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "size", "score", "n_bytes", "n_tokens", "over_limit"]
    got = out.collect()
    assert len(got) == len(rows)
    assert [r["n_tokens"] for r in got] == library_counts(token_counts.TOKENIZER, [r["text"] for r in got])
    assert all(r["n_bytes"] == len((r["text"] or "").encode()) and r["over_limit"] == (r["n_tokens"] > 100) for r in got)
    assert token_counts.count_tokens(empty(spark)).count() == 0


def test_op12_counts_whole_documents(spark):
    from trafficlab.llm.queries import op12_token_counts

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in op12_token_counts(spark, SF001).collect()}
    want = dict(zip(texts, library_counts("byte_bpe_50k.json", texts.values())))
    assert got == {i: (len((t or "").encode()), want[i], want[i] > 1024) for i, t in texts.items()}


# ---------------------------------------------------------------- hard negatives
EMBEDDINGS = "vec_id bigint, label int, embedding array<float>, rank string"


def plain_mine(rows, every=50, positives=5, negatives=3, low=50, high=95):
    rows = [(i, int(c), [math.floor(256 * float(np.float32(x))) for x in v]) for i, c, v in rows
            if i is not None and c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, c, v in rows:
        if i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, d == c) for j, d, w in rows if j != i]
        for s, j, _ in sorted(x for x in scored if x[2])[:positives]:
            fit = sorted((t, k) for t, k, same in scored if not same and 50 * -s <= 100 * -t and 100 * -t <= 95 * -s)
            out += [(i, j, n + 1, k, -s, -t) for n, (t, k) in enumerate(fit[:negatives])]
    return sorted(out)


def vectors(seed, n, dim, centres=0, labels=4):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dim))
    if centres:
        x = 0.05 * x + r.normal(size=(centres, dim))[r.integers(0, centres, n)]
    x /= np.linalg.norm(x, axis=1)[:, None]
    return [(i, int(r.integers(0, labels)), x[i].tolist()) for i in range(n)]


def mined(spark, rows, **how):
    df = spark.createDataFrame([(*r, "clash") for r in rows], EMBEDDINGS).repartition(3)
    return sorted(tuple(r) for r in hard_negatives.mine(df, **how).collect())


def test_mining_equals_all_pairs(spark):
    rows = vectors(1, 600, 8)
    rows += [(i, i % 3, rows[7][2]) for i in range(1000, 1120)]  # one vector many times
    rows += [rows[50], rows[100], rows[100], rows[3]]  # repeated anchors and rows
    rows += [(None, 1, rows[0][2]), (2000, None, rows[0][2]), (2050, 1, None), (2100, 1, [0.5, None]), (2150, 1, [float("nan")] * 8), (2200, 1, [float("inf")] * 8),
             (2250, 1, []), (2300, 2, [0.0] * 8), (2350, 1, [0.25, -0.5]), (2400, 1, [3.0] * 12), (-50, 0, [-0.3] * 8)]
    want = plain_mine(rows)
    assert len(want) > 150
    for how in ({}, dict(group_bytes=500, stripes=2, members=3, block=40, step=7), dict(stripes=5, members=16, block=100, step=16)):
        assert mined(spark, rows, **how) == want
    assert mined(spark, [r for r in rows if r[0] is None or r[0] % 50], stripes=2) == []
    assert mined(spark, [], stripes=2) == []


def test_mining_large_components_stay_exact(spark):
    r = np.random.default_rng(5)
    rows = [(10 * i, i % 2, [float(x) for x in np.float32(r.normal(size=3) * 2e6)]) for i in range(120)]
    assert mined(spark, rows, stripes=2) == plain_mine(rows) != []


def cell_of(rows, members):
    vec = np.array([[math.floor(256 * x) for x in r[2]] for r in rows], np.int64)
    ids, labels = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    at = ids % 50 == 0
    cell = hard_negatives.Cell(vec[at], ids[at], labels[at], hard_negatives.Best(int(at.sum()), 5, np.full(int(at.sum()), -(1 << 62))), members=members)
    cell.block(vec, ids, labels, step=64)
    return cell, vec, ids, labels


def test_walk_stops_early_and_shares_one_list():
    rows = vectors(2, 6000, 16, centres=30)
    cell, vec, ids, labels = cell_of(rows, 8)
    assert cell.listed == 6000 * 120
    assert cell.walked < 0.25 * cell.listed
    scores = vec[ids % 50 == 0] @ vec.T
    for a, i in enumerate(ids[ids % 50 == 0]):
        fit = sorted((-s, j) for s, j, c in zip(scores[a].tolist(), ids.tolist(), labels.tolist()) if c == labels[i] and j != i)[:5]
        assert list(zip((-cell.best.score[a]).tolist(), cell.best.id[a].tolist())) == fit


def test_clusters_are_bounded_and_whole():
    x = np.concatenate([np.ones((900, 4)), np.random.default_rng(1).normal(size=(300, 4)), np.zeros((50, 4))])
    found = hard_negatives.clusters(x, 32)
    assert max(map(len, found)) <= 32
    assert sorted(np.concatenate(found).tolist()) == list(range(len(x)))


def test_anchor_groups_are_bounded(spark):
    rows = [(50 * i, 1, [1.0, 0.0]) for i in range(3000)] + vectors(3, 500, 2)
    df = spark.createDataFrame(rows, "vec_id bigint, label bigint, vector array<double>").selectExpr(
        "monotonically_increasing_id() as number", "vec_id", "label", "transform(vector, x -> bigint(floor(256 * x))) as vector")
    sizes = [r["count"] for r in hard_negatives._with_groups(df, 7, 500, 2).groupBy("group").count().collect()]
    assert sum(sizes) == 3500 and max(sizes) < 700


