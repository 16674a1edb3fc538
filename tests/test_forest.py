"""The forest: the same however its nodes are cut, against MLlib, in parts, on a stream, saved."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trafficlab.operators import forest as FO
from trafficlab.operators import ml as M
from trafficlab.operators.prep import assemble
from trafficlab.session import scratch_path
from trafficlab.streaming import streams as ST

COLS = ["a", "b", "c", "d", "e"]


@pytest.fixture(scope="module")
def data(spark):
    """Noisy classes 0, 1, 3; a constant, a two-valued and a repeated row."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(900):
        x = rng.normal(size=3)
        y = int(x[0] > 0) + 2 * int(x[1] > 0.5 and x[0] > 0) if rng.random() < 0.85 else int(rng.integers(0, 2))
        rows.append((i, float(y), *map(float, x), float(i % 2), 7.0))
    rows += [(900 + i, float(i % 2), 0.0, 0.0, 0.0, 1.0, 7.0) for i in range(60)]
    return assemble(spark.createDataFrame(rows, "i long, label double, " + ", ".join(f"{c} double" for c in COLS)), COLS).select("i", "label", "features").coalesce(3).cache()


def _answers(model, df):
    return {r.i: (r.prediction, tuple(r.probability)) for r in model.transform(df).collect()}


def test_cut_forest_is_the_whole_one(spark, data, monkeypatch):
    whole = FO.fit(data, "features", "label", 6, 30, 3)
    monkeypatch.setattr(FO, "CELLS", 1 << 11)
    cut = FO.fit(data, "features", "label", 6, 30, 3, local_rows=40)
    assert len(whole.top["tree"]) == 6 and len(cut.top["tree"]) > 60
    shape = [sorted(map(tuple, m.shape().collect())) for m in (whole, cut)]
    assert shape[0] == shape[1] and len(shape[0]) == 6
    assert np.allclose(whole.featureImportances, cut.featureImportances) and whole.featureImportances[4] == 0
    first = _answers(whole, data)
    monkeypatch.setattr(FO, "PART_ROWS", 100)
    assert first == _answers(cut, data) and len(first) == 960
    assert all(abs(sum(p) - 1) < 1e-9 and len(p) == 4 and p[2] == 0 for _, p in first.values())


def test_forest_is_like_mllibs(spark, data):
    from pyspark.ml.classification import RandomForestClassifier
    train, test = data.where("i % 3 > 0"), data.where("i % 3 = 0")
    ours = M.fit_forest(train, num_trees=60)
    mllib = RandomForestClassifier(numTrees=60, maxDepth=30, featureSubsetStrategy="sqrt", seed=1).fit(train)

    def right(model):
        return model.transform(test).agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]
    assert abs(right(ours) - right(mllib)) < 0.04
    leaves = [r.leaves for r in M.forest_shape(spark, ours).collect()]
    theirs = [(t.numNodes + 1) / 2 for t in mllib.trees]
    assert len(leaves) == 60 and abs(np.mean(leaves) / np.mean(theirs) - 1) < 0.08
    depths = [r.depth for r in M.forest_shape(spark, ours).collect()]
    assert abs(np.mean(depths) / np.mean([t.depth for t in mllib.trees]) - 1) < 0.1
    assert np.allclose(ours.featureImportances, mllib.featureImportances.toArray(), atol=0.04)


def test_best_split_by_brute_force():
    rng = np.random.default_rng(2)
    hist = rng.integers(0, 4, (20, 3, 6, 3)).astype(float)
    hist[:, 1:] = hist[:, :1, rng.permutation(6)]  # every feature holds the same rows
    for h, j, cut, gain, left in zip(hist, *FO.best_splits(hist)):
        def gini(c):
            return 1 - (c ** 2).sum() / c.sum() ** 2
        def of(f, b):
            lc, rc = h[f, :b + 1].sum(0), h[f, b + 1:].sum(0)
            n = lc.sum() + rc.sum()
            return gini(lc + rc) - lc.sum() / n * gini(lc) - rc.sum() / n * gini(rc) if lc.sum() and rc.sum() else -1
        best = max(of(f, b) for f in range(3) for b in range(5))
        assert gain == pytest.approx(best) == pytest.approx(of(j, cut)) and (left == h[j, :cut + 1].sum(0)).all()


def test_save_and_stream_by_batches(spark, data, monkeypatch):
    model = FO.fit(data, "features", "label", 4, 30, 1, local_rows=100)
    path = scratch_path(spark, "forest")
    M.save_model(model, path)
    batch = _answers(model, data)
    assert _answers(M.load_model(path), data) == batch
    src, out = scratch_path(spark, "forest-in"), scratch_path(spark, "forest-out")
    data.write.parquet(src)
    s = spark.readStream.schema(data.schema).option("maxFilesPerTrigger", 1).parquet(src)
    monkeypatch.setattr(FO, "STREAM_BYTES", 10)
    with pytest.raises(ValueError):
        ST.score_stream(model, s)
    ST.run_scored(model, s, out, scratch_path(spark, "forest-ck"), ["i", "prediction"])
    got = {r.i: r.prediction for r in spark.read.parquet(out).collect()}
    assert got == {i: p for i, (p, _) in batch.items()}


def test_labels_that_are_no_classes(spark):
    df = assemble(spark.createDataFrame([(0.5, 1.0), (1.0, 2.0)], "label double, a double"), ["a"])
    with pytest.raises(ValueError):
        M.fit_forest(df, num_trees=2)
