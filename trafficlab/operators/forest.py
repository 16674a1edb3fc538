"""Random forest over binned rows, grown and scored without a whole tree in one place.

The forest is MLlib's: Poisson(1) bootstrap, at most 32 bins a feature, gini,
sqrt(features) drawn per node, a node splits while that lowers the impurity,
sibling leaves of one class are merged, trees vote with their class shares.
MLlib sends a histogram (20 KB) per open node and partition and keeps all nodes
on the driver; trees without a depth limit have nodes in proportion to the rows.
Here:

* Rows are binned once (a byte a feature) and staged.  Bags and the features of
  a node are hashes of (seed, tree, row) and (seed, tree, node), so no step needs
  them from another one and the forest is the same however it is cut.
* Nodes of more than ``LOCAL_ROWS`` bag rows (``top``, on the driver: in
  proportion to rows / LOCAL_ROWS) split by histograms that all tasks add up.
* The rows of a smaller node go to one task as blocks of bytes, which grows the
  rest of the tree level by level with the same histograms.  A subtree is one
  row of the staged table ``grown``.
* Scoring sends rows to the subtrees they end in, at most about ``PART_ROWS`` to
  a copy of one, and adds the votes up by row, in whole numbers.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import drop_staged, staged

# Bins as in MLlib; bag rows of a node that one task takes; rows scored by one
# copy of a subtree; histogram cells held at a time (64 MB); bytes of a forest sent to every task.
MAX_BINS = 32
LOCAL_ROWS = 200_000
PART_ROWS = 250_000
CELLS = 1 << 23
STREAM_BYTES = 64 << 20
VOTE = 1 << 40
MIN_GAIN = 1e-12
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(18)])
GROWN = "node int, tree int, depth int, leaves long, gains array<double>, feat binary, cut binary, left binary, off binary, cls binary, votes binary"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tree_key(seed: int, trees) -> np.ndarray:
    return _mix(np.atleast_1d(np.asarray(trees, np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + _mix(np.array([seed], np.uint64)))


def bag(seed: int, trees, ids: np.ndarray) -> np.ndarray:
    """Times each row (by id) is drawn into each tree."""
    u = _mix(_mix(ids.astype(np.uint64) + np.uint64(1))[:, None] + _tree_key(seed, trees)[None, :])
    return np.searchsorted(_POISSON, (u >> np.uint64(11)) * 2.0 ** -53, side="right").astype(np.uint8)


def drawn(seed: int, trees, heaps: np.ndarray, d: int, m: int) -> np.ndarray:
    """The ``m`` features each node may split on, ascending."""
    h = _mix(_tree_key(seed, trees) ^ _mix(heaps.astype(np.uint64)))
    h = _mix(h[:, None] + _mix(np.arange(1, d + 1, dtype=np.uint64))[None, :])
    return np.sort(np.argsort(h, axis=1, kind="stable")[:, :m], axis=1)


def add_counts(out: np.ndarray, slot, bins, y, w, subset, n_bins: int, k: int) -> None:
    """Add rows to the flat histograms (node, drawn feature, bin, class)."""
    m = subset.shape[1]
    at = ((slot[:, None] * m + np.arange(m)) * n_bins + np.take_along_axis(bins, subset[slot], 1)) * k + y[:, None]
    out += np.bincount(at.ravel(), weights=np.repeat(w, m), minlength=len(out))


def best_splits(hist: np.ndarray):
    """Of each node (node, feature, bin, class): feature position, bin, gain, left counts."""
    s, m, b, k = hist.shape
    left = np.cumsum(hist, axis=2)
    total = left[:, :, -1:, :]
    left = left[:, :, :-1, :]
    right = total - left
    nl, nr, n = left.sum(-1), right.sum(-1), total.sum(-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = ((left * left).sum(-1) / nl + (right * right).sum(-1) / nr - (total * total).sum(-1) / n) / n
    gain = np.where((nl > 0) & (nr > 0), gain, -1.0).reshape(s, -1)
    if gain.shape[1] == 0:
        return np.zeros(s, int), np.zeros(s, int), np.full(s, -1.0), np.zeros((s, k))
    best = gain.argmax(1)
    j, cut = best // (b - 1), best % (b - 1)
    return j, cut, gain[np.arange(s), best], left[np.arange(s), j, cut]


def grow(bins, w, y, seed: int, tree: int, heap: int, depth: int, max_depth: int, m: int, n_bins: int, k: int) -> dict:
    """The subtree below one node from all its rows, level by level."""
    d = bins.shape[1]
    feats, cuts, lefts, gains, counts, levels = [], [], [], [], [], []
    slot, heaps, made = np.zeros(len(y), np.int64), np.array([heap], np.uint64), 1
    w, y = w.astype(np.float64), y.astype(np.int64)
    step = max(1, CELLS // 8 // (m * n_bins * k))
    while len(heaps):
        size = len(heaps)
        here = np.bincount(slot * k + y, weights=w, minlength=size * k).reshape(size, k)
        feat, cut, left, gain = np.full(size, -1, np.int32), np.zeros(size, np.uint8), np.zeros(size, np.int32), np.zeros(size)
        opened = np.flatnonzero((here > 0).sum(1) > 1) if depth < max_depth else np.zeros(0, np.int64)
        rank = np.full(size, -1, np.int64)
        rank[opened] = np.arange(len(opened))
        slot = rank[slot]
        order = np.argsort(slot, kind="stable")
        order = order[np.searchsorted(slot[order], 0):]
        bins, w, y, slot = bins[order], w[order], y[order], slot[order]
        subset = drawn(seed, tree, heaps[opened], d, m)
        for a in range(0, len(opened), step):
            z = min(a + step, len(opened))
            lo, hi = np.searchsorted(slot, [a, z])
            hist = np.zeros((z - a) * m * n_bins * k)
            add_counts(hist, slot[lo:hi] - a, bins[lo:hi], y[lo:hi], w[lo:hi], subset[a:z], n_bins, k)
            j, c, g, _ = best_splits(hist.reshape(z - a, m, n_bins, k))
            ok = g > MIN_GAIN
            at = opened[a:z][ok]
            feat[at], cut[at], gain[at] = subset[a:z][np.arange(z - a), j][ok], c[ok], g[ok] * here[at].sum(1)
        split = np.flatnonzero(feat >= 0)
        left[split] = made + 2 * np.arange(len(split))
        made += 2 * len(split)
        child = np.full(size, -1, np.int64)
        child[split] = 2 * np.arange(len(split))
        node = opened[slot]
        stay = child[node] >= 0
        bins, w, y, node = bins[stay], w[stay], y[stay], node[stay]
        slot = child[node] + (bins[np.arange(len(y)), feat[node]] > cut[node])
        for to, x in ((feats, feat), (cuts, cut), (lefts, left), (gains, gain), (counts, here), (levels, np.full(size, depth, np.int32))):
            to.append(x)
        heaps = np.repeat(heaps[split] * np.uint64(2), 2) + np.tile(np.array([0, 1], np.uint64), len(split))
        depth += 1
    out = dict(feat=np.concatenate(feats), cut=np.concatenate(cuts), left=np.concatenate(lefts), gain=np.concatenate(gains),
               counts=np.concatenate(counts), depth=np.concatenate(levels))
    return compact(out, merge_siblings(out))


def merge_siblings(t: dict, firm=None) -> np.ndarray:
    """Take back splits whose children are leaves of one class (``firm``: ends that are no leaves).
    Returns the nodes still reached from the roots (level ``depth`` 0 or the first node)."""
    pred = t["counts"].argmax(1)
    leaf = t["feat"] < 0
    if firm is not None:
        leaf = leaf & ~firm
    for level in range(int(t["depth"].max()), int(t["depth"].min()) - 1, -1):
        at = np.flatnonzero((t["depth"] == level) & (t["feat"] >= 0))
        a = t["left"][at]
        at = at[leaf[a] & leaf[a + 1] & (pred[a] == pred[a + 1])]
        t["feat"][at], t["gain"][at], leaf[at] = -1, 0.0, True
    used = t["depth"] == t["depth"].min()
    for level in range(int(t["depth"].min()), int(t["depth"].max())):
        a = t["left"][np.flatnonzero((t["depth"] == level) & used & (t["feat"] >= 0))]
        used[a] = used[a + 1] = True
    return used


def compact(t: dict, used: np.ndarray) -> dict:
    """Only the used nodes; children stay neighbours."""
    new = np.cumsum(used) - 1
    out = {c: x[used] for c, x in t.items()}
    out["left"] = np.where(out["feat"] >= 0, new[out["left"]], 0).astype(np.int32)
    return out


def packed(node: int, tree: int, t: dict, d: int) -> dict:
    """A row of ``GROWN``; a leaf's votes are its class shares in units of 1 / VOTE."""
    leaf = t["feat"] < 0
    n = t["counts"].sum(1, keepdims=True)
    votes = np.where(leaf[:, None], np.floor(t["counts"] * float(VOTE) / n), 0).astype(np.int64)
    at, cls = np.nonzero(votes)
    off = np.searchsorted(at, np.arange(len(leaf) + 1)).astype(np.int32)
    gains = np.bincount(t["feat"][~leaf], weights=t["gain"][~leaf], minlength=d).astype(float)
    return dict(node=node, tree=tree, depth=int(t["depth"].max()), leaves=int(leaf.sum()), gains=gains.tolist(), feat=t["feat"].astype(np.int32).tobytes(),
                cut=t["cut"].astype(np.uint8).tobytes(), left=t["left"].tobytes(), off=off.tobytes(), cls=cls.astype(np.int32).tobytes(), votes=votes[at, cls].tobytes())


def walk(bins: np.ndarray, row: np.ndarray, node: np.ndarray, feat, cut, left) -> np.ndarray:
    """The node each (row, start node) ends in."""
    node = node.copy()
    go = np.arange(len(node))
    while len(go):
        go = go[feat[node[go]] >= 0]
        n = node[go]
        node[go] = left[n] + (bins[row[go], feat[n]] > cut[n])
    return node


def leaf_votes(bins: np.ndarray, r: dict):
    """(row, class, vote) of all rows in a packed subtree."""
    a = {c: np.frombuffer(r[c], t) for c, t in (("feat", np.int32), ("cut", np.uint8), ("left", np.int32), ("off", np.int32), ("cls", np.int32), ("votes", np.int64))}
    end = walk(bins, np.arange(len(bins)), np.zeros(len(bins), np.int64), a["feat"], a["cut"], a["left"])
    lo, many = a["off"][end], a["off"][end + 1] - a["off"][end]
    row = np.repeat(np.arange(len(bins)), many)
    at = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(len(row))
    return row, a["cls"][at], a["votes"][at]


def to_bins(x: np.ndarray, edges) -> np.ndarray:
    """Bins 0.. of each value: the edges below it (NaN: all)."""
    return np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(edges)], axis=1).astype(np.uint8)


def _array(features: str, df: DataFrame):
    from pyspark.ml.functions import vector_to_array
    return vector_to_array(F.col(features)) if df.schema[features].dataType.typeName() != "array" else F.col(features).cast("array<double>")


def _matrix(col, d: int, dtype) -> np.ndarray:
    """A list or binary Arrow column as a matrix of ``d`` columns."""
    if pa.types.is_binary(col.type):
        return np.frombuffer(b"".join(col.to_pylist()), dtype).reshape(len(col), d)
    return col.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(col), d)


def _edges(df: DataFrame, d: int) -> list[np.ndarray]:
    """Candidate thresholds from all rows: between all values of a feature that has few, else its quantiles."""
    def few(batches):
        seen = [np.zeros(0)] * d
        for b in batches:
            x = _matrix(b.column(0), d, np.float64)
            for i in range(d):
                if seen[i] is not None:
                    u = np.unique(np.concatenate([seen[i], x[:, i]]))
                    seen[i] = u[~np.isnan(u)]
                    seen[i] = seen[i] if len(seen[i]) <= MAX_BINS else None
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(d), pa.int32()), "v": pa.array([None if s is None else s.tolist() for s in seen], pa.list_(pa.float64()))})
    got = df.select("x").mapInArrow(few, "i int, v array<double>").groupBy("i").agg(
        F.max(F.col("v").isNull()).alias("many"), F.array_distinct(F.flatten(F.collect_list("v"))).alias("v")).collect()
    share = F.array(*[F.lit(i / MAX_BINS) for i in range(1, MAX_BINS)])
    real = lambda i: F.nullif(F.col("x")[i], F.lit(float("nan")))
    few_of = {r.i: np.sort(r.v) for r in got if not r.many and len(r.v) <= MAX_BINS}
    wide = [i for i in range(d) if i not in few_of]
    q = df.agg(*[F.percentile_approx(real(i), share, 10_000).alias(f"q{i}") for i in wide]).first() if wide else {}
    return [np.unique(q[f"q{i}"]) if i in wide else (few_of[i][:-1] + few_of[i][1:]) / 2 for i in range(d)]


def fit(df: DataFrame, features: str, label: str, num_trees: int, max_depth: int, seed: int, local_rows: int | None = None) -> "Forest":
    spark = df.sparkSession
    limit = local_rows or LOCAL_ROWS
    if max_depth > 30:
        raise ValueError("trees are at most 30 deep")
    raw = staged(df.select(_array(features, df).alias("x"), F.col(label).cast("double").alias("y")), "forest-rows")
    r = raw.agg(F.count(F.lit(1)).alias("n"), F.min("y").alias("lo"), F.max("y").alias("hi"), F.count("y").alias("ny"), F.min(F.size("x")).alias("d"),
                F.max(F.size("x")).alias("dx"), F.max((F.col("y") != F.floor("y")).cast("int")).alias("part")).first()
    if not r.n or r.ny != r.n or r.lo < 0 or r.part or r.d != r.dx:
        raise ValueError("a forest needs rows with equally many features and labels 0, 1, 2, ...")
    d, k, m = r.d, int(r.hi) + 1, math.ceil(math.sqrt(r.d))
    edges = _edges(raw, d)
    n_bins = max(len(e) for e in edges) + 1

    def binned(batches):
        for b in batches:
            x = to_bins(_matrix(b.column(1), d, np.float64), edges)
            yield pa.RecordBatch.from_pydict({"id": b.column(0), "bins": pa.array([v.tobytes() for v in x], pa.binary()), "y": b.column(2).cast(pa.int32())})
    rows = staged(raw.select(F.monotonically_increasing_id().alias("id"), "x", "y").mapInArrow(binned, "id long, bins binary, y int"), "forest-bins")
    drop_staged(raw)

    # top: nodes above the limit, by level
    trees = np.arange(num_trees)
    top = {"tree": trees, "depth": np.zeros(num_trees, int), "heap": np.ones(num_trees, int), "feat": np.full(num_trees, -1), "cut": np.zeros(num_trees, int),
           "left": np.zeros(num_trees, int), "gain": np.zeros(num_trees), "counts": np.zeros((num_trees, k))}

    def in_bags(b, feat, cut, left):
        """Bins, classes and, of all (row, tree) in a bag, row, weight and the top node it ends in."""
        x, y, w = _matrix(b.column(1), d, np.uint8), b.column(2).to_numpy(), bag(seed, trees, b.column(0).to_numpy())
        row, tree = np.nonzero(w)
        return x, y, row, w[row, tree], walk(x, row, tree, feat, cut, left)

    def roots(batches):
        s = np.zeros(num_trees * k)
        for b in batches:
            _, y, row, w, node = in_bags(b, top["feat"], top["cut"], top["left"])
            s += np.bincount(node * k + y[row], weights=w, minlength=len(s))
        yield pa.RecordBatch.from_pydict({"node": pa.array(range(num_trees), pa.int32()), "c": pa.array(s.reshape(num_trees, k).tolist(), pa.list_(pa.float64()))})
    sums = rows.mapInArrow(roots, "node int, c array<double>").select("node", F.posexplode("c").alias("i", "v")).groupBy("node", "i").agg(F.sum("v").alias("v"))
    for s in sums.collect():
        top["counts"][s.node, s.i] = s.v

    level = trees
    while len(level):
        c = top["counts"][level]
        level = level[(c.sum(1) > limit) & ((c > 0).sum(1) > 1) & (top["depth"][level] < max_depth)]
        fresh = []
        block = max(1, CELLS // (m * n_bins * k))
        for a in range(0, len(level), block):
            fresh += _top_splits(rows, level[a:a + block], top, in_bags, seed, d, m, n_bins, k)
        kids = []
        for node, feat, cut, gain, lc in sorted(fresh):
            at = len(top["tree"]) + len(kids)
            rest = top["counts"][node] - lc
            top["feat"][node], top["cut"][node], top["left"][node], top["gain"][node] = feat, cut, at, gain * top["counts"][node].sum()
            kids += [(node, 0, np.asarray(lc)), (node, 1, rest)]
        level = np.arange(len(top["tree"]), len(top["tree"]) + len(kids))
        if kids:
            up, side = np.array([x[0] for x in kids]), np.array([x[1] for x in kids])
            zero = np.zeros(len(kids), int)
            add = {"tree": top["tree"][up], "depth": top["depth"][up] + 1, "heap": top["heap"][up] * 2 + side, "feat": zero - 1, "cut": zero, "left": zero,
                   "gain": zero * 0.0, "counts": np.array([x[2] for x in kids])}
            top = {c: np.concatenate([top[c], add[c]]) for c in top}

    # below: the rows of each remaining node to one task
    c = top["counts"]
    small = (top["feat"] < 0) & (c.sum(1) <= limit) & ((c > 0).sum(1) > 1) & (top["depth"] < max_depth)
    t_feat, t_cut, t_left, t_tree, t_heap, t_depth = (top[x] for x in ("feat", "cut", "left", "tree", "heap", "depth"))

    def routed(batches):
        for b in batches:
            x, y, row, w, node = in_bags(b, t_feat, t_cut, t_left)
            yield from _blocks(node, np.where(small[node])[0], row, lambda i: {"x": x[row[i]], "w": w[i], "y": y[row[i]].astype(np.int32)})

    def grown(table):
        node = table.column("node")[0].as_py()
        x, w, y = (np.frombuffer(b"".join(table.column(n).to_pylist()), t) for n, t in (("x", np.uint8), ("w", np.uint8), ("y", np.int32)))
        t = grow(x.reshape(len(y), d), w, y, seed, int(t_tree[node]), int(t_heap[node]), int(t_depth[node]), max_depth, m, n_bins, k)
        return pa.Table.from_pylist([packed(node, int(t_tree[node]), t, d)], schema=_arrow_schema(spark_types))
    spark_types = _struct(GROWN)
    below = staged(rows.mapInArrow(routed, "node int, x binary, w binary, y binary").groupBy("node").applyInArrow(grown, spark_types), "forest-grown")
    drop_staged(rows)
    # a subtree of one leaf counts as a leaf of the top, where it may merge with its sibling
    firm = small.copy()
    firm[[r.node for r in below.where("leaves = 1").select("node").collect()]] = False
    used = merge_siblings(top, firm)
    return Forest(spark, num_trees, d, k, edges, top | {"used": used, "firm": firm}, below, features)


def _struct(ddl: str):
    from pyspark.sql.types import StructType
    return StructType.fromDDL(ddl)


def _arrow_schema(struct):
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(struct)


def _blocks(node, keep, row, columns, extra=None):
    """Rows grouped by node: one record (node, bytes of each column) per node, in batches of about 16 MB."""
    order = keep[np.argsort(node[keep], kind="stable")]
    starts = np.flatnonzero(np.r_[True, np.diff(node[order]) > 0]) if len(order) else np.zeros(0, int)
    ends = np.r_[starts[1:], len(order)]
    out, size = {}, 0
    for s, e in zip(starts, ends):
        one = {"node": int(node[order[s]])} | (extra or {}) | {c: v.tobytes() for c, v in columns(order[s:e]).items()}
        for c, v in one.items():
            out.setdefault(c, []).append(v)
            size += len(v) if isinstance(v, bytes) else 0
        if size > 1 << 24:
            yield _batch(out)
            out, size = {}, 0
    if out:
        yield _batch(out)


def _batch(out: dict):
    return pa.RecordBatch.from_pydict({c: pa.array(v, pa.binary() if isinstance(v[0], bytes) else pa.int32()) for c, v in out.items()})


def _top_splits(rows: DataFrame, nodes: np.ndarray, top: dict, in_bags, seed: int, d: int, m: int, n_bins: int, k: int) -> list:
    """The best splits of ``nodes``: (node, feature, bin, gain, left counts)."""
    feat, cut, left = top["feat"], top["cut"], top["left"]
    rank = np.full(len(feat), -1)
    rank[nodes] = np.arange(len(nodes))
    subset = drawn(seed, top["tree"][nodes], top["heap"][nodes].astype(np.uint64), d, m)
    cells = m * n_bins * k

    def counted(batches):
        hist = np.zeros(len(nodes) * cells)
        for b in batches:
            x, y, row, w, node = in_bags(b, feat, cut, left)
            at = rank[node]
            for lo in range(0, len(at), 1 << 18):
                keep = lo + np.flatnonzero(at[lo:lo + (1 << 18)] >= 0)
                add_counts(hist, at[keep], x[row[keep]], y[row[keep]].astype(np.int64), w[keep].astype(np.float64), subset, n_bins, k)
        hist = hist.reshape(len(nodes), cells)
        for i, h in zip(nodes, hist):
            at = np.flatnonzero(h)
            if len(at):  # cells that are not empty: no more than the task's rows fill
                yield pa.RecordBatch.from_pydict({"node": pa.array([i], pa.int32()), "at": pa.array([at.astype(np.int32).tobytes()], pa.binary()),
                                                  "v": pa.array([h[at].tobytes()], pa.binary())})
    out = _struct("node int, feat int, cut int, gain double, lc array<double>")

    def chosen(table):
        h = np.zeros(cells)
        for at, v in zip(table.column("at").to_pylist(), table.column("v").to_pylist()):
            h[np.frombuffer(at, np.int32)] += np.frombuffer(v)
        node = table.column("node")[0].as_py()
        j, c, g, lc = best_splits(h.reshape(1, m, n_bins, k))
        got = [dict(node=node, feat=int(subset[rank[node], j[0]]), cut=int(c[0]), gain=float(g[0]), lc=lc[0].tolist())] if g[0] > MIN_GAIN else []
        return pa.Table.from_pylist(got, schema=_arrow_schema(out))
    return [tuple(r) for r in rows.mapInArrow(counted, "node int, at binary, v binary").groupBy("node").applyInArrow(chosen, out).collect()]


class Forest:
    """A fitted forest: the top on the driver, the subtrees (``grown``) in a table."""

    def __init__(self, spark, num_trees, d, k, edges, top, grown, features):
        self.spark, self.getNumTrees, self.numFeatures, self.numClasses = spark, num_trees, d, k
        self.edges, self.top, self.features = edges, top, features
        taken = np.flatnonzero(top["firm"] & top["used"])
        self._leaves = np.flatnonzero((top["feat"] < 0) & top["used"] & ~top["firm"])
        kept = spark.createDataFrame(pd.DataFrame({"node": taken.astype(np.int32)}), "node int")
        ends = [packed(int(i), int(top["tree"][i]), {c: top[c][[i]] for c in ("feat", "cut", "gain", "counts", "depth")} | {"left": np.zeros(1, np.int32)}, d)
                for i in self._leaves]
        self.subtrees = grown.join(F.broadcast(kept), "node", "left_semi").unionByName(spark.createDataFrame(ends, _struct(GROWN)))

    def shape(self) -> DataFrame:
        """Depth and leaves of every tree."""
        return self.subtrees.groupBy("tree").agg(F.max("depth").alias("depth"), F.sum("leaves").cast("int").alias("leaves"))

    @property
    def featureImportances(self) -> np.ndarray:
        """Gains by feature, each tree's share of its own gains, averaged."""
        by = np.zeros((self.getNumTrees, self.numFeatures))
        s = self.subtrees.select("tree", F.posexplode("gains").alias("i", "v")).where("v > 0").groupBy("tree", "i").agg(F.sum("v").alias("v"))
        for r in s.collect():
            by[r.tree, r.i] += r.v
        at = np.flatnonzero((self.top["feat"] >= 0) & self.top["used"])
        np.add.at(by, (self.top["tree"][at], self.top["feat"][at]), self.top["gain"][at])
        of = by.sum(1, keepdims=True)
        out = np.divide(by, of, out=np.zeros_like(by), where=of > 0).sum(0)
        return out / out.sum() if out.sum() > 0 else out

    def _binned(self, df: DataFrame) -> DataFrame:
        edges = self.edges

        @F.pandas_udf("binary")
        def bins(x: pd.Series) -> pd.Series:
            return pd.Series([v.tobytes() for v in to_bins(np.stack(x.to_numpy()), edges)]) if len(x) else pd.Series([], dtype=object)
        return df.withColumn("_bins", bins(_array(self.features, df)))

    def _with_votes(self, df: DataFrame) -> DataFrame:
        """``_votes`` (a whole number per class) as the columns that MLlib's models add."""
        from pyspark.ml.functions import array_to_vector
        raw = F.transform("_votes", lambda v: v / F.lit(float(VOTE)))
        return df.withColumns({"rawPrediction": array_to_vector(raw), "probability": array_to_vector(F.transform(raw, lambda v: v / F.lit(float(self.getNumTrees)))),
                               "prediction": (F.array_position("_votes", F.array_max("_votes")) - 1).cast("double")}).drop("_votes")

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with rawPrediction, probability and prediction.  A stream is scored by
        a forest that every task can hold; others by batch (``streams.run_scored``)."""
        if df.isStreaming:
            return self._whole(df)
        d, k, trees = self.numFeatures, self.numClasses, self.getNumTrees
        feat, cut, left = self.top["feat"], self.top["cut"], self.top["left"]
        rows = staged(self._binned(df).withColumn("_id", F.monotonically_increasing_id()), "forest-scored")
        parts = max(1, -(-rows.count() // PART_ROWS))

        def routed(batches):
            for b in batches:
                ids, x = b.column(0).to_numpy(), _matrix(b.column(1), d, np.uint8)
                row, tree = np.repeat(np.arange(len(x)), trees), np.tile(np.arange(trees), len(x))
                node = walk(x, row, tree, feat, cut, left)
                part = int(_mix(ids[:1].astype(np.uint64))[0] % np.uint64(parts)) if len(ids) else 0
                yield from _blocks(node, np.arange(len(node)), row, lambda i: {"id": ids[row[i]].astype(np.int64), "x": x[row[i]]}, {"part": part})
        votes = _struct("_id long, c int, v long")

        def voted(table, tree):
            ids, x = (np.frombuffer(b"".join(table.column(n).to_pylist()), t) for n, t in (("id", np.int64), ("x", np.uint8)))
            if not len(ids):
                return pa.Table.from_pylist([], schema=_arrow_schema(votes))
            row, c, v = leaf_votes(x.reshape(len(ids), d), tree.to_pylist()[0])
            return pa.table({"_id": ids[row], "c": c, "v": v}).cast(_arrow_schema(votes))
        sent = rows.select("_id", "_bins").mapInArrow(routed, "node int, part int, id binary, x binary")
        copies = self.subtrees.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        found = sent.groupBy("node", "part").cogroup(copies.groupBy("node", "part")).applyInArrow(voted, votes)
        by_class = found.groupBy("_id", "c").agg(F.sum("v").alias("v"))
        of = by_class.groupBy("_id").agg(F.map_from_entries(F.collect_list(F.struct("c", "v"))).alias("_m"))
        of = of.select("_id", F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda c: F.coalesce(F.try_element_at("_m", c), F.lit(0))).alias("_votes"))
        return self._with_votes(rows.join(of, "_id")).select(*df.columns, "rawPrediction", "probability", "prediction")

    def _whole(self, df: DataFrame) -> DataFrame:
        size = self.subtrees.agg(F.sum(sum(F.length(c) for c in ("feat", "cut", "left", "off", "cls", "votes")))).first()[0] or 0
        if size > STREAM_BYTES:
            raise ValueError("this forest is too large for every task; score the stream with run_scored")
        sent = self.spark.sparkContext.broadcast([r.asDict() for r in self.subtrees.select("node", "feat", "cut", "left", "off", "cls", "votes").collect()])
        d, k, trees, feat, cut, left = self.numFeatures, self.numClasses, self.getNumTrees, self.top["feat"], self.top["cut"], self.top["left"]

        @F.pandas_udf("array<long>")
        def votes(b: pd.Series) -> pd.Series:
            x = np.frombuffer(b"".join(b), np.uint8).reshape(len(b), d)
            out = np.zeros((len(b), k), np.int64)
            row, tree = np.repeat(np.arange(len(x)), trees), np.tile(np.arange(trees), len(x))
            node = walk(x, row, tree, feat, cut, left)
            for r in sent.value:
                mine = row[node == r["node"]]
                at, c, v = leaf_votes(x[mine], r)
                np.add.at(out, (mine[at], c), v)
            return pd.Series(list(out))
        return self._with_votes(self._binned(df).withColumn("_votes", votes("_bins"))).drop("_bins")

    def save(self, path: str) -> None:
        """Three tables in one folder."""
        t = self.top
        top = pd.DataFrame({c: t[c] for c in ("tree", "depth", "heap", "feat", "cut", "left", "gain", "used", "firm")})
        top["node"], top["counts"] = range(len(top)), t["counts"].tolist()
        names = ["tree", "depth", "heap", "feat", "cut", "left", "gain", "used", "firm", "node", "counts"]
        ddl = "tree int, depth int, heap long, feat int, cut int, left int, gain double, used boolean, firm boolean, node int, counts array<double>"
        self.spark.createDataFrame(top[names], ddl).write.mode("overwrite").parquet(f"{path}/top")
        self.subtrees.write.mode("overwrite").parquet(f"{path}/subtrees")
        about = [(self.getNumTrees, self.numFeatures, self.numClasses, [e.tolist() for e in self.edges], self.features)]
        self.spark.createDataFrame(about, "trees int, d int, k int, edges array<array<double>>, features string").write.mode("overwrite").parquet(f"{path}/about")


def load(spark: SparkSession, path: str) -> Forest:
    a = spark.read.parquet(f"{path}/about").first()
    t = spark.read.parquet(f"{path}/top").orderBy("node").toPandas()
    top = {c: t[c].to_numpy() for c in ("tree", "depth", "heap", "feat", "cut", "left", "gain", "used", "firm")} | {"counts": np.array(t["counts"].tolist())}
    return Forest(spark, a.trees, a.d, a.k, [np.array(e) for e in a.edges], top, spark.read.parquet(f"{path}/subtrees"), a.features)
