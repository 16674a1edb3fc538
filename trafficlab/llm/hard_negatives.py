"""Hard-negative mining with lists shared by clusters of anchors.

Every row is a vector with a label; a component x counts as ``floor(256 x)``.
The score of a row for an anchor is their integer inner product.  For each
anchor: its first ``positives`` other rows of the same label by (score
descending, vec_id), and for each of them the first ``negatives`` rows of
another label whose score lies between two hundredths of the positive's score.

The anchors are the stated query set.  They stand in groups of at most
``GROUP_BYTES``; the rows stand in stripes; a cell is one group and one stripe,
and cells are dealt to tasks by number.  In a cell the anchors come first and are
kept; the rows stream past in blocks:

* the anchors of a group are cut into clusters by bisection; a cluster knows its
  centroid and the widest angle b between the centroid and a member;
* for each cluster the block is sorted once by ``|i| cos(max(0, angle(i) - b))``:
  times the anchor's length it bounds the score of row i for every member;
* every member walks that one list from its head, some rows at a time, and
  stops for certain when the bound falls below the score that it still needs:
  the last of its best so far, which all earlier blocks have raised, and for
  negatives at least the lower end of the range.

Bounds carry a slack above the rounding of the angles, and scores are exact
whole numbers, so the result is that of comparing all pairs; only the work
depends on the clusters.  Two passes: positives, then, with the ranges known,
negatives.  A cell sends at most its members' best, and a window per anchor
keeps the first.

Rows are copied once per anchor group (a group holds some hundred thousand
anchors), anchors once per stripe; nothing is broadcast but group sizes.  Which
coarse cluster an anchor belongs to, and so its group, is learned from a sample
of ``SAMPLE_ANCHORS`` anchors (the documented bound); a cluster of any size is
spread over as many groups as it fills.

Cases: rows with a null id, label or vector, or a null or non-finite component,
take no part.  A row with the anchor's own id is never its positive or negative;
other repeated rows and repeated anchors count row by row.  Vectors of unequal
length are compared as if zeros followed the shorter; an empty vector scores 0.
Scores of 62 bits and more saturate.  An anchor without positives, a positive without
rows in its range, and an empty table give no rows.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import default_partitions, staged

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
#: Range of a negative's score, in hundredths of the positive's.
LOW, HIGH = 50, 95
#: Memory of one group's anchors (eight bytes a component).
GROUP_BYTES = 64 << 20
#: Rows sorted at once for a cluster, and rows taken from its list in a step.
BLOCK, STEP = 8192, 512
#: Most anchors in one cluster of a cell.
MEMBERS = 128
#: Anchors from which the coarse clusters are learned, and the most of those.
SAMPLE_ANCHORS, COARSE = 4096, 256
#: Added to a cluster's widest angle, above the rounding of an arc cosine.
ANGLE_SLACK = 1e-6
_BIG = 1 << 62


def quantised(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(SCALE) * x.cast("double")).cast("long"))


def usable(vec_id: Column, label: Column, vector: Column) -> Column:
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    return vec_id.isNotNull() & label.isNotNull() & F.coalesce(finite, F.lit(False))


# ---------------------------------------------------------------- inside a cell
def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of whole numbers, zeros behind the shorter ones."""
    col = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(col.offsets.to_numpy())
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _most(x: np.ndarray) -> int:
    """Greatest absolute value."""
    return max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of two matrices beyond the whole numbers of a double; saturating."""
    if a.shape[1] * _most(a) * _most(b) < _BIG:
        return a @ b.T
    return np.clip(a.astype(object) @ b.astype(object).T, 1 - _BIG, _BIG - 1).astype(np.int64)


def _lengths(x: np.ndarray) -> np.ndarray:
    f = x.astype(np.float64)
    return np.sqrt(np.einsum("ij,ij->i", f, f))


def _angles(x: np.ndarray, length: np.ndarray, centre: np.ndarray) -> np.ndarray:
    cos = (x.astype(np.float64) @ centre) / np.maximum(length, 1e-300)
    return np.where(length > 0, np.arccos(np.clip(cos, -1.0, 1.0)), 0.0)


def clusters(x: np.ndarray, members: int = MEMBERS) -> list[np.ndarray]:
    """Rows of ``x`` in clusters of at most ``members``, by bisection between two far directions."""
    unit = x / np.maximum(_lengths(x), 1e-300)[:, None]
    out, todo = [], [np.arange(len(x))] if len(x) else []
    while todo:
        at = todo.pop()
        if len(at) <= members:
            out.append(at)
            continue
        u = unit[at]
        far = u[np.argmin(u @ u.mean(axis=0))]
        other = u[np.argmin(u @ far)]
        side = u @ (far - other)
        order = np.argsort(side, kind="stable")
        cut = int(np.searchsorted(side[order], 0.0))
        if min(cut, len(at) - cut) * 8 < len(at):  # uneven or all alike: halves along the line
            cut = len(at) // 2
        todo += [at[order[:cut]], at[order[cut:]]]
    return out


class Best:
    """The first ``k`` candidates of each slot by (score descending, id), and the score still needed."""

    def __init__(self, slots: int, k: int, least: np.ndarray):
        self.k, self.least = k, least
        self.score = np.full((slots, k), -_BIG)
        self.id = np.zeros((slots, k), np.int64)
        self.need = least.copy()

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(slot):
            return
        touched = np.unique(slot)
        slot = np.concatenate([slot, np.repeat(touched, self.k)])
        score = np.concatenate([score, self.score[touched].ravel()])
        ids = np.concatenate([ids, self.id[touched].ravel()])
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        nth = np.arange(len(slot)) - np.searchsorted(slot, touched)[np.searchsorted(touched, slot)]
        keep = nth < self.k
        self.score[slot[keep], nth[keep]] = score[keep]
        self.id[slot[keep], nth[keep]] = ids[keep]
        self.need[touched] = np.maximum(self.least[touched], self.score[touched, -1])


class Cell:
    """One group of anchors, and the rows of one stripe that stream past it."""

    def __init__(self, vec: np.ndarray, ids: np.ndarray, labels: np.ndarray, best: Best, want: np.ndarray | None = None, members: int = MEMBERS):
        """``want``: for negatives (anchors x slots) the highest score wanted; None: positives, one slot each."""
        self.vec, self.ids, self.labels, self.best, self.want = vec, ids, labels, best, want
        self.float, self.most, self.length = vec.astype(np.float64), _most(vec), _lengths(vec)
        self.slots = 1 if want is None else want.shape[1]
        self.groups = []
        for at in clusters(vec, members):
            unit = self.float[at] / np.maximum(self.length[at], 1e-300)[:, None]
            centre = unit.mean(axis=0)
            centre = centre / max(np.linalg.norm(centre), 1e-300)
            self.groups.append((at, centre, float(_angles(self.float[at], self.length[at], centre).max()) + ANGLE_SLACK))
        self.walked = self.listed = 0

    def block(self, vec: np.ndarray, ids: np.ndarray, labels: np.ndarray, step: int = STEP) -> None:
        as_float, length = vec.astype(np.float64), _lengths(vec)
        small = vec.shape[1] * self.most * _most(vec) < 1 << 53  # products of doubles are exact
        need = self.best.need.reshape(-1, self.slots)
        for at, centre, widest in self.groups:
            bound = length * np.cos(np.maximum(_angles(as_float, length, centre) - widest, 0.0))
            order = np.argsort(-bound, kind="stable")  # the list of this cluster
            bound = bound[order]
            slack = 1.0 + 1e-6 * self.length[at] * length.max()
            self.listed += len(at) * len(order)
            alive = np.arange(len(at))
            for i in range(0, len(order), step):
                # certified: nothing from here on reaches what the member still needs
                alive = alive[bound[i] * self.length[at[alive]] + slack[alive] >= need[at[alive]].min(axis=1)]
                if not len(alive):
                    break
                who, rows = at[alive], order[i:i + step]
                self.walked += len(who) * len(rows)
                score = self.float[who] @ as_float[rows].T if small else _products(self.vec[who], vec[rows])
                self._take(who, score, ids[rows], labels[rows])

    def _take(self, who: np.ndarray, score: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        need = self.best.need.reshape(-1, self.slots)
        a, r = np.nonzero(score >= need[who].min(axis=1)[:, None])
        s, w = score[a, r].astype(np.int64), who[a]
        same = labels[r] == self.labels[w]
        if self.want is None:
            hit = same & (ids[r] != self.ids[w])
            self.best.add(w[hit], s[hit], ids[r][hit])
            return
        for j in range(self.slots):
            hit = ~same & (s <= self.want[w, j]) & (s >= need[w, j])
            self.best.add(w[hit] * self.slots + j, s[hit], ids[r][hit])


def _hundredths(score: np.ndarray, percent: int) -> np.ndarray:
    """floor(percent * score / 100) without overflow."""
    return score // 100 * percent + score % 100 * percent // 100


def _open(anchors: list, k: int, negative: tuple[int, int] | None, members: int) -> Cell:
    vec, ids, labels, number, goal = (np.concatenate(x) for x in zip(*anchors))
    if negative is None:
        cell = Cell(vec, ids, labels, Best(len(ids), k, np.full(len(ids), -_BIG)), members=members)
    else:
        low, high = -_hundredths(-goal, negative[0]), _hundredths(goal, negative[1])
        low[low > high] = _BIG  # an empty range, or no such positive
        cell = Cell(vec, ids, labels, Best(goal.size, k, low.ravel()), high, members)
    cell.number = number
    return cell


def _scan(width: int, slots: int, k: int, negative: tuple[int, int] | None, members: int, block: int, step: int):
    """Arrow function over partitions sorted by (cell, anchors first): the best of each cell."""
    names = ["anchor", "slot", "score", "id"]

    def results(cell: Cell):
        best = cell.best
        slot, nth = np.nonzero(best.score > -_BIG)
        out = [cell.number[slot // cell.slots], slot % cell.slots, best.score[slot, nth], best.id[slot, nth]]
        for i in range(0, len(slot), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[i:i + 10_000]) for x in out], names=names)

    def run(batches):
        now, state, anchors, rows = None, None, [], []

        def flush():
            if state is not None and rows:
                state.block(*(np.concatenate(x) for x in zip(*rows)), step=step)
                rows.clear()

        for b in batches:
            col = dict(zip(b.schema.names, b.columns))
            cells = col["cell"].to_numpy()
            kinds = col["is_row"].to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((cells[1:] != cells[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for i, j in zip([0, *cuts], [*cuts, len(cells)]):
                if i == j:
                    continue
                vector, ids, labels, number, goal = (col[n].slice(i, j - i) for n in ("vector", "vec_id", "label", "number", "goal"))
                if cells[i] != now:
                    flush()
                    if state is not None:
                        yield from results(state)
                    now, state, anchors = cells[i], None, []
                part = (_matrix(vector, width), ids.to_numpy(), labels.to_numpy())
                if not kinds[i]:
                    anchors.append((*part, number.to_numpy(), _matrix(goal, slots)))
                    continue
                if state is None:
                    if not anchors:
                        continue  # no anchor in this cell
                    state = _open(anchors, k, negative, members)
                for x in range(0, j - i, block):
                    rows.append(tuple(a[x:x + block] for a in part))
                    if sum(len(r[1]) for r in rows) >= block:
                        flush()
        flush()
        if state is not None:
            yield from results(state)

    return run


# ---------------------------------------------------------------- on Spark
def _with_groups(anchors: DataFrame, groups: int, capacity: int, width: int) -> DataFrame:
    """Anchors with their group: near ones together, a large cluster over several groups."""
    if groups == 1:
        return anchors.withColumn("group", F.lit(0))
    sample = anchors.orderBy(F.xxhash64("vec_id"), "number").limit(SAMPLE_ANCHORS).select("vector").toArrow()
    vec = _matrix(sample.column("vector"), width)
    unit = vec / np.maximum(_lengths(vec), 1e-300)[:, None]
    centres = np.stack([unit[at].mean(axis=0) for at in clusters(vec, -(-len(vec) // COARSE))])

    def nearest(batches):
        for b in batches:
            x = _matrix(b.column(b.num_columns - 1), width)
            at = np.argmax(x.astype(np.float64) @ centres.T, axis=1) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int64))], names=[*b.schema.names, "coarse"])

    coarse = staged(anchors.select("number", "vec_id", "label", "vector").mapInArrow(
        nearest, "number bigint, vec_id bigint, label bigint, vector array<bigint>, coarse bigint"), "mine-coarse")
    sizes = coarse.groupBy("coarse").agg(F.count("*").alias("n"))  # at most COARSE rows
    before = Window.orderBy("coarse").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("coarse", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    spread = F.pmod(F.xxhash64("number"), F.lit(1 << 20)) / F.lit(1 << 20)
    return coarse.join(F.broadcast(sizes), "coarse").withColumn(
        "group", F.least(F.floor((F.col("first") + spread * F.col("n")) / capacity), F.lit(groups - 1)).cast("int")).drop("coarse", "first", "n")


def _cells(anchors: DataFrame, rows: DataFrame, groups: int, stripes: int) -> DataFrame:
    """One partition per cell (group and stripe), anchors before rows."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cell = (F.col("group") * stripes + F.col("stripe")).cast("int").alias("cell")
    kept = ["vector", "vec_id", "label", "number", "goal"]
    a = anchors.withColumn("stripe", every(stripes)).select(cell, F.lit(False).alias("is_row"), *kept)
    r = rows.withColumns({"group": every(groups), "stripe": F.pmod(F.xxhash64("number"), F.lit(stripes)), "goal": F.array().cast("array<bigint>")})
    both = a.unionByName(r.select(cell, F.lit(True).alias("is_row"), *kept))
    return both.repartitionById(groups * stripes, F.col("cell")).sortWithinPartitions("cell", "is_row")


def mine(embeddings: DataFrame, every: int = 50, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
         group_bytes: int = GROUP_BYTES, stripes: int | None = None, members: int = MEMBERS, block: int = BLOCK, step: int = STEP) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``embeddings`` has vec_id, label (whole numbers) and embedding; the anchors
    are the rows whose vec_id is divisible by ``every``.
    """
    spark = embeddings.sparkSession
    rows = staged(embeddings.where(usable(F.col("vec_id"), F.col("label"), F.col("embedding"))).select(
        F.monotonically_increasing_id().alias("number"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        quantised(F.col("embedding")).alias("vector")), "mine-vectors")
    anchors = rows.where(F.col("vec_id") % every == 0)
    n_anchors = anchors.count()
    width = max(1, rows.agg(F.max(F.size("vector"))).first()[0] or 1)
    capacity = max(1, group_bytes // (8 * width))
    groups = max(1, -(-n_anchors // capacity))
    stripes = stripes or max(1, -(-default_partitions(spark) // groups))
    anchors = _with_groups(anchors, groups, capacity, width).withColumn("goal", F.array().cast("array<bigint>"))
    out = "anchor bigint, slot bigint, score bigint, id bigint"

    found = _cells(anchors, rows, groups, stripes).mapInArrow(_scan(width, 0, positives, None, members, block, step), out)
    best = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    first = staged(found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= positives)
                   .select("anchor", (F.col("nth") - 1).cast("long").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")),
                   "mine-positives")
    goals = first.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("slot", "positive_score"))).alias("g"))  # ``positives`` entries
    goal = F.slice(F.concat(F.col("g.positive_score"), F.array_repeat(F.lit(-_BIG), positives)), 1, positives)
    asked = anchors.drop("goal").join(goals.select(F.col("anchor").alias("number"), goal.alias("goal")), "number")

    found = _cells(asked, rows, groups, stripes).mapInArrow(_scan(width, positives, negatives, (low, high), members, block, step), out)
    best = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    ids = anchors.select(F.col("number").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return ranked.join(first, ["anchor", "slot"]).join(ids, "anchor").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
