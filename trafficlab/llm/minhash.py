"""b-bit MinHash near-duplicate detection with exact confirmation.

1. Each text becomes a set of distinct 5-word shingles (64-bit hashes of the
   word sequence; A-Z lower-cased).  Equal sets are folded to one
   representative, so exact copies cost nothing further.
2. ``HASHES`` min-wise minima are taken.  Bands of minima, as many rows each as
   keep the missed share of threshold pairs below ``MISSED`` (0.85: 24 bands of
   6, 0.80: 36 bands of 4), give bucket keys; the low ``BITS`` bits of every minimum are packed into a
   signature.
3. Buckets shared by several representatives give candidates.  Within a bucket
   the similarity of two signatures is estimated from the number of equal
   b-bit slots (XOR, fold, bit count), corrected for chance collisions.  Pairs
   whose estimate is not ``MARGIN`` below the threshold connect; a bucket emits
   only a spanning forest, so output grows with its members, not with pairs.
   Connected components of these forests are the clusters.
4. Within a cluster all sets are compared exactly; linked documents
   (100 * intersection >= percent * union) connect, again by a spanning forest
   per task.  Components of the confirmed links are the result.

Large buckets and clusters are cut into blocks of bounded size (clusters by
rows and by shingles, intersections are counted tile by tile); every pair of
blocks is one task group, so no task holds an unbounded group and no pair of a
group is left out.  A link at the threshold shares no band with a chance of
1.2e-5 at 0.85 and 6e-9 at 0.80, and is missed then unless other links join
its documents.

Cases: a null or empty text has no shingles and links with nothing; shorter
texts than five words are one shingle; rows with the same doc_id count as one
document; a null doc_id is kept with a null component; ties go to the smallest
doc_id; an empty table gives no rows; other columns are ignored or carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import default_partitions, doc_chunks, drop_staged, mix64, staged, utf8
from .components import components

SHINGLE = 5
HASHES, BITS = 144, 4
#: Most pairs at the threshold, as a share, that have no band in common.
MISSED = 2e-5
#: Five standard deviations of the estimate at the threshold.
MARGIN = 0.16
#: About the most rows of a bucket or cluster and the most shingles of a cluster in one block.
BLOCK_ROWS, BLOCK_SHINGLES = 2048, 1_000_000
#: Rows and shingles whose intersections are counted at once.
TILE_ROWS, TILE_SHINGLES = 1024, 4096
CHUNK = 1 << 20

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_MUL = _rng.integers(1, 2**32, HASHES, dtype=np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 2**32, HASHES, dtype=np.uint32)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(x: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, x, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


class Shingler:
    """Word and shingle hashes of many texts at once."""

    def __init__(self):
        self.grow(1 << 16)

    def grow(self, n: int) -> None:
        self.up, self.down = _powers(_BASE, n), _powers(_INVERSE, n)

    def shingles(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shingle hashes and the first shingle of each text (n + 1 entries), repeats included."""
        if len(buf) + 1 > len(self.up):
            self.grow(2 * len(buf) + 2)
        if not len(buf):
            return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
        space = _SPACE[buf]
        opens = np.concatenate(([True], space[:-1]))
        opens[off[:-1][off[:-1] < len(buf)]] = True  # a text's first byte
        closes = np.concatenate((space[1:], [True]))
        closes[off[1:][off[1:] > 0] - 1] = True
        start = np.flatnonzero(opens & ~space)
        end = np.flatnonzero(closes & ~space) + 1
        prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[buf] * self.up[:len(buf)])))
        word = mix64((prefix[end] - prefix[start]) * self.down[start] + (end - start).astype(np.uint64))
        first = np.searchsorted(start, off)  # first word of each text
        count = np.diff(first)
        made = np.where(count >= SHINGLE, count - SHINGLE + 1, np.minimum(count, 1))
        at = np.concatenate(([0], np.cumsum(made)))
        h = np.zeros(at[-1], np.uint64)
        base = np.repeat(first[:-1] - at[:-1], made) + np.arange(at[-1])  # first word of each shingle
        size = np.repeat(np.minimum(count, SHINGLE), made)
        for i in range(SHINGLE):
            has = i < size
            h[has] = mix64(h[has] * _BASE + word[base[has] + i] + np.uint64(i + 1))
        return h, at


def minima(h: np.ndarray) -> np.ndarray:
    """The ``HASHES`` minima of a non-empty shingle set."""
    x = (h >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 4096):
        part = x[i:i + 4096]
        np.minimum(out, (part[None, :] * _MUL[:, None] + _ADD[:, None]).min(1), out=out)
    return out


def pack(m: np.ndarray) -> bytes:
    """Low ``BITS`` bits of the minima, two to a byte."""
    low = (m & np.uint32((1 << BITS) - 1)).astype(np.uint8)
    return (low[0::2] | (low[1::2] << 4)).tobytes()


def missed(percent: int, rows: int) -> float:
    """Chance of a pair at the threshold to have no band of ``rows`` minima in common."""
    return (1 - (percent / 100) ** rows) ** (HASHES // rows)


def band_rows(percent: int) -> int:
    """Most rows a band, of those that divide ``HASHES``, that miss at most ``MISSED``."""
    return max((r for r in range(1, HASHES + 1) if HASHES % r == 0 and missed(percent, r) <= MISSED), default=1)


def bands(m: np.ndarray, rows: int) -> np.ndarray:
    k = m.reshape(-1, rows).astype(np.uint64)
    h = np.arange(len(k), dtype=np.uint64)
    for i in range(rows):
        h = mix64(h * _BASE + k[:, i])
    return h.view(np.int64)


def estimate(sig: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Collision-corrected similarity of all pairs of packed signatures (uint64 words)."""
    equal = np.full((len(sig), len(other)), HASHES, np.int64)
    for w in range(sig.shape[1]):
        x = sig[:, w, None] ^ other[None, :, w]
        x |= x >> np.uint64(2)
        x |= x >> np.uint64(1)
        equal -= np.bitwise_count(x & np.uint64(0x1111111111111111))
    chance = 2.0 ** -BITS
    return (equal / HASHES - chance) / (1 - chance)


def forest(n: int, linked) -> list[tuple[int, int]]:
    """(root, member) edges of the components of 0..n-1; ``linked(rows)`` gives their boolean rows."""
    todo, out = np.ones(n, bool), []
    for r in range(n):
        if not todo[r]:
            continue
        todo[r] = False
        front = np.array([r])
        while len(front):
            hit = linked(front).any(0) & todo
            front = np.flatnonzero(hit)
            todo[front] = False
            out += [(r, int(x)) for x in front]
    return out


SIGNATURE = "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, bands array<bigint>, sig binary"


def _sign(rows: int):
    def run(batches):
        shingler = Shingler()
        for b in batches:
            buf, off = utf8(b.column(1))
            n, a, c, keys, sigs = [], [], [], [], []
            for i, j in doc_chunks(off, CHUNK):
                h, at = shingler.shingles(buf[off[i]:off[j]], off[i:j + 1] - off[i])
                for k in range(j - i):
                    s = np.unique(h[at[k]:at[k + 1]])
                    n.append(len(s))
                    if not len(s):
                        a.append(None)
                        c.append(None)
                        keys.append(None)
                        sigs.append(None)
                        continue
                    a.append(int(np.bitwise_xor.reduce(mix64(s)).view(np.int64)))
                    c.append(int(np.add.reduce(mix64(s ^ _BASE)).view(np.int64)))
                    m = minima(s)
                    keys.append(bands(m, rows))
                    sigs.append(pack(m))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                names=["doc_id", "n_shingles", "set_a", "set_b", "bands", "sig"])
    return run


def _sets(batches):
    """(doc_id, set): the sorted distinct shingles as bytes."""
    shingler = Shingler()
    for b in batches:
        buf, off = utf8(b.column(1))
        out = []
        for i, j in doc_chunks(off, CHUNK):
            h, at = shingler.shingles(buf[off[i]:off[j]], off[i:j + 1] - off[i])
            out += [np.unique(h[at[k]:at[k + 1]]).tobytes() for k in range(j - i)]
        yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *b.columns[2:], pa.array(out, pa.binary())], names=["doc_id", *b.schema.names[2:], "set"])


def _runs(batches, keys: int):
    """Tables of one group each from batches sorted by their first ``keys`` columns."""
    held = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [np.asarray(b.column(k)) for k in range(keys)]
        cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        for i, j in zip(np.append(0, cut), np.append(cut, b.num_rows)):
            key = tuple(c[i] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(i, j - i))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _edges(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int64()), pa.array([y for _, y in rows], pa.int64())], names=["a", "b"])


def _batched(pairs, size: int = 50_000):
    out = []
    for p in pairs:
        out += p
        if len(out) >= size:
            yield _edges(out)
            out = []
    yield _edges(out)


def _similar(cut: float):
    def run(batches):
        def groups():
            for t in _runs(batches, 3):
                ids = t.column("rep").to_numpy()
                sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint64).reshape(len(ids), -1)
                if len(ids) < 2:
                    continue
                yield [(int(ids[r]), int(ids[m])) for r, m in forest(len(ids), lambda f, s=sig: estimate(s[f], s) >= cut)]
        return _batched(groups())
    return run


def _confirm(percent: int):
    """Exact links inside one cluster block pair."""

    def linked(sets: list[np.ndarray]) -> np.ndarray:
        n = len(sets)
        size = np.array([len(s) for s in sets], np.int64)
        if n == 2:
            both = len(np.intersect1d(*sets, assume_unique=True))
            return np.full((2, 2), both and 100 * both >= percent * (size.sum() - both))
        owner = np.repeat(np.arange(n), size)
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        new = np.concatenate(([True], flat[1:] != flat[:-1]))
        column = np.cumsum(new) - 1
        shared = np.bincount(column) >= 2  # a shingle of one set only meets nothing
        keep = shared[column]
        column, owner = (np.cumsum(shared) - 1)[column[keep]], owner[keep]
        ok = np.zeros((n, n), bool)
        for r in range(0, n, TILE_ROWS):
            tile = slice(r, min(n, r + TILE_ROWS))
            both = np.zeros((tile.stop - r, n), np.float32)
            for low in range(0, int(column[-1]) + 1 if len(column) else 0, TILE_SHINGLES):
                i, j = np.searchsorted(column, [low, low + TILE_SHINGLES])
                m = np.zeros((n, TILE_SHINGLES), np.float32)
                m[owner[i:j], column[i:j] - low] = 1
                both += m[tile] @ m.T
            both = both.astype(np.int64)
            ok[tile] = (both > 0) & (100 * both >= percent * (size[tile, None] + size[None, :] - both))
        return ok

    def run(batches):
        def groups():
            for t in _runs(batches, 3):
                ids = t.column("rep").to_numpy()
                _, first = np.unique(ids, return_index=True)  # repeated rows of a document count once
                ids = ids[first]
                if len(ids) < 2:
                    continue
                raw = t.column("set")
                ok = linked([np.frombuffer(raw[int(i)].as_py(), np.uint64) for i in first])
                yield [(int(ids[r]), int(ids[m])) for r, m in forest(len(ids), lambda f, k=ok: k[f])]
        return _batched(groups())
    return run


def _block_pairs(df: DataFrame, keys: list[str], blocks: str) -> DataFrame:
    """Each row once for every pair of blocks that holds its own block."""
    own = F.pmod(F.xxhash64("rep", F.lit(3)), F.col(blocks)).cast("int")
    return (
        df.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col(blocks).cast("int") - 1)))
        .withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})
        .drop("own", "other")
    )


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; one row per row of ``docs``."""
    spark = docs.sparkSession
    parts = default_partitions(spark)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = staged(slim.mapInArrow(_sign(band_rows(percent)), SIGNATURE), "minhash-signatures")
    reps = staged(
        signed.where("doc_id is not null and n_shingles > 0").groupBy("set_a", "set_b")
        .agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("n_shingles", "bands", "sig"), "doc_id").alias("s"))
        .select("set_a", "set_b", "rep", "s.*"),
        "minhash-representatives",
    )
    keyed = reps.select("rep", F.explode("bands").alias("key"))
    full = keyed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    # bucket members first, then their signatures: most representatives share no bucket
    members = staged(keyed.join(full, "key").withColumn("blocks", F.ceil(F.col("members") / BLOCK_ROWS)), "minhash-members")
    signs = reps.select("rep", "sig")
    buckets = (
        _block_pairs(members.join(signs, "rep"), ["key"], "blocks").select("key", "low", "high", "rep", "sig")
        .repartition(parts, "key", "low", "high").sortWithinPartitions("key", "low", "high", "rep")
    )
    near = staged(buckets.mapInArrow(_similar(percent / 100 - MARGIN), "a bigint, b bigint"), "minhash-near")
    clusters = components(near)

    sized = staged(
        clusters.join(reps.groupBy(F.col("rep").alias("node")).agg(F.max("n_shingles").alias("n")), "node"), "minhash-clusters")
    blocks = sized.groupBy("component").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_ROWS)).alias("blocks"))
    wanted = sized.join(blocks, "component").select(F.col("node").alias("doc_id"), "component", "blocks")
    # merge: the clustered documents grow with the corpus, so they are never broadcast
    sets = slim.join(wanted.hint("merge"), "doc_id").select("doc_id", "text", "component", "blocks").mapInArrow(
        _sets, "doc_id bigint, component bigint, blocks bigint, set binary").withColumnRenamed("doc_id", "rep")
    compared = (
        _block_pairs(sets, ["component"], "blocks").select("component", "low", "high", "rep", "set")
        .repartition(parts, "component", "low", "high").sortWithinPartitions("component", "low", "high", "rep")
    )
    links = staged(compared.mapInArrow(_confirm(percent), "a bigint, b bigint"), "minhash-links")
    found = components(links)

    of_set = reps.join(found, reps["rep"] == found["node"], "left").select(
        F.col("set_a").alias("__a"), F.col("set_b").alias("__b"), F.coalesce("component", "rep").alias("__c"))
    by_row = signed.select("doc_id", "n_shingles", "set_a", "set_b")
    out = by_row.join(of_set, (F.col("set_a") == F.col("__a")) & (F.col("set_b") == F.col("__b")), "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("__c", "doc_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    done = staged(out, "minhash-result")
    drop_staged(signed, reps, members, near, sized, links)
    return done
