"""I-Match fingerprints with several randomised lexicon subsets.

1. Document frequencies of all terms (lower-cased words without surrounding
   punctuation) over all documents, counted per Arrow batch before the shuffle.
2. The lexicon keeps the terms whose document frequency lies in the chosen
   band of inverse document frequency: between ``LOW`` and ``HIGH`` of the
   documents.  It has at most (distinct terms of a document on average) / LOW
   terms whatever the corpus size; that bound is checked before it is broadcast.
3. A document's distinct terms in the lexicon are sorted, and for each of
   ``SUBSETS`` random subsets of the lexicon those that fall into it are hashed
   together.  A subset's density halves with each level; a document uses the
   two levels at which a subset holds about one of its terms, and half as many,
   so that long and short texts are equally sensitive.  A document without any
   lexicon term uses all its terms.

The likeness of two fingerprints is the share of equal hashes among the
subsets that hold a term of either, at their common level.

Cases: a null or empty text has the empty fingerprint, and two of these are
alike (1); equal texts have equal fingerprints; documents are ordered by
doc_id (nulls first), equal ids by text; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import string

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import default_partitions, drop_staged, mix64, staged

LOW, HIGH = 0.0002, 0.2
SUBSETS = 64
EDGES = string.punctuation + "«»“”„‘’…–—¿¡·©"
#: Most lexicon terms that are broadcast (8 bytes each): the bound of LOW for 2,000 distinct terms a document.
MOST_TERMS = 10_000_000
_SEED = mix64(np.arange(1, SUBSETS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_EMPTY = ""


class Terms:
    """Term hashes of words and their place in a lexicon, kept per task (at most ``LIMIT`` words)."""

    LIMIT = 1_000_000

    def __init__(self, lexicon: np.ndarray | None = None):
        self.lexicon = lexicon
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.hash = np.zeros(1 << 14, np.uint64)
        self.known = np.zeros(1 << 14, bool)

    def _add(self, words: list[str]) -> None:
        low = len(self.index)
        high = low + len(words)
        while high > len(self.hash):
            self.hash = np.concatenate([self.hash, np.zeros_like(self.hash)])
            self.known = np.concatenate([self.known, np.zeros_like(self.known)])
        cores = [w.strip(EDGES) for w in words]
        self.hash[low:high] = [xxhash.xxh64_intdigest(c) if c else 0 for c in cores]
        self.index.update(zip(words, range(low, high)))
        if self.lexicon is not None and len(self.lexicon):
            h = self.hash[low:high]
            self.known[low:high] = self.lexicon[np.minimum(np.searchsorted(self.lexicon, h), len(self.lexicon) - 1)] == h

    def hashes(self, text: str | None) -> np.ndarray:
        """Sorted distinct term hashes of a text: those in the lexicon, or all if there are none."""
        if not text:
            return np.zeros(0, np.uint64)
        if len(self.index) > self.LIMIT:
            self.clear()
        words = list(set(text.lower().split()))
        ids = list(map(self.index.get, words))
        if None in ids:
            self._add([w for w, i in zip(words, ids) if i is None])
            ids = list(map(self.index.get, words))
        at = np.array(ids, np.int64)
        if self.lexicon is not None:
            known = at[self.known[at]]
            at = known if len(known) else at
        h = np.unique(self.hash[at])
        return h[1:] if len(h) and h[0] == 0 else h  # 0: no term


def _count(batches):
    terms = Terms()
    for b in batches:
        got = [terms.hashes(t.as_py()) for t in b.column(0)]
        h, n = np.unique(np.concatenate(got), return_counts=True) if got else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        for i in range(0, len(h), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(h[i:i + 10_000].view(np.int64)), pa.array(n[i:i + 10_000])], names=["term", "n"])


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> np.ndarray:
    """Sorted hashes of the terms in the band."""
    total = docs.count()
    counts = docs.select("text").mapInArrow(_count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("df"))
    band = staged(counts.where((F.col("df") >= low * total) & (F.col("df") <= max(high * total, 1))).select("term"), "imatch-lexicon")
    size = band.count()
    if size > MOST_TERMS:
        raise ValueError(f"{size} terms in the band; raise `low`")
    found = band.toArrow().column("term").to_numpy()
    drop_staged(band)
    return np.sort(found.view(np.uint64))


def fingerprint(h: np.ndarray) -> str:
    """``level:`` and the hashes of two levels; 4 hex digits a subset, 0000 where it holds no term."""
    if not len(h):
        return _EMPTY
    level = max(0, int(round(np.log2(len(h) / 0.8))))
    x = h[None, :] * _SEED[:, None]  # one draw per subset and term: the leading bits tell the level
    row, col = np.nonzero(x < np.uint64(1 << (64 - level))) if level else np.divmod(np.arange(x.size), x.shape[1])
    drawn = x[row, col]
    mixed = mix64(drawn)
    parts = []
    for k in (level, level + 1):
        inside = np.flatnonzero(drawn < np.uint64(1 << (64 - k))) if k else np.arange(len(drawn))
        hashed = np.zeros(SUBSETS, np.uint64)
        np.add.at(hashed, row[inside], mixed[inside])
        short = (mix64(hashed) >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)
        short[np.bincount(row[inside], minlength=SUBSETS) == 0] = 0
        parts.append(short.astype(">u2").tobytes().hex())
    return f"{level}:{parts[0]}:{parts[1]}"


def likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    (la, *pa_), (lb, *pb) = a.split(":"), b.split(":")
    la, lb = int(la), int(lb)
    if abs(la - lb) > 1:
        return 0.0
    common = max(la, lb)
    x, y = (np.frombuffer(bytes.fromhex(p), np.uint16) for p in (pa_[common - la], pb[common - lb]))
    held = int(((x != 0) | (y != 0)).sum())
    return int(((x == y) & (x != 0)).sum()) / held if held else 0.0


RESULT = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
          "edited_fingerprint string, near_edited double, near_next double")


def _edit(sent):
    def run(batches):
        terms = Terms(sent.value)
        held = None  # the row whose next document is awaited
        out = []

        def finish(row, after):
            doc_id, text, fp = row
            q = len(text) // 4
            edited = text[:len(text) - q] + after[1][:q] if after is not None else text
            changed = fingerprint(terms.hashes(edited))
            return (doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), fp, changed,
                    likeness(fp, changed), likeness(fp, after[2]) if after is not None else 1.0)

        def flush(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        bucket = None
        for b in batches:
            for own, extra, doc_id, text in zip(*(b.column(i) for i in range(4))):
                own, text = own.as_py(), text.as_py() or ""
                if bucket != own:
                    held, bucket = None, own
                h = terms.hashes(text)
                row = (doc_id.as_py(), text, fingerprint(h))
                if held is not None:
                    out.append(finish(held, row))
                held = None if extra.as_py() else row
                if len(out) >= 2000:
                    yield flush(out)
                    out = []
        if out:
            yield flush(out)

    return run


def _rank(bounds: list[int], x):
    """Number of bounds at or below ``x``, by a coarse and a fine look-up."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    fine = F.array(*[F.lit(int(v)) for v in bounds])
    coarse = F.array(*[F.lit(int(v)) for v in bounds[::step]])
    block = F.size(F.filter(coarse, lambda v: v <= x))
    inside = F.slice(fine, F.greatest(block - 1, F.lit(0)) * step + 1, F.lit(step))
    return F.greatest(block - 1, F.lit(0)) * step + F.size(F.filter(inside, lambda v: v <= x))


def compare_edits(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """Fingerprints of every text and of its edited text, as ``RESULT``.

    Documents are dealt to ranges of doc_id; the first document of a range is
    also sent to the range before it (the very first to the last one), where
    it only serves as the next document.
    """
    spark = docs.sparkSession
    parts = default_partitions(spark)
    words = spark.sparkContext.broadcast(lexicon(docs, low, high))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # range bounds from doc_id alone: at most `parts` numbers
    bounds = rows.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10_000)).first()[0] if parts > 1 else None
    ranged = rows.withColumn("range", F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(_rank(sorted(set(bounds or [])), F.col("doc_id"))))
    # the first row of each range, by (doc_id, text): one row per range
    order = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", F.xxhash64("text").alias("h"))
    firsts = [(r["range"], r["first"]["doc_id"]) for r in ranged.groupBy("range").agg(F.min(order).alias("first")).orderBy("range").collect()]
    n = len(firsts)
    if not firsts:
        return spark.createDataFrame([], RESULT)
    # by range: its first doc_id and the range before it (before the first one: the last)
    first = F.create_map(*[x for own, doc_id in firsts for x in (F.lit(own), F.lit(doc_id).cast("long"))])
    lead = F.create_map(*[x for i in range(n) for x in (F.lit(firsts[i][0]), F.lit(firsts[i - 1][0]))])
    head = F.when(F.col("doc_id").eqNullSafe(first[F.col("range")]), lead[F.col("range")])
    dealt = ranged.withColumn("to", F.explode(F.array_compact(F.array(
        F.struct(F.col("range").alias("range"), F.lit(False).alias("extra")),
        F.when(head.isNotNull(), F.struct(head.alias("range"), F.lit(True).alias("extra"))),
    )))).select(F.col("to.range").alias("range"), F.col("to.extra").alias("extra"), "doc_id", "text")
    placed = dealt.repartition(parts, "range").sortWithinPartitions("range", "extra", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    return placed.mapInArrow(_edit(words), RESULT)
