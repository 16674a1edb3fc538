"""Exact substring dedup over a sampled suffix array built one bucket at a time.

A byte is removed when it is covered by a ``length``-byte string that also
starts in a document with a smaller doc_id.

A full suffix array of the corpus would move every suffix with its context.
Instead a cover sample of the suffixes stands for all of them: in every run of
``length`` bytes the ``GRAM``-byte string with the smallest hash is sampled
(the leftmost on ties), so two equal strings sample the same suffix at the same
distance.  That is the property a difference cover gives two arbitrary suffixes
(a common shift at which both are sampled), at a third of its density.

1. Texts are packed into blocks of about ``BLOCK_BYTES`` by a hash, in a
   bucketed table, so that the passes below reread them without a shuffle.
   Exact copies are found by hash and take no part.
2. Names: each block sends its distinct sampled strings and about how often it
   has them, cut into buckets of bounded size; a bucket is sorted at once and
   answers which names occur in several documents (one bit each) and which
   occur more than ``HOT_NAME`` times in the corpus (one more bit).
3. Suffix buckets: each block sends its repeated sampled suffixes with the
   bytes around them, once per distinct context, with the smallest doc_id.  A
   suffix bucket holds all suffixes with equal first ``GRAM`` bytes; one bucket
   at a time it names and sorts the ``length``-byte strings around its samples
   and answers, per suffix and shift, whether a smaller document has them.
   A hot name is not kept together: the block sends the 64-bit name of every
   ``length``-byte string around it, once, with the smallest doc_id, to a bucket
   chosen by the string.
4. Each block marks the covered bytes.

A short shared passage, or the edge of a long one, has other neighbours in each
document, so it makes one context per document, not per block.  The buckets by
name hold at most ``HOT_NAME`` contexts of one name; the strings around a hot
name are spread over all string buckets, where one string counts once per
block, however many documents have it.  Contexts and strings are compared by
64-bit names within equal 64-bit sample names.

Cases: a null or empty text has no bytes; a null doc_id is larger than any
other; rows with equal doc_id do not remove from each other; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import default_partitions, drop_staged, mix64, staged

LENGTH, GRAM = 50, 20
BLOCK_BYTES = 4 << 20
#: Names and contexts in one bucket, about.
BUCKET_NAMES, BUCKET_CONTEXTS = 1_500_000, 150_000
#: Occurrences of a name from which its strings are spread one by one (counted up to a factor of two too high).
HOT_NAME = 20_000
#: Contexts whose strings are named at once.
STEP = 20_000
LAST = np.iinfo(np.int64).max

_rng = np.random.default_rng(50)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0xD1342543DE82EF95)
_BACK = np.uint64(pow(0xD1342543DE82EF95, -1, 2**64))


@lru_cache(maxsize=4)
def _cumulative(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, _BACK, np.uint64)
    up[:1], down[:1] = 1, 1
    return np.cumprod(up), np.cumprod(down)


def gram_names(buf: np.ndarray, size: int) -> np.ndarray:
    """Name of the ``size`` bytes from every position (last axis)."""
    n = buf.shape[-1]
    up, down = (x[:n + 1] for x in _cumulative(1 << n.bit_length()))
    total = np.zeros(buf.shape[:-1] + (n + 1,), np.uint64)
    np.cumsum(_BYTE[buf] * up[:n], axis=-1, out=total[..., 1:])
    return mix64((total[..., size:] - total[..., :-size]) * down[:n - size + 1])


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while step * 2 <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    rest = width - step
    return np.minimum(x[:len(x) - rest], x[rest:]) if rest else x


class Block:
    """Sampled suffixes of the documents of one block, in a defined order."""

    def __init__(self, rows: pa.Table, copies: set, length: int, gram: int):
        order = sorted(
            (LAST if d is None else d, h, t or b"", d) for d, h, t in zip(
                rows.column("doc_id").to_pylist(), rows.column("h").to_pylist(), rows.column("text").cast(pa.large_binary()).to_pylist())
            if (d, h) not in copies)
        self.ids = np.array([o[0] for o in order], np.int64)
        self.raw = [o[3] for o in order]
        self.texts = [o[2] for o in order]
        self.length, self.gram = length, gram
        size = np.array([len(t) for t in self.texts], np.int64)
        self.start = np.concatenate(([0], np.cumsum(size)))
        self.buf = np.frombuffer(b"".join(self.texts), np.uint8)
        parts = [self._sample(i, j) for i, j in self._spans()]
        self.at, self.low, self.high, self.doc, self.name = (np.concatenate(x) for x in zip(*parts)) if parts else [np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64)]

    def _spans(self, limit: int = 4 << 20):
        """Document ranges of about ``limit`` bytes."""
        i, n = 0, len(self.texts)
        while i < n:
            j = i + 1
            while j < n and self.start[j + 1] - self.start[i] <= limit:
                j += 1
            yield i, j
            i = j

    def _sample(self, i: int, j: int):
        """Samples of documents i..j-1: position, first and last window start, document, name."""
        none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64))
        base, end = int(self.start[i]), int(self.start[j])
        if end - base < self.length:
            return none
        names = gram_names(self.buf[base:end], self.gram)
        pos = np.arange(len(names), dtype=np.uint64)
        bits = np.uint64(max(1, math.ceil(math.log2(len(names) + 1))))
        # the smallest name wins, the leftmost among equal leading bits
        least = _sliding_min(((names >> bits) << bits) | pos, self.length - self.gram + 1) & ((np.uint64(1) << bits) - np.uint64(1))
        where = np.arange(len(least))
        doc = np.searchsorted(self.start, where + base, "right") - 1
        inside = where + base + self.length <= self.start[doc + 1]
        where, doc, least = where[inside], doc[inside], least[inside].astype(np.int64)
        if not len(where):
            return none
        new = np.concatenate(([True], (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])))
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(where)) - 1
        at = least[first]
        return at + base, where[first] + base, where[last] + base, doc[first], names[at]

    def names(self):
        """Sorted distinct names, and a byte each: the logarithm of their count, and bit 7 when several documents of the block have them."""
        order = np.argsort(self.name, kind="stable")  # samples come by document, so owners stay in order
        name, owner = self.name[order], self.ids[self.doc[order]]
        head = np.concatenate(([True], name[1:] != name[:-1])) if len(name) else np.zeros(0, bool)
        first = np.flatnonzero(head)
        last = np.append(first[1:], len(name)) - 1 if len(first) else first
        power = np.ceil(np.log2(last - first + 1)).astype(np.uint8)
        return name[first], power | ((owner[first] != owner[last]).astype(np.uint8) << np.uint8(7))

    def _chosen(self, names: np.ndarray) -> np.ndarray:
        """Samples whose name is in a sorted array."""
        if not len(names) or not len(self.name):
            return np.zeros(0, np.int64)
        k = np.minimum(np.searchsorted(names, self.name), len(names) - 1)
        return np.flatnonzero(names[k] == self.name)

    def strings(self, hot: np.ndarray):
        """Strings around the samples whose name is in the sorted array ``hot``.

        The sorted distinct 64-bit names of the strings, their smallest doc_id; and for
        each occurrence its string, its first byte and whether a smaller document of the block has it.
        """
        use = self._chosen(hot)
        if not len(use):
            return None
        reach = self.length - self.gram
        padded = np.concatenate([np.zeros(reach, np.uint8), self.buf, np.zeros(self.length, np.uint8)])
        s = np.arange(reach + 1)
        keys, begins, docs = [], [], []
        for i in range(0, len(use), STEP):
            own = use[i:i + STEP]
            at = self.at[own]
            string = gram_names(padded[at[:, None] + np.arange(reach + self.length)], self.length)
            row, col = np.nonzero((s >= (at - self.high[own])[:, None]) & (s <= (at - self.low[own])[:, None]))
            keys.append(mix64(string[row, reach - col] + self.name[own][row]))
            begins.append(at[row] - col)
            docs.append(self.ids[self.doc[own]][row])
        key, doc = np.concatenate(keys), np.concatenate(docs)
        distinct, entry = np.unique(key, return_inverse=True)
        owner = np.full(len(distinct), LAST, np.int64)
        np.minimum.at(owner, entry, doc)
        return {"key": distinct, "owner": owner, "entry": entry, "begin": np.concatenate(begins), "own": doc > owner[entry]}

    def contexts(self, repeated: np.ndarray):
        """Entries of the samples whose name is in the sorted array ``repeated``.

        For each distinct (name, shifts, bytes around): the entry, ordered; and
        for each sample its entry and whether a smaller document of the block has it too.
        """
        use = self._chosen(repeated)
        if not len(use):
            return None
        at, low, high, doc, name = self.at[use], self.low[use], self.high[use], self.doc[use], self.name[use]
        reach = self.length - self.gram
        width = reach + self.length
        padded = np.concatenate([np.zeros(reach, np.uint8), self.buf, np.zeros(self.length, np.uint8)])
        around = padded[at[:, None] + np.arange(width)]
        # bytes no window of this sample reaches do not tell contexts apart
        column = np.arange(width) - reach + at[:, None]
        around[(column < low[:, None]) | (column >= high[:, None] + self.length)] = 0
        shift = np.stack([at - high, at - low], axis=1).astype(np.uint8)  # smallest and largest shift
        key = mix64(name + gram_names(np.concatenate([shift, around], axis=1), width + 2)[:, 0])
        _, first, entry = np.unique(key, return_index=True, return_inverse=True)
        owner = np.full(len(first), LAST, np.int64)
        np.minimum.at(owner, entry, self.ids[doc])
        return {"use": use, "entry": entry, "own": self.ids[doc] > owner[entry],
                "name": name[first], "shift": shift[first], "around": around[first], "owner": owner}


#: Kinds of answers to a block: its copies, repeated names, flags of contexts, hot names, flags of strings.
COPY, COLD, FLAGS, HOT, STRINGS = range(5)


def _copies(side: pa.Table) -> set:
    return {(d, h) for kind, d, h in zip(side.column("kind").to_pylist(), side.column("key").to_pylist(), side.column("h").to_pylist()) if kind == COPY}


def _bucket_of(name: np.ndarray, buckets: int) -> np.ndarray:
    return ((name >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


SIDE = "block bigint, kind int, key bigint, h bigint, payload binary"
NAMES = "bucket bigint, block bigint, payload binary, counts binary"
CONTEXTS = "bucket bigint, block bigint, name binary, shift binary, around binary, owner binary"
RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _table(schema: dict, rows: list[tuple]) -> pa.Table:
    return pa.table({k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate(schema.items())})


def _send_names(buckets: int, length: int, gram: int):
    schema = {"bucket": pa.int64(), "block": pa.int64(), "payload": pa.binary(), "counts": pa.binary()}

    def run(docs: pa.Table, side: pa.Table) -> pa.Table:
        rows = []
        if docs.num_rows:
            name, counts = Block(docs, _copies(side), length, gram).names()
            bucket = _bucket_of(name, buckets)
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
            block = docs.column("block")[0].as_py()
            for k in np.unique(bucket):
                own = order[cut[k]:cut[k + 1]]
                low = np.ascontiguousarray(name[own]).view(np.uint8).reshape(-1, 8)[:, :5]  # 40 bits in a bucket
                rows.append((int(k), block, low.tobytes(), counts[own].tobytes()))
        return _table(schema, rows)
    return run


def _find_repeated(most: int):
    schema = {"block": pa.int64(), "kind": pa.int32(), "key": pa.int64(), "h": pa.int64(), "payload": pa.binary()}

    def run(rows: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint8).reshape(-1, 5) for x in rows.column("payload").to_pylist()]
        size = np.array([len(p) for p in parts])
        wide = np.zeros((int(size.sum()), 8), np.uint8)
        wide[:, :5] = np.concatenate(parts)
        name = wide.view(np.uint64).ravel()
        counts = np.frombuffer(b"".join(rows.column("counts").to_pylist()), np.uint8)
        count = np.int64(1) << (counts & 127).astype(np.int64)
        order = np.argsort(name, kind="stable")
        ranked = name[order]
        new = np.concatenate(([True], ranked[1:] != ranked[:-1]))
        run_of = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        hit, hot = np.zeros(len(name), bool), np.zeros(len(name), bool)
        hit[order] = np.diff(np.append(first, len(name)))[run_of] > 1
        hit |= counts > 127
        hot[order] = np.add.reduceat(count[order], first)[run_of] > most
        hot &= hit
        ends = np.cumsum(size)
        out = []
        for b, k, n, e in zip(rows.column("block").to_pylist(), rows.column("bucket").to_pylist(), size, ends):
            for kind, bits in ((COLD, hit[e - n:e] & ~hot[e - n:e]), (HOT, hot[e - n:e])):
                if bits.any():
                    out.append((b, kind, k, int(count[e - n:e][bits].sum()), np.packbits(bits).tobytes()))
        return _table(schema, out)
    return run


def _answers(block: Block, side: pa.Table, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of a block that the answers mark as repeated: those below ``HOT_NAME`` occurrences, and the hot ones."""
    name, _ = block.names()
    bucket = _bucket_of(name, buckets)
    out = {COLD: [], HOT: []}
    for kind, k, payload in zip(side.column("kind").to_pylist(), side.column("key").to_pylist(), side.column("payload").to_pylist()):
        if kind in out:
            own = name[bucket == k]
            out[kind].append(own[np.unpackbits(np.frombuffer(payload, np.uint8), count=len(own)).astype(bool)])
    return tuple(np.sort(np.concatenate(x)) if x else np.zeros(0, np.uint64) for x in out.values())


def _send_contexts(name_buckets: int, buckets: int, string_buckets: int, length: int, gram: int):
    schema = {"bucket": pa.int64(), "block": pa.int64(), "name": pa.binary(), "shift": pa.binary(), "around": pa.binary(), "owner": pa.binary()}

    def run(docs: pa.Table, side: pa.Table) -> pa.Table:
        rows = []
        if docs.num_rows:
            block = Block(docs, _copies(side), length, gram)
            cold, hot = _answers(block, side, name_buckets)
            number = docs.column("block")[0].as_py()
            got = block.strings(hot)
            if got is not None:
                bucket = _bucket_of(got["key"], string_buckets)
                order = np.argsort(bucket, kind="stable")
                cut = np.searchsorted(bucket[order], np.arange(string_buckets + 1))
                for k in np.unique(bucket):
                    own = order[cut[k]:cut[k + 1]]
                    rows.append((buckets + int(k), number, got["key"][own].tobytes(), b"", b"", got["owner"][own].tobytes()))
            got = block.contexts(cold)
            if got is not None:
                bucket = _bucket_of(got["name"], buckets)
                for k in np.unique(bucket):
                    own = np.flatnonzero(bucket == k)
                    rows.append((int(k), number, *(np.ascontiguousarray(got[c][own]).tobytes() for c in ("name", "shift", "around", "owner"))))
        return _table(schema, rows)
    return run


def _least(key: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether an equal key has a smaller id."""
    ranked = np.lexsort((ids, key))
    k = key[ranked]
    first = np.concatenate(([True], k[1:] != k[:-1]))
    out = np.zeros(len(key), bool)
    out[ranked] = ids[ranked][first][np.cumsum(first) - 1] < ids[ranked]
    return out


def _sort_bucket(buckets: int, length: int, gram: int):
    reach = length - gram
    width = reach + length
    schema = {"block": pa.int64(), "kind": pa.int32(), "key": pa.int64(), "h": pa.int64(), "payload": pa.binary()}

    def run(rows: pa.Table) -> pa.Table:
        got = {c: rows.column(c).to_pylist() for c in ("name", "shift", "around", "owner")}
        size = [len(x) // 8 for x in got["name"]]
        ends = np.cumsum(size)
        places = list(zip(rows.column("block").to_pylist(), rows.column("bucket").to_pylist(), size, ends))
        name = np.frombuffer(b"".join(got["name"]), np.uint64)
        if places[0][1] >= buckets:  # strings around hot names
            smaller = _least(name, np.frombuffer(b"".join(got["owner"]), np.int64))
            return _table(schema, [(b, STRINGS, k - buckets, None, np.packbits(smaller[e - n:e]).tobytes()) for b, k, n, e in places])
        shift = np.frombuffer(b"".join(got["shift"]), np.uint8).reshape(-1, 2)
        around = np.frombuffer(b"".join(got["around"]), np.uint8).reshape(-1, width)
        owner = np.frombuffer(b"".join(got["owner"]), np.int64)
        flags = np.zeros(len(name), np.uint64)
        # entries with equal names share a suffix bucket; take whole buckets at a time
        order = np.argsort(name, kind="stable")
        heads = np.flatnonzero(np.concatenate(([True], name[order][1:] != name[order][:-1])))
        limits = np.append(heads[np.concatenate(([True], np.diff(heads // STEP) > 0))], len(name))
        for i, j in zip(limits[:-1], limits[1:]):
            own = order[i:j]
            string = gram_names(around[own], length)  # by first byte: reach - shift
            s = np.arange(reach + 1)
            valid = (s >= shift[own, 0, None]) & (s <= shift[own, 1, None])
            row, col = np.nonzero(valid)
            key = mix64(string[row, reach - col] + name[own][row])
            smaller = _least(key, owner[own][row])
            np.bitwise_or.at(flags, own[row[smaller]], np.uint64(1) << col[smaller].astype(np.uint64))
        return _table(schema, [(b, FLAGS, k, None, flags[e - n:e].tobytes()) for b, k, n, e in places])
    return run


def _mark(name_buckets: int, buckets: int, string_buckets: int, length: int, gram: int):
    schema = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()}

    def run(docs: pa.Table, side: pa.Table) -> pa.Table:
        rows = []
        if docs.num_rows:
            block = Block(docs, _copies(side), length, gram)
            edge = np.zeros(len(block.buf) + length + 1, np.int32)
            cold, hot = _answers(block, side, name_buckets)
            answers = list(zip(side.column("kind").to_pylist(), side.column("key").to_pylist(), side.column("payload").to_pylist()))
            got = block.strings(hot)
            if got is not None:
                smaller = np.zeros(len(got["key"]), bool)
                bucket = _bucket_of(got["key"], string_buckets)
                for kind, k, payload in answers:
                    if kind == STRINGS:
                        own = np.flatnonzero(bucket == k)
                        smaller[own] = np.unpackbits(np.frombuffer(payload, np.uint8), count=len(own)).astype(bool)
                begin = got["begin"][got["own"] | smaller[got["entry"]]]
                np.add.at(edge, begin, 1)
                np.add.at(edge, begin + length, -1)
            got = block.contexts(cold)
            if got is not None:
                flags = np.zeros(len(got["name"]), np.uint64)
                bucket = _bucket_of(got["name"], buckets)
                for kind, k, payload in answers:
                    if kind == FLAGS:
                        flags[bucket == k] = np.frombuffer(payload, np.uint64)
                use, entry = got["use"], got["entry"]
                s = np.arange(length - gram + 1)
                shift = got["shift"][entry]
                valid = (s >= shift[:, 0, None]) & (s <= shift[:, 1, None])
                hit = valid & (got["own"][:, None] | ((flags[entry][:, None] >> s.astype(np.uint64)) & np.uint64(1)).astype(bool))
                row, col = np.nonzero(hit)
                begin = block.at[use][row] - col
                np.add.at(edge, begin, 1)
                np.add.at(edge, begin + length, -1)
            gone = np.cumsum(edge)[:len(block.buf)] > 0
            for i, text in enumerate(block.texts):
                g = gone[block.start[i]:block.start[i + 1]]
                n = int(g.sum())
                spans = int((g[1:] & ~g[:-1]).sum() + g[0]) if len(g) else 0
                kept = text if not n else np.frombuffer(text, np.uint8)[~g].tobytes()
                rows.append((block.raw[i], len(text), n, spans, hashlib.sha256(kept).hexdigest()))
        return _table(schema, rows)
    return run


def drop_repeated_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``, as ``RESULT``."""
    spark = docs.sparkSession
    parts = default_partitions(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumns(
        {"h": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text"), "n_bytes": F.octet_length("text").cast("long")})
    total = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(total / block_bytes))
    name_buckets = max(1, math.ceil(total / 17 / BUCKET_NAMES))
    buckets = max(1, math.ceil(total / 17 / 5 / BUCKET_CONTEXTS))
    placed = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "h"), F.lit(blocks)).cast("long"))
    name = f"suffix_blocks_{uuid.uuid4().hex}"
    (placed.select("block", "doc_id", "h", "text").repartition(parts, "block")
     .write.bucketBy(parts, "block").sortBy("block").saveAsTable(name))
    try:
        texts = spark.table(name)
        # copies: texts of `length` bytes at least that a smaller document has, too
        slim = placed.select("block", "doc_id", "h", "h2", "n_bytes").where(F.col("n_bytes") >= length)
        least = slim.groupBy("h", "h2", "n_bytes").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")).where("rows > 1").select("h", "h2", "n_bytes", "least")
        copies = staged(
            slim.join(least, ["h", "h2", "n_bytes"]).where("least < coalesce(doc_id, 9223372036854775807)").select("block", "doc_id", "h", "n_bytes"), "suffix-copies")
        side0 = copies.select("block", F.lit(COPY).alias("kind"), F.col("doc_id").alias("key"), "h", F.lit(None).cast("binary").alias("payload"))

        def by_block(side: DataFrame, f, schema: str) -> DataFrame:
            return texts.groupBy("block").cogroup(side.groupBy("block")).applyInArrow(f, schema)

        sent = by_block(side0, _send_names(name_buckets, length, gram), NAMES)
        side1 = staged(sent.groupBy("bucket").applyInArrow(_find_repeated(HOT_NAME), SIDE), "suffix-names")
        # about half of the reach around each sample, one string a byte
        hot = side1.where(F.col("kind") == HOT).agg(F.coalesce(F.sum("h"), F.lit(0))).first()[0]
        string_buckets = max(1, math.ceil(hot * (length - gram + 1) / 2 / BUCKET_NAMES))
        both = side0.unionByName(side1)
        around = by_block(both, _send_contexts(name_buckets, buckets, string_buckets, length, gram), CONTEXTS)
        side2 = staged(around.groupBy("bucket").applyInArrow(_sort_bucket(buckets, length, gram), SIDE), "suffix-flags")
        marked = by_block(both.unionByName(side2), _mark(name_buckets, buckets, string_buckets, length, gram), RESULT)
        whole = copies.select("doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit("").cast("binary"), 256).alias("kept_sha256"))
        done = staged(marked.unionByName(whole), "suffix-result")
        drop_staged(copies, side1, side2)
        return done
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
