"""Target-distribution importance resampling with hashed n-gram features.

A batch's texts are joined with separator sentinels into one buffer.  One
regular-expression pass over the buffer finds all words; ``searchsorted`` over
the offsets of the documents gives each word's document, and a run of words
that touches two documents is masked out before ``bincount``.  An n-gram's
bucket is the CRC-32 of its bytes: the checksums of the words are computed side
by side, and the checksum of ``a b`` follows from those of ``a `` and ``b`` by
the shift operator of b's length, so no n-gram string is ever built.

1. Every task counts its buckets and sends one row of ``buckets`` counts; the
   sums of corpus (S, s) and target (T, t) are one row each.
2. The gain of a bucket is ``floor(1000 ln((t+1)(S+B) / ((s+1)(T+B))))``; the
   table of B gains, whose size is a parameter, goes to the tasks.
3. A second pass gives each document its weight, the floored mean gain of its
   features, and its score, the weight plus Gumbel noise that depends on seed
   and doc_id alone: the highest scores are a draw without replacement.
4. The ranks come from the skew-safe ordered scan over (score, doc_id) rows; no
   sort in one task.

Memory is bounded by ``CHUNK_BYTES`` of text; a longer document is cut between
words, and each piece repeats the words before it that its n-grams need.

Cases: a null or empty text has no features, weight 0, and is never drawn (it
has fewer than ``min_words`` words); a null doc_id draws as the empty string
and loses ties; repeated rows have equal scores and stand side by side; an
empty target has T = 0; an empty corpus gives no rows; carried columns with the
name of a made one are left out.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..operators.position import keyed_scan
from .common import staged, utf8

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 25
SEED = 7
#: Bytes of text worked on at once (about 60 bytes of memory each).
CHUNK_BYTES = 1 << 20
#: Words longer than this are summed one by one.
LONG_WORD = 64
NGRAMS = 2
#: Between the texts of a batch; not a byte of any word.
SENTINEL = b"\x00"
P = "__draw_"
MADE = ["n_features", "weight", "score", "rank"]

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9a-z\x80-\xff]")


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1).astype(np.uint32)
    return c


_CRC = _crc_table()
_SPACE = np.uint32(0x20)


def _append_byte(crc: np.ndarray, byte: np.ndarray | np.uint32) -> np.ndarray:
    """The checksums after one more byte each."""
    state = ~crc
    return ~(_CRC[(state ^ byte) & np.uint32(255)] ^ (state >> np.uint32(8)))


def _shift_tables(longest: int) -> np.ndarray:
    """For each length the four tables (one per byte of the checksum) that move it over so many zero bytes."""
    byte = np.arange(256, dtype=np.uint32)
    out = [np.stack([byte << np.uint32(8 * k) for k in range(4)])]
    for _ in range(longest):
        out.append(_CRC[out[-1] & np.uint32(255)] ^ (out[-1] >> np.uint32(8)))
    return np.stack(out).reshape(-1)


_SHIFT = _shift_tables(LONG_WORD)


def _join_crcs(raw: np.ndarray, head: np.ndarray, word: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The checksums of strings (``head``) followed by a word (``word``) each."""
    base = np.minimum(length, LONG_WORD) * 1024
    out = word ^ _SHIFT[base + (head & np.uint32(255))]
    for k in range(1, 4):
        out ^= _SHIFT[base + (256 * k + ((head >> np.uint32(8 * k)) & np.uint32(255)))]
    for i in np.flatnonzero(length > LONG_WORD):
        out[i] = zlib.crc32(raw[start[i]:start[i] + length[i]], int(head[i]))
    return out


def _word_crcs(raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of each word, all words one byte further in each step."""
    crc = np.zeros(len(start), np.uint32)
    order = np.argsort(-length, kind="stable")
    at, left = start[order], length[order]
    state = np.zeros(len(start), np.uint32)
    long = int(np.searchsorted(-left, -LONG_WORD, side="left"))
    for i in range(long):
        state[i] = zlib.crc32(raw[at[i]:at[i] + left[i]])
    k, n = 0, len(left)
    while True:
        n = int(np.searchsorted(-left, -k, side="left"))  # words longer than k
        if n <= long:
            break
        state[long:n] = _append_byte(state[long:n], raw[at[long:n] + k].astype(np.uint32))
        k += 1
    crc[order] = state
    return crc


class Features:
    """Buckets of all runs of 1 to ``ngrams`` words in a batch of texts."""

    def __init__(self, buckets: int = BUCKETS, ngrams: int = NGRAMS, chunk: int = CHUNK_BYTES):
        self.buckets, self.ngrams, self.chunk = np.uint32(buckets), ngrams, chunk

    def pieces(self, buf: np.ndarray, offsets: np.ndarray):
        """(document, bytes, words repeated from the piece before), in order.

        A document longer than a chunk is cut between words; the next piece
        opens with the last words of this one, for the n-grams across the cut."""
        for i in range(len(offsets) - 1):
            text = buf[offsets[i]:offsets[i + 1]].tobytes().lower()
            at, again = 0, []
            while len(text) - at > self.chunk:
                gap = _GAP.search(text, at + self.chunk)
                if gap is None:
                    break
                part = b" ".join([*again, text[at:gap.start()]])
                yield i, part, len(again)
                again = _WORD.findall(part)[1 - self.ngrams:] if self.ngrams > 1 else []
                at = gap.end()
            yield i, b" ".join([*again, text[at:]]), len(again)

    def batches(self, buf: np.ndarray, offsets: np.ndarray):
        """Per chunk: document and bucket of each feature, document of each word."""
        doc, text, skip, size = [], [], [], 0
        for i, t, again in self.pieces(buf, offsets):
            if text and size + len(t) > self.chunk:
                yield self._chunk(doc, text, skip)
                doc, text, skip, size = [], [], [], 0
            doc.append(i)
            text.append(t)
            skip.append(again)
            size += len(t) + 1
        if text:
            yield self._chunk(doc, text, skip)

    def _chunk(self, doc: list[int], text: list[bytes], skip: list[int]):
        joined = SENTINEL.join(text)
        found = list(_WORD.finditer(joined))
        begin = np.cumsum([0, *(len(t) + len(SENTINEL) for t in text[:-1])])
        start = np.fromiter(map(re.Match.start, found), np.int64, len(found))
        length = np.fromiter(map(re.Match.end, found), np.int64, len(found)) - start
        piece = np.searchsorted(begin, start, side="right") - 1
        nth = np.arange(len(start)) - np.searchsorted(start, begin)[piece]  # of its piece
        fresh = nth - np.array(skip)[piece]
        owner = np.array(doc)[piece]
        raw = np.frombuffer(joined, np.uint8)
        word = _word_crcs(raw, start, length)
        docs, crcs, run = [owner[fresh >= 0]], [word[fresh >= 0]], word
        for n in range(2, self.ngrams + 1):
            # the run that ends at the word before, a space, then the word; runs over two pieces are masked
            run = np.concatenate([run[:1], _join_crcs(raw, _append_byte(run[:-1], _SPACE), word[1:], start[1:], length[1:])])
            own = (nth >= n - 1) & (fresh >= 0)
            docs.append(owner[own])
            crcs.append(run[own])
        return np.concatenate(docs), np.concatenate(crcs) % self.buckets, owner[fresh >= 0]


def _bucket_counts(texts: DataFrame, buckets: int, ngrams: int, chunk: int) -> list[int]:
    """Counts of all buckets: one row of ``buckets`` sums per task, added up as they arrive."""
    def scan(batches):
        features, total = Features(buckets, ngrams, chunk), np.zeros(buckets, np.int64)
        for b in batches:
            for _, bucket, _ in features.batches(*utf8(b.column(0))):
                total += np.bincount(bucket, minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets, dtype=np.int32)), pa.array(total)], names=["bucket", "n"])

    sums = texts.select("text").mapInArrow(scan, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = [0] * buckets
    for row in sums.collect():  # ``buckets`` rows
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: list[int], target: list[int]) -> list[int]:
    """Gain of each bucket in thousandths."""
    n, big_s, big_t = len(corpus), sum(corpus), sum(target)
    return [math.floor(1000 * math.log(float((t + 1) * (big_s + n)) / float((s + 1) * (big_t + n)))) for s, t in zip(corpus, target)]


def noise(seed: int, doc_id: str) -> int:
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED,
             buckets: int = BUCKETS, ngrams: int = NGRAMS, carry: list[str] | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``carry`` columns of ``docs`` (default: all) plus n_features, weight, score and rank (null: not drawn).

    Drawn are the ``percent`` hundredths (rounded down) of the documents with
    ``min_words`` words that have the highest scores.
    """
    carry = [c for c in (carry if carry is not None else docs.columns) if c not in MADE]
    gain = gains(_bucket_counts(docs, buckets, ngrams, chunk_bytes), _bucket_counts(target, buckets, ngrams, chunk_bytes))
    sent = docs.sparkSession.sparkContext.broadcast(np.array(gain, np.int64))  # one number per bucket

    own = ["n_features", "weight", "score", "enough"]
    rows = docs.select(*[F.col(f"`{c}`") for c in carry], F.col("doc_id").cast("long").alias(f"{P}id"), F.col("text").alias(f"{P}text"))
    schema = T.StructType([*rows.schema.fields[:-1], *[T.StructField(P + n, T.LongType()) for n in own[:3]], T.StructField(P + "enough", T.BooleanType())])

    def scan(batches):
        gain, features = sent.value, Features(buckets, ngrams, chunk_bytes)
        for b in batches:
            n = b.num_rows
            n_features, total, n_words = (np.zeros(n, np.int64) for _ in range(3))
            for doc, bucket, owner in features.batches(*utf8(b.column(b.num_columns - 1))):
                low = int(doc.min()) if len(doc) else 0  # a chunk touches few documents
                for out, at, w in ((n_features, doc, None), (total, doc, gain[bucket].astype(np.float64)), (n_words, owner, None)):
                    got = np.bincount(at - low, weights=w)
                    out[low:low + len(got)] += got.astype(np.int64)
            weight = np.where(n_features > 0, total // np.maximum(n_features, 1), 0)
            ids = b.column(b.num_columns - 2).to_pylist()
            score = weight + np.array([noise(seed, "" if i is None else str(i)) for i in ids], np.int64)
            made = [pa.array(n_features), pa.array(weight), pa.array(score), pa.array(n_words >= min_words)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], names=schema.names)

    scored = staged(rows.mapInArrow(scan, schema), "resample-scores")  # the texts are read twice, not three times
    enough = F.col(P + "enough")
    drawn = scored.where(enough).count() * percent // 100
    order = scored.withColumns({P + "down": -F.col(P + "score"), P + "last": F.col(P + "id").isNull()})
    ranked = keyed_scan(order, [P + "enough"], [P + "down", P + "last", P + "id"], pos_col=P + "pos")
    return ranked.select(*[F.col(f"`{c}`") for c in carry], *[F.col(P + n).alias(n) for n in own[:3]],
                         F.when(enough & (F.col(P + "pos") < drawn), F.col(P + "pos") + 1).cast("long").alias("rank"))
