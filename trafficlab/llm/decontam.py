"""Benchmark decontamination by template canonicalisation.

A text becomes a sequence of template tokens: numbers, units and names are
replaced by typed placeholders, other words by their lower-cased core.  A name
is a capitalised word; a run of names is one placeholder.  A capitalised word
that opens a sentence may be a name or not, so a text has two readings: such
words are plain in one and placeholders of their own in the other.

Windows of ``window`` template tokens are hash-joined with the benchmark's
windows of the same reading.  A window with fewer than half plain words says
too little by its template: it is joined on the template and the slot values,
so it matches verbatim only.  An item of fewer template tokens than a window is
matched verbatim: all its words, symbols like ``+`` included, must follow each
other in the text, and it needs ``SHORTEST`` words; shorter items match nothing.

Matches are judged where they lie together: along alignments (document position
less item position) that differ by at most half the item's length, and by a
window at least.  Along one alignment each benchmark value must stand for one
document value and the other way round.  A document is contaminated by an item
when the matched windows of some place cover at least ``coverage`` of the
item's template and the slots agree there in at least ``slot_share`` of the
slot pairs; it is a re-parameterised copy when some agreeing slot of its best
place has another value.

The benchmark is the stated query set: its windows are read in blocks of at
most ``BLOCK_WINDOWS`` (an item is never split), each block is broadcast and
hash-joined inside the scan of the documents, so memory is bounded for any
benchmark and no window of the corpus is shuffled.  Every text is read whole.

Cases: a null or empty text (document or item) has no tokens and matches
nothing; repeated items or rows each count; ties need no order; an empty
benchmark or table contaminates nothing; other columns are carried, and
columns named like the results are replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .common import mix64

WINDOW = 8
COVERAGE = 0.6
SLOT_SHARE = 0.8
#: Least words of an item that is shorter than a window.
SHORTEST = 4
#: Most benchmark windows in one broadcast block (about 24 bytes each).
BLOCK_WINDOWS = 2_000_000
#: Units of measure (lower case).
UNITS = frozenset(
    "mm cm m km in ft yd mi mg g kg t lb oz ml l gal s sec min h hr ms hz khz mhz ghz w kw v a c f k "
    "inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres "
    "gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres second seconds minute minutes "
    "hour hours day days week weeks month months year years dollar dollars euro euros cent cents percent degree degrees".split())
NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(?:[a-z]{1,3}|%)?$")
EDGES = re.compile(r"^\W+|\W+$")
PLAIN, NUM, UNIT, NAME, NONE = range(5)
_SALT = [np.uint64(x) for x in (0, 0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179, 0x9B05688C2B3E6C1F)]
_STEP = np.uint64(0x9E3779B97F4A7C15)
_FACTOR = mix64(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)


class _Index(dict):
    """Numbers of words; a new word is added when it is asked for."""

    def __init__(self, add):
        self.add = add

    def __missing__(self, raw: bytes) -> int:
        i = self[raw] = self.add(raw)
        return i


class Vocabulary:
    """Attributes of raw words, kept per task and bounded."""

    LIMIT = 1_000_000

    def __init__(self):
        self.clear()

    def clear(self):
        self.index = _Index(self.add)
        self.fresh: list[tuple[int, int, bool, bool]] = []  # of the words met since the arrays were extended
        self.size = 0
        self.kind = np.zeros(1024, np.int8)
        self.key = np.zeros(1024, np.uint64)
        self.ends = np.zeros(1024, bool)
        self.capital = np.zeros(1024, bool)

    def add(self, raw: bytes) -> int:
        word = raw.decode("utf-8", "replace")
        if word.isalpha():  # no number and no punctuation
            low = word.lower()
            self.fresh.append((UNIT if low in UNITS and low == word else PLAIN, xxhash.xxh64_intdigest(low.encode()), False, word[0].isupper()))
            return self.size + len(self.fresh) - 1
        core = EDGES.sub("", word)
        low = core.lower()
        if not core:
            kind = NONE
        elif NUMBER.match(low):
            kind = NUM
        elif low in UNITS and low == core:
            kind = UNIT
        else:
            kind = PLAIN
        ends = word.rstrip("\"')]»”").endswith((".", "!", "?", ":"))
        self.fresh.append((kind, xxhash.xxh64_intdigest((low or word).encode()), ends, core[:1].isupper()))
        return self.size + len(self.fresh) - 1

    def _extend(self) -> None:
        low, self.size = self.size, self.size + len(self.fresh)
        for name, values in zip(("kind", "key", "ends", "capital"), zip(*self.fresh)):
            old = getattr(self, name)
            if self.size > len(old):
                old = np.concatenate([old, np.zeros(max(len(old), self.size - len(old)), old.dtype)])
                setattr(self, name, old)
            old[low:self.size] = np.array(values, old.dtype)
        self.fresh = []

    def tokens(self, text: bytes):
        """Template keys and slot values (0 for plain words) of both readings, and the keys of all words.

        The second reading is None when no capitalised word opens a sentence.
        """
        words = text.split()
        ids = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        if self.fresh:
            self._extend()
        kind, key = self.kind[ids], self.key[ids]
        every = key
        opening = None
        if len(ids):
            opens = np.concatenate(([True], self.ends[ids][:-1]))
            name = (kind == PLAIN) & self.capital[ids]
            opening = name & opens
            kind[name & ~opens] = NAME
        if len(self.index) > self.LIMIT:
            self.clear()
        keep = kind != NONE
        if not keep.any():
            none = np.zeros(0, np.uint64)
            return (none, none), None, every
        if not keep.all():
            kind, key, opening = kind[keep], key[keep], opening[keep]
        plain = _slots(kind, key, None)
        return plain, _slots(np.where(opening, NAME, kind), key, opening) if opening.any() else None, every


def _slots(kind: np.ndarray, key: np.ndarray, alone: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Template keys and slot values; names in ``alone`` are slots of their own."""
    if not kind.any():  # plain words only
        return key, np.zeros(len(key), np.uint64)
    # a run of names is one slot whose value is the whole run
    follows = (kind[1:] == NAME) & (kind[:-1] == NAME)
    if alone is not None:
        follows &= ~(alone[1:] | alone[:-1])
    starts = np.flatnonzero(np.concatenate(([True], ~follows)))
    if len(starts) == len(key):
        value = mix64(key)
    else:
        value = np.add.reduceat(mix64(key + _STEP * (np.arange(len(key), dtype=np.uint64) - np.repeat(starts, np.diff(np.append(starts, len(key)))).astype(np.uint64))), starts)
        kind, key = kind[starts], key[starts]
    template = np.where(kind == PLAIN, key, np.array(_SALT, np.uint64)[kind])
    return template, np.where(kind == PLAIN, np.uint64(0), value | np.uint64(1))


def window_hashes(template: np.ndarray, width: int) -> np.ndarray:
    """Hash of every window of ``width`` template tokens along the last axis (the tokens are hashes already)."""
    if template.shape[-1] < width:
        return np.zeros((*template.shape[:-1], 0), np.uint64)
    h, step = template, 1
    while 2 * step <= width:
        h = h[..., :-step] * _FACTOR[step] + h[..., step:]
        step *= 2
    if step < width:  # the first and the last ``step`` tokens
        h = h[..., :step - width] * _FACTOR[width] + h[..., width - step:]
    return (h + np.uint64(width)) * _STEP


def mostly_plain(slot: np.ndarray, width: int) -> np.ndarray:
    """Whether at least half of each window is plain words."""
    n = max(0, len(slot) - width + 1)
    total = np.concatenate(([0], np.cumsum(slot == 0)))
    return 2 * (total[width:width + n] - total[:n]) >= width


def window_keys(template: np.ndarray, slot: np.ndarray, width: int) -> np.ndarray:
    """Join key of every window: its template, with the slot values where fewer than half are plain words."""
    x = window_hashes(template, width)
    heavy = np.flatnonzero(~mostly_plain(slot, width)) if slot.any() else ()
    if len(heavy):
        exact = np.where(slot != 0, mix64(template + slot), template)
        x[heavy] = window_hashes(exact[heavy[:, None] + np.arange(width)], width)[:, 0]
    return x


class Windows:
    """Windows of one reading of some benchmark items, sorted by join key."""

    def __init__(self):
        self.parts = []
        self.texts: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}

    def add(self, item: int, template: np.ndarray, slot: np.ndarray, width: int) -> None:
        self.texts[item] = template, slot, width
        x = window_keys(template, slot, width)
        self.parts.append((x, np.full(len(x), item), np.arange(len(x)), np.full(len(x), width)))

    def sort(self) -> None:
        self.hash, self.item, self.pos, self.width = (np.concatenate(x) for x in zip(*self.parts)) if self.parts else [np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64)]
        self.parts = []
        order = np.argsort(self.hash, kind="stable")
        self.hash, self.item, self.pos, self.width = (x[order] for x in (self.hash, self.item, self.pos, self.width))
        self.widths = np.unique(self.width).tolist()
        self.seen = np.zeros(1 << 22 if len(self.hash) else 1, bool)
        self.seen[self.hash >> np.uint64(42)] = True

    def match(self, template: np.ndarray, slot: np.ndarray):
        """Matched (item, item position, document position) of one document."""
        found = []
        for w in self.widths:
            x = window_keys(template, slot, w)
            p = np.flatnonzero(self.seen[x >> np.uint64(42)]) if len(x) else np.zeros(0, np.int64)
            if not len(p):
                continue
            lo = np.searchsorted(self.hash, x[p], "left")
            n = np.searchsorted(self.hash, x[p], "right") - lo
            k = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            d = np.repeat(p, n)
            same = self.width[k] == w
            found.append(np.stack([self.item[k][same], self.pos[k][same], d[same]]))
        return np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)

    def places(self, item: int, ipos: np.ndarray, dpos: np.ndarray, slot: np.ndarray, reach: int):
        """(coverage, agreeing slots, re-parameterised) of one item around each of its alignments."""
        _, own, w = self.texts[item]
        shift = dpos - ipos
        order = np.argsort(shift, kind="stable")
        shift, ipos = shift[order], ipos[order]
        anchors, first = np.unique(shift, return_index=True)
        ends = {0: np.append(first[1:], len(shift))}
        if reach and len(anchors) > 1:
            ends[reach] = np.searchsorted(shift, anchors + reach, "right")
        for far, end in ends.items():
            for i, j in zip(first, end):
                if far and shift[j - 1] == shift[i]:
                    continue  # one alignment: judged already
                covered = np.zeros(len(own), bool)
                pairs = set()
                for s in np.unique(shift[i:j]):
                    p = ipos[i:j][shift[i:j] == s]
                    here = np.unique((p[:, None] + np.arange(w)).ravel())
                    covered[here] = True
                    at = here[own[here] != 0]
                    pairs.update((int(s), int(a), int(b)) for a, b in zip(own[at], slot[at + s]))
                there = {}
                back = {}
                for s, a, b in pairs:
                    there.setdefault((s, a), set()).add(b)
                    back.setdefault((s, b), set()).add(a)
                good = [(a, b) for s, a, b in pairs if len(there[s, a]) == 1 and len(back[s, b]) == 1]
                yield float(covered.mean()), len(good) / len(pairs) if pairs else 1.0, any(a != b for a, b in good)


class Block:
    """Windows of some benchmark items: both readings, and the short items word by word."""

    def __init__(self, items: list[tuple[int, bytes]], width: int):
        vocab = Vocabulary()
        self.ids = []
        self.plain, self.named, self.short = Windows(), Windows(), Windows()
        for item_id, text in items:
            plain, named, every = vocab.tokens(text)
            k = len(self.ids)
            self.ids.append(item_id)
            if len(plain[0]) >= width:
                self.plain.add(k, *plain, width)
                # the document may open a sentence where the item does not
                named = plain if named is None else named
                if len(named[0]) >= width:
                    self.named.add(k, *named, width)
            elif len(plain[0]) and len(every) >= SHORTEST:
                self.short.add(k, every, np.zeros(len(every), np.uint64), min(width, len(every)))
        for x in (self.plain, self.named, self.short):
            x.sort()

    def judge(self, plain, named, every, coverage: float, slot_share: float) -> list[tuple[int, float, float, bool]]:
        """(item, coverage, agreeing slots, re-parameterised) of the items that contaminate a document."""
        best = {}
        none = np.zeros(len(every), np.uint64) if self.short.widths else None
        for windows, text, least in ((self.plain, plain, coverage), (self.named, named, coverage), (self.short, (every, none), 1.0)):
            if text is None or not windows.widths:
                continue
            item, ipos, dpos = windows.match(*text)
            for k in np.unique(item):
                of = item == k
                own, w = windows.texts[k][1:]
                reach = 0 if windows is self.short else max(w, len(own) // 2)
                for cover, share, other in windows.places(k, ipos[of], dpos[of], text[1], reach):
                    if cover >= least and share >= slot_share:
                        best[k] = max(best.get(k, (0.0, 0.0, False, False)), (cover, share, not other, other))
        return [(self.ids[k], cover, share, other) for k, (cover, share, _, other) in sorted(best.items())]


def _blocks(benchmark: DataFrame, window: int, most: int):
    """Blocks of the benchmark, streamed through the driver one at a time."""
    items, size = [], 0
    for row in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator(prefetchPartitions=True):
        text = (row[1] or "").encode()
        n = 2 * len(text.split())  # two readings
        if items and size + n > most:
            yield Block(items, window)
            items, size = [], 0
        items.append((row[0], text))
        size += n
    if items:
        yield Block(items, window)


RESULT = "contaminated boolean, items array<bigint>, coverage double, slot_share double, reparameterised boolean"


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE,
                       slot_share: float = SLOT_SHARE, block_windows: int = BLOCK_WINDOWS, carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns of ``docs`` (default: all) and the columns of ``RESULT``."""
    spark = docs.sparkSession
    made = [f.name for f in T.StructType.fromDDL(RESULT).fields]
    carry = [c for c in (carry if carry is not None else docs.columns) if c not in made]
    extra = [] if "text" in carry else ["text"]
    rows = docs.select(*carry, *extra).withColumns({
        "items": F.array().cast("array<bigint>"), "coverage": F.lit(0.0), "slot_share": F.lit(1.0), "reparameterised": F.lit(False)})
    schema = rows.schema
    for block in _blocks(benchmark, window, block_windows):
        sent = spark.sparkContext.broadcast(block)

        def scan(batches, sent=sent):
            vocab, block = Vocabulary(), sent.value
            for b in batches:
                items, cover, share, rep = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("items", "coverage", "slot_share", "reparameterised"))
                texts = b.column(b.schema.get_field_index("text")).cast(pa.large_binary())
                for i in range(len(texts)):
                    text = texts[i].as_py()
                    if not text:
                        continue
                    for item, c, s, r in block.judge(*vocab.tokens(text), coverage, slot_share):
                        items[i] = sorted([*items[i], item])
                        share[i] = s if not cover[i] else min(share[i], s)
                        cover[i] = max(cover[i], c)
                        rep[i] = rep[i] or r
                made = {"items": pa.array(items, pa.list_(pa.int64())), "coverage": pa.array(cover, pa.float64()),
                        "slot_share": pa.array(share, pa.float64()), "reparameterised": pa.array(rep, pa.bool_())}
                yield pa.RecordBatch.from_arrays([made.get(n, b.column(k)) for k, n in enumerate(b.schema.names)], names=b.schema.names)

        rows = rows.mapInArrow(scan, schema)
    return rows.select(*carry, (F.size("items") > 0).alias("contaminated"), "items", "coverage", "slot_share", "reparameterised")
