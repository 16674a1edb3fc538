"""Toxicity: a bidirectional gated recurrent network with attention pooling.

Inputs: each word is the sum of its hashed word embedding and the mean of its
hashed character 4- and 5-gram embeddings.  A forward and a backward gated
recurrent unit read a window of words; attention pools their states to one
logit.  Windows of ``WINDOW`` words are scored from every ``STRIDE``-th word on,
not from every word, and the document's score is its largest window score,
calibrated on documents left out of the fit.  A phrase of up to 17 words lies
whole in some window, one of 18 to 32 words may not.

Training (numpy, in one task) uses a bounded sample of labelled rows:
at most ``sample_rows`` of each class, those with the smallest hash, of at
most ``sample_chars`` characters.  The labels are per document, so a toxic document
contributes the windows that look most toxic (first by word evidence, then by
the network itself) and a clean document its most suspicious windows and some
others.  The embeddings start from smoothed class log-odds.

Scoring is a map over Arrow batches with the weights broadcast (a fixed size);
word projections are computed once per distinct word of a task.

Cases: a null text and one without words score 0; equal texts have equal
scores; without labels of both classes every score is 0; an empty table
gives no rows; other columns are carried, and columns named score and
predicted are replaced.
"""

from __future__ import annotations

import math
import pickle
import string
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import mix64

WINDOW, STRIDE = 32, 16
BUCKETS = 1 << 16
DIM, HIDDEN, ATTEND = 8, 8, 8
THRESHOLD = 0.3
SAMPLE_ROWS, SAMPLE_CHARS = 2500, 20_000
GRAMS = (4, 5)
#: Characters taken off both ends of a word.
EDGES = string.punctuation + "«»“”„‘’…–—¿¡·©"


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Words:
    """Features of distinct words as flat arrays."""

    word: np.ndarray
    gram: np.ndarray
    start: np.ndarray  # first n-gram of each word

    @classmethod
    def of(cls, words: list[str]) -> Words:
        """Hashes all words at once: n-grams are runs of bytes of ``^word$`` joined in one buffer."""
        cores = [w.strip(EDGES).encode() for w in words]
        marked = b"".join([b"^" + c + b"$" for c in cores])
        size = np.fromiter(map(len, cores), np.int64, len(cores)) + 2
        text = np.frombuffer(marked, np.uint8).astype(np.uint64)
        of_byte = np.repeat(np.arange(len(cores)), size)
        left = np.repeat(np.cumsum(size), size) - np.arange(len(text))  # bytes up to the word's end
        owners, grams = [], []
        for n in GRAMS:
            m = len(text) - n + 1
            if m <= 0:
                continue
            h = np.full(m, n, np.uint64)
            for i in range(n):
                h = h * np.uint64(0x100000001B3) + text[i:i + m]
            at = np.flatnonzero(left[:m] >= n)
            owners.append(of_byte[at])
            grams.append((mix64(h[at]) >> np.uint64(40)).astype(np.int64) % BUCKETS)
        owners.append(np.arange(len(cores)))  # each word has one gram at least: all of it
        whole = np.fromiter(map(zlib.crc32, cores), np.int64, len(cores)) % BUCKETS
        grams.append(whole)
        owner = np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        return cls(whole, np.concatenate(grams)[order], np.searchsorted(owner[order], np.arange(len(cores))))

    def take(self, ids: np.ndarray) -> Words:
        ends = np.append(self.start[1:], len(self.gram))
        sizes = ends[ids] - self.start[ids]
        first = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        at = np.repeat(self.start[ids] - first, sizes) + np.arange(sizes.sum())
        return Words(self.word[ids], self.gram[at], first)

    def sizes(self) -> np.ndarray:
        return np.diff(np.append(self.start, len(self.gram)))


class Network:
    """Weights, forward pass and gradients."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        f = lambda *s, k=0.3: (r.standard_normal(s) * k).astype(np.float32)
        self.p = {"word": f(BUCKETS, DIM, k=0.02), "gram": f(BUCKETS, DIM, k=0.02)}
        for d in ("f", "b"):
            self.p |= {f"W{d}": f(2 * DIM, 3 * HIDDEN), f"U{d}": f(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"A": f(2 * HIDDEN, ATTEND), "a": np.zeros(ATTEND, np.float32), "v": f(ATTEND), "o": f(2 * HIDDEN), "q": np.full(1, -2, np.float32)}
        self.scale = (1.0, 0.0)

    def inputs(self, words: Words) -> np.ndarray:
        n = np.maximum(words.sizes(), 1)[:, None].astype(np.float32)
        grams = np.add.reduceat(self.p["gram"][words.gram], words.start, axis=0) / n if len(words.word) else np.zeros((0, DIM), np.float32)
        return np.concatenate([self.p["word"][words.word], grams], axis=1)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Input projections of both directions; a last row of zeros stands for padding."""
        out = np.concatenate([x @ self.p["Wf"] + self.p["cf"], x @ self.p["Wb"] + self.p["cb"]], axis=1)
        return np.concatenate([out, np.zeros((1, out.shape[1]), np.float32)]).astype(np.float32)

    def _run(self, proj: np.ndarray, ids: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        U, H = self.p[f"U{d}"], HIDDEN
        off = 0 if d == "f" else 3 * H
        B, n = ids.shape
        h = np.zeros((B, H), np.float32)
        states = np.zeros((n, B, H), np.float32)
        tape = []
        for t in range(n) if d == "f" else range(n - 1, -1, -1):
            x = proj[ids[:, t], off:off + 3 * H]
            g = _sigmoid(x[:, :2 * H] + h @ U[:, :2 * H])
            z, r = g[:, :H], g[:, H:]
            c = np.tanh(x[:, 2 * H:] + (r * h) @ U[:, 2 * H:])
            m = mask[:, t, None]
            new = m * (z * h + (1 - z) * c) + (1 - m) * h
            if keep:
                tape.append((t, h, z, r, c))
            h = new
            states[t] = h
        return states, tape

    def forward(self, proj, ids, mask, keep=False):
        sf, tf = self._run(proj, ids, mask, "f", keep)
        sb, tb = self._run(proj, ids, mask, "b", keep)
        s = np.concatenate([sf, sb], axis=2)  # time, window, 2 HIDDEN
        e = np.tanh(s @ self.p["A"] + self.p["a"])
        w = e @ self.p["v"] + np.where(mask.T > 0, 0, -1e9).astype(np.float32)
        w = np.exp(w - w.max(0)) * (mask.T > 0)
        w = w / np.maximum(w.sum(0), 1e-9)
        pooled = (w[..., None] * s).sum(0)
        logit = pooled @ self.p["o"] + self.p["q"][0]
        return logit, (s, e, w, pooled, tf, tb)

    def gradients(self, words: Words, ids, mask, y):
        """Gradients of the mean log loss; ``ids`` index ``words``, padding is len(words)."""
        p, H = self.p, HIDDEN
        x = self.inputs(words)
        proj = self.project(x)
        logit, (s, e, w, pooled, tf, tb) = self.forward(proj, ids, mask, keep=True)
        prob = _sigmoid(logit)
        g = {}
        dl = ((prob - y) / len(y)).astype(np.float32)
        g["o"], g["q"] = pooled.T @ dl, dl.sum(keepdims=True)
        dpool = dl[:, None] * p["o"]
        dw = (s * dpool).sum(2)
        ds = w[..., None] * dpool
        dscore = w * (dw - (w * dw).sum(0))
        de = dscore[..., None] * p["v"] * (1 - e * e)
        g["v"] = (dscore[..., None] * e).sum((0, 1))
        g["A"], g["a"] = np.einsum("tbi,tbj->ij", s, de), de.sum((0, 1))
        ds = ds + de @ p["A"].T
        dproj = np.zeros_like(proj)
        for d, tape, part in (("f", tf, ds[..., :H]), ("b", tb, ds[..., H:])):
            U, off = p[f"U{d}"], 0 if d == "f" else 3 * H
            gU = np.zeros_like(U)
            dh = np.zeros((len(y), H), np.float32)
            for t, h, z, r, c in reversed(tape):
                dh = dh + part[t]
                m = mask[:, t, None]
                dn = dh * m
                dz, dc = dn * (h - c) * z * (1 - z), dn * (1 - z) * (1 - c * c)
                drh = dc @ U[:, 2 * H:].T
                dr = drh * h * r * (1 - r)
                dx = np.concatenate([dz, dr, dc], axis=1)
                gU[:, :2 * H] += h.T @ dx[:, :2 * H]
                gU[:, 2 * H:] += (r * h).T @ dc
                dh = dh * (1 - m) + dn * z + drh * r + dx[:, :2 * H] @ U[:, :2 * H].T
                np.add.at(dproj[:, off:off + 3 * H], ids[:, t], dx)
            g[f"U{d}"] = gU
        dproj = dproj[:-1]
        dx = np.zeros_like(x)
        for d, off in (("f", 0), ("b", 3 * H)):
            part = dproj[:, off:off + 3 * H]
            g[f"W{d}"], g[f"c{d}"] = x.T @ part, part.sum(0)
            dx += part @ p[f"W{d}"].T
        g["word"] = (words.word, dx[:, :DIM])
        n = np.maximum(words.sizes(), 1)
        g["gram"] = (words.gram, np.repeat(dx[:, DIM:] / n[:, None], words.sizes(), axis=0))
        loss = -np.mean(y * np.log(prob + 1e-7) + (1 - y) * np.log(1 - prob + 1e-7))
        return float(loss), g


class Adam:
    def __init__(self, p: dict, rate: float, scale: dict):
        self.p, self.rate, self.scale, self.t = p, rate, scale, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, grads: dict) -> None:
        self.t += 1
        fix = math.sqrt(1 - 0.999 ** self.t) / (1 - 0.9 ** self.t)
        for k, g in grads.items():
            if isinstance(g, tuple):  # rows of an embedding: only those that occur move
                rows, at = np.unique(g[0], return_inverse=True)
                full = np.zeros((len(rows), g[1].shape[1]), np.float32)
                np.add.at(full, at, g[1])
                g = full
            else:
                rows = slice(None)
            self.m[k][rows] = 0.9 * self.m[k][rows] + 0.1 * g
            self.v[k][rows] = 0.999 * self.v[k][rows] + 0.001 * g * g
            self.p[k][rows] -= self.rate * self.scale.get(k, 1.0) * fix * self.m[k][rows] / (np.sqrt(self.v[k][rows]) + 1e-7)


def window_ids(ids: np.ndarray, pad: int) -> np.ndarray:
    """All overlapping windows of a word sequence, padded; one empty window if there is no word."""
    n = len(ids)
    count = max(1, -(-(n - WINDOW) // STRIDE) + 1) if n > WINDOW else 1
    full = np.full((count - 1) * STRIDE + WINDOW, pad, np.int64)
    full[:n] = ids
    return full[np.arange(count)[:, None] * STRIDE + np.arange(WINDOW)]


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit by damped Newton steps, the slope held near 1 by a ridge."""
    w, ridge = np.array([1.0, 0.0]), 20 / max(len(x), 1)
    X = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(200):
        p = _sigmoid(X @ w)
        g = X.T @ (p - y) + ridge * np.array([w[0] - 1, 0.0]) + 0.02 * np.array([0.0, w[1]])
        h = (X * (p * (1 - p))[:, None]).T @ X + np.diag([ridge, 0.02])
        w = w - 0.5 * np.linalg.solve(h, g)
    return max(float(w[0]), 0.05), float(w[1])


def train(texts: list[str], labels: np.ndarray, seed: int = 7, epochs: int = 3, batch: int = 256) -> Network | None:
    """Fit on whole labelled texts; None if a class is missing."""
    labels = np.asarray(labels, np.float32)
    if len(set(labels.tolist())) < 2:
        return None
    rng = np.random.default_rng(seed)
    vocab: dict[str, int] = {}
    docs = [np.array([vocab.setdefault(w, len(vocab)) for w in (t or "").lower().split()], np.int64) for t in texts]
    if not vocab:
        return None
    words = Words.of(list(vocab))
    net, pad = Network(seed), len(vocab)
    fit = rng.random(len(docs)) < 0.85
    for c in (0, 1):  # each class needs rows on both sides
        own = np.flatnonzero(labels == c)
        fit[own[0]] = True
        if len(own) > 1:
            fit[own[1]] = False
    fit_rows, out_rows = np.flatnonzero(fit), np.flatnonzero(~fit)

    # class log-odds of presence in a document, by bucket, as the first embedding channel
    for name, flat, sizes in (("word", words.word, np.ones(len(words.word), np.int64)), ("gram", words.gram, words.sizes())):
        first = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        seen = np.zeros((2, BUCKETS))
        for k in fit_rows:
            u = np.unique(docs[k])
            at = np.repeat(first[u] - np.concatenate(([0], np.cumsum(sizes[u])))[:-1], sizes[u]) + np.arange(sizes[u].sum())
            seen[int(labels[k]), np.unique(flat[at])] += 1
        n1, n0 = labels[fit_rows].sum(), (1 - labels[fit_rows]).sum()
        seen = np.maximum(seen - 1, 0)  # what a document says about itself does not count
        odds = np.log((seen[1] + 0.2) / (n1 + 0.4)) - np.log((seen[0] + 0.2) / (n0 + 0.4))
        support = seen.sum(0)
        net.p[name][:, 0] = np.clip(odds * support / (support + 4), -2, 4) / 2
    evidence = np.append(net.p["word"][words.word, 0], 0)
    grams = np.add.reduceat(net.p["gram"][words.gram, 0], words.start) / words.sizes()
    evidence[:-1] += grams

    spans = [window_ids(d, pad) for d in docs]
    owner = np.repeat(np.arange(len(docs)), [len(s) for s in spans])
    every = np.concatenate(spans)
    strength = np.sort(evidence[every], axis=1)[:, -3:].sum(1)

    def pick() -> np.ndarray:
        """Windows to learn from: the strongest two of each document, and two others of clean ones."""
        chosen = []
        order = np.lexsort((-strength, owner))
        start = np.searchsorted(owner[order], np.arange(len(docs) + 1))
        for k in fit_rows:
            own = order[start[k]:start[k + 1]]
            chosen.append(own[:1] if labels[k] else own[:2])
            if not labels[k] and len(own) > 2:
                chosen.append(rng.choice(own[2:], min(2, len(own) - 2), replace=False))
        return np.concatenate(chosen)

    # few labelled rows must not teach single words: embeddings then move slowly
    trust = float(n1 / (n1 + 1500))
    adam = Adam(net.p, 0.01, {"word": trust, "gram": trust})
    for epoch in range(epochs):
        if epoch:
            strength = score_windows(net, net.project(net.inputs(words)), every, pad)
        chosen = pick()
        share = max(labels[owner[chosen]].mean(), 1e-6)
        # enough steps to settle on a small sample, and one pass over a large one
        steps = min(max(60, len(chosen) // batch), 150)
        weight = np.where(labels[owner[chosen]] > 0, 0.4 / share, 0.6 / max(1 - share, 1e-6))
        prob = weight / weight.sum()
        for _ in range(steps):
            take = rng.choice(chosen, min(batch, len(chosen)), p=prob)
            ids = every[take]
            used, local = np.unique(ids, return_inverse=True)
            local = local.reshape(ids.shape)
            part = words.take(used[used != pad])
            _, g = net.gradients(part, local, (ids != pad).astype(np.float32), labels[owner[take]])
            adam.step(g)
    logits = score_windows(net, net.project(net.inputs(words)), every, pad)
    top = np.full(len(docs), -np.inf)
    np.maximum.at(top, owner, logits)
    net.scale = _calibrate(top[out_rows].astype(np.float64), labels[out_rows])
    return net


def score_windows(net: Network, proj: np.ndarray, ids: np.ndarray, pad: int, batch: int = 4096) -> np.ndarray:
    ids = np.where(ids == pad, len(proj) - 1, ids)
    out = [net.forward(proj, part, (part != len(proj) - 1).astype(np.float32))[0] for part in (ids[i:i + batch] for i in range(0, len(ids), batch))]
    return np.concatenate(out) if out else np.zeros(0, np.float32)


class Scorer:
    """Scores texts with word projections kept per task (at most ``LIMIT`` words)."""

    LIMIT = 400_000

    def __init__(self, net: Network):
        self.net = net
        self.clear()

    def clear(self):
        self.index: dict[str, int] = {}
        self.rows = np.zeros((1024, 6 * HIDDEN), np.float32)
        self.n = 0

    def _project(self, new: list[str]) -> None:
        made = self.net.project(self.net.inputs(Words.of(new)))[:-1]
        need = self.n + len(new) + 1
        if need > len(self.rows):
            grown = np.zeros((max(need, 2 * len(self.rows)), self.rows.shape[1]), np.float32)
            grown[:self.n] = self.rows[:self.n]
            self.rows = grown
        self.rows[self.n:self.n + len(new)] = made
        self.rows[self.n + len(new)] = 0
        self.n += len(new)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.n > self.LIMIT:
            self.clear()
        index, new, docs = self.index, [], []
        for t in texts:
            words = t.lower().split() if t else []
            for w in words:
                if w not in index:
                    index[w] = len(index)
                    new.append(w)
            docs.append(np.fromiter((index[w] for w in words), np.int64, len(words)))
        if new:
            self._project(new)
        pad = self.n
        self.rows[pad] = 0
        spans = [window_ids(d, pad) for d in docs]
        first = np.concatenate(([0], np.cumsum([len(s) for s in spans])))[:-1]
        logits = score_windows(self.net, self.rows[:pad + 1], np.concatenate(spans), pad)
        a, b = self.net.scale
        made = _sigmoid(a * np.maximum.reduceat(logits, first).astype(np.float64) + b)
        return np.where([len(d) > 0 for d in docs], made, 0.0)


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> DataFrame | None:
    """At most ``rows`` labelled texts of each class that are not held out: toxic, h, doc_id, text."""
    marked = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("__toxic"))
    slim = (  # choose by id; only the chosen texts are moved
        docs.where(F.length("text") <= chars).select("doc_id").join(marked, "doc_id")
        .where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2)
        .dropDuplicates(["doc_id"]).select("__toxic", F.xxhash64("doc_id").alias("__h"), "doc_id")
    )
    picked = [tuple(r) for c in (1, 0) for r in slim.where(F.col("__toxic") == c).orderBy("__h", "doc_id").limit(rows).collect()]
    if not picked:
        return None
    wanted = docs.sparkSession.createDataFrame(picked, "__toxic int, __h bigint, doc_id bigint")  # at most 2 * rows
    return (
        docs.where(F.length("text") <= chars).select("doc_id", "text").join(F.broadcast(wanted), "doc_id")
        .groupBy(F.col("__toxic").alias("toxic"), F.col("__h").alias("h"), "doc_id").agg(F.min("text").alias("text"))
    )


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, seed: int = 7) -> Network | None:
    """Train in one task on the bounded sample; the weights (a fixed size) come back to the driver."""
    sample = labelled_sample(docs, labels, rows, chars)
    if sample is None:
        return None

    def run(batches):
        got = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (-r["toxic"], r["h"], r["doc_id"]))
        net = train([r["text"] for r in got], np.array([r["toxic"] for r in got], np.float32), seed) if got else None
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], names=["model"])

    return pickle.loads(sample.repartition(1).mapInArrow(run, "model binary").first()[0])


def score(docs: DataFrame, net: Network | None, carry: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``carry`` columns of ``docs`` (default: all), score and predicted."""
    carry = [c for c in (carry if carry is not None else docs.columns) if c not in ("score", "predicted")]
    extra = [] if "text" in carry else ["text"]
    rows = docs.select(*carry, *extra).withColumn("score", F.lit(0.0))
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        scorer = Scorer(sent.value) if sent.value is not None else None
        for b in batches:
            texts = b.column(b.schema.get_field_index("text"))
            done = np.zeros(b.num_rows)
            if scorer is not None:
                i = 0
                while i < b.num_rows:  # about a million characters at a time
                    part, size = [], 0
                    while i + len(part) < b.num_rows and (not part or size < 1_000_000):
                        t = texts[i + len(part)].as_py()
                        part.append(t)
                        size += len(t or "")
                    done[i:i + len(part)] = scorer.scores(part)
                    i += len(part)
            at = b.schema.get_field_index("score")
            yield pa.RecordBatch.from_arrays([pa.array(done) if k == at else b.column(k) for k in range(b.num_columns)], names=b.schema.names)

    scored = rows.mapInArrow(run, rows.schema)
    return scored.select(*carry, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
