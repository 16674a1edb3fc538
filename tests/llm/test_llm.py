"""Small fixtures with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trafficlab.llm import chat, decontam, html_template, imatch, minhash, mixing, sharding, site_lines, suffix_dedup, toxicity

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, score string, shard string"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(["ka", "lo", "mi", "ten", "sor", "ve"]) for _ in range(r.randint(1, 4))) for _ in range(n))


def hostile(spark):
    long_text = prose(1, 6000)
    base = prose(2, 200)
    near = base.replace(base.split()[50], "changed", 1)
    texts = [base, base, near, None, "", "x", "one two three", long_text, long_text + " tail", prose(3, 80), prose(3, 80) + "\n" + prose(4, 30), "naïve ünïcode 漢字 " * 30]
    rows = [(i, t, "en", None if i == 5 else f"s{i % 3}", None, "clash", None, "x") for i, t in enumerate(texts)]
    rows += [rows[3], rows[0], (None, base, None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3), rows


def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return (text or "").encode().lower().split()


def test_sharding(spark):
    docs, rows = hostile(spark)
    out = sharding.shard_by_bytes(docs, 4).collect()
    assert len(out) == len(rows)
    assert sum(r["size"] for r in out) == sum(len((t[1] or "").encode()) + 16 for t in rows)
    for k in range(4):
        slots = sorted(r["slot"] for r in out if r["shard"] == k)
        assert slots == list(range(len(slots)))
    ids = [(r["shard"], -1 if r["doc_id"] is None else r["doc_id"]) for r in out]
    assert [i for _, i in sorted(ids)] == sorted(i for _, i in ids)  # contiguous
    assert all(r["text_crc32"] == zlib.crc32((r["text"] or "").encode()) for r in out)
    assert sharding.shard_by_bytes(empty(spark), 4).count() == 0


def test_site_lines(spark):
    rows = [(i, f"header\nbody {i}\n\n header ", "a" if i < 8 else None) for i in range(10)] + [(10, None, "a"), (11, "", "a"), (0, "header\nbody 0\n\n header ", "a")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("n_lines", F.lit("clash"))
    out = site_lines.drop_site_lines(docs, ratio=0.5, min_pages=3).collect()
    assert len(out) == len(rows)
    for r in out:
        if r["doc_id"] == 10:
            assert r["text"] is None and r["n_lines"] == 0
        elif r["doc_id"] == 11:
            assert r["text"] == ""
        elif r["source"] == "a":
            assert r["text"] == f"body {r['doc_id']}\n" and r["n_dropped"] == 2
        else:  # two pages only
            assert r["n_dropped"] == 0
    assert site_lines.drop_site_lines(empty(spark)).count() == 0


def test_chat_round_trip(spark):
    said = "\\### Assistant: </turn> ok"
    turns = [(1, 0, "user", said), (1, 1, "assistant", said + "\\a\\"), (1, 1, "assistant", None), (2, None, None, "###"), (2, 0, "to]: ol", ""),
             (None, 0, "system", "<"), (3, 0, "user", "q"), (3, 1, "assistant", "a\n### User: b</turn>\n")]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").withColumn("segments", F.lit(1))
    out = chat.format_conversations(df).withColumn("f", chat.formatted()).withColumn("back", chat.read_back(F.col("f"))).withColumn("loss", chat.loss_text()).collect()
    got = {r["conv_id"]: r for r in out}
    assert [(t["role"], t["text"]) for t in got[3]["back"]] == [("user", "q"), ("assistant", "a\n### User: b</turn>\n")]
    assert got[3]["valid"] and not got[1]["valid"] and not got[2]["valid"]
    assert [(t["role"], t["text"]) for t in got[1]["back"]] == [("user", said), ("assistant", ""), ("assistant", said + "\\a\\")]
    assert got[1]["loss"] == said + "\\a\\"
    assert [t["role"] for t in got[2]["back"]] == [None, "to]: ol"]
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_mixing(spark):
    docs, rows = hostile(spark)
    out = mixing.mix(docs, shards=4, blocks_per_shard=8).collect()
    again = mixing.mix(docs.repartition(2), shards=4, blocks_per_shard=8).collect()
    key = lambda r: (str(r["doc_id"]), r["copy"], r["words"], r["shard"], r["shuffle_key"])
    assert sorted(map(str, map(key, out))) == sorted(map(str, map(key, again)))
    total = sum(len(words(r[1])) for r in rows)
    by = {}
    for r in rows:
        by[r[3]] = by.get(r[3], 0) + len(words(r[1]))
    for s, size in by.items():
        own = [r for r in out if r["source"] == s]
        assert abs(sum(r["words"] for r in own) - own[0]["target"]) <= 0.5 + 1e-6
        assert own[0]["target"] <= 3 * size + 1e-6
    assert abs(sum(r["words"] for r in out) - total) <= len(by)
    assert all(r["words"] == 0 or r["shard"] is not None for r in out)
    quota = {}
    for r in out:
        quota[r["shard"]] = quota.get(r["shard"], 0) + r["words"]
    assert max(v for k, v in quota.items() if k is not None) <= 2.5 * total / 4
    assert mixing.mix(empty(spark)).count() == 0


def test_hypergeometric_splits_are_exact(spark):
    q = spark.createDataFrame([("a", 40), ("b", 7), ("c", 0), ("d", 17)], "__mix_key string, __mix_quota bigint")
    out = mixing.split_quotas(q, 8, 3).collect()
    by_shard, by_source = {}, {}
    for r in out:
        assert r["blocks"] >= 0
        by_shard[r["shard"]] = by_shard.get(r["shard"], 0) + r["blocks"]
        by_source[r["__mix_key"]] = by_source.get(r["__mix_key"], 0) + r["blocks"]
    assert by_source == {"a": 40, "b": 7, "c": 0, "d": 17}
    assert set(by_shard.values()) == {8}


def test_decontamination(spark):
    question = "If Alice Smith has 12 apples and gives Bob 5 kg of them to each of her friends how many apples will she keep today"
    other = question.replace("Alice Smith", "Maria").replace("12", "99").replace("Bob", "Tom").replace("kg", "km")
    crossed = question.replace("Bob", "Alice Smith")
    docs = spark.createDataFrame(
        [(1, f"Well. {question}. Yes."), (2, f"Well then. {other}."), (3, prose(5, 300)), (4, None), (5, ""), (6, "if alice"), (1, f"Well. {question}. Yes."), (7, prose(6, 40000) + " . " + question), (None, question)],
        "doc_id bigint, text string").withColumn("items", F.lit("clash"))
    bench = spark.createDataFrame([(10, question), (11, None), (12, ""), (13, "Too short")], "item_id bigint, text string")
    for block in (2_000_000, 1):
        got = {(r["doc_id"], r["contaminated"], tuple(r["items"]), r["reparameterised"]) for r in decontam.find_contamination(docs, bench, block_windows=block).collect()}
        assert got == {(1, True, (10,), False), (2, True, (10,), True), (3, False, (), False), (4, False, (), False), (5, False, (), False),
                       (6, False, (), False), (7, True, (10,), False), (None, True, (10,), False)}
    assert decontam.find_contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontam.find_contamination(docs.limit(0), bench).count() == 0
    block = decontam.Block([(1, question.encode())], decontam.WINDOW)
    v = decontam.Vocabulary()
    assert block.judge(*v.tokens(question.encode()), 0.6, 0.8)
    assert not block.judge(*v.tokens(crossed.encode()), 0.6, 0.99)  # one value stands for two


def judged(item: str, text: str):
    v = decontam.Vocabulary()
    return decontam.Block([(1, item.encode())], decontam.WINDOW).judge(*v.tokens(text.encode()), 0.6, 0.8)


def test_decontamination_finds_verbatim_items_of_mostly_slots():
    sums = "Compute 12 + 35 - 7 * 18 / 9 + 44 - 61 + 5 * 3 + 1020 - 77 = ?"
    for item in (sums, "12 + 35 = ?", "Sort 9 8 7 12 55 31 2 40 18 77"):
        assert judged(item, f"{prose(41, 60)}. {item} {prose(42, 60)}") == [(1, 1.0, 1.0, False)]
    assert not judged(sums, "Compute 11 + 36 - 8 * 19 / 8 + 45 - 62 + 6 * 2 + 1021 - 78 = ?")  # its template says nothing
    assert not judged("12 + 35 = ?", "13 + 35 = ? and 12 + 35 - 1 = ?")


def test_decontamination_finds_renamed_sentence_openers():
    item = "Tom has 12 apples. Tom gives Ann 3 apples. Ann eats 2 apples. How many apples does Tom have left?"
    copy = item.replace("Tom", "Max").replace("Ann", "Eve").replace("12", "15")
    (_, cover, share, other), = judged(item, f"The How and Why. {prose(43, 60)}. {copy} {prose(44, 60)}")
    assert cover > 0.9 and share == 1 and other
    assert judged(item, f"The How and Why. {prose(43, 60)}. {item} {prose(44, 60)}") == [(1, 1.0, 1.0, False)]
    lone = "Tom has 3 big red apples. Tom buys 4 small green ones. Tom eats 2 of them now. How many are left at home?"
    assert judged(lone, lone.replace("Tom", "Max"))


def test_decontamination_judges_one_place():
    assert not judged("Yes.", "yes I said") and not judged("Who was Einstein?", "He asked who was Newton?")
    assert not judged("Who was Albert Einstein?", "Who was Isaac Newton?")
    assert judged("Who was Albert Einstein?", "He asked: who was Albert Einstein? Yes.")[0][0] == 1
    item = prose(45, 40).split()
    scattered = " ".join(f"{' '.join(item[i:i + 10])} {prose(46 + i, 400)}" for i in range(0, 40, 10))
    assert not judged(" ".join(item), scattered)  # four quarters, far apart
    assert judged(" ".join(item), " ".join(item[:20] + ["so"] + item[20:]) + scattered)
    question = "if there are 12 apples and he gives Bob 5 kg of them to Eve how many will he keep then"
    wrong = question.replace("Bob", "Tom").replace("Eve", "Tom").replace("12", "7").replace(" 5 ", " 7 ")
    assert judged(question, f"{question} . {(prose(50, 200) + ' . ' + wrong + ' . ') * 4}") == [(1, 1.0, 1.0, False)]


def test_window_join_matches_brute_force():
    block = decontam.Block([(i, prose(100 + i, 30).encode()) for i in range(20)], decontam.WINDOW)
    v = decontam.Vocabulary()
    for k in range(30):
        text = (prose(k, 50) + " " + (prose(100 + k, 30) if k < 20 else "") + " " + prose(k + 50, 20)).encode()
        grams = lambda t: {tuple(t[i:i + decontam.WINDOW]) for i in range(len(t) - decontam.WINDOW + 1)}
        have = grams(text.split())
        want = [i for i in range(20) if len(grams(prose(100 + i, 30).encode().split()) & have) >= 11]
        assert [j[0] for j in block.judge(*v.tokens(text), 0.6, 0.8)] == want


def test_toxicity_learns_and_scores_windows(spark):
    bad = ["grimbal", "fostrum", "quexil"]
    rows, labels = [], []
    for i in range(240):
        t = prose(1000 + i, 60).split()
        toxic = i % 3 == 0
        if toxic:
            for k in range(3):
                t.insert((i * 7 + k * 13) % 60, bad[(i + k) % 3])
        rows.append((i, " ".join(t)))
        labels.append((i, int(toxic)))
    rows += [(900, None), (901, ""), (902, prose(7, 3000) + " grimbal fostrum you quexil " + prose(8, 3000)), (None, "grimbal quexil fostrum"), (0, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("score", F.lit("clash"))
    net = toxicity.fit(docs, spark.createDataFrame(labels + [(5, None)], "doc_id bigint, toxic int"))
    out = toxicity.score(docs, net).collect()
    got = {r["doc_id"]: r for r in out}
    truth = dict(labels)
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 4 == 2]
    wrong = sum(got[i]["predicted"] != truth[i] for i in held)
    assert wrong <= 0.1 * len(held)
    assert got[900]["score"] == 0 and got[901]["score"] == 0 and got[902]["predicted"] == 1
    assert all(0 <= r["score"] <= 1 for r in out) and len(out) == len(rows)
    assert toxicity.fit(docs, spark.createDataFrame([(1, 0)], "doc_id bigint, toxic int")) is None
    assert {r["predicted"] for r in toxicity.score(docs, None).collect()} == {0}
    assert toxicity.score(docs.limit(0), net).count() == 0


def test_gradients_agree_with_differences():
    net = toxicity.Network(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    w = toxicity.Words.of(["alpha", "beta", "gamma", "a"])
    ids = np.array([[0, 1, 2, 4], [3, 0, 4, 4]])
    mask, y = (ids != 4).astype(np.float32), np.array([1.0, 0.0])
    loss, g = net.gradients(w, ids, mask, y)
    for name in ("Wf", "Ub", "A", "v", "o", "cb"):
        flat = net.p[name].reshape(-1)
        for k in (0, len(flat) // 2):
            keep = flat[k]
            flat[k] = keep + 1e-3
            up = net.gradients(w, ids, mask, y)[0]
            flat[k] = keep - 1e-3
            down = net.gradients(w, ids, mask, y)[0]
            flat[k] = keep
            assert abs((up - down) / 2e-3 - g[name].reshape(-1)[k]) < 2e-3


def brute_components(rows, percent):
    sets = {}
    for r in rows:
        if r[0] is None:
            continue
        w = words(r[1])
        sets[r[0]] = frozenset(tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()
    low = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if a != b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both) and low[b] < low[a]:
                    low[a], changed = low[b], True
    return low, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize("blocks", [(2048, 1_000_000), (3, 150)])
def test_minhash_components(spark, blocks, monkeypatch):
    docs, rows = hostile(spark)
    base = prose(2, 200).split()
    for k in range(12):  # a chain of small edits
        base[10 * k + 3] = f"edit{k}"
        rows.append((100 + k, " ".join(base).upper() if k % 2 else " ".join(base), None, None, None, None, None, None))
    monkeypatch.setattr(minhash, "BLOCK_ROWS", blocks[0])
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", blocks[1])
    out = minhash.near_duplicates(spark.createDataFrame(rows, DOCS), 85).collect()
    low, size = brute_components(rows, 85)
    assert len(out) == len(rows)
    for r in out:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["component_id"], r["n_shingles"], r["kept"]) == (low[r["doc_id"]], size[r["doc_id"]], low[r["doc_id"]] == r["doc_id"])


def test_minhash_blocks_are_bounded_by_rows(spark, monkeypatch):
    base = prose(31, 40).split()
    rows = [(k, " ".join([*base[:20], f"edit{k}", *base[20:]]), *[None] * 6) for k in range(60)]  # far below a million shingles
    held = []
    pairs = minhash._block_pairs

    def seen(df, keys, blocks):
        out = pairs(df, keys, blocks)
        if keys == ["component"]:
            held.extend(out.groupBy("component", "low", "high").count().collect())
        return out

    monkeypatch.setattr(minhash, "BLOCK_ROWS", 6)
    monkeypatch.setattr(minhash, "_block_pairs", seen)
    out = minhash.near_duplicates(spark.createDataFrame(rows, DOCS), 75).collect()
    low, _ = brute_components(rows, 75)
    assert {r["doc_id"]: r["component_id"] for r in out} == low
    assert len(held) == 55 and max(r["count"] for r in held) < 30


def test_links_are_counted_tile_by_tile(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(minhash, "TILE_ROWS", 4)
    monkeypatch.setattr(minhash, "TILE_SHINGLES", 16)
    r = np.random.default_rng(4)
    sets = [np.unique(np.concatenate([np.arange(40 * (k // 6), 40 * (k // 6) + 40), r.integers(1000, 1100, 6)])).astype(np.uint64) for k in range(23)]
    rows = pa.RecordBatch.from_pydict({"component": [1] * 23, "low": [0] * 23, "high": [0] * 23, "rep": list(range(23)), "set": [x.tobytes() for x in sets]})
    got = [e for b in minhash._confirm(70)([rows]) for e in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    linked = lambda a, b: 100 * len(np.intersect1d(sets[a], sets[b])) >= 70 * len(np.union1d(sets[a], sets[b]))
    root = list(range(23))
    for _ in range(23):
        root = [min([root[b] for b in range(23) if linked(a, b)]) for a in range(23)]
    assert sorted(got) == sorted((root[k], k) for k in range(23) if root[k] != k)


def test_bands_miss_few_threshold_pairs():
    assert [minhash.band_rows(p) for p in (85, 80)] == [6, 4]
    assert all(minhash.missed(p, minhash.band_rows(p)) <= 2e-5 for p in range(50, 100))
    r = np.random.default_rng(80)
    a = r.integers(0, 2**32, (20_000, minhash.HASHES), dtype=np.uint32)
    b = np.where(r.random(a.shape) < 0.8, a, a ^ np.uint32(1))  # minima of pairs at 0.80
    rows = minhash.band_rows(80)
    assert all((minhash.bands(x, rows) == minhash.bands(y, rows)).any() for x, y in zip(a, b))


def test_minhash_empty(spark):
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_bit_estimate_is_close():
    shingler = minhash.Shingler()
    a = prose(11, 800).split()
    b = a[:720] + prose(12, 80).split()
    sets = []
    for t in (a, b):
        raw = " ".join(t).encode()
        h, _ = shingler.shingles(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        sets.append(np.unique(h))
    true = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
    sig = np.stack([np.frombuffer(minhash.pack(minhash.minima(s)), np.uint64) for s in sets])
    assert abs(minhash.estimate(sig[:1], sig[1:])[0, 0] - true) < 0.15


def test_imatch(spark):
    docs, rows = hostile(spark)
    out = imatch.compare_edits(docs).collect()
    assert len(out) == len(rows)
    known = sorted((r for r in rows if r[0] is not None and r[0] not in (0, 3)), key=lambda r: r[0])
    got = {r["doc_id"]: r for r in out}
    for a, b in zip(known, known[1:]):
        if b[0] - a[0] == 1:
            t, u = a[1] or "", b[1] or ""
            q = len(t) // 4
            edited = t[:len(t) - q] + u[:q]
            assert got[a[0]]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[a[0]]["n_chars"] == len(t)
    by_text = {}
    for r in out:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        text = next((x[1] or "") for x in rows if x[0] == r["doc_id"]) if r["doc_id"] is not None else None
        if text is not None:
            assert by_text.setdefault(text, r["fingerprint"]) == r["fingerprint"]
    assert got[7]["near_next"] > 0.8  # the same long text and one more word
    assert imatch.compare_edits(empty(spark)).count() == 0


def test_html_template(spark):
    def page(i, extra=""):
        return (f"<!DOCTYPE html><html><head><title>T{i}</title><script>var x='</p>';</script></head><body><nav><ul><li><a href='/x'>menu {i}</a></ul></nav>"
                f"<div class='cookie-notice'>We use cookies</div><article><h1>Head {i} &amp; co</h1><p><b>First {i}.<br><p>Second\n  &eacute;t {i}</p>{extra}</article>"
                f"<aside>side</aside><section id='comments'><p>nice {i}</p></section><form>name</form><footer>&copy; x</footer>")
    rows = [(i, f"https://a.example/{i}", page(i)) for i in range(6)] + [(6, "https://b.example/x", page(6)), (7, None, None), (8, "odd", ""), (9, "https://a.example/9", "plain <p>text"), (0, "https://a.example/0", page(0))]
    rows += [(20 + i, f"http://c.example/{i}", f"<html><body><div class='top'><a href='/'>home</a> <a href='/b'>all</a></div><div class='body'><p>{prose(i, 40)}</p><p>{prose(i + 9, 20)}</p></div><div class='legal'>All rights reserved</div></body></html>") for i in range(5)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("clash")).withColumn("slots", F.lit(1))
    out = html_template.extract_main_text(pages).collect()
    assert len(out) == len(rows)
    got = {r["page_id"]: r["text"] for r in out}
    for i in range(7):
        assert got[i] == f"Head {i} & co\n\nFirst {i}.\n\nSecond ét {i}"
    assert got[7] == "" and got[8] == "" and got[9] == "plain\n\ntext"
    for i in range(5):
        assert got[20 + i] == f"{prose(i, 40)}\n\n{prose(i + 9, 20)}"
    assert all(r["n_chars"] == len(r["text"]) for r in out)
    assert html_template.extract_main_text(pages.limit(0)).count() == 0


def test_html_template_decides_without_known_names(spark):
    def article(i):
        return (f"<html><body><div class='xq1'>Daily {i}</div><main><div class='xq2'><p>Read our paper every day</p></div><h1>Head {i}</h1><div class='xq3'><p>{prose(800 + i, 40)}</p></div>"
                f"<div class='xq4'>Written by our own staff</div></main></body></html>")

    def plain(i):
        return (f"<html><body><div class='xq5'><a href='/'>home</a> <a href='/b'>all</a></div><div class='xq6'>Head {i}</div><div class='xq7'><p>{prose(900 + i, 90)}</p></div>"
                f"<div class='xq8'>Printed on paper since 1900</div></body></html>")
    rows = [(i, f"https://main.example/{i}", article(i)) for i in range(6)] + [(10 + i, f"https://plain.example/{i}", plain(i)) for i in range(6)]
    rows += [(20 + i, f"https://same.example/{i}", article(0)) for i in range(5)]
    got = {r["page_id"]: r["text"] for r in html_template.extract_main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    for i in range(6):
        assert got[i] == f"Head {i}\n\n{prose(800 + i, 40)}"
        assert got[10 + i] == f"Head {i}\n\n{prose(900 + i, 90)}"
    assert all(prose(800, 40) in got[20 + i] for i in range(5))  # copies only: nothing tells template and text apart


def brute_suffix(rows, length):
    owner, out = {}, {}
    full = [(2**63 if r[0] is None else r[0], (r[1] or "").encode()) for r in rows]
    for d, t in full:
        for j in range(len(t) - length + 1):
            s = t[j:j + length]
            owner[s] = min(owner.get(s, d), d)
    for d, t in full:
        gone = np.zeros(len(t), bool)
        for j in range(len(t) - length + 1):
            if owner[t[j:j + length]] < d:
                gone[j:j + length] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + (gone[0] if len(t) else 0))
        out[d] = (len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("block", [4 << 20, 3000])
def test_suffix_dedup(spark, block):
    _, rows = hostile(spark)
    shared = prose(77, 25)
    rows = rows[:13] + [(200 + i, prose(300 + i, 15) + shared[i:] + prose(400 + i, 10), None, None, None, None, None, None) for i in range(12)] + [(300, "ab" * 100, *[None] * 6), (301, "ba" * 90, *[None] * 6), (None, shared, *[None] * 6)]
    out = suffix_dedup.drop_repeated_bytes(spark.createDataFrame(rows, DOCS), block_bytes=block).collect()
    want = brute_suffix(rows, 50)
    assert len(out) == len(rows)
    for r in out:
        assert tuple(r)[1:] == want[2**63 if r["doc_id"] is None else r["doc_id"]], r["doc_id"]


def hot_rows():
    """A passage shorter and one longer than 50 bytes, with other neighbours in each document."""
    short, long_ = prose(78, 5)[:30], prose(79, 14)[:70]
    rows = [(500 + i, prose(600 + i, 12) + (short if i % 2 else long_) + prose(700 + i, 12), *[None] * 6) for i in range(60)]
    return rows + [(560 + i, prose(600 + i, 12) + short + prose(700 + i, 12) + "!", *[None] * 6) for i in range(0, 60, 7)]


@pytest.mark.parametrize("block", [4 << 20, 3000])
def test_suffix_dedup_spreads_frequent_names(spark, block, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_NAME", 8)
    monkeypatch.setattr(suffix_dedup, "BUCKET_NAMES", 500)
    rows = hot_rows()
    rows += [(*rows[3][:1], rows[5][1], *[None] * 6), (None, rows[7][1] + prose(1, 9), *[None] * 6)]
    out = suffix_dedup.drop_repeated_bytes(spark.createDataFrame(rows, DOCS), block_bytes=block).collect()
    want = {}
    for r in rows:  # rows with equal doc_id do not remove from each other
        d = 2**63 if r[0] is None else r[0]
        others = [x for x in rows if x[0] is not None and x[0] < d]
        want.setdefault(r[0], []).append(brute_suffix([*others, (2**63, r[1])], 50)[2**63])
    assert any(w[0][1] for w in want.values())
    assert sorted((str(r["doc_id"]), tuple(r)[1:]) for r in out) == sorted((str(d), w) for d, ws in want.items() for w in ws)


def test_suffix_buckets_hold_few_contexts_of_one_name():
    import pyarrow as pa

    blocks = [pa.table({"block": [k] * 20, "doc_id": [r[0] for r in hot_rows()[20 * k:20 * k + 20]], "h": list(range(20)),
                        "text": [r[1] for r in hot_rows()[20 * k:20 * k + 20]]}) for k in range(3)]
    none = suffix_dedup._table({"kind": pa.int32(), "key": pa.int64(), "h": pa.int64(), "payload": pa.binary()}, [])
    sent = pa.concat_tables([suffix_dedup._send_names(1, 50, 20)(b, none) for b in blocks])
    answers = suffix_dedup._find_repeated(8)(sent)
    around = pa.concat_tables([
        suffix_dedup._send_contexts(1, 1, 4, 50, 20)(b, answers.filter(pa.array([x == k for x in answers.column("block").to_pylist()])))
        for k, b in enumerate(blocks)])
    names = [n for b, x in zip(around.column("bucket").to_pylist(), around.column("name").to_pylist()) if b == 0 for n in np.frombuffer(x, np.uint64)]
    assert max(np.unique(names, return_counts=True)[1], default=0) <= 8
    assert {b for b in around.column("bucket").to_pylist() if b} == {1, 2, 3, 4}


def test_suffix_dedup_empty(spark):
    assert suffix_dedup.drop_repeated_bytes(empty(spark)).count() == 0
