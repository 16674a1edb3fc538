"""Main-text extraction by equivalence-class template deduction.

1. Every page becomes tokens: element paths (tag and class names from the root)
   and text blocks.  A token's occurrence vector is its count on each page of
   the host; vectors are compared by an order-free sum of hashed (page, count)
   pairs, pre-aggregated per batch and host, so a host with a third of all
   pages costs no more than its share.
2. Tokens with equal vectors form an equivalence class.  A class is valid when
   it has two tokens or more and its tokens occur once on each page they occur
   on.  The valid class with the largest support is the template's root; the
   others nest into it by element path.
3. The template's slots are its elements; every text block belongs to the
   innermost template element around it.  Slots are aggregated per host:
   characters, and characters inside links.  Text blocks that are template
   tokens themselves (the same text once on every page) are template, not
   content, inside article and main, too.  What varies is left open by the
   template and settled by tags and names: boilerplate containers are no main
   slots; if the template has article or main elements, the slots inside them
   are main, otherwise all slots of prose (few links), however short.
4. Each page's blocks in main slots, in order, without the template's, are its
   text.  A page without the host's template (no such slot) is read by its own
   elements.  A page of which nothing is left (all pages of a host are copies)
   keeps the blocks of its slots.

Hosts with fewer than ``MIN_PAGES`` pages share one pooled template.  A
template is at most as large as one page, so one row per host.

Cases: a null or empty html gives an empty text; markup may be unclosed or
cut off; a null or odd url belongs to the empty host; repeated pages and ties
need no order; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .common import drop_staged, staged

MIN_PAGES = 3
POOLED = "*"
# fixed values: element kinds of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that end an open element of the same group.
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOILERPLATE = frozenset("nav header footer aside form script style noscript template iframe svg head button select textarea menu dialog title".split())
NAMES = re.compile(
    r"(?:^|[-_])(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|banner|promo|cookies?|consent|notice|popup|modal|overlay|sidebar|menu|nav|navbar|navigation|"
    r"breadcrumbs?|footer|header|masthead|comments?|replies|reply|disqus|share|sharing|social|related|recommended|newsletter|subscribe|signup|login|widget|pagination|pager)(?:$|[-_])")
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
SPACE = re.compile(r"\s+")


def _step(tag: str, attributes: str) -> tuple[str, bool]:
    """Path step of an element and whether it holds boilerplate."""
    names = []
    bad = tag in BOILERPLATE
    if attributes:
        for m in ATTRIBUTE.finditer(attributes):
            values = (m[2] or m[3] or m[4] or "").lower().split()
            if m[1].lower() == "class":
                names += [re.sub(r"\d+", "N", v).replace("/", "_") for v in values]
            bad = bad or any(NAMES.search(v) or (m[1].lower() == "role" and v in ("navigation", "banner", "contentinfo", "complementary", "search", "form")) for v in values)
    return tag + "".join("." + n for n in sorted(names)), bad


class Page:
    """Element paths and text blocks of a page."""

    def __init__(self, html: str):
        self.elements: dict[str, int] = {}
        #: (path, boilerplate, text, characters inside links)
        self.blocks: list[tuple[str, bool, str, int]] = []
        stack: list[tuple[str, str, bool]] = []  # tag, path, boilerplate
        text: list[str] = []
        linked = 0
        depth_a = 0

        def flush():
            nonlocal text, linked
            if text:
                t = SPACE.sub(" ", entities.unescape("".join(text))).strip()
                if t:
                    path, bad = self._container(stack)
                    self.blocks.append((path, bad, t, linked))
                text, linked = [], 0

        def pop(k: int):
            nonlocal depth_a
            depth_a -= sum(t == "a" for t, _, _ in stack[k:])
            del stack[k:]

        at, n = 0, len(html)
        while at < n:
            m = TOKEN.search(html, at)
            piece = html[at:m.start()] if m else html[at:]
            if piece:
                text.append(piece)
                if depth_a:
                    linked += len(piece)
            if not m:
                break
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:  # end tag
                k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
                if tag in BLOCK:
                    flush()
                if k is not None:
                    pop(k)
                continue
            if tag in BLOCK:
                flush()
                closes = ENDS.get(tag, {"p"})
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in closes:
                        pop(i)
                        break
                    if stack[i][0] in BLOCK and stack[i][0] not in ("p", "li", "dt", "dd", "td", "th", "tr", "tbody"):
                        break
            elif tag == "br":
                text.append(" ")
            step, bad = _step(tag, m[3])
            parent = stack[-1] if stack else ("", "", False)
            path = f"{parent[1]}/{step}"
            self.elements[path] = self.elements.get(path, 0) + 1
            if tag in VOID or m[3].rstrip().endswith("/"):
                continue
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                at = end.end() if end else n
                continue
            stack.append((tag, path, bad or parent[2]))
            depth_a += tag == "a"
        flush()

    @staticmethod
    def _container(stack) -> tuple[str, bool]:
        """Path of the innermost element that is not inline, and whether any element around is boilerplate."""
        bad = bool(stack) and stack[-1][2]
        for tag, path, _ in reversed(stack):
            if tag in BLOCK:
                return path, bad
        return "", bad


def in_article(path: str) -> bool:
    return any(s.split(".")[0] in ("article", "main") for s in path.split("/"))


def prefixes(path: str) -> list[str]:
    """The path and the paths of the elements around it, innermost first."""
    out = [path]
    while "/" in path:
        path = path.rpartition("/")[0]
        out.append(path)
    return out


def _vector(page: bytes, count: int) -> tuple[int, int]:
    h = xxhash.xxh64_intdigest(page + b"%d" % count)
    return h & 0xFFFFFFFF, h >> 32


TOKENS = "host string, token string, is_text boolean, pages bigint, total bigint, va bigint, vb bigint, chars bigint, links bigint, bad boolean"


def _tokens(batches):
    """Occurrence sums of each (host, token) of a batch; a text token is ``#`` and the hash of its text."""
    for b in batches:
        sums: dict[tuple[str, str], list] = {}
        for host, key, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            page = Page(html.as_py() or "")
            uid = key.to_bytes(8, "little", signed=True)
            seen: dict[str, list] = {p: [n, 0, 0, False] for p, n in page.elements.items()}
            for path, bad, text, linked in page.blocks:
                own = seen.setdefault(path, [0, 0, 0, False])
                own[1] += len(text)
                own[2] += min(linked, len(text))
                own[3] = own[3] or bad
                t = seen.setdefault("#" + xxhash.xxh64_hexdigest(text), [0, 0, 0, False])
                t[0] += 1
            for token, (n, chars, links, bad) in seen.items():
                va, vb = _vector(uid, n)
                s = sums.setdefault((host, token), [0, 0, 0, 0, 0, 0, False])
                for i, x in enumerate((1, n, va, vb, chars, links)):
                    s[i] += x
                s[6] = s[6] or bad
        rows = [(h, t, t.startswith("#"), *s) for (h, t), s in sums.items()]
        for i in range(0, len(rows), 20_000):
            part = list(zip(*rows[i:i + 20_000]))
            kinds = [pa.string(), pa.string(), pa.bool_(), *[pa.int64()] * 6, pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(part, kinds)], names=[c.split()[0] for c in TOKENS.split(", ")])


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)), F.lit(""))


def templates(pages: DataFrame) -> DataFrame:
    """One row per host: ``host``, ``slots`` (paths of main slots), ``fixed`` (text tokens of the template)."""
    keyed = pages.select(host_of(F.col("url")).alias("host"), F.xxhash64("page_id", "url").alias("key"), "html")
    by_host = staged(
        keyed.mapInArrow(_tokens, TOKENS).groupBy("host", "token", "is_text").agg(
            *[F.sum(c).alias(c) for c in ("pages", "total", "va", "vb", "chars", "links")], F.max("bad").alias("bad")),
        "html-tokens")
    hosts = staged(
        pages.groupBy(host_of(F.col("url")).alias("host")).agg(F.count("*").alias("host_pages"))
        .withColumn("grp", F.when(F.col("host_pages") >= MIN_PAGES, F.col("host")).otherwise(POOLED)), "html-hosts")
    sizes = hosts.groupBy("grp").agg(F.sum("host_pages").alias("grp_pages"))
    token = (
        by_host.join(hosts.select("host", "grp"), "host").groupBy("grp", "token", "is_text")
        .agg(*[F.sum(c).alias(c) for c in ("pages", "total", "va", "vb", "chars", "links")], F.max("bad").alias("bad"))
        .join(sizes, "grp")
    )
    token = staged(token, "html-vectors")
    # equivalence classes: equal vectors; valid: two tokens or more, once on each of their pages
    classes = token.where("total = pages").groupBy("grp", "pages", "va", "vb").agg(F.count("*").alias("tokens")).where("tokens >= 2")
    best = Window.partitionBy("grp").orderBy(F.col("pages").desc(), F.col("tokens").desc(), "va", "vb")
    root = classes.withColumn("r", F.row_number().over(best)).where("r = 1").select("grp", "pages", "va", "vb")
    template = staged(token.where("total = pages").join(root, ["grp", "pages", "va", "vb"]).select("grp", "token", "is_text", "grp_pages", "pages"), "html-template")
    elements = template.where("not is_text").select("grp", F.col("token").alias("slot"))
    # the innermost template element around each path; paths above it are its prefixes
    steps = F.split("token", "/")
    paths = token.where("not is_text and chars > 0").select(
        "grp", "token", "chars", "links", "bad",
        F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/"))).alias("slot"))
    inner = (
        paths.join(elements, ["grp", "slot"]).groupBy("grp", "token", "chars", "links", "bad")
        .agg(F.max_by("slot", F.length("slot")).alias("slot"))
        .groupBy("grp", "slot").agg(F.sum("chars").alias("chars"), F.sum("links").alias("links"), F.min("bad").alias("bad"))
        .where("not bad")
    )
    article = F.exists(F.split("slot", "/"), lambda s: s.rlike(r"^(article|main)(\.|$)"))
    everything = Window.partitionBy("grp")
    main = (
        inner.withColumn("article", article)
        .withColumn("has_article", F.max("article").over(everything))
        .where("if(has_article, article, links * 2 < chars)")
        .groupBy("grp").agg(F.collect_list("slot").alias("slots"))
    )
    fixed = template.where("is_text and pages = grp_pages and grp_pages >= 4").groupBy("grp").agg(F.collect_list("token").alias("fixed"))
    none = F.array().cast("array<string>")
    out = staged(
        hosts.join(main, "grp", "left").join(fixed, "grp", "left")
        .select("host", F.coalesce("slots", none).alias("slots"), F.coalesce("fixed", none).alias("fixed")), "html-main")
    drop_staged(by_host, hosts, token, template)
    return out


def main_text(html: str, slots: set[str], fixed: set[str]) -> str:
    page = Page(html)
    good = [(p, t) for p, bad, t, _ in page.blocks if not bad]
    chosen = [(p, t) for p, t in good if any(q in slots for q in prefixes(p))]
    if not chosen:  # not this host's template
        own = [(p, t) for p, t in good if in_article(p)]
        chosen = own or good
    kept = [t for _, t in chosen if "#" + xxhash.xxh64_hexdigest(t) not in fixed]
    return "\n\n".join(kept or [t for _, t in chosen])


RESULT = "page_id bigint, url string, text string, n_chars bigint"


def _extract(batches):
    known: dict[tuple, tuple[set, set]] = {}
    for b in batches:
        texts = []
        for html, slots, fixed in zip(b.column(2), b.column(3).to_pylist(), b.column(4).to_pylist()):
            key = (tuple(slots or ()), tuple(fixed or ()))
            if key not in known:
                if len(known) > 1000:
                    known.clear()
                known[key] = set(key[0]), set(key[1])
            texts.append(main_text(html.as_py() or "", *known[key]))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html", host_of(F.col("url")).alias("host"))
    return rows.join(templates(pages), "host", "left").select("page_id", "url", "html", "slots", "fixed").mapInArrow(_extract, RESULT)
