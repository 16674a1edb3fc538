"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. Word counts per source give the targets: shares of all words by weight,
   stopped at ``cap`` times the source's own size, the excess reshared by
   weight (water filling over one row per source).
2. A source's documents form a word stream in a permuted order (md5 of the
   doc_id).  Its prefix sums come from (source, hash bucket) totals and a
   running sum inside each bucket, so a source that holds a third of all rows
   is spread over ``BUCKETS`` groups.  The stream repeats, at most ``cap``
   times, until the target is reached; the last document is cut so that the
   taken words are the rounded target.
3. The stream is cut into blocks of equal length.  The sources' block quotas
   are split exactly among the output shards: a node of the tree holds every
   source's quota and draws, source by source, the hypergeometric number that
   goes to its left half; the rest goes right.  Leaves are shards.
4. Each shard takes the next unused blocks of each source, so blocks are
   disjoint, and orders its pieces by a second hash (local shuffle).

DataFrame operations only; all draws are functions of the seed, so reruns
agree.  Bounds: the tree has ``shards`` leaves and about
``shards * blocks_per_shard`` blocks plus one per source, whatever the input.

Cases: sources are ordered by code point, null last (null is a source); a null
or empty text has size 0 and is never taken; equal doc_ids are ordered by
size; an empty table gives no rows; columns named like the results are
replaced; internal columns start with ``__mix_``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import staged, word_count

WEIGHTS = (5, 2, 1)
CAP = 3
BUCKETS = 4096
P = "__mix_"


def _source_key(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n"))


def targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """``__mix_key``, source_size, target from rows of (source, size); one row per source."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = by.withColumn(f"{P}rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col(f"{P}rank") - 1) % len(weights) + 1)
    full = ranked.withColumn(f"{P}w", w).withColumn(f"{P}cap", F.col("source_size").cast("double") * cap)
    order = Window.orderBy(F.col(f"{P}cap") / F.col(f"{P}w"), f"{P}rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    filled = full.withColumn(
        f"{P}level",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum(f"{P}cap").over(before), F.lit(0.0)))
        / (F.sum(f"{P}w").over(everything) - F.coalesce(F.sum(f"{P}w").over(before), F.lit(0.0))),
    )
    # the level at which the first source stays under its cap holds for all after it
    free = F.when(F.col(f"{P}cap") >= F.col(f"{P}w") * F.col(f"{P}level"), F.struct(F.col(f"{P}cap") / F.col(f"{P}w"), F.col(f"{P}rank"), F.col(f"{P}level").alias("level")))
    level = F.min(free).over(everything)["level"]
    return filled.withColumn(f"{P}final", level).select(
        _source_key("source").alias(f"{P}key"), "source_size",
        F.least(F.col(f"{P}cap"), F.coalesce(F.col(f"{P}final") * F.col(f"{P}w"), F.col(f"{P}cap"))).alias("target"),
    )


def _log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series at n + 10, brought back to n."""
    x = n.cast("double") + 10.0
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x)
    for i in range(1, 11):
        series = series - F.log(n.cast("double") + float(i))
    return series


def _hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """Marked items among ``drawn`` of ``total``, by inversion of ``u`` in [0, 1)."""
    low = F.greatest(F.lit(0), drawn - (total - marked)).cast("int")
    high = F.least(marked, drawn).cast("int")

    def choose(a: Column, b: Column) -> Column:
        return _log_factorial(a) - _log_factorial(b) - _log_factorial(a - b)

    base = choose(total, drawn)

    def add(acc: Column, x: Column) -> Column:
        p = F.exp(choose(marked, x) + choose(total - marked, drawn - x) - base)
        up = acc["cdf"] + p
        hit = F.when((acc["x"] < 0) & (up > u), x).otherwise(acc["x"])
        return F.struct(up.alias("cdf"), hit.cast("int").alias("x"))

    start = F.struct(F.lit(0.0).alias("cdf"), F.lit(-1).alias("x"))
    return F.aggregate(F.sequence(low, high), start, add, lambda a: F.when(a["x"] < 0, high).otherwise(a["x"]))


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """Rows (``__mix_key``, shard, blocks) from rows (``__mix_key``, ``__mix_quota``).

    Level by level: one row per tree node with the array of its sources' quotas.
    """
    depth = int(math.log2(shards))
    if 2 ** depth != shards:
        raise ValueError("shards must be a power of two")
    item = F.struct(f"{P}key", f"{P}quota")
    nodes = quotas.agg(F.array_sort(F.collect_list(item)).alias("items")).select(F.lit(0).alias("node"), "items")
    for level in range(depth):
        total = F.aggregate("items", F.lit(0).cast("bigint"), lambda a, x: a + x[f"{P}quota"])

        def draw(acc: Column, x: Column) -> Column:
            h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit(level), F.col("node"), x[f"{P}key"])), 1, 12), 16, 10)
            left = _hypergeometric(acc["n"], x[f"{P}quota"], acc["d"], h.cast("double") / float(2 ** 48)).cast("bigint")
            one = F.struct(x[f"{P}key"].alias(f"{P}key"), left.alias(f"{P}quota"))
            return F.struct((acc["n"] - x[f"{P}quota"]).alias("n"), (acc["d"] - left).alias("d"), F.concat(acc["out"], F.array(one)).alias("out"))

        empty = F.array().cast(f"array<struct<{P}key:string,{P}quota:bigint>>")
        # shard sizes differ by one block at most: the left half holds the larger ones
        start = F.struct(F.col("total").alias("n"), F.expr("(total + 1) div 2").alias("d"), empty.alias("out"))
        split = nodes.withColumn("total", total).withColumn("left", F.aggregate("items", start, draw, lambda a: a["out"]))
        right = F.zip_with("items", "left", lambda a, b: F.struct(a[f"{P}key"].alias(f"{P}key"), (a[f"{P}quota"] - b[f"{P}quota"]).alias(f"{P}quota")))
        nodes = split.select(F.explode(F.array(
            F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("items")),
            F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("items")),
        )).alias("n")).select("n.node", "n.items")
        nodes = staged(nodes, "mix-tree")
    return nodes.select(F.col("node").alias("shard"), F.explode("items").alias("i")).select(
        F.col(f"i.{P}key").alias(f"{P}key"), "shard", F.col(f"i.{P}quota").alias("blocks"))


def mix(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, shards: int = 16, blocks_per_shard: int = 64,
        seed: int = 17, carry: list[str] | None = None) -> DataFrame:
    """Pieces of the mix: one row per (document, copy, block), and one with a null copy for a document not taken.

    Columns: ``carry`` columns of ``docs`` (default: all), size, source_size,
    target, copy, words (of the piece), full (words taken of the copy), head
    (first piece of the copy), shard, shuffle_key.
    """
    made = ["size", "source_size", "target", "copy", "words", "full", "head", "shard", "shuffle_key"]
    carry = [c for c in (carry if carry is not None else docs.columns) if c not in made]
    rows = docs.select(
        *carry, F.col("doc_id").alias(f"{P}id"), word_count("text").alias("size"), _source_key("source").alias(f"{P}key"),
        F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias(f"{P}md5"),
    ).withColumn(f"{P}bucket", F.conv(F.substring(f"{P}md5", 1, 3), 16, 10).cast("int"))
    slim = docs.select("source", word_count("text").alias("size"))
    goal = staged(targets(slim, weights, cap), "mix-targets")
    total = goal.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    length = max(1, -(-int(total) // (shards * blocks_per_shard)))  # words of a block

    whole = goal.withColumn(f"{P}goal", F.floor(F.col("target") + 0.5).cast("long"))
    quotas = whole.select(f"{P}key", F.ceil(F.col(f"{P}goal") / length).cast("long").alias(f"{P}quota"))
    shares = split_quotas(quotas, shards, seed)
    upto = Window.partitionBy(f"{P}key").orderBy("shard")
    ends = F.sum("blocks").over(upto.rowsBetween(Window.unboundedPreceding, 0))
    # one row per block: about shards * blocks_per_shard of them, and one more per source
    owner = staged(
        shares.withColumn("end", ends).where("blocks > 0")
        .select(F.col(f"{P}key").alias(f"{P}okey"), "shard", F.explode(F.expr("sequence(end - blocks, end - 1)")).alias(f"{P}oblock")),
        "mix-blocks",
    )

    totals = rows.groupBy(f"{P}key", f"{P}bucket").agg(F.sum("size").alias(f"{P}sum"))
    ahead = Window.partitionBy(f"{P}key").orderBy(f"{P}bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(f"{P}key", f"{P}bucket", F.coalesce(F.sum(f"{P}sum").over(ahead), F.lit(0)).alias(f"{P}offset"))
    run = Window.partitionBy(f"{P}key", f"{P}bucket").orderBy(f"{P}md5", f"{P}id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        rows.withColumn(f"{P}run", F.sum("size").over(run))
        .join(offsets, [f"{P}key", f"{P}bucket"])
        .join(whole, f"{P}key")
        .withColumn(f"{P}start", F.col(f"{P}offset") + F.col(f"{P}run") - F.col("size"))
    )

    def copy_of(p: Column) -> Column:
        low = p * F.col("source_size") + F.col(f"{P}start")
        full = F.greatest(F.lit(0).cast("long"), F.least(F.col(f"{P}goal"), low + F.col("size")) - low)
        return F.struct(p.cast("int").alias("copy"), low.alias("low"), full.alias("full"))

    copies = F.filter(F.transform(F.sequence(F.lit(0), F.lit(cap - 1)), lambda p: copy_of(p.cast("long"))), lambda c: c["full"] > 0)
    pieces = (
        placed.withColumn("c", F.explode_outer(copies))
        .withColumns({"copy": F.col("c.copy"), "full": F.coalesce(F.col("c.full"), F.lit(0).cast("long")), f"{P}low": F.col("c.low")})
        .withColumn(f"{P}block", F.explode_outer(F.when(
            F.col("copy").isNotNull(), F.sequence(F.expr(f"{P}low div {length}"), F.expr(f"({P}low + full - 1) div {length}")))))
        .withColumn("words", F.coalesce(
            F.least(F.col(f"{P}low") + F.col("full"), (F.col(f"{P}block") + 1) * length) - F.greatest(F.col(f"{P}low"), F.col(f"{P}block") * length),
            F.lit(0)).cast("long"))
    )
    return pieces.join(
        owner, (F.col(f"{P}key") == F.col(f"{P}okey")) & (F.col(f"{P}block") == F.col(f"{P}oblock")), "left",
    ).select(
        *carry, "size", "source_size", "target", "copy", "words", "full",
        (F.col(f"{P}block") == F.expr(f"{P}low div {length}")).alias("head"), "shard",
        F.md5(F.concat_ws(":", F.lit(seed + 1), F.col(f"{P}md5"), F.col("copy"), F.col(f"{P}block"))).alias("shuffle_key"),
    )
