"""Array helpers for accumulated flows (the reference keeps one list per
attribute and flow): parsing the textual form, slicing, statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_number_list(text: Column, elem_type: str = "double") -> Column:
    """S1/I7: '[6 6 6]' or '[a, b]' -> array; NULL stays NULL."""
    inner = F.regexp_replace(text, r"^\s*\[|\]\s*$", "")
    parts = F.split(F.trim(inner), r"[,\s]+")
    return F.transform(F.filter(parts, lambda x: x != ""), lambda x: x.cast(elem_type))


def parse_string_list(text: Column) -> Column:
    """S2: '[a b c]' -> array<string> (runs of spaces separate)."""
    inner = F.regexp_replace(text, r"^\s*\[|\]\s*$", "")
    return F.filter(F.split(F.trim(inner), " +"), lambda x: x != "")


def every_nth(arr: Column, n: int) -> Column:
    """x[::n] (twin of per-flow mode 1 on the long form)."""
    return F.filter(arr, lambda x, i: i % n == 0)


def first_n(arr: Column, n: int) -> Column:
    """x[:n] (twin of per-flow mode 3)."""
    return F.slice(arr, 1, n)


def array_stats(arr: Column) -> dict[str, Column]:
    """Length, sum, min, max, mean and distinct count of a numeric array."""
    dbl = F.transform(arr, lambda x: x.cast("double"))
    total = F.aggregate(dbl, F.lit(0.0), lambda acc, x: acc + x)
    return {
        "n": F.size(arr).cast("long"),
        "sum": total,
        "min": F.array_min(dbl),
        "max": F.array_max(dbl),
        "mean": F.try_divide(total, F.size(arr).cast("double")),
        "distinct": F.size(F.array_distinct(arr)).cast("long"),
    }


def array_mode(arr: Column) -> dict[str, Column]:
    """Mode (tie -> smallest), modeCount and distinct of an array, by sorting
    it and folding its runs (no explode).  NULL elements are a value of
    ``distinct`` only; an empty array has no mode and modeCount 0."""
    values = F.array_sort(F.filter(arr, lambda x: x.isNotNull()))
    start = F.try_element_at(values, F.lit(1))

    def fold(acc, x):
        run = F.when(x == acc["v"], acc["run"] + 1).otherwise(1)
        longer = run > acc["c"]
        return F.struct(x.alias("v"), run.alias("run"), F.when(longer, x).otherwise(acc["mode"]).alias("mode"), F.greatest(run, acc["c"]).alias("c"))
    best = F.aggregate(values, F.struct(start.alias("v"), F.lit(0).alias("run"), start.alias("mode"), F.lit(0).alias("c")), fold)
    return {"mode": best["mode"], "modeCount": best["c"].cast("long"), "distinct": F.size(F.array_distinct(arr)).cast("long")}
