"""TCP flag columns: one-hot letters, bitmask, and the flow flag summary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Flag letters in the order of the AGM vector columns.
FLAG_LETTERS = ["N", "C", "E", "U", "S", "R", "F", "P", "A"]
# TCP header bit weights of each flag letter (Q14).
FLAG_WEIGHTS = {"F": 1, "S": 2, "R": 4, "P": 8, "A": 16, "U": 32, "E": 64, "C": 128, "N": 256}
NON_TCP = "0"


def flag_combo(flags: Column) -> Column:
    """Flag combination of one packet; the non-TCP (empty) case becomes '0'."""
    return F.when(flags.isNull() | (flags == ""), F.lit(NON_TCP)).otherwise(flags)


def flags_onehot(flags: Column) -> dict[str, Column]:
    """one 0/1 INT column per letter."""
    return {c: F.coalesce(flags.contains(c).cast("int"), F.lit(0)) for c in FLAG_LETTERS}


def flags_to_int(flags: Column) -> Column:
    """flag letters -> integer bitmask (standard header weights)."""
    total = F.lit(0)
    for c, wgt in FLAG_WEIGHTS.items():
        total = total + F.when(flags.contains(c), F.lit(wgt)).otherwise(F.lit(0))
    return total.cast("long")


def _equals(value: str):
    return lambda y: y == F.lit(value)


def flag_mode_letters(combos: Column, mode_count: Column) -> dict[str, Column]:
    """F17 tie rule on ``combos`` = array<struct<c: count, combo: string>>.

    Tied = combinations whose count equals ``mode_count``.  If one of them is
    the non-TCP '0', no flag is set.  Otherwise the letters of the tied
    combinations are pooled and the letter(s) with the highest frequency in
    the pool are set (with a single winner that is just its letters).
    """
    tied = F.filter(combos, lambda x: x["c"] == mode_count)
    has_zero = F.exists(tied, lambda x: x["combo"] == F.lit(NON_TCP))
    pool = F.flatten(F.transform(tied, lambda x: F.split(x["combo"], "")))
    counts = {c: F.size(F.filter(pool, _equals(c))) for c in FLAG_LETTERS}
    top = F.greatest(*counts.values())
    return {c: F.when(~has_zero & (cnt == top) & (cnt > 0), F.lit(1)).otherwise(F.lit(0)).cast("int")
            for c, cnt in counts.items()}


def parse_flag_list(text: Column, packets: Column | None = None) -> Column:
    """S3: bracketed flag text '[S SA  A ]' -> array, empty slot -> '0'.

    An all-empty list becomes ['0'] * ``packets`` when the packet count is
    given.
    """
    inner = F.regexp_replace(F.regexp_replace(text, r"^\[", ""), r"\]$", "")
    arr = F.transform(F.split(inner, " "), lambda x: F.when(x == "", F.lit(NON_TCP)).otherwise(x))
    if packets is None:
        return arr
    blank = F.trim(inner) == ""
    return F.when(blank, F.array_repeat(F.lit(NON_TCP), packets.cast("int"))).otherwise(arr)
