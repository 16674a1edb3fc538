"""Run evaluation: numbering of many runs."""

from pyspark.sql import functions as F

from trafficlab.operators import evaluate as EV


def test_roman_numbers_end_at_3999(spark):
    rows = spark.range(1, 12001).select("id", EV.roman(F.col("id")).alias("r")).collect()
    got = {x["id"]: x["r"] for x in rows}
    assert [got[i] for i in (1, 4, 26, 1994, 3999)] == ["I", "IV", "XXVI", "MCMXCIV", "MMMCMXCIX"]
    assert len({got[i] for i in range(1, 4000)}) == 3999
    assert all(got[i] is None for i in range(4000, 12001))  # an error before


def test_more_than_3999_runs_are_numbered(spark):
    runs = spark.range(9000).select(F.col("id").alias("run_id"), F.when(F.col("id") % 4 == 0, "AGM").otherwise("CAIA").alias("family"),
                                    F.lit("flowsampling").alias("sampling"), F.lit("f").alias("folder"))
    rows = EV.assign_ids(runs).collect()
    assert sorted(x["id"] for x in rows) == list(range(1, 9001))
    assert all((x["roman"] is None) == (x["id"] > 3999) for x in rows)
