"""Array form (accumulated flows) equals the long form."""

from pyspark.sql import functions as F

from trafficlab.functions import arrays as A
from trafficlab.operators import flows as FW
from trafficlab.operators import sampling as S
from trafficlab.sources.tables import ORDER_SORT, pkt_order
from tests.conftest import SF001


def test_every_nth_array_equals_long_form(spark):
    o = pkt_order(spark, SF001)
    acc = FW.accumulate(o, ["l_orderkey"], ["octets"], order=ORDER_SORT)
    arr = acc.select("l_orderkey", F.array_join(A.every_nth(F.col("`accumulate(octets)`"), 2).cast("array<string>"), " ").alias("a"))
    long = S.sample_flow(o, "l_orderkey", "every_nth", 2, order=ORDER_SORT)
    back = FW.accumulate(long, ["l_orderkey"], ["octets"], order=ORDER_SORT).select(
        "l_orderkey", F.array_join(F.col("`accumulate(octets)`").cast("array<string>"), " ").alias("a"))
    assert {tuple(r) for r in arr.collect()} == {tuple(r) for r in back.collect()}


def test_array_mode_equals_long_form(spark):
    o = pkt_order(spark, SF001)
    acc = FW.accumulate(o, ["l_orderkey"], ["octets"], order=ORDER_SORT)
    m = A.array_mode(F.col("`accumulate(octets)`"))
    arr = {(r[0], r[1], r[2], r[3]) for r in acc.select("l_orderkey", m["mode"], m["modeCount"], m["distinct"]).collect()}
    long = {tuple(r) for r in FW.mode_numeric(o, ["l_orderkey"], "octets").select(
        "l_orderkey", "mode(octets)", "modeCount(octets)", "distinct(octets)").collect()}
    assert arr == long


def test_array_mode_of_long_and_odd_arrays(spark):
    rows = [(1, [3, 1, 3, 1, 2]), (2, []), (3, [None, None, 5]), (4, None), (5, [i % 50_000 for i in range(100_000)] + [7])]
    df = spark.createDataFrame(rows, "k long, a array<long>")
    m = A.array_mode(F.col("a"))
    got = {r[0]: tuple(r)[1:] for r in df.select("k", m["mode"], m["modeCount"], m["distinct"]).collect()}
    assert got[1] == (1, 2, 3) and got[2] == (None, 0, 0) and got[3] == (5, 1, 2) and got[4][0] is None
    assert got[5] == (7, 3, 50_000)


def test_string_list(spark):
    df = spark.createDataFrame([("[a  b c]",), ("[]",), (None,)], "t string")
    assert [r[0] for r in df.select(A.parse_string_list(F.col("t"))).collect()] == [["a", "b", "c"], [], None]


def test_rename_and_project(spark):
    from trafficlab.operators.columns import project_vector, rename_features
    from trafficlab.sources.tables import pkt_user
    v = FW.agm_vector(pkt_user(spark, SF001), 86400)
    r = rename_features(v, replace=("Count", "Cnt"))
    assert "packetTotalCnt" in r.columns
    assert project_vector(v, "AGM").columns == v.columns
