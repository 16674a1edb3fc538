"""File sources and sinks round-trip through the shared scratch folder."""

import os

from pyspark.sql import functions as F

from trafficlab.session import scratch_path as _scratch
from trafficlab.sources import files as FS


def scratch_path(spark, name):
    """Local form of a scratch folder (tests create files with ``os``)."""
    p = _scratch(spark, name)
    return p[len("file:"):] if p.startswith("file:") else p


def test_flow_csv_roundtrip(spark):
    df = spark.createDataFrame([(1, " a", 2.5), (2, "b", 3.0)], "id long, name string, x double")
    p = scratch_path(spark, "flows")
    FS.write_flows(df, p, fmt="csv")
    back = FS.read_flows(spark, p, cols=["id", "x"])
    assert back.columns == ["id", "x"]
    assert sorted(r.id for r in back.collect()) == [1, 2]


def test_partitioned_sink(spark):
    df = spark.createDataFrame([("Mon", 1, 5), ("Tue", 2, 6)], "capture string, mode int, v int")
    p = scratch_path(spark, "part")
    FS.write_flows(df, p, partition_by=["capture", "mode"])
    assert spark.read.parquet(p).where(F.col("capture") == "Tue").count() == 1


def test_read_runs_parses_folder(spark, tmp_path):
    root = scratch_path(spark, "runs")
    folder = os.path.join(root, "Friday_mode3_vector4_steps12_flowsampling")
    os.makedirs(folder)
    with open(os.path.join(folder, "marks.csv"), "w") as fh:
        fh.write("epochtime,scriptname,segment,status\n1.0,p.py,start,start\n2.5,p.py,end,end\n")
    r = FS.read_runs(spark, root, "marks.csv").collect()
    assert {x.steps for x in r} == {12} and {x.vector for x in r} == {4} and {x.mode for x in r} == {3}


def test_resource_log(spark):
    root = scratch_path(spark, "dstat")
    os.makedirs(root)
    head = '"Dstat 0.7 CSV output"\n"Author:","someone",,,,"URL:","none"\n"Host:","h",,,,"User:","u"\n"Cmdline:","dstat",,,,"Date:","d"\n'
    with open(os.path.join(root, "full.csv"), "w") as fh:
        fh.write(head + '"epoch","total cpu usage",,"dsk/total",,"memory usage",,"swap",\n'
                 '"epoch","usr","sys","read","writ","used","free","used","free"\n'
                 "100.0,3,1,0,0,5000000,9,11,1\n101.0\t3\t1\t0\t0\t7000000\t9\t12\t1\n")
    with open(os.path.join(root, "short.csv"), "w") as fh:
        fh.write(head + '"epoch","memory usage"\n"epoch","used"\n5.5,8000000\n')
    df = FS.read_resource_log(spark, root)
    assert df.columns == ["source", "epoch", "free", "free_2", "read", "sys", "used", "used_2", "usr", "writ"]
    got = sorted((r["epoch"], r["used"], r["used_2"]) for r in df.collect())
    assert got == [(5.5, 8e6, None), (100.0, 5e6, 11.0), (101.0, 7e6, 12.0)]
    some = FS.read_resource_log(spark, os.path.join(root, "full.csv"), ["used", "usr", "none"])
    assert [tuple(r)[1:] for r in some.orderBy("used").collect()] == [(5e6, 3.0, None), (7e6, 3.0, None)]


def test_run_info_and_model(spark):
    from trafficlab.operators import ml as M
    from trafficlab.operators.prep import assemble
    p = scratch_path(spark, "info")
    FS.write_run_info(spark, p, {"run": "x", "pca_n": 3, "pca_var": 0.9})
    assert spark.read.parquet(p).first().pca_n == 3
    data = spark.createDataFrame([(float(i % 2), float(i), float(i * 2)) for i in range(40)], "label double, a double, b double")
    model = M.fit_forest(assemble(data, ["a", "b"]), num_trees=3, max_depth=3)
    mp = scratch_path(spark, "model")
    M.save_model(model, mp)
    loaded = M.load_model(mp)
    assert loaded.getNumTrees == 3
