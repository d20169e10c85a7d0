"""The whole analysis on the smallest tables."""

import pytest
from pyspark.sql import functions as F

from roadweave.plans import networks as N
from roadweave.plans import workflow

SF = "/root/testdata/sf0.001"


def test_whole_analysis(spark, tmp_path):
    inputs = workflow.Inputs(
        N.road_axes(spark, SF).drop("o_totalprice"), N.carriageways(spark, SF), N.streets(spark, SF), N.community_ways(spark, SF),
        N.community_segments(spark, SF).withColumn("srid", F.lit(25832)), N.restrictions(spark, SF), N.addresses(spark, SF),
    )
    # the area is too flat for the usual inset of the address box
    box = (430000.0, 5929000.0, 436000.0, 5930700.0)
    got = workflow.run(inputs, box, points=16, radius=5.0, address_inset=1.0)
    assert got.status.count() == 16 and got.network_measures.count() == 2
    found = {r.data_basis: r.n for r in got.status.filter("status = 'found'").groupBy("data_basis").agg(F.count("*").alias("n")).collect()}
    assert found["community"] >= 4
    rows = got.route_measures.collect()
    assert sum(r.route_id == 0 for r in rows) == 1
    assert all(0 <= r.buffer <= 100 and r.hausdorff_distance <= r.frechet_distance for r in rows if r.route_id)
    steps = got.steps["community"]
    assert steps.filter("edge_id <> -1 AND distance IS NULL").isEmpty()
    reached = workflow.catchments(got, spark.createDataFrame([(1,), (2,)], "start_id long"), 60)
    assert {r.data_basis for r in reached.select("data_basis").distinct().collect()} == {"authority", "community"}
    checks = {r.check for r in got.networks["community"].checks.collect()}
    assert "oneway" in checks and "dead_ends" in checks
    first = reached.filter("seq = 1").collect()
    assert {r.point_id for r in first} == {r.start_id for r in first} and all(r.hook_length is not None for r in first)
    assert reached.filter("seq > 1 AND (point_id IS NOT NULL OR hook_length IS NOT NULL)").isEmpty()
    for starts, seconds in (([(1,), (999,)], 60), ([(1,)], 0)):
        with pytest.raises(ValueError):
            workflow.catchments(got, spark.createDataFrame(starts, "start_id long"), seconds)
    out = str(tmp_path / "out")
    got.save(out, catchments=reached)
    got.save(out, add=True, catchments=reached)
    read = lambda name: spark.read.parquet(f"{out}/{name}")
    assert read("route_steps").filter("data_basis = 'community'").count() == 2 * steps.count()
    status = read("status")
    assert status.count() == 32 and status.select("data_basis", "pair_id").distinct().count() == 32  # failed pairs as well
    assert status.agg(F.max("pair_id")).first()[0] == 16
    assert {r.catchment_id for r in read("catchments").select("catchment_id").distinct().collect()} == {1, 2, 3, 4}
    assert read("checks").count() > 2 and read("edges").count() > 0
    assert {r.route_id for r in read("route_measures").collect()} >= {0}


def test_unknown_coordinate_systems_stop(spark):
    lines = N.community_segments(spark, SF).limit(3)
    for code in (31467, None):
        with pytest.raises(ValueError, match="coordinate"):
            workflow._in_utm(lines.withColumn("srid", F.lit(code).cast("int")), "segments")
