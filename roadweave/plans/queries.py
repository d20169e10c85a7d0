"""Registered queries: each takes (spark, sf_dir) and runs one operator over the whole derived tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave.functions.geometry import bounds, line_length, point
from roadweave.functions.projection import reproject
from roadweave.operators import assemble, batch, clip, compare, paths, snap, spatial, topology, weights
from roadweave.plans import networks as N
from roadweave.plans import stages
from roadweave.session import dense_serial, pin, pin_table
from roadweave.sources import tables
from roadweave.sources.files import address_point, kept_tags, segment_ways

GIVEN_BOX = (431000.5, 5930100.25, 437000.75, 5935000.5)
CATCHMENT_SECONDS = 50
BUFFER_RADIUS = 2.0
NODE_RADIUS = 25.0
GAP_TOLERANCE = 0.5
EXTRA_IDS = 1_000_000_000_000_000

_COORD = "decimal(14,3)"


# ---------------------------------------------------------------- selection and assembly


def car_filter(spark: SparkSession, d: str) -> DataFrame:
    ways = assemble.filter_car_roads(N.community_ways(spark, d))
    return ways.select("edge_id", "osm_id", "highway", "access", "service", "oneway", "maxspeed_type", "zone_traffic", "name", "ref")


def access_filter(spark: SparkSession, d: str) -> DataFrame:
    ways = assemble.rename_tags(N.community_ways(spark, d))
    return ways.select("edge_id", assemble.access_allowed().alias("allowed"))


def explode_model(spark: SparkSession, d: str) -> DataFrame:
    axes = assemble.widen(N.road_axes(spark, d), assemble.AXIS_COLUMNS)
    return assemble.in_base_model(axes).select("gml_id", "model_pos", "funktion")


def notin_null_aware(spark: SparkSession, d: str) -> DataFrame:
    """Streets NOT IN the designations of motorway streets: without, with, and against no rows."""
    s = N.streets(spark, d)
    right = s.filter("widmung = 1301").select(F.col("bezeichnung").alias("other"))
    cases = {"no_nulls": right.filter("other IS NOT NULL"), "with_nulls": right, "empty": right.filter("other = ''")}
    counted = [
        assemble.not_in_column(s, "bezeichnung", other, "other").agg(F.count("*").alias("n")).select(F.lit(k).alias("case_name"), "n")
        for k, other in cases.items()
    ]
    return reduce(DataFrame.unionByName, counted)


def union_axes(spark: SparkSession, d: str) -> DataFrame:
    axes = N.road_axes(spark, d).drop("o_totalprice")
    return assemble.union_axes(axes, N.carriageways(spark, d)).select(
        "axis_kind", "gml_id", "model_pos", "istTeilVon", "verkehrsbedeutungInneroertlich"
    )


def street_enrich(spark: SparkSession, d: str) -> DataFrame:
    return assemble.enrich_with_streets(N.road_axes(spark, d), N.streets(spark, d)).select(
        "gml_id", "istTeilVon", "widmung", "bezeichnung", "name"
    )


def authority_assemble(spark: SparkSession, d: str) -> DataFrame:
    return N.authority_raw(spark, d).select("edge_id", "gml_id", "istTeilVon", "widmung", "bezeichnung", "name", "funktion", "zustand")


def tags_segments_join(spark: SparkSession, d: str) -> DataFrame:
    ways = assemble.filter_car_roads(N.community_ways(spark, d))
    joined = assemble.join_segments(ways, N.community_segments(spark, d))
    return joined.select("edge_id", "osm_id", "pgsql_osm_id", "highway", "oneway", "name", "ref", "maxspeed")


def _patch(spark: SparkSession, d: str) -> DataFrame:
    """Orders as patch entries for the edge numbered like their customer."""
    return N.table(spark, d, "orders").selectExpr(
        "o_orderkey AS seq", "o_custkey AS edge_id",
        "CASE o_orderstatus WHEN 'O' THEN true WHEN 'F' THEN false END AS fahrtrichtung",
    )


def oneway_patch(spark: SparkSession, d: str) -> DataFrame:
    """A patch of segments; the latest order wins."""
    return assemble.patch_oneway(N.community_segments(spark, d), _patch(spark, d)).select("edge_id", "fahrtrichtung")


def tag_rules(spark: SparkSession, d: str) -> DataFrame:
    """Tags of every order, seen as a way, that the import rules keep."""
    o = N.table(spark, d, "orders")
    tags = F.create_map(
        F.lit("highway"), F.lit("service"), F.lit("name"), F.col("o_orderpriority"), F.lit("note"), F.lit("x"),
        F.concat(F.lit("note:"), F.col("o_orderstatus")), F.lit("x"), F.concat(F.lit("tiger:"), F.col("o_orderpriority")), F.lit("x"),
        F.lit("source"), F.lit("x"), F.lit("source:maxspeed"), F.col("o_orderstatus"), F.lit("notes"), F.lit("kept"),
        F.lit("import"), F.lit("x"), F.lit("important"), F.lit("kept"),
    )
    return o.select(F.col("o_orderkey").alias("way_id"), F.explode(kept_tags(tags)).alias("tag", "value"))


def segment_cut(spark: SparkSession, d: str) -> DataFrame:
    """Row and column ways of four grid edges each, with a vertex amid every edge, cut at shared nodes."""
    g = N._cells(N.table(spark, d, "orders"))
    a, b = N._grid("c1", "r1"), N._grid("c2", "r2")
    g = g.selectExpr("*", f"{a} AS pa", f"{b} AS pb", "CASE WHEN i % 2 = 0 THEN c1 % 4 ELSE r1 % 4 END AS k").selectExpr(
        "*",
        "CASE WHEN i % 2 = 0 THEN 2 * (r1 * 1000 + c1 div 4) ELSE 2 * ((r1 div 4) * 1000 + c1) + 1 END AS osm_id",
    )
    points = g.selectExpr(
        "osm_id",
        "inline(array(named_struct('pos', 2 * k, 'node', r1 * 1000 + c1, 'x', pa.x, 'y', pa.y),"
        " named_struct('pos', 2 * k + 1, 'node', -1 - i, 'x', (pa.x + pb.x) / 2, 'y', (pa.y + pb.y) / 2),"
        " named_struct('pos', 2 * k + 2, 'node', r2 * 1000 + c2, 'x', pb.x, 'y', pb.y)))",
    ).distinct()
    cut = segment_ways(points)
    return cut.select("osm_id", F.col("seg_no").cast("int").alias("seg_no"), F.size("pts").alias("vertices"), line_length(F.col("pts")).cast("decimal(9,4)").alias("distance"))


def address_points(spark: SparkSession, d: str) -> DataFrame:
    """Register text (zone prefix, decimal comma) to points, for every customer."""
    c = N.addresses(spark, d).selectExpr(
        "id", "concat('32', replace(string(cast(x AS decimal(9,1))), '.', ',')) AS coor_easting",
        "replace(string(cast(y AS decimal(18,2))), '.', ',') AS coor_northing",
    )
    return address_point(c).select("id", "coor_easting", "coor_northing", "x", "y")


# ---------------------------------------------------------------- length, speed, weights


def edge_length(spark: SparkSession, d: str) -> DataFrame:
    both = [
        weights.set_length(N.community_segments(spark, d)).select(F.lit("community").alias("data_basis"), F.col("edge_id").cast("string").alias("id"), "distance"),
        weights.set_length(N.road_axes(spark, d)).select(F.lit("authority").alias("data_basis"), F.col("gml_id").alias("id"), "distance"),
    ]
    return reduce(DataFrame.unionByName, both)


def speed_community(spark: SparkSession, d: str) -> DataFrame:
    ways = assemble.rename_tags(N.community_ways(spark, d))
    return weights.set_speed_community(ways).select("edge_id", "maxspeed")


def speed_authority(spark: SparkSession, d: str) -> DataFrame:
    return weights.set_speed_authority(N.streets(spark, d)).select("gml_id", "widmung", "maxspeed")


def weights_community(spark: SparkSession, d: str) -> DataFrame:
    edges = N.community_network(spark, d, tags=["highway", "maxspeed", "maxspeed_type", "zone_traffic", "oneway"])
    edges = weights.set_weights(weights.set_speed_community(edges), weights.community_profile())
    return edges.select("edge_id", "distance", "weights_car", "weights_car_reverse")


def weights_authority(spark: SparkSession, d: str) -> DataFrame:
    return N.authority_weighted(spark, d).select("edge_id", "distance", "maxspeed", "weights_car", "weights_car_reverse")


def weights_oneway(spark: SparkSession, d: str) -> DataFrame:
    """Authority edges after a one-way patch: open both ways, along their line only, or against it only."""
    edges = assemble.patch_oneway(weights.set_speed_authority(N.authority_network(spark, d)), _patch(spark, d))
    return weights.set_weights(edges, weights.authority_profile()).select("edge_id", "fahrtrichtung", "weights_car", "weights_car_reverse")


def network_completeness(spark: SparkSession, d: str) -> DataFrame:
    # measures need neither edge ids nor most tags, so no global sort and no wide rows in the shuffle
    community = N.community_network(spark, d, tags=["highway", "maxspeed", "name", "oneway", "ref"])
    return compare.compare_networks(N.authority_network(spark, d, serial=False), community)


# ---------------------------------------------------------------- study area


def extents(spark: SparkSession, d: str) -> DataFrame:
    named = lambda df, n: clip.extent(df).select(F.lit(n).alias("data_basis"), "xmin", "ymin", "xmax", "ymax")
    return named(N.road_axes(spark, d), "authority").unionByName(named(N.community_ways(spark, d), "community"))


def _boxes(spark: SparkSession, d: str, box=None) -> DataFrame:
    return clip.study_boxes(N.road_axes(spark, d), N.community_ways(spark, d), box)


def boxes_common(spark: SparkSession, d: str) -> DataFrame:
    return _boxes(spark, d)


def boxes_given(spark: SparkSession, d: str) -> DataFrame:
    return _boxes(spark, d, GIVEN_BOX)


def bbox_filter(spark: SparkSession, d: str) -> DataFrame:
    boxes = pin(_boxes(spark, d, GIVEN_BOX))
    roads = clip.touching(N.community_segments(spark, d), boxes).select(F.lit("road").alias("kind"), F.col("edge_id").alias("id"))
    homes = clip.filter_points(N.addresses(spark, d), boxes).select(F.lit("address").alias("kind"), "id")
    return roads.unionByName(homes)


def clip_length(spark: SparkSession, d: str) -> DataFrame:
    parts = clip.clip(N.community_segments(spark, d), pin(_boxes(spark, d, GIVEN_BOX)))
    b = bounds(F.col("pts"))
    return parts.select(
        "edge_id", "part_no", line_length(F.col("pts")).cast("decimal(9,4)").alias("distance"),
        b["xmin"].cast(_COORD).alias("xmin"), b["ymax"].cast(_COORD).alias("ymax"),
    )


def _lonlat(spark: SparkSession, d: str) -> DataFrame:
    return N.table(spark, d, "customer").selectExpr(
        "c_custkey AS id", "7.0D + (c_custkey * 37 % 4000) / 1000.0D AS lon", "51.5D + (c_custkey * 91 % 3000) / 1000.0D AS lat"
    )


def _reprojected(df: DataFrame) -> DataFrame:
    p = F.element_at("pts", 1)
    return reproject(df).select("id", "srid", p["x"].cast(_COORD).alias("x"), p["y"].cast(_COORD).alias("y"))


def reproject_4326(spark: SparkSession, d: str) -> DataFrame:
    return _reprojected(_lonlat(spark, d).select("id", F.array(point("lon", "lat")).alias("pts"), F.lit(4326).alias("srid")))


def reproject_3857(spark: SparkSession, d: str) -> DataFrame:
    """Web-map coordinates of every customer, in whole metres."""
    c = N.table(spark, d, "customer").selectExpr(
        "c_custkey AS id", "double(780000 + c_custkey * 37 % 440000) AS x", "double(6700000 + c_custkey * 91 % 500000) AS y"
    )
    return _reprojected(c.select("id", F.array(point("x", "y")).alias("pts"), F.lit(3857).alias("srid")))


# ---------------------------------------------------------------- topology


def check_edges(spark: SparkSession, d: str) -> DataFrame:
    """All segments, and made-up faults: a crossing line per supplier, a ring per region, a gap per nation."""
    base = N.community_segments(spark, d).select("edge_id", "pts")
    oneway = N.community_ways(spark, d).select("edge_id", "oneway")
    base = base.join(oneway, "edge_id")
    line = N.table(spark, d, "supplier").selectExpr(
        f"{EXTRA_IDS} + s_suppkey AS edge_id",
        "array(named_struct('x', double(430050 + 100 * (s_suppkey % 100)), 'y', double(5929950 + 1000 * (s_suppkey div 100))),"
        " named_struct('x', double(430050 + 100 * (s_suppkey % 100)), 'y', double(5930650 + 1000 * (s_suppkey div 100)))) AS pts",
    )
    ring = N.table(spark, d, "region").selectExpr(
        f"{2 * EXTRA_IDS} + r_regionkey AS edge_id",
        "transform(array(0, 10, 20, 0), i -> named_struct('x', double(420000 + 50 * r_regionkey + i), 'y', double(5920000 + i % 20))) AS pts",
    )
    a, b = N._grid("4 * n_nationkey", "0"), N._grid("4 * n_nationkey + 1", "0")
    stub = N.table(spark, d, "nation").selectExpr("n_nationkey", f"{a} AS pa", f"{b} AS pb").selectExpr(
        "n_nationkey", "(pa.x + pb.x) / 2 AS mx", "(pa.y + pb.y) / 2 AS my",
        "(pa.y - pb.y) / sqrt((pb.x - pa.x) * (pb.x - pa.x) + (pb.y - pa.y) * (pb.y - pa.y)) AS nx",
        "(pb.x - pa.x) / sqrt((pb.x - pa.x) * (pb.x - pa.x) + (pb.y - pa.y) * (pb.y - pa.y)) AS ny",
    ).selectExpr(
        f"{3 * EXTRA_IDS} + n_nationkey AS edge_id",
        "array(named_struct('x', mx + 0.3D * nx, 'y', my + 0.3D * ny), named_struct('x', mx + 40 * nx, 'y', my + 40 * ny)) AS pts",
    )
    return reduce(lambda p, q: p.unionByName(q, allowMissingColumns=True), [base, line, ring, stub])


def _check_network(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    def make():
        edges, nodes = topology.build_topology(pin_table(check_edges(spark, d)))
        return pin_table(edges), pin_table(nodes)

    return stages._once(spark, d, "check network", make)


def topology_nodes(spark: SparkSession, d: str) -> DataFrame:
    nodes = _check_network(spark, d)[1]
    return nodes.select("node_id", F.col("x").cast(_COORD).alias("x"), F.col("y").cast(_COORD).alias("y"), "cnt")


def topology_edges(spark: SparkSession, d: str) -> DataFrame:
    return _check_network(spark, d)[0].select("edge_id", "source", "target")


def node_degree(spark: SparkSession, d: str) -> DataFrame:
    degrees = topology.node_degrees(_check_network(spark, d)[0])
    return degrees.groupBy(F.col("cnt").alias("degree")).agg(F.count("*").alias("nodes"))


def dead_ends(spark: SparkSession, d: str) -> DataFrame:
    return topology.dead_ends(_check_network(spark, d)[1]).select("node_id")


def isolated_edges(spark: SparkSession, d: str) -> DataFrame:
    return topology.isolated_edges(*_check_network(spark, d))


def rings(spark: SparkSession, d: str) -> DataFrame:
    return topology.rings(_check_network(spark, d)[0])


def crossings(spark: SparkSession, d: str) -> DataFrame:
    return spatial.crossing_pairs(_check_network(spark, d)[0])


def gaps(spark: SparkSession, d: str) -> DataFrame:
    return topology.gaps(*_check_network(spark, d), GAP_TOLERANCE)


def topology_report(spark: SparkSession, d: str) -> DataFrame:
    return topology.check_topology(*_check_network(spark, d), GAP_TOLERANCE)


def oneway_check(spark: SparkSession, d: str) -> DataFrame:
    return topology.check_oneway(_check_network(spark, d)[0])


STRICT_ONEWAY = {
    "s_in": ["", "no", "-1"], "s_out": ["", "no", "yes", "true", "1"],
    "t_in": ["", "no", "yes", "true", "1"], "t_out": ["", "no", "-1"],
}


def oneway_check_strict(spark: SparkSession, d: str) -> DataFrame:
    """The same check under rules that take the one-way values literally."""
    return topology.check_oneway(_check_network(spark, d)[0], STRICT_ONEWAY)


# ---------------------------------------------------------------- points


def serial_ids(spark: SparkSession, d: str) -> DataFrame:
    named = N.table(spark, d, "customer").select("c_name", "c_custkey")
    return dense_serial(named, [F.desc("c_name")], "serial").select("serial", "c_custkey")


def sample_points(spark: SparkSession, d: str) -> DataFrame:
    """A hundred addresses drawn by the hash of their id."""
    return batch.sample_points(N.addresses(spark, d), 100, seed="7").select("id", "address_id", "x", "y")


def od_pairs(spark: SparkSession, d: str) -> DataFrame:
    return batch.pair_points(N.addresses(spark, d))


def missing_points(spark: SparkSession, d: str) -> DataFrame:
    """Customers named by an order that are not among the first half of a pair."""
    starts = od_pairs(spark, d).select(F.col("start_id").alias("id"))
    return batch.missing_ids(N.table(spark, d, "orders"), starts, "o_custkey")


def next_route_id(spark: SparkSession, d: str) -> DataFrame:
    return batch.next_id([N.table(spark, d, "orders").select(F.col("o_orderkey").alias("k")), N.addresses(spark, d).select(F.col("id").alias("k"))], "k")


def nearest_edge(spark: SparkSession, d: str) -> DataFrame:
    near = spatial.nearest_edge(stages.points(spark, d), pin_table(N.community_segments(spark, d)))
    return near.select(
        "point_id", "edge_id", "seg_no", F.col("dist").cast("decimal(9,4)").alias("dist"),
        F.col("qx").cast(_COORD).alias("qx"), F.col("qy").cast(_COORD).alias("qy"),
    )


def nearest_node(spark: SparkSession, d: str) -> DataFrame:
    edges = pin_table(N.community_segments(spark, d))
    near = spatial.nearest_edge(stages.points(spark, d), edges).select("point_id", F.col("qx").alias("x"), F.col("qy").alias("y"))
    _, nodes = topology.build_topology(edges)
    return spatial.nearest_node(near, nodes, NODE_RADIUS).select("point_id", "node_id", F.col("node_dist").cast("decimal(9,4)").alias("node_dist"))


def split_edges(spark: SparkSession, d: str) -> DataFrame:
    """Every weighted segment split at the foot of each address that falls inside it."""
    edges = stages.weighted(spark, d, "community").withColumns({"source": F.col("edge_id") * 2, "target": F.col("edge_id") * 2 + 1})
    near = spatial.nearest_edge(stages.points(spark, d), edges)
    cuts = pin_table(near.filter("t > 0 AND t < 1").withColumn("node_id", F.lit(EXTRA_IDS) + F.col("point_id")))
    return snap.split_edges(edges, cuts).select(
        "edge_id", "orig_edge_id", "part_no", "source", "target", "distance", "weights_car", "weights_car_reverse", "highway"
    )


def snapped_points(spark: SparkSession, d: str) -> DataFrame:
    return stages.snapped(spark, d, "community").points.select("point_id", "node_id", "edge_id", "hook_length")


def snapped_network(spark: SparkSession, d: str) -> DataFrame:
    return stages.snapped(spark, d, "authority").edges.select("edge_id", "orig_edge_id", "part_no", "source", "target", "distance", "weights_car", "weights_car_reverse")


# ---------------------------------------------------------------- paths


def _catchment(spark: SparkSession, d: str, kind: str) -> DataFrame:
    edges, nodes = stages.network(spark, d, kind)
    reached = paths.catchment(edges, nodes, stages.catchment_starts(spark, d, kind), CATCHMENT_SECONDS)
    return reached.select("start_id", "seq", "node_id", "edge_id_to_node", "cost", "total_cost_to_node")


def catchment_community(spark: SparkSession, d: str) -> DataFrame:
    return _catchment(spark, d, "community")


def catchment_authority(spark: SparkSession, d: str) -> DataFrame:
    return _catchment(spark, d, "authority")


def catchment_both(spark: SparkSession, d: str) -> DataFrame:
    """Nodes reached from every start, counted for both networks."""
    out = []
    for kind in ("authority", "community"):
        edges, nodes = stages.network(spark, d, kind)
        reached = paths.catchment(edges, nodes, stages.catchment_starts(spark, d, kind), CATCHMENT_SECONDS)
        count = reached.groupBy("start_id").agg(F.count("*").alias("nodes"), F.max("seq").cast("long").alias("last_seq"), F.max("total_cost_to_node").alias("farthest"))
        out.append(count.withColumn("data_basis", F.lit(kind)))
    return out[0].unionByName(out[1])


def restriction_remap(spark: SparkSession, d: str) -> DataFrame:
    return snap.remap_restrictions(N.restrictions(spark, d), stages.snapped(spark, d, "community").edges)


def route_steps(spark: SparkSession, d: str) -> DataFrame:
    return stages.full_steps(spark, d, "authority").drop("pts")


def turn_route_steps(spark: SparkSession, d: str) -> DataFrame:
    return stages.full_steps(spark, d, "community").drop("pts")


def route_status(spark: SparkSession, d: str) -> DataFrame:
    a, c = (status.withColumn("data_basis", F.lit(k)) for k, (_, status) in stages.both_routes(spark, d).items())
    return a.unionByName(c)


def route_compare(spark: SparkSession, d: str) -> DataFrame:
    stages.both_routes(spark, d)
    return compare.compare_routes(stages.full_steps(spark, d, "authority"), stages.full_steps(spark, d, "community"), 5.0)


# ---------------------------------------------------------------- line measures over all road pairs


def _line_pairs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    a = N.road_axes(spark, d).select(F.substring("gml_id", 2, 12).cast("long").alias("route_id"), "pts")
    return a, N.community_segments(spark, d).select(F.col("edge_id").alias("route_id"), "pts")


def line_overlap(spark: SparkSession, d: str) -> DataFrame:
    return compare.overlap_share(*_line_pairs(spark, d), BUFFER_RADIUS)


def line_hausdorff(spark: SparkSession, d: str) -> DataFrame:
    return compare.hausdorff(*_line_pairs(spark, d))


def line_frechet(spark: SparkSession, d: str) -> DataFrame:
    return compare.frechet(*_line_pairs(spark, d))


def _chains(orders: DataFrame) -> DataFrame:
    """The orders of each customer chained to one line in key order, every status-F edge turned round."""
    steps = N._cells(orders).selectExpr(
        "o_custkey AS pair_id", "i AS seq", "o_orderstatus = 'F' AS backward",
        f"array({N._grid('c1', 'r1')}, {N._grid('c2', 'r2')}) AS pts",
    )
    return compare.route_lines(steps)


def merged_lines(spark: SparkSession, d: str) -> DataFrame:
    """Size and length of the chained line of each customer."""
    return _chains(N.table(spark, d, "orders")).select("route_id", F.size("pts").alias("vertices"), line_length(F.col("pts")).cast("decimal(14,3)").alias("length"))


def chain_hausdorff(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's line of all orders against the line of those that are not urgent: lines of many vertices."""
    orders = N.table(spark, d, "orders")
    return compare.hausdorff(_chains(orders), _chains(orders.filter("o_orderpriority <> '1-URGENT'")))


def route_means(spark: SparkSession, d: str) -> DataFrame:
    """Mean row over differences made from order values, NULLs left out."""
    o = N.table(spark, d, "orders").selectExpr(
        "o_orderkey + 1 AS route_id", "cast(o_orderkey % 97 - 40 AS decimal(18,4)) AS distance_diff",
        "cast(CASE WHEN o_orderstatus <> 'P' THEN o_custkey % 31 END AS decimal(12,2)) AS driving_time_diff",
        "cast(o_custkey % 7 AS decimal(9,4)) AS hook_length_diff", "cast(o_orderkey % 101 AS decimal(5,2)) AS buffer",
        "cast(o_orderkey % 13 AS decimal(9,4)) AS hausdorff_distance", "cast(o_orderkey % 17 AS decimal(9,4)) AS frechet_distance",
    )
    return compare.mean_row(o).filter("route_id = 0").select(*compare.MEANS)


# ---------------------------------------------------------------- audits and sinks


def key_audit(spark: SparkSession, d: str) -> DataFrame:
    return tables.duplicate_keys(N.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


def orphan_audit(spark: SparkSession, d: str) -> DataFrame:
    """Orders whose number is no customer, seen as references."""
    return tables.orphans(N.table(spark, d, "orders"), "o_orderkey", N.table(spark, d, "customer"), "c_custkey").select("o_orderkey")


def upsert_rows(spark: SparkSession, d: str) -> DataFrame:
    old = N.table(spark, d, "customer").selectExpr("c_custkey AS k", "c_mktsegment AS v")
    new = N.table(spark, d, "orders").groupBy((F.col("o_custkey") * 2).alias("k")).agg(F.max("o_orderpriority").alias("v"))
    return tables.upsert(old, new, ["k"]).select("k", "v")


REGISTRY = [
    network_completeness, car_filter, access_filter, explode_model, notin_null_aware, union_axes, street_enrich,
    authority_assemble, tags_segments_join, oneway_patch, tag_rules, segment_cut, address_points, edge_length,
    speed_community, speed_authority, weights_community, weights_authority, weights_oneway, extents, boxes_common, boxes_given,
    bbox_filter, clip_length, reproject_4326, reproject_3857, topology_nodes, topology_edges, node_degree,
    dead_ends, isolated_edges, rings, crossings, gaps, topology_report, oneway_check, oneway_check_strict,
    serial_ids, sample_points, od_pairs, missing_points, next_route_id, nearest_edge, nearest_node, split_edges,
    snapped_points, snapped_network, catchment_community, catchment_authority, catchment_both, restriction_remap,
    route_steps, turn_route_steps, route_status, route_compare, line_overlap, line_hausdorff, line_frechet,
    chain_hausdorff, merged_lines, route_means, key_audit, orphan_audit, upsert_rows,
]
