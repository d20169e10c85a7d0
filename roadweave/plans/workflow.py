"""The whole analysis as one call: two road data sets and an address register in, all measures out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave.functions.projection import reproject
from roadweave.operators import assemble, batch, clip, compare, paths, snap, topology, weights
from roadweave.session import dense_serial, pin, pin_table, side_by_side
from roadweave.sources import tables


@dataclass
class Inputs:
    """Raw tables; lines are in the column pts, their coordinate system in srid (25832 where there is no such column)."""

    axes: DataFrame
    carriageways: DataFrame
    streets: DataFrame
    ways: DataFrame
    segments: DataFrame
    restrictions: DataFrame
    addresses: DataFrame
    oneway_patch: DataFrame | None = None


@dataclass
class Network:
    edges: DataFrame
    nodes: DataFrame
    checks: DataFrame


@dataclass
class Results:
    boxes: DataFrame
    networks: dict[str, Network]
    network_measures: DataFrame
    points: DataFrame
    steps: dict[str, DataFrame]
    status: DataFrame
    route_measures: DataFrame

    def save(self, folder: str, add: bool = False, catchments: DataFrame | None = None) -> None:
        """One table per result; what exists for both data sets is partitioned by it.

        With add, routes and catchments join those stored in the folder: their numbers go on from the highest stored one
        of both data sets; networks, boxes and network measures stay as they are. The mean row of the comparison
        belongs to the run and is kept with its route numbers' offset in `run_from`.
        """
        both = lambda parts: [df.withColumn("data_basis", F.lit(k)) for k, df in parts.items()]
        spark = self.boxes.sparkSession
        put = tables.append if add else tables.write_new
        stored = lambda name, column: spark.read.parquet(f"{folder}/{name}").select(F.col(column).alias("k"))
        first_route = batch.next_id([stored("status", "pair_id")], "k").first().next_id if add else 1
        moved = lambda df, column: df.withColumn(column, F.col(column) + F.lit(first_route - 1).cast("long"))
        steps = both({k: moved(df, "pair_id") for k, df in self.steps.items()})
        put(steps[0].unionByName(steps[1], allowMissingColumns=True), f"{folder}/route_steps", "data_basis")
        put(moved(self.status, "pair_id"), f"{folder}/status", "data_basis")
        number = F.when(F.col("route_id") == 0, F.col("route_id")).otherwise(F.col("route_id") + F.lit(first_route - 1).cast("long"))
        put(self.route_measures.withColumns({"route_id": number, "run_from": F.lit(first_route).cast("long")}), f"{folder}/route_measures")
        put(self.points.withColumn("run_from", F.lit(first_route).cast("long")), f"{folder}/points")
        if catchments is not None:
            self.save_catchments(catchments, folder, add)
        if add:
            return
        tables.write_new(self.boxes, f"{folder}/boxes")
        tables.write_new(self.network_measures, f"{folder}/network_measures")
        for name, get in (("edges", lambda n: n.edges), ("nodes", lambda n: n.nodes), ("checks", lambda n: n.checks)):
            first, second = both({k: get(n) for k, n in self.networks.items()})
            tables.write_new(first.unionByName(second, allowMissingColumns=True), f"{folder}/{name}", "data_basis")

    def save_catchments(self, catchments: DataFrame, folder: str, add: bool = False) -> None:
        """Store catchments under numbers of their own (catchment_id), the same for a start in both data sets."""
        spark = catchments.sparkSession
        first = batch.next_id([spark.read.parquet(f"{folder}/catchments").select(F.col("catchment_id").alias("k"))], "k").first().next_id if add else 1
        numbers = dense_serial(catchments.select("start_id").distinct(), ["start_id"], "catchment_id", start=first)
        put = tables.append if add else tables.write_new
        put(catchments.join(numbers, "start_id"), f"{folder}/catchments", "data_basis")


def _in_utm(df: DataFrame, name: str) -> DataFrame:
    """Lines in metres; a line whose coordinate system is missing or cannot be handled stops the analysis."""
    if "srid" not in df.columns:
        return df
    moved = reproject(df)
    odd = [r.srid for r in moved.where("pts IS NOT NULL AND (srid IS NULL OR srid <> 25832)").select("srid").distinct().take(5)]
    if odd:
        raise ValueError(f"{name}: lines in unknown coordinate systems: {odd}")
    return moved


def _network(edges: DataFrame, oneway: bool) -> Network:
    edges = pin_table(edges)
    linked, nodes = topology.build_topology(edges)
    linked, nodes = pin_table(linked), pin_table(nodes)
    checks = topology.check_topology(linked, nodes)
    if oneway:
        wrong = topology.check_oneway(linked).filter("problem").agg(F.count("*").alias("n"))
        checks = checks.unionByName(wrong.select(F.lit("oneway").alias("check"), "n"))
    return Network(linked, nodes, checks)


def run(
    inputs: Inputs, box: tuple[float, float, float, float] | None = None, points: int = 1000, radius: float = 5.0, seed: str = "0",
    road_inset: float = clip.ROAD_INSET, address_inset: float = clip.ADDRESS_INSET, stored_points: DataFrame | None = None,
) -> Results:
    """Assemble, reproject, clip, link, measure, weight, sample, route and compare.

    Network measures are taken before missing speeds are filled in. Routes of the community network
    pay for restricted turns; the authority data have no restrictions. With `stored_points`, the points of
    a run before, nothing new is drawn while that table holds rows: an error says so.
    """
    authority = _in_utm(assemble.assemble_authority(inputs.axes, inputs.carriageways, inputs.streets), "axes")
    ways = _in_utm(assemble.filter_car_roads(inputs.ways), "ways")
    segments = _in_utm(inputs.segments, "segments")
    authority, ways = pin_table(authority), pin_table(ways)

    boxes = pin(clip.study_boxes(authority, ways, box, road_inset, address_inset))
    homes = clip.filter_points(inputs.addresses, boxes)
    authority = clip.unique_parts(clip.clip(authority, boxes))
    if inputs.oneway_patch is not None:
        authority = assemble.patch_oneway(authority, inputs.oneway_patch)
    authority = assemble.widen(authority, {"fahrtrichtung": "boolean"})
    community = assemble.join_segments(clip.clip(ways, boxes).drop("part_no"), clip.unique_parts(clip.clip(segments, boxes)))

    nets = {"authority": _network(weights.set_length(authority), False), "community": _network(weights.set_length(community), True)}
    measures = pin(compare.compare_networks(nets["authority"].edges, nets["community"].edges))
    weigh = {
        "authority": lambda e: weights.set_weights(weights.set_speed_authority(e), weights.authority_profile()),
        "community": lambda e: weights.set_weights(weights.set_speed_community(e), weights.community_profile()),
    }
    sample = pin(batch.sample_points(homes, points, seed, stored_points))
    pairs = pin(batch.pair_points(sample))

    def route(kind: str):
        net = nets[kind]
        edges = pin_table(weigh[kind](net.edges))
        put = snap.snap_points(sample.withColumnRenamed("id", "point_id"), edges, net.nodes)
        asked = pin(batch.pairs_on_network(pairs, put.points))
        if kind == "community":
            bans = snap.remap_restrictions(inputs.restrictions, put.edges)
            found, told = paths.turn_routes(put.edges, put.nodes, bans, asked)
        else:
            found, told = paths.shortest_routes(put.edges, put.nodes, asked)
        full = batch.attach_edges(found, put.edges, ["source", "target", "pts", "distance", "maxspeed", "weights_car", "weights_car_reverse"])
        steps = pin(batch.attach_hooks(full, asked).withColumn("maxspeed", F.col("maxspeed").cast("string")))
        return Network(put.edges, put.nodes, net.checks), steps, told.withColumn("data_basis", F.lit(kind))

    done = dict(zip(nets, side_by_side(*[lambda k=k: route(k) for k in nets])))
    nets = {k: v[0] for k, v in done.items()}
    steps = {k: v[1] for k, v in done.items()}
    status = [v[2] for v in done.values()]
    routes = pin(compare.compare_routes(steps["authority"], steps["community"], radius))
    return Results(boxes, nets, measures, sample, steps, pin(status[0].unionByName(status[1])), routes)


def catchments(results: Results, starts: DataFrame, seconds: float) -> DataFrame:
    """Nodes reached from sampled points (start_id) within a driving time, in both networks.

    An unknown start or a driving time that is not above 0 fails before any search. The first row of each catchment has
    the point's id and its hook length. Points of the sample meet the node their route made; snapping them again changes
    nothing.
    """
    if not float(seconds) > 0:
        raise ValueError(f"driving time has to be greater than 0 seconds, got {seconds}")
    batch.require_ids(starts, results.points, "start_id")
    out = []
    for kind, net in results.networks.items():
        put = snap.snap_points(
            results.points.join(starts.select(F.col("start_id").alias("id")), "id", "left_semi").withColumnRenamed("id", "point_id"),
            net.edges, net.nodes,
        )
        at = put.points.select(F.col("point_id").alias("start_id"), "node_id")
        reached = paths.catchment(put.edges, put.nodes, at, seconds)
        out.append(batch.attach_start_hooks(reached, put.points).withColumn("data_basis", F.lit(kind)))
    return out[0].unionByName(out[1])
