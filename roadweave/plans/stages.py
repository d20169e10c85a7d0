"""Workflow stages shared by several queries, pinned once per session and data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave.operators import batch, paths
from roadweave.operators.snap import Snapped, remap_restrictions, snap_points
from roadweave.operators.topology import build_topology
from roadweave.plans import networks as N
from roadweave.session import pin, pin_table, side_by_side

_MEMO: dict = {}


def forget() -> None:
    _MEMO.clear()


def _once(spark: SparkSession, sf_dir: str, name: str, make):
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _MEMO:
        _MEMO[key] = make()
    return _MEMO[key]


def weighted(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Weighted edges. Authority rows listed twice by their model are one edge for routing."""

    def make():
        if kind == "community":
            return pin_table(N.community_weighted(spark, sf_dir))
        edges = N.authority_weighted(spark, sf_dir)
        first = edges.groupBy("gml_id").agg(F.min("edge_id").alias("edge_id"))
        return pin_table(edges.join(first.select("edge_id"), "edge_id", "left_semi"))

    return _once(spark, sf_dir, f"weighted {kind}", make)


def network(spark: SparkSession, sf_dir: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """Edges with source and target, and nodes."""

    def make():
        edges, nodes = build_topology(weighted(spark, sf_dir, kind))
        return pin_table(edges), pin_table(nodes)

    return _once(spark, sf_dir, f"network {kind}", make)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.addresses(spark, sf_dir).withColumnRenamed("id", "point_id")


def snapped(spark: SparkSession, sf_dir: str, kind: str) -> Snapped:
    def make():
        edges, nodes = network(spark, sf_dir, kind)
        return snap_points(points(spark, sf_dir), edges, nodes)

    return _once(spark, sf_dir, f"snapped {kind}", make)


def pairs(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """All addresses paired in register order, with their nodes."""

    def make():
        pairs = batch.pair_points(N.addresses(spark, sf_dir))
        return pin(batch.pairs_on_network(pairs, snapped(spark, sf_dir, kind).points))

    return _once(spark, sf_dir, f"pairs {kind}", make)


def routes(spark: SparkSession, sf_dir: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """Steps and status; the community network uses turn penalties, the authority one has none."""

    def make():
        net, asked = snapped(spark, sf_dir, kind), pairs(spark, sf_dir, kind)
        if kind == "community":
            bans = remap_restrictions(N.restrictions(spark, sf_dir), net.edges)
            steps, status = paths.turn_routes(net.edges, net.nodes, bans, asked)
        else:
            steps, status = paths.shortest_routes(net.edges, net.nodes, asked)
        return pin(steps), pin(status)

    return _once(spark, sf_dir, f"routes {kind}", make)


KINDS = ("authority", "community")


def both_routes(spark: SparkSession, sf_dir: str) -> dict[str, tuple[DataFrame, DataFrame]]:
    """Routes on the two networks, searched at the same time."""
    return dict(zip(KINDS, side_by_side(*[lambda k=k: routes(spark, sf_dir, k) for k in KINDS])))


def full_steps(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Route steps with edge attributes, hook lengths and point ids."""
    net = snapped(spark, sf_dir, kind)
    own = {"community": ["osm_id"], "authority": ["gml_id"]}[kind]
    columns = ["source", "target", "pts", "distance", "maxspeed", "weights_car", "weights_car_reverse", *own]
    steps = batch.attach_edges(routes(spark, sf_dir, kind)[0], net.edges, columns)
    return batch.attach_hooks(steps, pairs(spark, sf_dir, kind))


def catchment_starts(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """One start per customer: the node where the lowest edge of theirs in the network begins."""
    edges, _ = network(spark, sf_dir, kind)
    if kind == "community":
        owner = N.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS edge_id", "o_custkey AS start_id")
        owned = edges.select("edge_id", "source").join(owner, "edge_id")
    else:
        owned = edges.select("edge_id", "source", F.col("istTeilVon").cast("long").alias("start_id"))
    return owned.groupBy("start_id").agg(F.min_by("source", "edge_id").alias("node_id"))
