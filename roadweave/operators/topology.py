"""Node table from edge ends, and the checks on the resulting graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadweave.functions.geometry import first_point, last_point, segments, with_foot
from roadweave.operators.spatial import (
    CELL, cells_in_reach, crossing_pairs, merge_points, tile_segments,
)

TOLERANCE = 0.00001  # metres


def edge_ends(edges: DataFrame) -> DataFrame:
    """Two rows per edge: pid = 2 * edge_id for the start and 2 * edge_id + 1 for the end."""
    end = lambda side, p: F.struct(
        (F.col("edge_id") * 2 + side).cast("long").alias("pid"), p["x"].alias("x"), p["y"].alias("y")
    )
    pts = F.col("pts")
    ends = F.when(F.size(pts) > 1, F.array(end(0, first_point(pts)), end(1, last_point(pts))))
    return edges.select("edge_id", F.inline(ends))


def build_topology(edges: DataFrame, tolerance: float = TOLERANCE) -> tuple[DataFrame, DataFrame]:
    """edges (edge_id, pts, …) → (edges with source and target, nodes (node_id, x, y, cnt)).

    Ends within the tolerance of a node share it; no two nodes are that near. A node is named after its lowest end, so its
    id needs no global numbering and does not depend on partitioning. Edges without a line keep NULLs.
    """
    ends = edge_ends(edges)
    at_node = ends.join(merge_points(ends, tolerance, by_id=False), ["x", "y"])
    side = lambda n: F.max(F.when(F.col("pid") % 2 == n, F.col("node_id")))
    linked = at_node.groupBy("edge_id").agg(side(0).alias("source"), side(1).alias("target"))
    nodes = at_node.groupBy("node_id").agg(
        F.max("node_x").alias("x"), F.max("node_y").alias("y"), F.count("*").alias("cnt")
    )
    return edges.drop("source", "target").join(linked, "edge_id", "left"), nodes


def node_degrees(edges: DataFrame) -> DataFrame:
    """node_id, cnt = number of edge ends at it."""
    return (
        edges.select(F.explode(F.array("source", "target")).alias("node_id"))
        .filter("node_id IS NOT NULL")
        .groupBy("node_id")
        .agg(F.count("*").alias("cnt"))
    )


def dead_ends(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("cnt") == 1)


def isolated_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with no neighbour at either end."""
    ends = edges.select("edge_id", F.explode(F.array("source", "target")).alias("node_id"))
    return (
        ends.join(nodes.select("node_id", "cnt"), "node_id")
        .groupBy("edge_id")
        .agg(F.max("cnt").alias("cnt"))
        .filter("cnt = 1")
        .select("edge_id")
    )


def rings(edges: DataFrame) -> DataFrame:
    """Edges that end where they start."""
    return edges.filter((F.size("pts") > 2) & (first_point(F.col("pts")) == last_point(F.col("pts")))).select("edge_id")


def gaps(edges: DataFrame, nodes: DataFrame, tolerance: float, cell: float = 128.0) -> DataFrame:
    """Dead ends within the tolerance of an edge they do not belong to (node_id, edge_id)."""
    cell = max(cell, 4 * tolerance)
    lonely = dead_ends(nodes).select("node_id", F.col("x").alias("px"), F.col("y").alias("py"))
    seen = lonely.select("*", F.inline(cells_in_reach(F.col("px"), F.col("py"), tolerance, cell)))
    tiles = tile_segments(segments(edges, ["edge_id", "source", "target"]), cell)
    foreign = (F.col("node_id") != F.col("source")) & (F.col("node_id") != F.col("target"))
    return (
        with_foot(seen.join(tiles, CELL).filter(foreign))
        .filter(F.col("dist") <= tolerance)
        .select("node_id", "edge_id")
        .distinct()
    )


def check_topology(edges: DataFrame, nodes: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Report (check, n): isolated segments, dead ends, potential gaps, intersections, rings, no geometry."""
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")
    report = count(isolated_edges(edges, nodes), "isolated")
    report = report.unionByName(count(dead_ends(nodes), "dead_ends"))
    report = report.unionByName(count(gaps(edges, nodes, tolerance).select("node_id").distinct(), "gaps"))
    report = report.unionByName(count(crossing_pairs(edges), "intersections"))
    report = report.unionByName(count(rings(edges), "rings"))
    return report.unionByName(count(edges.filter("pts IS NULL OR edge_id IS NULL"), "null_rows"))


# fixed values: one-way texts accepted as going in or out at either end
ONEWAY_RULES = {key: ["", "no", "yes"] for key in ("s_in", "s_out", "t_in", "t_out")}


def check_oneway(edges: DataFrame, rules: dict[str, list[str]] | None = None, column: str = "oneway") -> DataFrame:
    """Per node the number of edges leading in and out under the rules (NULL = both ways), and
    whether one of the two is missing."""
    rules = rules or ONEWAY_RULES
    ok = lambda key: (F.col(column).isNull() | F.col(column).isin(rules[key])).cast("int")
    end = lambda node, side: F.struct(
        F.col(node).alias("node_id"), ok(f"{side}_in").alias("i"), ok(f"{side}_out").alias("o")
    )
    return (
        edges.select(F.inline(F.array(end("source", "s"), end("target", "t"))))
        .filter("node_id IS NOT NULL")
        .groupBy("node_id")
        .agg(F.sum("i").alias("ein"), F.sum("o").alias("eout"))
        .withColumn("problem", (F.col("ein") == 0) | (F.col("eout") == 0))
    )
