"""Grid joins: merging near points, tiling segments, nearest edge, nearest node, crossings.

Every spatial join is an equi join on grid cells followed by the exact test, so Spark can shuffle,
spill and split it. Cells are refined where they are crowded; nothing is compared across whole tables.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from roadweave.functions.geometry import distance, segments, with_foot
from roadweave.session import pin, pin_table

CELL = ["ix", "iy"]


def cell_of(value: Column, size: float | Column) -> Column:
    return F.floor(value / size).cast("long")


def cells_in_reach(x: Column, y: Column, reach: float, size: float) -> Column:
    """Array of the grid cells that the square of half width `reach` around a point touches."""
    span = lambda v: F.sequence(cell_of(v - reach, size), cell_of(v + reach, size))
    return F.flatten(
        F.transform(
            span(x), lambda i: F.transform(span(y), lambda j: F.struct(i.alias("ix"), j.alias("iy")))
        )
    )


def home_cell(df: DataFrame, size: float, x: str = "x", y: str = "y") -> DataFrame:
    return df.withColumns({"ix": cell_of(F.col(x), size), "iy": cell_of(F.col(y), size)})


def cells_of_segment(size: float | Column) -> Column:
    """Array of the cells a segment x1..y2 runs through: per column of cells, the y range inside it."""
    c = F.col
    x1, y1, x2, y2 = c("x1"), c("y1"), c("x2"), c("y2")
    lo_x, hi_x = F.least(x1, x2), F.greatest(x1, x2)
    slack = size * 1e-9  # both sides of a cell border count as touched
    slope = (y2 - y1) / F.nullif(x2 - x1, F.lit(0.0))

    def column(ix):
        left, right = F.greatest(ix * size, lo_x), F.least((ix + 1) * size, hi_x)
        ya = F.coalesce(y1 + (left - x1) * slope, y1)
        yb = F.coalesce(y1 + (right - x1) * slope, y2)
        return F.transform(
            F.sequence(cell_of(F.least(ya, yb) - slack, size), cell_of(F.greatest(ya, yb) + slack, size)),
            lambda iy: F.struct(ix.alias("ix"), iy.alias("iy")),
        )

    return F.flatten(F.transform(F.sequence(cell_of(lo_x - slack, size), cell_of(hi_x + slack, size)), column))


def tile_segments(segs: DataFrame, size: float) -> DataFrame:
    """Segments × the cells they run through."""
    return segs.select("*", F.inline(cells_of_segment(F.lit(float(size)))))


def refine_crowded(tiles: DataFrame, size: float, crowd: int) -> DataFrame:
    """Split cells with more than `crowd` segments into 4^k smaller ones (columns k, jx, jy).

    Bounds the number of pairs a self join on the cell makes where the data is dense.
    """
    level = F.ceil(F.log2(F.sqrt(F.col("_n") / F.lit(float(crowd))))).cast("int")
    counts = tiles.groupBy(*CELL).agg(F.count("*").alias("_n"))
    counts = counts.select(*CELL, F.least(F.greatest(level, F.lit(0)), F.lit(12)).alias("k"))
    parts = F.pow(F.lit(2.0), F.col("k"))
    fine = F.lit(float(size)) / parts
    inside = F.filter(
        cells_of_segment(fine),
        lambda s: (F.floor(s["ix"] / parts) == F.col("ix")) & (F.floor(s["iy"] / parts) == F.col("iy")),
    )
    inside = F.transform(inside, lambda s: F.struct(s["ix"].alias("jx"), s["iy"].alias("jy")))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("jx"), F.lit(0).cast("long").alias("jy")))
    return tiles.join(counts, CELL).select("*", F.inline(F.when(F.col("k") == 0, whole).otherwise(inside)))


# ---------------------------------------------------------------- merging points


def merge_points(points: DataFrame, radius: float, by_id: bool = True) -> DataFrame:
    """Which points become nodes when points arrive in the order of `pid` and a point within `radius`
    of an earlier node takes the nearest such node instead of becoming one.

    points (pid, x, y) → one row per distinct place (x, y, node_id, node_x, node_y), where node_id is
    the pid of the point that made the node. Same outcome as the one-by-one rule, found in parallel:
    a point that is the smallest undecided one in all cells it can reach becomes a node, its
    neighbours drop out, and so on. Copies of one place are collapsed first.

    With by_id=False a hash of the place decides in place of the id, so that a long chain of near points takes rounds by the
    logarithm of its length; every point takes the nearest node, and node_id is the lowest pid at the node.
    """
    size = 8 * radius
    places = points.groupBy("x", "y").agg(F.min("pid").alias("rid"))
    rank = F.col("rid") if by_id else F.xxhash64("x", "y", "rid")
    crowded = pin(_crowded(places, radius))
    own = lambda df: df.select("x", "y", F.col("rid").alias("node_id"), F.col("x").alias("node_x"), F.col("y").alias("node_y"))
    if crowded.isEmpty():
        return own(places)

    undecided, nodes = crowded, None
    reach = lambda df: df.select("*", F.inline(cells_in_reach(F.col("x"), F.col("y"), radius, size)))
    while not undecided.isEmpty():
        seen = reach(undecided.withColumn("rank", rank))
        first = seen.groupBy(*CELL).agg(F.min("rank").alias("_first"))
        fresh = pin(
            seen.join(first, CELL)
            .groupBy("rid", "x", "y", "rank")
            .agg(F.min("_first").alias("_first"))
            .filter("_first = rank")
            .drop("_first", "rank")
        )
        nodes = fresh if nodes is None else nodes.unionByName(fresh)
        taken = _near(seen, fresh, radius, size, by_id).select("rid").distinct()
        undecided = pin(
            undecided.join(fresh.select("rid"), "rid", "left_anti").join(taken, "rid", "left_anti")
        )
    followers = reach(crowded.join(nodes.select("rid"), "rid", "left_anti"))
    follow = (
        _near(followers, nodes, radius, size, by_id)
        .groupBy("rid", "x", "y")
        .agg(F.min(F.struct("_d", "_node", "_nx", "_ny")).alias("_best"))
        .select("x", "y", *[F.col(f"_best.{a}").alias(b) for a, b in (("_node", "node_id"), ("_nx", "node_x"), ("_ny", "node_y"))])
    )
    lonely = places.join(crowded.select("rid"), "rid", "left_anti")
    if by_id:
        return reduce(DataFrame.unionByName, [own(lonely), own(nodes), follow])
    merged = pin(own(nodes).unionByName(follow))
    lowest = merged.join(crowded, ["x", "y"]).groupBy("node_id").agg(F.min("rid").alias("_lowest"))
    named = merged.join(lowest, "node_id").withColumn("node_id", F.col("_lowest")).drop("_lowest")
    return own(lonely).unionByName(named)


def _crowded(places: DataFrame, radius: float) -> DataFrame:
    """Places (rid, x, y) that meet another one in a cell; every place with one within the radius is among them.

    Most places of a network are alone, so this is the one step that moves them all: a place goes to few cells, once. Cells
    are wide and begin off the round coordinates, as a place on a border would go to four.
    """
    size = 16 * radius
    shifted = lambda v: F.col(v) + F.lit(0.37 * size)
    visits = places.select("rid", "x", "y", F.inline(cells_in_reach(shifted("x"), shifted("y"), 1.01 * radius, size)))
    cell = W.partitionBy(*CELL)
    seen = visits.withColumns({"_lo": F.min("rid").over(cell), "_hi": F.max("rid").over(cell)})
    return seen.filter("_lo <> _hi").select("rid", "x", "y").distinct()


def _near(visits: DataFrame, nodes: DataFrame, radius: float, size: float, by_id: bool = True) -> DataFrame:
    """Pairs of a visiting point and a node within the radius, an earlier one by id; a node sits in one cell only."""
    made = home_cell(nodes.select(F.col("rid").alias("_node"), F.col("x").alias("_nx"), F.col("y").alias("_ny")), size, "_nx", "_ny")
    return (
        visits.join(made, CELL)
        .withColumn("_d", distance(F.col("x"), F.col("y"), F.col("_nx"), F.col("_ny")))
        .filter((F.col("_d") <= radius) & (F.col("_node") < F.col("rid") if by_id else F.col("_node") != F.col("rid")))
    )


# ---------------------------------------------------------------- nearest things


def nearest_node(points: DataFrame, nodes: DataFrame, radius: float) -> DataFrame:
    """Nearest node within the radius (border included), lowest id on ties; no row when there is none.

    points (point_id, x, y), nodes (node_id, x, y) → point_id, node_id, node_dist
    """
    size = 4 * radius
    seen = points.select("point_id", "x", "y", F.inline(cells_in_reach(F.col("x"), F.col("y"), radius, size)))
    homes = home_cell(nodes.select("node_id", F.col("x").alias("_nx"), F.col("y").alias("_ny")), size, "_nx", "_ny")
    return (
        seen.join(homes, CELL)
        .withColumn("node_dist", distance(F.col("x"), F.col("y"), F.col("_nx"), F.col("_ny")))
        .filter(F.col("node_dist") <= radius)
        .groupBy("point_id")
        .agg(F.min(F.struct("node_dist", "node_id")).alias("_b"))
        .select("point_id", "_b.node_id", "_b.node_dist")
    )


def nearest_edge(
    points: DataFrame, edges: DataFrame, cell: float = 64.0, by: list[str] | None = None, crowd: int = 2000
) -> DataFrame:
    """Nearest edge of every point, with the foot point on it; lowest edge id on ties.

    points (point_id, x, y), edges (edge_id, pts) →
    point_id, x, y, edge_id, seg_no, t, qx, qy, dist

    With `by`, a point only looks at edges that agree with it in these columns.

    A point looks at the 3 × 3 cells around it. A hit not farther than one cell width cannot be beaten
    from outside, so it is final; the other points try again with cells twice and four times as wide, and the
    rest descends through the occupied cells (see _descend), so that no cell ever holds all segments. Points near
    a cell of more than `crowd` segments begin with cells an eighth as wide, so that they meet few of them.
    """
    by = by or []
    segs = pin_table(segments(edges, [*by, "edge_id"]))
    span = segs.agg(
        F.min(F.least("x1", "x2")), F.max(F.greatest("x1", "x2")), F.min(F.least("y1", "y2")), F.max(F.greatest("y1", "y2"))
    ).first()
    waiting = points.filter("x IS NOT NULL AND y IS NOT NULL").select(*by, "point_id", "x", "y")
    ends = waiting.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if span[0] is None or ends[0] is None:
        return _no_hits(waiting)
    widest = max(max(span[1], ends[1]) - min(span[0], ends[0]), max(span[3], ends[3]) - min(span[2], ends[2]), cell)
    return reduce(DataFrame.unionByName, _settle(waiting, segs, float(cell), widest, by, crowd))


def _settle(waiting: DataFrame, segs: DataFrame, size: float, widest: float, by: list[str], crowd: int) -> list[DataFrame]:
    """Rounds of nearest_edge from one cell width on."""
    ids = [*by, "point_id"]
    columns = ["edge_id", "seg_no", "t", "qx", "qy", "dist"]
    done = []
    full = _crowded_cells(segs, size, by, crowd)
    if size > 0.5 and not full.isEmpty():
        seen = waiting.select("*", F.inline(cells_in_reach(F.col("x"), F.col("y"), size, size)))
        near = pin(seen.join(full, [*by, *CELL], "left_semi").select(*ids, "x", "y").distinct())
        done += _settle(near, segs, size / 8, widest, by, crowd)
        waiting = waiting.join(near.select(*ids), ids, "left_anti")
    start = size
    for _ in range(3):
        best = _hits_in_reach(waiting, segs, size, by).groupBy(*ids).agg(F.min(F.struct("dist", "edge_id", "seg_no", "t", "qx", "qy")).alias("_b"))
        settled = F.coalesce(F.col("_b.dist") <= size, F.lit(False))
        found = pin(waiting.join(best, ids, "left").withColumn("_ok", settled))
        done.append(found.filter("_ok").select(*ids, "x", "y", *[F.col(f"_b.{c}").alias(c) for c in columns]))
        waiting = found.filter("NOT _ok").select(*ids, "x", "y")
        if waiting.isEmpty():
            return done
        size *= 2
    return [*done, _descend(pin(waiting), segs, start, widest, by)]


def _crowded_cells(segs: DataFrame, size: float, by: list[str], crowd: int) -> DataFrame:
    """Cells with more than `crowd` segments.

    Blocks of 8 × 8 cells are counted first, and single cells only inside blocks that hold that many, so that a task does
    not keep a count for every cell it meets.
    """
    block = {"_bx": F.shiftright("ix", 3), "_by": F.shiftright("iy", 3)}
    tiles = tile_segments(segs, size).select(*by, *CELL).withColumns(block)
    many = lambda df, keys: df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > crowd).select(*keys)
    blocks = pin(many(tiles, [*by, *block]))
    if blocks.isEmpty():
        return blocks.withColumnsRenamed({"_bx": "ix", "_by": "iy"})
    return pin(many(tiles.join(blocks, [*by, *block], "left_semi"), [*by, *CELL]))


def _hits_in_reach(waiting: DataFrame, segs: DataFrame, size: float, by: list[str]) -> DataFrame:
    """Points with the segments in the 3 × 3 cells around them, and the foot point.

    Segments whose envelope is farther than a cell width (and a bit, for rounding) cannot be final, so they are left out before hits are
    sorted for the nearest one. A segment without a beginning stays: its missing distance keeps a point from being settled.
    """
    c, reach = F.col, 1.01 * size
    apart = lambda v, a, b: (v < F.least(a, b) - reach) | (v > F.greatest(a, b) + reach)
    far = apart(c("x"), c("x1"), c("x2")) | apart(c("y"), c("y1"), c("y2"))
    seen = waiting.select("*", F.inline(cells_in_reach(c("x"), c("y"), size, size)))
    hits = seen.join(tile_segments(segs, size), [*by, *CELL]).filter(~far | c("x1").isNull() | c("y1").isNull())
    return with_foot(hits, "x", "y")


def _descend(waiting: DataFrame, segs: DataFrame, size: float, widest: float, by: list[str]) -> DataFrame:
    """nearest_edge for points far from all edges: from wide cells down to narrow ones, over occupied cells only.

    Cells of a level are pairs of the level below; a table per level lists those that hold any segment. A point begins at
    the level where four cells cover everything. An occupied cell has an edge no farther than its farthest corner, so
    the nearest of these bounds the answer, and only cells that reach within the bound are opened further. At the
    narrowest level the segments of the few cells left are measured. Points that agree with no edge in `by` get NULLs.
    """
    ids, c = [*by, "point_id"], F.col
    tiles = pin_table(tile_segments(segs, size))
    levels = max(1, math.ceil(math.log2(widest / size)) + 1)
    cells = [pin_table(tiles.select(*by, *CELL).distinct())]
    for _ in range(levels):
        cells.append(cells[-1].select(*by, F.shiftright("ix", 1).alias("ix"), F.shiftright("iy", 1).alias("iy")).distinct())
    top = cells[-1].withColumn("_all", F.lit(0))  # at most four cells for each value of `by`
    open_cells = waiting.withColumn("_all", F.lit(0)).join(top, [*by, "_all"]).drop("_all")
    for level in range(levels, -1, -1):
        wide = size * 2**level
        if level < levels:
            inner = cells[level].select(*by, c("ix").alias("_jx"), c("iy").alias("_jy"), F.shiftright("ix", 1).alias("ix"), F.shiftright("iy", 1).alias("iy"))
            open_cells = open_cells.join(inner, [*by, *CELL]).drop(*CELL).withColumnsRenamed({"_jx": "ix", "_jy": "iy"})
        out = lambda v, i: F.greatest(i * wide - v, v - (i + 1) * wide, F.lit(0.0))  # noqa: E731, B023
        far = lambda v, i: F.greatest(F.abs(i * wide - v), F.abs((i + 1) * wide - v))  # noqa: E731, B023
        nearest, farthest = F.hypot(out(c("x"), c("ix")), out(c("y"), c("iy"))), F.hypot(far(c("x"), c("ix")), far(c("y"), c("iy")))
        bound = F.min(farthest).over(W.partitionBy(*ids))
        open_cells = open_cells.withColumn("_bound", bound).filter(nearest <= c("_bound") * (1 + 1e-9) + 1e-6).drop("_bound")
        if level % 4 == 0:
            open_cells = pin(open_cells)
    hits = with_foot(open_cells.join(tiles, [*by, *CELL]), "x", "y")
    best = hits.groupBy(*ids).agg(F.min(F.struct("dist", "edge_id", "seg_no", "t", "qx", "qy")).alias("_b"))
    columns = ["edge_id", "seg_no", "t", "qx", "qy", "dist"]
    return waiting.join(best, ids, "left").select(*ids, "x", "y", *[c(f"_b.{n}").alias(n) for n in columns])


def _no_hits(points: DataFrame) -> DataFrame:
    n = F.lit(None)
    return points.select(
        "*", n.cast("long").alias("edge_id"), n.cast("int").alias("seg_no"),
        *[n.cast("double").alias(c) for c in ("t", "qx", "qy", "dist")],
    )


# ---------------------------------------------------------------- crossings


def _orient(ax, ay, bx, by, cx, cy) -> Column:
    return F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def segments_meet(a: str, b: str) -> Column:
    """Do two closed segments share a point? Envelopes overlap and each straddles the other's line."""
    c = lambda p, n: F.col(f"{p}.{n}")
    ax1, ay1, ax2, ay2 = (c(a, n) for n in ("x1", "y1", "x2", "y2"))
    bx1, by1, bx2, by2 = (c(b, n) for n in ("x1", "y1", "x2", "y2"))
    envelope = (
        (F.least(ax1, ax2) <= F.greatest(bx1, bx2)) & (F.greatest(ax1, ax2) >= F.least(bx1, bx2))
        & (F.least(ay1, ay2) <= F.greatest(by1, by2)) & (F.greatest(ay1, ay2) >= F.least(by1, by2))
    )
    return (
        envelope
        & (_orient(ax1, ay1, ax2, ay2, bx1, by1) * _orient(ax1, ay1, ax2, ay2, bx2, by2) <= 0)
        & (_orient(bx1, by1, bx2, by2, ax1, ay1) * _orient(bx1, by1, bx2, by2, ax2, ay2) <= 0)
    )


def crossing_pairs(edges: DataFrame, cell: float = 128.0, crowd: int = 200) -> DataFrame:
    """Pairs of edges (edge_a < edge_b) that meet without sharing a node.

    edges (edge_id, source, target, pts)
    """
    segs = segments(edges, ["edge_id", "source", "target"]).drop("seg_no")
    tiles = refine_crowded(tile_segments(segs, cell), cell, crowd)
    # both sides of the self join are read twice; pin, so that the tiling runs once
    tiles = pin_table(tiles)
    a, b = tiles.alias("a"), tiles.alias("b")
    keys = ["ix", "iy", "jx", "jy"]
    same_cell = reduce(lambda p, q: p & q, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys])
    shared = (
        (F.col("a.source") == F.col("b.source")) | (F.col("a.source") == F.col("b.target"))
        | (F.col("a.target") == F.col("b.source")) | (F.col("a.target") == F.col("b.target"))
    )
    return (
        a.join(b, same_cell & (F.col("a.edge_id") < F.col("b.edge_id")) & ~shared & segments_meet("a", "b"))
        .select(F.col("a.edge_id").alias("edge_a"), F.col("b.edge_id").alias("edge_b"))
        .distinct()
    )
