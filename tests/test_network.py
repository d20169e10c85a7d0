"""Snapping, splitting, topology and clipping against one-by-one replays and hand-made cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from roadweave.functions.geometry import line_length
from roadweave.operators import clip, snap, spatial, topology, weights

LINE = "array<struct<x:double,y:double>>"


def lines(spark, rows, extra=""):
    """rows (edge_id, [(x, y), …], *extra)"""
    data = [(r[0], [{"x": float(x), "y": float(y)} for x, y in r[1]], *r[2:]) for r in rows]
    return spark.createDataFrame(data, f"edge_id long, pts {LINE}" + (f", {extra}" if extra else ""))


def foot(p, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    n = dx * dx + dy * dy
    t = 0.0 if n == 0 else max(0.0, min(1.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / n))
    q = a if t == 0 else b if t == 1 else (a[0] + t * dx, a[1] + t * dy)
    return q, t, math.dist(p, q)


def replay(points, edges, nodes, radius=0.25):
    """One point after the other: reuse the nearest node within the radius of the foot point, else make one."""
    known, out = [(xy, n) for n, xy in nodes.items()], {}
    for pid, p in sorted(points.items()):
        best = min((foot(p, a, b)[2], e, k, foot(p, a, b)[0]) for e, pts in edges.items() for k, (a, b) in enumerate(zip(pts, pts[1:])))
        q = best[3]
        near = [(math.dist(q, xy), n) for xy, n in known if math.dist(q, xy) <= radius]
        if near:
            out[pid] = min(near)[1]
        else:
            out[pid] = ("new", pid)
            known.append((q, ("new", pid)))
    return out


def test_snapping_equals_the_replay(spark):
    rnd = random.Random(3)
    edges = {e: [(0.0, 3.0 * e), (10.0, 3.0 * e + 1), (20.0, 3.0 * e)] for e in range(5)}
    points = {k: (rnd.uniform(-1, 21), rnd.uniform(-1, 14)) for k in range(60)}
    points |= {100 + k: (5.0 + 0.06 * k, 1.3) for k in range(25)}  # a crowd on one edge
    points |= {200 + k: points[k] for k in range(5)}  # the same address again
    frame = lines(spark, [(e, p, "a") for e, p in edges.items()], "name string").withColumn("maxspeed", F.lit(36))
    frame = frame.withColumns({w: F.lit(v).cast("decimal(8,2)") for w, v in (("weights_car", 2.0), ("weights_car_reverse", -1))})
    net, nodes = topology.build_topology(weights.set_length(frame))
    node_xy = {r.node_id: (r.x, r.y) for r in nodes.collect()}
    assert len(node_xy) == 10 and max(node_xy) == 9
    got = snap.snap_points(spark.createDataFrame([(k, *p) for k, p in points.items()], "point_id long, x double, y double"), net, nodes)
    want = replay(points, edges, node_xy)
    mine = {r.point_id: r.node_id for r in got.points.collect()}
    assert mine == {k: (n if isinstance(n, int) else 10 + n[1]) for k, n in want.items()}

    parts = got.edges.collect()
    made = {n for n in mine.values() if n > 9}
    assert len(parts) == 5 + len(made)
    for e, pts in edges.items():
        mine_e = sorted((r for r in parts if r.orig_edge_id == e), key=lambda r: r.part_no)
        whole = sum(math.dist(a, b) for a, b in zip(pts, pts[1:]))
        assert abs(sum(math.dist((p.x, p.y), (q.x, q.y)) for r in mine_e for p, q in zip(r.pts, r.pts[1:])) - whole) < 1e-9
        assert mine_e[0].edge_id == e and mine_e[0].source == 2 * e and mine_e[-1].target == 2 * e + 1
        for a, b in zip(mine_e, mine_e[1:]):
            assert a.target == b.source and a.pts[-1] == b.pts[0] and b.edge_id > 4
        assert all(r.weights_car_reverse == -1 and r.name == "a" for r in mine_e)
        if len(mine_e) > 1:
            assert all(abs(float(r.weights_car) - float(r.distance) * 0.1) < 0.0051 for r in mine_e)
    assert got.nodes.count() == 10 + len(made)
    assert got.nodes.filter("cnt = 0").count() == 0


def test_split_keeps_closed_directions(spark):
    cases = [(k, [(0, 9 * k), (100, 9 * k)], a, b) for k, (a, b) in enumerate([(12, 12), (-1, -1), (-1, 12), (12, -1)])]
    edges = lines(spark, cases, "a int, b int").selectExpr(
        "edge_id", "pts", "cast(a as decimal(8,2)) weights_car", "cast(b as decimal(8,2)) weights_car_reverse", "30 maxspeed",
        "cast(100 as decimal(9,4)) distance", "edge_id * 2 source", "edge_id * 2 + 1 target",
    )
    cuts = spark.createDataFrame([(k, 50 + k, k, 1, 0.25, 25.0, 9.0 * k) for k in range(4)], "point_id long, node_id long, edge_id long, seg_no int, t double, qx double, qy double")
    got = {(r.orig_edge_id, r.part_no): (float(r.weights_car), float(r.weights_car_reverse)) for r in snap.split_edges(edges, cuts).collect()}
    assert got == {
        (0, 1): (3, 3), (0, 2): (9, 9), (1, 1): (-1, -1), (1, 2): (-1, -1),
        (2, 1): (-1, 3), (2, 2): (-1, 9), (3, 1): (3, -1), (3, 2): (9, -1),
    }


def test_restrictions_follow_split_edges(spark):
    rows = [(1, 10, 11, 1, 1), (2, 11, 12, 2, 1), (3, 10, 20, 3, 1), (90, 20, 11, 3, 2)]
    edges = spark.createDataFrame(rows, "edge_id long, source long, target long, orig_edge_id long, part_no int")
    bans = spark.createDataFrame([(1.0, 2, 3, None), (1.0, 3, 3, None), (1.0, 2, 1, None), (1.0, 2, 1, None)], "restriction_cost double, to_edge_id long, from_edge_id long, via_path string")
    got = sorted((r.from_edge_id, r.to_edge_id) for r in snap.remap_restrictions(bans, edges).collect())
    # 3 → 2 leaves by the second part, the U-turn ban holds at both ends, copies count once
    assert got == [(1, 2), (3, 3), (90, 2), (90, 90)]


def test_via_paths_follow_split_edges(spark):
    rows = [  # edge, source, target, orig, part
        (1, 10, 11, 1, 1), (91, 11, 12, 1, 2), (2, 12, 13, 2, 1), (92, 13, 14, 2, 2), (3, 14, 15, 3, 1), (4, 15, 16, 4, 1),
        (5, 14, 17, 5, 1), (93, 17, 12, 5, 2), (6, 14, 18, 6, 1), (94, 18, 15, 6, 2), (7, 19, 20, 7, 1), (95, 20, 15, 7, 2),
    ]
    edges = spark.createDataFrame(rows, "edge_id long, source long, target long, orig_edge_id long, part_no int")
    bans = spark.createDataFrame(
        [(1.0, 4, 3, "2,1"), (2.0, 4, 3, "5"), (3.0, 4, 6, "2"), (4.0, 7, 3, "2"), (5.0, 4, 3, "77"), (6.0, 4, 3, None), (7.0, 4, 6, "")],
        "restriction_cost double, to_edge_id long, from_edge_id long, via_path string",
    )
    got = {(int(r.restriction_cost), r.to_edge_id, r.from_edge_id, r.via_path) for r in snap.remap_restrictions(bans, edges).collect()}
    assert got == {
        (1, 4, 3, "92,2,91,1"),  # every part, nearest first
        (2, 4, 3, "5,93"),  # driven backward
        (3, 4, 94, "6,92,2"),  # the edge before the turn is driven whole
        (4, 95, 3, "92,2"),  # into the part at the shared node
        (5, 4, 3, "77"),  # not in the network
        (6, 4, 3, None), (7, 4, 94, ""),
    }


@pytest.mark.parametrize("radius", [1.0, 0.3])
def test_merging_equals_the_one_by_one_rule(spark, radius):
    rnd = random.Random(11)
    pts = [(k, round(rnd.uniform(0, 12), 2), round(rnd.uniform(0, 3), 2)) for k in range(250)]
    pts += [(300 + k, pts[k][1], pts[k][2]) for k in range(10)]
    made, want = [], {}
    for pid, x, y in sorted(pts):
        near = [(math.dist((x, y), xy), n) for n, xy in made if math.dist((x, y), xy) <= radius]
        if near:
            want[(x, y)] = want.get((x, y), min(near)[1])
        else:
            want[(x, y)] = pid
            made.append((pid, (x, y)))
    got = spatial.merge_points(spark.createDataFrame(pts, "pid long, x double, y double"), radius).collect()
    assert {(r.x, r.y): r.node_id for r in got} == want


def test_long_chains_merge_in_few_rounds(spark, monkeypatch):
    """Ten thousand points 0.9 radius apart: nodes keep their distance, every point has one in reach, named by its lowest point."""
    rounds = []
    pin = spatial.pin
    monkeypatch.setattr(spatial, "pin", lambda df: rounds.append(1) or pin(df))
    chain = spark.range(10_000).selectExpr("id AS pid", "id * 0.9D AS x", "0D AS y")
    got = spatial.merge_points(chain, 1.0, by_id=False).collect()
    assert len(rounds) <= 2 * 20 + 2  # two for each round, two for all
    assert len(got) == 10_000 and all(abs(r.x - r.node_x) <= 1 for r in got)
    nodes = {r.node_id: r.node_x for r in got}
    places = sorted(nodes.values())
    assert all(b - a > 1 for a, b in zip(places, places[1:]))
    lowest = {}
    for r in got:
        pid = round(r.x / 0.9)
        lowest[r.node_id] = min(pid, lowest.get(r.node_id, pid))
    assert all(k == v for k, v in lowest.items())


def test_topology_tolerance_and_missing_lines(spark):
    rows = [(1, [(0, 0), (10, 0)]), (2, [(10.000004, 0), (20, 0)]), (3, [(10.1, 0), (10.1, 9)])]
    edges = lines(spark, rows).unionByName(spark.createDataFrame([(4, None)], f"edge_id long, pts {LINE}"))
    net, nodes = topology.build_topology(edges)
    ends = {r.edge_id: (r.source, r.target) for r in net.collect()}
    assert ends == {1: (2, 3), 2: (3, 5), 3: (6, 7), 4: (None, None)}
    assert nodes.count() == 5
    report = {r.check: r.n for r in topology.check_topology(net, nodes, 0.2).collect()}
    assert report["null_rows"] == 1 and report["isolated"] == 1 and report["dead_ends"] == 4 and report["gaps"] == 1


@pytest.mark.parametrize("crowd", [2000, 4])
def test_nearest_edge_equals_brute_force(spark, crowd):
    rnd = random.Random(5)
    edges = {e: [(rnd.uniform(0, 900), rnd.uniform(0, 900)) for _ in range(rnd.choice([2, 3]))] for e in range(60)}
    points = {k: (rnd.uniform(-3000, 4000), rnd.uniform(0, 900)) for k in range(80)}
    got = spatial.nearest_edge(
        spark.createDataFrame([(k, *p) for k, p in points.items()], "point_id long, x double, y double"),
        lines(spark, list(edges.items())), cell=20.0, crowd=crowd,
    ).collect()
    assert len(got) == 80
    for r in got:
        want = min((foot(points[r.point_id], a, b)[2], e) for e, pts in edges.items() for a, b in zip(pts, pts[1:]))
        assert r.edge_id == want[1] and abs(r.dist - want[0]) < 1e-9


def test_nearest_edge_of_far_points(spark, monkeypatch):
    """Points up to 1,000 km away meet few segments, and none of all."""
    rnd = random.Random(5)
    edges = {k: [(x := rnd.uniform(-9000, 9000), y := rnd.uniform(-9000, 9000)), (x + rnd.uniform(-90, 90), y + rnd.uniform(-90, 90))] for k in range(4000)}
    points = {1: (1e6, 3.0), 2: (-2e5, -7e5), 3: (20000, 20000), 4: (0.0, 1e6), 5: (9400.0, -9300.0), 6: edges[7][0], 7: (-9000.0, 12000.0)}
    looked = []
    plain = spatial.with_foot
    monkeypatch.setattr(spatial, "with_foot", lambda df, *a: looked.append(df.count()) or plain(df, *a))
    got = spatial.nearest_edge(
        spark.createDataFrame([(k, *map(float, p)) for k, p in points.items()], "point_id long, x double, y double"), lines(spark, edges.items())
    ).collect()
    assert len(got) == len(points)
    for r in got:
        d, e = min((foot(points[r.point_id], *edges[k])[2], k) for k in edges)
        assert r.edge_id == e and abs(r.dist - d) < 1e-6 * max(1, d)
    assert looked[-1] < 400, looked


def test_hits_that_cannot_be_final_are_not_sorted(spark):
    """All segments within a cell width of a point go on, and none whose envelope is farther; a missing distance stays."""
    rnd = random.Random(6)
    edges = {e: [(rnd.uniform(0, 300), rnd.uniform(0, 300)) for _ in range(2)] for e in range(60)}
    points = {k: (rnd.uniform(0, 300), rnd.uniform(0, 300)) for k in range(40)}
    segs = spatial.segments(lines(spark, list(edges.items())), ["edge_id"])
    torn = spark.createDataFrame([(99, 1, 5.0, None, 6.0, 7.0)], segs.schema)
    frame = spark.createDataFrame([(k, *p) for k, p in points.items()] + [(50, 4.0, 4.0)], "point_id long, x double, y double")
    got = {(r.point_id, r.edge_id): r.dist for r in spatial._hits_in_reach(frame, segs.unionByName(torn), 20.0, []).collect()}
    assert got.pop((50, 99), 0) is None
    dist = {(k, e): foot(p, *pts)[2] for k, p in points.items() for e, pts in edges.items()}
    gap = lambda v, a, b: max(min(a, b) - v, v - max(a, b), 0)
    apart = lambda p, a, b: max(gap(p[0], a[0], b[0]), gap(p[1], a[1], b[1]))
    kept = {pair: d for pair, d in got.items() if pair in dist}
    assert kept.keys() >= {pair for pair, d in dist.items() if d <= 20}
    assert all(apart(points[k], *edges[e]) <= 20.2 and abs(d - dist[k, e]) < 1e-9 for (k, e), d in kept.items())


@pytest.mark.parametrize("crowd", [0, 3, 12, 1000])
def test_crowded_cells_by_blocks_equal_a_count_of_all(spark, crowd):
    rnd = random.Random(7)
    rows = [(k % 2, k, 1, *[rnd.gauss(0, 60) for _ in range(4)]) for k in range(300)]
    segs = spark.createDataFrame(rows, "kind long, edge_id long, seg_no int, x1 double, y1 double, x2 double, y2 double")
    counts = spatial.tile_segments(segs, 8.0).groupBy("kind", "ix", "iy").count().collect()
    want = sorted((r.kind, r.ix, r.iy) for r in counts if r["count"] > crowd)
    got = spatial._crowded_cells(segs, 8.0, ["kind"], crowd)
    assert got.columns == ["kind", "ix", "iy"] and sorted(map(tuple, got.collect())) == want
    assert (crowd == 1000) == (not want)


def test_nearest_edge_of_nothing(spark):
    none = spark.createDataFrame([], f"edge_id long, pts {LINE}")
    got = spatial.nearest_edge(spark.createDataFrame([(1, 0.0, 0.0)], "point_id long, x double, y double"), none).collect()
    assert len(got) == 1 and got[0].edge_id is None


def test_node_reuse_radius_includes_its_border(spark):
    nodes = spark.createDataFrame([(7, 0.0, 0.0), (8, 10.0, 0.0)], "node_id long, x double, y double")
    pts = spark.createDataFrame([(1, 0.25, 0.0), (2, 0.26, 0.0), (3, 9.9, 0.0)], "point_id long, x double, y double")
    assert {r.point_id: r.node_id for r in spatial.nearest_node(pts, nodes, 0.25).collect()} == {1: 7, 3: 8}


def test_crossings_in_a_crowded_cell_equal_brute_force(spark):
    rnd = random.Random(9)
    segs = []
    for e in range(120):
        x, y = rnd.uniform(0, 40), rnd.uniform(0, 40)
        segs.append((e, [(x, y), (x + rnd.uniform(-9, 9), y + rnd.uniform(-9, 9))]))
    edges = lines(spark, segs).withColumns({"source": F.col("edge_id") * 2, "target": F.col("edge_id") * 2 + 1})

    def side(a, b, c):
        v = (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
        return (v > 0) - (v < 0)

    want = {
        (e, f) for e, (a, b) in segs for f, (c, d) in segs
        if e < f and side(a, b, c) * side(a, b, d) <= 0 and side(c, d, a) * side(c, d, b) <= 0
    }
    got = {(r.edge_a, r.edge_b) for r in spatial.crossing_pairs(edges, cell=64.0, crowd=10).collect()}
    assert got == want and len(want) > 50


BOXES = [("inner_bbox", 0.0, 0.0, 10.0, 10.0)]


def parts_of(spark, pts):
    boxes = spark.createDataFrame(BOXES, "purpose string, xmin double, ymin double, xmax double, ymax double")
    return boxes, [[(p.x, p.y) for p in r.pts] for r in clip.clip(lines(spark, [(1, pts)]), boxes).orderBy("part_no").collect()]


@pytest.mark.parametrize(
    "pts,want",
    [
        ([(1, 1), (9, 9)], [[(1, 1), (9, 9)]]),
        ([(5, 5), (15, 5), (15, 8), (5, 8)], [[(5, 5), (10, 5)], [(10, 8), (5, 8)]]),  # leaves and comes back
        ([(8, 14), (14, 8)], []),  # envelope meets the box, the line does not
        ([(-5, 10), (15, 10)], [[(0, 10), (10, 10)]]),  # along the border
        ([(-5, 5), (5, 15)], []),  # touches a corner only
        ([(20, 20), (30, 30)], []),
        ([(-2, 5), (2, 5), (4, 7), (12, 7)], [[(0, 5), (2, 5), (4, 7), (10, 7)]]),
    ],
)
def test_clip(spark, pts, want):
    boxes, got = parts_of(spark, pts)
    assert got == want
    for part in got:
        assert parts_of(spark, part)[1] == [part]  # once is enough


def test_boxes(spark):
    a, b = lines(spark, [(1, [(0, 0), (9000, 9000)])]), lines(spark, [(1, [(1000, -50), (12000, 8000)])])
    common = {r.purpose: tuple(r)[1:] for r in clip.study_boxes(a, b).collect()}
    assert common == {
        "outer_bbox": (1000, 0, 9000, 8000), "inner_bbox": (2500, 1500, 7500, 6500), "address_bbox": (3500, 2500, 6500, 5500)
    }
    given = {r.purpose: tuple(r)[1:] for r in clip.study_boxes(a, b, (0, 100, 2500, 90000)).collect()}
    assert given["inner_bbox"] == (1000, 100, 2500, 8000)
    assert given["address_bbox"] == (None, None, None, None)  # nothing is left 1 km inside
    away = lines(spark, [(1, [(50000, 50000), (50001, 50001)])])
    assert {tuple(r)[1:] for r in clip.study_boxes(a, away).collect()} == {(None,) * 4}


def test_line_length(spark):
    df = lines(spark, [(1, [(0, 0), (3, 4), (3, 10)]), (2, [(5, 5)])])
    assert [r[0] for r in df.orderBy("edge_id").select(line_length(F.col("pts"))).collect()] == [11.0, 0.0]


def test_places_alone_are_moved_once(spark):
    """Places on round coordinates go to one cell each, and near ones are told from those that are alone."""
    from roadweave.operators import spatial

    rows = [(10 * i, 430000.0 + 100 * i, 5930000.0) for i in range(50)]
    near = [(1, 430000.00001, 5930000.0), (2, 430100.0, 5929999.999995), (3, 430300.000003, 5930000.000004)]
    places = spark.createDataFrame(rows + near, "rid long, x double, y double")
    got = {r.rid for r in spatial._crowded(places, 0.00001).collect()}
    assert got == {0, 1, 10, 2, 30, 3}
