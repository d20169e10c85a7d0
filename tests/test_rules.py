"""Selection, speed and weight rules, projections, comparison measures: hand-made cases."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from roadweave.functions.projection import lonlat_to_utm, reproject, utm_to_lonlat
from roadweave.operators import assemble, batch, compare, weights
from roadweave.session import dense_serial

LINE = "array<struct<x:double,y:double>>"


def pts(*points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


@pytest.mark.parametrize(
    "maxspeed,highway,kind,zone,want",
    [
        ("none", "motorway", None, None, "130"), (None, "motorway_link", None, None, "55"), ("none", "trunk", None, None, "130"),
        (None, "trunk", None, None, "100"), ("walk", "service", None, None, "7"), (None, "living_street", None, None, "7"),
        (None, "unclassified", "DE:zone30", None, "50"), (None, "living_street", "DE:zone30", None, "30"),
        (None, "living_street", "DE:zone20", None, "20"), (None, "residential", None, "DE:rural", "100"),
        (None, "service", "DE:urban", None, "50"), (None, "tertiary_link", None, None, "40"), ("50 mph", "primary", None, None, "50 mph"),
        (None, "construction", None, None, None),
    ],
)
def test_community_speed(spark, maxspeed, highway, kind, zone, want):
    df = spark.createDataFrame([(maxspeed, highway, kind, zone)], "maxspeed string, highway string, maxspeed_type string, zone_traffic string")
    assert weights.set_speed_community(df).first().maxspeed == want


def test_weights_round_half_up_and_close_directions(spark):
    rows = [("100.1250", "30", "no", "primary"), ("0.0010", "130", None, "primary"), ("36", "36", "-1", "primary"), ("36", "36", "true", "primary"), ("36", "36", None, "construction")]
    df = spark.createDataFrame(rows, "d string, maxspeed string, oneway string, highway string").withColumn("distance", F.col("d").cast("decimal(9,4)"))
    got = [(float(r.weights_car), float(r.weights_car_reverse)) for r in weights.set_weights(df, weights.community_profile()).collect()]
    assert got == [(12.02, 12.02), (0.0, 0.0), (-1, 3.6), (3.6, -1), (-1, -1)]


def test_bad_speed_text(spark):
    df = spark.createDataFrame([("50 mph",), ("0",)], "maxspeed string").withColumns({"distance": F.lit(10).cast("decimal(9,4)"), "oneway": F.lit(None).cast("string"), "highway": F.lit("service")})
    for text in ("50 mph", "0"):
        with pytest.raises(Exception):
            weights.set_weights(df.filter(F.col("maxspeed") == text), weights.community_profile()).collect()
    assert [r.weights_car for r in weights.set_weights(df, weights.community_profile(), lenient=True).collect()] == [None, None]


def test_authority_rules(spark):
    df = spark.createDataFrame([(1301, True, None), (1303, False, None), (9999, None, 2100), (1, None, None), (None, None, None)], "widmung int, fahrtrichtung boolean, zustand int").withColumn("distance", F.lit(100).cast("decimal(9,4)"))
    got = [(r.maxspeed, r.weights_car, r.weights_car_reverse) for r in weights.set_weights(weights.set_speed_authority(df), weights.authority_profile()).collect()]
    assert [(s, w is None or float(w), b is None or float(b)) for s, w, b in got] == [(130, 2.77, -1), (100, -1, 3.6), (30, -1, -1), (None, True, True), (None, True, True)]


@pytest.mark.parametrize("right,want", [(["a"], ["b"]), (["a", None], []), ([], ["a", "b", None]), (["z"], ["a", "b"])])
def test_not_in_follows_sql(spark, right, want):
    left = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    other = spark.createDataFrame([(v,) for v in right], "o string")
    assert sorted(map(str, (r.k for r in assemble.not_in_column(left, "k", other, "o").collect()))) == sorted(map(str, want))


def test_assembly(spark):
    axis = f"gml_id string, istTeilVon string, advstandardmodell array<string>, funktion int, pts {LINE}"
    p = pts((0, 0), (1, 1))
    axes = spark.createDataFrame([("A1", "s1", ["Basis-DLM"], None, p), ("A2", "s2", ["Basis-DLM", "Basis-DLM"], 5, p), ("A3", "s3", ["Basis-DLM"], 1808, p), ("A4", "s4", ["DLM50"], None, p), ("A5", "s5", ["Basis-DLM"], None, p)], axis)
    ways = spark.createDataFrame([("F1", "s1", ["Basis-DLM"], None, p)], axis)
    streets = spark.createDataFrame([("s1", 1301, "X"), ("s2", None, "Y"), ("s5", 9997, "Z")], "gml_id string, widmung int, name string")
    got = assemble.assemble_authority(axes, ways, streets).orderBy("edge_id").collect()
    assert [(r.edge_id, r.gml_id, r.widmung, r.name) for r in got] == [(1, "A2", None, "Y"), (2, "A2", None, "Y"), (3, "F1", 1301, "X")]
    missing = assemble.table_or_empty(spark, "no_such_table", {"gml_id": "string", "istTeilVon": "string", "advstandardmodell": "array<string>", "funktion": "int", "pts": LINE})
    assert assemble.assemble_authority(axes, missing, streets).count() == 3


def test_patch_last_entry_wins(spark):
    edges = spark.createDataFrame([(1,), (2,), (3,)], "edge_id long")
    patch = spark.createDataFrame([(1, 1, True), (2, 1, False), (3, 2, True)], "seq long, edge_id long, fahrtrichtung boolean")
    assert {r.edge_id: r.fahrtrichtung for r in assemble.patch_oneway(edges, patch).collect()} == {1: False, 2: True, 3: None}


def test_projections(spark):
    # reference point: 9° E lies on the central meridian; the other values are textbook UTM coordinates
    df = spark.createDataFrame([(9.0, 0.0), (8.1, 53.5), (11.9, 47.2)], "x double, y double").withColumn("p", F.struct("x", "y"))
    got = df.select("x", "y", lonlat_to_utm(F.col("p")).alias("u")).withColumn("b", utm_to_lonlat(F.col("u"))).collect()
    assert got[0].u.x == 500000 and got[0].u.y == 0
    for r in got:
        assert math.dist((r.x, r.y), (r.b.x, r.b.y)) < 1e-9  # there and back, far below a millimetre
    lines = spark.createDataFrame([(1, pts((8.1, 53.5)), 4326), (2, pts((8.1 * math.pi / 180 * 6378137, math.log(math.tan(math.pi / 4 + math.radians(53.5) / 2)) * 6378137)), 3857), (3, pts((1, 2)), 25832), (4, pts((1, 2)), 31467)], f"id int, pts {LINE}, srid int")
    out = {r.id: (r.pts[0].x, r.pts[0].y, r.srid) for r in reproject(lines).collect()}
    assert math.dist(out[1][:2], out[2][:2]) < 1e-3 and out[1][2] == out[2][2] == 25832
    assert out[3] == (1, 2, 25832) and out[4] == (1, 2, 31467)
    with pytest.raises(ValueError):
        reproject(lines, 31467)


def measure(spark, f, a, b):
    frame = lambda p: spark.createDataFrame([(1, pts(*p))], f"route_id long, pts {LINE}")
    return float(f(frame(a), frame(b)).first()[1])


@pytest.mark.parametrize(
    "a,b,share",
    [
        ([(0, 0), (100, 0)], [(0, 0), (100, 0)], 100), ([(0, 0), (100, 0)], [(0, 3), (100, 3)], 100), ([(0, 0), (100, 0)], [(0, 7), (100, 7)], 0),
        ([(0, 0), (100, 0)], [(50, -50), (50, 50)], 10), ([(0, 0), (100, 0)], [(0, 0), (50, 0)], 55), ([(0, 0), (1000, 0)], [(0, 1), (400, 1), (400, 900)], 40.5),
    ],
)
def test_overlap(spark, a, b, share):
    assert abs(measure(spark, lambda x, y: compare.overlap_share(x, y, 5.0), a, b) - share) < 0.02


def test_similarity(spark):
    line, back = [(0, 0), (100, 0)], [(100, 0), (0, 0)]
    assert measure(spark, compare.hausdorff, line, back) == 0 and measure(spark, compare.frechet, line, back) == 100
    a, b = [(0, 0), (50, 40), (100, 0)], [(0, 5), (100, 5)]
    assert measure(spark, compare.hausdorff, a, b) == measure(spark, compare.hausdorff, b, a) == 35
    assert measure(spark, compare.frechet, a, b) >= 35
    with pytest.raises(ValueError):
        measure(spark, lambda x, y: compare.overlap_share(x, y, 0), a, b)


def test_route_lines_and_comparison(spark):
    schema = f"pair_id long, seq int, edge_id long, backward boolean, cost decimal(12,2), penalty decimal(8,2), distance decimal(9,4), weights_car decimal(8,2), hook_length decimal(9,4), od_point_id long, pts {LINE}"
    dec = lambda *v: [str(x) for x in v]

    def steps(rows):
        raw = spark.createDataFrame(rows, schema.replace("decimal(12,2)", "string").replace("decimal(8,2)", "string").replace("decimal(9,4)", "string"))
        return raw.selectExpr(*[f"cast({c.split(' ')[0]} as {c.split(' ')[1]}) {c.split(' ')[0]}" for c in schema.split(f", pts")[0].replace("(12,2)", "(12;2)").replace("(8,2)", "(8;2)").replace("(9,4)", "(9;4)").replace(", ", "|").replace(";", ",").split("|")], "pts")

    a = steps([(1, 1, 5, False, *dec(3, 0, 30, 3), "1.5", 11, pts((0, 0), (30, 0))), (1, 2, 6, True, *dec(4, 0, 40, -1), None, None, pts((70, 0), (30, 0))), (1, 3, -1, None, *dec(0, 0), None, None, "2", 12, None), (2, 1, -1, None, *dec(0, 0), None, None, "2", 12, None)])
    b = steps([(1, 1, 7, False, *dec(16, 10, 70, 6), "1", 11, pts((0, 0), (70, 0))), (1, 2, -1, None, *dec(0, 0), None, None, "1", 12, None)])
    assert [(p.x, p.y) for p in compare.route_lines(a).filter("route_id = 1").first().pts] == [(0, 0), (30, 0), (70, 0)]
    got = {r.route_id: r for r in compare.compare_routes(a, b, 5.0).collect()}
    r = got[1]
    assert sorted(got) == [0, 1]  # route 2 exists in one network only
    assert (float(r.authority_driving_time), float(r.authority_driving_time_forward), float(r.community_driving_time)) == (7, 2, 6)
    assert (float(r.distance_diff), float(r.driving_time_diff), float(r.hook_length_diff), float(r.buffer)) == (0, 1, 1.5, 100)
    assert (r.start_point_id, r.dest_point_id, float(r.hausdorff_distance), float(r.frechet_distance)) == (11, 12, 0, 30)
    assert float(got[0].driving_time_diff) == 1 and got[0].authority_distance is None


def test_sampling_and_pairing(spark, monkeypatch):
    homes = spark.range(5).selectExpr("id", "double(id) x", "0.0D y")
    first, again = (sorted(map(tuple, batch.sample_points(homes, 3, "s").collect())) for _ in range(2))
    assert first == again and len({r[1] for r in first}) == 3 and [r[0] for r in first] == [1, 2, 3]
    with pytest.raises(ValueError):
        batch.sample_points(homes, 6)
    many = spark.range(3000).selectExpr("id % 2500 AS id", "double(id) x", "0.0D y")  # repeated ids share a draw
    for prefix, n in ((0, 7), (1, 0), (1, 700), (2, 3000), (4, 41)):
        monkeypatch.setattr(batch, "PREFIX", prefix)
        want = sorted((hashlib.md5(f"s:{i % 2500}".encode()).hexdigest(), i % 2500) for i in range(3000))[:n]
        assert [r.address_id for r in batch.sample_points(many, n, "s").orderBy("id").collect()] == [i for _, i in want]
    assert batch.sample_points(homes.limit(0), 0).count() == 0
    with pytest.raises(ValueError, match="already holds rows"):
        batch.sample_points(homes, 3, stored=homes)
    assert batch.sample_points(homes, 3, "s", homes.limit(0)).count() == 3
    assert [tuple(r) for r in batch.pair_points(homes).orderBy("pair_id").collect()] == [(1, 0, 1), (2, 2, 3)]
    with pytest.raises(ValueError):
        batch.require_ids(spark.createDataFrame([(9,)], "start_id long"), homes, "start_id")
    assert batch.next_id([homes, homes.filter("id < 0")], "id").first()[0] == 5


def test_hooks_on_one_step_routes(spark):
    steps = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "pair_id long, seq int")
    pairs = spark.createDataFrame([(1, 10, 20, 0.5, 0.75), (2, 30, 40, 1.0, 2.0)], "pair_id long, start_id long, dest_id long, start_hook double, dest_hook double")
    got = {(r.pair_id, r.seq): (r.hook_length, r.od_point_id) for r in batch.attach_hooks(steps, pairs).collect()}
    assert got == {(1, 1): (0.5, 10), (1, 2): (0.75, 20), (2, 1): (2.0, 40)}


def test_serial_is_dense_over_many_partitions(spark):
    df = spark.range(0, 1000, 1, 7).selectExpr("(id * 37) % 1000 AS k")
    assert [r.n for r in dense_serial(df, ["k"], "n", 0).orderBy("k").collect()] == list(range(1000))


def _wave(n, phase, step=40.0, x0=0.0):
    return [(x0 + i * step, 300 * math.sin(i / 7 + phase)) for i in range(n)]


def test_measures_of_long_lines(spark):
    """Lines far longer than one study area, against plain loops."""
    a, b = _wave(260, 0.0), _wave(210, 0.4, 50.0, 10.0)
    far = [(x * 15, y) for x, y in a]  # some 150 km
    seg = lambda p, q1, q2: math.dist(p, _foot(p, q1, q2))
    one_way = lambda p, q: max(min(seg(v, *s) for s in zip(q, q[1:])) for v in p)
    assert abs(measure(spark, compare.hausdorff, a, b) - max(one_way(a, b), one_way(b, a))) < 1e-3
    table = {}
    for i, p in enumerate(a):
        for j, q in enumerate(b):
            before = [table[k] for k in ((i - 1, j), (i, j - 1), (i - 1, j - 1)) if k in table]
            table[i, j] = max(math.dist(p, q), min(before) if before else 0)
    assert abs(measure(spark, compare.frechet, a, b) - table[len(a) - 1, len(b) - 1]) < 1e-3
    for x, y in ((a, b), (far, far[::2]), (far, far)):
        got = measure(spark, lambda p, q: compare.overlap_share(p, q, 5.0), x, y)
        inside = total = 0.0
        for p, q in zip(x, x[1:]):
            n = 400
            near = [s for s in zip(y, y[1:]) if min(s[0][0], s[1][0]) - 5 <= max(p[0], q[0]) and max(s[0][0], s[1][0]) + 5 >= min(p[0], q[0])]
            hits = sum(any(seg(m, *s) <= 5 for s in near) for m in ((p[0] + (q[0] - p[0]) * (k + 0.5) / n, p[1] + (q[1] - p[1]) * (k + 0.5) / n) for k in range(n)))
            inside, total = inside + math.dist(p, q) * hits / n, total + math.dist(p, q)
        assert abs(got - 100 * inside / total) < 0.1, (got, 100 * inside / total)


def _foot(p, a, b):
    d = ((b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2) or 1.0
    t = max(0.0, min(1.0, ((p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1])) / d))
    return a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])


def test_many_arcs_do_not_spill_into_the_time(spark):
    from roadweave.operators import paths

    arcs = spark.range(140_000)
    free = arcs.select(paths.weight_of(F.lit("0.00").cast("decimal(8,2)"), F.col("id")).alias("w"))
    assert free.agg(paths.seconds_of(F.sum("w")).alias("s")).first().s == 0
    paid = arcs.select(paths.weight_of(F.lit("0.01").cast("decimal(8,2)"), F.col("id")).alias("w"))
    assert paid.agg(paths.seconds_of(F.sum("w")).alias("s")).first().s == 1400
    seed = spark.createDataFrame([(1, 1, 0)], "source long, node long, key long")
    steep = spark.createDataFrame([(1, 2, (1 << 35) + 5, 0)], "from_node long, to_node long, w long, arc long")
    with pytest.raises(OverflowError):
        paths.relax(seed, steep)


def test_equal_ways_take_the_lowest_arc(spark):
    from roadweave.operators import paths

    seed = spark.createDataFrame([(1, 1, 0)], "source long, node long, key long")
    rows = [(1, 2, 10, 9), (1, 3, 10, 8), (2, 4, 5, 7), (3, 4, 5, 6), (4, 5, 1, 5), (1, 5, 16, 99)]
    for order in (rows, rows[::-1]):
        arcs = spark.createDataFrame(order, "from_node long, to_node long, w long, arc long").repartition(3)
        got = {r.node: r.arc for r in paths.relax(seed, arcs).collect()}
        assert got == {1: None, 2: 9, 3: 8, 4: 6, 5: 5}
