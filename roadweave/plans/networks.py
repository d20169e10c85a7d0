"""Road networks derived from the star tables by integer arithmetic, for queries, tests and the bench.

Every order is one edge of a jittered 100 m grid with 100 columns, every customer one street and one
address. Whole tables are used, so the networks grow with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave.operators.assemble import CAR_CLASSES, assemble_authority, filter_car_roads, join_segments
from roadweave.operators.weights import (
    authority_profile, community_profile, set_length, set_speed_authority, set_speed_community, set_weights,
)
from roadweave.session import pin_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(number: str, values: dict[int, str]) -> Column:
    c = F.lit(None).cast("string")
    for n, v in values.items():
        c = F.when(F.expr(number) == n, F.lit(v)).otherwise(c)
    return c


def _grid(c: str, r: str, dx: int = 0, dy: int = 0) -> str:
    """SQL text of a jittered grid point."""
    return (
        f"named_struct('x', double(430000 + 100*({c}) + (37*({c}) + 91*({r})) % 21 - 10 + {dx}), "
        f"'y', double(5930000 + 100*({r}) + (53*({c}) + 29*({r})) % 21 - 10 + {dy}))"
    )


def _cells(orders: DataFrame) -> DataFrame:
    return orders.selectExpr("*", "o_orderkey AS i", "(o_orderkey div 2) % 100 AS c1", "o_orderkey div 200 AS r1").selectExpr(
        "*", "c1 + (1 - i % 2) AS c2", "r1 + i % 2 AS r2"
    )


def community_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways with tags, before selection; four rows share one osm_id."""
    classes = [*CAR_CLASSES, "track", "footway"]
    d = _cells(table(spark, sf_dir, "orders"))
    return d.select(
        F.col("i").alias("edge_id"),
        F.expr("i div 4").alias("osm_id"),
        F.expr(f"array({_grid('c1', 'r1')}, {_grid('c2', 'r2')})").alias("pts"),
        F.element_at(F.array(*[F.lit(c) for c in classes]), F.expr("int(o_custkey % 16 + 1)")).alias("highway"),
        _pick("i % 10", {3: "private", 4: "yes"}).alias("access"),
        _pick("i % 23", {3: "private", 4: "yes"}).alias("vehicle"),
        _pick("i % 29", {3: "private", 4: "yes"}).alias("motor_vehicle"),
        _pick("i % 31", {3: "private", 4: "yes"}).alias("motorcar"),
        _pick("i % 41", {0: "parking_aisle"}).alias("service"),
        _pick("i % 11", {0: "none", 1: "walk", 2: "30", 3: "50", 4: "100"}).alias("maxspeed"),
        _pick("i % 17", {0: "DE:rural", 1: "DE:urban", 2: "DE:zone30", 3: "DE:zone20"}).alias("maxspeed:type"),
        _pick("i % 19", {0: "DE:rural", 1: "DE:urban"}).alias("zone:traffic"),
        F.when(F.col("o_orderstatus") == "O", _pick("i % 8", {0: "yes", 1: "-1", 2: "true", 3: "1", 4: "no"})).alias("oneway"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("name"),
        F.expr("CASE WHEN i % 3 = 0 THEN concat('K', i % 50) END").alias("ref"),
    )


def community_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routable segments: geometry and the id of their way."""
    d = _cells(table(spark, sf_dir, "orders"))
    return d.selectExpr("i AS edge_id", "i div 4 AS osm_id", f"array({_grid('c1', 'r1')}, {_grid('c2', 'r2')}) AS pts")


def streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "string(c_custkey) AS gml_id",
        "CASE c_nationkey % 8 WHEN 0 THEN 1301 WHEN 1 THEN 1303 WHEN 2 THEN 1305 WHEN 3 THEN 1306"
        " WHEN 4 THEN 1307 WHEN 5 THEN 9999 WHEN 6 THEN 9997 END AS widmung",
        "CASE WHEN c_custkey % 6 <> 0 THEN c_name END AS name",
        "CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment END AS bezeichnung",
    )


def road_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One axis per order, with a moved midpoint; priority decides the models, price the state."""
    d = _cells(table(spark, sf_dir, "orders"))
    a, b = _grid("c1", "r1", 1, -1), _grid("c2", "r2", 1, -1)
    d = d.selectExpr("*", f"{a} AS pa", f"{b} AS pb")
    mid = "named_struct('x', (pa.x + pb.x) / 2 + (i % 5 - 2), 'y', (pa.y + pb.y) / 2 + (i % 3 - 1))"
    return d.selectExpr(
        "concat('A', lpad(i, 12, '0')) AS gml_id",
        "string(o_custkey) AS istTeilVon",
        f"array(pa, {mid}, pb) AS pts",
        "CASE o_orderpriority WHEN '5-LOW' THEN array('DLM50') WHEN '1-URGENT' THEN array('Basis-DLM', 'DLM50')"
        " WHEN '2-HIGH' THEN array('Basis-DLM', 'Basis-DLM') ELSE array('Basis-DLM') END AS advstandardmodell",
        "CASE WHEN i % 27 = 0 THEN 1808 END AS funktion",
        "CASE WHEN i % 59 = 0 THEN 2100 WHEN i % 61 = 0 THEN 4000 END AS zustand",
        "CASE WHEN i % 7 = 0 THEN 2 END AS verkehrsbedeutungInneroertlich",
        "o_totalprice",
    )


def carriageways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most expensive roads have carriageway axes of their own."""
    return (
        road_axes(spark, sf_dir)
        .filter("o_totalprice >= 495000")
        .withColumn("gml_id", F.expr("concat('F', substring(gml_id, 2))"))
        .drop("verkehrsbedeutungInneroertlich", "o_totalprice")
    )


def authority_raw(spark: SparkSession, sf_dir: str, serial: bool = True) -> DataFrame:
    axes = road_axes(spark, sf_dir).drop("o_totalprice")
    return assemble_authority(axes, carriageways(spark, sf_dir), streets(spark, sf_dir), serial)


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One point per customer; neighbours in the register lie about 1.5 km apart."""
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS id",
        "430000 + (1511 * c_custkey) % 10000 + 0.5D AS x",
        "5930000 + 5 * c_custkey + 0.25D AS y",
    )


def restrictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Straight-on bans on every fifth east edge, U-turn bans, some listed twice."""
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS i")
    row = lambda cond, to: o.filter(cond).selectExpr(
        "10000.0D AS restriction_cost", f"{to} AS to_edge_id", "i AS from_edge_id", "CAST(NULL AS STRING) AS via_path"
    )
    both = "i % 370 = 0"
    return row("i % 10 = 0", "i + 2").unionByName(row("i % 37 = 0", "i")).unionByName(row(both, "i + 2")).unionByName(row(both, "i"))


def community_network(spark: SparkSession, sf_dir: str, tags: list[str] | None = None) -> DataFrame:
    """Community edges after selection and tag join, with length (speed not yet filled in)."""
    ways = filter_car_roads(community_ways(spark, sf_dir))
    return set_length(join_segments(ways, community_segments(spark, sf_dir), tags=tags))


def authority_network(spark: SparkSession, sf_dir: str, serial: bool = True) -> DataFrame:
    """Authority edges with length (speed not yet filled in)."""
    return set_length(authority_raw(spark, sf_dir, serial))


def community_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_weights(set_speed_community(community_network(spark, sf_dir)), community_profile())


def authority_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = set_speed_authority(authority_network(spark, sf_dir)).withColumn("fahrtrichtung", F.lit(None).cast("boolean"))
    return set_weights(edges, authority_profile())
