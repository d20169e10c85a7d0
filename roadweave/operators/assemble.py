"""From raw imports to the two edge tables: selection, union, enrichment, tag join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadweave.session import dense_serial

# fixed values: road classes open to cars, access values that exclude, service roads left out
CAR_CLASSES = [
    "motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link", "secondary",
    "secondary_link", "tertiary", "tertiary_link", "unclassified", "residential", "living_street", "service",
]
NO_ACCESS = ["no", "private", "customers", "permit", "agricultural", "forestry", "delivery", "destination"]
ACCESS_TAGS = ["access", "vehicle", "motor_vehicle", "motorcar"]
NO_SERVICE = ["parking_aisle", "emergency_access"]
# fixed values: text attributes of a community way, in table order, and the tags spelled otherwise
WAY_TAGS = [
    "access", "barrier", "bridge", "construction", "duration", "highway", "junction", "lanes", "layer",
    "maxaxleload", "maxheight", "maxlength", "maxspeed", "source_maxspeed", "maxspeed_type", "maxweight",
    "maxwidth", "motorcar", "motor_vehicle", "name", "alt_name", "oneway", "ref", "restriction", "service",
    "surface", "toll", "tracktype", "traffic_signals", "tunnel", "vehicle", "width", "source_width",
    "width_lanes", "zone_traffic",
]
RENAMED_TAGS = {
    "source:maxspeed": "source_maxspeed",
    "maxspeed:type": "maxspeed_type",
    "source:width": "source_width",
    "width:lanes": "width_lanes",
    "zone:traffic": "zone_traffic",
}
# fixed values: codes of the authority model
BASE_MODEL = "Basis-DLM"
PEDESTRIAN_ZONE = 1808
NOT_PUBLIC = 9997
# fixed values: optional attributes of the authority tables and their types
AXIS_COLUMNS = {
    "verkehrsbedeutungInneroertlich": "int",
    "verkehrsbedeutungUeberoertlich": "int",
    "funktion": "int",
    "zustand": "int",
    "anzahlDerFahrstreifen": "int",
    "breiteDerFahrbahn": "decimal(3,1)",
    "oberflaechenmaterial": "int",
}
STREET_COLUMNS = {"widmung": "int", "bezeichnung": "string", "name": "string", "fahrbahntrennung": "int"}


def widen(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add the missing columns as typed NULLs."""
    missing = {c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


def table_or_empty(spark, name: str, columns: dict[str, str]) -> DataFrame:
    """An optional input table; empty when it does not exist."""
    if spark.catalog.tableExists(name):
        return widen(spark.table(name), columns)
    schema = T.StructType([T.StructField(c, T._parse_datatype_string(t)) for c, t in columns.items()])
    return spark.createDataFrame([], schema)


def _null_or_not_in(column: str, values: list[str]) -> Column:
    c = F.col(column)
    return c.isNull() | ~c.isin(values)


def access_allowed() -> Column:
    return reduce(lambda a, b: a & b, [_null_or_not_in(t, NO_ACCESS) for t in ACCESS_TAGS])


def is_car_road() -> Column:
    return F.col("highway").isin(CAR_CLASSES) & access_allowed() & _null_or_not_in("service", NO_SERVICE)


def rename_tags(ways: DataFrame) -> DataFrame:
    """Tag columns with a colon get their table name; missing tag columns become NULL."""
    return widen(ways.withColumnsRenamed(RENAMED_TAGS), dict.fromkeys(WAY_TAGS, "string"))


def filter_car_roads(ways: DataFrame) -> DataFrame:
    """Community ways a car may use."""
    return rename_tags(ways).filter(is_car_road())


def join_segments(ways: DataFrame, segments: DataFrame, order: str = "edge_id", tags: list[str] | None = None) -> DataFrame:
    """Geometry of the routable segments with the tags of their way; only ways found in both remain.

    Several way rows with one osm_id: the lowest `order` value wins. The choice is a grouped minimum
    over a struct (partial aggregation before the shuffle), not a window over a whole key. Name the
    tags needed, if not all are: columns inside a struct are not pruned by the optimizer.
    """
    tags = [t for t in (tags or WAY_TAGS) if t in ways.columns]
    one = ways.groupBy("osm_id").agg(F.min_by(F.struct(*tags), F.col(order)).alias("_tags"))
    one = one.select("osm_id", F.col("osm_id").alias("pgsql_osm_id"), "_tags.*")
    geometry = [c for c in segments.columns if c not in tags and c != "pgsql_osm_id"]
    return segments.select(*geometry).join(one, "osm_id", "inner").select(*geometry, "pgsql_osm_id", *tags)


def in_base_model(axes: DataFrame) -> DataFrame:
    """Rows of the base model that are no pedestrian zone; a model listed twice gives the row twice."""
    return (
        axes.select("*", F.posexplode("advstandardmodell").alias("model_pos", "model"))
        .filter(F.col("model") == BASE_MODEL)
        .filter(F.col("funktion").isNull() | (F.col("funktion") != PEDESTRIAN_ZONE))
        .drop("model", "advstandardmodell")
    )


def not_in_column(df: DataFrame, column: str, other: DataFrame, other_column: str) -> DataFrame:
    """SQL `NOT IN (subquery)` with its NULL rules, as a hash anti join that scales.

    One NULL on the right removes every row; a NULL on the left is removed unless the right is empty.
    The two facts about the right side are one scalar subquery; the anti join itself is an equi join,
    so neither side has to fit into one executor.
    """
    facts = other.agg(
        F.struct(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(other_column).isNull()).alias("nulls"))
    ).scalar()
    keys = other.select(F.col(other_column).alias("_key")).filter("_key is not null").distinct()
    kept = df.join(keys, F.col(column) == F.col("_key"), "left_anti")
    return kept.filter((facts["rows"] == 0) | ((facts["nulls"] == 0) & F.col(column).isNotNull()))


def union_axes(axes: DataFrame, carriageways: DataFrame) -> DataFrame:
    """Road axes of streets without carriageway axes, followed by the carriageway axes."""
    axes, carriageways = widen(axes, AXIS_COLUMNS), widen(carriageways, AXIS_COLUMNS)
    roads = not_in_column(in_base_model(axes), "istTeilVon", carriageways, "istTeilVon")
    kind = lambda df, k: df.withColumn("axis_kind", F.lit(k))
    return kind(roads, 1).unionByName(kind(in_base_model(carriageways), 2), allowMissingColumns=True)


def enrich_with_streets(edges: DataFrame, streets: DataFrame) -> DataFrame:
    """Add dedication, designation and name of the street; edges without a street stay, with NULLs."""
    streets = widen(streets, STREET_COLUMNS)
    cols = list(STREET_COLUMNS)
    one = streets.groupBy(F.col("gml_id").alias("istTeilVon")).agg(
        F.min(F.struct(*[F.col(c) for c in cols])).alias("_s")
    )
    return edges.drop(*cols).join(one.select("istTeilVon", "_s.*"), "istTeilVon", "left")


def is_public() -> Column:
    return ~F.col("widmung").eqNullSafe(NOT_PUBLIC)


def assemble_authority(
    axes: DataFrame, carriageways: DataFrame, streets: DataFrame, serial: bool = True
) -> DataFrame:
    """The authority edge table. `serial=False` leaves out edge_id, and with it the global sort."""
    edges = enrich_with_streets(union_axes(axes, carriageways), streets).filter(is_public())
    if not serial:
        return edges
    return dense_serial(edges, ["axis_kind", "gml_id", "model_pos"], "edge_id").drop("axis_kind", "model_pos")


def patch_oneway(edges: DataFrame, patch: DataFrame) -> DataFrame:
    """Keyed one-way patch `(seq, edge_id, fahrtrichtung)`; the last entry of an edge wins."""
    last = patch.groupBy("edge_id").agg(F.max_by("fahrtrichtung", "seq").alias("_dir"), F.lit(True).alias("_hit"))
    edges = widen(edges, {"fahrtrichtung": "boolean"})
    return (
        edges.join(last, "edge_id", "left")
        .withColumn("fahrtrichtung", F.when(F.col("_hit"), F.col("_dir")).otherwise(F.col("fahrtrichtung")))
        .drop("_dir", "_hit")
    )
