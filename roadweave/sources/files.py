"""Readers for the input files: address register, community XML, authority XML, restrictions, patches."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from roadweave.operators.assemble import AXIS_COLUMNS, STREET_COLUMNS, widen
from roadweave.session import dense_serial, pin_table
from roadweave.sources.tag_rules import AREA_TAGS, DELETE_TAGS, LINE_TAGS

# fixed values: columns of the address register in file order
ADDRESS_COLUMNS = [
    "NBA", "OI", "QUA", "LAN", "RBZ", "KRS", "GMD", "OTT", "SSS", "HNR", "ADZ", "coor_easting",
    "coor_northing", "STN", "PLZ", "ONM", "ZON", "POT",
]
UTM32 = 25832


def address_point(df: DataFrame) -> DataFrame:
    """Add x, y, srid: decimal comma to point, zone prefix 32 taken off the easting (once, at its start)."""
    dot = lambda c: F.replace(F.col(c), F.lit(","), F.lit("."))
    east, north = dot("coor_easting"), dot("coor_northing")
    return df.withColumns(
        {
            "coor_easting": east,
            "coor_northing": north,
            "x": F.regexp_replace(east, "^32", "").cast("double"),
            "y": north.cast("double"),
            "srid": F.lit(UTM32),
        }
    )


def read_addresses(spark: SparkSession, path: str) -> DataFrame:
    """Address register: `;`-separated, Windows-1252, no header. Ids follow the object id (OI)."""
    name = "spark.sql.legacy.javaCharsets"  # Windows-1252 is not in the default list
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        return _addresses(spark, path)
    finally:
        spark.conf.set(name, before)


def _addresses(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ADDRESS_COLUMNS])
    raw = spark.read.schema(schema).option("sep", ";").option("encoding", "windows-1252").csv(path)
    order = ["OI", *[c for c in ADDRESS_COLUMNS if c != "OI"]]
    numbered = dense_serial(raw, order, "id")
    return address_point(numbered).select("id", *ADDRESS_COLUMNS, "x", "y", "srid")


# ---------------------------------------------------------------- community XML


def deleted_tag(key: Column) -> Column:
    """Is this tag dropped by the import rules? A trailing * in a rule stands for any ending."""
    pattern = "|".join(re.escape(t[:-1]) + ".*" if t.endswith("*") else re.escape(t) for t in DELETE_TAGS)
    return key.rlike(f"^(?:{pattern})$")


def kept_tags(tags: Column) -> Column:
    return F.map_filter(tags, lambda k, v: ~deleted_tag(k))


def tag_columns(tags: Column, columns: list[str] | None = None) -> list[Column]:
    """One text column per line tag of the rules."""
    return [F.try_element_at(tags, F.lit(t)).alias(t) for t in (columns or LINE_TAGS)]


#: The five named references of XML.
NAMED_REFERENCES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "amp": "&"}


def decoded(text: Column) -> Column:
    """Text with its named and numeric character references decoded, each once; what is no reference stays as it is."""

    def piece(p: Column, i: Column) -> Column:
        name = F.substring_index(p, ";", 1)
        number = F.when(name.rlike("^#[0-9]{1,7}$"), F.substring(name, 2, 7).cast("long")).when(
            name.rlike("^#x[0-9A-Fa-f]{1,6}$"), F.conv(F.substring(name, 3, 6), 16, 10).cast("long")
        )
        allowed = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)  # the rest are no characters
        found = F.when(allowed, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))
        for known, char in NAMED_REFERENCES.items():
            found = F.when(name == known, F.lit(char)).otherwise(found)
        rest = F.substring(p, F.length(name) + 2, F.length(p))
        return F.when(i == 0, p).when(p.contains(";") & found.isNotNull(), F.concat(found, rest)).otherwise(F.concat(F.lit("&"), p))

    return F.array_join(F.transform(F.split(text, "&"), piece), "")


def _attribute(body: Column, name: str) -> Column:
    """Value of an XML attribute as it is written; NULL where it is missing."""
    quoted = F.regexp_extract(body, rf"(?:^|\s){name}\s*=\s*(\"[^\"]*\"|'[^']*')", 1)
    return F.when(quoted != "", F.substring(quoted, F.lit(2), F.length(quoted) - 2))


def osm_records(spark: SparkSession, path: str) -> DataFrame:
    """The node, way, relation, nd and tag elements of a community file, in one pass that Spark can divide.

    The file is read as text that ends a record at every `>` (which attribute values must escape, as exports do), so large
    files are split like any other text. → kind, id, x, y, ref, k, v, empty (has no children), file, block, nth; block is
    where the split begins in the file, nth grows within it.
    """
    text = spark.read.option("lineSep", ">").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("nth"),
    )
    element = r"<(node|way|relation|nd|tag)(\s[^<]*)$"
    found = text.withColumns({"kind": F.regexp_extract("value", element, 1), "body": F.regexp_extract("value", element, 2)})
    found = found.where("kind <> ''")
    get = lambda name: _attribute(F.col("body"), name)
    return found.select(
        "kind", get("id").cast("long").alias("id"), get("lon").cast("double").alias("x"), get("lat").cast("double").alias("y"),
        get("ref").cast("long").alias("ref"), decoded(get("k")).alias("k"), decoded(get("v")).alias("v"), F.col("body").endswith("/").alias("empty"), "file", "block", "nth",
    )


def read_osm_nodes(spark: SparkSession, path: str, records: DataFrame | None = None) -> DataFrame:
    records = osm_records(spark, path) if records is None else records
    return records.where("kind = 'node'").select(F.col("id").alias("node"), "x", "y")


def read_osm_ways(spark: SparkSession, path: str, records: DataFrame | None = None) -> DataFrame:
    """osm_id, refs (node ids in order), tags (map, import rules applied); ways without any child are left out.

    A child belongs to the last node, way or relation that began before it: within a block by a window over the block (whose
    size Spark bounds), at a block's beginning by the last one begun in the blocks before, one row per block.
    """
    records = osm_records(spark, path) if records is None else records
    c = F.col
    rows = records.where("kind IN ('nd', 'tag') OR NOT empty")
    begun = F.when(c("kind").isin("node", "way", "relation"), F.struct("kind", "id"))
    last = rows.groupBy("file", "block").agg(F.max_by(begun, F.when(begun.isNotNull(), c("nth"))).alias("_own"))
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    last = last.select("file", "block", F.last("_own", ignorenulls=True).over(earlier).alias("_before"))
    here = W.partitionBy("file", "block").orderBy("nth").rowsBetween(W.unboundedPreceding, 0)
    owned = rows.withColumn("_own", F.last(begun, ignorenulls=True).over(here)).join(last, ["file", "block"])
    owned = owned.where("kind IN ('nd', 'tag')").withColumn("_own", F.coalesce("_own", "_before")).where("_own.kind = 'way'")
    nd = F.collect_list(F.when(c("kind") == "nd", F.struct("block", "nth", "ref")))
    tags = F.collect_list(F.when(c("kind") == "tag", F.struct("k", "v")))
    ways = owned.groupBy(c("_own.id").alias("osm_id")).agg(nd.alias("_nd"), tags.alias("_tags"))
    return ways.select(
        "osm_id", F.transform(F.array_sort("_nd"), lambda n: n["ref"]).alias("refs"), kept_tags(F.map_from_entries("_tags")).alias("tags")
    )


def way_points(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row per vertex of a way: osm_id, pos, node, x, y. Vertices without a node row are left out."""
    return ways.select("osm_id", F.posexplode("refs").alias("pos", "node")).join(nodes, "node")


def is_area(refs: Column, tags: Column) -> Column:
    """Closed ways with one of the area tags are areas, not lines."""
    closed = (F.size(refs) > 3) & (F.get(refs, 0) == F.element_at(refs, -1))
    return closed & F.exists(F.map_keys(tags), lambda k: k.isin(AREA_TAGS))


def read_osm_xml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Ways and their segments, as the analysis takes them: (ways, segments).

    Ways are lines in lon/lat with one column per tag (edge_id, osm_id, pts, srid, tags …); areas and ways of fewer than
    two known nodes are left out. Segments (edge_id, osm_id, seg_no, pts, srid) are the same ways cut at the nodes they
    share. edge_id numbers each table from 1, ways by osm_id, segments by (osm_id, seg_no).
    """
    records = pin_table(osm_records(spark, path))
    ways = pin_table(read_osm_ways(spark, path, records).where(~is_area(F.col("refs"), F.col("tags"))))
    points = pin_table(way_points(ways, read_osm_nodes(spark, path, records)))
    lines = (
        points.groupBy("osm_id")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))).alias("_p"))
        .filter(F.size("_p") > 1)
        .select("osm_id", F.transform("_p", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("pts"))
    )
    lines = ways.join(lines, "osm_id").select("osm_id", "pts", F.lit(4326).alias("srid"), *tag_columns(F.col("tags")))
    cut = segment_ways(points).withColumn("srid", F.lit(4326))
    return dense_serial(lines, ["osm_id"], "edge_id"), dense_serial(cut, ["osm_id", "seg_no"], "edge_id")


def segment_ways(points: DataFrame) -> DataFrame:
    """Cut ways into routable segments at the nodes they share.

    points (osm_id, pos, node, x, y) → osm_id, seg_no (from 1), pts. A node is a cut when two ways use it,
    or one way twice; the ends of a way always are. The vertex at a cut belongs to both segments.
    """
    uses = points.groupBy("node").agg(F.count("*").alias("_uses"))
    along = W.partitionBy("osm_id").orderBy("pos")  # one way: bounded by its number of vertices
    marked = points.join(uses, "node").withColumns(
        {"_first": F.lag("pos").over(along).isNull(), "_last": F.lead("pos").over(along).isNull()}
    )
    cut = (F.col("_uses") > 1) & ~F.col("_first") & ~F.col("_last")
    numbered = marked.withColumn("_cut", cut).withColumn("_k", F.sum(F.col("_cut").cast("int")).over(along) + 1)
    # _k counts cuts up to and including this vertex, so a cut vertex ends segment _k - 1 and starts _k
    member = F.when(F.col("_cut"), F.array(F.col("_k") - 1, F.col("_k"))).otherwise(F.array("_k"))
    rows = numbered.select("osm_id", "pos", "x", "y", F.explode(member).alias("seg_no"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "x", "y")))
    return rows.groupBy("osm_id", "seg_no").agg(
        F.transform(ordered, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("pts")
    ).filter(F.size("pts") > 1)


# ---------------------------------------------------------------- authority XML


def _pos_list(text: Column) -> Column:
    """'x y x y …' → array of points."""
    numbers = F.transform(F.filter(F.split(F.trim(text), r"\s+"), lambda s: s != ""), lambda s: s.cast("double"))
    xs, ys = F.filter(numbers, lambda v, i: i % 2 == 0), F.filter(numbers, lambda v, i: i % 2 == 1)
    return F.zip_with(xs, ys, lambda x, y: F.struct(x.alias("x"), y.alias("y")))


def _feature(spark: SparkSession, path: str, kind: str, fields: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", kind).option("ignoreNamespace", "true").schema(fields).load(path)


_MODEL = "modellart struct<AA_Modellart:array<struct<advStandardModell:string>>>"


def read_authority_xml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Road axes, carriageway axes and streets of the authority exchange file."""
    curve = "position struct<Curve:struct<segments:struct<LineStringSegment:array<struct<posList:string>>>>>"
    axis = f"_id string, {_MODEL}, istTeilVon struct<_href:string>, {curve}, " + ", ".join(f"{c} {t}" for c, t in AXIS_COLUMNS.items())

    def axes(kind: str) -> DataFrame:
        raw = _feature(spark, path, kind, axis)
        parts = F.transform("position.Curve.segments.LineStringSegment", lambda s: _pos_list(s["posList"]))
        joints = F.filter("pts", lambda p, i: (i == 0) | (F.get("pts", i - 1) != p))
        return raw.select(
            F.col("_id").alias("gml_id"),
            F.element_at(F.split("istTeilVon._href", ":"), -1).alias("istTeilVon"),
            F.transform("modellart.AA_Modellart", lambda m: m["advStandardModell"]).alias("advstandardmodell"),
            F.flatten(parts).alias("pts"),
            F.lit(UTM32).alias("srid"),
            *AXIS_COLUMNS,
        ).withColumn("pts", joints)

    street = "_id string, " + ", ".join(f"{c} {t}" for c, t in STREET_COLUMNS.items())
    streets = widen(_feature(spark, path, "AX_Strasse", street), STREET_COLUMNS)
    return axes("AX_Strassenachse"), axes("AX_Fahrbahnachse"), streets.select(F.col("_id").alias("gml_id"), *STREET_COLUMNS)


# ---------------------------------------------------------------- small tables


def read_restrictions(spark: SparkSession, path: str) -> DataFrame:
    """Turn restrictions (CSV with header); exact copies count once."""
    schema = "restriction_cost double, to_edge_id int, from_edge_id int, via_path string"
    return spark.read.schema(schema).option("header", "true").csv(path).dropDuplicates()


def read_oneway_patch(spark: SparkSession, path: str) -> DataFrame:
    """One-way patch (CSV with header): seq, edge_id, fahrtrichtung."""
    return spark.read.schema("seq long, edge_id long, fahrtrichtung boolean").option("header", "true").csv(path)
