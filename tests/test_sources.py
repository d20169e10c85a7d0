"""Input files written to a temporary folder and read back; sinks and audits."""

import pytest

from pyspark.sql import functions as F

from roadweave.operators.assemble import filter_car_roads, rename_tags
from roadweave.sources import files, tables


def test_address_register(spark, tmp_path):
    head = "N;{};A;03;0;00;000;0000;00000;{};;{};{};{};12345;Musterstadt;;"
    rows = [
        head.format("DENI000000000002", "12", "32440123,5", "5930001,25", "Süßstraße €"),
        head.format("DENI000000000001", "1", "32324400,5", "5930000,5", "Am Weg"),
        head.format("DENI000000000003", "", "", "", ""),
    ]
    path = tmp_path / "hk.csv"
    path.write_bytes("\n".join(rows).encode("windows-1252"))
    got = {r.id: r for r in files.read_addresses(spark, str(path)).collect()}
    assert sorted(got) == [1, 2, 3]
    assert (got[1].x, got[1].y, got[1].srid) == (324400.5, 5930000.5, 25832)  # only the zone prefix goes
    assert got[2].STN == "Süßstraße €" and (got[2].x, got[2].y) == (440123.5, 5930001.25)
    assert got[3].HNR is None and got[3].x is None


OSM = """<?xml version='1.0' encoding='UTF-8'?>
<osm>
 <node id="1" lat="53.5" lon="8.1"/><node id="2" lat="53.5" lon="8.2"/><node id="3" lat="53.5" lon="8.3"/>
 <node id="4" lat="53.6" lon="8.2"/>
 <way id="10"><nd ref="1"/><nd ref="2"/><nd ref="3"/><tag k="highway" v="primary"/><tag k="note:de" v="x"/><tag k="source:maxspeed" v="sign"/></way>
 <way id="11"><nd ref="2"/><nd ref="4"/><tag k="highway" v="track"/><tag k="tiger:zip" v="1"/></way>
 <way id="13"><nd ref="1"/><nd ref="3"/><nd ref="4"/><nd ref="1"/><tag k="highway" v="service"/><tag k="area:highway" v="yes"/></way>
 <way id="12"><nd ref="4"/><nd ref="99"/><tag k="highway" v="service"/></way>
</osm>"""


def test_community_xml(spark, tmp_path):
    path = tmp_path / "a.osm"
    path.write_text(OSM)
    ways, segments = files.read_osm_xml(spark, str(path))
    got = {r.osm_id: r for r in ways.collect()}
    assert sorted(got) == [10, 11]  # way 12 has one known node only, way 13 is an area
    assert [(p.x, p.y) for p in got[10].pts] == [(8.1, 53.5), (8.2, 53.5), (8.3, 53.5)]
    assert [got[k].edge_id for k in (10, 11)] == [1, 2]
    assert [(r.edge_id, r.osm_id, r.seg_no, r.srid) for r in segments.orderBy("edge_id").collect()] == [(1, 10, 1, 4326), (2, 10, 2, 4326), (3, 11, 1, 4326)]
    assert got[10]["source:maxspeed"] == "sign" and got[10].srid == 4326
    assert rename_tags(ways).filter("osm_id = 10").first().source_maxspeed == "sign"
    assert [r.osm_id for r in filter_car_roads(ways).collect()] == [10]
    tags = {r.osm_id: r.tags for r in files.read_osm_ways(spark, str(path)).collect()}
    assert tags[10] == {"highway": "primary", "source:maxspeed": "sign"} and tags[11] == {"highway": "track"}

    lines = files.read_osm_ways(spark, str(path)).where("osm_id <> 13")
    points = files.way_points(lines, files.read_osm_nodes(spark, str(path)))
    cut = {(r.osm_id, r.seg_no): [p.x for p in r.pts] for r in files.segment_ways(points).collect()}
    assert cut == {(10, 1): [8.1, 8.2], (10, 2): [8.2, 8.3], (11, 1): [8.2, 8.2]}


def test_character_references(spark):
    cases = {
        "M&#252;hlen&#x73;tra&#xDF;e": "Mühlenstraße", "&#128652; &#x1F68C;": "\U0001f68c \U0001f68c", "&lt;&gt;&quot;&apos;&amp;": "<>\"'&",
        "&amp;#223;": "&#223;", "&#38;lt;": "&lt;", "&amp;amp;": "&amp;",  # decoded once
        "A & B; C": "A & B; C", "&;": "&;", "&#;": "&#;", "&#0;": "&#0;", "&#xD800;": "&#xD800;", "&#x110000;": "&#x110000;", "&nbsp;": "&nbsp;", "&#65": "&#65",
        "": "", "plain": "plain", None: None,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.d for r in rows.select("t", files.decoded(F.col("t")).alias("d")).collect()} == cases


def test_large_community_xml_is_divided(spark, tmp_path):
    """Whatever the splits, ways keep their nodes in order and their tags."""
    n = 3000
    nodes = "".join(f'<node id="{i}" lat="53.{i:04d}" lon=\'8.{i:04d}\'><tag k="highway" v="crossing"/></node>\n' for i in range(n))
    ways = "".join(f'<way id="{100 + k}" visible="true"><nd ref="{k}"/>\n' + "".join(f'<nd ref="{(k + j) % n}"/>' for j in range(1, 40)) + f'<tag k="name" v="A &amp;amp; &lt;{k}&gt;"/></way>\n' for k in range(300))
    path = tmp_path / "big.osm"
    path.write_text(f"<osm>{nodes}{ways}<relation id='5'><member type='way' ref='100'/><tag k='type' v='route'/></relation></osm>")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        records = files.osm_records(spark, str(path))
        assert records.rdd.getNumPartitions() > 8
        got = {r.osm_id: (r.refs, r.tags) for r in files.read_osm_ways(spark, str(path)).collect()}
        assert files.read_osm_nodes(spark, str(path)).distinct().count() == n
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {100 + k: ([(k + j) % n for j in range(40)], {"name": f"A &amp; <{k}>"}) for k in range(300)}


AUTHORITY = """<?xml version="1.0" encoding="UTF-8"?>
<AX_Bestandsdatenauszug xmlns:gml="g" xmlns:xlink="x"><enthaelt>
<AX_Strassenachse gml:id="DENI1"><modellart><AA_Modellart><advStandardModell>DLM50</advStandardModell></AA_Modellart>
<AA_Modellart><advStandardModell>Basis-DLM</advStandardModell></AA_Modellart></modellart>
<istTeilVon xlink:href="urn:adv:oid:DENI9"/><position><gml:Curve><gml:segments><gml:LineStringSegment>
<gml:posList>430000.5 5930000 430010 5930005 430020 5930000</gml:posList></gml:LineStringSegment></gml:segments></gml:Curve></position>
<funktion>1808</funktion><breiteDerFahrbahn>5.5</breiteDerFahrbahn></AX_Strassenachse>
<AX_Strasse gml:id="DENI9"><widmung>1307</widmung><name>Weg</name></AX_Strasse>
</enthaelt></AX_Bestandsdatenauszug>"""


def test_authority_xml(spark, tmp_path):
    path = tmp_path / "a.xml"
    path.write_text(AUTHORITY)
    axes, carriageways, streets = files.read_authority_xml(spark, str(path))
    a = axes.first()
    assert (a.gml_id, a.istTeilVon, a.advstandardmodell, a.funktion) == ("DENI1", "DENI9", ["DLM50", "Basis-DLM"], 1808)
    assert [(p.x, p.y) for p in a.pts] == [(430000.5, 5930000), (430010, 5930005), (430020, 5930000)]
    assert float(a.breiteDerFahrbahn) == 5.5 and a.zustand is None
    assert carriageways.count() == 0
    s = streets.first()
    assert (s.gml_id, s.widmung, s.name, s.bezeichnung) == ("DENI9", 1307, "Weg", None)


def test_restriction_and_patch_files(spark, tmp_path):
    r = tmp_path / "r.csv"
    r.write_text("restriction_cost,to_edge_id,from_edge_id,via_path\n10000,1,2,\n10000,1,2,\n10000,3,3,\n")
    assert files.read_restrictions(spark, str(r)).count() == 2
    p = tmp_path / "p.csv"
    p.write_text("seq,edge_id,fahrtrichtung\n1,5,true\n2,5,false\n")
    assert files.read_oneway_patch(spark, str(p)).count() == 2


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    one = spark.createDataFrame([(1, "a")], "k int, dataset string")
    tables.write_new(one, path, "dataset")
    with pytest.raises(Exception, match="(?i)exist"):
        tables.write_new(one, path, "dataset")
    tables.append(spark.createDataFrame([(2, "b")], "k int, dataset string"), path, "dataset")
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == [1, 2]
    tables.replace_all(one, path)
    assert spark.read.parquet(path).count() == 1
    tables.require_empty(one.filter("k = 9"), "t")
    with pytest.raises(ValueError):
        tables.require_empty(one, "t")


def test_upsert_and_audits(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, tables.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, tables.upsert(old, new, ["k"], overwrite=False).collect())) == [(1, "a"), (2, "b"), (3, "d")]
    refs = spark.createDataFrame([(1,), (7,), (None,)], "r int")
    assert [r.r for r in tables.orphans(refs, "r", old, "k").collect()] == [7]
    assert tables.duplicate_keys(old.unionByName(old), ["k"]).count() == 2
