"""Common study area of two data sets, and clipping to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadweave.functions.geometry import BOX, bounds, box_inset, box_intersection, clip_line, overlaps
from roadweave.session import dense_serial

# fixed values: metres between common extent and road box, and between road box and address box
ROAD_INSET = 1500.0
ADDRESS_INSET = 1000.0


def extent(edges: DataFrame, pts: str = "pts") -> DataFrame:
    """One row: the envelope of all lines (NULL lines do not count)."""
    b = edges.select(*[c.alias(n) for n, c in bounds(F.col(pts)).items()])
    return b.agg(
        F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax")
    )


def _columns(prefix: str) -> dict:
    return {n: F.col(f"{prefix}{n}") for n in BOX}


def study_boxes(
    a: DataFrame, b: DataFrame, box: tuple[float, float, float, float] | None = None,
    road_inset: float = ROAD_INSET, address_inset: float = ADDRESS_INSET,
) -> DataFrame:
    """Three rows (purpose, xmin, ymin, xmax, ymax) for outer, inner and address box.

    Without a given box the common extent is the outer box and the inner box lies 1.5 km inside it;
    with one, the inner box is its overlap with the common extent. Addresses keep 1 km more distance.
    """
    both = extent(a).withColumn("_of", F.lit("a")).unionByName(extent(b).withColumn("_of", F.lit("b")))
    both = both.agg(*[F.max(F.when(F.col("_of") == k, F.col(n))).alias(f"{k}_{n}") for k in "ab" for n in BOX])
    common = box_intersection(_columns("a_"), _columns("b_"))
    both = both.select(*[c.alias(n) for n, c in common.items()])
    common = _columns("")
    if box is None:
        outer, inner = common, box_inset(common, road_inset)
    else:
        outer = {n: F.lit(float(v)) for n, v in zip(BOX, box)}
        inner = box_intersection(outer, common)
    both = both.select(*[c.alias(f"o_{n}") for n, c in outer.items()], *[c.alias(f"i_{n}") for n, c in inner.items()])
    address = box_inset(_columns("i_"), address_inset)
    row = lambda purpose, b: F.struct(F.lit(purpose).alias("purpose"), *[c.alias(n) for n, c in b.items()])
    return both.select(
        F.inline(
            F.array(
                row("outer_bbox", _columns("o_")), row("inner_bbox", _columns("i_")), row("address_bbox", address)
            )
        )
    )


def _the_box(boxes: DataFrame, purpose: str) -> dict[str, Column]:
    """The box of a purpose (there is one) as a scalar subquery, run once however often it is used."""
    one = boxes.filter(F.col("purpose") == purpose).select(F.struct(*BOX).alias("box")).scalar()
    return {n: one[n] for n in BOX}


def _meets(box: dict[str, Column]) -> Column:
    return F.coalesce(overlaps(bounds(F.col("pts")), box), F.col("pts").isNull())


def touching(edges: DataFrame, boxes: DataFrame, purpose: str = "inner_bbox") -> DataFrame:
    """Edges whose envelope meets the box; rows without geometry stay. A box with nothing left meets none."""
    return edges.filter(_meets(_the_box(boxes, purpose)))


def clip(edges: DataFrame, boxes: DataFrame, purpose: str = "inner_bbox") -> DataFrame:
    """Edges cut exactly at the box: one row per part, numbered by part_no; nothing left = no row."""
    box = _the_box(boxes, purpose)
    others = [c for c in edges.columns if c != "pts"]
    boxed = edges.filter(_meets(box)).withColumns({f"_{n}": c for n, c in box.items()})
    parts = F.posexplode(clip_line(F.col("pts"), _columns("_"))).alias("part_no", "pts")
    return boxed.select(*others, parts).withColumn("part_no", F.col("part_no") + 1)


def unique_parts(parts: DataFrame) -> DataFrame:
    """Give every part beyond the first an edge id of its own, above all others; drops part_no."""
    first, more = parts.filter("part_no = 1"), parts.filter("part_no > 1")
    top = parts.agg(F.max("edge_id")).scalar()
    more = dense_serial(more, ["edge_id", "part_no"], "_n").withColumn("edge_id", top + F.col("_n")).drop("_n")
    return first.unionByName(more).drop("part_no")


def filter_points(points: DataFrame, boxes: DataFrame, purpose: str = "address_bbox") -> DataFrame:
    """Points inside the box (border included); points without coordinates stay."""
    box = _the_box(boxes, purpose)
    hit = (F.col("x") >= box["xmin"]) & (F.col("x") <= box["xmax"]) & (F.col("y") >= box["ymin"]) & (F.col("y") <= box["ymax"])
    return points.filter(F.coalesce(hit, F.col("x").isNull() | F.col("y").isNull()))
