"""Planar geometry as Column expressions.

A point is STRUCT<x, y>, a line is ARRAY<STRUCT<x, y>>, a box is four doubles. Everything here stays
in the JVM: one line is one row, and lines are exploded to segments only where a join needs them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOX = ("xmin", "ymin", "xmax", "ymax")


def point(x, y) -> Column:
    return F.struct(F.col(x) if isinstance(x, str) else x, F.col(y) if isinstance(y, str) else y).cast(
        "struct<x:double,y:double>"
    )


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))


def first_point(pts: Column) -> Column:
    return F.element_at(pts, 1)


def last_point(pts: Column) -> Column:
    return F.element_at(pts, -1)


def line_length(pts: Column) -> Column:
    """Length of a line; 0 for fewer than two points."""
    steps = F.greatest(F.size(pts) - 1, F.lit(0))
    parts = F.zip_with(
        F.slice(pts, F.lit(1), steps),
        F.slice(pts, F.lit(2), steps),
        lambda a, b: distance(a["x"], a["y"], b["x"], b["y"]),
    )
    return F.aggregate(parts, F.lit(0.0), lambda s, d: s + d)


def bounds(pts: Column) -> dict[str, Column]:
    """Envelope of a line as four named columns."""
    xs, ys = F.transform(pts, lambda p: p["x"]), F.transform(pts, lambda p: p["y"])
    return {"xmin": F.array_min(xs), "ymin": F.array_min(ys), "xmax": F.array_max(xs), "ymax": F.array_max(ys)}


def overlaps(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Do two envelopes share a point? NULL when either is NULL."""
    return (
        (a["xmin"] <= b["xmax"]) & (a["xmax"] >= b["xmin"]) & (a["ymin"] <= b["ymax"]) & (a["ymax"] >= b["ymin"])
    )


def box_intersection(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    """Common part of two boxes; all four NULL when they do not meet."""
    lo_x, lo_y = F.greatest(a["xmin"], b["xmin"]), F.greatest(a["ymin"], b["ymin"])
    hi_x, hi_y = F.least(a["xmax"], b["xmax"]), F.least(a["ymax"], b["ymax"])
    ok = (lo_x <= hi_x) & (lo_y <= hi_y)
    return {"xmin": F.when(ok, lo_x), "ymin": F.when(ok, lo_y), "xmax": F.when(ok, hi_x), "ymax": F.when(ok, hi_y)}


def box_inset(a: dict[str, Column], by: float) -> dict[str, Column]:
    """Box moved inwards on all sides; all four NULL when nothing is left."""
    ok = (a["xmin"] + by < a["xmax"] - by) & (a["ymin"] + by < a["ymax"] - by)
    return {
        "xmin": F.when(ok, a["xmin"] + by),
        "ymin": F.when(ok, a["ymin"] + by),
        "xmax": F.when(ok, a["xmax"] - by),
        "ymax": F.when(ok, a["ymax"] - by),
    }


def segments(df: DataFrame, keys: list[str], pts: str = "pts") -> DataFrame:
    """One row per segment: keys, seg_no (from 1), x1, y1, x2, y2."""
    p = F.col(pts)
    rows = F.when(
        F.size(p) > 1,
        F.transform(
            F.sequence(F.lit(1), F.size(p) - 1),
            lambda i: F.struct(
                i.alias("seg_no"),
                F.get(p, i - 1)["x"].alias("x1"),
                F.get(p, i - 1)["y"].alias("y1"),
                F.get(p, i)["x"].alias("x2"),
                F.get(p, i)["y"].alias("y2"),
            ),
        ),
    )
    return df.select(*keys, F.inline(rows))


def foot_parameter(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Position in [0, 1] on the segment of the point nearest to (px, py); 0 for an empty segment."""
    dx, dy = x2 - x1, y2 - y1
    len2 = dx * dx + dy * dy
    t = ((px - x1) * dx + (py - y1) * dy) / F.nullif(len2, F.lit(0.0))
    return F.when(t.isNull() | (t <= 0), F.lit(0.0)).when(t >= 1, F.lit(1.0)).otherwise(t)


def at_parameter(t: Column, a: Column, b: Column) -> Column:
    """Coordinate at position t between a and b, exact at both ends."""
    return F.when(t <= 0, a).when(t >= 1, b).otherwise(a + t * (b - a))


def with_foot(df: DataFrame, px: str = "px", py: str = "py") -> DataFrame:
    """Add t, qx, qy, dist for a row that holds a point and a segment x1..y2."""
    c = F.col
    return (
        df.withColumn("t", foot_parameter(c(px), c(py), c("x1"), c("y1"), c("x2"), c("y2")))
        .withColumns({"qx": at_parameter(c("t"), c("x1"), c("x2")), "qy": at_parameter(c("t"), c("y1"), c("y2"))})
        .withColumn("dist", distance(c(px), c(py), c("qx"), c("qy")))
    )


def clip_line(pts: Column, box: dict[str, Column]) -> Column:
    """Parts of a line inside a box, as an array of lines (empty when the line only touches or misses).

    Each segment is cut by the four half planes; a cut piece is appended to the running part when the
    part ends where the piece begins, else it opens a new part. Row-local, so no shuffle.
    """
    n = F.size(pts)

    def cut(i):
        a, b = F.get(pts, i - 1), F.get(pts, i)
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]

        def span(delta, low, high):
            # for delta <> 0 the allowed range of t; for delta = 0 everything or nothing
            flat = F.when((low <= 0) & (high >= 0), F.lit(0.0)).otherwise(F.lit(2.0))
            lo = F.when(delta > 0, low / F.nullif(delta, F.lit(0.0))).when(
                delta < 0, high / F.nullif(delta, F.lit(0.0))
            )
            hi = F.when(delta > 0, high / F.nullif(delta, F.lit(0.0))).when(
                delta < 0, low / F.nullif(delta, F.lit(0.0))
            )
            return F.coalesce(lo, flat), F.coalesce(hi, F.lit(1.0))

        x_lo, x_hi = span(dx, box["xmin"] - a["x"], box["xmax"] - a["x"])
        y_lo, y_hi = span(dy, box["ymin"] - a["y"], box["ymax"] - a["y"])
        t0, t1 = F.greatest(x_lo, y_lo, F.lit(0.0)), F.least(x_hi, y_hi, F.lit(1.0))
        at = lambda t: F.struct(
            at_parameter(t, a["x"], b["x"]).alias("x"), at_parameter(t, a["y"], b["y"]).alias("y")
        )
        return F.struct((t0 < t1).alias("inside"), at(t0).alias("a"), at(t1).alias("b"))

    pieces = F.filter(F.transform(F.sequence(F.lit(1), n - 1), cut), lambda s: s["inside"])
    none = F.array().cast("array<array<struct<x:double,y:double>>>")

    def append(parts, s):
        last = F.element_at(parts, -1)
        joined = F.concat(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(F.concat(last, F.array(s["b"]))))
        return (
            F.when(F.size(parts) == 0, F.array(F.array(s["a"], s["b"])))
            .when(F.element_at(last, -1) == s["a"], joined)
            .otherwise(F.concat(parts, F.array(F.array(s["a"], s["b"]))))
        )

    box_holds_all = (
        (bounds(pts)["xmin"] >= box["xmin"])
        & (bounds(pts)["xmax"] <= box["xmax"])
        & (bounds(pts)["ymin"] >= box["ymin"])
        & (bounds(pts)["ymax"] <= box["ymax"])
    )
    return F.when(box_holds_all, F.array(pts)).when(n > 1, F.aggregate(pieces, none, append)).otherwise(none)
