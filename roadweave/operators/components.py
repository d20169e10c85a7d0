"""Connected components of an edge table, without any node's neighbours in one task."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave.session import pin_table

THIN = 50_000  # links that one task thins, and nodes of the forest it holds


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges replaced by stars with the same components (at most one edge per node), THIN nodes or a batch more at a time."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := up.setdefault(x, x)) != x:
            up[x] = x = up[p]
        return x

    def stars() -> pa.RecordBatch:
        found = [(x, r) for x in up if (r := root(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([s[i] for s in found], pa.int64()) for i in (0, 1)], names=["u", "v"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
        if len(up) >= THIN:
            yield stars()
            up.clear()
    yield stars()


def _all_stars(links: DataFrame) -> bool:
    """Has every tail one link, to a node that is no tail?"""
    tail, head = (F.struct(F.col(x).alias("x"), F.lit(n).cast("long").alias("n"), F.lit(n == 0).alias("head")) for x, n in (("u", 1), ("v", 0)))
    ends = links.select(F.inline(F.array(tail, head))).groupBy("x").agg(F.sum("n").alias("n"), F.max("head").alias("head"))
    return ends.where((F.col("n") > 1) | (F.col("head") & (F.col("n") > 0))).isEmpty()


def connected_components(edges: DataFrame, u: str, v: str) -> DataFrame:
    """(node, root) for every node that has a link to another one; root is the smallest long of its component.

    Edges are first thinned to forests, in each task on its own. Then large-star and small-star steps alternate until all
    that is left are stars: a step is a minimum per node (partial aggregation) and an equi join. Between them links are
    thinned again, in a task for every THIN of them, so that few links take few rounds. Minima are written as tables
    before they are joined: only then does Spark split hot keys of the other side, and each is computed once. Every link
    leads to a smaller node, so a star's centre is its smallest. Null ends and loops are ignored; no edges give no rows.
    """

    def step(links: DataFrame, near: DataFrame) -> DataFrame:
        return links.join(near, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")

    pairs = edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).where("u != v")
    links = pin_table(pairs.mapInArrow(_forest, "u long, v long").distinct())
    while True:
        links = pin_table(links.coalesce(links.count() // THIN + 1).mapInArrow(_forest, "u long, v long"))
        if _all_stars(links):
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
                links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = pin_table(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = pin_table(step(both.where("v > u"), least).unionAll(least.where("u != m")).distinct())
        least = pin_table(large.groupBy("u").agg(F.min("v").alias("m")))
        links = pin_table(step(large, least).unionAll(least).distinct())
