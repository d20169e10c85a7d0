"""SimHash near-duplicates: segment popcounts as a grid, a range join on it, exact verification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadweave.llm.common import arrow_rows, text_bytes, words
from roadweave.operators.components import connected_components
from roadweave.session import pin_table

BITS, SEED, STEP = 64, 42, 1 << 16
_LOW = 0x5555555555555555  # the lower bit of every segment of two bits


def fingerprint(text: bytes, shingle: int) -> int:
    """Bit i is set if it is set in over half the hashes (XXH64, seed 42) of the word shingles (repeats included)."""
    hashed, seed, bits = xxhash.xxh64_intdigest, SEED, BITS
    found = words(text.lower())  # bytes.lower() changes A-Z only
    if not found:
        return 0
    if len(found) <= shingle:
        return hashed(b" ".join(found), seed)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts, ends = np.concatenate(([0], ends[:-shingle])), ends[shingle - 1 :] - 1
    total, counts = len(starts), np.zeros(bits, np.int64)
    for at in range(0, total, STEP):  # a very long text takes bounded memory
        part = zip(starts[at : at + STEP].tolist(), ends[at : at + STEP].tolist(), strict=True)
        h = np.frombuffer(b"".join(hashed(joined[a:b], seed).to_bytes(bits // 8, "little") for a, b in part), np.uint8)
        counts += np.unpackbits(h.reshape(-1, bits // 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > total, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """(key, fp long) per row; the fingerprint's 64 bits are kept in a signed long."""
    kind = docs.schema[key].dataType.simpleString()

    def make(batch: pa.RecordBatch) -> dict:
        fps = np.fromiter((fingerprint(t, shingle) for t in text_bytes(batch.column(1))), np.uint64, batch.num_rows)
        return {key: batch.column(0), "fp": pa.array(fps.view(np.int64))}

    return arrow_rows(docs.select(key, text), f"`{key}` {kind}, fp long", make)


def _in_cells(nodes: DataFrame, max_distance: int) -> DataFrame:
    """nodes with one row for every grid cell (g, c) of their fp: one set of cells for each group of bits.

    With g = max_distance // 3 + 1 groups, fingerprints within max_distance differ by at most 2 bits in some group.
    A group is embedded as the popcounts (0 to 2) of its segments of two bits, packed into one long. The Manhattan
    distance of two embeddings is at most the bit distance, so such a pair has embeddings within 2 of each other, and
    then a lattice point within 1 of both. Each side lists the points within 1: equal cells find all pairs within 2.
    """
    groups, embedded = max_distance // 3 + 1, []
    for g in range(groups):
        first, last = (BITS * g // groups) // 2 * 2, (BITS * (g + 1) // groups) // 2 * 2
        x = F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << (last - first)) - 1 if last - first < 64 else -1))
        counts = x.bitwiseAND(F.lit(_LOW)) + F.shiftrightunsigned(x, 1).bitwiseAND(F.lit(_LOW))
        embedded.append(F.struct(F.lit(g).cast("byte").alias("g"), counts.alias("counts"), F.lit(last - first - 2).alias("top")))
    rows = nodes.select(*nodes.columns, F.inline(F.array(*embedded)))
    one = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
    digit = lambda i: F.call_function("shiftrightunsigned", F.col("counts"), i).bitwiseAND(F.lit(3))
    places = F.sequence(F.lit(0), F.col("top"), F.lit(2))
    more = F.transform(F.filter(places, lambda i: digit(i) < 2), lambda i: F.col("counts") + one(i))
    less = F.transform(F.filter(places, lambda i: digit(i) > 0), lambda i: F.col("counts") - one(i))
    return rows.select(*nodes.columns, "g", F.explode(F.concat(F.array("counts"), more, less)).alias("c"))


def _near(a: str, b: str, max_distance: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= max_distance


def links(nodes: DataFrame, max_distance: int = 4) -> DataFrame:
    """(a, b) of all different fingerprints of the column fp that differ in at most max_distance bits, each pair once.

    If nodes (then distinct) have a column root, pairs of the same root are left out. Only pairs that pass the tests leave
    the join; the two sides are shuffled by cell, and Spark splits crowded cells. For 3 * groups > max_distance up to 8 a
    cell names at least 20 bits.
    """
    rooted = "root" in nodes.columns
    cells = _in_cells(nodes.select("fp", *(["root"] if rooted else [])).distinct(), max_distance)
    a = cells.select(F.col("fp").alias("a"), "g", "c", *([F.col("root").alias("other")] if rooted else []))
    b = cells.withColumnRenamed("fp", "b")
    met = (F.col("a") < F.col("b")) & _near("a", "b", max_distance)
    if rooted:
        met &= F.col("other") != F.col("root")
    return a.join(b, ["g", "c"]).where(met).select("a", "b").distinct()


def connected(fps: DataFrame, max_distance: int = 4) -> DataFrame:
    """(node, root) of every fingerprint of the column fp that links of at most max_distance bits join to another one.

    First each fingerprint is tried against the smallest of each of its cells: in a group of near copies these stars
    join nearly all, with a link for each and not for each pair. Then all pairs that are still apart are sought.
    """
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nodes = pin_table(fps.select("fp").distinct().repartition(parts, "fp"))
    spread = nodes.repartition(parts, "fp")  # the table is small, its cells are many
    cells = _in_cells(spread, max_distance)
    heads = cells.groupBy("g", "c").agg(F.min("fp").alias("head"), F.count("*").alias("n"))
    heads = pin_table(heads.where("n > 1").drop("n"))
    stars = cells.join(heads, ["g", "c"]).where((F.col("fp") != F.col("head")) & _near("fp", "head", max_distance))
    stars = pin_table(stars.select(F.col("head").alias("a"), F.col("fp").alias("b")).distinct())
    known = pin_table(connected_components(stars, "a", "b"))
    rooted = nodes.join(known, nodes.fp == known.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))
    rest = pin_table(links(rooted.repartition(parts, "fp"), max_distance))
    return connected_components(known.select(F.col("root").alias("a"), F.col("node").alias("b")).unionAll(rest), "a", "b")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, max_distance: int = 4) -> DataFrame:
    """(key, fp, component) per row of docs; component is the smallest key that links of at most max_distance bits reach.

    Nulls: a null text counts as empty (fingerprint zero, which links like any other); a null key is kept, and is
    ignored as a smallest key (a component of null keys only has component null). Repeated rows stay repeated and share
    a component. An empty table gives no rows; other columns of docs are not read. Links are sought between distinct
    fingerprints only, so copies cost nothing and no pairs of copies are listed.
    """
    fps = pin_table(fingerprints(docs, key, text, shingle))
    nodes = fps.groupBy("fp").agg(F.min(key).alias("least"))
    parts = connected(fps, max_distance)
    linked = nodes.join(parts, nodes.fp == parts.node).select("fp", "root", "least")
    smallest = linked.groupBy("root").agg(F.min("least").alias("smallest"))
    linked = linked.join(smallest, "root").select("fp", "smallest")
    nodes = nodes.join(linked, "fp", "left").select("fp", F.coalesce("smallest", "least").alias("component"))
    return fps.join(nodes, "fp").select(key, "fp", "component")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, max_distance: int = 4) -> DataFrame:
    """The rows of docs (a table as read) without near-duplicates, with all their columns.

    Of each component of near_duplicates the row with the smallest key stays, of equal keys the first; a null key is
    smaller than others. Null and empty texts are near-duplicates of one another. An empty table gives no rows.
    """
    name = "_row"
    while name in docs.columns:
        name += "_"
    rows = docs.withColumn(name, F.monotonically_increasing_id())
    keyed = rows.select(F.struct(F.col(key).alias("key"), F.col(name).alias("row")).alias("id"), F.col(text).alias("text"))
    found = near_duplicates(keyed, "id", "text", shingle, max_distance)
    stay = found.where(F.col("id.row") == F.col("component.row")).select(F.col("id.row").alias(name))
    return rows.join(stay, name, "leftsemi").drop(name)
