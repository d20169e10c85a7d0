"""Substring duplicates by relative Lempel-Ziv factors: documents against indexed blocks of the corpus itself."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadweave.llm.common import text_bytes, words
from roadweave.session import pin_table

BYTES_AT_ONCE = 1 << 21
FILTER_BITS = 25
_GRAM, _WINDOW = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F  # odd bases of the two rolling hashes
_SLICE = 1 << 18


def _rolled(h: np.ndarray, n: int, base: int) -> np.ndarray:
    """Hash of every n consecutive word hashes: a polynomial modulo 2^64 by doubling, then mixed."""
    power = lambda k: np.uint64(pow(base, k, 1 << 64))
    out, have = h, 1
    for bit in bin(n)[3:]:
        out = out[:-have] * power(have) + out[have:]
        have *= 2
        if bit == "1":
            out = out[:-1] * power(1) + h[have:]
            have += 1
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(29))


def _anchors(h: np.ndarray, begins: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with a common anchor, of documents laid end to end; begins has one more entry at the end.

    The anchor of a window is its leftmost least n-gram hash, n = window // 2 + 1: it depends on the window's words only,
    so equal windows have equal anchors at equal places. Returns (first window, windows, place of the anchor in the
    first window, anchor hash) per run, and the hash of every window.
    """
    gram = window // 2 + 1
    span = window - gram + 1
    if len(h) < window:
        return *(np.zeros(0, np.int64),) * 3, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    grams, hashes = _rolled(h, gram, _GRAM), _rolled(h, window, _WINDOW)
    at = np.empty(len(hashes), np.int64)
    for a in range(0, len(at), _SLICE):
        view = np.lib.stride_tricks.sliding_window_view(grams[a : a + _SLICE + span - 1], span)
        at[a : a + len(view)] = view.argmin(1) + np.arange(a, a + len(view))
    starts = np.arange(len(hashes))
    doc = np.searchsorted(begins, starts, "right") - 1
    whole = starts + window <= begins[doc + 1]
    new = whole.copy()
    new[1:] &= ~whole[:-1] | (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    count = np.add.reduceat(whole, first) if len(first) else first
    return first, count.astype(np.int64), at[first] - first, grams[at[first]], hashes


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row ids, word hashes, where each row's words begin) for about two MB of text at once."""
    for batch in batches:
        rows, texts, size = batch.column(0).to_numpy(), batch.column(1), 0
        start = 0
        for row in range(batch.num_rows):
            size += len(texts[row].as_buffer() or b"") if texts[row].is_valid else 0
            if size >= BYTES_AT_ONCE or row + 1 == batch.num_rows:
                found = [words(t) for t in text_bytes(texts.slice(start, row + 1 - start))]
                begins = np.cumsum([0, *map(len, found)])
                h = np.fromiter((xxhash.xxh3_64_intdigest(w) for f in found for w in f), np.uint64, begins[-1])
                yield rows[start : row + 1], h, begins
                start, size = row + 1, 0


def anchors(docs: DataFrame, window: int, keep=None) -> DataFrame:
    """(h, at, rid, p, t, hashes): one row per run of windows of docs(rid, text) that share an anchor.

    h is the anchor's hash, p the first window's place in the document, t the anchor's place in that window; hashes
    has eight bytes for each window of the run, whose anchor places are t, t - 1, ... `at` numbers the rows of a table
    that is read the same way again. keep, a broadcast bit map, drops anchors that surely occur once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 40
        for rows, h, begins in _hashed(batches):
            first, count, place, grams, hashes = _anchors(h, begins, window)
            doc = np.searchsorted(begins, first, "right") - 1
            number = np.arange(at, at + len(first))
            at += len(first)
            if keep is not None:
                bit = (grams & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)
                kept = np.flatnonzero(keep.value[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
                first, count, place, grams, doc, number = (x[kept] for x in (first, count, place, grams, doc, number))
            lengths = np.concatenate(([0], np.cumsum(count * 8))).astype(np.int32)
            ends = lengths[1:] // 8
            flat = hashes[np.repeat(first - np.concatenate(([0], ends[:-1])) if len(first) else first, count) + np.arange(ends[-1] if len(ends) else 0)]
            binary = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(lengths), pa.py_buffer(np.ascontiguousarray(flat))])
            yield pa.RecordBatch.from_arrays(
                [pa.array(grams.view(np.int64)), pa.array(number), pa.array(rows[doc]), pa.array(first - begins[doc]), pa.array(place.astype(np.int32)), binary],
                names=["h", "at", "rid", "p", "t", "hashes"],
            )

    return docs.select("rid", "text").mapInArrow(run, "h long, at long, rid long, p long, t int, hashes binary")


def _repeated(docs: DataFrame, window: int):
    """A bit map of fixed size over the anchors that occur more than once (with false positives, never negatives)."""
    spark = docs.sparkSession
    seen = anchors(docs, window).groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    place = F.col("h").bitwiseAND(F.lit((1 << FILTER_BITS) - 1)) + 1
    maps = seen.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    found = np.zeros(1 << FILTER_BITS - 3, np.uint8)
    for row in maps.toLocalIterator():  # 2^25 bits in all, whatever the input
        found[(row.bucket - 1) * 4096 : row.bucket * 4096] = np.frombuffer(row.bits, np.uint8)
    return spark.sparkContext.broadcast(found)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Extend each run's factor against the reference block of its anchor: which windows equal the block's?"""
    for batch in batches:
        h, at, rid, p, t, own, ref, ref_t, block = batch.columns
        own_n = np.diff(np.frombuffer(own.buffers()[1], np.int32)[own.offset : own.offset + len(own) + 1]) // 8
        block_n = np.diff(np.frombuffer(block.buffers()[1], np.int32)[block.offset : block.offset + len(block) + 1]) // 8
        own_flat = np.frombuffer(b"".join(own.to_pylist()), np.uint64)
        block_flat = np.frombuffer(b"".join(block.to_pylist()), np.uint64)
        row = np.repeat(np.arange(len(own)), own_n)
        begin, block_begin = np.cumsum(own_n) - own_n, np.cumsum(block_n) - block_n
        place = t.to_numpy()[row] - (np.arange(len(row)) - begin[row])  # of the anchor in each window
        there = ref_t.to_numpy()[row] - place
        inside = (there >= 0) & (there < block_n[row])
        equal = inside & (block_flat[np.where(inside, block_begin[row] + there, 0)] == own_flat)
        is_ref = at.to_numpy() == ref.to_numpy()
        mask = np.bitwise_or.reduceat(np.where(equal, 1 << place, 0), begin) if len(row) else np.zeros(len(own), np.int64)
        rest = np.flatnonzero(~equal & ~is_ref[row])
        rest_n = np.bincount(row[rest], minlength=len(own))
        offsets = pa.array(np.concatenate(([0], np.cumsum(rest_n))).astype(np.int32))
        boundary = pa.StructArray.from_arrays([pa.array(place[rest].astype(np.int32)), pa.array(own_flat[rest].view(np.int64))], ["t", "w"])
        yield pa.RecordBatch.from_arrays(
            [h, rid, p, t, pa.array(is_ref), pa.array(mask), pa.ListArray.from_arrays(offsets, boundary)],
            names=["h", "rid", "p", "t", "is_ref", "mask", "rest"],
        )


def duplicate_windows(docs: DataFrame, window: int) -> DataFrame:
    """(rid, p, t, mask): window p + t - i of document rid is a duplicate where bit i of mask is set.

    The reference is the corpus: the index holds one block for every anchor that occurs more than once, the windows
    around its first occurrence. Each other occurrence is factored against that block as far as its words agree; all
    windows of the factor are duplicates, and so are the block's. Windows at factor boundaries, where the words differ
    from the block, are looked up among the other boundary windows of the same anchor. All occurrences of a window have
    the same anchor at the same place and so all agree with the block or none does: nothing is missed. Anchors are
    counted, joined and summed by Spark, so one passage in a third of all documents is a hot key that partial
    aggregation or a split join handles; copies are never paired with each other.
    """
    keep = _repeated(docs, window)
    found = pin_table(anchors(docs, window, keep))
    blocks = found.groupBy("h").agg(F.count("*").alias("n"), F.min_by(F.struct("at", "t", "hashes"), "at").alias("b")).where("n > 1")
    blocks = blocks.select("h", F.col("b.at").alias("ref"), F.col("b.t").alias("ref_t"), F.col("b.hashes").alias("block"))
    joined = found.join(blocks, "h").select("h", "at", "rid", "p", "t", "hashes", "ref", "ref_t", "block")
    factors = pin_table(joined.mapInArrow(_compare, "h long, rid long, p long, t int, is_ref boolean, mask long, rest array<struct<t:int,w:long>>"))
    others = factors.where("not is_ref")
    of_blocks = others.where("mask != 0").groupBy("h").agg(F.bit_or("mask").alias("mask"))
    blocks = factors.where("is_ref").drop("mask").join(of_blocks, "h")
    rest = others.where("size(rest) > 0").select("h", "rid", "p", "t", F.explode("rest").alias("x")).select("h", "rid", (F.col("p") + F.col("t") - F.col("x.t")).alias("p"), "x.t", "x.w")
    again = rest.groupBy("h", "t", "w").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    boundary = rest.join(again, ["h", "t", "w"]).select("rid", "p", F.lit(0).alias("t"), F.lit(1).cast("long").alias("mask"))
    wanted = ["rid", "p", "t", "mask"]
    return others.where("mask != 0").select(wanted).unionByName(blocks.select(wanted)).unionByName(boundary)


def remove_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 35) -> DataFrame:
    """(key, kept, n_words, n_removed, spans) per row: every word covered by a window of words that also starts elsewhere goes.

    Words are runs of bytes other than ASCII white space, compared as they are; kept words are joined by one space. All
    windows are judged on the input. spans lists the removed word ranges [begin, end). docs must be a table as read (its
    rows come in the same order each time), since rows are told apart by their place.

    Null text: no words, kept empty. Null and repeated keys are kept as they are. A repeated row is another document, so
    its windows occur twice. Texts shorter than the window stay whole. An empty table gives no rows. Other columns of
    docs are not read. `window` is at most 124 words.
    """
    if not 2 <= window <= 124:
        raise ValueError("window must have 2 to 124 words")
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(key).alias("key"), F.col(text).alias("text"))
    found = duplicate_windows(rows, window)
    found = found.groupBy("rid").agg(F.collect_list(F.struct("p", "t", "mask")).alias("found"))
    joined = rows.join(found, "rid", "left").select("key", "text", "found.p", "found.t", "found.mask")
    kind = docs.schema[key].dataType
    out = T.StructType([T.StructField(key, kind), T.StructField("kept", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType())))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(out, prefers_large_types=False)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                columns = [[], [], [], []]
                for i, body in enumerate(text_bytes(part.column(1))):
                    have = words(body)
                    gone, spans = 0, []
                    if part.column(2)[i].is_valid:
                        p, t, mask = (np.asarray(part.column(c)[i].values) for c in (2, 3, 4))
                        bits = np.arange(window)
                        hit = (mask[:, None] >> np.minimum(bits, 62) & 1).astype(bool) & (bits <= 62)
                        starts = (p + t)[:, None] - bits
                        change = np.zeros(len(have) + 1, np.int64)
                        first = np.unique(starts[hit])
                        np.add.at(change, first, 1)
                        np.add.at(change, first + window, -1)
                        removed = np.cumsum(change[:-1]) > 0
                        edge = np.flatnonzero(np.diff(np.concatenate(([0], removed.view(np.int8), [0]))))
                        spans, gone = edge.reshape(-1, 2).tolist(), int(removed.sum())
                        kept = [w for w, x in zip(have, removed.tolist(), strict=True) if not x]
                    else:
                        kept = have
                    for c, x in zip(columns, (b" ".join(kept), len(have), gone, spans), strict=True):
                        c.append(x)
                keys = part.column(0)
                kept = pa.array(columns[0], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([keys.cast(target.field(0).type), kept, *(pa.array(c, f.type) for c, f in zip(columns[1:], list(target)[2:], strict=True))], schema=target)

    return joined.mapInArrow(cut, out)
