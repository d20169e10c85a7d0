"""Token counts from flat token files that have no index: separators are searched block by block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadweave.llm.tokens import encoded

END_ID = 50256  # ids fit into two bytes
_WIDTH = 2


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, text: str = "text", end_id: int = END_ID) -> None:
    """Write the ids of the texts, two little-endian bytes each, every text closed by end_id, and nothing else.

    One file for each task that has rows, documents in the order of the rows. Spark's line writer puts the bytes as they
    are; the separator takes the place of its line end, so that the files live in any store that Spark writes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for _, _, ids in encoded(batches, 0, vocabulary):
            rows.append(ids.astype("<u2").tobytes())
            size += len(rows[-1])
            if size > 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["ids"])
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["ids"])

    closing = np.array([end_id], "<u2").tobytes().decode("latin-1")
    found = docs.select(text).mapInArrow(run, "ids binary")
    found.select(F.col("ids").cast("string")).write.option("lineSep", closing).option("encoding", "ISO-8859-1").text(folder)


def scan_blocks(spark: SparkSession, folder: str, end_id: int = END_ID, block_tokens: int = 1 << 20) -> DataFrame:
    """(path, block, first, n_tokens, ends): for each block its first token's place in the file and its separators' places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.frombuffer(content.as_buffer(), "<u2")
                for block, first in enumerate(range(0, len(ids), block_tokens)):
                    part = ids[first : first + block_tokens]
                    ends = np.flatnonzero(part == end_id) + first
                    yield pa.RecordBatch.from_pydict({"path": [path.as_py()], "block": pa.array([block], pa.int32()), "first": [first], "n_tokens": [len(part)], "ends": [ends]})

    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    return files.mapInArrow(run, "path string, block int, first long, n_tokens long, ends array<long>")


def document_lengths(spark: SparkSession, folder: str, end_id: int = END_ID, block_tokens: int = 1 << 20) -> DataFrame:
    """(path, nth, start, n_tokens, closed) of every document in the token files; the separator is not counted.

    Blocks are scanned independently. A prefix scan over the blocks of a file hands each block the number of documents
    before it and the place where its first document begins, which may lie several blocks back. Tokens after the last
    separator of a file are a document that is not closed. Two separators in a row bound an empty document; an empty
    file has no documents. Spark's binary source hands a file to one task and limits it to 2 GB, as shards have.
    """
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = scan_blocks(spark, folder, end_id, block_tokens)
    stitched = blocks.select(
        "path",
        "ends",
        F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).alias("nth"),
        F.coalesce(F.max(F.try_element_at("ends", F.lit(-1))).over(before) + 1, F.lit(0)).alias("begin"),
        (F.col("first") + F.col("n_tokens")).alias("last"),
        F.lead("block").over(Window.partitionBy("path").orderBy("block")).isNull().alias("closing"),
    )
    starts = F.concat(F.array("begin"), F.transform("ends", lambda x: x + 1))
    ends = F.when(F.col("closing"), F.concat("ends", F.array("last"))).otherwise(F.col("ends"))
    found = stitched.select("path", "nth", "last", F.size("ends").alias("closed"), F.posexplode(F.arrays_zip(starts.alias("a"), ends.alias("b"))).alias("i", "span"))
    found = found.where("span.b is not null and (i < closed or span.b > span.a)")
    return found.select("path", (F.col("nth") + F.col("i")).alias("nth"), F.col("span.a").alias("start"), (F.col("span.b") - F.col("span.a")).alias("n_tokens"), (F.col("i") < F.col("closed")).alias("closed"))


def count_documents(docs: DataFrame, folder: str, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens) per row of docs, counted in the token files that this writes into folder.

    The files name no documents: a document is found again by its file's task number and its place in the file, so docs
    must be a table as read (its rows come in the same order each time). A null or empty text has 0 tokens; a null key
    is kept; repeated rows are counted each; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    write_token_files(docs, folder, vocabulary, text)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(n, task, np.int32)), pa.array(np.arange(seen, seen + n))], names=[key, "task", "nth"])
            seen += n

    kind = docs.schema[key].dataType.simpleString()
    order = docs.select(key).mapInArrow(number, f"`{key}` {kind}, task int, nth long")
    found = document_lengths(spark, folder)
    found = found.select(F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"^part-(\d+)", 1).cast("int").alias("task"), "nth", "n_tokens")
    return order.join(found, ["task", "nth"]).select(key, "n_tokens")
