"""Session helpers: where intermediate results are pinned, and dense serial ids."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("roadweave")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: `spark.checkpoint.dir`, or a temporary one in local mode only."""
    sc = spark.sparkContext
    folder = sc.getCheckpointDir()
    if folder:
        return folder
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="roadweave-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def pin(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so that a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


MANY_ROWS = 100_000  # a broadcast of that many rows of a few numbers takes some ten MB of the driver


def pin_table(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: gives the optimizer real sizes for its join choice.

    Sizes of files say little of what a broadcast takes: columns are compressed, and a few columns of a wide table count by
    their share of the schema, however empty the others are. So the rows are counted (from the footers), and a table of many
    is marked to be joined by shuffling, unless a join asks for a broadcast of its own.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    return found.hint("merge") if found.count() > MANY_ROWS else found


def side_by_side(*jobs: Callable):
    """Run independent chains of jobs at the same time; Spark shares its cores among them.

    The loops here wait for the slowest task of each round, and another chain can use the idle cores.
    """
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [f.result() for f in [pool.submit(job) for job in jobs]]


_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in its lower 33 bits


def dense_serial(df: DataFrame, order: list[str | Column], name: str, start: int = 1) -> DataFrame:
    """Number rows 1, 2, 3, … in the given order without gathering them in one task.

    Range partitioning sorts globally; each partition numbers its own rows, and only one row per
    partition (its size) is summed up to get the offsets.
    """
    numbered = pin(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_m", F.monotonically_increasing_id())
        .withColumns({"_part": F.shiftright("_m", _ROW_BITS), "_row": F.col("_m").bitwiseAND((1 << _ROW_BITS) - 1)})
        .drop("_m")
    )
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        numbered.groupBy("_part")
        .agg(F.count("*").alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    # one row per partition of `numbered`, so the broadcast is bounded by the partition count
    return (
        numbered.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_row") + F.col("_offset") + F.lit(start))
        .drop("_part", "_row", "_offset")
    )
