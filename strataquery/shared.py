"""Durable intermediate tables, sized broadcasts and row numbers, as all operators share them."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Largest table, in estimated bytes, that is broadcast; beyond it the same join shuffles.
BROADCAST_BYTES = 16 * 1024 * 1024

#: Bytes that each row of a hashed relation needs besides its columns, as measured.
HASHED_ROW_BYTES = 150


#: At most this many keys have more than 1/HOT_KEYS of all rows each, so that their table is always small.
HOT_KEYS = 50_000

_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir. A local one is made only where that is unset and the
    session runs on one machine; it goes with the process."""
    context = spark.sparkContext
    there = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not there:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="strataquery-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        there = f"file:{folder}"
    if not context.getCheckpointDir():
        context.setCheckpointDir(there)
    return there


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def clear_intermediates(spark: SparkSession) -> int:
    """Deletes the folders named by new_path() in this process and returns how many. To be called once results are written;
    checkpoints are Spark's own to delete (spark.cleaner.referenceTracking.cleanCheckpoints)."""
    conf, n = spark._jsc.hadoopConfiguration(), len(_made)
    while _made:
        at = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        at.getFileSystem(conf).delete(at, True)
    return n


def fresh(df: DataFrame, name: str) -> str:
    """name, with as many underscores more as it takes to differ from every column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def pin(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and cuts its lineage: lost executors never change or repeat what it holds."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fits(rows: int, row_bytes: int) -> bool:
    """Whether a table of that many rows may be broadcast."""
    return rows * (row_bytes + HASHED_ROW_BYTES) <= BROADCAST_BYTES


def sized(keys: DataFrame, row_bytes: int, rows: int | None = None) -> DataFrame:
    """keys with a broadcast hint if its counted rows are within BROADCAST_BYTES; otherwise as it is, for a shuffled join."""
    return F.broadcast(keys) if fits(keys.count() if rows is None else rows, row_bytes) else keys


def split_join(left: DataFrame, keys: DataFrame, on: str, total: int, row_bytes: int, how: str = "inner", n: str = "n") -> DataFrame:
    """left joined with keys, which has each value of ``on`` once and in column ``n`` the rows of left that have it; total: rows of left.

    Within BROADCAST_BYTES keys is broadcast. Beyond, only the hot keys are, those with over total / HOT_KEYS rows, of which
    there are HOT_KEYS at most; the other rows are shuffled, and rows of a hot key never meet in one task.
    """
    if fits(keys.count(), row_bytes):
        return left.join(F.broadcast(keys), on, how)
    is_hot = F.col(n) * HOT_KEYS > total
    hot, cold = F.broadcast(keys.where(is_hot)), keys.where(~is_hot)
    return left.join(hot, on, "left_semi" if how == "left_semi" else "inner").unionByName(left.join(hot.select(on), on, "left_anti").join(cold, on, how))


def dense_numbers(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with ``name``: 0.. in the given order (null last), from one range exchange and a count per part, never in one task."""
    by = [F.col(c).asc_nulls_last() for c in order]
    at, part, start = fresh(rows, "at"), fresh(rows, "part"), fresh(rows, "start")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    local = pin(rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn(at, F.monotonically_increasing_id())).withColumn(part, F.shiftright(at, 33))
    counts = local.groupBy(F.col(part).alias("p")).agg(F.count("*").alias("n"))
    # one row per part
    starts = pin(counts.select(F.col("p").alias(part), (F.sum("n").over(W.orderBy("p")) - F.col("n")).alias(start)))
    return local.join(sized(starts, 16), part).withColumn(name, F.col(start) + F.col(at).bitwiseAND(F.lit(2**33 - 1))).select(*rows.columns, name)


#: Rows and bytes of an Arrow batch of texts; Spark's own bound of 10,000 rows alone would let long texts fill a worker.
BATCH_ROWS = 1000
BATCH_BYTES = 8 * 1024 * 1024


def bound_batches(spark: SparkSession) -> None:
    """Holds the session's Arrow batches within BATCH_ROWS and BATCH_BYTES; smaller bounds of the user's stay. Plans are run after the call, so the bound stays."""
    for key, bound in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = re.match(r"-?\d+", spark.conf.get(key))
        if not now or not 0 < int(now[0]) <= bound:
            spark.conf.set(key, str(bound))


#: Tables below this size, by the planner's estimate, are dealt over all cores by spread().
SPREAD_BYTES = 256 * 1024 * 1024


def spread(df: DataFrame) -> DataFrame:
    """df over twice as many parts as there are cores, if it is small: one small file is one task, however much work its rows make.
    A large table stays as its files lie."""
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SPREAD_BYTES:
        return df
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism)
