"""Written intermediate tables, row identity and running totals over sorted tables."""

from __future__ import annotations

import uuid

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintlake.session import shared_folder

_steps: list[str] = []  # the folder of the step that was begun last


def fresh_path(spark, name: str) -> str:
    """A new folder for one table, below the run's folder; all executors share it."""
    return f"{_steps[-1] if _steps else run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def run_folder(spark) -> str:
    """Where the intermediate tables of this application lie; :func:`clear` deletes it."""
    return f"{shared_folder(spark)}/llm-{spark.sparkContext.applicationId}"


def _delete(spark, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark) -> None:
    """Deletes all intermediate tables of this application; results that were not written elsewhere go with them."""
    _delete(spark, run_folder(spark))


def begin(spark, docs: DataFrame) -> None:
    """Starts a step of its own over ``docs``: drops the tables and shuffles of the step before, and keeps new ones together.

    Steps write their results before the next one begins.  Where ``docs`` still reads tables of the step before, those stay.
    """
    folder = f"{run_folder(spark)}/step-{uuid.uuid4().hex}"
    if _steps:
        before = _steps.pop()
        if not any(f"/{before.rsplit('/', 1)[1]}/" in file for file in docs.inputFiles()):
            _delete(spark, before)
            release(spark, at_once=True)
    _steps.append(folder)


def end(spark) -> None:
    """Ends the step that was begun last, whose result is written, and drops its tables."""
    if _steps:
        _delete(spark, _steps.pop())


def release(spark, at_once: bool = False) -> None:
    """Lets the driver forget plans, broadcasts and shuffles that nothing refers to, at once or when a quarter of its heap is in use.

    Spark frees broadcasts and shuffle files on all machines when the driver collects its
    references to them, which a driver that only plans may otherwise put off for long.  Its
    heap grows meanwhile: on small tables most joins are broadcasts, of a page each at least.
    """
    jvm = spark.sparkContext._jvm
    runtime = jvm.java.lang.Runtime.getRuntime()
    if at_once or 4 * (runtime.totalMemory() - runtime.freeMemory()) > runtime.maxMemory():
        jvm.java.lang.System.gc()


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = path or fresh_path(spark, name)
    df.write.parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def text_hash(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(text).isNull())


def running(df: DataFrame, keys: list[str], amount: str, out: str, name: str) -> DataFrame:
    """Adds the total of ``amount`` over all rows that sort before a row, as ``out``.

    Rows are dealt out by ranges of ``keys`` and sorted in each; each task adds up its own
    rows, and the totals of the tasks (one row each) give every task its start.  No task sees
    another one's rows.  Ties in ``keys`` are in no fixed order, so keys should be unique.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("_pid", T.IntegerType()), T.StructField("_before", T.LongType())])

    def add_up(batches):
        import numpy as np
        import pyarrow as pa

        pid, so_far = TaskContext.get().partitionId(), 0
        for batch in batches:
            values = batch.column(amount).to_numpy(zero_copy_only=False).astype(np.int64)
            before = so_far + np.concatenate([[0], np.cumsum(values)[:-1]]) if len(values) else values
            so_far += int(values.sum())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(values), pid, np.int32)), pa.array(before, pa.int64())],
                names=[*batch.schema.names, "_pid", "_before"],
            )

    parts = df.repartitionByRange(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)
    local = written(parts.mapInArrow(add_up, schema), name)
    totals = local.groupBy("_pid").agg(F.max(F.col("_before") + F.col(amount)).alias("_sum")).collect()  # one row a task
    starts, start = [], 0
    for row in sorted(totals, key=lambda r: r["_pid"]):
        starts.append((row["_pid"], start))
        start += row["_sum"]
    offsets = df.sparkSession.createDataFrame(starts, "_pid int, _start long")
    return local.join(F.broadcast(offsets), "_pid").withColumn(out, F.col("_start") + F.col("_before")).drop("_pid", "_start", "_before")
