"""Continuous refresh: a file stream whose batches rebuild what has changed."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

log = logging.getLogger(__name__)
#: Quiet time between refreshes.
TRIGGER = "400 milliseconds"


def start_watch(spark: SparkSession, root: str, refresh: Callable[[], object], checkpoint: str, name: str, once: bool = False) -> StreamingQuery:
    """Call ``refresh`` for every batch of new or changed files below ``root``.

    A second start under the same name gives the running query. A failing refresh is logged
    and the stream goes on. ``once`` takes what is there and stops.
    """
    for q in spark.streams.active:
        if q.name == name:
            return q
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", True).load(root)

    def batch(df: DataFrame, _: int) -> None:
        if df.isEmpty():
            return
        try:
            refresh()
        except Exception:  # the next change gets another try
            log.exception("refresh of %s failed", root)

    writer = files.select("path", "modificationTime").writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=TRIGGER)).start()


def stop_watch(spark: SparkSession, name: str) -> bool:
    for q in spark.streams.active:
        if q.name == name:
            q.stop()
            return True
    return False


def watch_status(query: StreamingQuery) -> dict:
    return {"name": query.name, "active": query.isActive, "refreshes": sum(1 for p in query.recentProgress if p["numInputRows"]), "message": query.status["message"]}


def stream_counts(spark: SparkSession, path: str, schema: str, keys: list[str], out: str, checkpoint: str) -> DataFrame:
    """Counts per key of a table that arrives as files, kept by state and written after every batch.

    Takes what is there, then stops; called again, it continues from the checkpoint with new files only.
    """
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).isFile(at):  # a stream reads folders only
        path, _, name = path.rpartition("/")
        reader = reader.option("pathGlobFilter", name)
    arriving = reader.parquet(path)
    counted = arriving.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))

    def save(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch-{batch:09d}")

    counted.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(save).trigger(availableNow=True).start().awaitTermination()
    at = jvm.org.apache.hadoop.fs.Path(out)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    last = sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []
    return spark.read.parquet(f"{out}/{last[-1]}") if last else spark.createDataFrame([], schema).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
