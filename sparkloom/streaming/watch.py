"""File changes as a stream: a change log in a folder, quiet periods as sessions, waves, and a sink that applies them one after the other.

Spark's file source does not see edits of a file it has read, so a watcher appends one small file per change to a log folder. A wave that fails
is logged, its paths are kept beside the checkpoint and come again with the next wave, and the stream goes on; deletes are left to the next full walk.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.ordering import global_position
from sparkloom.sources.files import walk_ignored

CHANGE = "path string, event string, ts timestamp"
WAVE = 200
log = logging.getLogger(__name__)


def changes(spark: SparkSession, folder: str, per_trigger: int = WAVE) -> DataFrame:
    """The stream of changes from a log folder of JSON lines, without paths that are always passed over."""
    stream = spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", per_trigger).json(folder)
    return stream.filter(~walk_ignored(F.col("path")))


def debounce(events: DataFrame, quiet: str = "300 milliseconds", *keys: str) -> DataFrame:
    """start, end, changes and the distinct paths of each run of events no further apart than the quiet period. On a stream with a watermark, or a table."""
    window = F.session_window("ts", quiet).alias("w")
    out = events.groupBy(*keys, window).agg(F.count("*").alias("changes"), F.sort_array(F.collect_set("path")).alias("paths"))
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "changes", "paths")


def waves(paths: DataFrame, size: int = WAVE) -> DataFrame:
    """Adds ``wave``: at most ``size`` paths each, in order of path."""
    return global_position(paths, [F.col("path")], "_p").withColumn("wave", F.floor(F.col("_p") / size)).drop("_p", "total")


def apply_changes(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False):
    """Starts the query that hands each batch's distinct paths to ``apply``, never two at a time."""

    retry = f"{checkpoint.rstrip('/')}-retry"

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        paths = batch.select("path").distinct()
        jvm = spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(retry)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        old = [f.getPath() for f in fs.listStatus(at)] if fs.exists(at) else []
        if old:
            paths = paths.unionByName(spark.read.schema("path string").parquet(*(str(f) for f in old))).distinct()
        try:
            apply(paths, number)
        except Exception:  # noqa: BLE001  one bad wave must not end the watch
            log.exception("wave %d failed", number)
            paths.write.mode("overwrite").parquet(f"{retry}/wave-{number:09d}")
            old = [f for f in old if f.getName() != f"wave-{number:09d}"]
        # Only now that they are applied, or kept again, may the earlier ones go.
        for f in old:
            fs.delete(f, True)

    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="300 milliseconds")).start()


def drain(query) -> None:
    """Lets what has arrived through, then stops."""
    query.processAllAvailable()
    query.stop()
