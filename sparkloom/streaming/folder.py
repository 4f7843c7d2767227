"""A folder as a stream of changes: each tick lists the tree, compares it with the listing last applied, and hands on what was added, edited or deleted.

The listing is a Spark job and the comparison a join, so a tree may be as large as a table. The listing that was applied lies in a folder of its own in ``state`` and takes the place of the
one before only after ``apply`` has come back: a tick that fails, or a driver that is lost, costs nothing, for the next tick finds the same changes and newer ones. So a change is
handed on at least once, and edits between two ticks come as one. A change is seen by a file's size and time in ms; an edit that keeps both is not.

Defined cases: a tree that was never seen is all additions; a folder that is gone or empty is all deletions; after a failure the next tries wait 2, 4, up to ``SLOWEST`` ticks.
"""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.sources import files as S

LISTING = "path string, size long, mtime long"
SLOWEST = 64
log = logging.getLogger(__name__)
Progress = Callable[[dict], None]


def moved(now: DataFrame, before: DataFrame) -> DataFrame:
    """path, event (add, change, unlink) between two listings (path, size, mtime)."""
    a, b = now.select("path", F.struct("size", "mtime").alias("_now")), before.select("path", F.struct("size", "mtime").alias("_was"))
    event = F.when(F.col("_was").isNull(), "add").when(F.col("_now").isNull(), "unlink").when(~F.col("_now").eqNullSafe(F.col("_was")), "change")
    return a.join(b, "path", "full_outer").select("path", event.alias("event")).filter("event is not null")


class State:
    """The listings below ``folder``: the newest whole one counts."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def numbers(self) -> list[int]:
        fs, at = self._fs(self.folder)
        names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n.removeprefix("listing-")) for n in names if n.startswith("listing-"))

    def _place(self, number: int) -> str:
        return f"{self.folder}/listing-{number:012d}"

    def last(self) -> DataFrame:
        known = self.numbers()
        return self.spark.read.schema(LISTING).parquet(self._place(known[-1])) if known else self.spark.createDataFrame([], LISTING)

    def draft(self, listing: DataFrame) -> str:
        place = f"{self.folder}/draft-{uuid.uuid4().hex}"
        listing.select("path", F.col("size").cast("long").alias("size"), "mtime").write.parquet(place)
        return place

    def read(self, place: str) -> DataFrame:
        return self.spark.read.schema(LISTING).parquet(place)

    def forget(self, place: str) -> None:
        fs, at = self._fs(place)
        fs.delete(at, True)

    def advance(self, draft: str) -> None:
        """The draft becomes the newest listing; older ones go. A rename: there or not there."""
        known = self.numbers()
        target = self._place(known[-1] + 1 if known else 0)
        fs, at = self._fs(draft)
        if not fs.rename(at, self._fs(target)[1]):
            raise OSError(f"cannot move {draft} to {target}")
        for n in known:
            self.forget(self._place(n))


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path, size, mtime of the files a walk takes in, ignore files of the tree applied; nothing where the folder is gone."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], LISTING)
    return S.list_files(spark, root, S.nested_rules(S.ignore_files(spark, root)))


def tick(spark: SparkSession, root: str, state: State, apply: Callable[[DataFrame], None], progress: Progress | None = None) -> int:
    """One look at the folder: hands the changes (path, event) to ``apply`` if there are any and remembers them once it is done. How many there were."""
    tell = progress or (lambda said: None)
    tell({"phase": "scanning", "root": root})
    draft = state.draft(listing(spark, root))
    try:
        changes = moved(state.read(draft), state.last()).cache()
        counts = {r["event"]: r["count"] for r in changes.groupBy("event").count().collect()}
        tell({"phase": "changed", **{e: counts.get(e, 0) for e in ("add", "change", "unlink")}})
        if counts:
            apply(changes)
            state.advance(draft)
        changes.unpersist()
        tell({"phase": "done", "changes": sum(counts.values())})
        return sum(counts.values())
    finally:
        state.forget(draft)


def watch(spark: SparkSession, root: str, state: str, apply: Callable[[DataFrame], None], every: str = "1 second", once: bool = False, progress: Progress | None = None):
    """Starts the streaming query whose every batch is a ``tick``; never two at a time. ``once`` looks once and ends. ``state`` is a folder that driver and executors share."""
    clock = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("numPartitions", 1).load()
    kept = State(spark, f"{state.rstrip('/')}/listings")
    wait = {"failures": 0, "left": 0}

    def sink(batch: DataFrame, number: int) -> None:
        if wait["left"]:
            wait["left"] -= 1
            return
        try:
            tick(spark, root, kept, apply, progress)
            wait["failures"] = 0
        except Exception as e:  # noqa: BLE001  one bad tick must not end the watch: its changes come again
            wait["failures"] += 1
            wait["left"] = min(2 ** wait["failures"], SLOWEST) - 1
            log.exception("tick %d failed", number)
            if progress:
                progress({"phase": "failed", "message": str(e)[:500], "wait": wait["left"]})

    writer = clock.writeStream.foreachBatch(sink).option("checkpointLocation", f"{state.rstrip('/')}/clock")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
