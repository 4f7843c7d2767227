"""Sessions, and the shared folder in which long jobs cut their lineage.

Staged tables live in the folder that the cluster names in ``spark.checkpoint.dir``; executors can be lost
at any time, and a staged table is read again instead of being computed again. Only on a local master may that setting be
absent (tests, a laptop); then a folder of our own is made. A staged table goes when it is dropped, or when the session ends.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_STAGED: "weakref.WeakKeyDictionary[DataFrame, str]" = weakref.WeakKeyDictionary()


def local_session(cpus: str | int = "*", partitions: int = 8, app: str = "sparkloom", memory: str = "20g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where that is unset and all executors are threads of this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
    return _OWN[app]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: For rows of some MB each: a Parquet writer looks at its size after a hundred rows only, and a reader holds a row group whole.
WIDE = {"parquet.block.size": str(4 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}


def stage(df: DataFrame, name: str, wide: bool = False) -> DataFrame:
    """Writes ``df`` to the shared folder and returns it as read from there; its lineage ends here. Rows that are ``wide`` stand in row groups of a few MB."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **(WIDE if wide else {})).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    _STAGED[back] = path
    atexit.register(_forget, weakref.ref(spark), path)
    return back


def _forget(ref, path: str) -> None:
    spark = ref()
    try:
        if spark is not None and spark._jsc.sc() is not None and not spark._jsc.sc().isStopped():
            _delete(spark, path)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        pass


def drop(*staged: DataFrame) -> None:
    """Deletes staged tables that no later step reads, then lets the cleaner free finished shuffles."""
    for df in staged:
        if path := _STAGED.pop(df, None):
            _delete(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Shuffle files go once nothing refers to them; the driver's collectors are told to look now, and its JVM gives freed memory back."""
    gc.collect()
    spark._jvm.System.gc()
    _trim(spark)


def _trim(spark: SparkSession) -> None:
    """Planning and compiling hundreds of queries leaves freed native memory spread over the C library's arenas, where it counts as the driver's.
    The JVM returns it by a command of its own (``jcmd System.trim_native_heap``, here by its management interface); a JVM without that command keeps it."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway

    def array(kind, *items):
        made = gateway.new_array(kind, len(items))
        for i, x in enumerate(items):
            made[i] = x
        return made

    named = jvm.java.lang.Class.forName
    try:
        kinds = array(jvm.java.lang.Class, *map(named, ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")))
        invoke = named("javax.management.MBeanServer").getMethod("invoke", kinds)
        commands = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), array(jvm.java.lang.Object, commands, "systemTrimNativeHeap", None, None))
    except Py4JError:
        pass


def dealt(df: DataFrame) -> DataFrame:
    """``df`` for a join by shuffle. Sorted numbers and constant columns make small files, so the size of a table's files does not tell
    whether it may be sent whole; a side that grows with the input must not be, for it would pass the driver."""
    return df.hint("merge")


def width(spark: SparkSession) -> int:
    """The number of shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _parts(batches: Iterator[pa.RecordBatch], records: int, size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        waiting = [batch]
        while waiting:
            one = waiting.pop()
            if one.num_rows > 1 and (one.num_rows > records or one.nbytes > size):
                half = one.num_rows // 2
                waiting += [one.slice(half), one.slice(0, half)]
            else:
                yield one


def bounded(f: Callable, records: int = 2000, size: int = 4 << 20) -> Callable:
    """A function for ``mapInArrow`` whose batches hold at most ``records`` rows and ``size`` bytes (a longer row comes alone), whatever the session's limits are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return f(_parts(batches, records, size))

    return run
