"""Where intermediate tables go, and small helpers that several operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints that driver and executors share.

    On a cluster it is the one that ``spark.checkpoint.dir`` names, or that was set on the context. Only where neither is
    there and all runs in one process (tests) is a temporary folder made and set; elsewhere executors would each write to
    a disk of their own, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="pagelode-checkpoint-")
    spark.sparkContext.setCheckpointDir(own)
    return own


_WRITTEN: list[str] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete on leaving what :func:`written` wrote within. Results are lazy and read those tables, so use them up inside."""
    before = len(_WRITTEN)
    try:
        yield
    finally:
        while len(_WRITTEN) > before:
            _delete(spark, _WRITTEN.pop())


def written(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and return that table.

    This cuts the lineage: a lost executor costs only the tasks that it ran, since the written files stay. With ``release``
    the driver gives its memory back afterwards (:func:`give_back`), upon which Spark deletes the shuffle files of the plan
    that has ended; else they stay until the driver happens to do so.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pagelode/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    _WRITTEN.append(path)
    if release:
        give_back(spark)
    return spark.read.schema(df.schema).parquet(path)


def give_back(spark: SparkSession) -> bool:
    """Collect the driver's garbage and return the free memory of its C heap; whether the JVM could do the latter.

    Hundreds of plans with hundreds of tasks each leave both behind: the C library keeps what threads and buffers of ended
    plans had, beside Java's heap and without its limit.
    """
    gc.collect()
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    jvm.System.gc()
    try:  # through the interface, since the class of the server isn't open to callers
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        given = gateway.new_array(jvm.java.lang.Object, 4)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(server, given)
    except Py4JError:  # not every JVM has it
        return False
    return True


def remove_written(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`written` that no later plan reads."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Small tables are broadcast up to so many rows; beyond, rows are dealt to SALTS times as many groups.
SMALL_ROWS, SALTS = 100_000, 32


def looked_up(rows: DataFrame, small: DataFrame, keys: dict[str, str]) -> DataFrame:
    """``rows`` with what ``small`` has for them (nulls equal nulls), else nulls. ``keys``: columns of rows and of small.

    ``small`` has one row for each key and is counted first. Where it is too many to broadcast, a key that holds a large
    part of the rows is split by a hash of the row.
    """
    same = F.lit(True)
    for a, b in keys.items():
        same &= F.col(f"`{a}`").eqNullSafe(F.col(f"`{b}`"))
    if small.count() <= SMALL_ROWS:
        return rows.join(F.broadcast(small), same, "left").drop(*keys.values())
    copies = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("__dealt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.lit(SALTS)).cast("int"))
    return dealt.join(copies, same & (F.col("__dealt") == F.col("__salt")), "left").drop(*keys.values(), "__dealt", "__salt")


BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """``mapInArrow`` in small batches, after each partition of which a worker gives its free memory back.

    Texts can be long, so the session's batches are set to at most ``BATCH_ROWS`` rows and about ``BATCH_BYTES`` bytes.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not every C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return df.mapInArrow(lean, schema)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; rows where it is 1 are held out of every fit."""
    return F.crc32(doc_id.cast("string")) % 3


def unit_hash(*cols: Column, seed: int = 0) -> Column:
    """A number in [0, 1) from a hash of the columns."""
    h = F.xxhash64(F.lit(seed), *cols)
    return F.shiftrightunsigned(h, 11).cast("double") * (2.0**-53)
