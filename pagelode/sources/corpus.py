"""Adapters that read the driver's tables as a library of files, pages and chapters.

A library is taken in once: its numbered pages (and what is made of them, such as postings) are written to the shared folder
and read from there by every query of the session. Without a folder that all executors share they are made anew each time.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

FILES = StructType([StructField("id", LongType()), StructField("filename", StringType()), StructField("relative_path", StringType()), StructField("last_modified", DoubleType()), StructField("file_hash", StringType())])
PAGES = StructType([StructField("file_id", LongType()), StructField("page_num", IntegerType()), StructField("text", StringType())])
CHAPTERS = StructType([StructField("file_id", LongType()), StructField("page_num", IntegerType()), StructField("title", StringType()), StructField("level", IntegerType())])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_FOLDERS: dict[str, str | None] = {}


def _folder(spark: SparkSession) -> str | None:
    """The folder of what the session takes in: below the checkpoint folder, or a temporary one where all runs in one process."""
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        named = spark.conf.get("spark.checkpoint.dir", None)
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if named or current.isDefined():
            _FOLDERS[app] = f"{(named or current.get()).rstrip('/')}/library-{app}"
        else:
            master = spark.sparkContext.master
            alone = master.startswith("local") and not master.startswith("local-cluster")
            _FOLDERS[app] = "file://" + tempfile.mkdtemp(prefix="pagelode-library-") if alone else None
    return _FOLDERS[app]


def _statuses(spark: SparkSession, source: str) -> list:
    """What the file system says of a file or folder, and of the files in it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [fs.getFileStatus(path)]
    return found + (list(fs.listStatus(path)) if found[0].isDirectory() else [])


def size(spark: SparkSession, source: str) -> int:
    """Bytes of a source's files."""
    return sum(f.getLen() for f in _statuses(spark, source))


def stored(spark: SparkSession, source: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` makes of a source's files, written on the first use and read afterwards; made anew if the files change."""
    folder = _folder(spark)
    if folder is None:
        return make()
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = _statuses(spark, source)
    state = "|".join(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in found)
    at = f"{folder}/{name}-{hashlib.sha256(state.encode()).hexdigest()[:24]}"
    done = jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
    if not done.getFileSystem(conf).exists(done):
        made = make()
        made.write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)


#: Ids are numbered in ranges of about so many rows, of which there are at most so many.
RANGE_ROWS, MOST_RANGES = 10_000, 200


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volumes: each source of ``documents`` is a file, its documents are the pages in the order of their ids.

    A source can hold a large part of all texts. So ids are cut into ranges, pages are numbered within a range of their
    source, and the pages of the ranges before are added from narrow counts: no task sorts a whole source.
    """
    docs = table(spark, sf_dir, "documents")
    n = min(MOST_RANGES, docs.count() // RANGE_ROWS)
    cuts = sorted({int(c) for c in docs.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.001)}) if n > 1 else []
    at = F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: c <= F.col("doc_id"))) if cuts else F.lit(0)
    placed = docs.withColumn("range", F.when(F.col("doc_id").isNull(), -1).otherwise(at)).withColumn("key", F.coalesce("source", F.lit("")))
    sizes = placed.groupBy("key", "range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("key", "range", before.alias("before"))
    rows = placed.select("key", "range", "source", "text", F.row_number().over(Window.partitionBy("key", "range").orderBy("doc_id")).alias("i"))
    number = (F.col("before") + F.col("i")).cast("int")
    return rows.join(starts, ["key", "range"]).select((F.substring("source", 4, 10).cast("long") + 1).alias("file_id"), number.alias("page_num"), "text")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, f"{sf_dir}/documents.parquet", "pages", lambda: numbered(spark, sf_dir))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.substring("source", 4, 10)
    name = F.concat(F.lit("Volume "), n, F.lit(".pdf"))
    deep = F.concat(F.lit("shelf"), (n.cast("int") % 3).cast("string"), F.lit("/set"), (n.cast("int") % 2).cast("string"), F.lit("/"), name)
    return table(spark, sf_dir, "documents").select("source").distinct().select(
        (n.cast("long") + 1).alias("id"), name.alias("filename"), F.when(n.cast("int") % 5 == 0, name).otherwise(deep).alias("relative_path"),
        (F.lit(1700000000.0) + n.cast("int")).alias("last_modified"), F.sha2(name, 256).alias("file_hash"),
    )


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part each five pages and a section in its middle."""
    p = pages(spark, sf_dir).select("file_id", "page_num")
    part = p.where("(page_num - 1) % 5 = 0").select("file_id", "page_num", F.concat(F.lit("Part "), F.col("page_num").cast("string")).alias("title"), F.lit(1).alias("level"))
    section = p.where("(page_num - 1) % 5 = 2").select("file_id", "page_num", F.concat(F.lit("Section "), F.col("page_num").cast("string")).alias("title"), F.lit(2).alias("level"))
    return part.unionByName(section)


def conversation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file_id"), (F.col("turn") + 1).cast("int").alias("page_num"), "text")
