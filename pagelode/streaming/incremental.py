"""Incremental maintenance as a stream: micro-batches of documents are merged into a versioned snapshot of the library."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import maintain
from ..sources.corpus import FILES, PAGES


class Snapshot:
    """Tables in versions below a folder; a version counts once its marker is written, so a failed write changes nothing."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _current(self) -> str | None:
        fs, path = self._fs()
        marks = path(f"{self.root}/versions")
        names = sorted(s.getPath().getName() for s in fs.listStatus(marks)) if fs.exists(marks) else []
        return names[-1] if names else None

    def read(self, table: str, schema: StructType) -> DataFrame:
        version = self._current()
        if version is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{version}/{table}")

    def replace(self, tables: dict[str, DataFrame]) -> None:
        last = self._current()
        version = f"v{(int(last[1:9]) if last else 0) + 1:08d}-{uuid.uuid4().hex[:8]}"
        for name, df in tables.items():
            df.write.parquet(f"{self.root}/{version}/{name}")
        fs, path = self._fs()
        fs.create(path(f"{self.root}/versions/{version}"), True).close()

    def wipe(self) -> None:
        self.replace({"files": self.spark.createDataFrame([], FILES), "pages": self.spark.createDataFrame([], PAGES)})


def merge(snapshot: Snapshot, batch: DataFrame) -> None:
    """Upsert documents (filename, relative_path, last_modified, file_hash, pages array<struct<page_num, text>>) as one version."""
    files, pages = snapshot.read("files", FILES), snapshot.read("pages", PAGES)
    one = batch.dropDuplicates(["relative_path"])
    merged = maintain.upserted(files, one.select("filename", "relative_path", "last_modified", "file_hash"))
    ids = merged.select(F.col("id").alias("file_id"), "relative_path")
    new = one.join(ids, "relative_path").select("file_id", F.explode("pages").alias("p")).select("file_id", F.col("p.page_num").cast("int").alias("page_num"), F.col("p.text").alias("text"))
    touched = one.join(ids, "relative_path").select("file_id")
    kept = pages.join(touched, "file_id", "left_anti")
    snapshot.replace({"files": merged, "pages": kept.unionByName(new)})


def follow(documents: DataFrame, snapshot: Snapshot, checkpoint: str) -> StreamingQuery:
    """Merge all that has come since the last run; a stream of documents is read to its present end."""
    return documents.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: merge(snapshot, df)).start()
