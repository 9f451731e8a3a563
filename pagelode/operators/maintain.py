"""Incremental maintenance of the library's tables: what changed, and merging it in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def changes(listing: DataFrame, files: DataFrame) -> DataFrame:
    """Status of each listed file (relative_path, last_modified): 'index' if unknown, 'reindex' if newer, else 'skip'."""
    known = files.select("relative_path", F.col("last_modified").alias("known"))
    return listing.join(known, "relative_path", "left").select(
        "relative_path", "last_modified", F.when(F.col("known").isNull(), "index").when(F.col("last_modified") > F.col("known"), "reindex").otherwise("skip").alias("status")
    )


def renames(listing: DataFrame, files: DataFrame) -> DataFrame:
    """(id, old_path, relative_path, filename, last_modified): new paths with the hash of a file that is gone. The first gone
    file by id wins, and it goes to the first new path."""
    new = listing.join(files.select("relative_path"), "relative_path", "left_anti").where("file_hash is not null")
    gone = files.join(listing.select("relative_path"), "relative_path", "left_anti").select("id", F.col("relative_path").alias("old_path"), "file_hash")
    pairs = new.join(gone, "file_hash")
    one = pairs.withColumn("r", F.row_number().over(Window.partitionBy("relative_path").orderBy("id"))).where("r = 1")
    one = one.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("relative_path"))).where("r = 1")
    return one.select("id", "old_path", "relative_path", "filename", "last_modified")


def deleted(files: DataFrame, listing: DataFrame, root: str = "") -> DataFrame:
    """Files under ``root`` (a plain prefix) that the listing doesn't have."""
    return files.where(F.startswith("relative_path", F.lit(root))).join(listing.select("relative_path"), "relative_path", "left_anti")


def renamed(files: DataFrame, moves: DataFrame) -> DataFrame:
    """Files with path, name and time of the moves (id, relative_path, filename, last_modified); contents keep their ids."""
    m = moves.select("id", *[F.col(c).alias("new_" + c) for c in ("relative_path", "filename", "last_modified")])
    return files.join(m, "id", "left").select(
        "id", *[F.coalesce("new_" + c, c).alias(c) for c in ("filename", "relative_path", "last_modified")], "file_hash"
    )


def upserted(files: DataFrame, new: DataFrame) -> DataFrame:
    """Files after an upsert by path: known ones get time and hash (not the name), unknown ones an id after the largest.

    New ids come from ranks within ranges of the paths, so no task numbers all new files.
    """
    update = new.select("relative_path", F.col("last_modified").alias("m"), F.col("file_hash").alias("h"))
    kept = files.join(update, "relative_path", "left").select("id", "filename", "relative_path", F.coalesce("m", "last_modified").alias("last_modified"), F.when(F.col("m").isNotNull(), F.col("h")).otherwise(F.col("file_hash")).alias("file_hash"))
    fresh = new.join(files.select("relative_path"), "relative_path", "left_anti").dropDuplicates(["relative_path"])
    part = F.pmod(F.xxhash64("relative_path"), F.lit(64)).cast("int")
    ranked = fresh.withColumn("p", part).withColumn("r", F.row_number().over(Window.partitionBy("p").orderBy("relative_path")))
    sizes = ranked.groupBy("p").agg(F.count("*").alias("n"))
    offset = F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # 64 rows
    starts = sizes.select("p", offset.alias("o"))
    top = files.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))  # one row
    numbered = ranked.join(F.broadcast(starts), "p").join(F.broadcast(top)).select((F.col("top") + F.col("o") + F.col("r")).alias("id"), "filename", "relative_path", "last_modified", "file_hash")
    return kept.unionByName(numbered)


def replaced_pages(pages: DataFrame, new: DataFrame, key: str = "file_id") -> DataFrame:
    """Rows of the files in ``new`` replaced as a whole; works for pages and for chapters."""
    return pages.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def without_files(rows: DataFrame, gone: DataFrame, key: str = "file_id") -> DataFrame:
    """Pages or chapters without those of deleted files (cascade)."""
    return rows.join(gone.select(F.col("id").alias(key)), key, "left_anti")


def inserted_or_ignored(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return target.unionByName(new.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti"))


def normalized_paths(files: DataFrame) -> DataFrame:
    """Backslashes in paths become slashes; a file whose new path is taken already goes."""
    plain = F.replace("relative_path", F.lit("\\"), F.lit("/"))
    odd = F.contains("relative_path", F.lit("\\"))
    good = files.where(~odd)
    fixed = files.where(odd).withColumn("relative_path", plain).join(good.select("relative_path"), "relative_path", "left_anti")
    first = fixed.withColumn("r", F.row_number().over(Window.partitionBy("relative_path").orderBy("id"))).where("r = 1").drop("r")
    return good.unionByName(first.select(*files.columns))


def todo_lists(statuses: DataFrame) -> DataFrame:
    """(path, reason) of files whose text is missing or to be read again."""
    return statuses.where(F.col("status").isin("missing", "redo")).select("path", F.col("status").alias("reason"))


def migrated(table: DataFrame, schema: StructType, defaults: dict[str, object] | None = None) -> DataFrame:
    """A table of an earlier version in the columns of ``schema``: missing ones get their default or null, others go."""
    made: list[Column] = []
    for f in schema.fields:
        value = F.col(f"`{f.name}`") if f.name in table.columns else F.lit((defaults or {}).get(f.name))
        made.append(value.cast(f.dataType).alias(f.name))
    return table.select(*made)


def outcomes(listing: DataFrame, extracted: DataFrame) -> DataFrame:
    """(relative_path, status, pages) of listed files. ``extracted``: (relative_path, error, encrypted, ocr_status, pages).

    A file that raised an error, is encrypted or didn't come back has 'failed'; one whose text is to be read by OCR has
    'needs_ocr_missing' or 'needs_ocr_redo'; the others are 'indexed'. Only these keep their pages.
    """
    rows = listing.select("relative_path").join(extracted, "relative_path", "left")
    failed = F.col("error").isNotNull() | F.coalesce("encrypted", F.lit(False)) | F.col("pages").isNull()
    status = F.when(failed, F.lit("failed")).when(F.col("ocr_status").isNotNull(), F.concat(F.lit("needs_ocr_"), F.col("ocr_status"))).otherwise(F.lit("indexed"))
    return rows.select("relative_path", status.alias("status"), F.when(status == "indexed", F.col("pages")).alias("pages"))
