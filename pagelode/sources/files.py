"""Files of a folder tree, hashes, ignore rules and lists of texts as DataFrames."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: codes of the second field of a tabular list
LIST_CODES = ("ON", "OJR", "NA", "JRA", "YR", "GB")


def scan(spark: SparkSession, root: str, base: str | None = None) -> DataFrame:
    """PDF files below ``root`` (or that file itself): (relative_path, filename, last_modified, length). Names and folders that
    start with a dot, and names that start with a tilde, are left out; the content isn't read. The driver lists the folders,
    as it does for a table's files: Spark's readers hide names that start with an underscore, which belong here.
    """
    listing = _listed(spark, root)
    rel = relative_path(F.regexp_replace("path", F.lit("^[a-z]+:/*(?=/)"), F.lit("")), F.lit(base or root))
    found = listing.select(rel.alias("relative_path"), F.regexp_extract(rel, "([^/]+)$", 1).alias("filename"), "last_modified", "length")
    inside = F.col("relative_path") if base is None else relative_path(F.col("relative_path"), F.lit(root.removeprefix(base).strip("/")))
    return found.where(F.endswith(F.lower("filename"), F.lit(".pdf")) & ~F.regexp_like(inside, F.lit(r"(^|/)\.")) & ~F.startswith("filename", F.lit("~")))


def _listed(spark: SparkSession, root: str) -> DataFrame:
    """(path, last_modified, length) of all files below a path. Links are followed; a folder met again under its real name
    is not entered twice."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    start = jvm.org.apache.hadoop.fs.Path(root)
    fs = start.getFileSystem(conf)
    files, todo, seen = [], [start] if fs.exists(start) else [], set()
    while todo:
        folder = todo.pop()
        real = os.path.realpath(folder.toUri().getPath()) if fs.getScheme() == "file" else folder.toString()
        if real in seen:
            continue
        seen.add(real)
        for status in fs.listStatus(folder):
            path = status.getPath()
            if not status.isDirectory():
                files.append((path.toString(), status.getModificationTime() / 1000.0, status.getLen()))
            elif not path.getName().startswith("."):
                todo.append(path)
    return spark.createDataFrame(files, "path string, last_modified double, length bigint")


def contained(path: Column, root: str) -> Column:
    """Whether a path is the root or below it; dots and double slashes are resolved first."""
    clean = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), F.lit("/(?:\\.?/)+|/\\.$"), F.lit("/"))
    for _ in range(8):  # a name and the step up after it cancel each other, inmost first
        clean = F.regexp_replace(clean, F.lit(r"/(?!\.\./)[^/]+/\.\.(?=/|$)"), F.lit(""))
    clean = F.rtrim(clean, F.lit("/"))
    top = "/" + root.strip("/")
    return ((clean == top) | F.startswith(clean, F.lit(top + "/"))) & ~F.regexp_like(clean, F.lit(r"(^|/)\.\.(/|$)"))


def hashed(spark: SparkSession, root: str) -> DataFrame:
    """(path, file_hash): SHA-256 of the content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.sha2("content", 256).alias("file_hash"))


def relative_path(path: Column, base: Column) -> Column:
    """The path below ``base`` where it is there, with forward slashes; the name alone of a file that is the base itself."""
    p, b = (F.replace(x, F.lit("\\"), F.lit("/")) for x in (path, base))
    return F.when(p == b, F.regexp_extract(p, "([^/]+)$", 1)).when(F.startswith(p, F.concat(b, F.lit("/"))), F.substring(p, F.length(b) + 2, F.length(p))).otherwise(p)


def ignore_rules(lines: DataFrame, column: str = "value", folder: Column | None = None) -> DataFrame:
    """(root, rule) of ignore files: lines without blanks around, comments and empty lines left out. ``folder``: where each
    line's file lies, as a path like those of files; the top by default."""
    rule = F.btrim(F.replace(F.col(column), F.lit("\\"), F.lit("/")), F.lit(" \t\r\n"))
    return lines.select((F.lit("") if folder is None else folder).alias("root"), rule.alias("rule")).where((F.col("rule") != "") & ~F.startswith("rule", F.lit("#"))).distinct()


PARENTS = 10


def ignored(files: DataFrame, rules: DataFrame, path: str = "relative_path") -> DataFrame:
    """Paths that a rule of the nearest ignore file above them names, among PARENTS folders: by the name of their folder, by that
    folder or one above it (as a path from the ignore file's folder), by their name or by their whole path."""
    parts = F.split(F.col(path), "/")
    depth = F.size(parts) - 1  # folders above the file
    above = F.filter(F.transform(F.sequence(F.lit(0), depth), lambda i: F.when(depth - i < PARENTS, F.array_join(F.slice(parts, F.lit(1), i), "/"))), lambda x: x.isNotNull())
    spread = files.select(path, F.posexplode(above).alias("level", "root"))
    near = spread.join(rules.select("root").distinct(), "root", "left_semi").groupBy(path).agg(F.max_by("root", "level").alias("root"))
    inner = F.when(F.col("root") == "", F.col(path)).otherwise(F.substring(F.col(path), F.length("root") + 2, F.length(path)))
    near = near.withColumn("names", F.split(inner, "/"))
    n = F.size("names") - 1
    folders = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice("names", F.lit(1), i), "/"))
    keys = F.array_distinct(F.concat(F.when(n > 0, F.array_append(folders, F.get("names", n - 1))).otherwise(F.array().cast("array<string>")), F.array(F.get("names", n), inner)))
    return near.select(path, "root", F.explode(keys).alias("rule")).join(rules, ["root", "rule"], "left_semi").select(path).distinct()


def not_ignored(files: DataFrame, rules: DataFrame, path: str = "relative_path") -> DataFrame:
    return files.join(ignored(files, rules, path), path, "left_anti")


def text_list(lines: DataFrame, column: str = "value") -> DataFrame:
    """Titles of a list. If any line is tabular (its second field of three or more is one of the codes), only the third fields
    of such lines are titles; else every line is one. Empty titles are left out."""
    f = F.split(F.col(column), "\t")
    coded = F.coalesce((F.size(f) >= 3) & F.trim(F.get(f, 1)).isin(*LIST_CODES), F.lit(False))
    marked = lines.select(F.btrim(F.col(column), F.lit(" \t\r\n")).alias("line"), coded.alias("coded"), F.btrim(F.get(f, 2), F.lit(" \t\r\n")).alias("field"))
    tabular = marked.agg(F.coalesce(F.bool_or("coded"), F.lit(False)).alias("tabular"))  # one row
    title = F.when(~F.col("tabular"), F.col("line")).when(F.col("coded"), F.col("field"))
    return marked.join(F.broadcast(tabular)).select(title.alias("title")).where("title <> ''")


def query_list(lines: DataFrame, column: str = "value") -> DataFrame:
    return lines.select(F.trim(column).alias("query")).where((F.col("query") != "") & ~F.startswith("query", F.lit("#")))


SPANS = "file_id bigint, page_num int, page_width double, block int, line int, pos int, x0 double, x1 double, y0 double, size double, text string"


def spans(spark: SparkSession, path: str) -> DataFrame:
    """Spans of pages as an extractor wrote them, a line of JSON each. Lines that can't be read are left out, so that one bad
    page doesn't stop a library; :func:`..operators.structure.assembled` makes pages of them."""
    return spark.read.schema(SPANS).option("mode", "DROPMALFORMED").json(path)
