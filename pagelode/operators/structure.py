"""Structure of documents: spans to pages, headers and footers, tables of contents, boilerplate chapters, page overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cleaning, rules, text

LEAST_PAGES = 8
OVERLAP = 300


# ---- spans to text ----


def reading_order(blocks: DataFrame) -> DataFrame:
    """Blocks (file_id, page_num, page_width, x0, y0, text) with ``pos``: by strips of 40 % of the page's width, then downwards."""
    strip = (F.col("x0") / (F.col("page_width") / 2.5)).cast("int")
    return blocks.withColumn("pos", F.row_number().over(Window.partitionBy("file_id", "page_num").orderBy(strip, "y0", "x0")))


def spans_to_lines(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Spans (keys, pos, text, x0, x1, size) joined to lines: a blank where a gap over 0.15 of the size has none yet."""
    by = Window.partitionBy(*keys).orderBy("pos")
    before, edge = F.lag("text").over(by), F.lag("x1").over(by)
    spaced = F.regexp_like(before, F.lit(r"(?U)\s\z")) | F.regexp_like("text", F.lit(r"(?U)\A\s"))
    closing = F.regexp_like("text", F.lit("\\A[.,!?:;'\"’”\\] ]"))
    gap = before.isNotNull() & (F.col("x0") - edge > F.col("size") * 0.15) & ~spaced & ~closing
    parts = spans.withColumn("part", F.concat(F.when(F.coalesce(gap, F.lit(False)), F.lit(" ")).otherwise(F.lit("")), F.col("text")))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "part")))
    return parts.groupBy(*keys).agg(F.trim(F.array_join(F.transform(ordered, lambda s: s["part"]), "")).alias("line"))


def lines_to_page(lines: DataFrame) -> DataFrame:
    """Lines (file_id, page_num, block, pos, line): lines of a block joined by blanks, blocks by an empty line."""
    blocks = lines.where(F.trim("line") != "").groupBy("file_id", "page_num", "block").agg(F.array_sort(F.collect_list(F.struct("pos", F.trim("line").alias("line")))).alias("ls"))
    blocks = blocks.withColumn("b", F.array_join(F.transform("ls", lambda s: s["line"]), " "))
    return blocks.groupBy("file_id", "page_num").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "b"))), lambda s: s["b"]), "\n\n").alias("text"))


def assembled(spans: DataFrame) -> DataFrame:
    """Pages (file_id, page_num, text) of spans: blocks in reading order, their lines, and the spans of each line."""
    page = ["file_id", "page_num"]
    corner = spans.groupBy(*page, "page_width", "block").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"))
    order = reading_order(corner).select(*page, "block", F.col("pos").alias("place"))
    lines_ = spans_to_lines(spans.withColumnRenamed("line", "line_no"), [*page, "block", "line_no"])
    placed = lines_.join(order, [*page, "block"]).select(*page, F.col("place").alias("block"), F.col("line_no").alias("pos"), "line")
    return lines_to_page(placed)


# ---- headers and footers ----


def lines(pages: DataFrame) -> DataFrame:
    """Lines of pages: (file_id, page_num, pos, line, stripped, first, last): positions of the first and last line with content."""
    cut = F.transform(F.split("text", "\n", -1), lambda s: F.btrim(s, F.lit(" \t\r\x0b\f")))
    spots = F.filter(F.transform(cut, lambda s, i: F.when(s != "", i)), lambda i: i.isNotNull())
    made = pages.select("file_id", "page_num", F.split("text", "\n", -1).alias("ls"), F.array_min(spots).alias("first"), F.array_max(spots).alias("last"))
    made = made.select("file_id", "page_num", "first", "last", F.posexplode("ls").alias("pos", "line"))
    return made.withColumn("stripped", F.btrim("line", F.lit(" \t\r\x0b\f")))


def edge_lines(pages: DataFrame) -> DataFrame:
    """The first and the last three lines with content of each page, of files with more than LEAST_PAGES pages; on short pages
    a line can come in both places: (file_id, page_num, line, place)."""
    solid = F.filter(F.transform(F.split("text", "\n", -1), lambda s: F.btrim(s, F.lit(" \t\r\x0b\f"))), lambda s: s != "")
    long = pages.groupBy("file_id").agg(F.count("*").alias("n_pages")).where(F.col("n_pages") > LEAST_PAGES)
    rows = pages.join(long, "file_id").select("file_id", "page_num", "n_pages", solid.alias("s"))
    top, end = F.slice("s", F.lit(1), F.lit(3)), F.slice("s", F.greatest(F.size("s") - 2, F.lit(1)), F.lit(3))
    marked = F.concat(F.transform(top, lambda x: F.struct(x.alias("line"), F.lit("header").alias("place"))), F.transform(end, lambda x: F.struct(x.alias("line"), F.lit("footer").alias("place"))))
    return rows.select("file_id", "page_num", "n_pages", F.explode(marked).alias("e")).select("file_id", "page_num", "n_pages", "e.line", "e.place")


def common_lines(pages: DataFrame) -> DataFrame:
    """(file_id, line, n): edge lines that come three times or more in a file."""
    return edge_lines(pages).groupBy("file_id", "line").agg(F.count("*").alias("n")).where("n >= 3")


def fuzzy_lines(pages: DataFrame) -> DataFrame:
    """(file_id, place, line, n): edge lines with their digits masked, as often as the size of the file asks for."""
    found = edge_lines(pages).withColumn("line", text.digits_to_token(F.col("line"))).groupBy("file_id", "place", "line").agg(F.count("*").alias("n"), F.first("n_pages").alias("n_pages"))
    return found.where(F.col("n") >= F.greatest(F.lit(3), F.least(F.floor(F.col("n_pages") / 10), F.lit(25)))).select("file_id", "place", "line", "n")


def strip_headers(pages: DataFrame) -> DataFrame:
    """Pages without common lines anywhere, without masked common lines near the top and the end, and without a page number on
    the first or last line with content. Empty lines stay."""
    every = lines(pages)
    common = common_lines(pages).select("file_id", F.col("line").alias("stripped"), F.lit(1).alias("exact"))
    masked = fuzzy_lines(pages).select("file_id", F.col("line").alias("mask"), "place").groupBy("file_id", "mask").agg(F.collect_set("place").alias("places"))
    every = every.withColumn("mask", text.digits_to_token(F.col("stripped"))).join(common, ["file_id", "stripped"], "left").join(masked, ["file_id", "mask"], "left")
    top, end = F.col("pos") <= F.col("first") + 2, F.col("pos") >= F.col("last") - 2
    near = (F.coalesce(F.array_contains("places", "header"), F.lit(False)) & top) | (F.coalesce(F.array_contains("places", "footer"), F.lit(False)) & end)
    number = text.is_page_number(F.col("stripped")) & ((F.col("pos") == F.col("first")) | (F.col("pos") == F.col("last")))
    gone = (F.col("stripped") != "") & (F.col("exact").isNotNull() | near | number)
    kept = every.where(~F.coalesce(gone, F.lit(False))).groupBy("file_id", "page_num").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("ls"))
    kept = kept.select("file_id", "page_num", F.array_join(F.transform("ls", lambda s: s["line"]), "\n").alias("text"))
    return pages.select("file_id", "page_num").join(kept, ["file_id", "page_num"], "left").withColumn("text", F.coalesce("text", F.lit("")))


# ---- overlap of pages ----


def overlapped(pages: DataFrame, heal: bool = True) -> DataFrame:
    """Pages with the beginning of the page right after them appended; blank pages give nothing and are left out."""
    by = Window.partitionBy("file_id").orderBy("page_num")
    blank = lambda c: F.regexp_like(c, F.lit(r"(?U)\A\s*\z"))
    rows = pages.select("file_id", "page_num", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("next", F.when(F.lead("page_num").over(by) == F.col("page_num") + 1, F.lead("text").over(by)))
    head = F.left("next", F.lit(OVERLAP))
    clipped = F.when((F.length("next") > OVERLAP) & (F.instr(head, " ") > 0), F.left(head, F.length(head) - F.instr(F.reverse(head), " "))).otherwise(head)
    strip = lambda c: F.btrim(c, F.lit(" \t\n\r\x0b\f"))
    there = F.instr(F.right("text", F.lit(200)), F.left(strip(head), F.lit(50))) > 0
    joined = F.concat("text", F.lit(" "), strip(clipped))
    skip = F.col("next").isNull() | blank("next") | there
    whole = F.when(skip, F.col("text")).otherwise(cleaning.heal_hyphens(joined) if heal else joined)
    return rows.withColumn("out", whole).where(~blank("text")).select("file_id", "page_num", F.col("out").alias("text"))


# ---- tables of contents ----


def visual_toc(pages: DataFrame) -> DataFrame:
    """(file_id, level, title, page): entries such as 'Title ..... 12' on pages with five or more, among the first 15 pages."""
    early = pages.where("page_num <= 15").select("file_id", "page_num", F.explode(F.split("text", "\n", -1)).alias("line"))
    line = F.rtrim("line")
    entry = early.select("file_id", "page_num", line.alias("line"), F.ltrim(line).alias("s")).where(F.regexp_like("s", F.lit(rules.TOC_LINE)))
    entry = entry.select(
        "file_id", "page_num", (1 + F.floor((F.length("line") - F.length("s")) / 3)).cast("int").alias("level"),
        F.trim(F.regexp_extract("s", rules.TOC_LINE, 1)).alias("title"), F.regexp_extract("s", rules.TOC_LINE, 2).cast("int").alias("page"),
    )
    dense = entry.withColumn("n", F.count("*").over(Window.partitionBy("file_id", "page_num"))).where("n >= 5")
    return dense.select("file_id", "level", "title", "page").distinct()


def is_boilerplate_title(title: Column) -> Column:
    found = F.lit(False)
    for p in rules.BOILERPLATE_TITLES:
        found |= F.regexp_like(title, F.lit("(?diU)" + p))
    return found


def table_of_contents(metadata: DataFrame, recovered: DataFrame) -> DataFrame:
    """Entries of the metadata; recovered ones for files without any."""
    return metadata.unionByName(recovered.join(metadata.select("file_id").distinct(), "file_id", "left_anti"))


def valid_chapters(toc: DataFrame) -> DataFrame:
    return toc.where((F.col("page") > 0) & ~is_boilerplate_title(F.col("title"))).select("file_id", F.col("page").alias("page_num"), "title", "level")


def boilerplate_pages(toc: DataFrame, last_page: DataFrame) -> DataFrame:
    """(file_id, page_num) of boilerplate chapters: from a boilerplate title until the next entry that isn't below it.

    ``toc``: (file_id, level, title, page) ; ``last_page``: (file_id, n_pages). Entries go in the order of their pages.
    """
    by = Window.partitionBy("file_id").orderBy("page", "level", "title")
    # ``inside``: level of the boilerplate chapter that an entry belongs to, carried along the entries of a file
    state = F.aggregate(
        "items", F.struct(F.lit(None).cast("int").alias("level"), F.array().cast("array<struct<page:int,inside:boolean>>").alias("out")),
        lambda s, e: F.struct(
            F.when(s["level"].isNotNull() & (e["level"] > s["level"]), s["level"]).when(e["bad"], e["level"]).alias("level"),
            F.concat(s["out"], F.array(F.struct(e["page"].alias("page"), ((s["level"].isNotNull() & (e["level"] > s["level"])) | e["bad"]).alias("inside")))).alias("out"),
        ),
        lambda s: s["out"],
    )
    marked = toc.where("page > 0").withColumn("bad", is_boilerplate_title(F.col("title"))).withColumn("n", F.row_number().over(by))
    items = marked.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("n", F.col("page").cast("int").alias("page"), F.col("level").cast("int").alias("level"), "bad"))).alias("items"))
    spans = items.select("file_id", F.posexplode(state).alias("k", "e")).select("file_id", "k", "e.page", "e.inside")
    spans = spans.withColumn("next", F.lead("page").over(Window.partitionBy("file_id").orderBy("k"))).join(last_page, "file_id").where("inside")
    upto = F.coalesce(F.col("next") - 1, F.col("n_pages").cast("int"))
    return spans.where(upto >= F.col("page")).select("file_id", F.explode(F.sequence("page", upto)).alias("page_num")).distinct()


def blanked(pages: DataFrame, gone: DataFrame) -> DataFrame:
    """Pages with the text of boilerplate pages emptied."""
    hit = gone.select("file_id", "page_num", F.lit(1).alias("hit"))
    return pages.join(hit, ["file_id", "page_num"], "left").withColumn("text", F.when(F.col("hit").isNull(), F.col("text")).otherwise("")).drop("hit")
