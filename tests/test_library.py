"""Structure, quality, maintenance and sources on small libraries."""

import os

import duckdb
import oracle
import pytest
from pyspark.sql import functions as F

from pagelode.operators import analysis, maintain, ocr, search, structure
from pagelode.plans import registry
from pagelode.sources import corpus, files
from pagelode.streaming import incremental


def _rows(df):
    return sorted(map(tuple, df.collect()))


def test_breadcrumbs(spark):
    toc = spark.createDataFrame([(1, 1, "Part", 1), (1, 3, "Chapter", 2), (1, 3, "Section", 3), (1, 9, "Part II", 1)], corpus.CHAPTERS)
    pages = spark.createDataFrame([(1, p) for p in (1, 2, 4, 9)] + [(2, 1)], "file_id long, page_num int")
    assert _rows(search.breadcrumbs(pages, toc)) == [(1, 1, "Part"), (1, 2, "Part"), (1, 4, "Part > Chapter > Section"), (1, 9, "Part II"), (2, 1, None)]


def test_headers_go(spark):
    pages = spark.createDataFrame([(1, p, f"My Book\n\nBody of page number {p * 7} here\nmore {chr(96 + p)}\nagain {chr(97 + p)}{p}x\nPage {p} of 9") for p in range(1, 10)], corpus.PAGES)
    out = structure.strip_headers(pages).orderBy("page_num").first()
    assert "My Book" not in out.text and "Page 1" not in out.text and out.text.startswith("\n")


def test_overlap(spark):
    long = "word " * 100
    pages = spark.createDataFrame([(1, 1, "First half of a sen- "), (1, 2, "tence ends."), (1, 3, " "), (1, 5, "Far."), (1, 6, long)], corpus.PAGES)
    got = {r.page_num: r.text for r in structure.overlapped(pages).collect()}
    assert got[1] == "First half of a sentence ends." and got[2] == "tence ends." and set(got) == {1, 2, 5, 6}
    assert got[5].startswith("Far. word word") and len(got[5]) <= 5 + 300


def test_spans(spark):
    spans = spark.createDataFrame([(1, 0, "Hel", 0.0, 10.0, 10.0), (1, 1, "lo", 10.5, 20.0, 10.0), (1, 2, "world", 25.0, 40.0, 10.0), (1, 3, "!", 50.0, 55.0, 10.0)], "k int, pos int, text string, x0 double, x1 double, size double")
    assert structure.spans_to_lines(spans, ["k"]).first().line == "Hello world!"
    lines = spark.createDataFrame([(1, 1, 0, 0, "a "), (1, 1, 0, 1, "b"), (1, 1, 1, 0, "c"), (1, 1, 1, 1, " ")], "file_id long, page_num int, block int, pos int, line string")
    assert structure.lines_to_page(lines).first().text == "a b\n\nc"


def test_ocr_status(spark):
    def pages(i, texts):
        return [(i, n + 1, t) for n, t in enumerate(texts)]

    good = "the story that they would have told about people after the war with this and that " * 3
    rows = pages(1, ["", "", ""]) + pages(2, [good] * 3) + pages(3, ["zqx wvu kjh " * 30] * 3) + pages(4, ["ab", "c", "d"]) + pages(5, ["4 4 4 and the 5 5 5 that have with " * 9] * 3)
    got = dict(_rows(ocr.status(ocr.features(spark.createDataFrame(rows, corpus.PAGES)))))
    assert got == {1: "redo", 2: None, 3: "redo", 4: "missing", 5: None}


def test_duplicate_pairs(spark):
    shared = [f"a long shared line number {i} that is over forty characters" for i in range(3)]
    rows = [(1, "\n".join(shared)), (2, "\n".join(shared[:2])), (3, "short"), (4, None)]
    assert _rows(analysis.duplicate_pairs(spark.createDataFrame(rows, "id long, text string"), "id")) == [(1, 2, 2, 2 / 3, 1.0)]


def test_titles(spark):
    t = lambda *x: spark.createDataFrame([(v,) for v in x], "title string")
    got = {r.title: r.rule for r in analysis.title_matches(t("The King's Men", "Night", "Song of Fire", "Nothing like it"), t("the kings men.pdf", "Long Night Falls", "fire of song", "zzz")).collect()}
    assert got == {"The King's Men": "exact", "Night": "part", "Song of Fire": "tokens", "Nothing like it": None}
    fuzzy = analysis.fuzzy_title_matches(t("The Emperors Gift"), t("The Emperor's Gifts", "Another"))
    assert fuzzy.first().best == "The Emperor's Gifts"


def test_folder_names_are_like_patterns(spark):
    f = spark.createDataFrame([(1, "a", "Shelf1/x/a", 0.0, None), (2, "b", "b", 0.0, None), (3, "c", "shelf_1/c", 0.0, None), (4, "d", "shelfX1/d", 0.0, None)], corpus.FILES)
    ids = lambda *folders: {r.id for r in search.in_folders(f, list(folders)).collect()}
    assert ids("shelf1") == {1} and ids("(Root)") == {2} and ids("shelf_1") == {3, 4} and ids() == {1, 2, 3, 4}


def test_upsert_keeps_names(spark):
    old = spark.createDataFrame([(7, "old.pdf", "a/old.pdf", 1.0, "h")], corpus.FILES)
    new = spark.createDataFrame([("other.pdf", "a/old.pdf", 2.0, "i"), ("n.pdf", "n.pdf", 3.0, "j")], "filename string, relative_path string, last_modified double, file_hash string")
    assert _rows(maintain.upserted(old, new)) == [(7, "old.pdf", "a/old.pdf", 2.0, "i"), (8, "n.pdf", "n.pdf", 3.0, "j")]


def test_scan_and_hash(spark, tmp_path):
    for name in ("a/one.PDF", "a/.hid/two.pdf", "~x.pdf", "b.txt", "c.pdf"):
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    assert {r.relative_path for r in files.scan(spark, str(tmp_path)).collect()} == {"a/one.PDF", "c.pdf"}
    assert files.hashed(spark, str(tmp_path / "c.pdf")).first().file_hash == "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"


def test_stream_merges_batches(spark, tmp_path):
    schema = "filename string, relative_path string, last_modified double, file_hash string, pages array<struct<page_num:int,text:string>>"
    snap = incremental.Snapshot(spark, str(tmp_path / "lib"))
    for k, rows in enumerate([[("a", "a", 1.0, "h", [(1, "one"), (2, "two")])], [("a", "a", 2.0, "h2", [(1, "new")]), ("b", "b", 1.0, "g", [(1, "bee")])]]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
        q = incremental.follow(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), snap, str(tmp_path / "cp"))
        q.awaitTermination()
        assert k >= 0
    assert _rows(snap.read("files", corpus.FILES).select("relative_path", "last_modified")) == [("a", 2.0), ("b", 1.0)]
    assert _rows(snap.read("pages", corpus.PAGES).select("text")) == [("bee",), ("new",)]


def test_embed_pages_and_catalogue(spark):
    hits = spark.createDataFrame([(1, 5), (1, 6), (2, 1), (2, 2)], "file_id long, page_num int")
    assert _rows(analysis.embed_pages(hits)) == [(1, 5, 1, 0, 0), (1, 6, 2, 0, 0), (2, 1, 3, 0, 0), (2, 2, 4, 1, 0)]
    f = spark.createDataFrame([(1, "V 10.pdf", "s/V 10.pdf", 0.0, None), (2, "V 9.pdf", "s/V 9.pdf", 0.0, None)], corpus.FILES)
    assert analysis.catalogue(f).first().entries == ["V 9.pdf", "V 10.pdf"]


def test_compare_and_percentiles(spark):
    runs = spark.createDataFrame([("q", float(v)) for v in range(1, 101)], "k string, v double")
    row = analysis.latencies(runs, "k", "v").first()
    assert (row.n, row.p50, row.p95) == (100, 50.5, 95.05)
    assert analysis.compared(runs.limit(1), runs.limit(1).withColumn("v", F.lit(3.0)), "k", "v").first().percent == 200.0


def test_fuzzy_titles_equal_all_pairs(spark):
    """Blocks lose nothing: the same best scores as when every work is held against every local title."""
    import difflib
    import random

    from pagelode.operators import analysis

    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefg", k=rng.randint(1, 9)))
    works = [" ".join(word() for _ in range(rng.randint(1, 4))) for _ in range(60)]

    def changed(t):
        t = list(t)
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(t))
            t[i : i + 1] = rng.choice([[], ["h"], ["a", t[i]]])
        parts = "".join(t).split()
        rng.shuffle(parts)
        return " ".join(parts) or "x"

    local = [changed(rng.choice(works)) if rng.random() < 0.7 else word() for _ in range(80)]
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    want = {}
    for w in set(works):
        scores = [ratio(w, x) for x in set(local) if ratio(w, x) > 0.85 or all(any(t == u or ratio(t, u) > 0.8 for u in x.split()) for t in w.split())]
        if scores:
            want[w] = round(max(scores), 12)
    frames = [spark.createDataFrame([(t,) for t in rows], "title string") for rows in (works, local)]
    got = {r.title: round(r.score, 12) for r in analysis.fuzzy_title_matches(*frames).collect()}
    assert got == want and len(want) > 20


def test_report_rounds_shares_as_sql_does(spark):
    pairs = spark.createDataFrame([(1, 2, 5, 5 / 16, 0.25), (1, 3, 15, 15 / 16, 0.25)], "file_a long, file_b long, shared long, ratio_a double, ratio_b double")
    shared = spark.createDataFrame([(1, 2, "x"), (1, 3, "x")], "file_a long, file_b long, line string")
    files = spark.createDataFrame([(i, 16, f"d{i}") for i in (1, 2, 3)], "file_id long, n long, path string")
    made = analysis.duplicate_report(pairs, shared, files.drop("path"), files.drop("n"))
    assert sorted(r.report.split("\n")[0] for r in made.collect()) == ["Match: 31.2% overlap", "Match: 93.8% overlap"]


_COMMON = "Ti wh enndst onndble esthtion eringing thhethea inst insher."


@pytest.mark.parametrize("pages", [
    ["One.", "Nada nada.", "Two."],  # no term: no row
    ["Before it.", f"{_COMMON} Now the end comes.", f"{_COMMON} Other words go on."],  # the next page begins as this one
    [("The page of one kind. " * 30).strip()] * 3,
    ["Some of it is bro-", "ken of course and the well-\nknown end.", "Next of all."],
])
def test_snippet_on_demand_of_odd_pages(spark, tmp_path, pages):
    rows = [(i, t, "en", "src0", len(t)) for i, t in enumerate(["a b c."] * 3 + pages)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert oracle.differences(registry.queries()["snippet_on_demand"](spark, str(tmp_path)), con, registry.oracle_sql()["snippet_on_demand"]) == ""


def test_pages_are_numbered_in_ranges(spark, tmp_path, monkeypatch):
    """No task sorts a whole source: ids are cut into ranges, and the numbers are those of one window over the source."""
    monkeypatch.setattr(corpus, "RANGE_ROWS", 5)
    ids = [(7 * i) % 101 * 10**9 - 5 for i in range(100)]
    rows = [(k, f"text {k}", f"src{0 if i % 3 else i % 7}") for i, k in enumerate(ids)] + [(3, "none", None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    want = [(int(s[3:]) + 1, n, t) for s in {r[2] for r in rows if r[2]} for n, (_, t, _) in enumerate(sorted(r for r in rows if r[2] == s), 1)]
    made = corpus.numbered(spark, str(tmp_path))
    assert sorted(tuple(r) for r in made.collect() if r.file_id is not None) == sorted(want)
    assert [tuple(r) for r in made.where("file_id is null").collect()] == [(None, 1, "none")]
    assert "windowspecdefinition(key#" in made._jdf.queryExecution().optimizedPlan().toString()


def test_breadcrumbs_of_many_chapters(spark):
    """Against a walk back over the chapters; and a file's chapters are not gathered beside each of its pages."""
    toc = [(1, 1 + (i * 37) % 90, f"t{i}", 1 + (i * 13) % 4) for i in range(60)]
    want = []
    for p in range(1, 101):
        kept = []
        for _, _, title, level in sorted((c for c in toc if c[1] <= p), key=lambda c: (c[1], c[3], c[2]), reverse=True):
            if not kept or level < kept[-1][1]:
                kept.append((title, level))
        want.append((1, p, " > ".join(t for t, _ in reversed(kept)) or None))
    pages = spark.createDataFrame([(1, p) for p in range(1, 101)], "file_id long, page_num int")
    made = search.breadcrumbs(pages, spark.createDataFrame(toc, corpus.CHAPTERS))
    assert _rows(made) == want
    assert "AS toc" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_only_first_hits_move_their_texts(spark):
    pages = spark.createDataFrame([(1, p, f"the page {p}") for p in range(1, 8)], corpus.PAGES)
    chosen = spark.createDataFrame([(1,)], "file_id long")
    made = search.page_hits(pages.select("file_id", "page_num"), pages, chosen, 2)
    assert _rows(made) == [(1, p, p, f"the page {p}" if p < 3 else "") for p in range(1, 8)]
    assert "LeftSemi" in made._jdf.queryExecution().optimizedPlan().toString() and "rightHint=(strategy=broadcast)" in made._jdf.queryExecution().optimizedPlan().toString()


def test_merging_sets_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10000)
    search.merged(spark.createDataFrame([("a", "b")], "x string, y string"), "x", "y")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
