"""The query language: trees, errors, and equal results of both ways to run a query."""

import pytest
from pyspark.sql import functions as F

from pagelode.functions import text
from pagelode.operators import index, query, search
from pagelode.operators.query import DATABASE, SYNTAX, And, Not, Or, Phrase, parse
from pagelode.sources import corpus

TEXTS = ["The quick brown fox", "Don't panic: snap-hip jump", "war and peace", "fox the quick", "Crème brûlée snaphip", "x²y a1b2 中文字", "", None]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(i, 1, t) for i, t in enumerate(TEXTS)], "file_id long, page_num int, text string").cache()


def test_trees():
    assert parse("war AND peace").tree == And((Phrase(("war",)), Phrase(("and",)), Phrase(("peace",))))
    assert parse('"The Fox"').tree == Phrase(("the", "fox"))
    assert parse('"qui*"').tree == Phrase(("qui",), prefix=True)
    assert parse("snap-hip").tree == Or((Phrase(("snap", "hip")), Phrase(("snaphip",))))
    assert parse("(a)OR(b)").tree == Or((Phrase(("a",)), Phrase(("b",))))
    assert parse("(a)NOT(b)").tree == Not(Phrase(("a",)), Phrase(("b",)))
    assert parse("^the").tree == Phrase(("the",), initial=True)
    assert parse("“the fox”").tree == Phrase(("the", "fox"))


@pytest.mark.parametrize("q", ["foo,", "foo.bar", "(a", "*"])
def test_syntax_errors(q):
    assert parse(q).error == SYNTAX


@pytest.mark.parametrize("q", ['"abc', 'foo"bar'])
def test_unterminated(q):
    assert parse(q).error == DATABASE


@pytest.mark.parametrize("q", ["-foo", "foo:bar", "nope:foo"])
def test_unknown_columns_match_nothing(q):
    assert parse(q).error is None and parse(q).tree == Phrase(())


@pytest.mark.parametrize("q", ["", "   ", '""'])
def test_empty(q):
    assert parse(q).empty and parse(q).error is None


CASES = {
    "fox": {0, 3}, '"the quick"': {0, 3}, '"quick brown"': {0}, "^fox": {3}, "qui*": {0, 3}, '"the qui*"': {0, 3}, "don't": {1}, "snap-hip": {1, 4}, "war AND peace": {2},
    "brulee": {4}, "(fox)NOT(brown)": {3}, "(peace)OR(panic)": {1, 2}, "text:fox": {0, 3}, "*fox": {0, 3}, "fox quick": {0, 3}, '"..."': set(), "中文字": {5}, "a1b2": {5},
}


@pytest.mark.parametrize("q", CASES)
def test_scan_and_postings_agree(pages, q):
    parsed = parse(q)
    scan = {r.file_id for r in search.hits(pages, parsed).collect()}
    assert scan == CASES[q]
    assert {r.file_id for r in index.matching_pages(index.postings(pages), parsed.tree).collect()} == scan


def test_tokens(spark):
    row = spark.createDataFrame([("ÉTÉ x²y don't_stop ﬁn",)], "t string").select(text.tokens(F.col("t")).alias("k")).first()
    assert row.k == ["ete", "x²y", "don", "t", "stop", "ﬁn"]


def test_written_postings_are_cut_by_token(spark, pages, tmp_path):
    index.write_postings(pages, str(tmp_path / "p"), 2)
    again = spark.read.parquet(str(tmp_path / "p"))
    assert again.count() == index.postings(pages).count()
    assert {r.file_id for r in index.matching_pages(again, parse("fox").tree).collect()} == {0, 3}


def test_postings_need_no_shuffle(spark):
    rows = spark.createDataFrame([(1, 1, "the a the b"), (1, 2, None), (2, 1, ""), (2, 2, "a")], corpus.PAGES)
    made = index.postings(rows)
    assert sorted(map(tuple, made.collect())) == [("a", 1, 1, [1]), ("a", 2, 2, [0]), ("b", 1, 1, [3]), ("the", 1, 1, [0, 2])]
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
