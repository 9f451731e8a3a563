"""Goldens of the cleaning steps, snippets and small text functions."""

import random

import pytest
from pyspark.sql import functions as F

from pagelode.functions import cleaning, text
from pagelode.operators import search


@pytest.mark.parametrize(("a", "b"), [
    ("The Emper- or came", "The Emperor came"), ("self- made", "self-made"), ("I- I don't", "I- I don't"), ("Jean- Luc", "Jean- Luc"), ("Th- then", "Th- then"),
    ("EMPER- OR", "EMPER- OR"), ("twenty- One", "twenty- One"), (None, None), ("", ""),
])
def test_hyphens(a, b):
    assert cleaning.heal(a) == b


@pytest.mark.parametrize(("a", "b"), [
    ('He said "go" now', "He said “go” now"), ('end."He', "end. “He"), ('"a" "b"', "“a” “b”"), ('("x")', "(“x”)"), ("none", "none"), ('say "one\n"two" x', "say “one\n“two” x"),
])
def test_smart_quotes(a, b):
    assert cleaning.curl(a) == b


CLEAN = {
    "aa\tbb\xa0cc": "aa bb cc", "s o m e text": "some text", "Wait . . . now": "Wait now", "see oceanofpdf.com here": "see here", "line one ¦ junk\nnext": "next", "eeeeee ok": " ok",
    "ER ER ER fine": " fine", "ſtone ﬁre": "stone fire", "one — two": "one - two", "word ,next": "word, next", "Don' t go": "Don't go", "John 's hat": "John's hat",
    "that'sa trap": "that's a trap", "http://a.b/c,d": "http://a.b/c,d", "visit www. google. com": "visit www.google.com", "e.g. this": "e.g. this", "a####b": "ab", "text\nChapter One\nmore": "text\nmore",
    "keep\nCopyright 2020 all gone": "keep", "Emper- or": "Emperor", "": "",
}


def test_clean(spark):
    rows = cleaning.cleaned(spark.createDataFrame(list(enumerate(CLEAN)), "i int, t string"), "t").collect()
    got = {r.i: r.t for r in rows}
    assert got == dict(enumerate(CLEAN.values()))


def test_clean_null(spark):
    assert cleaning.cleaned(spark.createDataFrame([(None,)], "t string"), "t").first().t is None


def test_natural_order(spark):
    names = ["Volume 10.pdf", "volume 2.pdf", "1 first", "Volume 1.pdf", "a", "Volume 02b.pdf"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").orderBy(text.natural_key(F.col("n"))).collect()
    assert [r.n for r in rows] == ["1 first", "a", "Volume 1.pdf", "volume 2.pdf", "Volume 02b.pdf", "Volume 10.pdf"]


def test_markdown_and_truncate(spark):
    row = spark.createDataFrame([("a <b>x*y</b> &lt;z&gt;<i>q</i>", "abcdef")], "s string, t string").select(text.to_markdown(F.col("s")).alias("s"), text.truncate(F.col("t"), 4).alias("t")).first()
    assert row.s == r"a **x\*y** <z\>q" and row.t == "abc…"


def test_snippet():
    page = "Mr. Smith met Dr. Jones. " + "Filler words stand here. " * 40 + "The kelbor hal spoke of war & peace. " + "More filler follows on. " * 40
    s = search.snippet(page, ["kelbor-hal"])
    assert "<b>kelbor hal</b>" in s and "&amp; peace" in s and len(s) < 700
    assert search.snippet("", ["x"]) == ""
    assert search.snippet('He said "stop it now" loudly.', ["stop"]) == 'He said "<b>stop</b> it now" loudly.'


def test_sentences_keep_abbreviations():
    ends = [m.end() for m in search._SENTENCE_END.finditer("Mr. Smith left. He ran! Why? Yes.")]
    assert ends[0] == len("Mr. Smith left. ")


def test_merge_pages():
    assert search.merge_pages("one two three", "three four five six seven eight nine ten eleven twelve")[0].startswith("one two three three")
    over = "x" * 60
    whole, start = search.merge_pages("begin " + over, over + " end")
    assert whole == "begin " + over + " end" and start == 6
    assert search.merge_pages("", "b") == ("b", 0) and search.merge_pages("a", "") == ("a", 0)


def test_fold_matches():
    rows = [{"page_num": p, "snippet": s, "chapter": None} for p, s in ((1, "a b c d"), (2, "a b c e"), (3, "a b c d"), (5, "q"), (6, "r"), (7, "s"), (9, None))]
    kept = [(r["page_num"], r["snippet"]) for r in search.fold_matches(rows)]
    assert kept == [(1, "a b c d"), (3, None), (5, "q"), (6, "r"), (7, None), (9, None)]


def test_a_text_goes_round_steps_that_cannot_change_it(spark):
    pieces = ["s o m e", "a  b", "x\u00a0y", "\u3000z", "a ¦ b\n", "ab~cd", "a.b.c.d", "hahaha", "aaaaaa", "go go go", "......", "----", "“q”", "`", "|x", "\x1c", "\x00", "ſe", "https://a.b:80/c,d", "e.g.", "&amp;", "fne",
              "that'sa", "James'hat", "can' t", "John 's", '" hi', "so,'yes", 'end."Next', "say!''go", "word'. Next", "so...Next", "ab ,cd", "one.two", "www. site. com", "emper- or", "half-\ndone", "\nDedication\nfor", "\nCONTENTS\nPART ONE\n", "oceanofpdf.com", ". . .", "\ufffd", "<PRD>", "è", "!\n'", "plain words", "\nChapter X\n"]
    rng = random.Random(5)
    texts = [rng.choice(["", " ", "\n"]).join(rng.choice(pieces) for _ in range(rng.randint(1, 4))) for _ in range(1500)] + pieces
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    order = "whitespace spaced_out watermarks boilerplate ellipsis garbage characters protect contractions quotes_before smart_quotes quotes_after punctuation restore heal_urls heal_hyphens collapse".split()
    plain = rows
    for name in order:
        plain = plain.withColumn("t", getattr(cleaning, name)(F.col("t")))
    made = cleaning.cleaned(rows, "t")
    assert {r.i: r.t for r in made.collect()} == {r.i: r.t for r in plain.collect()}
    # a step is behind a condition, so that a text without artefacts is not run through the rules
    text = F.col("t")
    clean = spark.createDataFrame([("Plain words stand here, and nothing is wrong with them.",)], "t string")
    assert not any(clean.select(*[need(text) for need, _ in cleaning.STEPS if callable(need)]).first())
