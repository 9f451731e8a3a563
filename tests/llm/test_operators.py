"""Sharding, language ID, toxicity, embeddings, HTML, quality, BPE and mixing: against brute force, and on odd tables."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from pagelode.llm import bpe, embeddings, html, langid, mixing, quality, queries, runtime, sharding, toxicity

DOCS = "doc_id long, text string, lang string, source string"
ODD = ["", None, " ", "\n\n", "a", "日本 é 🙂", "x" * 40_000, "the end. " * 5000, "12345 !!!"]


# ---- sharding ----


def test_matrix_has_its_margins_and_mean():
    m = sharding.communication_matrix([50, 0, 30, 20], [34, 33, 33], 1)
    assert m.sum(axis=1).tolist() == [50, 0, 30, 20] and m.sum(axis=0).tolist() == [34, 33, 33] and (m >= 0).all()
    mean = np.mean([sharding.communication_matrix([50, 50], [30, 70], s)[0, 0] for s in range(400)])
    assert abs(mean - 15) < 0.6


@pytest.mark.parametrize(("good", "bad", "sample"), [(400_000_000, 700_000_000, 9_000), (3 * 10**12, 10**12, 10**6), (10**13, 10**12, 2 * 10**12), (10**9, 5, 10**9), (7, 10**10, 10**9)])
def test_large_draws_are_hypergeometric(good, bad, sample):
    """Mean and variance of many draws beyond the sizes that numpy takes, and their support."""
    rng = np.random.Generator(np.random.PCG64(5))
    x = np.array([sharding._hypergeometric(rng, good, bad, sample) for _ in range(4000)], float)
    n, p = good + bad, good / (good + bad)
    sd = np.sqrt(sample * p * (1 - p) * (n - sample) / (n - 1))
    if sd > 0.1:
        assert abs(x.mean() - sample * p) < 4 * sd / np.sqrt(4000) and abs(x.std() / sd - 1) < 0.06
    assert x.max() <= min(good, sample) and x.min() >= max(0, sample - bad)


def test_large_draws_follow_the_law_at_small_sizes():
    """The way for large sizes, used at a small one, against the exact chances."""
    from math import comb

    good, bad, sample, n = 12, 30, 15, 20_000
    rng = np.random.Generator(np.random.PCG64(6))
    p, most = sample / (good + bad), None
    most = sharding._log_binomial(int((bad + 1) * p), bad, p)
    got = Counter()
    while got.total() < n:
        x = int(rng.binomial(good, p))
        if 0 <= sample - x <= bad and np.log(rng.random()) <= sharding._log_binomial(sample - x, bad, p) - most:
            got[x] += 1
    for k in range(good + 1):
        chance = comb(good, k) * comb(bad, sample - k) / comb(good + bad, sample)
        assert abs(got[k] / n - chance) < 5 * np.sqrt(chance / n) + 1e-4


def _by_hand(rows, shards, seed, sources):
    """The whole operator by sorting in Python: counts drawn from the matrix, local order, exchange, order in the shard."""
    local, upto = {}, sharding.communication_matrix([sum(r[1] == i for r in rows) for i in range(sources)], sharding.shard_sizes(len(rows), shards), seed).cumsum(axis=1)
    placed = []
    for i in range(sources):
        local = sorted((r for r in rows if r[1] == i), key=lambda r: (r[2], r[0]))
        placed += [(int((upto[i] < k + 1).sum()), r[3], r[0]) for k, r in enumerate(local)]
    placed.sort()
    first = {}
    return {row: (s, n - first.setdefault(s, n)) for n, (s, _, row) in enumerate(placed)}


@pytest.mark.parametrize("sources", [1, 6])
def test_shards_equal_brute_force(spark, monkeypatch, sources):
    monkeypatch.setattr(sharding, "RANGE_ROWS", 16)
    df = spark.range(300)
    h = lambda k: F.xxhash64(F.lit(k), "id")
    rows = [tuple(r) for r in df.select("id", F.pmod(h(4), F.lit(sources)).cast("int"), h(5), h(6), F.shiftrightunsigned(h(6), 32)).collect()]
    want = _by_hand([(r[0], r[1], r[2], (r[4], r[3])) for r in rows], 7, 4, sources)
    got = {r.id: r for r in sharding.shard(df, 7, 4, sources).collect()}
    assert {i: r.shard for i, r in got.items()} == {i: v[0] for i, v in want.items()}
    ranges = max(1, -(-300 // (7 * 16)))
    for s in range(7):  # slots follow the third hash within the ranges, which follow one another
        order = sorted((r for r in rows if got[r[0]].shard == s), key=lambda r: (r[4] * ranges >> 32, r[3]))
        assert [got[r[0]].slot for r in order] == list(range(len(order)))


@pytest.mark.parametrize(("n", "shards", "sources"), [(103, 16, 7), (5, 16, None), (0, 4, None), (1000, 1, 3)])
def test_shards_are_even_and_gapless(spark, n, shards, sources):
    df = spark.range(n).withColumn("shard", F.lit("x"))
    rows = sharding.shard(df, shards, 3, sources).collect()
    assert sorted(r.id for r in rows) == list(range(n))
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots.get(i, [])) for i in range(shards)]
    assert max(sizes) - min(sizes) <= 1


def test_shards_repeat_and_hold_repeated_rows(spark):
    df = spark.createDataFrame([(i % 5, None if i % 3 else "é") for i in range(60)], "a int, b string")
    a, b = (sorted(map(str, sharding.shard(df, 4, 9, 5).collect())) for _ in range(2))
    assert a == b and len(a) == 60


def test_slots_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANGE_ROWS", 10)
    rows = sharding.shard(spark.range(500), 3, 1).collect()
    assert sorted((r.shard, r.slot) for r in rows) == [(s, k) for s, n in enumerate(sharding.shard_sizes(500, 3)) for k in range(n)]


# ---- language ----


def test_kneser_ney_sums_to_one():
    model = langid.Model(["x"], 6)
    model.orders.append(langid._fit_language(["abc", "abd", "cab", "b"], np.array([3.0, 1, 2, 5]), 6))
    runs = langid.Runs(["aba abb abc abd"])
    total = 0.0
    for last in ["a", "b", "c", "d"]:
        r = langid.Runs(["ab" + last])
        run, hashes = r.grams(langid.ORDER)
        total += np.exp(langid._log_chances(model, hashes, langid._context_hashes(r, run, hashes))[2, 0])
    r = langid.Runs(["ab"])
    run, hashes = r.grams(langid.ORDER)
    total += np.exp(langid._log_chances(model, hashes, langid._context_hashes(r, run, hashes))[2, 0])
    assert len(runs.start) == 4 and abs(total + np.exp(langid._log_chances(model, *_unknown())[2, 0]) - 1) < 0.02


def _unknown():
    r = langid.Runs(["abz"])
    run, hashes = r.grams(langid.ORDER)
    return hashes, langid._context_hashes(r, run, hashes)


def _lang_docs(spark):
    rng = random.Random(1)
    words = {"en": "the of and thing there with house water".split(), "de": "der die und haus wasser nicht schön über".split()}
    rows = [(i, " ".join(rng.choices(words[lang], k=60)), lang, "s") for i, lang in enumerate(["en", "de"] * 60)]
    return spark.createDataFrame(rows, DOCS)


def test_languages_and_rejection(spark):
    docs = _lang_docs(spark)
    model = langid.fit(docs)
    got = langid.predict(docs, model).collect()
    assert all(r.lang == r.lang_pred and not r.rejected and 0 <= r.score <= 1 for r in got)
    odd = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)] + [(50, "zqxjk vwpqz " * 80), (51, "Привет мир " * 50)], "doc_id long, text string").withColumn("score", F.lit("s"))
    res = {r.doc_id: r for r in langid.predict(odd, model, keep_text=True).collect()}
    assert all(res[i].lang_pred == "und" and res[i].rejected and res[i].score == 0 for i in (0, 1, 2, 3, 8))
    assert res[50].rejected and res[51].rejected and res[51].lang_pred in ("en", "de") and res[4].text == "a"


@pytest.mark.parametrize("n", range(1, 6))
def test_rare_languages_are_not_rejected(spark, n):
    """Few labelled rows, whichever of them the hash puts aside; long texts of the language are kept."""
    rng = random.Random(n)
    rare = "talo vesi kuningas yö äiti poika tyttö metsä järvi lintu".split()
    text = lambda: " ".join(rng.choices(rare, k=200))
    for first in range(1000, 1000 + 3 * n, n):
        rows = [(first + i, text(), "fi", "s") for i in range(n)]
        docs = _lang_docs(spark).unionByName(spark.createDataFrame(rows, DOCS))
        new = spark.createDataFrame([(i, text()) for i in range(5)], "doc_id long, text string")
        got = langid.predict(new, langid.fit(docs)).collect()
        assert all(r.lang_pred == "fi" and not r.rejected for r in got)


def _brute_entropy(words, counts, text):
    """Interpolated Kneser-Ney by dictionaries: mean negative log chance of the symbols of a text's runs."""
    n, d = langid.ORDER, langid.DISCOUNT
    pad = lambda w: ["<"] * (n - 1) + list(w) + [">"]
    grams = [Counter() for _ in range(n + 1)]
    for w, c in zip(words, counts, strict=True):
        p = pad(w)
        for i in range(n - 1, len(p)):
            grams[n][tuple(p[i - n + 1 : i + 1])] += c
    for k in range(n - 1, 0, -1):
        grams[k] = Counter(g[1:] for g in grams[k + 1])
    totals, kinds = [Counter() for _ in range(n + 1)], [Counter() for _ in range(n + 1)]
    for k in range(1, n + 1):
        for g, c in grams[k].items():
            totals[k][g[:-1]] += c
            kinds[k][g[:-1]] += min(c, d)
    alphabet = len({c for w in words for c in w}) + 2

    def chance(g, k):
        if k == 0:
            return 1 / alphabet
        t = totals[k][g[n - k : -1]]
        low = chance(g, k - 1)
        return low if not t else max(grams[k][g[n - k :]] - d, 0) / t + kinds[k][g[n - k : -1]] / t * low

    logs = [np.log(chance(tuple(pad(w)[i - n + 1 : i + 1]), n)) for w in text.split() for i in range(n - 1, len(pad(w)))]
    return -np.mean(logs)


def test_cross_entropy_equals_brute_force():
    words, counts = ["abc", "abd", "cab", "b", "abcab", "dd"], np.array([3.0, 1, 2, 5, 1, 1])
    alphabet = len(set("".join(words))) + 2
    model = langid.Model(["x"], alphabet, name="brute")
    model.orders.append(langid._fit_language(words, counts, alphabet))
    for text in ("abc", "abca dab bbb", "zzz abq", "cab cab d"):
        sums, symbols = langid._scored(model, [text])
        assert -sums[0, 0] / symbols[0] == pytest.approx(_brute_entropy(words, counts, text), rel=1e-5)


def test_blocks_of_languages_give_the_same(spark, monkeypatch):
    rng = random.Random(5)
    kinds = {f"l{i}": ["".join(rng.choices("abcdefghijklmnop"[i : i + 9], k=5)) for _ in range(30)] for i in range(5)}
    rows = [(i * 5 + k, " ".join(rng.choices(kinds[lang], k=40)), lang, "s") for i in range(12) for k, lang in enumerate(kinds)] + [(900, None, "l1", "s"), (901, "12 3", "l2", "s")]
    docs = spark.createDataFrame(rows, DOCS)
    got = []
    for block in (256, 2):
        monkeypatch.setattr(langid, "BLOCK", block)
        models = langid.fit(docs)
        assert len(models) == (1 if block > 5 else 3)
        got.append({r.doc_id: (r.lang_pred, round(r.score, 9), r.cross_entropy and round(r.cross_entropy, 6), r.n_symbols, r.rejected, r.text) for r in langid.predict(docs, models, keep_text=True).collect()})
    assert got[0] == got[1] and all(v[0] == r[2] for r in rows[:60] if (v := got[0][r[0]]))


def test_models_of_other_counts_have_other_names(spark):
    """Swapped labels: as many languages and words, other chances; workers must not mix up their caches."""
    docs = _lang_docs(spark)
    swapped = docs.withColumn("lang", F.when(F.col("lang") == "en", "de").otherwise("en"))
    a, b = langid.fit(docs), langid.fit(swapped)
    assert a[0].name != b[0].name and a[0].langs == b[0].langs
    for models, right in ((a, docs), (b, swapped)):
        assert langid.predict(right, models).where("lang <> lang_pred").count() == 0


def test_language_without_rows(spark):
    empty = spark.createDataFrame([], DOCS)
    model = langid.fit(empty)
    assert langid.predict(empty, model).collect() == []
    assert langid.predict(spark.createDataFrame([(1, "text")], "doc_id long, text string"), model).first().lang_pred == "und"


def test_held_out_languages(spark, sf_dir):
    got = queries.op3_kneser_ney_langid(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() >= 0.98 * got.count()


# ---- toxicity ----


def test_machine_learns_pairs():
    """Neither word alone decides: only an insult that meets a group is marked."""
    rng = np.random.Generator(np.random.PCG64(0))
    row, term, label = [], [], []
    for i in range(3000):
        a, b = rng.random(2) < 0.4
        marks = [t for t, on in ((1, a), (2, b), (3, True), (int(rng.integers(10, 400)), True)) if on]
        row += [i] * len(marks)
        term += marks
        label.append(float(a and b))
    m = toxicity.train(np.array(row), np.array(term), np.array(label))
    p = toxicity._chance(toxicity._sums(m, 4, np.array([0, 1, 2, 2]), m.slot[np.array([1, 2, 1, 2])].astype(int)))
    assert p[2] > 0.7 and p[0] < 0.3 and p[1] < 0.3 and p[3] < 0.3


def test_machine_learns_pairs_that_tell_nothing_alone():
    """Words 1 and 2 are each as common in either class; only both together are marked. Word 5 marks the other half."""
    rng = np.random.Generator(np.random.PCG64(1))
    row, term, label = [], [], []
    for i in range(4000):
        marks = [[1, 2], [5], [1], [2]][i % 4] + [3, int(rng.integers(10, 400))]
        row += [i] * len(marks)
        term += marks
        label.append(float(i % 4 < 2))
    m = toxicity.train(np.array(row), np.array(term), np.array(label))
    assert (m.slot[np.unique(term)] >= 0).all()
    p = toxicity._chance(toxicity._sums(m, 3, np.array([0, 0, 0, 1, 1, 2, 2]), m.slot[np.array([1, 2, 3, 1, 3, 2, 3])].astype(int)))
    assert p[0] > 0.7 and p[1] < 0.3 and p[2] < 0.3


def test_sums_equal_brute_force():
    """Bias, weights, and the product of factors of every pair of terms."""
    rng = np.random.Generator(np.random.PCG64(2))
    m = toxicity.Machine(0.3, np.zeros(0), rng.normal(size=40), rng.normal(size=(40, toxicity.FACTORS)))
    sets = [rng.choice(40, size=k, replace=False) for k in (0, 1, 2, 7, 20)]
    row = np.repeat(np.arange(5), [len(x) for x in sets])
    got = toxicity._sums(m, 5, row, np.concatenate(sets).astype(int))
    for x, z in zip(sets, got, strict=True):
        pairs = sum(m.factors[i] @ m.factors[j] for a, i in enumerate(x) for j in x[a + 1 :])
        assert z == pytest.approx(0.3 + m.weight[x].sum() + pairs)


def test_held_out_toxicity(spark, sf_dir):
    """Of rows that the fit never sees: clean ones stay, and the ranking tells the toxic ones."""
    labels = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.1')}/labels.parquet")
    got = queries.op4_factorization_toxicity(spark, sf_dir.replace("sf0.001", "sf0.1")).join(labels, "doc_id").where("held_out and toxic is not null").select("toxic", "score", "predicted").toPandas()
    bad, good = got[got.toxic == 1], got[got.toxic == 0]
    assert (bad.predicted == 1).mean() >= 0.8 and (good.predicted == 1).mean() <= 0.01
    order = got.score.rank()
    assert (order[bad.index].sum() - len(bad) * (len(bad) + 1) / 2) / (len(bad) * len(good)) >= 0.95


def test_scores_follow_the_rate_of_all_rows(spark):
    """A balanced sample of a table with a tenth of toxic rows, whose texts tell nothing."""
    docs = spark.createDataFrame([(i, "plain words") for i in range(2000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(2000)], "doc_id long, toxic int")
    p = toxicity.score(docs.limit(1), toxicity.fit(docs, labels, rows_per_class=200)).first().score
    assert 0.05 < p < 0.2


def test_toxic_texts(spark):
    rng = random.Random(4)
    plain = [f"word{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choices(plain, k=40) + (["idiot", "scum"] if i % 5 == 0 else []))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)] + [(301, None), (302, 7)], "doc_id long, toxic int")
    m = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, m).collect()}
    assert all(got[i].predicted == int(i % 5 == 0) for i in range(300, 400))
    odd = toxicity.score(spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").withColumn("predicted", F.lit(True)), m).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == 0 for r in odd)
    one = toxicity.fit(docs, labels.where("toxic = 1"))
    assert toxicity.score(docs.limit(3), one).where("predicted = 1").count() == 3
    assert toxicity.score(docs.limit(0), toxicity.fit(docs, labels.limit(0))).collect() == []


# ---- embeddings ----


def _brute(rows):
    ids = [r[0] for r in rows]
    ok = [r[1] is not None and r[2] is not None and len(r[1]) and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    n, label = [0] * len(rows), list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i + 1, len(rows)):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], np.float32).astype(float), np.array(rows[j][1], np.float32).astype(float)
                if a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= 0.93:
                    n[i] += 1
                    n[j] += 1
                    x, y = sorted((label[i], label[j]), key=lambda k: ids[k])
                    label = [x if k == y else k for k in label]
    return {ids[i]: (n[i], ids[label[i]]) for i in range(len(rows))}


@pytest.mark.parametrize(("grid", "block"), [(0, 1), (0, 16), (10**9, 16)])
def test_links_equal_brute_force(spark, monkeypatch, grid, block):
    monkeypatch.setattr(embeddings, "GRID_ROWS", grid)
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rng = np.random.Generator(np.random.PCG64(2))
    rows = []
    for i in range(160):
        if i and i % 3 == 0:
            v = np.array(rows[rng.integers(0, len(rows))][1]) + rng.normal(0, rng.choice([0, 0.05, 0.12]), 24)
        else:
            v = rng.normal(0, 1, 24)
        rows.append((i * 7 % 160, [float(x) for x in v], int(rng.integers(0, 3))))
    rows += [(200, None, 1), (201, [0.0] * 24, 1), (202, [float("nan")] * 24, 1), (203, [1.0, None], 1), (204, rows[0][1], None), (205, [float("inf")] * 24, 1), (206, [], 1), (207, rows[5][1][:10], rows[5][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n", F.lit(1))
    got = {r.vec_id: r for r in embeddings.link(df).collect()}
    want = _brute(rows)
    assert {k: (r.n_links, r.component_id) for k, r in got.items()} == want
    assert all(r.kept == (r.component_id == r.vec_id) for r in got.values())


def test_links_of_copies_and_empty(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0], 1) for i in range(50)], "vec_id long, embedding array<float>, label int")
    assert {(r.n_links, r.component_id) for r in embeddings.link(df).collect()} == {(49, 0)}
    assert embeddings.link(df.limit(0)).collect() == []


# ---- HTML ----

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/a>A</a></li></ul></nav><div class="ad">Buy now</div><div class='cookie-notice'>We use cookies</div>
<article><h1>Title &amp; more</h1><p>First  <b>bold</b>\nline.<br><p>Second &lt;tag&gt; &eacute; &#8364;.</p><div class="advert">Ad</div><form><input value=x>Sign up</form>
<ul><li>Point one</li><li>Point two</li></ul><div class="share-buttons">Share</div></article>
<aside>Related</aside><section id="comments"><p>Great article with a very long comment that goes on and on and on for quite some time indeed.</p></section><footer>(c) 2020</footer></body></html>"""


def test_article_text():
    assert html.main_text(PAGE) == "Title & more\n\nFirst bold line.\n\nSecond <tag> é €.\n\nPoint one\n\nPoint two"


def test_density_finds_the_article_without_hints():
    links = "".join(f'<li><a href="/{i}">Some link text {i}</a></li>' for i in range(30))
    body = "".join(f"<p>{'Running text of the story goes here. ' * 6}{i}</p>" for i in range(8))
    text = html.main_text(f"<html><body><div><ul>{links}</ul></div><div><div>{body}</div></div></body></html>")
    assert text.count("\n\n") == 7 and "link" not in text


@pytest.mark.parametrize("wrap", ["<div class='content'>{}</div>", "<article><div>{}</div></article>", "<main><div>{}</div></main>"])
def test_unequal_sections_are_all_kept(wrap):
    """The densest section is not the whole article: smaller ones beside it, their headings and an introduction are kept too."""
    links = "".join(f'<li><a href="/{i}">Some link text {i}</a></li>' for i in range(30))
    section = lambda name, n: f"<h2>{name}</h2><div>" + "".join(f"<p>{name} {i} {'running text of the story ' * 12}</p>" for i in range(n)) + "</div>"
    intro = "Introduction of the story in words that stand between the blocks. " * 3
    inner = f"{intro}{section('One', 9)}{section('Two', 4)}{section('Three', 2)}"
    text = html.main_text(f"<html><body><div><ul>{links}</ul></div>{wrap.format(inner)}<div>All rights</div></body></html>")
    blocks = text.split("\n\n")
    assert [b[:12].split()[0] for b in blocks] == ["Introduction"] + ["One"] * 10 + ["Two"] * 5 + ["Three"] * 3
    assert "link" not in text and "rights" not in text


@pytest.mark.parametrize("page", ["", None, "<", "<<<>>>", "<p", "<!--", "<script>", "&amp;", "</div></p>", "<p>a<p>b<div>c", "<table><tr><td>x<td>y</table>", "<a" + " b" * 5000, "<div>" * 3000 + "deep"])
def test_broken_pages(page):
    assert isinstance(html.main_text(page), str)
    assert html.main_text("<p>a<p>b<div>c") == "a\n\nb\n\nc"


def test_teasers_called_article_are_not_the_article():
    """Tags don't decide: short article elements with links lose to a plain div of running text, also on the same level."""
    teasers = "".join(f'<article><h2><a href="/{i}">Headline number {i}</a></h2><p><a href="/{i}">Read all about {i}</a></p></article>' for i in range(12))
    story = "".join(f"<p>{'Running text of the story goes on. ' * 5}{i}</p>" for i in range(6))
    for page in (f"<body><div>{teasers}</div><div>{story}</div></body>", f"<body>{teasers}<div><h1>Story</h1>{story}</div></body>", f"<body><main>{teasers}</main><div>{story}</div><main>{teasers}</main></body>"):
        text = html.main_text(page)
        assert text.count("Running text of the story goes on.") == 30 and "Headline" not in text and "Read" not in text


def test_results_come_through_density(monkeypatch):
    """With one density for all elements menus and adverts stay in, and links win over the story."""
    links = "".join(f'<li><a href="/{i}">Some link text {i}</a></li>' for i in range(30))
    page = f"<body><nav>Menu here</nav><div><ul>{links}</ul></div><div>{'<p>' + 'Running text of the story. ' * 9 + '</p>'}<p>{'More of it. ' * 9}</p></div><div class=ad>Buy now</div></body>"
    right = html.main_text(page)
    plain = html._densities

    def flat(nodes):
        plain(nodes)
        for x in nodes:
            x.density = 1.0 if x.chars else 0.0

    monkeypatch.setattr(html, "_densities", flat)
    assert right.startswith("Running") and "link" not in right and "Buy" not in right and html.main_text(page) != right


def test_densities_equal_brute_force():
    """Characters for each tag, adjusted for links, counted anew for every element of random trees."""
    import xml.etree.ElementTree as ET

    rng = random.Random(3)

    def grow(depth):
        tag = rng.choice(["div", "section", "b", "a", "span"] if depth else ["span", "a"])
        inner = "".join(rng.choice(["some text ", "x", "", grow(depth - 1)]) for _ in range(rng.randint(1, 4))) if depth else "leaf text"
        return f"<{tag}>{inner}</{tag}>"

    def figures(e):
        inner = "".join(e.itertext()).replace(" ", "")
        below = [x for x in e.iter() if x is not e]
        links, at = 0, [(e, e.tag == "a")]
        while at:
            x, inside = at.pop()
            if inside:
                links += len("".join(x.itertext()).replace(" ", ""))
            else:
                at += [(c, c.tag == "a") for c in x]
        return len(inner), len(below), links, sum(x.tag == "a" for x in below)

    for _ in range(60):
        page = "<div>" + "".join(grow(3) for _ in range(3)) + "</div>"
        nodes = html._order(html._tree(page))
        html._densities(nodes)
        elements = list(ET.fromstring(page).iter())
        assert [x.name for x in nodes[1:]] == [e.tag for e in elements]
        whole = figures(elements[0])
        for x, e in zip(nodes[1:], elements, strict=True):
            c, t, lc, lt = figures(e)
            assert (x.chars, x.tags, x.link_chars, x.link_tags) == (c, t, lc, lt)
            base = np.log(c / max(1, c - lc) * lc + whole[2] / max(1, whole[0]) * c + np.e)
            want = c / max(1, t) * np.log(c / max(1, lc) * max(1, t) / max(1, lt) + 1) / np.log(base + 1) if c else 0
            assert x.density == pytest.approx(want)


@pytest.mark.parametrize("page", ["<p " * 100_000 + '"', "<b>" * 40_000 + "</i>" * 40_000, "<div><b><table>" + "<i>" * 40_000 + "</b>" * 40_000, "<i>" * 40_000 + "<hr>" * 40_000,
                                  "<i>" * 40_000 + "<li></li>" * 40_000, "<script>" + "</script " * 100_000, '<p a="x>' * 60_000, "<!--" * 100_000, "<table><tr><td>" * 20_000 + "<li></li>" * 20_000])
def test_long_broken_pages_take_no_long_time(page):
    import time

    start = time.process_time()
    html.main_text(page)
    assert time.process_time() - start < 20  # seconds; a way back for each tag would take many minutes


def test_extract_rows(spark):
    df = spark.createDataFrame([(1, "u", PAGE, 5), (1, "u", PAGE, 5), (2, None, None, 6)], "page_id long, url string, html string, n_chars int")
    rows = html.extract(df).collect()
    assert sorted((r.page_id, r.n_chars) for r in rows) == [(1, len(html.main_text(PAGE)))] * 2 + [(2, 0)]
    assert {r.page_id: r.text for r in rows}[2] == "" and html.extract(df.limit(0)).collect() == []


# ---- quality ----


def _measures(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    c, inside = Counter(zip(w, w[1:], w[2:], strict=False)), set()
    for i in range(len(w) - 2):
        if c[tuple(w[i : i + 3])] > 1:
            inside |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t or ""), len(lines) - len(set(lines)), len(inside)


def test_measures_equal_brute_force(spark):
    rng = random.Random(6)
    texts = [t for t in ODD] + ["".join(rng.choices("ab \n#\t", k=rng.randint(0, 300))) for _ in range(150)] + ["a b c a b c", "a a a a", "a b c d b c d", " x y", "one two three"]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], DOCS).withColumns({"n_words": F.lit("x"), "kept": F.lit(1), "n": F.lit(2)})
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.judge(df).collect()}
    assert got == {i: _measures(t) for i, t in enumerate(texts)}


def _words(rng, n, sizes, mark=""):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.choice(sizes))) + mark for _ in range(n))


@pytest.mark.parametrize("broadcast", [runtime.SMALL_ROWS, 0])
def test_fences_follow_the_group(spark, monkeypatch, broadcast):
    """Place and width of the fences differ by group: what is usual in one is beyond the fence in another."""
    monkeypatch.setattr(quality, "LEAST_GROUP", 20)
    monkeypatch.setattr(runtime, "SMALL_ROWS", broadcast)
    rng = random.Random(7)
    even, wide = [5, 6, 7], [2, 4, 6, 8, 10]
    rows = [(i, _words(rng, 80, even), "en", "s1") for i in range(60)] + [(100 + i, _words(rng, 80, wide, "##"), "en", "s2") for i in range(60)]
    rows += [(200, _words(rng, 80, even, "##"), "en", "s1"), (201, "short", "en", "s1"), (202, _words(rng, 80, even), None, None)]
    rows += [(203, _words(rng, 80, [7]), "en", "s1"), (204, _words(rng, 80, [7], "##"), "en", "s2")]  # a letter longer
    rows += [(205, _words(rng, 80, even) + " #####", "en", "s1")]  # a few symbols are chance
    df = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in quality.judge(df).collect()}
    assert all(got[i].kept for i in [*range(60), *range(100, 160), 202, 204, 205])
    assert not got[200].kept and not got[200].base_failed and not got[203].kept and got[201].base_failed
    limits = {r["__source"]: r for r in quality.fences(quality.measured(df)).collect()}
    assert limits["s2"].high - limits["s2"].low > 2 * (limits["s1"].high - limits["s1"].low)
    assert limits["s2"].fence_symbols_per_word > 1 and limits["s1"].fence_symbols_per_word == 0
    assert quality.judge(spark.createDataFrame([], DOCS)).collect() == []


# ---- BPE ----


@pytest.fixture(scope="module")
def tokens():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def test_ids_equal_the_library(tokens):
    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens) if t}, special_tokens={})
    rng = random.Random(9)
    texts = [t or "" for t in ODD] + ["".join(rng.choice("ab 1'srevltmd\n\t!.é　²🙂 ") for _ in range(rng.randint(1, 80))) for _ in range(600)] + ["<|endoftext|>", "'ll've", "thequick" * 100]
    enc = bpe.encoder(tokens, public_tokenizers.PATTERN)
    for made in (enc.encode(texts), enc._by_regex(texts)):
        ids, first = made
        assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == [ref.encode_ordinary(t) for t in texts]


def test_encode_and_decode_columns(spark, tokens):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(ODD)] + [(0, "", 1)], "doc_id long, text string, ids int")
    coded = bpe.encode(df, tokens, public_tokenizers.PATTERN)
    back = bpe.decode(coded, tokens)
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in back.collect()) and back.count() == len(ODD) + 1
    d = {r.doc_id: r for r in bpe.digests(df, tokens, public_tokenizers.PATTERN).collect()}
    for r in coded.collect():
        assert d[r.doc_id].n_tokens == len(r.ids) and d[r.doc_id].ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest()
        assert d[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert bpe.digests(df.limit(0), tokens, public_tokenizers.PATTERN).collect() == []


def test_full_cache_changes_nothing(tokens, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 8)
    enc = bpe.Encoder(bpe.Vocabulary(tokens, public_tokenizers.PATTERN))
    for t in (["many different words stand here in a row"], ["other words follow after that one too"]):
        assert enc.encode(t)[0].tolist() == enc._by_regex(t)[0].tolist()


# ---- mixing ----


def _shares(amount, weights, limits):
    """Round by round: what a full child can't take goes to the others by weight."""
    out, left = [0.0] * len(weights), amount
    open_ = {i for i, w in enumerate(weights) if w > 0 and limits[i] > 0}
    while open_ and left > 1e-9:
        total = sum(weights[i] for i in open_)
        parts = {i: left * weights[i] / total for i in open_}
        full = {i for i in open_ if out[i] + parts[i] >= limits[i] - 1e-12}
        for i in full or open_:
            left -= (limits[i] if full else out[i] + parts[i]) - out[i]
            out[i] = limits[i] if full else out[i] + parts[i]
        open_ -= full
        if not full:
            break
    return out


def _budgets(leaves, total, weights, default=1.0, prefix=()):
    """By recursion over a tree of dictionaries."""
    if len(prefix) == 3:
        return {prefix: int(min(total, leaves[prefix]) + 1e-6)}
    mine = [p for p in leaves if p[: len(prefix)] == prefix]
    names = list(dict.fromkeys(p[: len(prefix) + 1] for p in mine))
    useful = lambda p: all(weights.get(p[:k], default) > 0 for k in range(1, 4))
    limits = [sum(leaves[p] for p in mine if p[: len(c)] == c and useful(p)) for c in names]
    out = {}
    for c, part in zip(names, _shares(total, [weights.get(c, default) for c in names], limits), strict=True):
        out |= _budgets(leaves, part, weights, default, c)
    return out


def _made(spark, leaves, total, weights):
    df = spark.createDataFrame([(*p, float(v)) for p, v in leaves.items()], "__domain string, __lang string, __source string, supply double")
    return {tuple(r)[:3]: r.goal for r in mixing.budgets(df, total, weights).collect()}


def test_shortage_goes_to_siblings_first(spark):
    leaves = {("a", "en", "s1"): 10.0, ("a", "en", "s2"): 500.0, ("a", "de", "s1"): 500.0, ("b", "en", "s1"): 500.0}
    assert _made(spark, leaves, 400, {}) == {("a", "en", "s1"): 10, ("a", "en", "s2"): 90, ("a", "de", "s1"): 100, ("b", "en", "s1"): 200}
    leaves = {("a", "en", "s1"): 10.0, ("a", "de", "s1"): 20.0, ("b", "en", "s1"): 500.0}
    assert _made(spark, leaves, 200, {}) == {("a", "en", "s1"): 10, ("a", "de", "s1"): 20, ("b", "en", "s1"): 170}
    assert _made(spark, leaves, 200, {("b",): 0.0}) == {("a", "en", "s1"): 10, ("a", "de", "s1"): 20, ("b", "en", "s1"): 0}


@pytest.mark.parametrize("seed", range(3))
def test_budgets_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    leaves = {(f"d{i}", rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", None])): float(rng.choice([0, 5, 80, 900])) for i in range(4) for _ in range(6)}
    weights = {("d0",): 4.0, ("d1",): 0.0 if seed else 2.0, ("d2", "en"): 3.0, ("d2", None): 0.5, ("d3", "de", "s1"): 7.0, ("d0", "en", "s2"): 0.0}
    for total in (0, 50, 700, 10**6):
        got, want = _made(spark, leaves, total, weights), _budgets(leaves, total, weights)
        assert got.keys() == want.keys() and all(abs(got[p] - want[p]) <= 1 for p in want)


def _brute_mix(rows, goal, epochs, seed, spark):
    """Prefixes by sorting each leaf by the same order."""
    out = Counter()
    df = spark.createDataFrame(rows, DOCS)
    supply = Counter()
    for _, t, lang, s in rows:
        supply[("d", lang, s)] += len((t or "").split())
    whole = {p: divmod(goal[p], supply[p]) if supply[p] else (0, None) for p in supply}
    u = {}
    for w in {v[0] for v in whole.values()}:
        for r in df.select("*", runtime.unit_hash(F.col("doc_id").cast("string"), F.col("text"), F.lit(w).cast("int"), seed=seed).alias("u")).collect():
            u[(r.doc_id, w)] = r.u
    for p, (w, rest) in whole.items():
        mine = sorted((x for x in rows if ("d", x[2], x[3]) == p), key=lambda x: u[(x[0], w)])
        total, going = 0, rest is not None
        for d, t, *_ in mine:
            total += len((t or "").split())
            going = going and total <= rest
            if w + going:
                out[d] = w + going
    return out


@pytest.mark.parametrize(("share", "small"), [(0.3, 0), (1.0, 100), (1.7, 100)])
def test_mix_equals_brute_force(spark, monkeypatch, share, small):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 8)
    monkeypatch.setattr(runtime, "SMALL_ROWS", small)
    rng = random.Random(11)
    rows = [(i, "w " * rng.randint(0, 9) if i % 17 else None, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3"])) for i in range(300)]
    df = spark.createDataFrame(rows, DOCS).withColumn("epoch", F.lit("x"))
    weights = {("d", "en"): 3.0, ("d", "de", "s1"): 5.0}
    got = Counter(r.doc_id for r in mixing.mix(df, F.lit("d"), weights, share, epochs=2, seed=5).collect())
    supply = Counter()
    for _, t, lang, s in rows:
        supply[("d", lang, s)] += len((t or "").split())
    goal = _budgets({p: 2.0 * n for p, n in supply.items()}, share * sum(supply.values()), weights)
    assert got == _brute_mix(rows, goal, 2, 5, spark)
    assert mixing.mix(df.limit(0), F.lit("d"), {}).collect() == []
