"""Near-duplicates and repeated passages against brute force, and what odd tables give."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from pagelode.llm import components, minhash, substring
from pagelode.llm.words import Words, shingle_set

DOCS = "doc_id long, text string"


def _texts(seed, n=40, length=120):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    out = []
    for _ in range(n):
        base = [word() for _ in range(length)]
        out.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 3])):
            near = list(base)
            for _ in range(rng.choice([0, 1, 2, 8])):
                near[rng.randrange(length)] = word()
            out.append(" ".join(near))
    return out


def _classes(texts):
    sets = [shingle_set(t) for t in texts]
    label = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and label[i] != label[j]:
            a, b = sorted((label[i], label[j]))
            label = [a if x == b else x for x in label]
    return label


def test_words_and_shingles():
    w = Words(pa.array(["a b  a", None, "", "x\ny\tz é q r", " a"]))
    assert np.diff(w.first).tolist() == [3, 0, 0, 6, 1]
    assert w.hash[0] == w.hash[2] == w.hash[-1] != w.hash[1]
    elements, first = w.shingles(5)
    assert np.diff(first).tolist() == [1, 0, 0, 2, 1] and len(set(elements.tolist())) == 4


def test_signatures_estimate_similarity():
    rng = np.random.Generator(np.random.PCG64(1))
    sets = rng.integers(0, 2**63, 600, dtype=np.uint64)
    a, b = sets[:400], sets[100:500]  # 300 of 500
    s = minhash.signatures(np.concatenate([a, b]), np.array([0, 400, 800]), 2000)
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.05
    weights = np.concatenate([np.full(400, 1.0), np.where(np.arange(400) < 300, 3.0, 0.5)])
    s = minhash.signatures(np.concatenate([a, b]), np.array([0, 400, 800]), 2000, weights)
    assert abs((s[0] == s[1]).mean() - 300 / (100 + 900 + 50)) < 0.05
    assert (minhash.signatures(a[:1], np.array([0, 1, 1]), 64)[1] == 2**64 - 1).all()


def test_tune_reaches_recall():
    bands, rows = minhash.tune(0.8, 0.999, 40)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999 and bands <= 40


def test_classes_equal_brute_force(spark):
    texts = _texts(3)
    got = minhash.dedup(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()
    assert [r.class_id for r in sorted(got, key=lambda r: r.doc_id)] == _classes(texts)


def test_group_around_a_base_and_mixed_buckets(spark, monkeypatch):
    """Many edits of one text: members link through others, and blocks of buckets are compared in full."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(90):
        t = list(base)
        for _ in range(rng.choice([1, 2, 3, 4])):
            t[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(t))
    got = minhash.dedup(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()
    assert [r.class_id for r in sorted(got, key=lambda r: r.doc_id)] == _classes(texts)


def test_dedup_of_odd_rows(spark):
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    rows = [(1, None, 9), (2, "", 9), (3, " \n ", 9), (4, "one two", 9), (5, "one two", 9), (5, "one two", 9), (None, "one two", 9), (7, long, 9), (8, long + " end", 9), (9, "two one", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    got = sorted(((r.doc_id, r.class_id, r.kept) for r in minhash.dedup(df).collect()), key=str)
    assert got == sorted([(1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (5, 4, False), (5, 4, False), (None, None, True), (7, 7, True), (8, 7, False), (9, 9, True)], key=str)
    assert minhash.dedup(spark.createDataFrame([], DOCS)).collect() == []


def test_components_follow_long_chains(spark):
    links = [(i + 1, i) for i in range(60)] + [(100, 101), (101, 100), (5, 5), (None, 3)]
    got = dict(map(tuple, components.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


@pytest.mark.parametrize("ends", [False, True])
def test_components_of_shuffled_paths(spark, ends):
    """Ids in no order, and the two smallest ids at the two ends: rounds must not grow with the length."""
    ids = [0, *range(2, 3000), 1] if ends else random.Random(3).sample(range(3000), 3000)
    links = spark.createDataFrame(list(itertools.pairwise(ids)), "a long, b long")
    assert {tuple(r) for r in components.components(links).collect()} == {(i, 0) for i in range(3000)}


def _passages(rng, words):
    return " ".join("".join(rng.choices("klmnopqrs", k=6)) for _ in range(words))


def test_passages_are_cut_from_later_documents(spark):
    rng = random.Random(8)
    passage, other = _passages(rng, 70), _passages(rng, 60)
    mid = lambda p: f"{_passages(rng, 45)} {p} {_passages(rng, 45)}"
    rows = [(1, mid(passage)), (2, mid(passage)), (3, f"{_passages(rng, 20)}\n{passage}\n{_passages(rng, 20)}"), (4, mid("")), (5, f"head\n{other}\ntail"), (6, f"top\n{other.replace(other.split()[30], 'changed')}\nend"), (7, None), (8, "")]
    rows += [(9, mid(passage[:150])), (10, mid(passage) + " é"), (None, passage)]
    got = {r.doc_id: r for r in substring.dedup(spark.createDataFrame(rows, DOCS)).collect()}
    text = dict(rows)
    assert {d for d, r in got.items() if r.spans} == {2, 3, 6, 10}
    assert got[2].earlier == [1] and got[6].earlier == [5]
    for d in (2, 3, 10):
        left = set(zip(*[got[d].text.split()[k:] for k in range(40)], strict=False))
        assert not left & set(zip(*[passage.split()[k:] for k in range(40)], strict=False))
        assert got[d].text.split()[:15] == text[d].split()[:15]
    assert got[6].text == "top\nend"
    for d in (1, 4, 5, 7, 8, 9, None):
        assert got[d].text == text[d]


def test_passages_of_odd_tables(spark):
    assert substring.dedup(spark.createDataFrame([], DOCS)).collect() == []
    same = " ".join(["of"] * 400)
    rows = [(1, same, [1]), (1, same, [1]), (2, "x " * 30_000, [2])]
    got = substring.dedup(spark.createDataFrame(rows, "doc_id long, text string, doc array<int>")).collect()
    assert [r.text for r in got if r.doc_id == 1] == [same, same]


def test_equal_runs_share_an_anchor():
    """Any 25 equal words of two texts have a gram in common, wherever they stand."""
    rng = random.Random(2)
    for _ in range(200):
        p = _passages(rng, 2 * substring.GRAM - 5)
        _, row, _, key = substring.anchors(pa.array([f"{_passages(rng, rng.randint(0, 30))} {p} {_passages(rng, rng.randint(0, 30))}" for _ in range(2)]))
        assert set(key[row == 0].tolist()) & set(key[row == 1].tolist())
    assert len(substring.anchors(pa.array(["one", "", None]))[1]) == 0


def _repeated(texts, n=50):
    """Words of each text that stand in a window of n words that a text with a smaller number holds too."""
    seen, out = set(), []
    for t in texts:
        w = t.split()
        windows = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
        out.append({i + k for i, x in enumerate(windows) if x in seen for k in range(n)})
        seen |= set(windows)
    return out


def test_passages_equal_brute_force(spark):
    """Passages of 40 to 70 words in any place, also across line ends: exactly the words of repeated windows of 50 words go."""
    rng = random.Random(14)
    shared = [_passages(rng, n).split() for n in (40, 49, 50, 50, 51, 52, 55, 60, 70)]
    texts = []
    for _ in range(60):
        w = _passages(rng, rng.randint(10, 60)).split()
        for p in rng.sample(shared, rng.randint(0, 3)):
            w += p + _passages(rng, rng.randint(3, 40)).split()
        texts.append("".join(x + rng.choice(["  ", " ", " ", " ", " ", " ", " ", " ", " ", "\n"]) for x in w))
    got = {r.doc_id: r for r in substring.dedup(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    for i, (t, gone) in enumerate(zip(texts, _repeated(texts), strict=True)):
        assert got[i].text.split() == [x for k, x in enumerate(t.split()) if k not in gone]
        assert bool(got[i].spans) == bool(gone)


@pytest.mark.parametrize("change", [["new"], [], ["new", "old"]])
def test_passages_with_one_word_changed(spark, change):
    """One word replaced, left out or put in (two words for one here): edit distance one in the middle of 56 words."""
    rng = random.Random(15)
    p = _passages(rng, 56).split()
    edited = p[:28] + change[:1] + (p[28 + (len(change) < 2) :])
    mid = lambda w: f"{_passages(rng, 30)} {' '.join(w)} {_passages(rng, 30)}"
    rows = [(-5, mid(p)), (7, mid(edited)), (8, mid(p[:28] + ["x", "y", "z"] + p[28:]))]
    got = {r.doc_id: r for r in substring.dedup(spark.createDataFrame(rows, DOCS)).collect()}
    assert len(got[7].text.split()) == 60 and got[7].earlier == [-5] and got[8].spans == [] and got[-5].spans == []


def test_phrases_repeated_over_and_over(spark):
    """Stretches of one phrase are the same wherever they begin; a phrase repeated for less than 50 words stays."""
    rng = random.Random(17)
    phrase = _passages(rng, 7).split()
    turned = lambda k, n: " ".join((phrase[k:] + phrase[:k]) * 20).split()[:n]
    own = [_passages(rng, 20) for _ in range(5)]
    rows = [(1, f"{own[0]} {' '.join(turned(0, 80))} {own[0]}"), (2, f"{own[1]} {' '.join(turned(3, 61))} {own[1]}"), (3, f"{own[2]} {' '.join(turned(2, 40))}"), (4, "the " * 200), (5, f"{own[3]}\n{'the ' * 90}\n{own[4]}"), (6, "of " * 49)]
    got = {r.doc_id: r for r in substring.dedup(spark.createDataFrame(rows, DOCS)).collect()}
    assert {d: r.earlier for d, r in got.items()} == {1: [], 2: [1], 3: [], 4: [], 5: [4], 6: []}
    assert got[2].text == f"{own[1]} {own[1]}" and got[5].text == f"{own[3]}\n{own[4]}"


def test_ids_of_any_size_and_texts_of_one_id(spark):
    rng = random.Random(16)
    p, q = _passages(rng, 60), _passages(rng, 60)
    big = 2**63 - 1
    rows = [(-(2**63), f"a {p} b"), (big, f"c {p}\nd"), (2**42, f"{q}"), (big, f"top\n{q}\nend"), (big, f"{_passages(rng, 9)}"), (big, f"e {p}")]
    got = substring.dedup(spark.createDataFrame(rows, DOCS)).collect()
    # the lines with a word or two more are near-duplicates and go as a whole
    assert sorted(r.text for r in got if r.doc_id == big) == sorted(["d", "top\nend", rows[4][1], ""])
    assert {r.text for r in got if r.doc_id != big} == {rows[0][1], q}


def test_cuts_leave_no_empty_lines():
    line = "one two three"
    for text, span, left in [(f"a\n {line} \nb", (3, 16), "a\nb"), (f"{line}\nb", (0, 13), "b"), (f"a\n{line}", (2, 15), "a"), (line, (0, 13), ""), (f"a {line} b", (2, 15), "a b"), (f"a {line}\nb", (2, 15), "a \nb")]:
        assert substring._cut(text, [span]) == left
    assert substring._cut("x\nab\ncd\ny", [(2, 4), (5, 7)]) == "x\ny"


@pytest.mark.parametrize("seed", range(3))
def test_signature_weights_of_one_equal_sets(seed):
    rng = np.random.Generator(np.random.PCG64(seed))
    e = rng.integers(0, 2**63, 50, dtype=np.uint64)
    assert (minhash.signatures(e, np.array([0, 50]), 128) == minhash.signatures(e, np.array([0, 50]), 128, np.ones(50))).all()
