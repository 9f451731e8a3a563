"""The pipeline end to end on a small corpus, against what each stage must do."""

import random
from collections import Counter

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from pagelode.llm import bpe


def _sentence(rng, words, k):
    return " ".join(rng.choices(words, k=k))


def test_pipeline(spark, tmp_path):
    rng = random.Random(12)
    made = {lang: ["".join(rng.choices(letters, k=rng.randint(3, 8))) for _ in range(2000)] for lang, letters in (("en", "etaoinshr"), ("de", "äöüchwzkg"))}
    rows = [(i, _sentence(rng, made[lang], 120), lang, f"src{i % 4}") for i, lang in enumerate(["en", "de"] * 40)]
    passage = _sentence(rng, made["en"], 80)
    text = {r[0]: r[1] for r in rows}
    rows += [(100, text[0], "en", "src0"), (101, text[2] + " extra", "en", "src1"), (102, "12 34 !!", "en", "src1"), (103, None, "en", "src1"), (104, "Это другой язык " * 30, None, "src2")]
    rows += [(d, f"{_sentence(rng, made['en'], 50)} {passage} {_sentence(rng, made['en'], 50)}", "en", "src3") for d in (110, 111)]
    rows = [(*r, len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == corpus_pipeline.COLUMNS
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r.doc_id: r for r in docs.collect()}
    everyone = {r[0] for r in rows}
    assert set(kept["language_id"]) == everyone - {102, 103, 104}
    assert set(kept["minhash_near_dedup"]) == everyone - {100, 101, 102, 103, 104}
    cut = kept["substring_dedup"]
    assert set(cut) == set(kept["minhash_near_dedup"]) and passage in cut[110].text and passage[60:400] not in cut[111].text
    assert all(r.n_chars == len(r.text) for r in cut.values()) and all(cut[i].text == text[i] for i in range(80))
    assert 0.6 < sum(len(r.text.split()) for r in kept["mixing"].values()) / sum(len(r.text.split()) for r in cut.values()) <= 0.8
    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))) if t}, special_tokens={})
    got = {r.doc_id: r.n_tokens for r in corpus_pipeline.STAGES[4][1](spark, docs, str(tmp_path)).collect()}
    assert got == {d: len(ref.encode_ordinary(r.text)) for d, r in kept["mixing"].items()}


def test_pipeline_of_an_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_stages_of_odd_tables(spark, tmp_path):
    """Repeated rows, nulls in any column, and other columns whose names clash with those that operators add."""
    rng = random.Random(13)
    made = ["".join(rng.choices("etaoinshr", k=rng.randint(3, 8))) for _ in range(500)]
    rows = [(i, _sentence(rng, made, 90), "en", "src1") for i in range(20)]
    rows += [rows[3], rows[3], (None, rows[4][1], "en", "src2"), (50, None, None, None), (51, "", "en", None), (52, _sentence(rng, made, 70), None, None), (53, rows[5][1], "en", None)]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    clash = {c: F.lit(1) for c in ("uid", "kept", "class_id", "label", "spans", "earlier", "epoch", "lang_pred", "score", "rejected", "__whole", "version", "tokens")}
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs.withColumns(clash), str(tmp_path))
        assert out.columns == corpus_pipeline.COLUMNS and stage(spark, docs.limit(0), str(tmp_path)).collect() == []
    kept = Counter(r.doc_id for r in corpus_pipeline.STAGES[1][1](spark, docs, str(tmp_path)).collect())
    assert kept == Counter({**dict.fromkeys([*range(20), 50, 51, 52], 1), 3: 3, None: 1})
    assert corpus_pipeline.STAGES[4][1](spark, docs.withColumns(clash), str(tmp_path)).count() == len(rows)


def test_the_driver_gives_memory_back_between_plans(spark, monkeypatch):
    from pagelode.llm import components, runtime

    assert runtime.give_back(spark)
    calls = []
    monkeypatch.setattr(runtime, "give_back", lambda s: calls.append(s))
    label = components.components(spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a long, b long"))
    assert {(r.node, r.label) for r in label.collect()} == {(1, 1), (2, 1), (3, 1), (4, 1)}
    assert calls  # after each round
