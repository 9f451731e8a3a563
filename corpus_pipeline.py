"""A corpus pipeline: language ID, near-duplicates, repeated passages, mixing to target weights, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents. Every stage works on all that the one before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelode.llm import bpe, langid, minhash, mixing, substring
from pagelode.llm.queries import mix_domain, mix_weights
from pagelode.llm.runtime import fold, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Share of the tokens at hand that the mix takes; no document is taken twice.
MIX_SHARE, MIX_SEED = 0.8, 11


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known go on; ``lang`` stays as it was. Rejected are texts that are null, empty or without a
    letter, and texts far from all languages learned here. Without a labelled row no language is known and none goes on.
    Repeated rows are judged alike; ties go to the language that sorts first. Columns beside those of documents go."""
    model = langid.fit(docs.where(fold(F.col("doc_id")) != 1))
    found = langid.predict(docs.select(*COLUMNS), model, keep_text=True)
    return found.where(~F.col("rejected")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest id stays; equal ids are one document, and repeated rows
    of it stay together. Null and empty texts, and rows without an id, are classes of their own. Columns beside those of
    documents go; an empty table stays empty."""
    return minhash.dedup(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are cut out; a document of which nothing is left goes. n_chars follows. Null and
    empty texts, and rows without an id, stay as they are; repeated rows are cut alike and don't repeat one another. Columns
    beside those of documents go; an empty table stays empty."""
    left = substring.dedup(docs.select(*COLUMNS))
    whole = (F.size("spans") == 0) | (F.btrim(F.col("text"), F.lit(" \t\n\x0b\f\r")) != "")
    chars = F.when(F.size("spans") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return left.where(whole).withColumn("n_chars", chars).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents chosen so that domains, languages and sources come near their target weights. Null languages and sources are
    keys of their own; null and empty texts have no tokens and are not chosen. Repeated rows count each, ties in the order go
    by id and text. Columns beside those of documents go; an empty table stays empty."""
    return mixing.mix(docs.select(*COLUMNS), mix_domain(), mix_weights(), share=MIX_SHARE, seed=MIX_SEED).select(*COLUMNS)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the token ids of every text and of the bytes that they decode to; a null text counts as empty. Each row has one
    row, repeated ones too; an empty table stays empty."""
    import public_tokenizers

    tokens = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    coded = bpe.digests(docs.select("doc_id", "text", "lang", "source"), tokens, public_tokenizers.PATTERN)
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language_id", identify_language),
    ("minhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("byte_level_bpe", encode_tokens),
]
#: Language models, signatures and merges are beyond SQL; tests/llm compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}", release=True)
    return docs
