"""The registered queries of this subpackage, ``opN_<name>``, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embeddings, html, langid, minhash, mixing, quality, sharding, substring, toxicity
from .runtime import fold

SHARDS = 16
#: Target weights of the mix by path: domains, and languages within any domain; sources of a language weigh alike.
DOMAIN_WEIGHTS = {"d0": 0.4, "d1": 0.3, "d2": 0.2, "d3": 0.1}
LANG_WEIGHTS = {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}
MIX_SHARE, MIX_SEED = 0.7, 10


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix_domain() -> Column:
    """The tables name no domain; sources are dealt to four domains by the number in their name."""
    return F.concat(F.lit("d"), F.pmod(F.coalesce(F.expr("try_cast(regexp_extract(source, '[0-9]+', 0) AS bigint)"), F.lit(0)), F.lit(4)).cast("string"))


def mix_weights() -> dict[tuple, float]:
    return {(d,): w for d, w in DOMAIN_WEIGHTS.items()} | {(d, lang): w for d in DOMAIN_WEIGHTS for lang, w in LANG_WEIGHTS.items()}


def op1_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "kept")


def op2_hypergeometric_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return sharding.shard(docs, SHARDS, seed=20).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op3_kneser_ney_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(fold(F.col("doc_id")) != 1))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op4_factorization_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    machine = toxicity.fit(docs, labels.where(fold(F.col("doc_id")) != 1))
    found = toxicity.score(docs.select("doc_id", "text"), machine)
    return found.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "score", "predicted")


def op5_pca_tiled_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.link(_table(spark, sf_dir, "embeddings"))


def op6_text_density_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op7_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substring.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select(
        "doc_id", F.size("spans").cast("long").alias("n_spans"), "spans", F.col("earlier").alias("earlier_doc_ids"),
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars_left"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_left_crc32"),
    )


def op8_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    tokens = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(docs, tokens, public_tokenizers.PATTERN).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op10_hierarchical_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    chosen = mixing.mix(docs, mix_domain(), mix_weights(), share=MIX_SHARE, epochs=2, seed=MIX_SEED)
    return chosen.select("doc_id", mix_domain().alias("domain"), "lang", "source", "epoch")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}
    return dict(sorted(found.items(), key=lambda kf: int(kf[0][2:].split("_")[0])))


_CLOSURE = """reach AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a)"""

#: Exact Jaccard similarity of all pairs of texts that share a five-word shingle, and what links reach.
_OP1 = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
  s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i+4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws)-3, 2))) AS i FROM w WHERE len(ws) > 0)),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
  p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
  l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE k >= 0.8 * (x.n + y.n - k) - 1e-9),
  e AS (SELECT a, b FROM l UNION SELECT b, a FROM l), {_CLOSURE},
  c AS (SELECT a, min(b) AS b FROM reach GROUP BY 1)
  SELECT doc_id, least(doc_id, coalesce(b, doc_id)) AS class_id, least(doc_id, coalesce(b, doc_id)) = doc_id AS kept FROM documents LEFT JOIN c ON a = doc_id"""

#: Cosines of all pairs of a label, in double precision.
_OP5 = f"""WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
  o AS (SELECT *, sqrt(list_sum(list_transform(x, lambda y: y * y))) AS n FROM v),
  l AS (SELECT p.vec_id AS a, q.vec_id AS b FROM o p JOIN o q ON p.label = q.label AND p.vec_id < q.vec_id AND len(p.x) = len(q.x) AND p.n > 0 AND q.n > 0 WHERE list_dot_product(p.x, q.x) / (p.n * q.n) >= 0.93),
  e AS (SELECT a, b FROM l UNION SELECT b, a FROM l), {_CLOSURE},
  c AS (SELECT a, min(b) AS b FROM reach GROUP BY 1), d AS (SELECT a, count(*) AS k FROM e GROUP BY 1)
  SELECT vec_id, coalesce(k, 0) AS n_links, least(vec_id, coalesce(c.b, vec_id)) AS component_id, least(vec_id, coalesce(c.b, vec_id)) = vec_id AS kept
  FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN d ON d.a = vec_id"""


def _op8() -> str:
    """Quantiles are exact here, as the sketches are while a group has fewer values than they hold."""
    k, z, least, low, tail = quality.FENCE, quality.CHANCE, quality.LEAST_GROUP, quality.LOW_TAIL, quality.TAIL
    figures = [quality.MEAN, *quality.RATES]
    quantiles = lambda s: ", ".join(f"quantile_disc({r}, {low}) AS a{s}_{r}, quantile_disc({r}, 0.5) AS m{s}_{r}, quantile_disc({r}, {tail}) AS b{s}_{r}" for r in figures)
    pick = lambda end, r: f"CASE WHEN g.n >= {least} THEN g.{end}g_{r} WHEN l.n >= {least} THEN l.{end}l_{r} ELSE w.{end}w_{r} END"
    fence = lambda end, r: f"({pick(end, r)} + {k}::DOUBLE * ({pick(end, r)} - {pick('m', r)}))"
    inside = f"m.{quality.MEAN} BETWEEN {fence('a', quality.MEAN)} AND {fence('b', quality.MEAN)}"
    for r, n in quality.RATES.items():
        inside += f" AND m.{r} <= {fence('b', r)} + ({z}::DOUBLE * sqrt({pick('b', r)} / m.n_{n[2:]}) + {z * z}::DOUBLE / m.n_{n[2:]})"
    blank = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return rf"""WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
  x AS (SELECT doc_id, i, array_to_string(ws[i:i+2], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws)-1)) AS i FROM d)),
  r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM x) WHERE c > 1),
  c AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + k AS p FROM r, (SELECT unnest([0, 1, 2]) AS k)) GROUP BY 1),
  b AS (SELECT doc_id, lang, source, len(ws) AS n_words, coalesce(CAST(list_sum(list_transform(ws, lambda y: length(y))) AS BIGINT), 0) AS word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda y: trim(y, {blank}) <> '') AS ls, coalesce(c.n, 0) AS n_repeat_words FROM d LEFT JOIN c USING (doc_id)),
  m AS (SELECT *, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_chars, CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbols_per_word,
    CASE WHEN len(ls) > 0 THEN (len(ls) - len(list_distinct(ls))) / len(ls) ELSE 0 END AS dup_line_share, CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END AS repeat_word_share FROM b),
  f AS (SELECT * FROM m WHERE NOT base_failed), g AS (SELECT lang, source, count(*) AS n, {quantiles('g')} FROM f GROUP BY 1, 2), l AS (SELECT lang, count(*) AS n, {quantiles('l')} FROM f GROUP BY 1), w AS (SELECT {quantiles('w')} FROM f)
  SELECT m.doc_id, m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, m.base_failed, NOT m.base_failed AND coalesce({inside}, false) AS kept
  FROM m LEFT JOIN g ON g.lang IS NOT DISTINCT FROM m.lang AND g.source IS NOT DISTINCT FROM m.source LEFT JOIN l ON l.lang IS NOT DISTINCT FROM m.lang, w"""


def oracle_sql() -> dict[str, str]:
    """Sharding, models, tokenizing, page text, passages and seeded prefixes are beyond SQL; tests/llm has their brute force."""
    return {"op1_dart_minhash": _OP1, "op5_pca_tiled_embeddings": _OP5, "op8_adaptive_quality": _op8()}
