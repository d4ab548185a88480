"""The queries of this package over the sample tables, and SQL where SQL can express them."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from chronaudit.llm import (
    block_topk,
    cross_polytope,
    pair_index,
    piece_merge,
    secret_scan,
    simhash,
    site_quality,
    source_mix,
    token_counts,
    token_files,
    token_overlap,
    url_rules,
    whitening,
)
from chronaudit.llm.common import reach_workers, scratch_path

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_oracles: dict[str, str] = {}


def _bound(name: str, sql: str | None = None):
    def register(query):
        @functools.wraps(query)
        def run(spark, folder):
            reach_workers(spark)
            return query(spark, folder)

        _queries[name] = run
        if sql is not None:
            _oracles[name] = sql
        return query

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracles() -> dict[str, str]:
    return dict(_oracles)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


@_bound("op1_token_counts")
def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(
        _table(spark, folder, "documents"),
        cache_path=scratch_path(spark, "token-counts"),
        tokenizer_path=public_tokenizers.path("word_bpe_49k.json"),
        collapse_spaces=True,
    )


@_bound("op2_token_files")
def op2_token_files(spark: SparkSession, folder: str) -> DataFrame:
    files = scratch_path(spark, "token-files")
    token_files.write_token_files(
        _table(spark, folder, "documents"), files, public_tokenizers.path("byte_bpe_50k.json"), end_id=2
    )
    return token_files.read_token_files(spark, files)


@_bound("op3_pair_index_bpe")
def op3_pair_index_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return pair_index.round_trip(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


WORDS = r"[^\x20\x09-\x0D]+"

SQL_MIX = rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORDS}')) AS size,
         md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS draw
  FROM documents
), weighed AS (
  SELECT source, source_size, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source)
), levels AS (
  SELECT *, ((SELECT sum(source_size) FROM weighed)
      - coalesce(sum(3.0 * source_size) OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST
                                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST
                        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed
), chosen AS (
  SELECT coalesce(arg_min(CAST(level AS DOUBLE), 3.0 * source_size / weight)
                    FILTER (WHERE weight * level <= 3.0 * source_size), 1e300) AS level FROM levels
), targets AS (
  SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), weight * chosen.level) AS target
  FROM weighed, chosen
), rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM targets
), placed AS (
  SELECT doc_id, size, source_size, target, whole, target - whole * source_size AS quota,
         sum(size) OVER (PARTITION BY sized.source ORDER BY draw ROWS UNBOUNDED PRECEDING) - size AS ahead
  FROM sized JOIN rates ON sized.source IS NOT DISTINCT FROM rates.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, CAST(target AS DOUBLE) AS target,
       CAST(size * (whole + CASE WHEN ahead + size / 2.0 <= quota THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM placed
"""


@_bound("op5_source_mix", SQL_MIX)
def op5_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return source_mix.mix_sources(_table(spark, folder, "documents")).drop("epochs", "source")


RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]

SQL_URLS = f"""
WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}),
cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), named AS (
  SELECT page_id, regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1) AS raw,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), hosts AS (
  SELECT row_number() OVER () AS k, page_id,
         translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM named
), fits AS (
  SELECT k, rule_host || rule_path AS rule, rule_verdict,
         row_number() OVER (PARTITION BY k ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS place
  FROM hosts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict
FROM hosts LEFT JOIN (SELECT * FROM fits WHERE place = 1) USING (k)
"""


@_bound("op6_url_rules", SQL_URLS)
def op6_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_rules.judge_urls(_table(spark, folder, "pages"), rules)


@_bound("op4_site_quality")
def op4_site_quality(spark: SparkSession, folder: str) -> DataFrame:
    return site_quality.judge_quality(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


@_bound("op9_simhash")
def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, folder, "documents"), shingle=3, max_bits=2)


@_bound("op10_secret_scan")
def op10_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.find_secrets(_table(spark, folder, "documents"))


SQL_TOP_K = """
WITH valid AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS k, vec_id,
         list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), scored AS (
  SELECT q.k, q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(q.v::DOUBLE[], d.v::DOUBLE[]) AS BIGINT) AS score
  FROM valid q JOIN valid d ON q.vec_id % 100 = 0 AND q.k <> d.k
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY k ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


@_bound("op7_block_topk", SQL_TOP_K)
def op7_block_topk(spark: SparkSession, folder: str) -> DataFrame:
    return block_topk.top_k(_table(spark, folder, "embeddings"), k=10, every=100, scale=1024)


# All pairs; it agrees where hashing finds them all.
SQL_NEAR_VECTORS = """
WITH RECURSIVE valid AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id, b.vec_id AS other
  FROM valid a JOIN valid b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), reach AS (
  SELECT vec_id, vec_id AS other FROM embeddings
  UNION
  SELECT r.vec_id, l.other FROM reach r JOIN links l ON r.other = l.vec_id
), heads AS (
  SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id
), degrees AS (
  SELECT vec_id, count(*) AS n FROM links GROUP BY vec_id
)
SELECT e.vec_id, coalesce(d.n, 0) AS n_links, h.component_id, e.vec_id = h.component_id AS kept
FROM embeddings e JOIN heads h USING (vec_id) LEFT JOIN degrees d USING (vec_id)
"""


@_bound("op8_cross_polytope", SQL_NEAR_VECTORS)
def op8_cross_polytope(spark: SparkSession, folder: str) -> DataFrame:
    return cross_polytope.near_vectors(_table(spark, folder, "embeddings"), least_cosine=0.98)


@_bound("op11_token_overlap")
def op11_token_overlap(spark: SparkSession, folder: str) -> DataFrame:
    return token_overlap.token_agreement(
        _table(spark, folder, "documents"),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("piece_bpe_32k.model"),
    )


@_bound("op12_spectrum_whitening")
def op12_spectrum_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened_rows(_table(spark, folder, "embeddings"), components=32)


@_bound("op13_merge_rounds")
def op13_merge_rounds(spark: SparkSession, folder: str) -> DataFrame:
    return piece_merge.round_trip(_table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
