"""The registered query of each operator, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import bpe_digests
from .language_id import identify_language
from .lm_scoring import score_texts
from .ngram_join import ngram_join
from .quality_classifier import quality_scores
from .quality_rules import quality_rules
from .source_mixing import mix_sources
from .substring_dedup import substring_dedup
from .url_filter import rule_table, url_filter
from .vector_search import nearest


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def remainder(n: int) -> Column:
    """crc32(doc_id as text) mod n; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % n


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify_language(docs, remainder(4) != 2)
    return found.select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score", "accepted")


#: Host, path and verdict of each rule.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter(pages, rule_table(spark, URL_RULES)).select("page_id", "host", "path", "rule", "verdict")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality_rules(docs).drop("lang", "source")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = ngram_join(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return joined.select("doc_id", "set_id", "class_id", "n_copies", "n_links")


def op6_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), remainder(5) != 0)
    return scored.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", "predicted")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_texts(table(spark, sf_dir, "documents"), remainder(7) != 2)
    rounded = [F.round(c, 6).alias(c) for c in ("base_score", "score")]
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", *rounded)


def bpe_vocabulary() -> tuple[str, str]:
    """Path of the rank file and the splitting pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"), *bpe_vocabulary())


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", "source", "xxhash64(text) AS text_hash")
    return mix_sources(docs, text="text_hash").drop("text_hash")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_language_id": op2_language_id,
    "op3_url_filter": op3_url_filter,
    "op4_quality_rules": op4_quality_rules,
    "op5_ngram_join": op5_ngram_join,
    "op6_vector_search": op6_vector_search,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_source_mixing": op10_source_mixing,
}

ORACLE_SQL: dict[str, str] = {
    # The first start of every 20-word sequence stays; words under any other window go.
    "op1_substring_dedup": r"""
        WITH words AS (
            SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
        windows AS (
            SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS seq
            FROM words, unnest(range(1, len(w) - 18)) AS t(s)),
        repeated AS (
            SELECT doc_id, s FROM windows
            QUALIFY row_number() OVER (PARTITION BY seq ORDER BY doc_id, s) > 1),
        gone AS (SELECT DISTINCT doc_id, s + k AS p FROM repeated, unnest(range(0, 20)) AS t(k)),
        one AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM words),
        rest AS (
            SELECT doc_id, count(*) AS kept, string_agg(word, ' ' ORDER BY p) AS text
            FROM one ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(kept, 0)::BIGINT AS n_removed,
               sha256(coalesce(rest.text, '')) AS kept_sha256
        FROM words LEFT JOIN rest USING (doc_id)""",
    "op3_url_filter": r"""
        WITH rules(rh, rp, rv) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
            ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
        parts AS (
            SELECT page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                   coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
            FROM pages),
        urls AS (SELECT DISTINCT host, path FROM parts),
        best AS (
            SELECT host, path, arg_max(rh || rp, (length(rh || rp), length(rh))) AS rule,
                   arg_max(rv, (length(rh || rp), length(rh))) AS verdict
            FROM urls JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
            GROUP BY ALL)
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
        FROM parts LEFT JOIN best USING (host, path)""",
    # Jaccard similarity i / (a + b - i) >= 0.8 in whole numbers: 9 i >= 4 (a + b).
    "op5_ngram_join": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
        sets AS (
            SELECT doc_id, list_sort(list_distinct(CASE
                       WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))
                       WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g
            FROM words),
        hashed AS (SELECT doc_id, g, CASE WHEN len(g) > 0 THEN md5(array_to_string(g, chr(10))) ELSE 'empty ' || doc_id END AS h FROM sets),
        nodes AS (SELECT h, min(doc_id) AS id, count(*) AS n_copies, any_value(g) AS g, len(any_value(g)) AS n FROM hashed GROUP BY h),
        grams AS (SELECT id, n, unnest(g) AS t FROM nodes),
        links AS (
            SELECT a.id AS a, b.id AS b FROM grams a JOIN grams b ON a.t = b.t AND a.id <> b.id
            GROUP BY a.id, b.id, a.n, b.n HAVING 9 * count(*) >= 4 * (a.n + b.n)),
        reach AS (SELECT id AS a, id AS b FROM nodes UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        classes AS (SELECT a AS id, min(b) AS class_id FROM reach GROUP BY a),
        degrees AS (SELECT a AS id, count(*) AS n_links FROM links GROUP BY a)
        SELECT doc_id, id AS set_id, class_id, n_copies, coalesce(n_links, 0) AS n_links
        FROM hashed JOIN nodes USING (h) JOIN classes USING (id) LEFT JOIN degrees USING (id)""",
}
