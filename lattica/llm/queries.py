"""The queries opN_<name>: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import held_out, table
from lattica.llm.exact_dedup import exact_dedup
from lattica.llm.fingerprints import fingerprints
from lattica.llm.lm_scores import score_texts
from lattica.llm.mixing import mix
from lattica.llm.near_copies import near_copies
from lattica.llm.packing import pack
from lattica.llm.pii import find_pii
from lattica.llm.quality import classify
from lattica.llm.token_count import count_tokens
from lattica.llm.warc import round_trip


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark, table(spark, sf_dir, "documents"))


#: Target shares of the languages' tokens.
LANGUAGES = {"de": 0.17, "en": 0.50, "es": 0.15, "fr": 0.18}


def language_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, domain): the language of the labelled documents of good quality; those held out for tests are not among them."""
    good = table(spark, sf_dir, "labels").filter((F.col("quality") == 1) & ~held_out("doc_id", 0)).select("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("domain")).join(good, "doc_id", "left_semi")


def op2_mixing_to_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark, table(spark, sf_dir, "documents"), language_labels(spark, sf_dir), LANGUAGES)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark, table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark, table(spark, sf_dir, "documents"))


def op7_language_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(spark, table(spark, sf_dir, "documents"))


def op8_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark, table(spark, sf_dir, "pages"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(spark, table(spark, sf_dir, "documents"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(spark, table(spark, sf_dir, "documents"), words=4, percent=85)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_mixing_to_targets, op3_exact_dedup, op4_best_fit_packing, op5_quality_classifier, op6_document_fingerprints, op7_language_model_scores, op8_warc_archives, op9_personal_data, op10_ngram_jaccard_join)}


def oracle_sql() -> dict[str, str]:
    return {
        "op8_warc_archives": """
            WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
                 c AS (SELECT payload_digest AS d, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
            SELECT page_id, payload_bytes, payload_digest,
                   CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
                   CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
            FROM p LEFT JOIN c ON payload_digest = d""",
        "op3_exact_dedup": r"""
            WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS chars,
                              regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
                 c AS (SELECT norm, count(*) AS group_size, first(doc_id ORDER BY chars DESC, doc_id) AS keep_id FROM n GROUP BY norm)
            SELECT n.doc_id, c.keep_id, c.group_size, n.doc_id = c.keep_id AS kept, sha256(n.norm) AS text_sha256
            FROM n JOIN c ON n.norm = c.norm""",
    }
