"""The operators' registered queries, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .warc_revisit import ORACLE as REVISIT_SQL


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_scoring import lm_scores

    return lm_scores(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import Similarity, jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents"), Similarity(k=4, percent=85))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op7_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc_revisit import page_captures, resolve_revisits

    found = resolve_revisits(page_captures(table(spark, sf_dir, "pages")))
    return found.withColumn("payload", F.md5("payload"))  # the stored body's digest stands for it


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import bpe_round_trip

    return bpe_round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op9_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_knn import quality_knn

    return quality_knn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import html_extract

    return html_extract(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_lm_scoring, op2_token_counts, op3_jaccard_join, op4_exact_dedup, op5_quality_rules, op6_curve_packing, op7_warc_revisit, op8_bpe_round_trip, op9_quality_knn, op10_html_extract)}

ORACLES: dict[str, str] = {
    "op7_warc_revisit": REVISIT_SQL,
    "op4_exact_dedup": """
with t as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') as body from documents),
g as (select body, min(doc_id) as keep_id, count(*) as group_size from t group by body)
select t.doc_id, g.keep_id, cast(g.group_size as bigint) as group_size, t.doc_id = g.keep_id as kept, sha256(t.body) as text_sha256
from t join g using (body)
""",
}
