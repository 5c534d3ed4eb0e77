"""The registered queries of the operators over the given tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonaria.llm import (
    embedding_dups,
    fill_in_middle,
    hard_negatives,
    html_text,
    language_id,
    mixing,
    packing,
    passage_dedup,
    simhash,
    statements,
    suffix_dedup,
    topk_search,
    toxicity,
    url_filter,
)
from sonaria.llm.common import QUERIES, STATEMENTS, query
from sonaria.session import table


TOPK_SQL = """
WITH usable AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
        CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
    FROM usable q JOIN usable c ON c.vec_id != q.vec_id AND len(c.v) = len(q.v)
    WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
WHERE rank <= 5
"""


@query("op1_packing")
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(
        table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")
    )


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    )


@query("op3_simhash")
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.duplicate_components(table(spark, sf_dir, "documents"))


@query("op4_embedding_dups")
def op4_embedding_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dups.link_vectors(table(spark, sf_dir, "embeddings"))


@query("op5_html_text")
def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


@query("op6_suffix_dedup")
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


@query("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


@query("op8_topk_search", TOPK_SQL)
def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op9_mixing")
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op10_passage_dedup")
def op10_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_dedup.find_passages(table(spark, sf_dir, "documents"))


@query("op11_fill_in_middle", statements.FILL_IN_MIDDLE)
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    text = fill_in_middle.restored(F.col("form"), F.col("output"))
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(text, 256).alias("restored_sha256"),
    )


@query("op12_hard_negatives", statements.HARD_NEGATIVES)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", label)
    return hard_negatives.mine(vectors, F.col("id") % 100 == 0).drop("anchor_row")


@query("op13_url_filter", statements.URL_FILTER)
def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Look-ups of pages are joins with a possibly hot left key.
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    rules = spark.createDataFrame(statements.RULES, url_filter.RULE_SCHEMA)
    return url_filter.judge(table(spark, sf_dir, "pages"), rules)


def all_queries():
    return dict(QUERIES)


def all_statements():
    return dict(STATEMENTS)
