"""Matching queries over ``embeddings``: every vector is a probe; the registry is either every
vector or the latest enrolment of each label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonaria.constants import MATCH_THRESHOLD
from sonaria.functions import messages, vectors
from sonaria.operators import matching
from sonaria.plans.registered import query
from sonaria.session import table


def probes_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("probe_id"), "embedding")


def full_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("vec_id").cast("string")
    return table(spark, sf_dir, "embeddings").select(
        user.alias("user_id"), F.concat(user, F.lit(".npy")).alias("ref_path"), "embedding"
    )


def label_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector enrols its label's voice; the last one stays."""
    user = F.col("label").cast("string")
    enrolments = table(spark, sf_dir, "embeddings").select(
        user.alias("user_id"),
        F.concat(user, F.lit(".npy")).alias("ref_path"),
        "embedding",
        F.col("vec_id").alias("enrolled_at"),
    )
    return matching.latest_enrolments(enrolments, ["enrolled_at"])


UNIT = """
vec AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
unit AS (
  SELECT vec_id, label,
         list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12)) AS u
  FROM vec)"""

LATEST = (
    UNIT
    + """,
registry AS (
  SELECT CAST(label AS VARCHAR) AS user_id, arg_max(u, vec_id) AS u, max(vec_id) AS enrolled_at,
         count(*) AS enrolments
  FROM unit GROUP BY label),
scored AS (
  SELECT p.vec_id AS probe_id, r.user_id, list_dot_product(p.u, r.u) AS cosine,
         row_number() OVER (PARTITION BY p.vec_id
                            ORDER BY round(list_dot_product(p.u, r.u), 12) DESC, r.user_id) AS rank
  FROM unit p, registry r)"""
)


@query(
    "registry_topk",
    f"""
WITH {UNIT},
scored AS (
  SELECT p.vec_id AS probe_id, CAST(r.vec_id AS VARCHAR) AS user_id,
         list_dot_product(p.u, r.u) AS cosine
  FROM unit p, unit r),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY probe_id
                               ORDER BY round(cosine, 12) DESC, user_id) AS rank
  FROM scored)
SELECT probe_id, CAST(rank AS BIGINT) AS rank, user_id, round(cosine, 6) AS cosine,
       round((greatest(-1.0, least(1.0, cosine)) + 1) / 2, 6) AS score,
       user_id || '.npy' AS ref_path
FROM ranked WHERE rank <= 5""",
)
def registry_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = matching.top_matches(
        probes_of(spark, sf_dir), full_registry(spark, sf_dir), top_k=5
    )
    return matching.match_rows(matched).select(
        "probe_id",
        F.col("rank").cast("bigint").alias("rank"),
        "user_id",
        F.round("cosine", 6).alias("cosine"),
        F.round("score", 6).alias("score"),
        "ref_path",
    )


@query(
    "registry_topk_blocks",
    f"""
WITH {UNIT},
scored AS (
  SELECT p.vec_id AS probe_id, CAST(r.vec_id AS VARCHAR) AS user_id,
         list_dot_product(p.u, r.u) AS cosine
  FROM unit p, unit r),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY probe_id
                               ORDER BY round(cosine, 12) DESC, user_id) AS rank
  FROM scored)
SELECT probe_id, CAST(rank AS BIGINT) AS rank, user_id, round(cosine, 6) AS cosine
FROM ranked WHERE rank <= 3""",
)
def registry_topk_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small blocks, so that the grid has many cells even on small tables."""
    matched = matching.top_matches(
        probes_of(spark, sf_dir),
        full_registry(spark, sf_dir),
        top_k=3,
        block_rows=64,
        probe_rows=96,
    )
    return matching.match_rows(matched).select(
        "probe_id",
        F.col("rank").cast("bigint").alias("rank"),
        "user_id",
        F.round("cosine", 6).alias("cosine"),
    )


@query(
    "registry_decision",
    f"""
WITH {LATEST},
top AS (
  SELECT probe_id, max(CASE WHEN rank = 1 THEN user_id END) AS best_id,
         max(CASE WHEN rank = 1 THEN (least(1.0, cosine) + 1) / 2 END) AS best_score,
         string_agg(user_id, ',' ORDER BY rank) AS matches, count(*) AS n_matches
  FROM scored WHERE rank <= 5 GROUP BY probe_id)
SELECT probe_id, best_score >= 0.65 AS decision, CAST(0.65 AS DOUBLE) AS threshold,
       CASE WHEN best_score >= 0.65 THEN best_id END AS best_user,
       CASE WHEN best_score >= 0.65 THEN round(best_score, 6) END AS best_score,
       matches, n_matches
FROM top""",
)
def registry_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = matching.top_matches(
        probes_of(spark, sf_dir), label_registry(spark, sf_dir), top_k=5
    )
    return matching.decide(matched, MATCH_THRESHOLD).select(
        "probe_id",
        "decision",
        "threshold",
        F.col("best.user_id").alias("best_user"),
        F.round("best.score", 6).alias("best_score"),
        F.array_join("matches.user_id", ",").alias("matches"),
        F.size("matches").cast("bigint").alias("n_matches"),
    )


@query(
    "registry_binary_decision",
    f"""
WITH {LATEST}
SELECT probe_id, (cosine + 1) / 2 >= 0.8 AS decision, user_id AS best_user,
       round((cosine + 1) / 2, 6) AS best_score
FROM scored WHERE rank = 1""",
)
def registry_binary_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = matching.top_matches(
        probes_of(spark, sf_dir), label_registry(spark, sf_dir), top_k=1
    )
    return matching.decide(matched, 0.8, keep_best=True).select(
        "probe_id",
        "decision",
        F.col("best.user_id").alias("best_user"),
        F.round("best.score", 6).alias("best_score"),
    )


@query(
    "pair_verify",
    f"""
WITH {LATEST}
SELECT p.vec_id AS probe_id, r.user_id, round(list_dot_product(p.u, r.u), 6) AS cosine,
       list_dot_product(p.u, r.u) >= 0.65 AS decision
FROM unit p JOIN registry r ON r.user_id = CAST(p.label AS VARCHAR)""",
)
def pair_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("probe_id"), F.col("label").cast("string").alias("user_id"), "embedding"
    )
    pairs = matching.verify_pairs(probes, label_registry(spark, sf_dir), "user_id")
    return pairs.select("probe_id", "user_id", F.round("cosine", 6).alias("cosine"), "decision")


@query(
    "registry_upsert",
    f"""
WITH {LATEST}
SELECT user_id, user_id || '.npy' AS ref_path, enrolled_at, round(u[1], 6) AS first_value
FROM registry""",
)
def registry_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A base registry of the first half of every enrolment stream, then the later half on top."""
    user = F.col("label").cast("string")
    rows = table(spark, sf_dir, "embeddings").select(
        user.alias("user_id"),
        F.concat(user, F.lit(".npy")).alias("ref_path"),
        "embedding",
        F.col("vec_id").alias("enrolled_at"),
    )
    old = matching.latest_enrolments(rows.where(F.col("embedding")[0] < 0), ["enrolled_at"])
    new = rows.where(F.col("embedding")[0] >= 0)
    return matching.upsert(old, new, ["enrolled_at"]).select(
        "user_id",
        "ref_path",
        "enrolled_at",
        F.round(F.get(vectors.l2_normalise("embedding"), F.lit(0)), 6).alias("first_value"),
    )


@query(
    "registry_listing",
    """
SELECT CAST(vec_id AS VARCHAR) AS user_id, (SELECT count(*) FROM embeddings) AS registry_size
FROM embeddings ORDER BY 1""",
)
def registry_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.listing(full_registry(spark, sf_dir))


@query(
    "default_reference",
    """
WITH candidates AS (
  SELECT doc_id, r AS rank, 'ref/' || (doc_id + r * r) AS path
  FROM documents, (SELECT unnest(range(5)) AS r)),
existing AS (SELECT DISTINCT 'ref/' || doc_id AS path FROM labels WHERE quality = 1),
hits AS (SELECT c.doc_id, c.path, c.rank FROM candidates c JOIN existing e ON c.path = e.path)
SELECT d.doc_id, (SELECT arg_min(h.path, h.rank) FROM hits h WHERE h.doc_id = d.doc_id) AS ref_path
FROM documents d""",
)
def default_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = (
        table(spark, sf_dir, "documents")
        .select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("rank"))
        .withColumn(
            "path", F.concat(F.lit("ref/"), (F.col("doc_id") + F.col("rank") * F.col("rank")).cast("string"))
        )
    )
    existing = (
        table(spark, sf_dir, "labels")
        .where("quality = 1")
        .select(F.concat(F.lit("ref/"), F.col("doc_id").cast("string")).alias("path"))
    )
    return matching.first_existing(candidates, existing, "doc_id")


@query(
    "signal_validity",
    """
WITH s AS (
  SELECT vec_id, label, CASE label
           WHEN 0 THEN list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * 1e-8)
           WHEN 1 THEN list_append(CAST(embedding AS DOUBLE[]), 'nan'::DOUBLE)
           WHEN 2 THEN list_append(CAST(embedding AS DOUBLE[]), '-inf'::DOUBLE)
           ELSE CAST(embedding AS DOUBLE[]) END AS x
  FROM embeddings)
SELECT vec_id, len(list_filter(x, lambda v: abs(v) > 1e-7)) > 0
       AND len(list_filter(x, lambda v: isnan(v) OR isinf(v))) = 0 AS usable
FROM s""",
)
def signal_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = F.col("embedding").cast("array<double>")
    signal = (
        F.when(F.col("label") == 0, F.transform(wide, lambda x: x * F.lit(1e-8)))
        .when(F.col("label") == 1, F.array_append(wide, F.lit(float("nan"))))
        .when(F.col("label") == 2, F.array_append(wide, F.lit(float("-inf"))))
        .otherwise(wide)
    )
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", vectors.is_usable_signal(signal).alias("usable")
    )


@query(
    "truncated_cosine",
    f"""
WITH {LATEST}
SELECT p.vec_id,
       CAST(CASE WHEN p.label = 0 THEN 64 ELSE 64 - p.label END AS BIGINT) AS used_dim,
       round(list_cosine_similarity(p.v[1:64 - p.label], r.v[1:64 - p.label]), 6) AS cosine
FROM vec p JOIN (SELECT label, arg_max(v, vec_id) AS v FROM vec GROUP BY label) r
  ON r.label = p.label""",
)
def truncated_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probe shortened by its label, so that most pairs differ in dimension."""
    probes = table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.col("label").cast("string").alias("user_id"),
        F.slice("embedding", F.lit(1), F.size("embedding") - F.col("label")).alias("probe"),
    )
    refs = label_registry(spark, sf_dir).select("user_id", F.col("embedding").alias("reference"))
    pairs = probes.join(refs, "user_id")
    return pairs.select(
        "vec_id",
        F.least(F.size("probe"), F.size("reference")).cast("bigint").alias("used_dim"),
        F.round(vectors.truncated_cosine(F.col("probe"), F.col("reference")), 6).alias("cosine"),
    )


@query(
    "unit_vectors",
    """
WITH s AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * label) AS v
           FROM embeddings),
n AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS norm FROM s)
SELECT vec_id, round(norm, 6) AS norm_before, round(v[1] / greatest(norm, 1e-12), 6) AS first_value,
       CAST(CASE WHEN norm = 0 THEN 0 ELSE 1 END AS DOUBLE) AS norm_after
FROM n""",
)
def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = F.transform(
        F.col("embedding").cast("array<double>"), lambda x: x * F.col("label")
    )
    base = table(spark, sf_dir, "embeddings").select("vec_id", scaled.alias("v"))
    unit = base.withColumn("u", vectors.l2_normalise("v"))
    return unit.select(
        "vec_id",
        F.round(vectors.norm("v"), 6).alias("norm_before"),
        F.round(F.get("u", F.lit(0)), 6).alias("first_value"),
        F.round(vectors.norm("u"), 6).alias("norm_after"),
    )


@query(
    "verify_messages",
    f"""
WITH {LATEST},
top AS (
  SELECT probe_id, max(CASE WHEN rank = 1 THEN user_id END) AS best_id,
         max(CASE WHEN rank = 1 THEN (cosine + 1) / 2 END) AS best_score,
         string_agg('"' || user_id || '"', ',' ORDER BY rank) AS matches
  FROM scored WHERE rank <= 2 GROUP BY probe_id)
SELECT probe_id,
       '{{"type":"partial","decision":' || CASE WHEN best_score >= 0.65 THEN 'true' ELSE 'false' END
       || ',"threshold":0.65,"best":'
       || CASE WHEN best_score >= 0.65 THEN '{{"user_id":"' || best_id || '"}}' ELSE 'null' END
       || ',"matches":[' || matches || '],"session_id":"s' || probe_id
       || '","version":1,"ts_ms":' || (1704067200000 + probe_id) || '}}' AS message
FROM top""",
)
def verify_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = matching.top_matches(
        probes_of(spark, sf_dir), label_registry(spark, sf_dir), top_k=2
    )
    decided = matching.decide(matched)
    body = decided.select(
        "probe_id",
        F.lit("partial").alias("type"),
        "decision",
        "threshold",
        F.when(F.col("best").isNotNull(), F.struct(F.col("best.user_id"))).alias("best"),
        F.col("matches.user_id").alias("matches"),
        F.concat(F.lit("s"), F.col("probe_id").cast("string")).alias("session_id"),
        F.lit(None).cast("int").alias("version"),
        (F.lit(1704067200000) + F.col("probe_id")).alias("ts_ms"),
    )
    stamped = messages.stamp(body)
    return stamped.select(
        "probe_id", messages.verify_json(*[c for c in stamped.columns if c != "probe_id"]).alias("message")
    )
