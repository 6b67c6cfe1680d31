"""The query that mines hard negatives, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import hard_negatives

SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND NOT list_bool_or(list_prepend(false, list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x))))),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER g AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW g AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER g <= 3
"""


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(*hard_negatives.scaled(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


QUERIES = {"op11_hard_negatives": op11}
ORACLES = {"op11_hard_negatives": SQL}
