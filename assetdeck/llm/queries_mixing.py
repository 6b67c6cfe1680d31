"""The query that mixes sources to target weights, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import common as C
from . import mixing

SQL = rf"""
WITH RECURSIVE d AS (SELECT source, doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
g AS (SELECT source, doc_id, size, count(*) AS n FROM d GROUP BY ALL),
s AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM (SELECT source, sum(size * n)::BIGINT AS source_size FROM g GROUP BY source)),
w AS (SELECT *, {list(mixing.WEIGHTS)}[rank % 3 + 1] AS w, {mixing.MOST} * source_size AS cap FROM s),
o AS (SELECT *, sum(source_size) OVER () AS t, coalesce(sum(cap) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c,
             sum(w) OVER (q ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ww FROM w WINDOW q AS (ORDER BY cap::DOUBLE / w, rank)),
f AS (SELECT t, c, ww FROM o WHERE (t - c)::DOUBLE * w / ww::DOUBLE <= cap ORDER BY cap::DOUBLE / w, rank LIMIT 1),
tg AS (SELECT w.*, least(cap::DOUBLE, (t - c)::DOUBLE * w / ww::DOUBLE) AS target FROM w, f),
p AS (SELECT *, CASE WHEN source_size > 0 THEN least({mixing.MOST}, floor(target / source_size))::BIGINT ELSE 0 END AS passes FROM tg),
b AS (SELECT g.*, rank, md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || size) AS digest,
             least({mixing.BLOCK_BITS}, length(bin(source_size // {mixing.BLOCK_WORDS}))) AS bits FROM g JOIN p ON g.source IS NOT DISTINCT FROM p.source),
r AS (SELECT *, ('0x' || substr(digest, 1, 8))::BIGINT & (pow(2, bits)::BIGINT - 1) AS block FROM b),
k AS (SELECT rank, block, words, passes, target - passes * source_size AS rest, md5('{mixing.SEED}:' || rank || ':' || passes || ':' || block) AS key
      FROM (SELECT rank, block, sum(size * n)::BIGINT AS words FROM r GROUP BY ALL) JOIN p USING (rank)),
a AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY rank ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM k),
x AS (SELECT *, before + words <= rest AS whole FROM a),
e AS (SELECT *, rest - min(before) FILTER (NOT whole) OVER (PARTITION BY rank) AS room,
             sum((NOT whole)::INT) OVER (PARTITION BY rank ORDER BY key) AS nth FROM x),
i AS (SELECT rank, room, r.size, r.n, digest, doc_id, row_number() OVER (PARTITION BY rank ORDER BY digest, doc_id, size) AS k
      FROM e JOIN r USING (rank, block) WHERE NOT whole AND nth <= {mixing.LAST_BLOCKS} AND room >= 1),
fill(rank, k, room, copies) AS (
  SELECT DISTINCT rank, 0::BIGINT, room, 0::BIGINT FROM i
  UNION ALL
  SELECT rank, y.k, fill.room - c * y.size, c FROM fill JOIN (SELECT rank, k, size, n FROM i) y USING (rank),
    LATERAL (SELECT CASE WHEN y.size > 0 THEN least(y.n, floor(fill.room / y.size))::BIGINT ELSE 0 END AS c) WHERE y.k = fill.k + 1)
SELECT r.doc_id, r.size, p.source_size, p.target,
       r.size * (p.passes + e.whole::INT + (copy < coalesce(fill.copies, 0))::INT) AS taken
FROM (SELECT *, unnest(range(n)) AS copy FROM r) r JOIN p USING (rank) JOIN e USING (rank, block)
LEFT JOIN i ON i.rank = r.rank AND i.digest = r.digest AND i.doc_id IS NOT DISTINCT FROM r.doc_id AND i.size = r.size
LEFT JOIN fill ON fill.rank = i.rank AND fill.k = i.k
"""


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(C.documents(spark, sf_dir))


QUERIES = {"op13_source_mixing": op13}
ORACLES = {"op13_source_mixing": SQL}
