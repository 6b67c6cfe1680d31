"""The query that damages and repairs conversations, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import conversations

SQL = r"""
WITH RECURSIVE
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
crc AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(key) + 1), lambda i: ord(key[i])::BIGINT)),
          lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)),
          4294967295) % 20 AS kind FROM src),
dmg AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
               CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
               unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM crc),
num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(role || chr(0) || text)) AS i FROM dmg),
flt AS (SELECT conv_id, turn, i, role, text, left(role, 1) AS initial,
               CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                    WHEN right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM num),
ins(st, st2, more, letters, lines) AS (VALUES ('n', 'n', 0, '', []::VARCHAR[]), ('n', 'u', 3, 'I', ['user:']), ('n', 'a', 6, 'II', ['user:', 'assistant:']),
  ('s', 's', 0, '', []), ('s', 'u', 3, 'I', ['user:']), ('s', 'a', 6, 'II', ['user:', 'assistant:']), ('u', 'u', 0, '', []), ('u', 'a', 3, 'I', ['assistant:']),
  ('a', 'a', 0, '', []), ('a', 'u', 3, 'I', ['user:'])),
edit(st, st2, how) AS (VALUES ('n', 'n', 'D'), ('s', 's', 'D'), ('u', 'u', 'D'), ('a', 'a', 'D'), ('n', 's', 'K'), ('n', 'u', 'K'), ('s', 'u', 'K'), ('u', 'a', 'K'),
  ('a', 'u', 'K'), ('n', 'u', 'R'), ('s', 'u', 'R'), ('u', 'a', 'R'), ('a', 'u', 'R')),
dp(conv_id, i, st, w) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, 'n', struct_pack(cost := 0::BIGINT, audit := '', lines := []::VARCHAR[]) FROM num
  UNION ALL
  SELECT dp.conv_id, any_value(f.i), edit.st2, min(struct_pack(
           cost := w.cost + ins.more + CASE how WHEN 'D' THEN 4 ELSE CASE how WHEN 'R' THEN 3 ELSE 0 END + CASE fault WHEN 'truncated' THEN 3 ELSE 0 END END,
           audit := w.audit || ins.letters || how,
           lines := list_concat(w.lines, ins.lines, CASE how WHEN 'D' THEN []::VARCHAR[] WHEN 'K' THEN [f.role || ':' || f.text]
                                                    ELSE [CASE edit.st2 WHEN 'u' THEN 'user:' ELSE 'assistant:' END || f.text] END)))
  FROM dp JOIN flt f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.i = dp.i + 1 JOIN ins ON ins.st = dp.st JOIN edit ON edit.st = ins.st2
  WHERE how = 'D' OR (fault NOT IN ('blank', 'duplicate') AND (how = 'R' OR f.initial = edit.st2))
  GROUP BY dp.conv_id, edit.st2),
fin AS (SELECT dp.conv_id, min(struct_pack(cost := w.cost + ins.more, audit := w.audit || ins.letters, lines := list_concat(w.lines, ins.lines))) AS w
        FROM dp JOIN ins ON ins.st = dp.st JOIN (SELECT conv_id, max(i) AS i FROM num GROUP BY conv_id) e ON e.conv_id IS NOT DISTINCT FROM dp.conv_id AND e.i = dp.i
        WHERE ins.st2 = 'a' OR (ins.st2 = 'n') GROUP BY dp.conv_id),
adj AS (SELECT conv_id, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM flt),
ill AS (SELECT conv_id, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM adj GROUP BY conv_id),
cnt AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
               count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated FROM flt GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(fin.w.cost, 0) AS cost, coalesce(fin.w.audit, '') AS audit,
       sha256(coalesce(array_to_string(fin.w.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN cnt ON cnt.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN ill ON ill.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN fin ON fin.conv_id IS NOT DISTINCT FROM o.conv_id
"""


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.audit(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {"op12_conversation_repair": op12}
ORACLES = {"op12_conversation_repair": SQL}
