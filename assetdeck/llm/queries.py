"""Registered queries of the training-data operators and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import (bpe, exact_dedup, licenses, packing, pii, quality_classifier, quality_rules, queries_conversations, queries_mixing,
               queries_negatives, simhash, suffixes, toxicity)

QUERIES = {**queries_negatives.QUERIES, **queries_conversations.QUERIES, **queries_mixing.QUERIES}
ORACLES = {**queries_negatives.ORACLES, **queries_conversations.ORACLES, **queries_mixing.ORACLES}


def query(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return deco


@query("op8_exact_dedup", """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.label(C.documents(spark, sf_dir))


QUALITY_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS host FROM documents),
wd AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM t),
win AS (SELECT rid, unnest(range(1, len(w) - 6)) AS i, w FROM wd WHERE len(w) >= 8),
winx AS (SELECT rid, i, w[i:i+7] AS g FROM win),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM winx) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, range(0, 8) AS r(k) GROUP BY rid),
ln AS (SELECT rid, host, text, unnest(string_split(text, chr(10))) AS line FROM t),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
norm AS (SELECT rid, host, text, trim(regexp_replace(regexp_replace(lower(line), '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS x FROM ln),
cand AS (SELECT rid, host, text, x, len(string_split(x, ' ')) AS w FROM norm WHERE x <> ''),
freq AS (SELECT host, x, min(md5(host || chr(0) || text)) AS keeper FROM cand GROUP BY host, x
         HAVING count(DISTINCT text) > 20 AND 1000 * count(DISTINCT text) >
                2 * (SELECT count(DISTINCT text) FROM t WHERE t.host = cand.host)),
lost AS (SELECT rid, sum(w) AS n FROM cand JOIN freq USING (host, x) WHERE md5(host || chr(0) || text) <> keeper GROUP BY rid),
m AS (SELECT t.doc_id, len(wd.w) AS n_words, length(regexp_replace(t.text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
             length(t.text) - length(translate(t.text, '#*$%&|<>', '')) AS n_symbols,
             coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(lost.n, 0)::BIGINT AS n_removed
      FROM t JOIN wd USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN lost USING (rid)),
b AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND 100 * n_removed <= 50 * n_words) AS kept, n_removed
FROM b
"""


@query("op7_quality_rules", QUALITY_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(C.documents(spark, sf_dir))


@query("op6_byte_bpe")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(C.documents(spark, sf_dir))


@query("op1_best_fit_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(C.documents(spark, sf_dir)))


@query("op3_simhash_near_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(C.documents(spark, sf_dir), shingle=3, radius=2)


PII_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
hit AS (SELECT rid, 0 AS kind, regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS ms,
               string_split_regex(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS gs FROM t
        UNION ALL SELECT rid, 1, regexp_extract_all(text, '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)'),
               string_split_regex(text, '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)') FROM t
        UNION ALL SELECT rid, 2, regexp_extract_all(text, '[0-9](?:[\x20-]?[0-9])+'), string_split_regex(text, '[0-9](?:[\x20-]?[0-9])+') FROM t
        UNION ALL SELECT rid, 3, regexp_extract_all(text, '\+[0-9][\x20().0-9-]+[0-9]'), string_split_regex(text, '\+[0-9][\x20().0-9-]+[0-9]') FROM t),
one AS (SELECT rid, kind, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS g, unnest(range(0, len(ms))) AS i FROM hit WHERE len(ms) > 0),
loc AS (SELECT *, sum(length(g) + length(m)) OVER (PARTITION BY rid, kind ORDER BY i)::BIGINT AS e FROM one),
dig AS (SELECT rid, kind, m, e - length(m) AS s, e, regexp_replace(m, '[^0-9]', '', 'g') AS d FROM loc),
ok AS (SELECT rid, kind, s, e, CASE kind WHEN 0 THEN lower(m) WHEN 1 THEN m ELSE d END AS v FROM dig
       WHERE kind = 0 OR (kind = 1 AND list_bool_and([length(ltrim(x, '0')) <= 3 AND ('0' || right(x, 4))::INT <= 255 FOR x IN string_split(m, '.')]))
          OR (kind = 3 AND length(d) BETWEEN 8 AND 15)
          OR (kind = 2 AND length(d) BETWEEN 16 AND 19 AND
              list_sum([CASE WHEN k % 2 = 1 THEN d[length(d) - k + 1]::INT WHEN d[length(d) - k + 1]::INT < 5 THEN 2 * d[length(d) - k + 1]::INT
                        ELSE 2 * d[length(d) - k + 1]::INT - 9 END FOR k IN range(1, length(d) + 1)]) % 10 = 0)),
bare AS (SELECT rid, list_reduce(list_prepend(struct_pack(t := any_value(text), s := 0::BIGINT, e := 0::BIGINT), list(struct_pack(t := '', s := s, e := e))),
           lambda a, x: struct_pack(t := left(a.t, x.s) || repeat(' ', x.e - x.s) || substr(a.t, x.e + 1), s := 0::BIGINT, e := 0::BIGINT)).t AS text
         FROM ok JOIN t USING (rid) GROUP BY rid),
men AS (SELECT DISTINCT rid, kind || ':' || v AS entity FROM ok),
one_text AS (SELECT rid, text FROM t QUALIFY row_number() OVER (PARTITION BY text ORDER BY rid) = 1),
wrd AS (SELECT rid, unnest(list_distinct(regexp_extract_all(lower(text), '\p{L}{4,}'))) AS term FROM bare),
cand AS (SELECT entity, term, count(*) AS k FROM men JOIN wrd USING (rid) WHERE rid IN (SELECT rid FROM one_text) GROUP BY ALL),
ent AS (SELECT entity, count(*) AS e FROM men WHERE rid IN (SELECT rid FROM one_text) GROUP BY ALL),
frq AS (SELECT term, count(*) AS t FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '\p{L}{4,}'))) AS term FROM one_text) GROUP BY ALL),
n AS (SELECT count(*)::DOUBLE AS n FROM one_text),
rev AS (SELECT entity, term FROM cand JOIN ent USING (entity) JOIN frq USING (term), n
        WHERE k::DOUBLE / (k + 1) * ln(n * k / (e::DOUBLE * t)) >= %(share)s * ln(n / e)),
mine AS (SELECT DISTINCT rid, term FROM men JOIN rev USING (entity) JOIN wrd USING (rid, term)),
th AS (SELECT rid, regexp_extract_all(text, '\p{L}{4,}') AS ms, string_split_regex(text, '\p{L}{4,}') AS gs FROM t WHERE rid IN (SELECT rid FROM mine)),
t1 AS (SELECT rid, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS g, unnest(range(0, len(ms))) AS i FROM th),
t2 AS (SELECT rid, m, sum(length(g) + length(m)) OVER (PARTITION BY rid ORDER BY i)::BIGINT AS e FROM t1),
spn AS (SELECT rid, kind, s, e FROM ok UNION ALL
        SELECT rid, 4, e - length(m), e FROM t2 WHERE EXISTS (SELECT 1 FROM mine WHERE mine.rid = t2.rid AND mine.term = lower(t2.m))),
nam AS (SELECT rid, kind, s, (['email', 'ip', 'card', 'phone', 'term'])[kind + 1] || ':' || s || ':' || e AS x FROM spn),
agg AS (SELECT rid, count(*) FILTER (kind = 0) AS n_email, count(*) FILTER (kind = 1) AS n_ip, count(*) FILTER (kind = 2) AS n_card,
               count(*) FILTER (kind = 3) AS n_phone, count(*) FILTER (kind = 4) AS n_term,
               string_agg(x, ',' ORDER BY kind, s) FILTER (kind < 4) AS b, string_agg(x, ',' ORDER BY kind, s) AS a FROM nam GROUP BY rid)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
       sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans, coalesce(n_term, 0) AS n_term
FROM t LEFT JOIN agg USING (rid)
""".replace("%(share)s", str(pii.SHARE))


@query("op10_pii_sanitisation", PII_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(C.documents(spark, sf_dir))


def source_files(docs: DataFrame) -> DataFrame:
    """The corpus as a tree: source/language/thousand/ten, where the first document of a directory is its licence file.

    ``doc_id, path, text``; a null id stands beside the directories of its source and language.
    """
    n = F.col("doc_id")
    top = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")))
    k, j = F.floor(n / 1000).cast("string"), F.floor(n / 10).cast("string")
    path = (F.when(n.isNull(), F.concat_ws("/", top, F.lit("none.txt"))).when(n % 1000 == 0, F.concat_ws("/", top, k, F.lit("LICENSE")))
            .when(n % 10 == 0, F.concat_ws("/", top, k, j, F.lit("LICENSE"))).otherwise(F.concat_ws("/", top, k, j, F.concat(n.cast("string"), F.lit(".txt")))))
    return docs.select(n.alias("doc_id"), path.alias("path"), "text")


def _license_sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({k}, {quoted(name)}, {quoted(text)})" for k, (name, text) in enumerate(licenses.TEMPLATES))
    stop = "(" + ", ".join(map(quoted, licenses.STOP)) + ")"
    words = lambda x: f"unnest(regexp_extract_all(lower({x}), '[a-z0-9]+'))"
    return f"""
WITH f AS (SELECT CASE WHEN doc_id IS NULL THEN top || '/none.txt' WHEN doc_id % 1000 = 0 THEN top || '/' || doc_id // 1000 || '/LICENSE'
                       WHEN doc_id % 10 = 0 THEN top || '/' || doc_id // 1000 || '/' || doc_id // 10 || '/LICENSE'
                       ELSE top || '/' || doc_id // 1000 || '/' || doc_id // 10 || '/' || doc_id || '.txt' END AS path, coalesce(text, '') AS text, doc_id
           FROM (SELECT *, coalesce(source, 'none') || '/' || coalesce(lang, 'none') AS top FROM documents)),
tpl(template, license, text) AS (VALUES {values}),
tt AS (SELECT template, term, count(*) AS tf FROM (SELECT template, {words("text")} AS term FROM tpl) WHERE term NOT IN {stop} GROUP BY ALL),
voc AS (SELECT DISTINCT term FROM tt),
sp AS (SELECT path, text, string_split(text, chr(10)) AS lines FROM f),
hd AS (SELECT path, text, lines, list_transform(lines, lambda x: regexp_matches(lower(x), '[a-z0-9]')) AS b FROM sp),
h2 AS (SELECT path, text, lines, list_position(b, true) AS i, b FROM hd),
h3 AS (SELECT path, text, lines, i, list_position(b[i:], false) AS j FROM h2),
part AS (SELECT path, unnest(list_concat(lines, CASE WHEN i > 0 THEN [array_to_string(CASE WHEN j > 0 THEN lines[i:i + j - 2] ELSE lines[i:] END, chr(10))] ELSE [] END,
                CASE WHEN path LIKE '%/LICENSE' THEN [text] ELSE [] END)) AS line FROM h3),
lw AS (SELECT line, term, count(*) AS tf FROM (SELECT line, {words("line")} AS term FROM (SELECT DISTINCT line FROM part)) WHERE term NOT IN {stop} GROUP BY ALL),
hit AS (SELECT DISTINCT line FROM lw WHERE term IN (SELECT term FROM voc)),
df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT rid, term FROM (SELECT rid, {words("text")} AS term FROM (SELECT row_number() OVER () AS rid, text FROM f)))
       WHERE term IN (SELECT term FROM voc) GROUP BY term),
n AS (SELECT count(*)::DOUBLE AS n FROM documents),
idf AS (SELECT term, ln((n + 1) / (coalesce(df, 0) + 1)) + 1 AS w FROM voc LEFT JOIN df USING (term), n),
a AS (SELECT line, term, tf * coalesce(w, ln(n + 1) + 1) AS w FROM lw LEFT JOIN idf USING (term), n WHERE line IN (SELECT line FROM hit)),
b AS (SELECT template, term, tf * w AS w FROM tt JOIN idf USING (term)),
an AS (SELECT line, sqrt(sum(w * w)) AS m FROM a GROUP BY line), bn AS (SELECT template, sqrt(sum(w * w)) AS m FROM b GROUP BY template),
dot AS (SELECT line, template, sum(a.w * b.w) AS d FROM a JOIN b USING (term) GROUP BY line, template),
sc AS (SELECT line, license, round(d / an.m / bn.m, 6) AS score FROM dot JOIN an USING (line) JOIN bn USING (template) JOIN tpl USING (template)),
own AS (SELECT path, max(struct_pack(s := score, l := license)) AS x FROM part JOIN sc USING (line) WHERE score >= 0.6 GROUP BY path),
lic AS (SELECT path, regexp_replace(path, '/LICENSE$', '') AS dir, x.l AS license FROM own WHERE path LIKE '%/LICENSE'),
anc AS (SELECT DISTINCT f.path, k, array_to_string(string_split(regexp_replace(f.path, '/[^/]*$', ''), '/')[1:k], '/') AS dir
        FROM f, range(0, 40) AS r(k) WHERE k <= len(string_split(f.path, '/')) - 1 AND f.path NOT IN (SELECT path FROM own)),
near AS (SELECT anc.path, max(struct_pack(k := k, f := lic.path, l := lic.license)) AS x FROM anc JOIN lic USING (dir) GROUP BY anc.path)
SELECT f.doc_id, f.path, own.x.l AS own_license, own.x.s AS own_score, coalesce(own.x.l, near.x.l) AS license, near.x.f AS inherited_from
FROM f LEFT JOIN own USING (path) LEFT JOIN near USING (path)
"""


@query("op4_license_scans", _license_sql())
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = source_files(C.documents(spark, sf_dir))
    found = licenses.scan(files)
    return files.select("doc_id", F.col("path").alias("p")).join(found, F.col("p") == F.col("path")).drop("p")


def _remainder(n: int):
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n  # a null id like an empty one


@query("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    model = toxicity.train(docs, C.labels(spark, sf_dir), "toxic", _remainder(5) != 0)
    return toxicity.score(docs, model).select("doc_id", (_remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
                                              "n_sentences", "n_toxic", "worst_start", "worst_end")


@query("op9_quality_classifier")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    model = quality_classifier.train(docs, C.labels(spark, sf_dir), "quality", _remainder(3) != 1)
    return quality_classifier.score(docs, model).select("doc_id", (_remainder(3) == 1).alias("held_out"), "score",
                                                        (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op5_suffix_array_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.deduplicate(C.documents(spark, sf_dir), with_data=False)
    share = F.when(F.col("n_bytes") > 0, F.col("n_removed") / F.nullif(F.col("n_bytes"), F.lit(0))).otherwise(0.0)
    return found.withColumn("removed_share", share)
