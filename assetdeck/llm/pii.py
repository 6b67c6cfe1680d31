"""Personal data: pattern spans, and information-theoretic sanitisation of the terms around them.

Every value found by a pattern is a protected entity.  The words of the texts that hold it, outside the patterns' spans,
are counted over the corpus in distinct whole texts.  A word reveals the entity if their pointwise mutual information,
discounted for few observations, is at least a share (``SHARE``) of the entity's information content,

    k / (k + 1) * log(n k / (e t)) >= SHARE * log(n / e),

with n texts, e of them with the entity, t with the word and k with both.  There is no least number of co-occurrences:
one alone counts half, so it reveals where the word is found nowhere else.  Patterns are generalised to their kind;
words that pass are removed from every document that holds their entity; other documents are left alone.

Entities found in exactly the same texts have equal counts and are one class, so a list of addresses in one text is one
class whatever its length; pairs of class and word are formed only where the counts of both let the word pass.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Fixed patterns, possessive and anchored so that no text takes more than linear time.  A match may begin inside a run
#: of local-part characters only where the match before it ended (\G).
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ["email", "ip", "card", "phone", "term"]
TERM = r"\p{L}{4,}"
PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
SPAN = "array<struct<kind:int,s:bigint,e:bigint,v:string>>"
#: Part of an entity's information that a word may disclose.
SHARE = 0.5


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def worth(i: Column) -> Column:  # i-th digit from the right
        d = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d < 5, 2 * d).otherwise(2 * d - 9)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + worth(i)) % 10 == 0


def _valid(kind: int, match: Column) -> Column:
    if kind == 0:
        return F.lit(True)
    if kind == 1:
        return match.rlike(f"^{PART}(?:\\.{PART}){{3}}$")
    n = F.length(_digits(match))
    return n.between(8, 15) if kind == 3 else n.between(16, 19) & F.when(n.between(16, 19), _luhn(_digits(match))).otherwise(False)


def _value(kind: int, match: Column) -> Column:
    return F.lower(match) if kind == 0 else match if kind in (1, 4) else _digits(match)


def _spans(text: Column, pattern: str, kind: int, valid) -> Column:
    """The valid matches of ``pattern`` with their places, summed up from the lengths of matches and gaps."""
    none = F.array().cast(SPAN)

    def place(matches: Column) -> Column:
        parts = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(matches)), matches,
                           lambda g, m: F.struct(F.length(g).cast("long").alias("g"), m.alias("m")))

        def step(acc: Column, x: Column) -> Column:
            start, end = acc["at"] + x["g"], acc["at"] + x["g"] + F.length(x["m"])
            span = F.struct(F.lit(kind).alias("kind"), start.alias("s"), end.alias("e"), _value(kind, x["m"]).alias("v"))
            return F.struct(end.alias("at"), F.when(valid(x["m"]), F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).cast(SPAN).alias("found"))

        start = F.struct(F.lit(0).cast("long").alias("at"), none.alias("found"))
        return F.when(F.size(matches) > 0, F.aggregate(parts, start, step)["found"]).otherwise(none)

    return C.let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)


def base_spans(text: Column) -> Column:
    """``array<struct<kind, s, e, v>>`` by kind, then start; code points, end exclusive."""
    none = F.array().cast(SPAN)
    possible = [F.contains(text, F.lit("@")), text.rlike(r"[0-9]\.[0-9]"), text.rlike(r"[0-9][\x20-]?[0-9]"), F.contains(text, F.lit("+"))]
    kinds = [F.when(p, _spans(text, pattern, k, lambda m, k=k: _valid(k, m))).otherwise(none)
             for k, (p, pattern) in enumerate(zip(possible, (EMAIL, IP, CARD, PHONE)))]
    return F.concat(*kinds)


def term_spans(text: Column, terms: Column) -> Column:
    return _spans(text, TERM, 4, lambda m: F.array_contains(terms, F.lower(m)))


def _replaced(text: Column, spans: Column, tags: Column) -> Column:
    """``text`` with every span replaced by the tag of its kind; spans that overlap, together by that of the first."""
    order = F.sort_array(F.transform(spans, lambda s: F.struct(s["s"].alias("s"), s["e"].alias("e"), s["kind"].alias("kind"))))

    def rewrite(found: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            gap = F.substr(text, (acc["at"] + 1).cast("int"), (x["s"] - acc["at"]).cast("int"))
            return F.when(x["s"] >= acc["at"], F.struct(x["e"].alias("at"), F.concat(acc["out"], gap, tags[x["kind"]]).alias("out"))
                          ).otherwise(F.struct(F.greatest(acc["at"], x["e"]).alias("at"), acc["out"].alias("out")))

        start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
        end = F.aggregate(found, start, step)
        rest = C.let(end, lambda z: F.concat(z["out"], F.substr(text, (z["at"] + 1).cast("int"), F.length(text))))
        return F.when(F.size(found) > 0, rest).otherwise(text)

    return C.let(order, rewrite)


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def _signature(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _found(docs: DataFrame, row: Column) -> DataFrame:
    """``row, sig, base, text`` per row: the base spans, and the text where there are any (else null)."""
    rows = docs.select(row.alias("row"), C.text_or_empty().alias("text"))
    rows = rows.select("row", "text", _signature(F.col("text")).alias("sig"), base_spans(F.col("text")).alias("base"))
    return C.written(rows.withColumn("text", F.when(F.size("base") > 0, F.col("text"))), "personal-spans")


def _passes(k: Column, e: Column, t: Column, n: Column, share: float) -> Column:
    k, e, t, n = (x.cast("double") for x in (k, e, t, n))
    return k / (k + 1) * F.log(n * k / (e * t)) >= share * F.log(n / e)


def _classes(holders: DataFrame) -> DataFrame:
    """``sig, e, x, y`` per text and class of entities: how many texts hold them, and two digests of which."""
    mentions = holders.select("sig", F.explode("entities").alias("entity"))
    sets = mentions.groupBy("entity").agg(F.count(F.lit(1)).alias("e"), F.bit_xor(F.xxhash64("sig")).alias("x"),
                                          F.bit_xor(F.xxhash64(F.lit(1), "sig")).alias("y"))
    return mentions.join(sets, "entity").select("sig", "e", "x", "y").distinct()


def disclosive_terms(docs: DataFrame, found: DataFrame, share: float = SHARE) -> DataFrame:
    """``(sig, terms)``: per distinct text with an entity the words that reveal one."""
    text, blanks = F.col("text"), F.array(*[F.lit(" ")] * len(KINDS))
    held = found.where("text IS NOT NULL").select(
        "sig", F.array_distinct(F.transform("base", lambda s: F.xxhash64(s["kind"], s["v"]))).alias("entities"),
        _terms(_replaced(text, F.col("base"), blanks)).alias("terms"))
    holders = C.written(held.groupBy("sig").agg(F.first("entities").alias("entities"), F.first("terms").alias("terms")), "mentions")
    n = found.select("sig").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()  # one number
    hashes = F.transform(_terms(C.text_or_empty()), lambda t: F.xxhash64(t))  # words travel as 64 bits to be counted
    of_text = docs.select(_signature(C.text_or_empty()).alias("sig"), hashes.alias("hashes"))
    distinct = of_text.groupBy("sig").agg(F.first("hashes").alias("hashes"))  # copies count once
    frequency = distinct.select(F.explode("hashes").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("t"))
    spoken = holders.select("sig", F.explode("terms").alias("term")).withColumn("h", F.xxhash64("term"))
    words = C.written(spoken.join(frequency, "h").drop("h"), "word-counts")
    classes = C.written(_classes(holders).withColumnRenamed("sig", "s"), "entity-classes")
    e, t = F.col("e"), F.col("t")
    able = _passes(F.least(e, t), e, t, n, share)  # as if they met wherever both can
    pairs = words.join(classes, (F.col("sig") == F.col("s")) & able).select("sig", "term", "t", "e", "x", "y")
    pairs = C.written(pairs, "candidate-terms")
    counts = pairs.where("e > 1").groupBy("term", "t", "e", "x", "y").agg(F.count(F.lit(1)).alias("k"))
    revealing = counts.where(_passes(F.col("k"), e, t, n, share)).select("term", "e", "x", "y")
    several = pairs.where("e > 1").join(revealing, ["term", "e", "x", "y"]).select("sig", "term")
    single = pairs.where("e = 1").select("sig", "term")  # the one text that holds the entity has the word: k is 1
    return C.written(single.unionByName(several).groupBy("sig").agg(F.collect_set("term").alias("terms")), "terms-by-text")


def _with_terms(found: DataFrame, terms: DataFrame) -> DataFrame:
    """The rows of ``found`` that hold an entity, with their revealing words (null if none): only these meet the words."""
    return found.where("text IS NOT NULL").join(terms, "sig", "left")


def _listed(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name[s["kind"]], s["s"].cast("string"), s["e"].cast("string"))), ",")


def find(docs: DataFrame, share: float = SHARE) -> DataFrame:
    """One row per input row: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term``.

    Null texts are empty and have no spans (``base_sha256`` of the empty text).  Repeated rows get equal results, ids
    may repeat or be null, other columns are not read, an empty table gives an empty result.
    """
    found = _found(docs, F.col("doc_id").cast("long"))
    holders = _with_terms(found, disclosive_terms(docs, found, share))
    none = F.array().cast(SPAN)

    def result(base: Column, term: Column) -> list[Column]:
        def count(kind: int) -> Column:
            return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

        return [F.col("row").alias("doc_id"), *map(count, range(4)), F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"),
                _listed(F.concat(base, term)).alias("spans"), F.size(term).cast("long").alias("n_term")]

    marked = holders.select("row", "base", F.when(F.col("terms").isNull(), none).otherwise(
        term_spans(F.col("text"), F.col("terms"))).alias("term"))
    return marked.select(*result(F.col("base"), F.col("term"))).unionByName(found.where("text IS NULL").select(*result(none, none)))


def sanitise(docs: DataFrame, share: float = SHARE) -> DataFrame:
    """All columns of ``docs`` with every span in the text replaced by its kind in brackets (``n_chars`` follows there).

    Base spans are generalised to their kind, revealing terms to ``[TERM]``; spans that overlap are replaced together
    by the kind of the first.  Every row stays, repeated ones too; rows without a span, null and empty texts among them,
    stay as they are; an empty table gives an empty one.
    """
    found = _found(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    holders = _with_terms(found, disclosive_terms(docs, found, share))
    text = F.col("text")
    spans = F.concat("base", F.when(F.col("terms").isNull(), F.array().cast(SPAN)).otherwise(term_spans(text, F.col("terms"))))
    tags = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    clean = holders.select("row", _replaced(text, spans, tags).alias("clean")).select(*C.with_text("row", docs.columns, F.col("clean")))
    return clean.unionByName(found.where("text IS NULL").select("row.*"))
