"""Quality rules with cross-document line frequency, in DataFrame functions only.

Per text: word, symbol and repetition counts.  Across texts: every line is normalised and hashed together with its
host, distinct documents are counted per host and line, lines above the host's limit are boilerplate, and a document
that loses more than a share of its words to them is rejected.

Distinct documents are distinct texts: exact copies count once.  The first document (by digest) with a boilerplate
line keeps it, so that no group of copies can vanish as a whole.  Lines of every length are counted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

WINDOW = 8
SYMBOLS = "[#*$%&|<>]"
#: Runs of white space in a line that are not a single blank.
SPACES = r"\x20*+[\x09\x0B-\x0D][\x20\x09\x0B-\x0D]*+|\x20\x20++"


@dataclass(frozen=True)
class Limits:
    """A line is boilerplate in more than ``min_docs`` and more than ``share`` of the host's distinct documents."""

    min_words: int = 20
    max_repeat_percent: int = 30
    min_docs: int = 20
    per_thousand: int = 2
    max_removed_percent: int = 50


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(C.WORD), F.lit(0))


def _covered(starts: Column) -> Column:
    """Words covered by the windows that begin at the ascending positions ``starts`` (not empty)."""
    gaps = F.zip_with(F.slice(starts, 1, F.size(starts) - 1), F.slice(starts, 2, F.size(starts)),
                      lambda a, b: F.least(b - a, F.lit(WINDOW)).cast("long"))
    return F.aggregate(gaps, F.lit(WINDOW).cast("long"), lambda s, g: s + g)


def _repeat_words(words: Column) -> Column:
    """Words that lie in a window of eight words found twice or more in the text."""

    def from_hashes(hashes: Column) -> Column:
        order = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def from_sorted(s: Column) -> Column:
            same = F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s)), lambda a, b: a["h"] == b["h"])

            def from_same(e: Column) -> Column:
                no = F.array(F.lit(False))
                twice = F.zip_with(F.concat(e, no), F.concat(no, e), lambda a, b: a | b)
                at = F.zip_with(s, twice, lambda x, t: F.when(t, x["i"]))
                return C.let(F.sort_array(F.filter(at, lambda x: x.isNotNull())), _covered)

            return C.let(same, from_same)

        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), C.let(order, from_sorted)).otherwise(F.lit(0).cast("long"))

    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(F.size(words) > WINDOW, C.let(hashes, from_hashes)).otherwise(F.lit(0).cast("long"))


def normalised_lines(text: Column) -> Column:
    """The lines of a text in lower case, digits as 0, runs of white space as one blank, none at the ends."""
    whole = F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]", "0"), SPACES, " ")
    return F.transform(F.split(whole, "\n", -1), lambda x: F.trim(x))


def _counted_lines(text: Column, host: Column) -> Column:
    """``array<struct<h, w>>``: hash and word count of each line that is not blank."""
    words = lambda x: F.octet_length(x) - F.octet_length(F.replace(x, F.lit(" "), F.lit(""))) + 1
    return F.transform(F.filter(normalised_lines(text), lambda x: x != ""),
                       lambda x: F.struct(F.xxhash64(host, x).alias("h"), words(x).alias("w")))


def _host(column: str = "source") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def _signature(host: Column, text: Column) -> Column:
    return F.unhex(F.md5(F.concat_ws("\0", host, text)))


def candidate_lines(docs: DataFrame) -> DataFrame:
    """``host, sig, lines``: digest of (host, text) and the lines that are not blank, per row."""
    host, text = _host(), C.text_or_empty()
    return docs.select(host.alias("host"), text.alias("text")).select(
        "host", _signature(F.col("host"), F.col("text")).alias("sig"),
        _counted_lines(F.col("text"), F.col("host")).alias("lines"))


def base(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Per row: id, digest of (host, text) and the per-text counts."""
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.text_or_empty().alias("text"), _host().alias("host"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    t = t.select(
        "doc_id", _signature(F.col("host"), F.col("text")).alias("sig"),
        C.let(words_of(F.col("text")),
              lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).alias("rep"),
                                 F.length(F.array_join(w, "")).cast("long").alias("chars"))).alias("w"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        C.let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))
    n, rep = F.col("w.n"), F.col("w.rep")
    return t.select("doc_id", "sig", n.alias("n_words"), F.col("w.chars").alias("word_chars"), "n_symbols", "n_dup_lines",
                    rep.alias("n_repeat_words"),
                    ((n < limits.min_words) | (100 * rep > limits.max_repeat_percent * n)).alias("base_failed"))


def frequent_lines(counted: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``(h, keeper)`` of the lines above their host's limit, from the result of ``candidate_lines``.

    Three aggregations, all with partial aggregation on keys that spread: (line, text), line, host.
    """
    pairs = (counted.select("host", "sig", F.explode("lines").alias("l"))
             .groupBy("l.h", "host", "sig").agg(F.count(F.lit(1)).alias("n")))
    lines = (pairs.groupBy("h", "host").agg(F.count(F.lit(1)).alias("docs"), F.min("sig").alias("keeper"))
             .where(F.col("docs") > limits.min_docs))
    hosts = (counted.groupBy("host", "sig").agg(F.count(F.lit(1)).alias("n"))
             .groupBy("host").agg(F.count(F.lit(1)).alias("host_docs")))
    return lines.join(hosts, "host").where(1000 * F.col("docs") > limits.per_thousand * F.col("host_docs")).select("h", "keeper")


def removed_lines(counted: DataFrame, frequent: DataFrame) -> DataFrame:
    """``(sig, n_removed, lost)``: the words and line hashes each distinct text loses to lines above the limits."""
    per_row = counted.select("sig", F.explode("lines").alias("l")).select("sig", "l.h", "l.w")
    hit = per_row.join(frequent, "h").where(F.col("sig") != F.col("keeper"))
    sums = hit.groupBy("sig").agg(F.sum("w").alias("w"), F.collect_set("h").alias("lost"))
    copies = counted.groupBy("sig").agg(F.count(F.lit(1)).alias("copies"))
    # every copy of a text brings the same lines
    return sums.join(copies, "sig").select("sig", (F.col("w") / F.col("copies")).cast("long").alias("n_removed"), "lost")


def _passes(limits: Limits) -> Column:
    lost = F.coalesce("n_removed", F.lit(0).cast("long"))
    return ~F.col("base_failed") & (100 * lost <= limits.max_removed_percent * F.col("n_words"))


def _lost(docs: DataFrame, limits: Limits) -> DataFrame:
    counted = C.written(candidate_lines(docs), "candidate-lines")
    frequent = C.written(frequent_lines(counted, limits), "frequent-lines")
    return C.written(removed_lines(counted, frequent), "removed-lines")


def verdicts(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row per input row with the counts, ``base_failed``, ``kept`` and ``n_removed``.

    Null text counts as empty (no words, so it fails), null source as host ''.  Repeated rows get equal verdicts,
    ids may repeat or be null, other columns are not read, an empty table gives an empty result.
    """
    removed = _lost(docs, limits).drop("lost")
    return base(docs, limits).join(removed, "sig", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        _passes(limits).alias("kept"), F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"))


def clean(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The documents that pass, all columns, without the lines above the limits (``n_chars`` follows the text).

    Null and empty texts have no words and are rejected; a null source is the host ''.  Exact copies count once and are
    kept or rejected together, rows that repeat an id included; the first text (by digest) with a line above the limits
    keeps it.  An empty table gives an empty one.  Lines are told apart by 64-bit hashes.
    """
    removed = _lost(docs, limits)
    per_row = C.packed(docs, text=C.text_or_empty(), host=_host())
    n = F.size(words_of(F.col("text")))
    repeats = C.let(words_of(F.col("text")), _repeat_words)
    failed = (n < limits.min_words) | (100 * repeats > limits.max_repeat_percent * n)
    rows = (per_row.where(~failed).select("row", "text", "host", n.cast("long").alias("n_words"), F.lit(False).alias("base_failed"),
                                          _signature(F.col("host"), F.col("text")).alias("sig"))
            .join(removed, "sig", "left").where(_passes(limits)))
    left = F.array_join(F.filter(F.zip_with(F.split("text", "\n", -1), normalised_lines(F.col("text")), lambda line, norm:
                                            F.when(~F.array_contains("lost", F.xxhash64("host", norm)), line)),
                                 lambda x: x.isNotNull()), "\n")
    return rows.select(*C.with_text("row", docs.columns, F.when(F.col("lost").isNull(), F.col("text")).otherwise(left)))
