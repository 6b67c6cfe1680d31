"""Licence scans: sparse TF-IDF cosine of headers and licence files to templates, and inheritance from licence files above.

A file is compared by its header (its first block of lines, up to a line without words), by each of its lines, and, if
its name says it is a licence file, as a whole.  Terms weigh their count times their inverse document frequency; the
template most similar to any of these texts is the file's own licence.  Files without one take that of the licence file
in the nearest directory above them, found by joining the paths of their ancestors.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Titles, notices and, where they are short, whole texts of public licences.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
     "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
     "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either "
     "express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
     "by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
     "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
     "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
     "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
     "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
     "Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
     "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
     "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
     "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
     "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
     "disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
     "in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its "
     "contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS "
     "PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED "
     "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE "
     "LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF "
     "SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
     "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF "
     "THE POSSIBILITY OF SUCH DAMAGE."),
    ("MPL-2.0", "This source code form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Proprietary", "All rights reserved."),
]
#: Words that count for nothing.
STOP = ["a", "an", "and", "any", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "may", "not", "of", "on",
        "or", "that", "the", "this", "to", "use", "with", "you"]


#: Names of licence files.
LICENSE_NAMES = r"(?i)(?:licen[sc]e|copying)(?:\..*)?"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def _terms(text: Column) -> Column:
    """The distinct terms of a text."""
    return F.array_except(_words(text), F.array(*[F.lit(s) for s in STOP]))


def is_license_file(path: str = "path") -> Column:
    return F.regexp_extract(path, "[^/]*$", 0).rlike(f"^{LICENSE_NAMES}$")


def _stretches(words: Column) -> Column:
    """``array<struct<first, n, words>>`` of a file's words by line: every line, the first block of lines with words (comment
    signs are none), and for licence files all lines; ``first`` counts from 1."""
    def stretch(first: Column, n: Column, of: Column) -> Column:
        return F.struct(first.cast("int").alias("first"), n.cast("int").alias("n"), of.alias("words"))

    def block(begin: Column) -> Column:
        after = F.transform(F.slice(words, F.greatest(begin, F.lit(1)), F.size(words)), lambda w: F.size(w) > 0)
        length = C.let(F.array_position(after, F.lit(False)).cast("int"), lambda stop: F.when(stop > 0, stop - 1).otherwise(F.size(words) - begin + 1))
        return C.let(length, lambda n: F.when(begin > 0, F.array(stretch(begin, n, F.flatten(F.slice(words, F.greatest(begin, F.lit(1)), F.greatest(n, F.lit(0))))))))

    none = F.array().cast("array<struct<first:int,n:int,words:array<string>>>")
    header = C.let(F.array_position(F.transform(words, lambda w: F.size(w) > 0), F.lit(True)).cast("int"), block)
    whole = F.when(is_license_file(), F.array(stretch(F.lit(1), F.size(words), F.flatten(words))))
    lines = F.transform(words, lambda w, k: stretch(k + 1, F.lit(1), w))
    return F.concat(lines, F.coalesce(header, none), F.coalesce(whole, none))


def _possible(words: Column, vocabulary: Column, threshold: float) -> Column:
    """Whether a text of these words can reach the threshold with any template.

    Its cosine is at most the share of its length that lies in the templates' terms.  No weight exceeds that of a term in
    no template, and each of those counts once at least, so counts alone give a bound that loses nothing.
    """
    least = (threshold - 1e-6) ** 2

    def bound(terms: Column) -> Column:
        def compare(known: Column) -> Column:
            squares = F.aggregate(known, F.lit(0).cast("long"), lambda s, t: s + C.let(
                (F.size(words) - F.size(F.array_remove(words, t))).cast("long"), lambda n: n * n))
            return F.when(F.size(known) > 0, squares * (1 - least) >= least * (F.size(terms) - F.size(known))).otherwise(F.lit(False))

        return C.let(F.array_intersect(terms, vocabulary), compare)

    return C.let(F.array_except(words, F.array(*[F.lit(s) for s in STOP])), bound)


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, name, text) for k, (name, text) in enumerate(TEMPLATES)], "template int, license string, text string")


def _weighted(rows: DataFrame, key: str, idf: DataFrame, total: Column) -> DataFrame:
    """``(key, term, w)``: each term of a text weighs its count times its inverse document frequency."""
    top = F.log(total + 1) + 1  # a term in no template: counted as if no document had it
    counts = rows.select(key, F.explode(_words(F.col("text"))).alias("term")).where(~F.col("term").isin(STOP)).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    return (counts.join(idf, "term", "left")
            .select(key, "term", (F.col("tf") * F.coalesce(F.log((total + 1) / (F.col("df") + 1)) + 1, top)).alias("w")))


def own_licenses(files: DataFrame, threshold: float = 0.6) -> DataFrame:
    """``(path, own_license, own_score)`` of the files (``path``, ``text``) like a template in a line, the header or, for licence files, as a whole."""
    spark = files.sparkSession
    form = templates(spark)
    known = sorted({t for r in form.select(_terms(F.col("text")).alias("terms")).collect() for t in r.terms})  # of the templates, a parameter
    vocabulary = F.array(*[F.lit(t) for t in known])
    lines = F.split(C.text_or_empty(), "\n", -1)
    likely = C.let(F.transform(lines, _words), lambda w: F.filter(_stretches(w), lambda x: _possible(x["words"], vocabulary, threshold)))
    found = files.select("path", lines.alias("lines"), F.explode(likely).alias("x"))
    hits = found.select("path", F.array_join(F.slice("lines", F.col("x.first"), F.col("x.n")), "\n").alias("text"))
    hits = C.written(hits.select("path", "text", F.xxhash64("text").alias("part")), "licence-parts")
    df = (files.select(F.explode(F.array_intersect(_terms(C.text_or_empty()), vocabulary)).alias("term"))
          .groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    idf = C.written(spark.createDataFrame([(t,) for t in known], "term string").join(df, "term", "left")
                    .select("term", F.coalesce("df", F.lit(0)).alias("df")), "licence-idf")
    total = files.agg(F.count(F.lit(1))).scalar().cast("double")
    texts = hits.groupBy("part").agg(F.first("text").alias("text"))  # a text many files share is scored once
    ours = C.written(_weighted(texts, "part", idf, total), "licence-terms")
    theirs = C.written(_weighted(form, "template", idf, total), "licence-templates")
    squares = lambda w, key: w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias(f"{key}_norm"))
    dot = (ours.select("part", "term", F.col("w").alias("lw")).join(theirs, "term")
           .groupBy("part", "template").agg(F.sum(F.col("lw") * F.col("w")).alias("dot")))
    score = F.round(F.col("dot") / F.col("part_norm") / F.col("template_norm"), 6)
    like = (dot.join(squares(ours, "part"), "part").join(squares(theirs, "template"), "template").join(form.drop("text"), "template")
            .select("part", "license", score.alias("score")).where(F.col("score") >= threshold))
    best = F.max(F.struct("score", F.col("license")))
    scored = C.written(like.groupBy("part").agg(best.alias("b")).select("part", "b.score", "b.license"), "licence-scores")
    return (hits.select("path", "part").join(scored, "part").groupBy("path").agg(best.alias("b"))
            .select("path", F.col("b.license").alias("own_license"), F.col("b.score").alias("own_score")))


def directory(path: Column) -> Column:
    """The directory of a path; that of a top-level name is the empty path."""
    return F.regexp_replace(path, "(^|/)[^/]*$", "")


def scan(files: DataFrame) -> DataFrame:
    """``path, own_license, own_score, license, inherited_from`` per distinct path of ``files`` (``path``, ``text``).

    A file without a licence of its own inherits from the licence file (by its name) in the nearest directory above
    it; of several there, the first by path.  Null texts are empty; rows that repeat a path are one file with the
    lines of all; null paths are left out; an empty table gives an empty result; other columns are not read.
    """
    files = files.select(F.col("path").cast("string").alias("path"), F.col("text")).where("path IS NOT NULL")
    own = C.written(own_licenses(files), "own-licences")
    above = C.written(own.where(is_license_file()).groupBy(directory(F.col("path")).alias("dir"))
                      .agg(F.min(F.struct("path", "own_license")).alias("from")), "licence-directories")
    paths = files.select("path").distinct()
    bare = paths.join(own.select("path"), "path", "left_anti")
    parts = F.split(directory(F.col("path")), "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(
        k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("dir")))
    near = (bare.select("path", F.explode(F.array_distinct(ancestors)).alias("a")).select("path", "a.depth", "a.dir").join(above, "dir")
            .groupBy("path").agg(F.max(F.struct("depth", "from")).alias("n"))
            .select("path", F.col("n.from.own_license").alias("given"), F.col("n.from.path").alias("inherited_from")))
    return paths.join(own, "path", "left").join(near, "path", "left").select(
        "path", "own_license", "own_score", F.coalesce("own_license", "given").alias("license"), "inherited_from")
