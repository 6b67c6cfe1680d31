"""Storage listing and path existence (SRC-11 on real file systems).

A folder (or glob) is listed by Spark's ``binaryFile`` source selecting only
``path`` and ``length``: the file contents are never read.  Candidate URIs
are left-joined to the listing, so existence is a distributed join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def list_files(spark: SparkSession, root: str, glob: str | None = None, recursive: bool = False) -> DataFrame:
    """``(path, length, modification_time)`` for every file under ``root``."""
    r = spark.read.format("binaryFile")
    if glob:
        r = r.option("pathGlobFilter", glob)
    if recursive:
        r = r.option("recursiveFileLookup", "true")
    return r.load(root).select("path", "length", F.col("modificationTime").alias("modification_time"))


def normalize_path(col) -> F.Column:
    """``file:/x`` / ``file:///x`` -> ``/x`` so local paths compare equal."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(c, r"^file:(//)?", "")


def uri_exists(uris: DataFrame, listing: DataFrame, uri_col: str = "uri") -> DataFrame:
    """Adds ``reachable_passed`` / ``reachable_message``: a URI exists if it is a listed
    file or a prefix folder of one (``uri/...``)."""
    files = listing.select(normalize_path("path").alias("_p"))
    exact = files.select(F.col("_p").alias("_k")).withColumn("_hit", F.lit(True))
    # every ancestor folder of a listed file also exists
    parents = files.select(F.explode(F.expr(
        "transform(sequence(2, size(split(_p, '/')) - 1), i -> array_join(slice(split(_p, '/'), 1, i), '/'))")).alias("_k")
    ).distinct().withColumn("_hit", F.lit(True))
    known = exact.unionByName(parents).groupBy("_k").agg(F.max("_hit").alias("_hit"))
    u = uris.withColumn("_k", F.regexp_replace(normalize_path(uri_col), "/+$", ""))
    j = u.join(known, "_k", "left")
    found = F.coalesce(F.col("_hit"), F.lit(False))
    return j.withColumn("reachable_passed", found).withColumn(
        "reachable_message", F.when(~found, F.concat(F.lit("URI does not exist: "), F.col(uri_col)))).drop("_k", "_hit")
