"""Metadata extraction from Parquet and Delta tables (SRC-03 .. SRC-06, SRC-12 .. SRC-14).

Requests are ``(uri, format)`` rows.  Parquet paths are listed, every file's footer is read in a task of its own, and an
aggregation per path makes the profile: columns and partition keys of its first file, sums of rows and bytes.  Delta
paths go through ``delta_log``.  Failures become values (``status`` / ``error``), never job failures.

A path fails where its schema cannot be read; where only the count of some later file is missing, ``n_rows`` is NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from . import delta_log as DL
from . import files as FS

PROFILE = T.StructType([
    T.StructField("uri", T.StringType()),
    T.StructField("format", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("n_rows", T.LongType()),
    T.StructField("n_columns", T.IntegerType()),
    T.StructField("n_bytes", T.LongType()),
    T.StructField("columns", T.ArrayType(S.COLUMN_INFO)),
    T.StructField("partition_columns", T.ArrayType(T.StringType())),
])


FIELDS = ["n_rows", "n_columns", "n_bytes", "columns", "partition_columns"]


def parquet_metadata(paths: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """``uri, error, n_rows, n_columns, n_bytes, columns, partition_columns`` per distinct path of ``paths`` (``uri``).

    ``listed`` may bring the files of the paths (as ``files.data_files`` or ``files.below`` list them); else they are listed."""
    read = FS.footers(FS.data_files(paths) if listed is None else listed).select("uri", "n_rows", "length", F.struct("name", "columns", "error").alias("file"))
    per_path = read.groupBy("uri").agg(
        F.min_by("file", F.col("file.name")).alias("first"), F.min("file.error").alias("some_error"), DL.all_or_nothing_sum("n_rows").alias("n_rows"),
        F.sum("length").alias("n_bytes"))
    first = F.coalesce("first", F.struct(F.lit(None).cast("string").alias("name"), F.lit(None).cast("array<struct<name:string,dtype:string>>").alias("columns"),
                                         F.col("some_error").alias("error")))  # no file: the listing's error
    out = per_path.withColumn("first", first).withColumn("error", F.col("first.error"))
    good = lambda c: F.when(F.col("error").isNull(), c)
    return out.select("uri", "error", good(F.col("n_rows")).alias("n_rows"), F.size("first.columns").alias("n_columns"), good(F.col("n_bytes")).alias("n_bytes"),
                      FS.column_infos("first.columns").alias("columns"), good(FS.partition_keys("first.name")).alias("partition_columns"))


def profile_paths(paths: DataFrame, uri_col: str = "uri", format_col: str = "format") -> DataFrame:
    """SRC-06: one metadata row per request row (``uri``, ``format``) with ``status``/``error``.

    Unknown formats are an error naming the supported ones (SRC-05); a NULL path is an error.  Equal requests are read
    once and every request gets its row."""
    asked = paths.select(F.col(uri_col).alias("uri"), F.col(format_col).alias("format")).withColumn("reader", extractor_for("format"))
    found = None
    for reader, metadata in (("parquet", parquet_metadata), ("delta", DL.table_metadata)):
        got = metadata(asked.where(F.col("reader") == reader)).withColumn("r", F.lit(reader))
        found = got if found is None else found.unionByName(got)
    found = found.withColumnRenamed("uri", "u").withColumnRenamed("error", "why")
    out = asked.join(found, (F.col("uri") == F.col("u")) & (F.col("reader") == F.col("r")), "left")
    failed = F.coalesce("why", F.when(F.col("uri").isNull(), F.lit("no path given")))
    error = F.coalesce(extractor_error("format"), F.concat(F.lit("Metadata extraction failed: "), failed))
    status = F.when(F.col("reader").isNull(), "unsupported_format").when(failed.isNotNull(), "error").otherwise("ok")
    return out.select("uri", "format", status.alias("status"), error.alias("error"),
                      *[F.col(c).cast(PROFILE[c].dataType).alias(c) for c in FIELDS])


def extracted(located: DataFrame) -> DataFrame:
    """``uri, format`` and the metadata read at ``path`` by the format's reader, for the rows of ``located`` where that works."""
    asked = located.select(F.col("path").alias("uri"), "format").distinct()
    found = profile_paths(asked).where("status = 'ok'").select(F.col("uri").alias("p"), F.col("format").alias("f"), *FIELDS)
    return located.select("uri", "path", "format").join(found, (F.col("path") == F.col("p")) & (F.col("format") == F.col("f"))).select(
        "uri", "format", *FIELDS)


def inventory(located: DataFrame) -> DataFrame:
    """What storage holds at each URI: ``uri, actual_format, error, n_rows, n_bytes, columns, partition_columns``.

    ``located`` gives each ``uri`` the ``path`` it is reached by; equal paths are looked at once.  ``actual_format`` is
    the reader that can read it (``delta`` before ``parquet``) or ``other``; URIs without a file or folder have no row,
    unless the storage cannot be reached: then ``error`` says why and ``actual_format`` is NULL."""
    paths = located.select(F.col("path").alias("uri")).where("path IS NOT NULL").distinct()
    there = FS.existence(paths).where("found OR error IS NOT NULL").select(F.col("uri").alias("path"), F.col("error").alias("unreachable"))
    read = {"delta": DL.table_metadata(paths), "parquet": parquet_metadata(paths)}
    for name, found in read.items():
        there = there.join(found.select(F.col("uri").alias(f"u_{name}"), F.struct("error", *FIELDS).alias(name)), F.col("path") == F.col(f"u_{name}"), "left")
    fits = {name: F.col("unreachable").isNull() & F.col(name).isNotNull() & F.col(f"{name}.error").isNull() for name in read}
    actual = F.when(F.col("unreachable").isNotNull(), F.lit(None)).when(fits["delta"], "delta").when(fits["parquet"], "parquet").otherwise("other")
    value = lambda c: F.when(fits["delta"], F.col(f"delta.{c}").cast(PROFILE[c].dataType)).when(
        fits["parquet"], F.col(f"parquet.{c}").cast(PROFILE[c].dataType)).alias(c)
    seen = there.select(F.col("path").alias("p"), actual.alias("actual_format"), F.col("unreachable").alias("error"), *map(value, FIELDS))
    return located.select("uri", "path").join(seen, F.col("path") == F.col("p")).drop("path", "p")


def extractor_for(fmt_col: str = "format") -> F.Column:
    """SRC-05 as a column: extractor name, or NULL when there is none."""
    f = F.lower(F.col(fmt_col))
    return F.when(f.isin(*S.SUPPORTED_EXTRACT_FORMATS), f)


def extractor_error(fmt_col: str = "format") -> F.Column:
    return F.when(extractor_for(fmt_col).isNull(), F.concat(
        F.lit("No metadata extractor for format '"), F.coalesce(F.col(fmt_col), F.lit("None")),
        F.lit("'. Supported: " + ", ".join(sorted(S.SUPPORTED_EXTRACT_FORMATS)))))


def sniff(profiled: DataFrame) -> DataFrame:
    """SRC-12/13/14 from a profile: NULL format -> pass with message; format without a sniffer ->
    pass with message; else readable schema -> pass, otherwise fail with the reader's message."""
    fmt = F.lower(F.col("format"))
    label = F.when(fmt == "parquet", F.lit("Parquet")).otherwise(F.lit("Delta"))
    msg = (F.when(F.col("format").isNull(), F.lit("No format specified; skipping sniff"))
           .when(~fmt.isin("parquet", "delta"), F.concat(F.lit("No sniffer registered for format '"), F.col("format"), F.lit("'")))
           .when(F.col("status") != "ok", F.concat(label, F.lit(" sniff failed: "),
                                                   F.regexp_replace("error", "^Metadata extraction failed: ", ""))))
    passed = F.col("format").isNull() | ~fmt.isin("parquet", "delta") | (F.col("status") == "ok")
    return profiled.withColumn("sniff_passed", passed).withColumn("sniff_message", msg)
