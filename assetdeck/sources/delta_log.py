"""Delta transaction logs as DataFrames (SRC-04, WIN-04, AGG-02).

The logs of a whole table of paths are read at once: files are listed per path, the newest complete checkpoint is an
aggregation over file names, and only it and the commits after it are opened, each file in its own task.  The newest
action per (table, file, deletion vector) is a ``max_by`` aggregation, so one huge table does not become one task;
per-table sums are all-or-nothing.  Nothing passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import files as FS

DELETION_VECTOR = T.StructField("deletionVector", T.StructType([
    T.StructField("storageType", T.StringType()), T.StructField("pathOrInlineDv", T.StringType()), T.StructField("offset", T.IntegerType())]))

ACTION = T.StructType([
    T.StructField("add", T.StructType([
        T.StructField("path", T.StringType()), T.StructField("size", T.LongType()), T.StructField("stats", T.StringType()),
        DELETION_VECTOR,
    ])),
    T.StructField("remove", T.StructType([T.StructField("path", T.StringType()), DELETION_VECTOR])),
    T.StructField("metaData", T.StructType([
        T.StructField("schemaString", T.StringType()), T.StructField("partitionColumns", T.ArrayType(T.StringType())),
    ])),
])

SCHEMA_STRING = T.StructType([T.StructField("fields", T.ArrayType(T.StructType([
    T.StructField("name", T.StringType()), T.StructField("type", T.StringType())])))])

#: Fixed names: a commit, a checkpoint in one file or in numbered parts, a checkpoint with sidecar files.
COMMIT = r"^(\d+)\.json$"
CHECKPOINT = r"^(\d+)\.checkpoint(?:\.(\d{10})\.(\d{10}))?\.parquet$"
WITH_SIDECARS = r"^(\d+)\.checkpoint\.[0-9a-f]{8}-[0-9a-f-]{27}\.(?:json|parquet)$"


def _version(pattern: str) -> Column:
    return F.nullif(F.regexp_extract("name", pattern, 1), F.lit("")).cast("bigint")


def segments(listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(files, tables)`` of the listed log files (``files.log_files``).

    ``tables`` has one row per table with a log: ``uri, checkpoint, error``.  A checkpoint counts once all its parts
    are there; commits must follow it (or version 0) without a gap, else the table cannot be read.  ``files`` are the
    files to read: ``uri, file, version``.
    """
    part, parts = (F.coalesce(F.nullif(F.regexp_extract("name", CHECKPOINT, k), F.lit("")).cast("int"), F.lit(1)) for k in (2, 3))
    named = listed.where("error IS NULL").select("uri", "file", "name", _version(COMMIT).alias("commit"), _version(CHECKPOINT).alias("ck"), part.alias("part"),
                                                 parts.alias("parts"), F.col("name").rlike(WITH_SIDECARS).alias("sidecars"))
    named = named.where("commit IS NOT NULL OR ck IS NOT NULL OR sidecars")
    complete = (named.where("ck IS NOT NULL").groupBy("uri", "ck", "parts").agg(F.count_distinct("part").alias("n")).where("n = parts")
                .groupBy("uri").agg(F.max(F.struct("ck", "parts")).alias("newest")))
    known = named.join(complete, "uri", "left").withColumn("from", F.coalesce(F.col("newest.ck"), F.lit(-1)))
    use = F.coalesce(F.col("commit") > F.col("from"), F.lit(False)) | F.coalesce(
        (F.col("ck") == F.col("newest.ck")) & (F.col("parts") == F.col("newest.parts")), F.lit(False))
    later = F.when(F.col("commit") > F.col("from"), F.col("commit"))
    per_table = known.groupBy("uri").agg(F.max("newest.ck").alias("checkpoint"), F.max("from").alias("from"), F.count(later).alias("commits"),
                                         F.max(later).alias("last"), F.max("sidecars").alias("sidecars"))
    gap = F.col("commits") != F.coalesce(F.col("last") - F.col("from"), F.lit(0))
    error = (F.when(gap & F.col("sidecars"), F.concat(F.lit("Delta log at '"), "uri", F.lit("' has a checkpoint with sidecar files, which cannot be read")))
             .when(gap, F.concat(F.lit("Delta log at '"), "uri", F.lit("' lacks commits after version "), F.col("from").cast("string")))
             .when((F.col("commits") == 0) & F.col("checkpoint").isNull(),
                   F.concat(F.lit("Delta log at '"), "uri", F.lit("' has a checkpoint with sidecar files, which cannot be read"))))
    tables = per_table.select("uri", "checkpoint", error.alias("error"))
    wanted = known.where(use).select("uri", "file", F.coalesce("commit", "ck").alias("version"))
    return wanted.join(tables.where("error IS NULL").select("uri"), "uri"), tables


def _vector(action: str) -> Column:
    """Identity of a deletion vector; NULL for a file without one."""
    v = F.col(f"a.{action}.deletionVector")
    return F.when(v.isNotNull(), F.concat_ws("@", v["storageType"], v["pathOrInlineDv"], v["offset"].cast("string")))


def read_actions(files: DataFrame) -> DataFrame:
    """The actions of the given log files (``uri, file, version``): ``(table, version, add_path, add_size, num_records,
    remove_path, vector, schema_string, partition_columns, error)``; a file or line that cannot be read is a row with an error.
    """
    read = FS.log_lines(files).withColumn("a", F.from_json("value", ACTION))
    bad = F.coalesce("error", F.when(F.try_parse_json("value").isNull(), F.concat(F.lit("unreadable action in version "), F.col("version").cast("string"))))
    return read.select(
        F.col("uri").alias("table"), "version",
        F.col("a.add.path").alias("add_path"), F.col("a.add.size").alias("add_size"),
        F.get_json_object("a.add.stats", "$.numRecords").cast("bigint").alias("num_records"),
        F.col("a.remove.path").alias("remove_path"), F.coalesce(_vector("add"), _vector("remove"), F.lit("")).alias("vector"),
        F.col("a.metaData.schemaString").alias("schema_string"),
        F.col("a.metaData.partitionColumns").alias("partition_columns"), bad.alias("error"))


def live_files(actions: DataFrame, order: list[str] | None = None) -> DataFrame:
    """WIN-04: newest action per (table, path, deletion vector) by ``order`` (default: version); keep adds only.

    A commit that gives a file a new deletion vector adds it under that vector and removes it under the old one, so
    the two are different entries.  ``actions`` without a column ``vector`` have none."""
    order = order or ["version"]
    if "vector" not in actions.columns:
        actions = actions.withColumn("vector", F.lit(""))
    acts = actions.where(F.col("add_path").isNotNull() | F.col("remove_path").isNotNull()).withColumn(
        "path", F.coalesce("add_path", "remove_path"))
    payload = F.struct(*order, F.col("add_path").isNotNull().alias("is_add"), "add_size", "num_records")
    newest = acts.groupBy("table", "path", "vector").agg(F.max_by(payload, F.struct(*order)).alias("n"))
    return newest.where(F.col("n.is_add")).select("table", "path", F.col("n.add_size").alias("size"),
                                                   F.col("n.num_records").alias("num_records"))


def all_or_nothing_sum(c: Column | str, rows: Column | str | None = None) -> Column:
    """AGG-02: sum when every value is known, NULL if one is missing, 0 for no rows.

    After an outer join, ``rows`` is a column that is NULL where there was no row."""
    x = F.col(c) if isinstance(c, str) else c
    n = F.count(F.lit(1) if rows is None else rows)
    return F.when(n == F.count(x), F.coalesce(F.sum(x), F.lit(0)))


def table_metadata(tables: DataFrame) -> DataFrame:
    """``uri, error, n_rows, n_columns, n_bytes, columns, partition_columns`` per distinct path of ``tables`` (``uri``).

    Columns and partition columns come from the newest metadata action, totals are all-or-nothing over live files.
    No log, a gap in it, an unreadable file and a log without metadata are errors; a NULL path has no log.
    """
    uris = tables.select("uri").where("uri IS NOT NULL").distinct()
    listed = FS.log_files(uris)  # two small reads of it follow: what to open, and what could not be listed
    files, found = segments(listed)
    actions = read_actions(files)
    newest = actions.where(F.col("schema_string").isNotNull()).groupBy("table").agg(
        F.max_by(F.struct("schema_string", "partition_columns"), "version").alias("m"))
    newest = newest.select("table", F.from_json("m.schema_string", SCHEMA_STRING)["fields"].alias("fields"),
                           F.col("m.partition_columns").alias("partition_columns"))
    live = live_files(actions).groupBy("table").agg(all_or_nothing_sum("num_records").alias("n_rows"), all_or_nothing_sum("size").alias("n_bytes"),
                                                    F.lit(True).alias("has_live"))
    broken = actions.where(F.col("error").isNotNull()).groupBy("table").agg(F.min("error").alias("broken"))
    unlisted = listed.where("error IS NOT NULL").select(F.col("uri").alias("u"), F.col("error").alias("unlisted"))
    found = found.select(F.col("uri").alias("f"), F.col("error").alias("unread"))
    out = (uris.join(found, F.col("uri") == F.col("f"), "left").join(unlisted, F.col("uri") == F.col("u"), "left")
           .join(newest.withColumnRenamed("table", "t1"), F.col("uri") == F.col("t1"), "left")
           .join(live.withColumnRenamed("table", "t2"), F.col("uri") == F.col("t2"), "left")
           .join(broken.withColumnRenamed("table", "t3"), F.col("uri") == F.col("t3"), "left"))
    at = F.concat(F.lit("Delta log at '"), "uri")
    error = F.coalesce("unlisted", F.when(F.col("f").isNull(), F.concat(F.lit("No Delta transaction log found at '"), "uri", F.lit(
        "'. This path may not contain a Delta Lake table."))), "unread", F.when(F.col("broken").isNotNull(), F.concat(at, F.lit("': "), "broken")),
        F.when(F.col("fields").isNull(), F.concat(at, F.lit("' has no metadata action"))))
    out = out.withColumn("error", error)
    good = lambda c: F.when(F.col("error").isNull(), c)
    total = lambda c: good(F.when(F.col("has_live"), F.col(c)).otherwise(F.lit(0).cast("bigint"))).alias(c)
    columns = F.transform("fields", lambda f: F.struct(f["name"].alias("name"), f["type"].alias("dtype")))
    return out.select("uri", "error", total("n_rows"), good(F.size("fields")).alias("n_columns"), total("n_bytes"),
                      good(columns).alias("columns"), good(F.col("partition_columns")).alias("partition_columns"))
