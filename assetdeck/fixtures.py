"""Asset inputs derived from the driver's tables.

Each derivation is pure column arithmetic over one source table, so the same
rows can be written a second time in plain SQL (``plans/fixture_sql.py``) and
compared.  All of them scale with their source table: one asset per order,
one annotation per line item, one registration candidate per event.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import schema as S

# Dtype names used for generated column metadata: a mix of Arrow/Polars and
# Spark spellings so that dtype normalisation has work to do.
DTYPE_CYCLE = ("int64", "Int64", "uint64", "float64", "string", "list[int64]", "decimal(20,0)", "double")

# Reference point for expiry: never the wall clock, so results are stable.
DEFAULT_NOW = "1999-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Source rows a task derives wide rows from; a file split of the source holds millions.
ROWS_PER_TASK = 250_000


def spread(rows: DataFrame, per_task: int | None = None) -> DataFrame:
    """``rows`` dealt, still narrow, over tasks of about ``per_task`` each (few rows: as they are).

    For rows that grow many times when derived and are sorted then: a task sorts what fits its memory, however large its split was."""
    n = -(-rows.count() // (per_task or ROWS_PER_TASK))
    return rows.repartition(max(n, rows.sparkSession.sparkContext.defaultParallelism), *rows.columns) if n > 1 else rows


def now_lit(now: str | None = None):
    return F.lit(now or DEFAULT_NOW).cast("timestamp")


def assets(spark: SparkSession, sf_dir: str, with_columns: bool = True) -> DataFrame:
    """Asset snapshot: one asset per order (``id`` = order key).

    ``cached_metadata.columns`` holds ``1 + id % 6`` generated columns named
    ``col_1..col_n``; annotations are attached separately (see ``annotations``).
    """
    return assets_from(table(spark, sf_dir, "orders"), with_columns)


def assets_to_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``assets`` for ``write_base``, which sorts whole rows (about 1 kB each) by datastack in every task."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_custkey", "o_orderstatus", "o_orderdate")
    return assets_from(spread(o))


def assets_from(o: DataFrame, with_columns: bool = True) -> DataFrame:
    """The asset derivation over any orders DataFrame."""
    df = o.selectExpr(
        "CAST(o_orderkey AS STRING) AS id",
        "concat('ds', CAST(o_orderkey % 4 AS STRING)) AS datastack",
        "concat('tbl_', CAST(o_orderkey % 500 AS STRING), CASE WHEN o_orderkey % 7 = 0 THEN '.by_key' ELSE '' END) AS name",
        "CAST(CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 900 + o_orderkey % 7 END AS INT) AS mat_version",
        "CAST(o_orderkey DIV 500 AS INT) AS revision",
        "concat('gs://bucket-', CAST(o_orderkey % 10 AS STRING), '/t/', CAST(o_orderkey AS STRING)) AS uri",
        "CASE o_orderpriority WHEN '1-URGENT' THEN 'delta' WHEN '2-HIGH' THEN 'parquet' "
        "WHEN '3-MEDIUM' THEN 'delta' WHEN '4-NOT SPECIFIED' THEN 'precomputed' ELSE NULL END AS format",
        "CASE WHEN o_orderkey % 6 = 0 THEN 'asset' ELSE 'table' END AS asset_type",
        "o_custkey AS owner",
        "o_orderkey % 2 = 0 AS is_managed",
        "CASE WHEN o_orderkey % 4 = 0 THEN 'mutable' ELSE 'static' END AS mutability",
        "CASE o_orderstatus WHEN 'F' THEN 'stable' WHEN 'O' THEN 'draft' ELSE 'deprecated' END AS maturity",
        "CASE o_orderkey % 10 "
        "WHEN 0 THEN concat('{\"source\": \"materialization\", \"source_table\": \"nation_', CAST(o_orderkey % 25 AS STRING), "
        "'\", \"mat_version\": ', CAST(900 + o_orderkey % 7 AS STRING), '}') "
        "WHEN 5 THEN concat('{\"tag\": \"t', CAST(o_orderkey % 3 AS STRING), '\", \"nested\": {\"level\": ', CAST(o_orderkey % 4 AS STRING), '}}') "
        "ELSE '{}' END AS properties",
        "CASE WHEN o_orderkey % 8 = 0 THEN concat('grp', CAST(o_custkey % 5 AS STRING)) WHEN o_orderkey % 8 = 4 THEN '' END AS access_group",
        "o_orderdate AS created_at",
        "CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 90 DAYS END AS expires_at",
        "CASE WHEN o_orderkey % 6 = 0 THEN NULL WHEN o_orderkey % 9 = 0 THEN 'materialization' ELSE 'user' END AS source",
        "o_orderkey % 6 <> 0 AS _is_table",
        "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE ((o_orderkey % 1000003) * 7919) % 100000007 END AS _n_rows",
        "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE ((o_orderkey % 1000003) * 1048573) % 1099511627776 END AS _n_bytes",
        "CAST(1 + o_orderkey % 6 AS INT) AS _n_cols",
        "o_orderkey AS _k",
    )
    # col_1 .. col_n built from plain (code-generated) expressions; no lambda per element
    cols = F.slice(F.array(*[
        F.struct(F.lit(f"col_{i}").alias("name"), _dtype_col((F.col("_k") + i) % 8).alias("dtype")) for i in range(1, 7)
    ]), 1, F.col("_n_cols"))
    md = F.when(
        F.col("_is_table"),
        F.struct(
            F.col("_n_rows").cast("bigint").alias("n_rows"),
            F.col("_n_cols").alias("n_columns"),
            F.col("_n_bytes").cast("bigint").alias("n_bytes"),
            (cols if with_columns else F.lit(None).cast("array<struct<name:string,dtype:string>>")).alias("columns"),
            F.when(F.col("_k") % 4 == 1, F.array(F.lit("col_1"))).otherwise(F.array().cast("array<string>")).alias("partition_columns"),
        ),
    )
    out = df.withColumn("cached_metadata", md).withColumn(
        "metadata_cached_at", F.when(F.col("_is_table"), F.col("created_at"))
    ).withColumn("column_annotations", F.lit(None).cast(T.ArrayType(S.ANNOTATION)))
    return out.select(*S.ASSET_COLUMNS)


def _dtype_col(idx):
    expr = None
    for i, d in enumerate(DTYPE_CYCLE):
        expr = F.when(idx == i, F.lit(d)) if expr is None else expr.when(idx == i, F.lit(d))
    return expr


def asset_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form of discovered columns: one row per (table asset, position)."""
    a = assets(spark, sf_dir)
    return a.where(F.col("cached_metadata").isNotNull()).select(
        "id", F.posexplode("cached_metadata.columns").alias("pos", "c")
    ).select(
        F.col("id").alias("asset_id"),
        (F.col("pos") + 1).cast("int").alias("pos"),
        F.col("c.name").alias("name"),
        F.col("c.dtype").alias("dtype"),
    )


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long-form column annotations, one per line item, in submission order ``pos``.

    About one in ten names a column that does not exist (orphan); line items
    whose part key is a multiple of 7 re-annotate ``col_1`` so that the
    last-wins rule matters; split points share (group, axis) on purpose.
    Line numbers repeat within an order, so submission order is ``(pos, tie)``.
    """
    li = table(spark, sf_dir, "lineitem")
    return li.selectExpr(
        "CAST(l_orderkey AS STRING) AS asset_id",
        "l_linenumber AS pos",
        "l_partkey * 100003 + l_suppkey % 100003 AS tie",
        "CASE WHEN l_partkey % 10 = 0 THEN concat('orphan_', CAST(l_linenumber AS STRING)) "
        "WHEN l_partkey % 7 = 0 THEN 'col_1' ELSE concat('col_', CAST(l_linenumber AS STRING)) END AS column_name",
        "CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE concat('note ', CAST(l_partkey AS STRING)) END AS description",
        "CASE l_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'materialization' WHEN 2 THEN 'segmentation' "
        "WHEN 3 THEN 'packed_point' ELSE 'split_point' END AS kind",
        "CASE WHEN l_partkey % 5 = 1 THEN CASE WHEN l_suppkey % 6 = 0 THEN '' "
        "ELSE concat('nation_', CAST(l_suppkey % 30 AS STRING)) END END AS target_table",
        "CASE WHEN l_partkey % 5 = 1 THEN CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE 'id' END END AS target_column",
        "CASE WHEN l_partkey % 5 = 2 THEN CASE l_suppkey % 4 WHEN 0 THEN 'root_id' WHEN 1 THEN 'supervoxel_id' "
        "WHEN 2 THEN concat('level', CAST(l_suppkey % 9 AS STRING), '_id') ELSE 'level_x' END END AS node_level",
        "CASE WHEN l_partkey % 5 = 3 THEN CASE l_suppkey % 3 WHEN 0 THEN NULL WHEN 1 THEN array(4.0D, 4.0D, 40.0D) "
        "ELSE array(8.0D, 8.0D) END END AS resolution",
        "CASE WHEN l_partkey % 5 = 4 THEN CASE l_suppkey % 4 WHEN 0 THEN 'x' WHEN 1 THEN 'y' WHEN 2 THEN 'z' END END AS axis",
        "CASE WHEN l_partkey % 5 = 4 AND l_partkey % 3 <> 0 THEN concat('pt', CAST(l_partkey % 2 AS STRING)) END AS point_group",
        "CASE WHEN l_partkey % 5 = 4 THEN l_tax END AS axis_resolution",
    )


def annotation_struct(df: DataFrame) -> DataFrame:
    """Pack long-form annotation columns into the ``ANNOTATION`` struct."""
    kind = F.when(
        F.col("kind").isNotNull(),
        F.struct(*[F.col(f.name).alias(f.name) for f in S.KIND.fields]),
    )
    return df.select(
        "asset_id", "pos", "tie",
        F.struct(F.col("column_name"), F.col("description"), kind.alias("kind")).alias("annotation"),
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registration batch: one candidate per event, in ``seq`` order.

    Contains bad names, reserved names, copies of asset keys and URIs, and
    key/URI collisions inside the batch.
    """
    return candidates_from(table(spark, sf_dir, "events"))


def candidates_from(ev: DataFrame) -> DataFrame:
    """The candidate derivation over any events DataFrame (batch or stream)."""
    return ev.selectExpr(
        "event_id AS seq",
        "user_id",
        "CASE WHEN event_id % 23 = 0 THEN concat('ds', CAST(event_id % 4 AS STRING)) "
        "ELSE concat('ds', CAST(user_id % 5 AS STRING)) END AS datastack",
        "CASE WHEN event_id % 23 = 0 THEN concat('tbl_', CAST(event_id % 500 AS STRING), CASE WHEN event_id % 7 = 0 THEN '.by_key' ELSE '' END) "
        "WHEN event_id % 11 = 0 THEN concat(upper(event_type), '_', CAST(user_id % 40 AS STRING)) "
        "WHEN event_id % 13 = 0 THEN concat(event_type, '_', CAST(user_id % 40 AS STRING), '.') "
        "WHEN event_id % 17 = 0 THEN concat('nation_', CAST(user_id % 25 AS STRING), CASE WHEN user_id % 2 = 0 THEN '.by_root' ELSE '' END) "
        "ELSE concat(event_type, '_', CAST(user_id % 40 AS STRING)) END AS name",
        "CAST(CASE WHEN event_id % 23 = 0 THEN CASE WHEN event_id % 5 = 0 THEN NULL ELSE 900 + event_id % 7 END "
        "WHEN event_id % 4 = 0 THEN NULL ELSE 900 + user_id % 7 END AS INT) AS mat_version",
        "CAST(CASE WHEN event_id % 23 = 0 THEN event_id DIV 500 ELSE event_id % 3 END AS INT) AS revision",
        "CASE WHEN event_id % 19 = 0 THEN concat('gs://bucket-', CAST(event_id % 10 AS STRING), '/t/', CAST(event_id AS STRING)) "
        "ELSE concat('gs://bucket-', CAST(user_id % 10 AS STRING), '/c/', CAST(CAST(floor(value) AS BIGINT) AS STRING)) END AS uri",
        "CASE event_id % 5 WHEN 0 THEN 'delta' WHEN 1 THEN 'parquet' WHEN 2 THEN 'Parquet' WHEN 3 THEN 'precomputed' END AS format",
        "CASE WHEN event_id % 2 = 0 THEN 'table' ELSE 'asset' END AS asset_type",
        "CASE WHEN event_id % 41 <> 0 THEN event_id % 3 = 0 END AS is_managed",
        "CASE WHEN event_id % 37 = 0 THEN 'frozen' WHEN event_id % 4 = 1 THEN 'mutable' ELSE 'static' END AS mutability",
        "CASE event_id % 3 WHEN 0 THEN 'stable' WHEN 1 THEN 'draft' ELSE 'deprecated' END AS maturity",
        "CASE WHEN event_id % 31 = 0 THEN 'not json' WHEN event_id % 47 = 0 THEN '[1, 2]' WHEN event_id % 53 = 0 THEN '7' "
        "WHEN event_id % 59 = 0 THEN NULL WHEN event_id % 29 = 0 THEN concat('{\"source\": \"materialization\", \"source_table\": \"nation_', "
        "CAST(user_id % 30 AS STRING), '\", \"mat_version\": ', CAST(900 + user_id % 7 AS STRING), '}') "
        "WHEN event_id % 43 = 0 THEN '{\"source\": \"materialization\"}' "
        "ELSE props END AS properties",
        "CASE WHEN event_id % 8 = 0 THEN concat('grp', CAST(user_id % 5 AS STRING)) END AS access_group",
        "CASE WHEN event_id % 9 = 0 THEN ts + INTERVAL 30 DAYS END AS expires_at",
    )


def mat_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference objects: nations are tables, regions are views."""
    n = table(spark, sf_dir, "nation").selectExpr(
        "concat('ds', CAST(n_nationkey % 4 AS STRING)) AS datastack",
        "CAST(900 + n_nationkey % 7 AS INT) AS version",
        "'table' AS object_type",
        "lower(n_name) AS object_name",
        "n_nationkey % 5 <> 4 AS is_current",
        "CASE WHEN n_nationkey % 2 = 0 THEN array('id', 'pt_position_bbox', 'size') "
        "ELSE array('id', 'pre_pt_position_bbox', 'post_pt_position') END AS fields",
    )
    r = table(spark, sf_dir, "region").selectExpr(
        "concat('ds', CAST(r_regionkey % 4 AS STRING)) AS datastack",
        "CAST(900 + r_regionkey % 7 AS INT) AS version",
        "'view' AS object_type",
        "concat(lower(replace(r_name, ' ', '_')), '_view') AS object_name",
        "true AS is_current",
        "array('id', 'region_bbox') AS fields",
    )
    return n.unionByName(r)


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr("c_custkey AS user_id", "c_custkey % 97 = 0 AS is_admin")


def permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    ds = c.selectExpr(
        "c_custkey AS user_id",
        "concat('ds', CAST(c_nationkey % 4 AS STRING)) AS resource",
        "CASE c_mktsegment WHEN 'BUILDING' THEN 'view' WHEN 'HOUSEHOLD' THEN 'view' "
        "WHEN 'AUTOMOBILE' THEN 'edit' WHEN 'FURNITURE' THEN 'edit' ELSE 'admin' END AS permission",
    )
    grp = c.where("c_custkey % 3 = 0").selectExpr(
        "c_custkey AS user_id", "concat('grp', CAST(c_custkey % 5 AS STRING)) AS resource", "'view' AS permission"
    )
    return ds.unionByName(grp)


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").selectExpr(
        "c_custkey AS user_id", "concat('grp', CAST((c_custkey + 1) % 5 AS STRING)) AS group_name"
    )


def view_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user, asset) access requests: each event asks for the asset with the same key."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS request_id", "user_id", "CAST(event_id AS STRING) AS asset_id"
    )


def form_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat form cells ``(asset_id, idx, tie, field, value)`` as a browser form would post them.

    A form row is ``(asset_id, idx, tie)``: line numbers repeat within an order.
    """
    li = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    base = li.selectExpr(
        "CAST(l_orderkey AS STRING) AS asset_id",
        "l_linenumber - 1 AS idx",
        "l_partkey * 100003 + l_suppkey % 100003 AS tie",
        "l_partkey", "l_suppkey",
    )
    fields = F.array(
        F.struct(F.lit("name").alias("field"), F.concat(F.lit("col_"), (F.col("idx") + 1).cast("string")).alias("value")),
        F.struct(F.lit("desc").alias("field"),
                 F.when(F.col("l_suppkey") % 3 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" note "), F.col("l_partkey").cast("string"))).alias("value")),
        F.struct(F.lit("kind").alias("field"),
                 F.element_at(F.array(*[F.lit(x) for x in ("", "materialization", "segmentation", "packed_point", "split_point")]),
                              (F.col("l_partkey") % 5 + 1).cast("int")).alias("value")),
        F.struct(F.lit("target_table").alias("field"),
                 F.when(F.col("l_suppkey") % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("nation_"), (F.col("l_suppkey") % 30).cast("string"))).alias("value")),
        F.struct(F.lit("target_column").alias("field"), F.when(F.col("l_suppkey") % 5 == 0, F.lit(" ")).otherwise(F.lit("id")).alias("value")),
        F.struct(F.lit("node_level").alias("field"),
                 F.element_at(F.array(*[F.lit(x) for x in ("root_id", "supervoxel_id", "custom", "custom")]),
                              (F.col("l_suppkey") % 4 + 1).cast("int")).alias("value")),
        F.struct(F.lit("custom_level").alias("field"),
                 F.when(F.col("l_suppkey") % 4 == 3, F.lit("")).otherwise((F.col("l_partkey") % 9).cast("string")).alias("value")),
        F.struct(F.lit("resolution").alias("field"),
                 F.element_at(F.array(*[F.lit(x) for x in ("4, 4, 40", "", "8,8", "1.5,,2.5, 3", "2")]),
                              (F.col("l_suppkey") % 5 + 1).cast("int")).alias("value")),
        F.struct(F.lit("axis").alias("field"),
                 F.element_at(F.array(*[F.lit(x) for x in ("x", "y", "z", " ")]), (F.col("l_partkey") % 4 + 1).cast("int")).alias("value")),
        F.struct(F.lit("point_group").alias("field"),
                 F.when(F.col("l_partkey") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("pt"), (F.col("l_partkey") % 2).cast("string"))).alias("value")),
    )
    return base.select("asset_id", "idx", "tie", F.explode(fields).alias("c")).select(
        "asset_id", F.col("idx").cast("int").alias("idx"), "tie", F.col("c.field").alias("field"), F.col("c.value").alias("value")
    )


#: Kinds of stored tables, by number modulo ``MOUNTS``: their columns, rows and, for Delta, bytes follow from it.
MOUNTS = 24
#: Arrow's names of the types that stand for ``DTYPE_CYCLE`` in a Parquet file.
PARQUET_DTYPES = ("int64", "int64", "uint64", "double", "string", "list<element: int64>", "decimal128(20, 0)", "double")
_mounted: dict[tuple[str, str], str] = {}


def _write_mounts(root: str):
    """Writes table ``k`` as a Parquet file and as a Delta log (three files, one removed again, in two commits)."""

    def run(batches):
        import json

        import pandas as pd
        import pyarrow as pa
        import pyarrow.parquet as pq

        from assetdeck.sources.files import opened

        arrow = [pa.int64(), pa.int64(), pa.uint64(), pa.float64(), pa.string(), pa.list_(pa.int64()), pa.decimal128(20, 0), pa.float64()]
        for batch in batches:
            for k in map(int, batch["id"]):
                fs, base = opened(root)
                rows, picks = 7 * k + 3, [(k + i) % 8 for i in range(1, 2 + k % 6)]
                schema = pa.schema([(f"col_{i}", arrow[p]) for i, p in enumerate(picks, 1)])
                table = pa.Table.from_arrays([pa.nulls(rows, f.type) for f in schema], schema=schema)
                fs.create_dir(f"{base}/t{k}_delta/_delta_log")
                with fs.open_output_stream(f"{base}/t{k}_parquet") as out:
                    pq.write_table(table, out)
                with fs.open_output_stream(f"{base}/t{k}_other") as out:
                    out.write(b"neither of both")
                fields = [{"name": f"col_{i}", "type": DTYPE_CYCLE[p], "nullable": True, "metadata": {}} for i, p in enumerate(picks, 1)]
                add = lambda path, n, size: {"add": {"path": path, "size": size, "stats": json.dumps({"numRecords": n})}}
                commits = [[{"metaData": {"schemaString": json.dumps({"type": "struct", "fields": fields}), "partitionColumns": []}},
                            add("a", 3, 17), add("old", 5, 5)], [{"remove": {"path": "old"}}, add("b", 7 * k, 1000 * k)]]
                for v, actions in enumerate(commits):
                    with fs.open_output_stream(f"{base}/t{k}_delta/_delta_log/{v:020d}.json") as out:
                        out.write("\n".join(map(json.dumps, actions)).encode())
            yield pd.DataFrame({"id": batch["id"]})

    return run


def mounts(spark: SparkSession) -> str:
    """The folder of stored tables, in the shared folder; written once per application."""
    from .session import shared_dir

    key = (spark.sparkContext.applicationId, shared_dir(spark, ""))
    if key not in _mounted:
        root = shared_dir(spark, f"mounts-{uuid.uuid4().hex}")
        spark.range(0, MOUNTS, 1, MOUNTS).mapInPandas(_write_mounts(root), "id long").count()
        _mounted[key] = root
    return _mounted[key]


def located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``uri, path``: where in the stored tables each asset's and candidate's URI leads; some paths lead nowhere.

    Most asset URIs still exist; candidate URIs exist when their number is not a multiple of 3.
    """
    o = table(spark, sf_dir, "orders").selectExpr(
        "concat('gs://bucket-', CAST(o_orderkey % 10 AS STRING), '/t/', CAST(o_orderkey AS STRING)) AS uri", "o_orderkey AS n",
        "CASE WHEN o_orderkey % 17 = 0 THEN 'gone' WHEN o_orderkey % 3 = 0 THEN 'parquet' WHEN o_orderkey % 3 = 1 THEN 'delta' ELSE 'other' END AS kind")
    e = table(spark, sf_dir, "events").selectExpr(
        "concat('gs://bucket-', CAST(user_id % 10 AS STRING), '/c/', CAST(CAST(floor(value) AS BIGINT) AS STRING)) AS uri",
        "CAST(floor(value) AS BIGINT) AS n",
        "CASE WHEN CAST(floor(value) AS BIGINT) % 3 = 0 THEN 'gone' WHEN CAST(floor(value) AS BIGINT) % 2 = 0 THEN 'parquet' ELSE 'delta' END AS kind").distinct()
    path = F.concat(F.lit(mounts(spark) + "/t"), F.pmod("n", F.lit(MOUNTS)).cast("string"), F.lit("_"), "kind")
    return o.unionByName(e).select("uri", path.alias("path"))


def _inventory(spark: SparkSession) -> DataFrame:
    """What the readers find in the folder of stored tables, by path; read once per application, a row per stored table."""
    from .sources import extract

    root = mounts(spark)
    key = (root, "inventory")
    if key not in _mounted:
        kinds = F.explode(F.array(*map(F.lit, ("parquet", "delta", "other", "gone"))))
        path = F.concat(F.lit(root + "/t"), F.col("id").cast("string"), F.lit("_"), "kind")
        paths = spark.range(MOUNTS).withColumn("kind", kinds).select(path.alias("uri"), path.alias("path"))
        extract.inventory(paths).write.parquet(f"{root}-inventory")
        _mounted[key] = f"{root}-inventory"
    return spark.read.parquet(_mounted[key]).withColumnRenamed("uri", "path")


def storage_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The storage inventory ``uri, actual_format`` as the readers see it, for the checks of whole batches."""
    return located(spark, sf_dir).join(F.broadcast(_inventory(spark)), "path").select("uri", "actual_format")  # at most 3 * MOUNTS rows


def extracted_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata the readers find at each readable storage URI: ``(uri, n_rows, n_bytes, columns, partition_columns)``."""
    return located(spark, sf_dir).join(F.broadcast(_inventory(spark).where("actual_format <> 'other'")), "path").select(
        "uri", "n_rows", "n_bytes", "columns", "partition_columns")


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PATCH requests, up to four an id: per field a ``<field>_set`` flag (sent or not) and the value (NULL clears)."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS request_id", "user_id",
        "CAST(event_id DIV 4 * 4 AS STRING) AS id",
        "event_id % 3 = 0 AS maturity_set",
        "CASE WHEN event_id % 33 = 0 THEN NULL WHEN event_id % 21 = 0 THEN 'bogus' "
        "WHEN event_id % 3 = 0 THEN 'deprecated' ELSE 'draft' END AS maturity",
        "event_id % 4 = 0 AS access_group_set",
        "CASE WHEN event_id % 8 = 0 THEN NULL ELSE concat('grp', CAST(user_id % 5 AS STRING)) END AS access_group",
        "event_id % 5 = 0 AS expires_at_set",
        "CASE WHEN event_id % 10 = 0 THEN NULL WHEN event_id % 15 = 0 THEN TIMESTAMP '1990-01-01' "
        "ELSE ts + INTERVAL 60 DAYS END AS expires_at",
    )


def delete_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DELETE requests, one or two an id; some ids do not exist."""
    return table(spark, sf_dir, "events").where("event_id % 2 = 1").selectExpr(
        "event_id AS request_id", "user_id", "CAST(event_id DIV 4 * 5 AS STRING) AS id")


def annotation_updates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Annotation replacement requests (every 5th order) and their new lists (even part keys; may be empty)."""
    req = table(spark, sf_dir, "orders").where("o_orderkey % 5 = 0").selectExpr("CAST(o_orderkey AS STRING) AS id", "o_custkey AS user_id")
    new = annotations(spark, sf_dir).where("tie DIV 100003 % 2 = 0")
    return req, new.join(req.withColumnRenamed("id", "asset_id"), "asset_id", "left_semi")


def refresh_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_orderkey % 7 = 0").selectExpr("CAST(o_orderkey AS STRING) AS id", "o_custkey AS user_id")


def preview_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What readers report when a preview fails, one message per event: every kind of error, some with two reasons, some none."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS seq", "CASE WHEN event_id % 2 = 0 THEN 'parquet' ELSE 'delta' END AS format",
        "CASE event_id % 9 WHEN 0 THEN concat('No such file or directory: ', event_type, '/', CAST(user_id AS STRING)) "
        "WHEN 1 THEN concat('404 Not Found: object ', CAST(user_id AS STRING)) WHEN 2 THEN concat('bucket-', CAST(user_id % 10 AS STRING), ' does not exist') "
        "WHEN 3 THEN concat('PERMISSION denied for user ', CAST(user_id AS STRING)) WHEN 4 THEN '403 Forbidden' "
        "WHEN 5 THEN concat('no Access to ', event_type) WHEN 6 THEN concat('Invalid magic number in footer of ', event_type) "
        "WHEN 7 THEN 'access denied or key not found' END AS message")


def registration_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw registration-form text, one form per event (blank, padded and malformed values included)."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS seq",
        "CASE WHEN event_id % 50 = 0 THEN '  ' ELSE concat('ds', CAST(user_id % 5 AS STRING)) END AS datastack",
        "concat(' ', event_type, '_', CAST(user_id % 40 AS STRING), ' ') AS name",
        "CASE WHEN event_id % 47 = 0 THEN '' ELSE concat('gs://bucket-', CAST(user_id % 10 AS STRING), '/f/', CAST(event_id AS STRING)) END AS uri",
        "CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'parquet' WHEN 2 THEN ' delta ' ELSE 'precomputed' END AS format",
        "CASE event_id % 6 WHEN 0 THEN '' WHEN 1 THEN ' 903 ' WHEN 2 THEN 'abc' ELSE CAST(900 + user_id % 7 AS STRING) END AS mat_version",
        "CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'x1' ELSE CAST(event_id % 3 AS STRING) END AS revision",
        "CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'mutable' ELSE 'static' END AS mutability",
        "CASE event_id % 4 WHEN 0 THEN ' ' WHEN 1 THEN 'draft' ELSE 'stable' END AS maturity",
        "CASE event_id % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE '' END AS is_managed",
        "CASE WHEN event_id % 7 = 0 THEN concat(' grp', CAST(user_id % 5 AS STRING), ' ') ELSE '  ' END AS access_group",
        "CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'not json' WHEN 2 THEN '   ' ELSE props END AS properties",
        "CASE event_id % 6 WHEN 0 THEN ' 2030-01-02 03:04:05 ' WHEN 1 THEN 'soon' WHEN 2 THEN '' WHEN 3 THEN '2031-05-06' END AS expires_at",
    )
