"""Stored columns: discovered columns and annotations of a store's tables, bucketed alike (SNK-02, SNK-04, JON-06).

Two tables in the shared folder, both clustered and sorted by (asset, column name) into the same number of buckets, so
merging them needs no shuffle, and an asset with very many columns spreads over the buckets.  Registration appends to
both; a replacement writes the annotations anew under the next generation, and the old one stays readable until dropped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import annotations as AN
from ..session import shared_dir

KIND = "kind string, target_table string, target_column string, node_level string, resolution array<double>, axis string, point_group string, axis_resolution double"
COLUMNS = "asset_id string, name string, pos int, dtype string"
ANNOTATIONS = f"asset_id string, column_name string, pos int, tie bigint, description string, {KIND}"


class ColumnStore:
    """The stored columns below ``root``; ``name`` is how the session's tables are called."""

    def __init__(self, spark: SparkSession, name: str, root: str, buckets: int, generation: int = 0):
        self.spark, self.name, self.root, self.buckets, self.generation = spark, name, root.rstrip("/"), buckets, generation
        self._create("columns", COLUMNS, "name")
        self._create(f"annotations_{generation}", ANNOTATIONS, "column_name")

    @classmethod
    def fresh(cls, spark: SparkSession, buckets: int | None = None) -> ColumnStore:
        n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        key = uuid.uuid4().hex
        return cls(spark, f"stored_{key}", shared_dir(spark, f"stored-columns-{key}"), n)

    def _create(self, part: str, schema: str, column: str) -> None:
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name}_{part} ({schema}) USING parquet CLUSTERED BY (asset_id, {column}) "
                       f"SORTED BY (asset_id, {column}) INTO {self.buckets} BUCKETS LOCATION '{self.root}/{part}'")

    def _append(self, part: str, rows: DataFrame, schema: str, column: str) -> None:
        fields = [f.rsplit(" ", 1) for f in schema.split(", ")]
        (rows.select(*[F.col(n).cast(t).alias(n) for n, t in fields]).write.mode("append").format("parquet")
         .bucketBy(self.buckets, "asset_id", column).sortBy("asset_id", column).saveAsTable(f"{self.name}_{part}"))

    def add(self, assets: DataFrame, annotations: DataFrame) -> None:
        """Store the discovered columns of ``assets`` (with ``cached_metadata``) and their annotations in long form."""
        self._append("columns", AN.explode_columns(assets), COLUMNS, "name")
        self._append(f"annotations_{self.generation}", annotations, ANNOTATIONS, "column_name")

    def columns(self) -> DataFrame:
        return self.spark.table(f"{self.name}_columns")

    def annotations(self) -> DataFrame:
        return self.spark.table(f"{self.name}_annotations_{self.generation}")

    def merged(self) -> DataFrame:
        """JON-06 over everything stored, without a shuffle."""
        return AN.merge_columns(self.columns(), self.annotations())

    def replaced(self, annotations: DataFrame) -> ColumnStore:
        """The store with ``annotations`` (all of them, as ``changes.replace_annotations`` returns) as its next generation."""
        out = ColumnStore(self.spark, self.name, self.root, self.buckets, self.generation + 1)
        out._append(f"annotations_{out.generation}", annotations, ANNOTATIONS, "column_name")
        return out

    def drop_tables(self) -> None:
        """Take the names out of the session; the folders stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_columns")
        for g in range(self.generation + 1):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_annotations_{g}")
