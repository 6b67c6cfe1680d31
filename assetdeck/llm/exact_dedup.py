"""Exact deduplication against a persistent digest index.

The index is a table of SHA-256 digests, bucketed and sorted by digest.  New data is first reduced to one row per
digest (with partial aggregation, so a text with any number of copies moves as one row per task); a sort-merge
anti-join against the index, which reads the index without a shuffle, leaves the digests not yet known, and these
are appended.  Bytes are compared as they are: no normalisation.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SCHEMA = "digest binary, keep_id bigint, group_size bigint"


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, digest)`` per row; a null text has the digest of the empty text."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.unhex(F.sha2(C.text_or_empty(text_col).cast("binary"), 256)).alias("digest"))


class DigestIndex:
    """A bucketed, sorted table of known digests in the shared folder.

    ``add`` may be called again and again: digests that are known stay with the document first admitted, and only
    unknown ones are appended.  Within one call the largest ``doc_id`` of equal texts stays.  The folder outlives the
    session: opened again under any table name, it holds what was added before, in the buckets it was made with.
    """

    def __init__(self, spark: SparkSession, table: str, path: str, buckets: int):
        self.spark, self.table, self.path = spark, table, path
        self.buckets = self._made_with(buckets)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({SCHEMA}) USING parquet "
                  f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'")

    @classmethod
    def fresh(cls, spark: SparkSession, buckets: int | None = None) -> DigestIndex:
        """An empty index in a new folder; as many buckets as shuffle partitions."""
        n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        return cls(spark, f"digest_index_{uuid.uuid4().hex}", C.scratch_path(spark, "digest-index"), n)

    def _made_with(self, buckets: int) -> int:
        """The number of buckets of the folder, which its files were dealt by; noted beside it when it is new."""
        note = f"{self.path}-buckets"
        try:
            return self.spark.read.schema("buckets int").parquet(note).first().buckets
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
        self.spark.range(1).selectExpr(f"{buckets} AS buckets").write.parquet(note)
        return buckets

    def rows(self) -> DataFrame:
        """The index as a bucketed table: joins on the digest need no shuffle of it."""
        return self.spark.table(self.table)

    def files(self) -> DataFrame:
        """The same rows without bucketing, for joins whose other side has hot digests."""
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def add(self, batch: DataFrame) -> DataFrame:
        """Admit the unknown digests of ``batch`` (``doc_id``, ``digest``) and return them; ``group_size`` counts its rows."""
        new = batch.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        known = self.rows().select(F.col("digest").alias("known"))
        # the second condition keeps the join above the aggregation: copies meet as one row per task first
        unknown = new.hint("merge").join(known.hint("merge"), (F.col("digest") == F.col("known")) & (F.col("group_size") > 0),
                                         "left_anti")
        admitted = C.written(unknown.select("digest", "keep_id", "group_size"), "admitted-digests")
        (admitted.write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.table))
        return admitted

    def drop_table(self) -> None:
        """Take the name out of the session; the folder stays."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def label(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    The rows come in two batches, the upper half of the ids first, so that texts known from one are found by the join
    in the next.  Null texts equal the empty text.  Among equal texts the row with the largest ``doc_id`` stays; null
    ids rank lowest, and rows that repeat both id and text all carry the verdict of that document.  With an index that
    was used before, a known text stays with its earlier document.  ``group_size`` counts the equal texts of ``docs``.
    Other columns are not read.  An empty table gives an empty result.  Hot digests are split by adaptive execution, as
    both sides of the last joins are plain shuffles.
    """
    index = index or DigestIndex.fresh(docs.sparkSession)
    rows = C.written(digests(docs), "digests")
    middle = rows.agg(F.percentile_approx("doc_id", F.lit(0.5))).first()[0]
    upper = F.coalesce(F.col("doc_id") >= F.lit(middle), F.lit(False))
    index.add(rows.where(upper))
    index.add(rows.where(~upper))
    sizes = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    known = index.files().select("digest", "keep_id").join(sizes, "digest")
    return rows.join(known, "digest").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicate(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, all columns: exactly one per distinct text that the index did not know.

    Null texts equal the empty text; among equal texts the largest ``doc_id`` stays, a null one only where there is no
    other, and of rows that repeat it one.  An empty table gives an empty result.
    """
    index = index or DigestIndex.fresh(docs.sparkSession)
    admitted = index.add(digests(docs))
    rows = C.packed(docs, keep_id=F.col("doc_id").cast("long"),
                    digest=F.unhex(F.sha2(C.text_or_empty().cast("binary"), 256)))
    found = admitted.select(F.col("digest").alias("known"), F.col("keep_id").alias("winner"), "group_size")
    stay = rows.join(found, (F.col("digest") == F.col("known")) & F.col("keep_id").eqNullSafe(F.col("winner")))
    single = stay.where("group_size = 1").select("row.*")
    # only texts with copies can repeat a winning id
    return single.unionByName(stay.where("group_size > 1").dropDuplicates(["digest"]).select("row.*"))
