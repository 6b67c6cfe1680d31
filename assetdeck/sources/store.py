"""Asset storage: a base snapshot plus append-only batches (SRC-01 reader, sinks' writer).

Layout under a root folder (in the cluster's shared storage)::

    root/base/datastack=.../part-*.parquet        full snapshot
    root/appended/batch=<n>/datastack=.../...     rows admitted by batch n

Readers see ``base UNION ALL appended``.  Partitioning by ``datastack`` (the
listing's required filter) gives partition pruning.  A batch folder is
written once; a replayed batch finds it and skips, so stream replays never
admit twice.  Row changes (patch / delete / annotations) write a new base
folder instead of rewriting files they read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..session import shared_dir


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def write_base(df: DataFrame, root: str, name: str = "base") -> str:
    path = f"{root.rstrip('/')}/{name}"
    # overwrite only replaces an unfinished attempt (no _SUCCESS) of the same snapshot
    df.select(*S.ASSET_COLUMNS).write.mode("overwrite").partitionBy("datastack").parquet(path)
    return path


def batch_path(root: str, batch_id: int) -> str:
    return f"{root.rstrip('/')}/appended/batch={batch_id}"


def batch_done(spark: SparkSession, root: str, batch_id: int) -> bool:
    return exists(spark, batch_path(root, batch_id) + "/_SUCCESS")


def append_batch(df: DataFrame, root: str, batch_id: int) -> None:
    """Write the admitted rows of one batch; overwriting the same batch folder on a retry is idempotent."""
    df.select(*S.ASSET_COLUMNS).write.mode("overwrite").partitionBy("datastack").parquet(batch_path(root, batch_id))


def completed_batches(spark: SparkSession, appended: str) -> list[str]:
    """Batch folders with their success marker; an unfinished one belongs to a batch still to be replayed."""
    fs, p = _fs(spark, f"{appended}/batch=*/_SUCCESS")
    return sorted(s.getPath().getParent().toString() for s in (fs.globStatus(p) or []))


def read_store(spark: SparkSession, root: str, base: str = "base") -> DataFrame:
    """SRC-01: the current store (base plus every completed appended batch)."""
    b = spark.read.schema(S.ASSET).parquet(f"{root.rstrip('/')}/{base}").select(*S.ASSET_COLUMNS)
    app = f"{root.rstrip('/')}/appended"
    done = completed_batches(spark, app)
    if not done:
        return b
    # the fixed schema also reads batches that admitted nothing, whose folders hold only the marker
    a = spark.read.schema(S.ASSET).option("basePath", app).parquet(*done)
    return b.unionByName(a.select(*S.ASSET_COLUMNS))


def read_tables(spark: SparkSession, root: str) -> DataFrame:
    """SRC-02: the table subtype, stated explicitly."""
    return read_store(spark, root).where(F.col("asset_type") == "table")


def stored_assets(spark: SparkSession, sf_dir: str, tables: list[str], build: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """The rows of ``build(spark, sf_dir)`` as a partitioned base snapshot in the shared folder.

    Written once per application and state (modification times) of the source ``tables``."""
    states = []
    for t in tables:
        fs, p = _fs(spark, f"{sf_dir.rstrip('/')}/{t}.parquet")
        states.append(f"{t}@{fs.getFileStatus(p).getModificationTime()}")
    key = hashlib.sha1(":".join([spark.sparkContext.applicationId, sf_dir, *states]).encode()).hexdigest()[:16]
    root = shared_dir(spark, f"store-{key}")
    if not exists(spark, f"{root}/base/_SUCCESS"):
        write_base(build(spark, sf_dir), root)
    return read_store(spark, root)
