"""Streaming registration intake (STR-01).

Registrations arrive as a stream of candidate rows.  Each micro-batch runs
the full registration pipeline (checks + admission rounds) against the
store as of the previous batch and appends its admitted rows as batch
``<batch_id>``; labels go to ``labels/batch=<batch_id>``.  Inside a batch the
order is the candidates' ``seq``; batches are processed in order, so the
outcome equals one sequential pass over the whole stream.  A replayed batch
(after a failure) finds its folder complete and is skipped: nothing is
admitted twice.  A batch folder without its success marker is not part of the
store, so a replay never meets its own rows; a batch that admits nothing
leaves a marked, empty folder.  Progress and replay bookkeeping live in the query's
checkpoint location in shared storage.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import registration as RG
from ..sources import store as ST


@dataclass
class IntakeContext:
    store_root: str
    mat: DataFrame
    storage: DataFrame
    permissions: DataFrame
    users: DataFrame
    now: str
    auth_enabled: bool = True
    #: With these two, candidates of type ``table`` are registered as tables; without, all as plain assets.
    annotations: DataFrame | None = None
    extracted: DataFrame | None = None


def process_batch(ctx: IntakeContext, batch: DataFrame, batch_id: int) -> None:
    spark = batch.sparkSession
    if ST.batch_done(spark, ctx.store_root, batch_id):
        return  # replay of a completed batch
    current = ST.read_store(spark, ctx.store_root)
    known = ctx.mat, ctx.storage, ctx.permissions, ctx.users, ctx.now
    if ctx.annotations is None:
        res = RG.register_assets(batch, current, *known, auth_enabled=ctx.auth_enabled, batch=batch_id)
    else:
        res = RG.register_all(batch, ctx.annotations, ctx.extracted, current, *known, auth_enabled=ctx.auth_enabled, batch=batch_id)
        res.annotations.write.mode("overwrite").parquet(f"{ctx.store_root.rstrip('/')}/annotations/batch={batch_id}")
    labels_path = f"{ctx.store_root.rstrip('/')}/labels/batch={batch_id}"
    res.labelled.select("seq", "admission_status", "existing_id", "new_id").write.mode("overwrite").parquet(labels_path)
    ST.append_batch(res.created, ctx.store_root, batch_id)


def start_intake(stream: DataFrame, ctx: IntakeContext, checkpoint_location: str, available_now: bool = True) -> StreamingQuery:
    """Run the intake over a streaming DataFrame of candidates."""
    w = stream.writeStream.foreachBatch(lambda df, bid: process_batch(ctx, df, bid)).option(
        "checkpointLocation", checkpoint_location)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def read_labels(spark: SparkSession, store_root: str) -> DataFrame:
    return spark.read.parquet(f"{store_root.rstrip('/')}/labels")


def read_annotations(spark: SparkSession, store_root: str) -> DataFrame:
    """Annotations of the tables that completed batches created, in long form."""
    rows = spark.read.parquet(f"{store_root.rstrip('/')}/annotations")
    done = [int(b.rsplit("=", 1)[1]) for b in ST.completed_batches(spark, f"{store_root.rstrip('/')}/appended")]
    return rows.where(F.col("batch").isin(done)).drop("batch")
