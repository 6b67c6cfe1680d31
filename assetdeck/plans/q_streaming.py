"""Registered query: streaming registration intake (STR-01)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import fixtures as FX
from ..session import shared_dir
from ..sources import store as ST
from ..streaming import intake as IN
from .q_admission import REGISTER_ALL_SQL
from .registry import query

#: Micro-batches the events arrive in.
ARRIVALS = 3

_BATCH = f"(SELECT CAST(n AS BIGINT) * {ARRIVALS} // (SELECT max(event_id) + 1 FROM events))"


def _numbered(column: str) -> str:
    """Ids of created assets with the number of the batch that created them."""
    seq = f"TRY_CAST(substr({column}, 5) AS BIGINT)"
    return f"CASE WHEN {column} LIKE 'new-%' THEN 'new-' || {_BATCH.replace('CAST(n AS BIGINT)', seq)} || '-' || {seq} ELSE {column} END AS {column}"


@query("registration_intake", f"SELECT seq, admission_status, {_numbered('existing_id')}, {_numbered('new_id')} FROM ({REGISTER_ALL_SQL})")
def registration_intake(spark, d):
    """Events arriving in three micro-batches, assets and tables registered together; returns the labels of all."""
    root = shared_dir(spark, f"intake-{uuid.uuid4().hex}")
    ST.write_base(FX.assets_to_store(spark, d), root)
    events = FX.table(spark, d, "events")
    ends = events.agg(F.max("event_id") + 1).scalar()
    ctx = IN.IntakeContext(root, FX.mat_objects(spark, d), FX.storage_objects(spark, d), FX.permissions(spark, d), FX.users(spark, d),
                           FX.DEFAULT_NOW, annotations=FX.annotations(spark, d), extracted=FX.extracted_metadata(spark, d))
    for k in range(ARRIVALS):
        events.where(F.floor(F.col("event_id") * ARRIVALS / ends) == k).write.mode("append").parquet(f"{root}/arrivals")
        stream = spark.readStream.schema(events.schema).parquet(f"{root}/arrivals")
        IN.start_intake(FX.candidates_from(stream), ctx, root + "/_stream_checkpoint").awaitTermination()
    return IN.read_labels(spark, root).select("seq", "admission_status", "existing_id", "new_id")
