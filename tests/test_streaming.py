"""Streaming intake equals one sequential pass; replays admit nothing twice."""

import os
import re
import tempfile
import time

from pyspark.sql import functions as F

from assetdeck import fixtures as FX
from assetdeck.operators import registration as RG
from assetdeck.schema import CANDIDATE
from assetdeck.sources import store as ST
from assetdeck.streaming import intake as IN
from conftest import SMALL


def test_stream_matches_batch_and_is_idempotent(spark):
    root = tempfile.mkdtemp(prefix="assetdeck-intake-")
    src = f"{root}/incoming"
    cands = FX.candidates(spark, SMALL)
    bounds = [(0, 150), (150, 400), (400, 10 ** 12)]
    for i, (lo, hi) in enumerate(bounds):
        path = f"{src}/batch-{i}.parquet"
        cands.where((F.col("seq") >= lo) & (F.col("seq") < hi)).coalesce(1).write.parquet(path)
        ts = time.time() + i * 10
        for dirpath, _, fnames in os.walk(path):
            for f in fnames:
                os.utime(os.path.join(dirpath, f), (ts, ts))
    store = f"{root}/store"
    assets = FX.assets(spark, SMALL)
    ST.write_base(assets, store)
    ctx = IN.IntakeContext(store, FX.mat_objects(spark, SMALL), FX.storage_objects(spark, SMALL),
                           FX.permissions(spark, SMALL), FX.users(spark, SMALL), FX.DEFAULT_NOW)
    stream = spark.readStream.schema(CANDIDATE).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true") \
        .option("pathGlobFilter", "*.parquet").parquet(src)
    q = IN.start_intake(stream, ctx, f"{root}/chk")
    q.awaitTermination()
    rows = IN.read_labels(spark, store).collect()
    assert all(r["new_id"] == f"new-{r['batch']}-{r['seq']}" for r in rows if r["admission_status"] == "created")
    labels = {r["seq"]: (r["admission_status"], r["existing_id"] and re.sub(r"^new-\d+-", "new-", r["existing_id"])) for r in rows}
    once = RG.register_assets(cands, assets, ctx.mat, ctx.storage, ctx.permissions, ctx.users, FX.DEFAULT_NOW)
    want = {r["seq"]: (r["admission_status"], r["existing_id"]) for r in once.labelled.collect()}
    assert labels == want
    n_before = ST.read_store(spark, store).count()
    assert n_before == assets.count() + sum(1 for s, _ in want.values() if s == "created")
    # replaying a completed batch is a no-op
    IN.process_batch(ctx, cands.where("seq < 150"), 0)
    assert ST.read_store(spark, store).count() == n_before
    # restarting the query over the same checkpoint finds nothing new
    q2 = IN.start_intake(stream, ctx, f"{root}/chk")
    q2.awaitTermination()
    assert ST.read_store(spark, store).count() == n_before


def test_replay_without_marker_and_empty_batches(spark):
    root = tempfile.mkdtemp(prefix="assetdeck-replay-") + "/store"
    assets = FX.assets(spark, SMALL)
    ST.write_base(assets, root)
    ctx = IN.IntakeContext(root, FX.mat_objects(spark, SMALL), FX.storage_objects(spark, SMALL),
                           FX.permissions(spark, SMALL), FX.users(spark, SMALL), FX.DEFAULT_NOW)
    cands = FX.candidates(spark, SMALL)
    IN.process_batch(ctx, cands.where(F.col("name").isNull()), 0)  # admits nothing
    assert ST.batch_done(spark, root, 0) and ST.read_store(spark, root).count() == assets.count()
    IN.process_batch(ctx, cands.where("seq < 300"), 1)

    def labels():
        rows = IN.read_labels(spark, root).where("batch = 1").select("seq", "admission_status", "existing_id", "new_id")
        return sorted(map(tuple, rows.collect()), key=str)

    want, stored = labels(), ST.read_store(spark, root).count()
    assert stored > assets.count()
    os.remove(ST.batch_path(root, 1) + "/_SUCCESS")  # a crash between the files and the marker
    assert ST.read_store(spark, root).count() == assets.count()
    IN.process_batch(ctx, cands.where("seq < 300"), 1)
    assert labels() == want and ST.read_store(spark, root).count() == stored
