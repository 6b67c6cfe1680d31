"""Metadata extraction from real Parquet files and Delta logs written per test."""

import json
import os
import tempfile

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from assetdeck.sources import delta_log as DL
from assetdeck.sources import extract as EX
from assetdeck.sources import files as FS
from assetdeck.sources import storage as ST


@pytest.fixture(scope="module")
def files():
    root = tempfile.mkdtemp(prefix="assetdeck-extract-")
    pq.write_table(pa.table({"a": pa.array([1, 2, 3], pa.int64()), "b": ["x", "y", "z"]}), f"{root}/simple.parquet")
    pq.write_table(pa.table({"u8": pa.array([1], pa.uint8()), "u16": pa.array([1], pa.uint16()),
                             "u32": pa.array([1], pa.uint32()), "u64": pa.array([1], pa.uint64())}), f"{root}/unsigned.parquet")
    with open(f"{root}/corrupt.parquet", "wb") as fh:
        fh.write(b"this is not parquet")
    os.makedirs(f"{root}/part/part=x")
    os.makedirs(f"{root}/part/part=y")
    pq.write_table(pa.table({"val": pa.array([1, 2], pa.int64())}), f"{root}/part/part=x/f0.parquet")
    pq.write_table(pa.table({"val": pa.array([3], pa.int64())}), f"{root}/part/part=y/f1.parquet")
    # a Delta table: three adds, one remove, one add without stats
    d = f"{root}/delta_tbl"
    os.makedirs(f"{d}/_delta_log")
    schema = {"type": "struct", "fields": [{"name": "a", "type": "long", "nullable": True, "metadata": {}},
                                           {"name": "b", "type": "string", "nullable": True, "metadata": {}}]}
    c0 = [{"protocol": {"minReaderVersion": 1}},
          {"metaData": {"id": "x", "schemaString": json.dumps(schema), "partitionColumns": [], "format": {"provider": "parquet"}}},
          {"add": {"path": "f1.parquet", "size": 100, "stats": json.dumps({"numRecords": 3})}},
          {"add": {"path": "f2.parquet", "size": 200, "stats": json.dumps({"numRecords": 4})}}]
    c1 = [{"add": {"path": "f3.parquet", "size": 50, "stats": json.dumps({"numRecords": 5})}},
          {"remove": {"path": "f1.parquet"}}]
    for i, c in enumerate([c0, c1]):
        with open(f"{d}/_delta_log/{i:020d}.json", "w") as fh:
            fh.write("\n".join(json.dumps(x) for x in c) + "\n")
    d2 = f"{root}/delta_nostats"
    os.makedirs(f"{d2}/_delta_log")
    c = c0[:2] + [{"add": {"path": "g.parquet", "size": 10}}]
    with open(f"{d2}/_delta_log/{0:020d}.json", "w") as fh:
        fh.write("\n".join(json.dumps(x) for x in c) + "\n")
    os.makedirs(f"{root}/empty_dir")
    return root


def _profile(spark, rows):
    df = spark.createDataFrame(rows, "uri string, format string")
    return {r["uri"]: r for r in EX.profile_paths(df).collect()}


def test_parquet_profile(spark, files):
    got = _profile(spark, [(f"{files}/simple.parquet", "parquet"), (f"{files}/unsigned.parquet", "Parquet"),
                           (f"{files}/corrupt.parquet", "parquet"), (f"{files}/missing.parquet", "parquet"),
                           (f"{files}/part", "parquet"), (f"{files}/simple.parquet", "csv")])
    s = got[f"{files}/simple.parquet"]
    assert s["status"] == "unsupported_format" and "Supported: delta, parquet" in s["error"]
    u = got[f"{files}/unsigned.parquet"]
    assert [c["dtype"] for c in u["columns"]] == ["uint8", "uint16", "uint32", "uint64"]
    assert got[f"{files}/corrupt.parquet"]["status"] == "error"
    assert "No such file" in got[f"{files}/missing.parquet"]["error"]
    p = got[f"{files}/part"]
    assert (p["n_rows"], p["partition_columns"]) == (3, ["part"])


def test_parquet_counts_and_size(spark, files):
    got = _profile(spark, [(f"{files}/simple.parquet", "parquet")])[f"{files}/simple.parquet"]
    assert (got["status"], got["n_rows"], got["n_columns"]) == ("ok", 3, 2)
    assert got["n_bytes"] == os.path.getsize(f"{files}/simple.parquet")
    assert [(c["name"], c["dtype"]) for c in got["columns"]] == [("a", "int64"), ("b", "string")]


def test_delta_profile(spark, files):
    got = _profile(spark, [(f"{files}/delta_tbl", "delta"), (f"{files}/delta_nostats", "delta"),
                           (f"{files}/simple.parquet", "delta"), (f"{files}/empty_dir", "DELTA")])
    t = got[f"{files}/delta_tbl"]
    assert (t["status"], t["n_rows"], t["n_bytes"], t["n_columns"]) == ("ok", 9, 250, 2)
    n = got[f"{files}/delta_nostats"]
    assert (n["n_rows"], n["n_bytes"]) == (None, 10)
    assert "No Delta transaction log found" in got[f"{files}/simple.parquet"]["error"]
    assert got[f"{files}/empty_dir"]["status"] == "error"


def _metadata(spark, *uris):
    return {r["uri"]: r for r in DL.table_metadata(spark.createDataFrame([(u,) for u in uris], "uri string")).collect()}


def test_delta_log_as_dataframes(spark, files):
    wanted, _ = DL.segments(FS.log_files(spark.createDataFrame([(f"{files}/delta_tbl",), (f"{files}/delta_nostats",)], "uri string")))
    acts = DL.read_actions(wanted)
    live = sorted((r["path"], r["size"]) for r in DL.live_files(acts).where(F.col("table").endswith("delta_tbl")).collect())
    assert live == [("f2.parquet", 200), ("f3.parquet", 50)]
    md = _metadata(spark, f"{files}/delta_tbl", f"{files}/delta_nostats", f"{files}/empty_dir", None)
    assert len(md) == 3
    assert (md[f"{files}/delta_tbl"]["n_rows"], md[f"{files}/delta_tbl"]["n_bytes"]) == (9, 250)
    assert md[f"{files}/delta_nostats"]["n_rows"] is None
    assert md[f"{files}/empty_dir"]["error"].startswith("No Delta transaction log found")


def test_all_or_nothing_sum(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", None)], "g string, v int")
    got = {r["g"]: r["s"] for r in df.groupBy("g").agg(DL.all_or_nothing_sum("v").alias("s")).collect()}
    assert got == {"a": 3, "b": None}
    empty = spark.createDataFrame([], "v int").agg(DL.all_or_nothing_sum("v")).first()[0]
    assert empty == 0


def test_sniff(spark, files):
    df = spark.createDataFrame([(f"{files}/simple.parquet", "parquet"), (f"{files}/corrupt.parquet", "parquet"),
                                (f"{files}/simple.parquet", None), (f"{files}/simple.parquet", "precomputed")],
                               "uri string, format string")
    got = {(os.path.basename(r["uri"]), r["format"]): r for r in EX.sniff(EX.profile_paths(df)).collect()}
    assert {k for k, r in got.items() if not r["sniff_passed"]} == {("corrupt.parquet", "parquet")} and len(got) == 4
    assert got["corrupt.parquet", "parquet"]["sniff_message"].startswith("Parquet sniff failed")
    assert {r["sniff_message"] for r in got.values() if r["format"] is None} == {"No format specified; skipping sniff"}


def test_uri_exists_against_listing(spark, files):
    listing = ST.list_files(spark, files, recursive=True)
    uris = spark.createDataFrame([(f"{files}/simple.parquet",), (f"{files}/part",), (f"{files}/nope",), (f"file:{files}/part/",)],
                                 "uri string")
    got = {r["uri"]: r["reachable_passed"] for r in ST.uri_exists(uris, listing).collect()}
    assert got == {f"{files}/simple.parquet": True, f"{files}/part": True, f"{files}/nope": False, f"file:{files}/part/": True}


def test_delta_checkpoint_then_commits(spark, files):
    """A Parquet checkpoint named by _last_checkpoint, older commits gone, newer commits applied on top."""
    d = f"{files}/delta_ckpt"
    os.makedirs(f"{d}/_delta_log")
    schema = {"type": "struct", "fields": [{"name": "id", "type": "long", "nullable": True, "metadata": {}}]}
    add_t = pa.struct([("path", pa.string()), ("size", pa.int64()), ("stats", pa.string())])
    rem_t = pa.struct([("path", pa.string())])
    md_t = pa.struct([("schemaString", pa.string()), ("partitionColumns", pa.list_(pa.string()))])
    rows = [
        {"add": None, "remove": None, "metaData": {"schemaString": json.dumps(schema), "partitionColumns": ["day"]}},
        {"add": {"path": "a.parquet", "size": 10, "stats": json.dumps({"numRecords": 1})}, "remove": None, "metaData": None},
        {"add": {"path": "b.parquet", "size": 20, "stats": json.dumps({"numRecords": 2})}, "remove": None, "metaData": None},
    ]
    pq.write_table(pa.Table.from_pylist(rows, pa.schema([("add", add_t), ("remove", rem_t), ("metaData", md_t)])),
                   f"{d}/_delta_log/{3:020d}.checkpoint.parquet")
    with open(f"{d}/_delta_log/_last_checkpoint", "w") as fh:
        fh.write(json.dumps({"version": 3, "size": 3}))
    with open(f"{d}/_delta_log/{4:020d}.json", "w") as fh:
        fh.write(json.dumps({"remove": {"path": "a.parquet"}}) + "\n")
        fh.write(json.dumps({"add": {"path": "c.parquet", "size": 30, "stats": json.dumps({"numRecords": 3})}}) + "\n")
    got = _profile(spark, [(d, "delta")])[d]
    assert (got["status"], got["n_rows"], got["n_bytes"], got["partition_columns"]) == ("ok", 5, 50, ["day"])


def test_delta_checkpoint_as_dataframes(spark, files):
    test_delta_checkpoint_then_commits(spark, files) if not os.path.exists(f"{files}/delta_ckpt") else None
    md = _metadata(spark, f"{files}/delta_ckpt", f"{files}/delta_tbl")
    assert (md[f"{files}/delta_ckpt"]["n_rows"], md[f"{files}/delta_ckpt"]["n_bytes"]) == (5, 50)
    assert md[f"{files}/delta_ckpt"]["partition_columns"] == ["day"]
    assert (md[f"{files}/delta_tbl"]["n_rows"], md[f"{files}/delta_tbl"]["n_bytes"]) == (9, 250)


def _log(root, name, files):
    """A table folder with the given log files: lines of a commit, or rows of a checkpoint (``.parquet``)."""
    os.makedirs(f"{root}/{name}/_delta_log")
    for file, actions in files.items():
        path = f"{root}/{name}/_delta_log/{file}"
        if not file.endswith(".parquet"):
            with open(path, "w") as fh:
                fh.write("\n".join(a if isinstance(a, str) else json.dumps(a) for a in actions))
            continue
        stats = pa.struct([("numRecords", pa.int64())])
        kinds = {"add": pa.struct([("path", pa.string()), ("size", pa.int64()), ("stats", pa.string()), ("stats_parsed", stats),
                                   ("partitionValues", pa.map_(pa.string(), pa.string()))]),
                 "remove": pa.struct([("path", pa.string())]), "protocol": pa.struct([("minReaderVersion", pa.int32())]),
                 "metaData": pa.struct([("schemaString", pa.string()), ("partitionColumns", pa.list_(pa.string()))])}
        rows = [{k: a.get(k) for k in kinds} for a in actions]
        pq.write_table(pa.Table.from_pylist(rows, pa.schema(list(kinds.items()))), path)
    return f"{root}/{name}"


SCHEMA = {"metaData": {"schemaString": json.dumps({"type": "struct", "fields": [
    {"name": "id", "type": "long"}, {"name": "tags", "type": {"type": "array", "elementType": "string", "containsNull": True}}]}),
    "partitionColumns": ["day", "hour"]}}


def _add(path, rows=None, size=1, **more):
    return {"add": {"path": path, "size": size} | ({"stats": json.dumps({"numRecords": rows})} if rows is not None else {}) | more}


def test_delta_log_segments(spark):
    root = tempfile.mkdtemp(prefix="assetdeck-logs-")
    n = lambda k, end=".json": f"{k:020d}{end}"
    unfinished = {n(5, ".checkpoint.0000000001.0000000002.parquet"): [SCHEMA]}
    parts = {n(2, f".checkpoint.{k:010d}.0000000002.parquet"): [[SCHEMA, _add("a", 1)], [{"add": {"path": "b", "size": 7, "stats_parsed": {"numRecords": 4}}}]][k - 1] for k in (1, 2)}
    uris = {
        "parts": _log(root, "parts", parts | unfinished | {n(k): [_add(f"c{k}", 10)] for k in (3, 4)} | {n(2): ["not read"], "_last_checkpoint": ["{}"]}),
        "gap": _log(root, "gap", {n(0): [SCHEMA], n(2): [_add("x", 1)]}),
        "headless": _log(root, "headless", {n(4): [SCHEMA]}),
        "sidecars": _log(root, "sidecars", {n(9, ".checkpoint.80a083e8-7026-4e79-81be-64bd76c43a11.json"): ["{}"], n(10): [_add("x", 1)]}),
        "broken": _log(root, "broken", {n(0): [SCHEMA, "{ no json"]}),
        "bare": _log(root, "bare", {n(0): [_add("x", 1)]}),
        "emptied": _log(root, "emptied", {n(0): [SCHEMA, _add("x", 1)], n(1): [{"remove": {"path": "x"}}]}),
        "bad_checkpoint": _log(root, "bad_checkpoint", {n(1): [SCHEMA]}),
        "blank lines": _log(root, "blank lines", {n(0): [SCHEMA, "", _add("x", 5), ""]}),
        "nothing": f"{root}/nothing",
    }
    with open(f"{uris['bad_checkpoint']}/_delta_log/{n(0, '.checkpoint.parquet')}", "w") as fh:
        fh.write("not parquet")
    md = _metadata(spark, *uris.values())
    got = {k: md[u] for k, u in uris.items()}
    assert (got["parts"]["n_rows"], got["parts"]["n_bytes"], got["parts"]["partition_columns"]) == (25, 10, ["day", "hour"])
    assert [c["name"] for c in got["parts"]["columns"]] == ["id", "tags"] and json.loads(got["parts"]["columns"][1]["dtype"])["type"] == "array"
    assert (got["emptied"]["n_rows"], got["emptied"]["n_bytes"], got["emptied"]["error"]) == (0, 0, None)
    assert got["blank lines"]["n_rows"] == 5
    for name, word in {"gap": "lacks commits after version -1", "headless": "lacks commits", "sidecars": "sidecar", "broken": "unreadable action in version 0",
                       "bare": "no metadata action", "bad_checkpoint": "Delta log at", "nothing": "No Delta transaction log"}.items():
        assert word in got[name]["error"] and got[name]["n_rows"] is None and got[name]["columns"] is None, name


def test_folder_is_read_file_by_file(spark):
    root = tempfile.mkdtemp(prefix="assetdeck-folder-")
    for k in range(120):
        os.makedirs(f"{root}/t/year={k % 3}/month={k % 4}", exist_ok=True)
        pq.write_table(pa.table({"v": pa.array(range(k), pa.int32())}), f"{root}/t/year={k % 3}/month={k % 4}/f{k:03d}.parquet")
    os.makedirs(f"{root}/t/_temporary")
    with open(f"{root}/t/_temporary/x.parquet", "w") as fh:
        fh.write("hidden")
    uris = spark.createDataFrame([(f"{root}/t",)], "uri string")
    tasks = FS.footers(FS.data_files(uris)).select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks == int(spark.conf.get("spark.sql.shuffle.partitions"))
    row = EX.parquet_metadata(uris).first()
    assert (row["n_rows"], row["n_columns"], row["partition_columns"], row["error"]) == (sum(range(120)), 1, ["year", "month"], None)
    with open(f"{root}/t/year=2/month=3/zz.parquet", "w") as fh:
        fh.write("broken")
    row = EX.parquet_metadata(uris).first()  # its schema is known, one count is not
    assert (row["n_rows"], row["error"], [tuple(c)[:2] for c in row["columns"]]) == (None, None, [("v", "int32")])
    with open(f"{root}/t/year=0/month=0/a.parquet", "w") as fh:
        fh.write("broken first")
    row = EX.parquet_metadata(uris).first()
    assert row["error"] and row["columns"] is None and row["n_bytes"] is None


def test_equal_and_empty_requests(spark, files):
    rows = [(f"{files}/simple.parquet", "parquet")] * 3 + [(None, "parquet"), (None, "delta"), (None, None), (f"{files}/simple.parquet", "PARQUET")]
    got = EX.profile_paths(spark.createDataFrame(rows, "uri string, format string")).collect()
    assert len(got) == 7 and [r["status"] for r in got].count("ok") == 4
    assert {r["error"] for r in got if r["uri"] is None and r["format"]} == {"Metadata extraction failed: no path given"}
    assert EX.profile_paths(spark.createDataFrame([], "uri string, format string")).count() == 0


def test_new_deletion_vector_of_a_file(spark, files):
    """One commit adds a file under its new deletion vector and removes it under the old one: it stays live, once."""
    d = f"{files}/delta_dv"
    os.makedirs(f"{d}/_delta_log")
    schema = {"type": "struct", "fields": [{"name": "id", "type": "long", "nullable": True, "metadata": {}}]}
    file = {"path": "f.parquet", "size": 70, "stats": json.dumps({"numRecords": 7})}
    first, second = ({"storageType": "u", "pathOrInlineDv": x, "offset": 1} for x in ("ab", "cd"))
    commits = [[{"metaData": {"schemaString": json.dumps(schema), "partitionColumns": []}}, {"add": file}],
               [{"add": file | {"deletionVector": first}}, {"remove": {"path": "f.parquet"}}],
               [{"add": file | {"deletionVector": second}}, {"remove": {"path": "f.parquet", "deletionVector": first}}]]
    for i, c in enumerate(commits):
        with open(f"{d}/_delta_log/{i:020d}.json", "w") as fh:
            fh.write("\n".join(json.dumps(x) for x in c) + "\n")
    got = _profile(spark, [(d, "delta")])[d]
    assert (got["n_rows"], got["n_bytes"]) == (7, 70)
    md = _metadata(spark, d)[d]
    assert (md["n_rows"], md["n_bytes"]) == (7, 70)


def test_inventory_reads_what_is_there(spark, files):
    """Formats by their readers, missing paths without a row, storage that cannot be reached with its error."""
    from assetdeck.operators import checks as CK

    paths = {"gs://b/a": f"{files}/simple.parquet", "gs://b/again": f"{files}/simple.parquet", "gs://b/d": f"{files}/delta_tbl", "gs://b/c": f"{files}/corrupt.parquet",
             "gs://b/dir": f"{files}/empty_dir", "gs://b/gone": f"{files}/no_such", "gs://b/far": "nosuchscheme://bucket/x"}
    located = spark.createDataFrame(list(paths.items()), "uri string, path string")
    seen = EX.inventory(located)
    got = {r["uri"]: (r["actual_format"], r["n_rows"]) for r in seen.collect()}
    assert got == {"gs://b/a": ("parquet", 3), "gs://b/again": ("parquet", 3), "gs://b/d": ("delta", 9), "gs://b/c": ("other", None),
                   "gs://b/dir": ("other", None), "gs://b/far": (None, None)}
    cands = spark.createDataFrame([(u, "Parquet") for u in paths], "uri string, format string")
    out = {r["uri"]: r for r in CK.format_sniff(CK.uri_reachable(cands, seen)).collect()}
    assert out["gs://b/far"]["reachable_message"].startswith("URI unreachable: ") and not out["gs://b/far"]["reachable_passed"]
    assert out["gs://b/gone"]["reachable_message"] == "URI does not exist: gs://b/gone"
    assert {u for u, r in out.items() if r["sniff_passed"]} == {"gs://b/a", "gs://b/again"}
    assert out["gs://b/d"]["sniff_message"] == "Parquet sniff failed: not a parquet table"


def test_stored_tables_are_read_back(spark):
    """The tables behind the generated URIs, by the rule the oracles state; sizes of Parquet files are those on disk."""
    from assetdeck import fixtures as FX

    root = FX.mounts(spark)
    plain = root.removeprefix("file:")
    got = {r["path"].rsplit("/", 1)[1]: r for r in FX._inventory(spark).collect()}
    assert len(got) == 3 * FX.MOUNTS
    for k in range(FX.MOUNTS):
        d, p = got[f"t{k}_delta"], got[f"t{k}_parquet"]
        picks = [(k + i) % 8 for i in range(1, 2 + k % 6)]
        assert (d["actual_format"], p["actual_format"], got[f"t{k}_other"]["actual_format"]) == ("delta", "parquet", "other")
        assert (d["n_rows"], d["n_bytes"], p["n_rows"]) == (7 * k + 3, 1000 * k + 17, 7 * k + 3)
        assert p["n_bytes"] == os.path.getsize(f"{plain}/t{k}_parquet")
        assert [c["dtype"] for c in d["columns"]] == [FX.DTYPE_CYCLE[x] for x in picks]
        assert [c["dtype"] for c in p["columns"]] == [FX.PARQUET_DTYPES[x] for x in picks]
