"""Files behind data paths, listed and opened on executors: one row per file, so a folder spreads over all tasks.

Python only lists folders and opens files here; what the rows mean (schemas, totals, replay of a log) is decided by
aggregations over them.  Failures become values.
"""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S

#: Rows per yielded batch.
CHUNK = 10_000
LISTED = "uri string, file string, name string, length long, error string"


def opened(uri: str):
    """``(file system, path)`` of a URI or local path."""
    import pyarrow.fs as pafs

    if "://" in uri and not uri.startswith("file:"):
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), re.sub("^file:(//)?", "", uri)


def _files_below(fs, folder: str) -> Iterator:
    """Data files below a folder, one folder at a time; hidden names (``_``, ``.``) are left out."""
    import pyarrow.fs as pafs

    todo = [folder]
    while todo:
        for info in fs.get_file_info(pafs.FileSelector(todo.pop())):
            if not info.base_name.startswith(("_", ".")):
                if info.type == pafs.FileType.Directory:
                    todo.append(info.path)
                else:
                    yield info


def _data_files(uri: str) -> Iterator[tuple]:
    import pyarrow.fs as pafs

    fs, path = opened(uri)
    info = fs.get_file_info(path)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(f"No such file or directory: '{uri}'")
    if info.type == pafs.FileType.File:
        yield info.path, "", info.size
        return
    found = False
    for f in _files_below(fs, path.rstrip("/")):
        found = True
        yield f.path, f.path[len(path.rstrip("/")) + 1 :], f.size
    if not found:
        raise FileNotFoundError(f"No parquet files found under '{uri}'")


def _log_files(uri: str) -> Iterator[tuple]:
    import pyarrow.fs as pafs

    fs, path = opened(uri)
    log = path.rstrip("/") + "/_delta_log"
    if fs.get_file_info(log).type == pafs.FileType.Directory:
        for f in fs.get_file_info(pafs.FileSelector(log)):
            if f.type == pafs.FileType.File:
                yield f.path, f.base_name, f.size


def _listing(files_of):
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in LISTED.split(", ")]
        for batch in batches:
            rows = []
            for uri in batch["uri"]:
                try:
                    for file in files_of(uri):
                        rows.append((uri, *file, None))
                        if len(rows) >= CHUNK:
                            yield pd.DataFrame(rows, columns=names)
                            rows = []
                except Exception as exc:  # noqa: BLE001 - errors become values
                    rows.append((uri, None, None, None, str(exc)))
            yield pd.DataFrame(rows, columns=names).astype({"length": "Int64"})

    return run


def _tasks(df: DataFrame) -> int:
    """A stated number, so that adaptive execution does not merge rows that are few bytes but much work."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _distinct(uris: DataFrame) -> DataFrame:
    """The distinct paths, dealt over the tasks by the one shuffle that finds the equal ones."""
    return uris.select("uri").where("uri IS NOT NULL").repartition(_tasks(uris), "uri").dropDuplicates(["uri"])


def data_files(uris: DataFrame) -> DataFrame:
    """``uri, file, name, length, error`` of the data files of each distinct path (``uri``); ``name`` is relative to the path."""
    return _distinct(uris).mapInPandas(_listing(_data_files), LISTED)


def below(listing: DataFrame, path_pattern: str) -> DataFrame:
    """``uri, file, name, length, error`` from a listing (``storage.list_files``): each file belongs to the path that
    ``path_pattern`` matches at its beginning."""
    uri = F.regexp_extract("path", f"^{path_pattern}", 0)
    name = F.regexp_replace(F.substr("path", F.length("uri") + 1, F.length("path")), "^/", "")
    return listing.select("path", "length", uri.alias("uri")).where("uri <> ''").select(
        "uri", F.regexp_replace("path", "^file:(//)?", "").alias("file"), name.alias("name"), "length", F.lit(None).cast("string").alias("error"))


def log_files(uris: DataFrame) -> DataFrame:
    """``uri, file, name, length, error`` of the files in each distinct path's ``_delta_log``; none where there is no log."""
    return _distinct(uris).mapInPandas(_listing(_log_files), LISTED)


FOOTER = "uri string, name string, length long, n_rows long, columns array<struct<name:string,dtype:string>>, error string"


def _footers(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import pyarrow.parquet as pq

    for batch in batches:
        rows = []
        for uri, file, name, length, missing in zip(*(batch[c] for c in ("uri", "file", "name", "length", "error"))):
            if pd.notna(missing):
                rows.append((uri, None, None, None, None, missing))
                continue
            try:
                with opened(uri)[0].open_input_file(file) as handle:
                    meta = pq.ParquetFile(handle).metadata
                schema = meta.schema.to_arrow_schema()
                columns = [{"name": n, "dtype": str(t)} for n, t in zip(schema.names, schema.types)]
                rows.append((uri, name, length, meta.num_rows, columns, None))
            except Exception as exc:  # noqa: BLE001
                rows.append((uri, name, length, None, None, str(exc)))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in FOOTER.split(", ", 5)]).astype({"n_rows": "Int64", "length": "Int64"})


def footers(files: DataFrame) -> DataFrame:
    """``uri, name, length, n_rows, columns, error`` per listed Parquet file, of which only the footer is read; a path that
    could not be listed stays a row with its error and no name."""
    return files.repartition(_tasks(files), "file").mapInPandas(_footers, FOOTER)


ACTION_FIELDS = {"add": ("path", "size", "stats", "deletionVector"), "remove": ("path", "deletionVector"),
                 "metaData": ("schemaString", "partitionColumns")}


def _checkpoint_lines(handle) -> Iterator[str]:
    """The actions of a checkpoint file as the JSON lines a commit would hold, a batch of rows at a time."""
    import pyarrow.parquet as pq

    file = pq.ParquetFile(handle)
    wanted = [c for c in file.schema_arrow.names if c in ACTION_FIELDS]
    for batch in file.iter_batches(CHUNK, columns=wanted):
        for row in batch.to_pylist():
            for kind, action in row.items():
                if action is not None:
                    out = {k: action.get(k) for k in ACTION_FIELDS[kind]}
                    parsed = action.get("stats_parsed")
                    if kind == "add" and out["stats"] is None and parsed and parsed.get("numRecords") is not None:
                        out["stats"] = json.dumps({"numRecords": parsed["numRecords"]})
                    yield json.dumps({kind: out})


def _lines(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["uri", "version", "value", "error"]
    for batch in batches:
        for uri, file, version in zip(batch["uri"], batch["file"], batch["version"]):
            rows = []
            try:
                with opened(uri)[0].open_input_file(file) as handle:
                    lines = _checkpoint_lines(handle) if file.endswith(".parquet") else io.TextIOWrapper(handle, "utf-8")
                    for line in lines:
                        if line.strip():
                            rows.append((uri, version, line, None))
                        if len(rows) >= CHUNK:
                            yield pd.DataFrame(rows, columns=names)
                            rows = []
            except Exception as exc:  # noqa: BLE001
                rows.append((uri, version, None, str(exc)))
            yield pd.DataFrame(rows, columns=names)


def log_lines(files: DataFrame) -> DataFrame:
    """``uri, version, value, error``: every action of the given log files (``uri, file, version``) as a JSON line."""
    files = files.select("uri", "file", "version")
    return files.repartition(_tasks(files), "file").mapInPandas(_lines, "uri string, version long, value string, error string")


def partition_keys(name: str = "name") -> F.Column:
    """The ``key`` of each ``key=value`` folder of a relative file name, outermost first."""
    folders = F.slice(F.split(name, "/"), 1, F.size(F.split(name, "/")) - 1)
    return F.array_distinct(F.transform(F.filter(folders, lambda x: x.contains("=")), lambda x: F.split(x, "=")[0]))


def column_infos(columns: str) -> F.Column:
    return F.col(columns).cast(f"array<{S.COLUMN_INFO.simpleString()}>")


def _found(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import pyarrow.fs as pafs

    for batch in batches:
        rows = []
        for uri in batch["uri"]:
            try:
                fs, path = opened(uri)
                rows.append((uri, fs.get_file_info(path).type != pafs.FileType.NotFound, None))
            except Exception as exc:  # noqa: BLE001
                rows.append((uri, False, str(exc)))
        yield pd.DataFrame(rows, columns=["uri", "found", "error"])


def existence(uris: DataFrame) -> DataFrame:
    """``uri, found, error`` per row of ``uris``: whether there is a file or folder; ``error`` where that cannot be told."""
    return uris.select("uri").repartition(_tasks(uris), "uri").mapInPandas(_found, "uri string, found boolean, error string")
