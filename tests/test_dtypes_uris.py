"""dtype classes and URI parsing."""

from urllib.parse import urlparse

import pytest

from assetdeck.functions import dtypes as DT
from assetdeck.functions import uris as U


@pytest.mark.parametrize("dtype,cls", [
    ("int64", "integer"), ("Int64", "integer"), ("uint64", "integer"), ("UInt8", "integer"), ("decimal(20,0)", "integer"),
    ("bigint", "integer"), ("long", "integer"), ("integer", "integer"), ("float64", "float"), ("double", "float"),
    ("Float32", "float"), ("string", "other"), ("list[int64]", "other"), ("bool", "other"),
])
def test_dtype_class(spark, dtype, cls):
    df = spark.createDataFrame([(dtype,)], "d string")
    assert df.select(DT.dtype_class("d")).first()[0] == cls


def py_gcs(uri):
    import re
    p = urlparse(uri)
    if p.scheme != "gs" or not p.netloc:
        return None, None, "uri"
    if not re.fullmatch(r"[a-z0-9][a-z0-9._-]{1,61}[a-z0-9]", p.netloc):
        return p.netloc, None, "bucket"
    prefix = p.path.lstrip("/")
    if prefix and not re.fullmatch(r"[a-zA-Z0-9/_\-.=+]*", prefix):
        return p.netloc, prefix, "prefix"
    return p.netloc, prefix, None


URIS = ["gs://bucket/prefix/", "GS://bucket/x", "gs://bucket/p?x=1#f", "gs://b/x", "s3://bucket/x", "gs:///x",
        "gs://bucket//a/b", "gs://Bucket/x", "gs://bucket/sp ace", "gs://bucket", "https://example.com/a", "plainpath"]


def test_gcs_parse_matches_urlparse(spark):
    df = spark.createDataFrame([(u,) for u in URIS], "u string")
    rows = df.select("u", U.gcs_bucket("u").alias("b"), U.gcs_prefix("u").alias("p"), U.gcs_uri_error("u").alias("e"),
                     U.uri_scheme("u").alias("s")).collect()
    for r in rows:
        b, p, kind = py_gcs(r["u"])
        assert r["s"] == urlparse(r["u"]).scheme, r
        if kind is None:
            assert r["e"] is None and (r["b"], r["p"]) == (b, p), r
        elif kind == "uri":
            assert r["e"].startswith("Invalid GCS URI"), r
        elif kind == "bucket":
            assert r["e"].startswith("Invalid GCS bucket name"), r
        else:
            assert r["e"].startswith("Invalid GCS prefix"), r


def test_prefix_condition_is_plain_prefix(spark):
    df = spark.createDataFrame([("b1", "a/b")], "b string, p string")
    assert df.select(U.prefix_condition("b", "p")).first()[0] == \
        "resource.name.startsWith('projects/_/buckets/b1/objects/a/b')"
