"""Display formatters against expected texts."""

import datetime as dt

from pyspark.sql import functions as F

from assetdeck.functions import formatting as FM


BYTES = {
    None: "—", 0: "0 B", 1: "1 B", 512: "512 B", 1023: "1023 B", 1024: "1.0 KB", 1280: "1.2 KB", 2304: "2.2 KB", 5000: "4.9 KB",
    1048575: "1024.0 KB", 1048576: "1.0 MB", 1073741824: "1.0 GB", 1099511627775: "1024.0 GB", 5497558138880: "5.0 TB",
    3377699720527872: "3.0 PB", 2305843009213693952: "2.0 EB", -5: "-5 B",
}
DECIMAL = {
    1: "1 Byte", 2: "2 Bytes", 999: "999 Bytes", 1000: "1.0 kB", 1500: "1.5 kB", 999999: "1000.0 kB", 1000000: "1.0 MB",
    1234567890: "1.2 GB", 1000000000000000: "1.0 PB",
}


def test_format_bytes(spark):
    df = spark.createDataFrame([(b,) for b in BYTES], "b long")
    assert {r["b"]: r["t"] for r in df.select("b", FM.format_bytes("b").alias("t")).collect()} == BYTES


def test_format_bytes_decimal(spark):
    df = spark.createDataFrame([(v,) for v in DECIMAL], "b long")
    assert {r["b"]: r["t"] for r in df.select("b", FM.format_bytes_decimal("b").alias("t")).collect()} == DECIMAL


def test_format_bytes_preview(spark):
    df = spark.createDataFrame([(100,), (2048,), (3 * 1048576,), (5 * 1073741824,)], "b long")
    got = [r[0] for r in df.select(FM.format_bytes_preview("b")).orderBy("b").collect()]
    assert got == ["100 B", "2.0 KB", "3.0 MB", "5.0 GB"]


def test_format_number(spark):
    df = spark.createDataFrame([(337412891, 1234.56)], "i long, f double")
    r = df.select(FM.format_number("i").alias("a"), FM.format_number("f", integral=False).alias("b"),
                  FM.format_number("i", grouping=False).alias("c")).first()
    assert (r["a"], r["b"], r["c"]) == ("337,412,891", "1,234.6", "337412891")


def test_format_datetime_and_missing(spark):
    ts = dt.datetime(2026, 4, 15, 10, 30, 0, 123456)
    df = spark.createDataFrame([(ts,), (None,)], "t timestamp")
    got = [r[0] for r in df.select(FM.format_datetime("t")).collect()]
    assert sorted(got) == sorted(["2026-04-15 10:30:00", "—"])


def test_text_and_bool(spark):
    df = spark.createDataFrame([("delta", True), (None, False)], "f string, m boolean")
    got = df.select(FM.format_text("f").alias("f"), FM.format_text("m", is_bool=True).alias("m")).collect()
    assert [(r["f"], r["m"]) for r in got] == [("delta", "True"), ("—", "False")]


def test_triage_error(spark):
    msgs = ["No such file or directory", "Path NOT FOUND", "object does not exist", "403 Forbidden",
            "Permission denied", "Access denied", "corrupt footer", "access not found"]
    df = spark.createDataFrame([(m,) for m in msgs], "m string")
    got = {r["m"]: r["t"] for r in df.select("m", FM.triage_error("m").alias("t")).collect()}
    assert got["No such file or directory"] == "missing"
    assert got["Path NOT FOUND"] == "missing"
    assert got["403 Forbidden"] == "denied"
    assert got["corrupt footer"] == "unreadable"
    assert got["access not found"] == "missing"   # 'missing' words are checked first
    df2 = df.select(FM.triage_message("m", F.lit("parquet")).alias("x"))
    assert any(x[0].startswith("Failed to read parquet data: ") for x in df2.collect())
