"""Name rules, each stated once and tried on every name up to three signs of a small alphabet, and on chosen ones."""

import itertools
import string

import pytest

from assetdeck.functions import names as N

LOWER, INNER = set(string.ascii_lowercase), set(string.ascii_lowercase + string.digits + "_")


def rule(name):
    """The code of the first rule a name breaks, None for a good one."""
    if not name:
        return "empty"
    parts = name.split(".")
    if len(parts) > 2:
        return "too_many"
    for part in parts:
        if not part:
            return "empty_segment"
        if part[0] not in LOWER or not set(part) <= INNER:
            return "bad_segment"
    return None


def judged(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "name string")
    return {r["name"]: (r["code"], r["msg"]) for r in
            df.select("name", N.name_error_code("name").alias("code"), N.name_error("name").alias("msg")).collect()}


def test_every_short_name(spark):
    names = ["".join(p) for n in range(4) for p in itertools.product("qZ7_.- ", repeat=n)]
    got = judged(spark, names)
    assert {n: code for n, (code, _) in got.items()} == {n: rule(n) for n in names}
    assert {msg is None for code, msg in got.values() if code is None} == {True}


@pytest.mark.parametrize("name", ["qué", "ñandu", "ß", "ḱ", "q\n", "q\r", "\tq", "q.\n", "ｑ", "q ", "q..q", "..", "q.7", "q._", "q7_.z9_"])
def test_letters_outside_ascii_and_white_space(spark, name):
    assert judged(spark, [name])[name][0] == rule(name)


def test_the_message_names_what_failed(spark):
    got = judged(spark, ["Q.", "q.Z7", "q.", None])
    assert got["Q."][1].startswith("Name segment 'Q' is invalid.")  # the first segment fails before the empty second one
    assert got["q.Z7"][1].startswith("Name segment 'Z7'")
    assert got["q."][1].startswith("Name 'q.' has an empty segment.")
    assert got[None] == ("empty", "Name must not be empty.")


def test_base_name_is_what_stands_before_the_dot(spark):
    df = spark.createDataFrame([(a + b,) for a in ("q", "long_name_7") for b in ("", ".z", ".")], "name string")
    assert [r[0] for r in df.select(N.base_name("name")).collect()] == ["q"] * 3 + ["long_name_7"] * 3
