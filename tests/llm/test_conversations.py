"""Conversation repair against exhaustive search, and its stretches against whole conversations."""

import functools
import hashlib
import itertools
import random
import re

import pytest

from assetdeck.llm import conversations

GRAMMAR = re.compile(r"(s?(ua)+)?")


@functools.cache
def brute(code):
    """The cheapest edits of a short code by trying all of them; at most two inserts in a row help."""
    found = None
    turns = [code[k : k + 2] for k in range(0, len(code), 2)]
    gaps = ["", "u", "a", "ua", "au"]
    edits = []
    for initial, fault in turns:
        extra = 3 * (fault == "t")
        edits.append([("", 4, "D")] + ([] if fault in "bd" else [(initial, extra, "K"), ("u", 3 + extra, "R"), ("a", 3 + extra, "R")]))
    for chosen in itertools.product(*edits):
        for put in itertools.product(gaps, repeat=len(turns) + 1):
            roles = put[0] + "".join(e[0] + g for e, g in zip(chosen, put[1:]))
            if GRAMMAR.fullmatch(roles):
                cost = sum(e[1] for e in chosen) + 3 * sum(map(len, put))
                audit = "I" * len(put[0]) + "".join(e[2] + "I" * len(g) for e, g in zip(chosen, put[1:]))
                found = min(found or (cost, audit), (cost, audit))
    return found


def test_cheapest_edits_equal_exhaustive_search():
    signs = [i + f for i in "sua?" for f in "-bt"]
    for n in range(3):
        for turns in itertools.product(signs, repeat=n):
            assert conversations.best("".join(turns)) == brute("".join(turns))
    rng = random.Random(5)
    for _ in range(60):
        code = "".join(rng.choice(signs + ["u-", "a-", "ud"]) for _ in range(4))
        assert conversations.best(code) == brute(code), code


def test_what_follows_depends_on_the_stack_top_alone():
    lr = conversations.tables()
    seen = {}
    for n in range(6):
        for word in itertools.product("sua", repeat=n):
            stack = (0, None)
            for t in word:
                stack = stack and lr.shift(stack, t)
            if stack is None:
                assert not re.match(r"(s?(ua)*u?)\Z", "".join(word))
                continue
            able = tuple(bool(lr.shift(stack, t)) for t in "sua$")
            assert able[3] == bool(GRAMMAR.fullmatch("".join(word)))
            assert seen.setdefault(stack[0], able) == able


def reference(rows):
    """One conversation's rows (turn, role, text) -> gaps, blank, duplicate, truncated, illegal, cost, audit, digest."""
    sig = lambda r: hashlib.md5(f"{r[1]}\0{r[2]}".encode()).digest()
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], sig(r)))
    seen, code, count = set(), "", dict.fromkeys("bdt-", 0)
    for turn, role, text in rows:
        solid = text.strip(" \t\n\v\f\r")
        fault = "b" if not solid else "d" if (role, text) in seen else "t" if solid[-1] not in ".!?" else "-"
        seen.add((role, text))
        count[fault] += 1
        code += (role[:1] if role[:1] in ("s", "u", "a") else "?") + fault
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    numbers = {r[0] for r in rows if r[0] is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    cost, audit = conversations.best(code)
    lines = [f"{role or rows[k][1]}:{rows[k][2] if k >= 0 else ''}" for k, role in conversations.apply(code, audit, 0)]
    return (gaps, count["b"], count["d"], count["t"], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


ROWS = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Hello!"), (1, 2, "assistant", "Hello!"), (1, None, "user", "first"),
        (None, 0, None, None), (None, 3, "user", "A?"), (2, 5, "tool", "out."), (2, None, "", "x."), (3, 1, "user", ""), (3, 9, "user", "\t\n"),
        ((1 << 60) + 1, 0, "user", "big id"), ((1 << 60) + 2, 0, "assistant", "bigger id. "), (4, -7, "user", "ends in a newline.\n")]
KIND = "conv_id long, turn long, role string, text string, at long, fault string, code string, begin long"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    more = [(100 + c, rng.choice([None, *range(6)]), rng.choice(["system", "user", "assistant", "assistant", "user", "?"]),
             rng.choice(["Yes.", "No.", "Well", "  ", "Go on!", f"t{rng.random()}."])) for c in range(60) for _ in range(rng.randrange(1, 9))]
    long_ = [(7, k // 2, ("user", "assistant", "system")[rng.randrange(3)], f"t{rng.randrange(400)}" + "." * (rng.random() < 0.8)) for k in range(500)]
    return ROWS + more + long_


@pytest.mark.parametrize("bits", [1, 3, 10])
def test_repair_equals_one_conversation_at_a_time(spark, rows, monkeypatch, bits):
    monkeypatch.setattr(conversations, "BLOCK_BITS", bits)
    table = spark.createDataFrame([(*r, 1, "f", "c", 2) for r in rows], KIND).repartition(4)
    summary, repaired = conversations.repair(table)
    hashes = {r.conv_id: r.repaired_sha256 for r in conversations.digests(repaired).collect()}
    none = hashlib.sha256(b"").hexdigest()
    got = {r.conv_id: (*r[1:], hashes.get(r.conv_id, none)) for r in summary.collect()}
    groups = {}
    for c, t, role, text in rows:
        groups.setdefault(c, []).append((t, " " if role is None else role, " " if text is None else text))
    assert got == {c: reference(g) for c, g in groups.items()}


def test_empty_table_and_lost_conversations(spark):
    assert conversations.audit(spark.createDataFrame([], KIND)).collect() == []
    import zlib

    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = conversations.audit(spark.createDataFrame([(gone, 0, "user", "Hi.", 1, "", "", 1)], KIND)).collect()
    assert [tuple(r) for r in got] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
