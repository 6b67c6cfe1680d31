"""Repair of conversation structure: generalised LR parsing of the roles with weighted edits.

The order of roles follows a small grammar.  Its LR tables drive a graph-structured stack: after each turn there is one
node per distinct stack top, reached by deleting the turn, keeping it, giving it another role, or inserting turns; equal
tops merge into the one of least (cost, audit).  Audits of the same turns and the same cost are never prefixes of each
other (only inserts add letters, and each costs), so the least one stays least whatever follows, and stretches of a
conversation can be parsed apart: a stretch gives the best way from each entry top to each exit top, and the ways of a
conversation's stretches are joined in order.

Turns are sorted once over the whole table and numbered; blocks of numbered turns are parsed by themselves,
whatever conversations they hold, so one conversation with a third of all rows spreads over all tasks.  Only stretches
at the ends of blocks meet again by conversation, without their texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Turns that are parsed together, as a power of two.
BLOCK_BITS = 10
#: The grammar of the role initials, (s?(ua)+)?: left side and right side of each rule; the first is the start.
RULES = (("C", ""), ("C", "P"), ("C", "sP"), ("P", "ua"), ("P", "Pua"))
INSERTABLE = {"u": "user", "a": "assistant"}
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
FAULTS = ("blank", "duplicate", "truncated")
SPACE = " \t\n\v\f\r"


class Tables:
    """SLR tables of ``rules``: item sets closed over the rules, shifts and gotos, and reductions by what may follow."""

    def __init__(self, rules: tuple[tuple[str, str], ...] = RULES):
        self.rules = rules
        left = {a for a, _ in rules}
        follow = {a: set() for a in left} | {rules[0][0]: {"$"}}
        first = {a: set() for a in left}
        for _ in rules:  # as many rounds as rules reach every symbol
            for a, right in rules:
                if right:
                    first[a] |= first[right[0]] if right[0] in left else {right[0]}
                for x, y in zip(right, [*right[1:], None]):
                    if x in left:
                        follow[x] |= follow[a] if y is None else first[y] if y in left else {y}
        self.states = [self._closed({(k, 0) for k, (a, _) in enumerate(rules) if a == rules[0][0]})]
        self.goto: dict[tuple[int, str], int] = {}
        self.reduce: dict[tuple[int, str], int] = {}
        for s, items in enumerate(self.states):  # grows while it is walked
            for k, at in sorted(items):
                a, right = rules[k]
                if at == len(right):
                    self.reduce.update({(s, t): k for t in follow[a]})
                elif (s, right[at]) not in self.goto:
                    moved = self._closed({(j, n + 1) for j, n in items if rules[j][1][n : n + 1] == right[at]})
                    if moved not in self.states:
                        self.states.append(moved)
                    self.goto[s, right[at]] = self.states.index(moved)

    def _closed(self, items: set[tuple[int, int]]) -> frozenset:
        items, todo = set(items), list(items)
        while todo:
            k, at = todo.pop()
            for j, (a, _) in enumerate(self.rules):
                if self.rules[k][1][at : at + 1] == a and (j, 0) not in items:
                    items.add((j, 0))
                    todo.append((j, 0))
        return frozenset(items)

    def shift(self, stack: tuple, symbol: str) -> tuple | None:
        """The stack ``(state, rest)`` after the reductions that ``symbol`` asks for and its shift; at the end, "$" accepts."""
        while (stack[0], symbol) in self.reduce:
            a, right = self.rules[self.reduce[stack[0], symbol]]
            for _ in right:
                stack = stack[1]
            if a == self.rules[0][0]:
                return stack
            stack = (self.goto[stack[0], a], stack)
        to = self.goto.get((stack[0], symbol))
        return None if to is None else (to, stack)


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


@lru_cache(maxsize=1)
def entries() -> dict[int, tuple]:
    """A stack for each state that may be on top between turns: what follows depends on the top alone."""
    lr, found, todo = tables(), {}, [(0, None)]
    while todo:
        stack = todo.pop(0)
        if stack[0] not in found:
            found[stack[0]] = stack
            todo += [s for t in "sua" if (s := lr.shift(stack, t))]
    return found


Tops = dict[int, tuple[int, str, tuple]]


def _merge(tops: Tops, cost: int, audit: str, stack: tuple | None) -> bool:
    """Add a way to its stack top if it is better than the one there."""
    if stack is None or (stack[0] in tops and tops[stack[0]][:2] <= (cost, audit)):
        return False
    tops[stack[0]] = (cost, audit, stack)
    return True


def _with_inserts(tops: Tops) -> Tops:
    lr, out, todo = tables(), dict(tops), list(tops)
    while todo:
        cost, audit, stack = out[todo.pop()]
        for t in INSERTABLE:
            after = lr.shift(stack, t)
            if _merge(out, cost + INSERT, audit + "I", after):
                todo.append(after[0])
    return out


def _advance(tops: Tops, initial: str, fault: str) -> Tops:
    lr, out = tables(), {}
    extra = TRUNCATED if fault == "t" else 0
    for cost, audit, stack in _with_inserts(tops).values():
        _merge(out, cost + DELETE, audit + "D", stack)
        if fault in "bd":
            continue
        if initial in "sua":
            _merge(out, cost + extra, audit + "K", lr.shift(stack, initial))
        for t in INSERTABLE:
            _merge(out, cost + REROLE + extra, audit + "R", lr.shift(stack, t))
    return out


def parse(code: str, entry: int = 0) -> dict[int, tuple[int, str]]:
    """``top: (cost, audit)`` for every top the stretch can end with.

    ``code`` has two signs per turn: the initial (``?`` if it is none of the grammar) and the fault (``b``lank,
    ``d``uplicate, ``t``runcated or ``-``).
    """
    tops: Tops = {entry: (0, "", entries()[entry])}
    for initial, fault in zip(code[::2], code[1::2]):
        tops = _advance(tops, initial, fault)
    return {s: way[:2] for s, way in tops.items()}


def finish(ways: dict[int, tuple[int, str]]) -> tuple[int, str]:
    """The best of the ways whose top, after inserts, accepts the end."""
    lr = tables()
    all_ = _with_inserts({s: (cost, audit, entries()[s]) for s, (cost, audit) in ways.items()})
    return min(way[:2] for way in all_.values() if lr.shift(way[2], "$"))


@lru_cache(maxsize=100_000)
def best(code: str) -> tuple[int, str]:
    return finish(parse(code))


def apply(code: str, audit: str, entry: int) -> list[tuple[int, str]]:
    """``(turn, role)`` of the turns that stay, in order: role "" is kept, turn -1 is an inserted one before the next."""
    lr, stack, out, at = tables(), entries()[entry], [], 0
    for edit in audit:
        if edit != "D":
            t = code[2 * at] if edit == "K" else next(t for t in INSERTABLE if lr.shift(stack, t))
            stack = lr.shift(stack, t)
            out.append((-1 if edit == "I" else at, "" if edit == "K" else INSERTABLE[t]))
        at += edit != "I"
    return out


def _text_id(conv_id: Column) -> Column:
    """An id for Python workers, where numbers beside nulls would lose digits: as text, a null empty."""
    return F.coalesce(conv_id.cast("string"), F.lit(""))


def _id(conv: str = "conv") -> Column:
    return F.nullif(F.col(conv), F.lit("")).cast("long")


def turns(conversations: DataFrame) -> DataFrame:
    """``at, conv_id, turn, role, text, sig``: all rows in order of conversation, turn (nulls first), role and digest of the text.

    ``at`` numbers the rows in that order, with gaps between range partitions.  Null roles and texts are one blank.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), blank("role"), blank("text"))
    rows = rows.withColumn("sig", F.unhex(F.md5(F.concat_ws("\0", "role", "text"))))
    order = ["conv_id", "turn", "role", "sig"]
    return C.written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "turns")


def faults(rows: DataFrame) -> DataFrame:
    """``at, conv_id, turn, initial, fault`` of every row of ``turns``; the first fault counts.

    A duplicate has the role and text of an earlier row: the least number per (conversation, digest) is the first one.
    """
    first = rows.groupBy("conv_id", "sig").agg(F.min("at").alias("first"))
    first = first.select(F.col("conv_id").alias("c"), F.col("sig").alias("s"), "first")
    last = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    seen = rows.select("at", "conv_id", "turn", "sig", F.substring("role", 1, 1).alias("initial"), last.alias("last"))
    seen = seen.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("sig") == F.col("s")))
    fault = (F.when(F.col("last") == "", "b").when(F.col("at") > F.col("first"), "d").when(~F.col("last").isin(".", "!", "?"), "t").otherwise("-"))
    return C.written(seen.select("at", "conv_id", "turn", "initial", fault.alias("fault")), "faults")


STRETCH = "conv string, begin long, code string, illegal long, blank long, duplicate long, truncated long, edge boolean, head string, tail string"
LEGAL = {"su", "ua", "au"}


def _stretches(rows: pd.DataFrame) -> pd.DataFrame:
    """The stretches of conversations in a block; those at its ends may go on in the next one."""
    rows = rows.sort_values("at", kind="stable")
    out, ids = [], rows["conv"].tolist()
    begins = [k for k in range(len(ids)) if k == 0 or ids[k] != ids[k - 1]]
    at, initials, marks = rows["at"].tolist(), rows["initial"].tolist(), rows["fault"].tolist()
    for a, b in zip(begins, [*begins[1:], len(ids)]):
        code = "".join((i if i in ("s", "u", "a") else "?") + f for i, f in zip(initials[a:b], marks[a:b]))
        illegal = sum(x + y not in LEGAL for x, y in zip(initials[a : b - 1], initials[a + 1 : b]))
        count = [marks[a:b].count(f[0]) for f in FAULTS]
        out.append((ids[a], at[a], code, illegal, *count, a == 0 or b == len(ids), initials[a], initials[b - 1]))
    return pd.DataFrame(out, columns=[c.split()[0] for c in STRETCH.split(", ")])


ENDED = "conv string, begin long, code string, illegal long, blank long, duplicate long, truncated long, cost long, audit string, entry int"
ENDED_NAMES = [c.split()[0] for c in ENDED.split(", ")]


def _whole(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Conversations of one stretch."""
    for rows in batches:
        found = [best(c) for c in rows["code"]]
        yield rows.assign(cost=[c for c, _ in found], audit=[a for _, a in found], entry=0)[ENDED_NAMES]


def _join(rows: pd.DataFrame) -> pd.DataFrame:
    """Join the stretches of one conversation: the best way to each top, then back along the chosen one.

    The cost stands at the first stretch; the audits of all of them make the conversation's.
    """
    rows = rows.sort_values("begin", kind="stable").reset_index(drop=True)
    ways: dict[int, tuple[int, str, tuple | None]] = {0: (0, "", None)}  # top: cost, audit, (entry, piece, way before)
    for code in rows["code"]:
        after: dict[int, tuple] = {}
        for entry, (cost, audit, _) in ways.items():
            for top, (more, piece) in parse(code, entry).items():
                way = (cost + more, audit + piece)
                if top not in after or way < after[top][:2]:
                    after[top] = (*way, (entry, piece, ways[entry][2]))
        ways = after
    cost, audit = finish({top: way[:2] for top, way in ways.items()})
    # the chosen way is the one whose audit the whole audit continues; inserts may follow it
    top = next(t for t, (c, a, _) in ways.items() if audit.startswith(a) and set(audit[len(a) :]) <= {"I"} and c + INSERT * (len(audit) - len(a)) == cost)
    chain, link = [], ways[top][2]
    while link is not None:
        chain.append(link[:2])
        link = link[2]
    chain.reverse()
    rows["entry"], rows["audit"] = [e for e, _ in chain], [p for _, p in chain]
    rows.loc[len(rows) - 1, "audit"] += audit[len(ways[top][1]) :]
    rows["cost"] = [cost] + [0] * (len(rows) - 1)
    joints = zip(rows["tail"][:-1], rows["head"][1:])
    rows.loc[0, "illegal"] += sum(x + y not in LEGAL for x, y in joints)
    return rows[ENDED_NAMES]


def ended(marked: DataFrame) -> DataFrame:
    """The stretches of ``faults``, each with its part of the cheapest edits."""
    block = F.shiftright("at", BLOCK_BITS).alias("block")
    conv = _text_id(F.col("conv_id")).alias("conv")
    stretches = C.written(marked.select(block, "at", conv, "initial", "fault").groupBy("block").applyInPandas(_stretches, STRETCH), "stretches")
    whole = stretches.where("not edge").mapInPandas(_whole, ENDED)
    return C.written(whole.unionByName(stretches.where("edge").groupBy("conv").applyInPandas(_join, ENDED)), "ended-stretches")


def _placed(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What stays of each stretch, in order; ``at`` is -1 for inserted turns."""
    for rows in batches:
        out = []
        for conv, begin, code, audit, entry in zip(rows["conv"], rows["begin"], rows["code"], rows["audit"], rows["entry"]):
            out += [(conv, begin, n, -1 if k < 0 else begin + k, role) for n, (k, role) in enumerate(apply(code, audit, entry))]
        yield pd.DataFrame(out, columns=["conv", "begin", "nth", "at", "role"])


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(summary, repaired)`` of conversations with ``conv_id, turn, role, text``.

    ``summary`` has a row per conversation: ``gaps, blank, duplicate, truncated, illegal, cost, audit``; ``repaired`` its
    turns: ``conv_id, begin, nth, role, text`` in order of begin and nth.  Blank and repeated turns must go, truncated
    ones cost extra where they stay.  A null id is a conversation of its own, null roles and texts are one blank, a null
    turn comes first and counts for no gap; turns alike in number follow role, then digest of role and text.  Roles
    outside the grammar can only be deleted or replaced.  Other columns are not read; an empty table gives empty results.
    """
    rows = turns(conversations)
    marked = faults(rows)
    parts = ended(marked)
    numbers = marked.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n")).groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0).cast("long")).alias("gaps"))
    in_order = F.array_sort(F.collect_list(F.struct("begin", "audit")))
    sums = parts.groupBy("conv").agg(*(F.sum(c).cast("long").alias(c) for c in (*FAULTS, "illegal", "cost")),
                                        F.array_join(F.transform(in_order, lambda x: x["audit"]), "").alias("audit"))
    summary = numbers.join(sums, _text_id(F.col("conv_id")) == F.col("conv")).select("conv_id", "gaps", *FAULTS, "illegal", "cost", "audit")
    stay = parts.select("conv", "begin", "code", "audit", "entry").mapInPandas(_placed, "conv string, begin long, nth long, at long, role string")
    stay = stay.select(_id().alias("conv_id"), "begin", "nth", "at", "role")
    texts = rows.select(F.col("at").alias("a"), F.col("role").alias("own"), "text")
    kept = stay.where("at >= 0").join(texts, F.col("at") == F.col("a")).select(
        "conv_id", "begin", "nth", F.when(F.col("role") == "", F.col("own")).otherwise(F.col("role")).alias("role"), "text")
    return summary, kept.unionByName(stay.where("at < 0").select("conv_id", "begin", "nth", "role", F.lit("").alias("text")))


def digests(repaired: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256``: SHA-256 of the ``role:text`` lines of each conversation.

    One digest runs over one conversation in order, so its rows stream through one task; a batch at a time is held.
    """

    kind = "conv string, repaired_sha256 string"

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_, state = None, None
        for rows in batches:
            out = []
            for conv, role, text in zip(rows["conv"], rows["role"], rows["text"]):
                if conv == open_:
                    state.update(b"\n")
                else:
                    if state:
                        out.append((open_, state.hexdigest()))
                    open_, state = conv, hashlib.sha256()
                state.update(f"{role}:{text}".encode())
            yield pd.DataFrame(out, columns=["conv", "repaired_sha256"])
        if state:
            yield pd.DataFrame([(open_, state.hexdigest())], columns=["conv", "repaired_sha256"])

    rows = repaired.withColumn("conv", _text_id(F.col("conv_id"))).repartition("conv").sortWithinPartitions("conv", "begin", "nth")
    return rows.select("conv", "role", "text").mapInPandas(run, kind).select(_id().alias("conv_id"), "repaired_sha256")


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` as a crawl might leave them, by the CRC-32 of ``conv_id:turn``.

    Of 20 rows one is dropped (0), one loses its text (1), one its sentence ends (2), one comes twice (3) and one gets
    the role user (4).  Nulls are one blank, in the key too.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                text("role").alias("role"), text("text").alias("text"))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = rows.withColumn("kind", kind).where("kind <> 0")
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                       F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
                       F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def audit(conversations: DataFrame) -> DataFrame:
    """One row per conversation of the table: its damage, its repair, and the digest of what comes out."""
    summary, repaired = repair(damaged(conversations))
    ids = conversations.select(F.col("conv_id").cast("long").alias("id")).distinct()
    found = ids.join(summary, F.col("id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
    found = found.join(digests(repaired), F.col("id").eqNullSafe(F.col("conv_id")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return found.select(F.col("id").alias("conv_id"), *map(zero, ("gaps", *FAULTS, "illegal", "cost")),
                        F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
