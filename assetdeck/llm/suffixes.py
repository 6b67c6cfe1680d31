"""Suffix-array deduplication: bytes covered by a string of ``LENGTH`` bytes that also starts elsewhere.

Which strings can repeat is found first, with sums that spread over the cluster.  In every window of ``LENGTH`` bytes
one anchor is chosen by the window's content alone (the smallest hash of a few bytes among its first ``REACH``
positions), so equal windows have their anchor at the same place.  Anchors with equal bytes behind them share a key.
Anchors with equal surroundings settle all their windows at once; what differs somewhere within reach goes, as
contexts of at most ``2 * REACH`` bytes around a symbol for the key, into suffix arrays: neighbours in suffix order
that share a whole window are repeats.

The suffix arrays are built by linear grouping: suffixes with the same Lyndon prefix form a group; groups are taken in
descending order, pointers to the previous smaller suffix (the nearest not yet taken) refine the groups below, and in
a second pass each group's order is emitted along the same pointers, without renaming or recursion.

Keys with many contexts are halved by the distance of window and anchor, which adds the bytes all windows of a half
share to the key, until a key is small or names a single window; equal contexts merge before each step.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

LENGTH = 400
REACH = 256
GRAM = 8
#: Bytes behind an anchor that lie in each of its windows.
CORE = LENGTH - REACH + 1
#: Contexts of one key that go into one suffix array; keys with more are halved first.
KEY_LIMIT = 256
#: Symbols of a suffix array, and contexts of a task.
BLOCK = 150_000
TASK = 1_500
#: Window starts worked on at once in a long text.
SEGMENT = 1 << 20

ANCHOR = "sig binary, pos long, lo int, hi int, key long, x long"
CONTEXT = ANCHOR + ", c_lo int, c_hi int, before binary, after binary, done boolean"
SPAN = "sig binary, s long, e long"


def suffix_array(text: list[int]) -> list[int]:
    """Suffix array of integers; the last must be smaller than all others."""
    n = len(text)
    symbols = sorted(set(text))
    rank = {c: k for k, c in enumerate(symbols)}
    group = [rank[c] for c in text]
    members: list[list[int]] = [[] for _ in symbols]
    for i, g in enumerate(group):
        members[g].append(i)
    up, down = [*range(1, len(symbols)), -1], [-1, *range(len(symbols) - 1)]
    left = list(range(-1, n - 1))  # left[i]: for a taken i, where to look for the previous smaller suffix
    taken, previous = bytearray(n), [-1] * n
    g, lowest = len(symbols) - 1, 0
    while g >= 0:
        here = [i for i in members[g] if group[i] == g]
        for i in here:
            taken[i] = 1
        count: dict[int, int] = {}
        for i in here:
            j = left[i]
            while j >= 0 and taken[j]:
                j = left[j]
            k = i
            while k != j and left[k] != j:  # shorten the path for those who come after
                left[k], k = j, left[k]
            previous[i] = j
            if j >= 0:
                count[j] = count.get(j, 0) + 1
        moves: dict[tuple[int, int], list[int]] = {}
        for j, times in count.items():
            moves.setdefault((times, group[j]), []).append(j)
        for times, h in sorted(moves, reverse=True) if len(moves) > 1 else moves:
            new, above = len(members), up[h]
            part = moves[times, h]
            members.append(part)
            up.append(above)
            down.append(h)
            up[h] = new
            if above >= 0:
                down[above] = new
            for j in part:
                group[j] = new
        g = down[g]
    start, at, g = [0] * len(members), 0, lowest
    size = [0] * len(members)
    for x in group:
        size[x] += 1
    while g >= 0:
        start[g] = at
        at += size[g]
        g = up[g]
    order, placed = [0] * n, bytearray(n)
    order[0] = n - 1
    placed[n - 1] = 1
    start[group[n - 1]] += 1
    for i in range(n):
        j = order[i] - 1
        while j >= 0 and not placed[j]:
            placed[j] = 1
            x = group[j]
            order[start[x]] = j
            start[x] += 1
            j = previous[j]
    return order


def anchors(data: bytes) -> Iterator[tuple[int, int, int]]:
    """``(anchor, nearest, farthest)``: runs of window starts, by their distance before the anchor they choose."""
    for first in range(0, len(data) - LENGTH + 1, SEGMENT):
        part = data[first : first + SEGMENT + LENGTH - 1]
        m = len(part) - LENGTH + 1
        n = m + REACH - 1  # positions an anchor of these windows can have
        h = np.ndarray((n,), "<u8", part, strides=(1,)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h &= np.uint64(0xFFFFFFFF00000000)
        h |= np.arange(0xFFFFFFFF, 0xFFFFFFFF - n, -1, dtype=np.uint64)  # of equal hashes the last position wins
        rows = np.concatenate([h, np.full(-n % REACH, np.uint64(0xFFFFFFFFFFFFFFFF))]).reshape(-1, REACH)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        best = np.minimum(behind[:m], ahead[REACH - 1 : REACH - 1 + m])
        change = np.flatnonzero(best[1:] != best[:-1]) + 1
        starts, ends = np.concatenate([[0], change]), np.concatenate([change, [m]])
        at = np.int64(0xFFFFFFFF) - (best[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        yield from zip((at + first).tolist(), (at - ends + 1).tolist(), (at - starts).tolist())


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def surroundings(before: bytes, after: bytes, lo: int, hi: int) -> int:
    return signed(xxhash.xxh3_64_intdigest(b"%d:%d:%d:" % (lo, hi, len(before)) + before + after))


def _anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for sig, data in zip(batch["sig"], batch["data"]):
            for b, lo, hi in anchors(data):
                key = signed(xxhash.xxh3_64_intdigest(data[b : b + CORE]))
                rows.append((sig, b, lo, hi, key, surroundings(data[b - hi : b], data[b + CORE : b + LENGTH - lo], lo, hi)))
            if len(rows) > 100_000:
                yield pd.DataFrame(rows, columns=["sig", "pos", "lo", "hi", "key", "x"])
                rows = []
        yield pd.DataFrame(rows, columns=["sig", "pos", "lo", "hi", "key", "x"])


def _contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(sig, w["pos"], w["lo"], w["hi"], w["key"], w["x"], 0, REACH - 1, data[w["pos"] - w["hi"] : w["pos"]],
                 data[w["pos"] + CORE : w["pos"] + LENGTH - w["lo"]], w["done"])
                for sig, data, wanted in zip(batch["sig"], batch["data"], batch["wanted"]) for w in wanted]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in CONTEXT.split(", ")])


def _halves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each context once per half of its key's distances, with the bytes that half's windows share in the new key."""
    for batch in batches:
        rows = []
        for r in batch.itertuples(index=False):
            middle = (r.c_lo + r.c_hi) // 2
            for c_lo, c_hi in {(r.c_lo, middle), (min(middle + 1, r.c_hi), r.c_hi)}:
                lo, hi = max(c_lo, r.lo), min(c_hi, r.hi)
                if lo <= hi:
                    before, after = r.before[len(r.before) - hi :], r.after[: REACH - 1 - lo]
                    shared = before[len(before) - c_lo :] + b"|" + after[: REACH - 1 - c_hi]
                    key = signed(xxhash.xxh3_64_intdigest(b"%d:%d:%d:" % (r.key, c_lo, c_hi) + shared))
                    rows.append((r.sig, r.pos, lo, hi, key, surroundings(before, after, lo, hi), c_lo, c_hi, before, after, r.done))
        yield pd.DataFrame(rows, columns=list(batch.columns))


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def longest_shared(strings: list[bytes]) -> list[int]:
    """For each string, the longest prefix it shares with another: that of a neighbour in sorted order."""
    order = sorted(range(len(strings)), key=strings.__getitem__)
    best = [0] * len(strings)
    for i, j in zip(order, order[1:]):
        n = common_prefix(strings[i], strings[j])
        best[i] = max(best[i], n)
        best[j] = max(best[j], n)
    return best


def repeated_windows(keys: list, before: list[bytes], after: list[bytes], lo: list[int], hi: list[int]) -> list[np.ndarray]:
    """For each context, which of its windows (distances ``lo`` to ``hi``) another context with the same key also has.

    Only distances whose bytes on either side some other context of the key shares can repeat, so contexts are cut to
    these; and bytes that lie in all their windows and are the same in all contexts of a key become part of the symbol
    for the key.  The rest goes into one suffix array.
    """
    by_key: dict = {}
    for i, k in enumerate(keys):
        by_key.setdefault(k, []).append(i)
    found = [np.zeros(b - a + 1, bool) for a, b in zip(lo, hi)]
    text: list[int] = []
    cores: list[tuple[int, ...]] = []  # context, symbol, first and last distance from it, symbols of a window, bytes before in the symbol
    for number, at in enumerate(by_key.values()):
        backwards = [before[i][::-1] for i in at]
        shared_left, shared_right = longest_shared(backwards), longest_shared([after[i] for i in at])
        cut = [(i, max(lo[i], REACH - 1 - r), min(hi[i], n), back) for i, n, r, back in zip(at, shared_left, shared_right, backwards)]
        cut = [x for x in cut if x[1] <= x[2]]
        if len(cut) < 2:
            continue
        first, last = cut[0][0], cut[0][3]
        near, far = min(x[1] for x in cut), max(x[2] for x in cut)
        near = min([near, *(common_prefix(last, x[3]) for x in cut[1:])])  # bytes before the anchor in the symbol
        behind = min([REACH - 1 - far, *(common_prefix(after[first], after[x[0]]) for x in cut[1:])])
        for i, a, b, back in cut:
            text.append(1)
            text.extend([c + 2 for c in before[i][len(back) - b : len(back) - near]])
            cores.append((i, len(text), a - near, b - near, REACH - near - behind, near))
            text.append(300 + number)
            text.extend([c + 2 for c in after[i][behind : REACH - 1 - a]])
    if not cores:
        return found
    text.append(0)
    order = np.array(suffix_array(text), np.int64)
    symbols = np.array(text + [0] * REACH, np.int32)
    length = np.zeros(len(text), np.int64)  # of the window that begins here
    for _, c, a, b, m, _ in cores:
        length[c - b : c - a + 1] = m
    order = order[length[order] > 0]
    twice = np.zeros(len(text), bool)
    reach = np.arange(REACH)
    for i in range(0, len(order) - 1, 4096):
        a, b = order[i : i + 4097][:-1], order[i + 1 : i + 4097]
        same = ((symbols[a[:, None] + reach] == symbols[b[:, None] + reach]) | (reach >= length[a][:, None])).all(axis=1)
        twice[a[same]] = True
        twice[b[same]] = True
    for i, c, a, b, m, near in cores:
        found[i][a + near - lo[i] : b + near - lo[i] + 1] = twice[c - b : c - a + 1][::-1]
    return found


def _sorted_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Suffix arrays over consecutive keys of a sorted partition; a key is never cut."""
    kept: list[tuple] = []
    size = 0

    def settle() -> pd.DataFrame:
        spans = []
        found = repeated_windows([r.key for r in kept], [r.before for r in kept], [r.after for r in kept],
                                 [r.lo for r in kept], [r.hi for r in kept])
        for r, hit in zip(kept, found):
            if not r.done and hit.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
                spans += [(r.sig, r.pos - r.lo - b + 1, r.pos - r.lo - a + LENGTH) for a, b in edge.reshape(-1, 2).tolist()]
        return pd.DataFrame(spans, columns=["sig", "s", "e"])

    for batch in batches:
        for r in batch.itertuples(index=False):
            if size >= BLOCK and r.key != kept[-1].key:
                yield settle()
                kept, size = [], 0
            kept.append(r)
            size += len(r.before) + len(r.after) + 2
    if kept:
        yield settle()


def _spans(rows: DataFrame) -> DataFrame:
    return rows.select("sig", (F.col("pos") - F.col("hi")).alias("s"), (F.col("pos") - F.col("lo") + LENGTH).alias("e"))


def _resolve(contexts: DataFrame) -> list[DataFrame]:
    """Spans of the repeated windows of ``contexts``, which are distinct in (key, x)."""
    spans = []
    while True:
        sizes = C.written(contexts.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "key-sizes")
        small = contexts.join(sizes.where(f"m <= {KEY_LIMIT}").select("key"), "key", "left_semi")
        n = int(sizes.where(f"m <= {KEY_LIMIT}").agg(F.sum("m")).first()[0] or 0)
        if n:
            dealt = small.select(*contexts.columns).repartition(max(1, -(-n // TASK)), "key").sortWithinPartitions("key")
            spans.append(C.written(dealt.mapInPandas(_sorted_blocks, SPAN), "suffix-spans"))
        large = sizes.where(f"m > {KEY_LIMIT}").select("key")
        if large.isEmpty():
            return spans
        halves = C.written(contexts.join(large, "key", "left_semi").select(*contexts.columns).mapInPandas(_halves, CONTEXT), "halves")
        times = C.written(halves.groupBy("key", "x").agg(F.count(F.lit(1)).alias("n")), "half-counts")
        counted = C.written(halves.join(times, ["key", "x"]), "counted-halves")
        spans.append(_spans(counted.where("n > 1 AND NOT done")))
        contexts = C.written(counted.withColumn("done", F.col("done") | (F.col("n") > 1)).dropDuplicates(["key", "x"])
                             .select(*contexts.columns), "contexts")


def _texts(docs: DataFrame) -> DataFrame:
    data = C.text_or_empty().cast("binary")
    return docs.select(data.alias("data")).select(F.unhex(F.md5("data")).alias("sig"), "data")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``(sig, s, e)``: byte spans, by MD5 of the text, that are unions of repeated windows; spans may overlap."""
    texts = _texts(docs)
    found = C.written(texts.where(F.length("data") >= LENGTH).mapInPandas(_anchors, ANCHOR), "anchors")
    keys = C.written(found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "repeated-keys")
    found = C.written(found.join(keys, "key", "left_semi").select("sig", "pos", "lo", "hi", "key", "x"), "repeated-anchors")
    times = C.written(found.groupBy("key", "x").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("sig", "pos", "lo", "hi")).alias("one")),
                      "surroundings")
    settled = _spans(found.join(times.where("n > 1").select("key", "x"), ["key", "x"], "left_semi"))
    several = C.written(times.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("key"), "split-keys")
    wanted = (times.join(several, "key", "left_semi")
              .select("one.sig", F.struct("one.pos", "one.lo", "one.hi", "key", "x", (F.col("n") > 1).alias("done")).alias("w"))
              .groupBy("sig").agg(F.collect_list("w").alias("wanted")))  # at most the anchors of one text
    wanted = C.written(wanted, "wanted-contexts")
    contexts = texts.join(wanted, "sig").mapInPandas(_contexts, CONTEXT)
    contexts = C.written(contexts.dropDuplicates(["key", "x"]), "contexts")  # texts with copies came several times
    spans = settled
    for more in _resolve(contexts):
        spans = spans.unionByName(more)
    return spans


def removed(docs: DataFrame) -> DataFrame:
    """``(sig, spans)``: per text the disjoint, sorted spans to remove, as ``array<struct<s, e>>``."""
    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for spans in batch["spans"]:
                done: list[list[int]] = []
                for s, e in sorted((x["s"], x["e"]) for x in spans):
                    if done and s <= done[-1][1]:
                        done[-1][1] = max(done[-1][1], e)
                    else:
                        done.append([s, e])
                out.append([{"s": s, "e": e} for s, e in done])
            yield pd.DataFrame({"sig": batch["sig"], "spans": out})

    lists = repeated_spans(docs).distinct().groupBy("sig").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    return C.written(lists.mapInPandas(merge, "sig binary, spans array<struct<s:long,e:long>>"), "removed-spans")


def deduplicate(docs: DataFrame, with_data: bool = True) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and, if asked, ``data`` (what is left).

    Whole texts as UTF-8 bytes, null as empty; matches never cross texts; copies of a text remove each other whole if
    it has ``LENGTH`` bytes.  Spans are judged on the input, overlaps count, touching spans are one.  What is left may
    not be valid UTF-8, so it is binary.  Ids may repeat or be null; other columns are not read; an empty table gives
    an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.text_or_empty().cast("binary").alias("data"))
    rows = rows.withColumn("sig", F.unhex(F.md5("data"))).join(removed(docs), "sig", "left").drop("sig")
    kind = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", data binary" * with_data

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, data, spans in zip(batch["doc_id"].astype("Int64"), batch["data"], batch["spans"]):
                spans = [] if spans is None else [(x["s"], x["e"]) for x in spans]
                ends = [0, *(e for _, e in spans)]
                left = b"".join(data[a:s] for a, s in zip(ends, [*(s for s, _ in spans), len(data)]))
                out.append((doc_id, len(data), len(data) - len(left), len(spans), hashlib.sha256(left).hexdigest()) + (left,) * with_data)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in kind.split(", ")]).astype({"doc_id": "Int64"})

    return rows.mapInPandas(cut, kind)
