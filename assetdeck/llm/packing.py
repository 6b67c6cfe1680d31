"""Best-fit packing of tokenised documents, with certified bounds and exchange between partitions.

Documents are cut into pieces of at most ``capacity`` tokens.  Pieces are dealt over partitions of bounded size, and
each partition packs its own by best-fit decreasing.  Dual feasible functions give a lower bound of the sequences any
packing of those pieces needs; where the count equals the bound, the partition is certified and done.  Partitions with
a gap put the pieces of their emptiest sequences into a pool; the pools of ``fan_in`` partitions meet and are packed
again, until no gap or one partition is left.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from . import common as C

END = 2
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECE + ", sequence_id long, offset long, partition_sequences long, partition_bound long, pooled boolean, bucket long"


def pieces(docs: DataFrame, capacity: int = 1024, vocabulary: str = bpe.VOCABULARY) -> DataFrame:
    """One row per piece: tokens of the document, then id 2; only the first of several pieces is shorter.

    A null text is an empty one (a single token).  An added token written out in a text has its own id, as the library
    encodes it by default.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, end = bpe.Codec.here(vocabulary), np.array([END], "<i4").tobytes()
        for batch in batches:
            for first, texts in bpe.slices(batch.column(1)):
                doc, piece, start, length, crc = [], [], [], [], []
                for k, ids in enumerate(codec.encode_with_added(texts)):
                    ids += end
                    n = len(ids) // 4
                    cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                    for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        doc.append(first + k)
                        piece.append(p)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(ids[4 * a : 4 * b]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                    ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.text_or_empty().alias("text")).mapInArrow(run, PIECE)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(sequence, offset)`` of each length and the fill of each sequence.  Equal lengths keep their order."""
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # open sequences by free tokens
    some, fill = 0, []  # some: bit r is set if room[r] is not empty
    order = np.argsort(-lengths, kind="stable")
    for at, size in zip(order.tolist(), lengths[order].tolist()):
        fits = some >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            s = room[free].pop()
            if not room[free]:
                some &= ~(1 << free)
        else:
            s, free = len(fill), capacity
            fill.append(0)
        sequence[at], offset[at] = s, fill[s]
        fill[s] += size
        free -= size
        if free:
            room[free].append(s)
            some |= 1 << free
    return sequence, offset, np.array(fill, np.int64)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best bound of two families of dual feasible functions over all their parameters.

    Cut-off e: lengths over capacity - e count as whole, those under e as nothing.  Rounding k: a length counts as the
    number of (k+1)-ths of the capacity it fills, over k, unless it is a multiple of such a part.
    """
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int(count @ size) // capacity)
    tokens, many = np.cumsum(count * size), np.cumsum(count)
    for e in range(1, capacity // 2 + 1):
        whole = int(many[capacity] - many[capacity - e])
        best = max(best, whole + -(-int(tokens[capacity - e] - tokens[e - 1]) // capacity))
    for k in range(1, 33):
        part = size * (k + 1)
        worth = np.where(part % capacity == 0, size * k, part // capacity * capacity)
        best = max(best, -(-int(count @ worth) // (k * capacity)))
    return best


def _pack(capacity: int, step: int, pool: int):
    """Pack one partition; if it has a gap, mark the pieces of its emptiest sequences, ``pool`` pieces at most."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece", "start"], kind="stable").reset_index(drop=True)
        lengths = rows["length"].to_numpy()
        sequence, offset, fill = best_fit_decreasing(lengths, capacity)
        bound = lower_bound(lengths, capacity)
        again = np.zeros(len(fill), bool)
        if len(fill) > bound and pool:
            emptiest = np.argsort(fill, kind="stable")
            again[emptiest[np.cumsum(np.bincount(sequence, minlength=len(fill))[emptiest]) <= pool]] = True
            again &= fill < capacity
        return rows.drop(columns="bucket").assign(
            sequence_id=(step << 56) | (int(key[0]) << 24) | sequence, offset=offset, partition_sequences=len(fill),
            partition_bound=bound, pooled=again[sequence], bucket=int(key[0]))

    return run


def pack(cut: DataFrame, capacity: int = 1024, per_partition: int = 50_000, fan_in: int = 8) -> DataFrame:
    """Place the rows of ``pieces``: ``sequence_id`` and ``offset``, and the size and bound of the partition that placed them.

    Every row is placed exactly once, rows that repeat a document included; ties in length go by document, piece and
    start.  A partition holds about ``per_partition`` pieces whatever the input size; each exchange has an ``fan_in``-th
    of the partitions of the one before.  An empty table gives an empty result.
    """
    cut = C.written(cut, "pieces")
    n = max(1, -(-cut.count() // per_partition))
    row = F.xxhash64("doc_id", "piece", "start", "ids_crc32", F.monotonically_increasing_id())  # spreads repeated ids too
    todo, done, step = cut.withColumn("bucket", F.pmod(row, F.lit(n))), [], 0
    while True:
        pool = per_partition // fan_in if n > 1 else 0
        placed = C.written(todo.groupBy("bucket").applyInPandas(_pack(capacity, step, pool), PLACED), "placed")
        done.append(placed.where("not pooled"))
        if n == 1 or placed.where("pooled").isEmpty():
            break
        todo = placed.where("pooled").select(*cut.columns, F.floor(F.col("bucket") / fan_in).cast("long").alias("bucket"))
        n, step = -(-n // fan_in), step + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("pooled", "bucket")
