"""Hard-negative mining with an inverted multi-index.

Vectors are cut in two halves; a codebook per half, fitted on a bounded sample, gives every vector a code pair, its cell.
A query bounds the score of all vectors of a code by its score with the code word plus its length times the radius of
the code (the farthest vector from the word), and a cell by the sum of its half bounds.  A multi-sequence heap walks the
cells in falling order of that sum and stops once no cell left can hold a vector of the windows asked for: the result
is exact, whatever the codebooks.

A search goes in rounds.  In each, every open query takes further cells from its heap, for eight times as many vectors
as in the round before, and the best scores found raise the bar for the next cells.  Vectors are packed in blocks of a
cell and queries in batches, so a cell of any size is many rows of the join, and each meeting is one matrix product.  Neither side is broadcast: both grow with the table.
Of vectors alike in everything only as many as a result can hold are indexed, so a group of copies stays small.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: Vectors the codebooks are fitted on; all are indexed.
SAMPLE = 8_192
#: Vectors a cell should hold, and the most code words of a half: the cells are at most their square.
PER_CELL, MOST_WORDS = 512, 256
#: Vectors in a block, queries in a batch, and vectors a query sees in its first round.
BLOCK, BATCH, FIRST_ROUND, GROWTH = 1_024, 256, 2_048, 8
#: Scores below this are sums of products that a double holds exactly.
EXACT = float(1 << 53)


def packed_vectors(rows: DataFrame, dims: int) -> Column:
    """A vector of whole numbers, filled up with zeros to ``dims``."""
    return F.concat("q", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("q")))


def matrix(column: pd.Series | list, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<i8").reshape(-1, dims)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows, exact; beyond 64 bits they wrap like any long."""
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] < EXACT:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def code_words(points: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's algorithm from evenly spaced points; a word without points stays where it is."""
    words = points[np.linspace(0, len(points) - 1, k).astype(int)].astype(float)
    for _ in range(rounds):
        nearest = np.argmin((words * words).sum(1) - 2 * points @ words.T, axis=1)
        for w in range(k):
            mine = points[nearest == w]
            if len(mine):
                words[w] = mine.mean(axis=0)
    return words


@dataclass
class Index:
    """``blocks`` (``cell, block, items``) in the shared folder; code words, radii and cell sizes are bounded by the codes."""

    dims: int
    words: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray]
    sizes: np.ndarray
    blocks: DataFrame

    def half_bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Upper bounds, in whole numbers, of the scores of a query's halves with the vectors of each code."""
        cut, out = self.dims // 2, []
        for x, words, radii in zip((q[:cut], q[cut:]), self.words, self.radii):
            x = x.astype(float)
            bound = words @ x + np.sqrt(x @ x) * radii
            out.append(np.ceil(bound + 1e-6 * (1 + np.abs(bound))).astype(np.int64))
        return out[0], out[1]


def visit(bounds: tuple[np.ndarray, np.ndarray], opened: list[int]) -> Iterator[tuple[int, int, list[int]]]:
    """``(bound, cell, opened)`` in falling order of the bound.

    The codes of both halves are sorted by bound; the cell (i, j) of these orders is reached from (i, j - 1), and (i, 0)
    from (i - 1, 0), so the heap holds one cell per opened i.  ``opened`` says how far each i has come: with the list a
    walk ended with, it goes on from there.
    """
    first, second = (np.argsort(-b, kind="stable") for b in bounds)
    b1, b2, n = bounds[0][first].tolist(), bounds[1][second].tolist(), len(bounds[1])
    opened = list(opened) or [0]
    heap = [(-b1[i] - b2[j], i, j) for i, j in enumerate(opened) if j < n]
    heapq.heapify(heap)
    while heap:
        bound, i, j = heap[0]
        yield -bound, int(first[i]) * n + int(second[j]), opened
        heapq.heappop(heap)
        opened[i] = j + 1
        if j + 1 < n:
            heapq.heappush(heap, (-b1[i] - b2[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(b1):
            opened.append(0)
            heapq.heappush(heap, (-b1[i + 1] - b2[0], i + 1, 0))


def build(vectors: DataFrame, dims: int, most: int) -> Index:
    """Index ``vectors`` (``id, label, q``): of those alike in label and vector the first ``most`` by id."""
    alike = Window.partitionBy("q", "label").orderBy("id")
    kept = C.written(vectors.withColumn("nth", F.row_number().over(alike)).where(f"nth <= {most}").drop("nth"), "distinct-vectors")
    n = kept.count()
    k = int(min(MOST_WORDS, max(1, round((n / PER_CELL) ** 0.5))))
    cut = dims // 2

    def fit(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [np.array(b["q"].tolist(), float).reshape(len(b), -1) for b in batches]
        points = np.concatenate(parts) if parts else np.zeros((1, dims))
        points = points[np.lexsort(points.T[::-1])] if dims else points
        for half, part in enumerate((points[:, :cut], points[:, cut:])):
            yield pd.DataFrame({"half": half, "code": range(k), "word": code_words(part, k).tolist()})

    sample = kept.select("q").orderBy(F.xxhash64("q")).limit(SAMPLE)
    book = sample.repartition(1).mapInPandas(fit, "half int, code int, word array<double>").collect()
    words = tuple(np.array([r.word for r in sorted(book, key=lambda r: r.code) if r.half == h], float).reshape(k, -1) for h in (0, 1))

    def assign(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            q = np.array(rows["q"].tolist(), np.int64).reshape(len(rows), dims)
            out = {"id": rows["id"], "label": rows["label"], "data": [v.astype("<i8").tobytes() for v in q]}
            for h, half in enumerate((q[:, :cut].astype(float), q[:, cut:].astype(float))):
                code = np.argmin((words[h] * words[h]).sum(1) - 2 * half @ words[h].T, axis=1) if len(q) else np.zeros(0, int)
                out[f"c{h}"], out[f"d{h}"] = code, np.sqrt(((half - words[h][code]) ** 2).sum(axis=1))
            yield pd.DataFrame(out)

    coded = C.written(kept.mapInPandas(assign, "id long, label long, data binary, c0 int, d0 double, c1 int, d1 double"), "coded-vectors")
    radii = (np.zeros(k), np.zeros(k))
    for h in (0, 1):
        for r in coded.groupBy(f"c{h}").agg(F.max(f"d{h}").alias("r")).collect():  # a row per code word
            radii[h][r[0]] = r.r
    sizes = np.zeros(k * k, np.int64)
    cell = (F.col("c0") * k + F.col("c1")).alias("cell")
    counts = C.written(coded.groupBy(cell).agg(F.count(F.lit(1)).alias("n")), "cell-sizes")
    for r in counts.collect():  # a row per cell
        sizes[r.cell] = r.n
    block = F.pmod(F.xxhash64("id", "data"), F.ceil(F.col("n") / BLOCK)).alias("block")
    rows = coded.select(cell, "id", "label", "data").join(counts, "cell")
    blocks = rows.groupBy("cell", block).agg(F.collect_list(F.struct("id", "label", "data")).alias("items"))
    return Index(dims, words, radii, sizes, C.written(blocks, "vector-blocks"))


def search(index: Index, queries: DataFrame, most: int, same: bool) -> DataFrame:
    """``query, window, score, id``: per query and window its ``most`` best rows, by score, then by smaller id.

    ``queries`` has ``query, label, data, low, high``: the last two are arrays, one window of scores (ends included)
    each.  Rows of the query's label are searched if ``same``, else those of other labels.
    """
    state = C.written(queries.withColumn("opened", F.array().cast("array<int>")).withColumn("least", F.col("low")), "search-state")
    dims, sizes, n = index.dims, index.sizes, len(index.words[1])
    found, budget = None, FIRST_ROUND
    bare = Index(index.dims, index.words, index.radii, index.sizes, None)

    def plan(batches: Iterable[pd.DataFrame], budget: int) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for query, label, data, low, high, least, opened in zip(*(rows[c] for c in ("query", "label", "data", "low", "high", "least", "opened"))):
                cells, seen, bar = [], 0, min(least, default=0)
                for bound, cell, opened in visit(bare.half_bounds(np.frombuffer(data, "<i8")), list(opened)):  # noqa: B020
                    if bound < bar or seen >= budget or not len(low):
                        break
                    if sizes[cell]:
                        cells.append(cell)
                        seen += int(sizes[cell])
                if cells:
                    out.append((query, label, data, low, high, least, opened, cells))
            yield pd.DataFrame(out, columns=["query", "label", "data", "low", "high", "least", "opened", "cells"])

    def compare(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out: list[tuple[np.ndarray, ...]] = []
            for batch, items in zip(rows["batch"], rows["items"]):
                ids = np.array([x["id"] for x in items], np.int64)
                labels = np.array([x["label"] for x in items], np.int64)
                scores = products(matrix([x["data"] for x in batch], dims), matrix([x["data"] for x in items], dims))
                by_id = np.argsort(ids, kind="stable")
                ids, labels, scores = ids[by_id], labels[by_id], scores[:, by_id]
                for x, s in zip(batch, scores):
                    fits = np.flatnonzero((labels == x["label"]) == same)
                    s = s[fits]
                    for w, (least, high) in enumerate(zip(x["least"], x["high"])):
                        at = np.flatnonzero((s >= least) & (s <= high))
                        at = at[np.argsort(-s[at], kind="stable")[:most]]
                        out.append((np.full(len(at), x["query"]), np.full(len(at), w), s[at], ids[fits[at]]))
            yield pd.DataFrame(dict(zip(("query", "window", "score", "id"), map(np.concatenate, zip(*out)))) if out else
                               {c: np.zeros(0, np.int64) for c in ("query", "window", "score", "id")})

    better = Window.partitionBy("query", "window").orderBy(F.desc("score"), "id")
    while True:
        wanted = state.mapInPandas(lambda batches, b=budget: plan(batches, b), state_kind(queries) + ", cells array<int>")
        wanted = C.written(wanted, "wanted-cells")
        active = wanted.count()
        if not active:
            break
        batch = F.pmod(F.xxhash64("query"), F.lit(-(-active // BATCH))).alias("part")
        item = F.struct("query", "label", "data", "least", "high")
        batches = wanted.select(F.explode("cells").alias("cell"), batch, item.alias("x")).groupBy("cell", "part").agg(F.collect_list("x").alias("batch"))
        hits = batches.hint("merge").join(index.blocks.hint("merge"), "cell").select("batch", "items").mapInPandas(compare, "query long, window int, score long, id long")
        hits = hits if found is None else hits.unionByName(found)
        found = C.written(hits.withColumn("nth", F.row_number().over(better)).where(f"nth <= {most}").drop("nth"), "found")
        full = found.groupBy("query", "window").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("bar")).where(f"n = {most}")
        bars = full.groupBy("query").agg(F.map_from_entries(F.collect_list(F.struct("window", "bar"))).alias("bars"))
        raised = F.transform("least", lambda x, w: F.greatest(x, F.when(F.col("bars").isNotNull(), F.try_element_at("bars", w))))
        state = C.written(wanted.drop("cells").join(bars, "query", "left").withColumn("least", raised).drop("bars"), "search-state")
        budget *= GROWTH
    return found if found is not None else queries.sparkSession.createDataFrame([], "query long, window int, score long, id long")


def state_kind(queries: DataFrame) -> str:
    return "query long, label long, data binary, low array<long>, high array<long>, least array<long>, opened array<int>"


def mine(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, percent: tuple[int, int] = (50, 95)) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vectors`` and ``anchors`` have ``id, label, q``, q a list of whole numbers; each anchor is also a row of
    ``vectors``.  Positives of an anchor are its best rows of the same label besides itself; negatives of a pair are the
    best rows of other labels that score between ``percent`` of the positive's score, ends included.  Pairs whose score
    is negative have none.  Shorter vectors are filled up with zeros.  Rows that repeat an id are rows of their own; an
    anchor leaves out one row with its id.  An empty table gives an empty result.
    """
    dims = vectors.agg(F.coalesce(F.max(F.size("q")), F.lit(0))).first()[0]
    dims += dims % 2
    filled = lambda d: d.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), packed_vectors(d, dims).alias("q"))
    index = build(filled(vectors), dims, max(positives + 1, negatives))
    named = C.written(filled(anchors), "anchors")
    kinds = C.written(named.select("q", "label").distinct().withColumn("query", F.monotonically_increasing_id()), "anchor-vectors")

    def pack(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"query": rows["query"], "label": rows["label"], "data": [np.array(q, "<i8").tobytes() for q in rows["q"]]})

    packed = C.written(kinds.mapInPandas(pack, "query long, label long, data binary"), "packed-anchors")
    ends = [F.array(F.lit(x).cast("long")) for x in (-(1 << 63), (1 << 63) - 1)]
    near = search(index, packed.select("*", ends[0].alias("low"), ends[1].alias("high")), positives + 1, True)
    best = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "id")))
    lists = C.written(near.groupBy("query").agg(best.alias("best")), "positives")
    scores = F.sort_array(F.array_distinct(F.filter(F.transform("best", lambda x: -x["minus"]), lambda s: s >= 0)))
    windows = lists.select("query", scores.alias("scores")).where(F.size("scores") > 0)
    asked = packed.join(windows, "query").select(
        "query", "label", "data", F.transform("scores", lambda s: F.floor((s * percent[0] + 99) / 100).cast("long")).alias("low"),
        F.transform("scores", lambda s: F.floor(s * percent[1] / 100).cast("long")).alias("high"))
    other = search(index, asked, negatives, False).join(windows, "query")
    ranks = Window.partitionBy("query", "window").orderBy(F.desc("score"), "id")
    other = other.select(F.col("query").alias("k"), F.element_at("scores", F.col("window") + 1).alias("of"), F.row_number().over(ranks).alias("rank"),
                         F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    mine_ = named.join(kinds, ["q", "label"]).select("id", "query").join(lists, "query")
    own = F.array_position(F.transform("best", lambda x: x["id"]), F.col("id"))
    others = F.slice(F.filter("best", lambda x, i: i + 1 != own), 1, positives)
    pairs = mine_.select("query", F.col("id").alias("anchor_id"), F.explode(others).alias("p")).select(
        "query", "anchor_id", F.col("p.id").alias("positive_id"), (-F.col("p.minus")).alias("positive_score"))
    return pairs.join(other, (F.col("query") == F.col("k")) & (F.col("positive_score") == F.col("of"))).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def scaled(embeddings: DataFrame, every: int = 50) -> tuple[DataFrame, DataFrame]:
    """``(vectors, anchors)`` of a table ``vec_id, embedding, label``: components times 256, rounded down.

    Rows with a null id, label or vector, or a null or non-finite component, take no part.  The label of every seventh
    id is first moved on by one, modulo ten.  Anchors are the rows whose id ``every`` divides.
    """
    unfit = F.exists("embedding", lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True)))
    rows = embeddings.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(~unfit)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select(F.col("vec_id").cast("long").alias("id"), label.cast("long").alias("label"),
                       F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("long")).alias("q"))
    rows = C.written(rows, "scaled-vectors")
    return rows, rows.where(F.col("id") % every == 0)
