"""SimHash near-duplicates through vantage-point trees.

Fingerprints are 64 majority bits over the XXH64 of word shingles.  Equal fingerprints are one class.  A tree of
vantage points, fitted on a bounded sample of the classes, cuts the space by Hamming distance; every class goes to its
shard and, where it lies at most ``radius`` bits outside a ball, by the triangle inequality also into the ball's
shards, so each pair within ``radius`` bits meets in some shard.  Shards that are too large get trees of their own, level
by level.  A shard that fits goes on splitting the same way in memory and compares what is left exactly.  Shards emit a spanning set of their links, never all pairs, and the links are merged
into components by star contraction.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

SEED = 42
#: Classes the tree is fitted on; every class is routed through it.
SAMPLE = 16_384
#: Classes a shard may hold, and sampled classes a leaf of a tree has at least.
SHARD = 20_000
LEAF = 32


def fingerprint(data: bytes, shingle: int) -> int:
    """The fingerprint of one text as an unsigned integer; no words: 0."""
    words = data.lower().split()  # ASCII only, for bytes: A-Z and the six white-space characters
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    stops = ends[min(shingle, len(words)) - 1 :]
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:last].tolist(), stops.tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        part = h[i : i + (1 << 16)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprint_column(shingle: int):
    """A column function: the fingerprint of a binary column as a signed 64-bit integer."""

    @F.pandas_udf("long")
    def of(data: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(d, shingle) for d in data], np.uint64).astype(np.int64))

    return of


class VantageTree:
    """Nodes as arrays: vantage point, ball radius, and the node or ``~shard`` inside and outside."""

    def __init__(self, sample: np.ndarray, leaf: int, radius: int):
        self.radius, self.nodes, self.shards = radius, [], 0
        self.root = self._grow(sample, leaf, np.random.default_rng(7))

    def packed(self) -> bytes:
        return pickle.dumps((self.radius, self.root, [(int(v), b, i, o) for v, b, i, o in self.nodes]))

    @classmethod
    def unpacked(cls, data: bytes) -> VantageTree:
        tree = cls.__new__(cls)
        tree.radius, tree.root, nodes = pickle.loads(data)
        tree.nodes = [(np.uint64(v), b, i, o) for v, b, i, o in nodes]
        return tree

    def _grow(self, points: np.ndarray, leaf: int, rng: np.random.Generator) -> int:
        best = None if len(points) <= leaf else choose(points, self.radius, rng)
        if best is None:
            self.shards += 1
            return ~(self.shards - 1)
        vantage, ball, d = best
        at = len(self.nodes)
        self.nodes.append(None)
        inside = self._grow(points[d <= ball + self.radius], leaf, rng)
        self.nodes[at] = (vantage, ball, inside, self._grow(points[d > ball], leaf, rng))
        return at

    def route(self, points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """``(shard, positions)``: a point outside a ball but within ``radius`` of it goes into both."""
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if node < 0:
                yield ~node, at
                continue
            vantage, ball, inside, outside = self.nodes[node]
            d = np.bitwise_count(points[at] ^ vantage)
            todo += [(inside, at[d <= ball + self.radius]), (outside, at[d > ball])]


def choose(points: np.ndarray, radius: int, rng: np.random.Generator):
    """The vantage point and ball, of some tried, with the smallest larger side; None if no ball parts the points."""
    best, least = None, 0.9 * len(points)
    for vantage in points[rng.integers(0, len(points), 6)]:
        d = np.bitwise_count(points ^ vantage).astype(np.int64)
        upto = np.cumsum(np.bincount(d, minlength=65 + radius))
        sides = np.maximum(upto[radius : 65 + radius], len(points) - upto[:65])  # of balls 0..64, with the overlap
        ball = int(np.argmin(sides))
        if sides[ball] < least:
            best, least = (vantage, ball, d), sides[ball]
    return best


def spanning_links(points: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect exactly what the pairs within ``radius`` connect; ``points`` are distinct."""
    links, rng, todo = [], np.random.default_rng(7), [np.arange(len(points))]
    while todo:
        at = todo.pop()
        part = choose(points[at], radius, rng) if len(at) > 512 else None
        if part is not None:
            _, ball, d = part
            todo += [at[d <= ball + radius], at[d > ball]]
            continue
        if len(at) <= 512:
            x = points[at]
            near = np.bitwise_count(x[:, None] ^ x[None, :]) <= radius
            at = at[near.sum(axis=1) > 1]
        while len(at):  # walk each component; a point is compared with what no walk has reached yet
            front, at = [at[0]], at[1:]
            while front and len(at):
                p = front.pop()
                hit = np.bitwise_count(points[at] ^ points[p]) <= radius
                links += [(int(p), int(q)) for q in at[hit]]
                front += at[hit].tolist()
                at = at[~hit]
    return links


def _route(batches: Iterator[pd.DataFrame], tree: VantageTree) -> Iterator[pd.DataFrame]:
    for batch in batches:
        fp = batch["fp"].to_numpy()
        for k, at in tree.route(fp.view(np.uint64)):
            yield pd.DataFrame({"shard": str(k), "fp": fp[at]})


def _route_again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by shard, each shard's tree before its fingerprints: a batch and a tree are held at a time."""
    tree, of = None, None
    for batch in batches:
        for shard, rows in batch.groupby("shard", sort=False):
            if rows["tree"].iloc[0] is not None:
                tree, of, rows = VantageTree.unpacked(rows["tree"].iloc[0]), shard, rows.iloc[1:]
            assert of == shard
            for part in _route([rows], tree):
                yield part.assign(shard=shard + "/" + part["shard"])


def shards(classes: DataFrame, radius: int, sample: int = SAMPLE, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """``(fitting, dense)``: fingerprints by ``shard`` (one may be in several), every shard of at most ``shard`` of them, and
    the fingerprints of shards that no ball parts.

    The first tree is fitted on the driver on ``sample`` classes.  Shards that are too large get a tree of their own,
    fitted by a task each on as many of theirs, a job per level, until all fit.
    """
    n = classes.count()
    fitted = [r.fp for r in classes.select("fp").orderBy(F.xxhash64("fp")).limit(sample).collect()]
    leaf = lambda size, taken: max(LEAF, taken * shard // max(size, 1))
    tree = VantageTree(np.array(fitted, np.int64).view(np.uint64), leaf(n, len(fitted)), radius)
    routed = C.written(classes.select("fp").mapInPandas(lambda b: _route(b, tree), "shard string, fp long"), "shards")
    first = Window.partitionBy("shard").orderBy(F.xxhash64("fp"), "fp")

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        points = rows["fp"].to_numpy().view(np.uint64)
        grown = VantageTree(points, leaf(int(rows["size"].iloc[0]), len(points)), radius)
        return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "tree": [grown.packed() if grown.shards > 1 else None]})

    fitting, dense = [], []
    while True:
        large = C.written(routed.groupBy("shard").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > shard), "large-shards")
        fitting.append(routed.join(large.select("shard"), "shard", "left_anti"))
        if large.isEmpty():
            break
        over = routed.join(large, "shard")
        taken = over.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= sample).select("shard", "fp", "size")
        trees = C.written(taken.groupBy("shard").applyInPandas(fit, "shard string, tree binary"), "shard-trees")
        dense.append(over.join(trees.where("tree IS NULL").select("shard"), "shard", "left_semi").select("fp"))
        grown = trees.where("tree IS NOT NULL")
        parts = over.join(grown.select("shard"), "shard", "left_semi").select("shard", F.lit(None).cast("binary").alias("tree"), "fp")
        both = grown.select("shard", "tree", F.lit(0).cast("long").alias("fp")).unionByName(parts)
        both = both.repartition("shard").sortWithinPartitions("shard", F.col("tree").isNull())
        routed = C.written(both.mapInPandas(_route_again, "shard string, fp long"), "shards")
    union = lambda parts, schema: reduce(DataFrame.unionByName, parts) if parts else classes.sparkSession.createDataFrame([], schema)
    return union(fitting, "shard string, fp long"), union(dense, "fp long").distinct()


def neighbourhood_links(points: DataFrame, radius: int) -> DataFrame:
    """``(a, b)``: spanning links of fingerprints crowded so closely that no ball parts them; ``radius`` must be even.

    Two are within ``radius`` bits exactly if some word is within half of it of both: all that share such a word are
    linked to the least of them.  A word has few neighbours, so no group is large.
    """
    if radius % 2:
        raise ValueError("fingerprints that no ball parts need an even radius")
    bits = F.array(*[F.lit(np.array([1 << k], np.uint64).view(np.int64).item()) for k in range(64)])
    words = F.array(F.col("fp"))
    for _ in range(radius // 2):
        flipped = F.transform(words, lambda w: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: w.bitwiseXOR(F.element_at(bits, k + 1))))
        words = F.array_distinct(F.concat(words, F.flatten(flipped)))
    sharing = points.select("fp", F.explode(words).alias("word")).groupBy("word").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    return sharing.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b").distinct()


def links(classes: DataFrame, radius: int, sample: int = SAMPLE, shard: int = SHARD) -> DataFrame:
    """``(a, b)``: spanning links between the distinct fingerprints of ``classes`` (column ``fp``)."""

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        fp = rows["fp"].to_numpy()
        found = np.array(spanning_links(fp.view(np.uint64), radius), np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": fp[found[:, 0]], "b": fp[found[:, 1]]})

    fitting, dense = shards(classes, radius, sample, shard)
    near = fitting.groupBy("shard").applyInPandas(compare, "a long, b long")
    dense = C.written(dense, "dense-classes")
    return (near if dense.isEmpty() else near.unionByName(neighbourhood_links(dense, radius))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(fp, root)`` for every fingerprint with a link: the smallest fingerprint it is connected to.

    Alternating star contraction: each round is a minimum per node and a join, and is written to the shared folder.
    Ends when a round changes nothing; the number of rounds grows with the logarithm of the longest path.
    """
    edges = C.written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        mark = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == before or not mark[0]:
            return edges.select(F.col("u").alias("fp"), F.col("v").alias("root"))
        before = mark
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = C.written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "star-minima")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = C.written(large.where("u <> v").distinct(), "large-star")
        low = C.written(large.groupBy("u").agg(F.min("v").alias("m")), "star-minima")
        small = large.join(low, "u")
        edges = C.written(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
                          .where("u <> v").distinct(), "small-star")


def classes_of(fingerprints: DataFrame, radius: int) -> DataFrame:
    """``fp, root, component_id, size`` per distinct fingerprint of ``fingerprints`` (``doc_id``, ``fp``, written)."""
    classes = C.written(fingerprints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "classes")
    rooted = classes.join(components(links(classes, radius)), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = C.written(rooted, "rooted-classes")
    whole = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("size"))
    return C.written(rooted.select("fp", "root").join(whole, "root"), "components")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row per input row: ``doc_id, fingerprint, component_id``.

    A null text is empty: fingerprint 0, linked like any other.  ``component_id`` is the smallest id reachable through
    links of at most ``radius`` bits (null ids never win; null if there is no other).  Repeated rows keep their number;
    other columns are not read; an empty table gives an empty result.
    """
    of = fingerprint_column(shingle)
    rows = C.written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), of(C.text_or_empty().cast("binary")).alias("fp")),
                     "fingerprints")
    return rows.join(classes_of(rows, radius), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """All columns of one row per component: the one with the smallest id (a null id only where there is no other).

    Null and empty texts are alike (fingerprint 0); of rows that repeat the smallest id one stays; an empty table gives
    an empty one.
    """
    of = fingerprint_column(shingle)
    rows = C.packed(docs, id=F.col("doc_id").cast("long"), fp=of(C.text_or_empty().cast("binary")))
    rows = C.written(rows, "fingerprinted")
    found = classes_of(rows.select(F.col("id").alias("doc_id"), "fp"), radius)
    stay = rows.join(found, "fp").where(F.col("id").eqNullSafe(F.col("component_id")))
    return stay.where("size = 1").select("row.*").unionByName(
        stay.where("size > 1").dropDuplicates(["root"]).select("row.*"))  # ids may repeat within a component
