"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source has a quota of blocks of its documents: whole passes, and of one further pass so many blocks, in permuted
order, as its target leaves room for.  The quotas of all sources are split down a binary tree over the output shards:
each node deals an exact number of blocks to its left half, drawn without replacement from the blocks it has, so the
counts per source follow the multivariate hypergeometric law and every block goes to exactly one shard.  The shards then
draw disjoint stretches of each source's permuted blocks, and rows are shuffled within their shard.

Everything random comes from digests of ids, so reruns agree.  DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (1, 2, 3)
#: No source gives more than so many times its size.
MOST = 3
#: Words a block should hold, and the power of two of the blocks a source has at most: both bound what one window sees.
BLOCK_WORDS = 4_096
BLOCK_BITS = 16
#: Blocks that share the end of a pass that is not whole: long documents that no longer fit leave their room to others.
LAST_BLOCKS = 16
#: Rows that one generated array holds.
CHUNK = 10_000
SEED = "mix"


def _number(text: Column) -> Column:
    """32 bits of the MD5 digest of a string."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """``source, doc_id, size, n``: the documents with their size in words; rows alike in all three are one with a count."""
    size = F.regexp_count(C.text_or_empty(), F.lit(C.WORD)).cast("long")
    return (docs.select(F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"))
            .groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("n")))


def ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with ``rank`` from 0 in code-point order, null last; ranks add up over range partitions."""
    order = F.col("source").asc_nulls_last()
    parts = C.written(sources.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "source-parts")
    before = F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.groupBy("part").agg(F.count(F.lit(1)).alias("rows")).select("part", before.alias("offset"))  # a row per partition
    within = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return parts.withColumn("within", within).join(offsets, "part").withColumn("rank", F.col("within") + F.col("offset")).drop("part", "within", "offset")


def targets(sizes: DataFrame) -> DataFrame:
    """``source, source_size, rank, target, passes, rest`` per source of ``sized``.

    The sources share all words by weight.  Where that exceeds ``MOST`` times a source's size, the target stops there
    and the others share what is left; the loop ends when none is above.  ``passes`` are whole, ``rest`` is what remains.
    """
    sums = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    table = C.written(ranked(sums).withColumn("weight", weight).withColumn("cap", MOST * F.col("source_size")), "source-sizes")
    total = table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    capped = F.lit(False)
    while True:  # three numbers a round come to the driver
        stopped, left, n = table.agg(F.coalesce(F.sum(F.when(capped, F.col("cap"))), F.lit(0)),
                                     F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0)), F.count(F.when(capped, 1))).first()
        share = F.lit(total - stopped).cast("double") * F.col("weight") / F.lit(max(left, 1)).cast("double")
        above = capped | (share > F.col("cap"))
        if table.where(above).count() == n:
            break
        capped = above
    target = F.when(capped, F.col("cap").cast("double")).otherwise(share)
    passes = F.when(F.col("source_size") > 0, F.least(F.lit(MOST), F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))))).otherwise(0)
    return (table.withColumn("target", target).withColumn("passes", passes.cast("int"))
            .select("source", "source_size", "rank", "target", "passes", (F.col("target") - F.col("passes") * F.col("source_size")).alias("rest")))


def blocked(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """``sized`` rows with ``digest`` and ``block``: a source of many words has a power of two of blocks, dealt by digest."""
    bits = F.least(F.lit(BLOCK_BITS), F.length(F.bin(F.floor(F.col("source_size") / BLOCK_WORDS))))
    key = F.concat_ws(":", F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("size").cast("string"))
    joined = sizes.join(sources.select(F.col("source").alias("s"), "rank", "source_size"), F.col("source").eqNullSafe(F.col("s")))
    return joined.select("source", "rank", "doc_id", "size", "n", F.md5(key).alias("digest"),
                         _number(key).bitwiseAND(F.pow(F.lit(2.0), bits).cast("long") - 1).alias("block"))


def quotas(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``rank, pass, block, nth, room``: every block drawn, numbered from 0 within its source in permuted order.

    ``room`` is null where the whole block is drawn.  A pass that is not whole ends with ``LAST_BLOCKS`` blocks that
    together give ``room`` words and are dealt as one.
    """
    words = rows.groupBy("rank", "block").agg(F.sum(F.col("size") * F.col("n")).alias("words"))
    key = F.md5(F.concat_ws(":", F.lit(SEED), F.col("rank").cast("string"), F.col("pass").cast("string"), F.col("block").cast("string")))
    order = Window.partitionBy("rank", "pass").orderBy("key")  # 2 ** BLOCK_BITS rows at most
    drawn = words.join(sources.select("rank", "passes", "rest"), "rank").withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes")))).withColumn("key", key)
    before = F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    drawn = drawn.withColumn("before", before).withColumn("whole", (F.col("pass") < F.col("passes")) | (F.col("before") + F.col("words") <= F.col("rest")))
    room = F.when(~F.col("whole"), F.col("rest") - F.min(F.when(~F.col("whole"), F.col("before"))).over(Window.partitionBy("rank", "pass")))
    partial = F.sum((~F.col("whole")).cast("int")).over(order)
    drawn = drawn.withColumn("room", room).withColumn("partial", partial).where(F.col("whole") | ((F.col("partial") <= LAST_BLOCKS) & (F.col("room") >= 1)))
    done = F.sum(F.col("whole").cast("long")).over(Window.partitionBy("rank").orderBy("pass", "key").rowsBetween(Window.unboundedPreceding, 0))
    return drawn.select("rank", "pass", "block", (done - F.col("whole").cast("long")).alias("nth"), "room")


def _fill(items: Column, room: Column) -> Column:
    """``items`` (with ``size`` and ``n``) in order, each with the ``copies`` that the room left by those before still holds."""
    kind = "struct<room:double,out:array<bigint>>"

    def step(a: Column, x: Column) -> Column:
        fit = F.when(x["size"] > 0, F.least(x["n"], F.floor(a["room"] / F.nullif(x["size"], F.lit(0))))).otherwise(F.lit(0).cast("long"))
        return C.let(fit, lambda c: F.struct((a["room"] - c * x["size"]).alias("room"), F.concat(a["out"], F.array(c)).alias("out")).cast(kind))

    return F.aggregate(items, F.struct(room.alias("room"), F.array().alias("out")).cast(kind), step)["out"]


def hypergeometric(total: Column, marked: Column, drawn: Column, uniform: Column) -> Column:
    """How many of ``drawn`` out of ``total``, ``marked`` of them special, are special: the inverse of the law at ``uniform``.

    Terms further than ten deviations (and ten) from the mean weigh less than a double resolves and are left out.
    """
    t, m, d = (x.cast("double") for x in (total, marked, drawn))
    mean = d * m / F.greatest(t, F.lit(1.0))
    spread = 10 * F.sqrt(mean * (t - m) / F.greatest(t, F.lit(1.0)) * (t - d) / F.greatest(t - 1, F.lit(1.0))) + 10
    low = F.greatest(F.lit(0).cast("long"), drawn - (total - marked), F.floor(mean - spread))
    high = F.least(drawn, marked, F.ceil(mean + spread))

    def invert(ends: Column) -> Column:
        ks = F.sequence(ends["low"], ends["high"])

        def following(weight: Column, k: Column) -> Column:  # weight of k + 1 from that of k
            x = k.cast("double")
            return weight * (m - x) * (d - x) / ((x + 1) * (t - m - d + x + 1))

        first = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"))
        whole = F.aggregate(ks, first, lambda a, k: F.struct(F.when(k < ends["high"], following(a["w"], k)).otherwise(0.0).alias("w"),
                                                             (a["sum"] + a["w"]).alias("sum")))["sum"]

        def find(goal: Column) -> Column:
            start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"), ends["low"].alias("k"))
            return F.aggregate(ks, start, lambda a, k: F.struct(
                F.when(k < ends["high"], following(a["w"], k)).otherwise(0.0).alias("w"), (a["sum"] + a["w"]).alias("sum"),
                F.when(a["sum"] + a["w"] <= goal, F.least(k + 1, ends["high"])).otherwise(a["k"]).alias("k")))["k"]

        return C.let(whole * uniform, find)

    return C.let(F.struct(low.alias("low"), high.alias("high")), invert)


def _split(node: Column) -> Column:
    """The halves of a tree node ``struct<first, shards, quotas>``; a node of one shard stays."""
    total = F.aggregate(node["quotas"], F.lit(0).cast("long"), lambda a, q: a + q)

    def halves(whole: Column) -> Column:
        left = F.floor(node["shards"] / 2).cast("long")
        indexed = F.transform(node["quotas"], lambda q, i: F.struct(q.alias("q"), i.alias("i")))
        start = F.struct(whole.alias("total"), F.floor(whole * left / node["shards"]).cast("long").alias("need"), F.array().cast("array<bigint>").alias("out"))

        def step(a: Column, x: Column) -> Column:
            key = F.concat_ws(":", F.lit(SEED), node["first"].cast("string"), node["shards"].cast("string"), x["i"].cast("string"))
            uniform = _number(key).cast("double") / float(1 << 32)
            return C.let(hypergeometric(a["total"], x["q"], a["need"], uniform), lambda k: F.struct(
                (a["total"] - x["q"]).alias("total"), (a["need"] - k).alias("need"), F.concat(a["out"], F.array(k)).alias("out")))

        return C.let(F.aggregate(indexed, start, step)["out"], lambda mine: F.array(
            _node(node["first"], left, mine),
            _node(node["first"] + left, node["shards"] - left, F.zip_with(node["quotas"], mine, lambda q, k: q - k))))

    return F.when(node["shards"] > 1, C.let(total, halves)).otherwise(F.array(node))


def _node(first: Column, shards: Column, quotas: Column) -> Column:
    return F.struct(first.cast("long").alias("first"), shards.cast("long").alias("shards"), quotas.alias("quotas"))


def dealt(drawn: DataFrame, blocks_per_shard: int) -> DataFrame:
    """``rank, nth, shard``: the shard of every block of ``quotas``, as the splitting tree gives it.

    A node holds one number per source; a level of the tree is one pass over its nodes.
    """
    counts = C.written(drawn.groupBy("rank").agg((F.max("nth") + 1).alias("blocks")), "block-quotas")
    total = counts.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]
    shards = max(1, -(-total // blocks_per_shard))
    by_rank = F.array_sort(F.collect_list(F.struct("rank", "blocks")))
    root = counts.agg(by_rank.alias("all")).select(F.transform("all", lambda x: x["rank"]).alias("ranks"), _node(
        F.lit(0), F.lit(shards), F.transform("all", lambda x: x["blocks"])).alias("node"))
    nodes, width = root, 1
    while width < shards:
        nodes, width = nodes.select("ranks", F.explode(_split(F.col("node"))).alias("node")), 2 * width
        if width % 64 == 0:
            nodes = C.written(nodes.repartition(width // 64, F.col("node.first")), "tree")
    leaves = nodes.select(F.col("node.first").alias("shard"), F.explode(F.arrays_zip(F.col("ranks"), F.col("node.quotas"))).alias("x"))
    leaves = C.written(leaves.select("shard", F.col("x.ranks").alias("rank"), F.col("x.quotas").alias("quota")).where("quota > 0"), "shard-quotas")
    end = F.sum("quota").over(Window.partitionBy("rank").orderBy("shard"))
    return leaves.withColumn("end", end).select("rank", "shard", F.explode(F.sequence(F.col("end") - F.col("quota"), F.col("end") - 1)).alias("nth"))


def mix(docs: DataFrame, blocks_per_shard: int = 64) -> tuple[DataFrame, DataFrame]:
    """``(plan, draws)``: the documents with their source's target, and what each shard draws of them.

    ``plan`` has ``source, rank, doc_id, size, n, source_size, target`` per distinct (source, id, size) with its count of
    rows.  ``draws`` has ``rank, doc_id, size, copies, pass, shard, place``: so many of those rows (one pass takes a row
    once), and their place in the shard's shuffle.  Null texts are empty, a null source is the last one, null ids are a
    document of their own; rows that repeat one are counted and all drawn alike, but for the last blocks, whose documents
    are taken in order as long as they fit in what the target leaves.  Other columns are not read; an empty table gives empty results.
    """
    sizes = C.written(sized(docs), "sized-documents")
    sources = C.written(targets(sizes), "source-targets")
    rows = C.written(blocked(sizes, sources), "blocked-documents")
    drawn = C.written(quotas(rows, sources), "drawn-blocks")
    placed = C.written(drawn.join(dealt(drawn, blocks_per_shard), ["rank", "nth"]), "placed-blocks")
    whole = rows.join(placed.where("room IS NULL"), ["rank", "block"]).withColumn("copies", F.col("n"))
    item = F.struct("nth", "digest", "doc_id", "size", "n", "block", "pass", "shard", "source")
    cut = rows.join(placed.where("room IS NOT NULL"), ["rank", "block"]).groupBy("rank").agg(
        F.array_sort(F.collect_list(item)).alias("items"), F.first("room").alias("room"))  # the last blocks of each source
    cut = cut.select("rank", F.explode(F.arrays_zip(F.col("items"), _fill(F.col("items"), F.col("room")).alias("copies"))).alias("x"))
    cut = cut.select("rank", "x.items.*", "x.copies").where("copies > 0")
    draws_of = lambda d: d.select("rank", "doc_id", "size", "n", "copies", "pass", "shard", F.md5(F.concat_ws(
        ":", "digest", F.col("shard").cast("string"), F.col("pass").cast("string"))).alias("place"))
    draws = draws_of(whole).unionByName(draws_of(cut))
    plan = rows.join(sources.select("rank", "source_size", "target"), "rank").select(
        "source", "rank", "doc_id", "size", "n", "source_size", "target")
    return plan, draws


def shards(draws: DataFrame) -> DataFrame:
    """The mix itself: one row per document drawn (``shard, rank, doc_id, size, pass``), shuffled within each shard."""
    each = repeated(draws, F.col("copies"), lambda k: k.alias("copy"))
    return each.repartition("shard").sortWithinPartitions("shard", "place", "copy").select("shard", "rank", "doc_id", "size", "pass")


def repeated(rows: DataFrame, times: Column, number: Callable[[Column], Column]) -> DataFrame:
    """Every row ``times`` times, numbered from 0; no array is longer than ``CHUNK`` and large counts spread over tasks."""
    chunks = rows.withColumn("_times", times).where("_times > 0").withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_times") - 1) / CHUNK)))).hint("rebalance")
    first = F.col("_chunk") * CHUNK
    return chunks.select("*", F.explode(F.sequence(first, F.least(first + CHUNK, F.col("_times")) - 1)).alias("_k")).select(
        *rows.columns, number(F.col("_k")))


def taken(docs: DataFrame, blocks_per_shard: int = 64) -> DataFrame:
    """One row per input row: ``doc_id, size, source_size, target, taken``, the words that all draws take of it."""
    plan, draws = mix(docs, blocks_per_shard)
    sums = draws.groupBy("rank", "doc_id", "size").agg(F.sum(F.floor(F.col("copies") / F.col("n"))).alias("passes"),
                                                       F.sum(F.col("copies") % F.col("n")).alias("extra"))
    sums = sums.select(F.col("rank").alias("r"), F.col("doc_id").alias("d"), F.col("size").alias("z"), "passes", "extra")
    same = (F.col("rank") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("size") == F.col("z"))
    rows = plan.join(sums, same, "left").select("doc_id", "size", "n", "source_size", "target", F.coalesce("passes", F.lit(0)).alias("passes"),
                                                F.coalesce("extra", F.lit(0)).alias("extra"))
    return repeated(rows, F.col("n"), lambda k: (F.col("size") * (F.col("passes") + (k < F.col("extra")).cast("long"))).alias("taken")).select(
        "doc_id", "size", "source_size", "target", "taken")
