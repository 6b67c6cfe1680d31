"""Batch admission under two unique keys (WIN-02, PIP-05, PIP-06, SNK-01, SNK-02).

Sequential semantics: candidates are processed in ``seq`` order and one is
accepted unless an *accepted* earlier one (or the store) already holds its
key ``(datastack, name, mat_version, revision)`` (NULL versions equal) or its
URI.  Rejected rows never block later rows.

That is the greedy maximal matching in arrival order on the bipartite graph
key -- URI.  It is computed exactly in rounds (Blelloch, Fineman, Shun, SPAA
2012): among undecided rows, accept every row that holds the smallest ``seq``
of both its key group and its URI group; drop undecided rows sharing a key or
URI with a row just accepted; repeat until nothing is undecided.  Every round
accepts at least the smallest undecided ``seq``, so it terminates; random
inputs need a handful of rounds.  After the first rounds, chains of conflicts
are settled whole by pointer doubling, in logarithmically many joins.  Group minima are grouped aggregations
(partial aggregation map-side, so a hot key costs one small row per task) and
each round's state is cut from its lineage with a reliable ``checkpoint()``
in the cluster's checkpoint folder, so a lost executor only recomputes one round.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from . import checks as CK


def key_column() -> Column:
    """Join-safe text form of the key: NULL version is its own value."""
    mv = F.coalesce(F.col("mat_version").cast("string"), F.lit("\u0000"))
    return F.concat_ws("\u0001", F.col("datastack"), F.col("name"), mv, F.coalesce(F.col("revision"), F.lit(0)).cast("string"))


#: Rounds without pointer doubling: they settle most of what collides, and chains are what is left.
PLAIN_ROUNDS = 6


def _two_smallest(undecided: DataFrame, group: str) -> DataFrame:
    """``group, first, second``: the two smallest ``seq`` of each group (second NULL if there is one); a task keeps two rows a group."""
    place = F.row_number().over(Window.partitionBy(group).orderBy("seq"))
    two = undecided.select(group, "seq").withColumn("n", place).where("n <= 2")
    return two.groupBy(group).agg(F.min("seq").alias("first"), F.max(F.when(F.col("n") == 2, F.col("seq"))).alias("second"))


def _doubled(ways: DataFrame) -> DataFrame:
    """Pointers ``(seq, at, odd)`` followed by the pointers they lead to; ``moved`` where there was one."""
    on = ways.select(F.col("seq").alias("_at"), F.col("at").alias("_to"), F.col("odd").alias("_odd"))
    joined = ways.join(on, F.col("at") == F.col("_at"), "left")
    return joined.select("seq", F.coalesce("_to", "at").alias("at"), (F.col("odd") != F.coalesce("_odd", F.lit(False))).alias("odd"),
                         F.col("_to").isNotNull().alias("moved"))


def _settle_chains(undecided: DataFrame) -> tuple[DataFrame, int]:
    """``(seq of accepted rows, doubling steps)``: rows that nothing precedes, and what follows from them along chains.

    A row with one earlier neighbour (second in one of its groups, first in the other) is accepted exactly if that
    neighbour is not.  Each such row points to its neighbour; the pointers are doubled until they end, so a chain of k
    rows takes log k joins, and the parity of the distance to a row that nothing precedes decides.  Chains that end in a
    row with several earlier neighbours stay undecided in this round.
    """
    k, u = (_two_smallest(undecided, c).checkpoint() for c in ("kkey", "uri"))
    pair = lambda t, name: t.select(*[F.col(c).alias(f"{name}_{c}") for c in ("first", "second")])
    k, u = pair(k, "k"), pair(u, "u")
    roots = k.join(u, F.col("k_first") == F.col("u_first")).select(F.col("k_first").alias("seq"))
    ways = (k.join(u, F.col("k_second") == F.col("u_first")).select(F.col("k_second").alias("seq"), F.col("k_first").alias("at"))
            .unionByName(u.join(k, F.col("u_second") == F.col("k_first")).select(F.col("u_second").alias("seq"), F.col("u_first").alias("at"))))
    ways, steps = ways.withColumn("odd", F.lit(True)).checkpoint(), 0
    while True:
        ways = _doubled(_doubled(ways)).checkpoint()  # a step follows four times the distance
        steps += 1
        if ways.where("moved").isEmpty():
            break
    even = ways.where(~F.col("odd")).join(roots.withColumnRenamed("seq", "_root"), F.col("at") == F.col("_root"), "left_semi").select("seq")
    return roots.unionByName(even), steps


def greedy_accept(eligible: DataFrame) -> tuple[DataFrame, int]:
    """Rows of ``eligible(seq, kkey, uri)`` accepted by the sequential rule; returns (accepted, rounds and doubling steps)."""
    spark = eligible.sparkSession
    ensure_checkpoint_dir(spark)
    undecided = eligible.select("seq", "kkey", "uri").checkpoint()
    accepted_parts: list[DataFrame] = []
    rounds = 0
    while not undecided.isEmpty():
        rounds += 1
        if rounds <= PLAIN_ROUNDS:
            # the smallest seq of each key group and of each URI group; a seq that is both is accepted.
            # Joining the two (small) group tables on seq avoids joining them back to every row.
            mk = undecided.groupBy("kkey").agg(F.min("seq").alias("seq"))
            mu = undecided.groupBy("uri").agg(F.min("seq").alias("seq"))
            acc = mk.join(mu, "seq").select("seq", "kkey", "uri")
        else:
            settled, steps = _settle_chains(undecided)
            rounds += steps
            acc = undecided.join(settled, "seq", "left_semi")
        # kept (memory, spilling to disk) for the final union; if lost it is recomputed
        # from the checkpointed round state
        acc = acc.persist(StorageLevel.MEMORY_AND_DISK)
        accepted_parts.append(acc)
        undecided = (undecided.join(acc.select("kkey"), "kkey", "left_anti")
                     .join(acc.select("uri"), "uri", "left_anti").checkpoint())
    if not accepted_parts:
        return eligible.select("seq", "kkey", "uri").limit(0), 0
    out = accepted_parts[0]
    for p in accepted_parts[1:]:
        out = out.unionByName(p)
    out = out.checkpoint()
    for p in accepted_parts:
        p.unpersist()
    return out, rounds


def admit(cands: DataFrame, assets: DataFrame, gate_status: str = "gate_status",
          content_status: str = "content_status", batch: int | str | None = None) -> tuple[DataFrame, int]:
    """Label each candidate with ``admission_status`` and the id it collides with.

    Stage order of a single registration: ``gate_status`` (request and permission
    checks, NULL = passed), then key conflict, then URI conflict (store or an
    accepted earlier candidate), then ``content_status`` (content, kind and
    extraction checks, NULL = passed), else ``created``.  Both status columns
    depend only on the row itself.  New ids are ``new-<batch>-<seq>`` (``new-<seq>`` without a batch), so the
    batches of one store must be told apart by ``batch``.  Returns (labelled candidates, rounds)."""
    prefix = F.lit("new-" if batch is None else f"new-{batch}-")
    # used twice (eligibility and labelling): cut here instead of re-joining the store; nothing stays cached
    ensure_checkpoint_dir(cands.sparkSession)
    # by URI first: registration's last checks join by URI as well
    c = CK.find_duplicate(CK.find_by_uri(cands, assets), assets).withColumn("kkey", key_column()).checkpoint()
    eligible = c.where(F.col(gate_status).isNull() & F.col(content_status).isNull()
                       & F.col("dup_id").isNull() & F.col("uri_dup_id").isNull() & F.col("uri").isNotNull())
    accepted, rounds = greedy_accept(eligible)
    by_key = accepted.select("kkey", F.col("seq").alias("_k_seq"))
    by_uri = accepted.select("uri", F.col("seq").alias("_u_seq"))
    j = c.join(by_key, "kkey", "left").join(by_uri, "uri", "left")
    key_hit = F.coalesce(F.col("_k_seq") < F.col("seq"), F.lit(False))
    uri_hit = F.coalesce(F.col("_u_seq") < F.col("seq"), F.lit(False))
    gate, content = F.col(gate_status), F.col(content_status)
    status = (
        F.when(gate.isNotNull(), gate)
        .when(F.col("dup_id").isNotNull() | key_hit, F.lit("duplicate"))
        .when(F.col("uri_dup_id").isNotNull() | uri_hit, F.lit("duplicate_uri"))
        .when(content.isNotNull(), content)
        .when(F.col("_k_seq") == F.col("seq"), F.lit("created"))
    )
    existing = (
        F.when(gate.isNotNull(), F.lit(None).cast("string"))
        .when(F.col("dup_id").isNotNull(), F.col("dup_id"))
        .when(key_hit, F.concat(prefix, F.col("_k_seq").cast("string")))
        .when(F.col("uri_dup_id").isNotNull(), F.col("uri_dup_id"))
        .when(uri_hit, F.concat(prefix, F.col("_u_seq").cast("string")))
    )
    out = j.withColumn("admission_status", status).withColumn("existing_id", existing).withColumn(
        "new_id", F.when(status == "created", F.concat(prefix, F.col("seq").cast("string"))))
    return out.drop("_k_seq", "_u_seq", "kkey"), rounds


def to_asset_rows(created: DataFrame, now, table: bool = False) -> DataFrame:
    """Accepted candidates as asset rows: fresh id, owner = requesting user, created now."""
    ts = now if isinstance(now, Column) else F.lit(now).cast("timestamp")
    base = created.select(
        F.col("new_id").alias("id"), "datastack", "name", "mat_version", F.coalesce("revision", F.lit(0)).alias("revision"),
        "uri", "format", (F.lit("table") if table else F.col("asset_type")).alias("asset_type"),
        F.col("user_id").alias("owner"), F.coalesce("is_managed", F.lit(False)).alias("is_managed"),
        F.coalesce("mutability", F.lit("static")).alias("mutability"), F.coalesce("maturity", F.lit("stable")).alias("maturity"),
        F.coalesce(F.when(F.try_parse_json("properties").isNotNull(), F.col("properties")), F.lit("{}")).alias("properties"),
        "access_group", ts.alias("created_at"), "expires_at",
        *([c for c in ("source", "cached_metadata", "column_annotations") if c in created.columns]),
    )
    if table:
        base = base.withColumn("metadata_cached_at", ts)
    return base
