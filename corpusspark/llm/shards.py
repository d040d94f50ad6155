"""Shards by balanced label propagation.

Linked documents (members of one link group) move towards the shard where most of their group is.  Each round is a
few joins over the narrow table of memberships: votes are summed per (group, shard), every group names its best
shard, and the wishes are granted under quotas: a shard takes as many as its free places and what leaves it allow,
and which groups move is decided by a hash, so no list of movers is ordered anywhere.  A group larger than a
fraction of a shard is cut into pieces first.  At the end documents are laid out by (shard, group) and that order is
cut into equal runs: the counts are at most one apart, and every border cuts one group at most.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import ranked, uniform

ROUNDS = 6
#: A group piece holds at most this part of a shard.
PIECE = 0.125
#: Spare places of a shard while documents move.
SLACK = 0.02


def _grants(demand: list[tuple[int, int, int]], load: dict[int, int], capacity: float, shards: int) -> list[float]:
    """Part of the wishes each shard grants; ``demand`` (from, to, documents) has at most shards * shards rows."""
    flow, held = np.zeros((shards, shards)), np.array([load.get(s, 0) for s in range(shards)], float)
    for a, b, n in demand:
        flow[a, b] = n
    part = np.ones(shards)
    for _ in range(50):  # what leaves a shard depends on what the others grant
        leaves, wish = flow @ part, flow.sum(0)
        room = np.maximum(0, capacity - held + leaves)
        part = np.minimum(part, np.where(wish > 0, room / np.maximum(wish, 1), 1.0))
    return part.clip(0, 1).tolist()


def propagate(members: DataFrame, loads: DataFrame, total: int, shards: int, rounds: int = ROUNDS, seed: int = 0) -> DataFrame:
    """members (doc, group, piece, shard) after at most ``rounds`` rounds; loads (shard, n) of all documents."""
    capacity = total / shards * (1 + SLACK) + 1
    for turn in range(rounds):
        votes = members.groupBy("group", "piece", "shard").agg(F.count("*").alias("n"))
        best = F.max(F.struct("n", F.xxhash64("group", "piece", "shard", F.lit(turn)).alias("h"), F.col("shard").alias("s")))  # ties: another choice each round
        wishes = cut_lineage(votes.groupBy("group", "piece").agg(best.alias("b"), F.collect_list(F.struct("shard", "n")).alias("now")).select(
            "group", "piece", F.col("b.s").alias("to"), "now"))  # at most one entry per shard
        demand = [tuple(r) for r in wishes.select("to", F.explode("now").alias("v")).filter("v.shard <> to").groupBy("v.shard", "to").agg(
            F.sum("v.n")).collect()]  # at most shards * shards rows
        if not demand:
            break
        load = {r[0]: r[1] for r in loads.collect()}  # a row per shard
        grants = F.array(*[F.lit(g) for g in _grants(demand, load, capacity, shards)])
        granted = uniform(F.lit(seed), F.lit(turn), F.hex("group"), "piece") < F.element_at(grants, F.col("to") + 1)
        moves = cut_lineage(wishes.filter(granted & (F.size("now") > 1)).select("group", "piece", "to", "now"))
        out = moves.select(F.explode("now").alias("v"), "to").select(F.col("v.shard").alias("shard"), (-F.col("v.n")).alias("n"), "to", F.col("v.n").alias("m"))
        change = out.select("shard", "n").unionByName(out.select(F.col("to").alias("shard"), F.col("m").alias("n")))
        loads = cut_lineage(loads.unionByName(change).groupBy("shard").agg(F.sum("n").alias("n")))
        members = cut_lineage(members.join(moves.select("group", "piece", "to"), ["group", "piece"], "left").withColumn(
            "shard", F.coalesce("to", "shard")).drop("to"))
    return members


def assign_shards(docs: DataFrame, links: DataFrame, shards: int, rounds: int = ROUNDS, seed: int = 0) -> DataFrame:
    """docs (doc, ...) with shard and slot; links (doc, group): documents of one group are linked.

    ``doc`` identifies a row.  A document takes part in one group.  Law `rows`: shard counts at most one apart, slots
    gapless from 0.  Documents without links keep a hashed shard as their starting place.  Empty tables give none.
    """
    start = F.floor(uniform(F.lit(seed), "doc") * shards).cast("int")
    total = docs.count()
    placed = docs.withColumn("_first", start)
    loads = cut_lineage(placed.groupBy(F.col("_first").alias("shard")).agg(F.count("*").alias("n")))
    sizes = links.groupBy("group").agg(F.count("*").alias("n")).filter("n > 1")
    limit = max(1, int(total / shards * PIECE))
    pieces = F.pmod(F.xxhash64("doc"), F.ceil(F.col("n") / F.lit(limit))).cast("int")
    members = cut_lineage(links.join(sizes, "group").select("doc", "group", pieces.alias("piece"), start.alias("shard")))
    moved = propagate(members, loads, total, shards, rounds, seed)
    laid = placed.join(moved, "doc", "left").withColumn("shard", F.coalesce("shard", "_first")).drop("_first")
    order = ranked(laid, [F.col("shard"), F.col("group"), F.col("piece"), F.col("doc")], "_rank")
    exact = F.expr(f"CAST(_rank * {shards} DIV {max(total, 1)} AS INT)")
    first = F.expr(f"(shard * CAST({total} AS BIGINT) + {shards - 1}) DIV {shards}")
    return order.withColumn("shard", exact).withColumn("slot", F.col("_rank") - first).drop("_rank", "piece", "group")


def shard_documents(docs: DataFrame, shards: int, rounds: int = ROUNDS, seed: int = 0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; equal texts are linked.

    size: UTF-8 bytes of the text (null: none) plus 16.  Null ids, repeated rows and null texts are rows like any
    other: each gets its place; null and empty texts are one group.  Other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = cut_lineage(docs.select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.md5(text)).alias("key")).withColumn("doc", F.monotonically_increasing_id()))
    out = assign_shards(rows.drop("key"), rows.select("doc", F.col("key").alias("group")), shards, rounds, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long"),
                      F.lit(None).cast("int").alias("grown_shard"))
