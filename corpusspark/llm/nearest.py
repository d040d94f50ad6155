"""Approximate nearest neighbours by multi-index hashing, for the largest inner product.

Vectors get one more component that makes their lengths equal (the largest inner product is then the nearest angle),
are centred, and turned into binary codes by learned rotations (principal axes, then rotations that bring the data
close to the corners of the cube).  A code is cut into substrings, each indexed by value.  By the pigeonhole principle
a code within the radius of the query's has a substring within that substring's share of the radius, so probing the
substring indexes retrieves every code within the radius; those are ranked by their original vectors.  Rotations and
radius are learned on a bounded sample (``FIT_ROWS``); the index holds every different vector.

Work is laid out in cells: a block of the index and a block of the queries, joined by the cell's number.  Equal vectors
are one entry of the index with their smallest ids, so a vector that a third of the rows share is one row of work.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage

FIT_ROWS, FIT_QUERIES, TURNS = 4096, 256, 30
BITS, PART = 256, 32
#: The radius holds this share of the sample's true neighbours.
COVER = 0.97
INDEX_BLOCK, QUERY_BLOCK = 4096, 2048


@dataclass
class Codes:
    """Centre, length of the longest vector, axes (one column per bit), radius, share of the radius per substring."""

    centre: np.ndarray
    longest: float
    axes: np.ndarray
    radius: int
    shares: list[int]

    def lifted(self, x: np.ndarray, query: bool) -> np.ndarray:
        x = x / self.longest
        rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(1)))
        return np.concatenate([x, rest[:, None]], 1)

    def bits(self, x: np.ndarray, query: bool) -> np.ndarray:
        """(rows, substrings) of 32-bit words."""
        signs = (self.lifted(x, query) - self.centre) @ self.axes > 0
        return np.packbits(signs, axis=1, bitorder="little").view("<u4")


def _shares(radius: int, parts: int) -> list[int]:
    """Shares r_j with sum(r_j + 1) = radius + 1: a code within the radius is within r_j in some substring j."""
    left = max(radius + 1 - parts, 0)
    return [left // parts + (j < left % parts) for j in range(parts)]


def learn(sample: np.ndarray, longest: float, bits: int = BITS, k: int = 20, cover: float = COVER, seed: int = 0) -> Codes:
    rng = np.random.default_rng(seed)
    codes = Codes(np.zeros(sample.shape[1] + 1), longest, np.zeros((sample.shape[1] + 1, bits)), bits, [])
    data = codes.lifted(sample, False)
    codes.centre = data.mean(0)
    z = data - codes.centre
    spread, axes = np.linalg.eigh(z.T @ z / len(z))
    axes = axes[:, ::-1][:, spread[::-1] > 1e-9 * max(spread.max(), 1e-30)]
    if axes.shape[1] == 0:
        axes = np.eye(z.shape[1])[:, :1]
    flat = z @ axes
    turned = []
    while sum(t.shape[1] for t in turned) < bits:  # rotations from different starts, until there are enough bits
        rotation = np.linalg.qr(rng.normal(size=(axes.shape[1],) * 2))[0]
        for _ in range(TURNS):
            u, _, vt = np.linalg.svd(np.where(flat @ rotation > 0, 1.0, -1.0).T @ flat)
            rotation = (u @ vt).T
        turned.append(axes @ rotation)
    codes.axes = np.concatenate(turned, 1)[:, :bits]
    asked = rng.permutation(len(sample))[:FIT_QUERIES]
    own, words = codes.bits(sample[asked], True), codes.bits(sample, False)
    apart = np.bitwise_count(own[:, None] ^ words[None]).sum(2, dtype=np.int64)
    near = sample[asked] @ sample.T
    near[np.arange(len(asked)), asked] = -np.inf
    top = np.argsort(-near, axis=1)[:, : min(k, max(len(sample) - 1, 1))]
    codes.radius = int(np.quantile(np.take_along_axis(apart, top, 1), cover, method="higher"))
    codes.shares = _shares(codes.radius, bits // PART)
    return codes


def index_of(words: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per substring: its different values, and which of them each row has."""
    return [np.unique(words[:, j], return_inverse=True) for j in range(words.shape[1])]


def retrieve(codes: Codes, queries: np.ndarray, words: np.ndarray, index: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of all code pairs within the radius, found by probing every substring's index.

    The radius is too large for listing the values near a query's substring, so a probe compares it with the values
    that the index has.
    """
    hit = np.zeros((len(queries), len(words)), bool)
    for j, (share, (values, where)) in enumerate(zip(codes.shares, index, strict=True)):
        hit |= (np.bitwise_count(queries[:, j, None] ^ values[None]) <= share)[:, where]
    q, v = np.nonzero(hit)
    inside = np.bitwise_count(queries[q] ^ words[v]).sum(1, dtype=np.int64) <= codes.radius
    return q[inside], v[inside]


def _best(codes: Codes, queries: np.ndarray, vectors: np.ndarray, rep: np.ndarray, keep: int, chunk: int = 64):
    """(query, row, score) of the ``keep`` largest inner products per query among what is retrieved; ties to smaller rep."""
    own, words = codes.bits(queries, True), codes.bits(vectors, False)
    index = index_of(words)
    for a in range(0, len(queries), chunk):
        q, v = retrieve(codes, own[a : a + chunk], words, index)
        score = np.einsum("ij,ij->i", queries[a + q], vectors[v])
        order = np.lexsort((rep[v], -score, q))
        q, v, score = q[order], v[order], score[order]
        top = np.arange(len(q)) - np.searchsorted(q, q) < keep
        yield a + q[top], v[top], score[top]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64).reshape(len(column), -1)


def _cell(codes: Codes, keep: int):
    def run(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        names = ["query_key", "key", "rep", "score"]
        if not len(index) or not len(queries):
            return pd.DataFrame(columns=names)
        rep, key, asked = index["rep"].to_numpy(), index["key"].to_numpy(), queries["query_key"].to_numpy()
        found = [pd.DataFrame({"query_key": asked[q], "key": key[v], "rep": rep[v], "score": s})
                 for q, v, s in _best(codes, _matrix(queries["vector"]), _matrix(index["vector"]), rep, keep)]
        return pd.concat(found, ignore_index=True)[names]

    return run


def _answers(codes: Codes, reps: DataFrame, queries: DataFrame, ids: DataFrame, k: int, blocks: int, groups: int) -> DataFrame:
    """(query_key, vec_id, score): the k + 1 nearest rows within the radius of each different query vector."""
    place = lambda n, salt, key: F.pmod(F.xxhash64(F.lit(salt), key), F.lit(n)).cast("int")
    index = reps.select("key", "rep", "vector", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), place(blocks, 1, "key").alias("b"))
    asked = queries.select("query_key", "vector", place(groups, 2, "query_key").alias("g"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))
    found = index.groupBy("b", "g").cogroup(asked.groupBy("b", "g")).applyInPandas(_cell(codes, k + 1), "query_key string, key string, rep long, score double")
    best = W.partitionBy("query_key").orderBy(F.desc("score"), "rep")
    classes = found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1).drop("n", "rep")
    # equal vectors share their answer: at most k + 1 classes of at most k + 1 ids, cut to k + 1 before the queries' own ids
    answer = W.partitionBy("query_key").orderBy(F.desc("score"), "vec_id")
    return cut_lineage(classes.join(ids, "key").withColumn("n", F.row_number().over(answer)).filter(F.col("n") <= k + 1).drop("n", "key"))


def search(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query, nearest first, ties to the smaller id.

    ``is_query``: condition on ``vectors`` naming the queries.  A query's own id is no candidate.  Vectors that are null,
    zero, or hold null or non-finite components take no part, nor do those without an id or of another length than
    most; rows that repeat id and vector count once.  Queries that find fewer than k ask again with wider radii, so fewer
    rows mean that there are no more candidates.
    """
    value = F.col(vector_col)
    sound = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(value, lambda x: x != 0)
    good = vectors.filter(F.col(id_col).isNotNull() & value.isNotNull() & sound)
    usual = good.groupBy(F.size(value).alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not usual:
        return vectors.sparkSession.createDataFrame([], schema)
    plain = F.transform(value, lambda x: x.cast("double"))
    rows = cut_lineage(good.filter(F.size(value) == usual[0]["n"]).select(
        F.col(id_col).cast("long").alias("id"), plain.alias("vector"), is_query.alias("query"),
        F.md5(F.array_join(F.transform(plain, lambda x: x.cast("string")), ",")).alias("key")))
    reps = cut_lineage(rows.groupBy("key").agg(F.min("id").alias("rep"), F.first("vector").alias("vector"), F.max("query").alias("query")))
    count, asked = reps.agg(F.count("*"), F.count(F.when(F.col("query"), 1))).first()
    longest = reps.select(F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)))).first()[0]
    sample = reps.orderBy(F.xxhash64("key"), "key").limit(FIT_ROWS).select("vector").toPandas()
    codes = learn(_matrix(sample["vector"]), longest, k=k)
    blocks = -(-count // INDEX_BLOCK)
    members = W.partitionBy("key").orderBy("id")
    ids = rows.dropDuplicates(["id", "key"]).withColumn("n", F.row_number().over(members)).filter(F.col("n") <= k + 1).select("key", F.col("id").alias("vec_id"))
    ids = cut_lineage(ids)
    enough = min(k + 1, ids.count())
    queries, answers = reps.filter("query").select(F.col("key").alias("query_key"), "vector"), None
    while asked:
        found = _answers(codes, reps, queries, ids, k, blocks, max(1, -(-asked // QUERY_BLOCK)))
        full = found.groupBy("query_key").count().filter(F.col("count") >= (0 if codes.radius >= BITS else enough)).select("query_key")
        done = found.join(full, "query_key", "left_semi")
        answers = done if answers is None else answers.unionByName(done)
        queries = cut_lineage(queries.join(full, "query_key", "left_anti"))  # far from all others: again with a wider radius
        asked = 0 if codes.radius >= BITS else queries.count()
        codes.radius = min(BITS, codes.radius + BITS // 8)
        codes.shares = _shares(codes.radius, BITS // PART)
    if answers is None:
        return vectors.sparkSession.createDataFrame([], schema)
    whose = rows.filter("query").select(F.col("id").alias("query_id"), F.col("key").alias("query_key")).distinct()
    ranked = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return whose.join(answers, "query_key").filter("vec_id <> query_id").withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
