"""Exact top-k search by no-random-access aggregation of sorted component lists."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import query, table

#: Vectors in one block: bounds the memory of a task (a block of 64 components is 2 MB as doubles).
BLOCK = 4096
#: Queries that one block of candidates meets at a time.
QUERY_BLOCK = 512
LONG = (-(1 << 63), (1 << 63) - 1)


BLOCKS = "ids binary, dims binary, comps binary"


def _packed(ids, vectors) -> pd.DataFrame:
    """One block as one row of bytes: identifiers, lengths, components end to end."""
    flat = np.concatenate([np.zeros(0), *[np.asarray(v, "float64") for v in vectors]])
    return pd.DataFrame({"ids": [np.asarray(ids, "int64").tobytes()], "comps": [flat.tobytes()],
                         "dims": [np.array([len(v) for v in vectors], "int32").tobytes()]})[["ids", "dims", "comps"]]


def _candidate_blocks(vectors: DataFrame) -> DataFrame:
    """The vectors of each partition in blocks of at most BLOCK rows."""
    def pack(batches):
        ids, held = [], []
        for pdf in batches:
            ids.extend(pdf["id"])
            held.extend(pdf["v"])
            while len(ids) >= BLOCK:
                yield _packed(ids[:BLOCK], held[:BLOCK])
                ids, held = ids[BLOCK:], held[BLOCK:]
        if ids:
            yield _packed(ids, held)

    return vectors.mapInPandas(pack, BLOCKS)


def _query_blocks(queries: DataFrame, blocks: int) -> DataFrame:
    """The queries dealt by a digest of the identifier into numbered blocks of about QUERY_BLOCK rows."""
    dealt = queries.withColumn("q_block", F.expr(f"pmod(xxhash64(id), {blocks}L)").cast("int"))
    return dealt.groupBy("q_block").applyInPandas(
        lambda pdf: _packed(pdf["id"], pdf["v"]).assign(q_block=pdf["q_block"].iloc[0]), BLOCKS + ", q_block int")


def _matrix(ids: bytes, dims: bytes, comps: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Identifiers and the vectors as rows, shorter ones filled up with zeros."""
    ids, dims, flat = np.frombuffer(ids, "int64"), np.frombuffer(dims, "int32"), np.frombuffer(comps)
    out = np.zeros((len(ids), width))
    out[np.repeat(np.arange(len(ids)), dims), np.arange(len(flat)) - np.repeat(np.cumsum(dims) - dims, dims)] = flat
    return ids, out


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of integer vectors as Python integers, for components beyond 2^53 together."""
    as_int = np.vectorize(int, otypes=[object])
    return as_int(q).dot(as_int(x).T) if q.size and x.size else np.zeros((len(q), len(x)), object)


def score_bounds(plus: np.ndarray, minus: np.ndarray, x: np.ndarray, top, bottom, low, high):
    """Bounds of all scores after the components of at least `top` and of at most `bottom` have been read."""
    upper = plus @ np.maximum(x, top).T + minus @ np.minimum(x, bottom).T
    lower = plus @ np.where(x >= top, x, low).T + minus @ np.where(x <= bottom, x, high).T
    return lower, upper


def scan_lists(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int):
    """The k best candidates of one block for each query, by reading sorted lists until bounds decide.

    List i holds the candidates sorted by component i. It is read from its top for a query whose
    weight i is positive, from its bottom otherwise. After depth t, a component not yet read lies
    between the last value read and the far end of the list, which bounds the score from both sides.
    A candidate whose upper bound is below the k-th lower bound is out. Reading goes on, to twice the
    depth, only for queries with more than k candidates left and over candidates that one of these has
    left. The candidates left are then scored, which is what reading the lists to their end gives.
    Where products may pass 2^53, all candidates are scored in whole numbers instead, without reading lists.
    Yields (query id, candidate ids, scores).
    """
    m, k = len(x), min(k, len(x))
    largest = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, x.shape[1])
    if largest >= 2.0 ** 53:  # doubles would round: the same answer from whole numbers
        for row, qi in zip(_exact(q, x), q_ids):
            keep = [j for j in range(m) if x_ids[j] != qi]
            keep = sorted(keep, key=lambda j: (-row[j], x_ids[j]))[:k]
            yield qi, x_ids[keep], np.array([min(max(row[j], LONG[0]), LONG[1]) for j in keep], "int64")
        return
    lists = np.sort(x, axis=0)
    low, high = lists[0], lists[-1]
    plus, minus = np.maximum(q, 0), np.minimum(q, 0)
    alive = q_ids[:, None] != x_ids[None, :]
    depth = max(1, m // 8)
    while depth < m:
        open_q = np.flatnonzero(alive.sum(axis=1) > k)
        if not len(open_q):
            break
        left = np.flatnonzero(alive[open_q].any(axis=0))
        lower, upper = score_bounds(plus[open_q], minus[open_q], x[left], lists[m - depth], lists[depth - 1], low, high)
        held = alive[np.ix_(open_q, left)]
        lower[~held] = -np.inf
        rank = np.partition(lower, len(left) - k, axis=1)[:, len(left) - k]
        alive[np.ix_(open_q, left)] = held & (upper >= rank[:, None])
        depth *= 2
    open_q = alive.sum(axis=1) > k
    left = np.flatnonzero(alive[open_q].any(axis=0))
    together = dict(zip(np.flatnonzero(open_q), q[open_q] @ x[left].T))
    for i in range(len(q)):
        keep = np.flatnonzero(alive[i])
        scores = together[i][np.searchsorted(left, keep)] if i in together else x[keep] @ q[i]
        best = np.lexsort((x_ids[keep], -scores))[:k]
        yield q_ids[i], x_ids[keep[best]], scores[best].astype("int64")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding",
          scale: float = 1024.0) -> DataFrame:
    """The k candidates of highest integer inner product for each query, other than itself.

    Components become floor(scale * x) with x as double. Queries and candidates are packed into
    blocks; each block of queries meets each block of candidates once, and only k rows per query and
    block go on to the final ranking, so no task holds more than two blocks.

    Vectors that are NULL or hold NULL or non-finite components, and rows without an identifier, take
    no part. Shorter vectors count as filled up with zeros. Ties go to the smaller identifier.
    Repeated candidate rows are ranked as often as they occur; repeated query rows count once.
    Scores beyond 64 bits are held at the limit.
    Returns query_id, rank (from 1), vec_id, score.
    """
    def clean(df):
        # No fractions from here on: floor of a double stays a double, exact for whole numbers.
        x = F.transform(F.col(vector).cast("array<double>"), lambda c: c * F.lit(float(scale)))
        ok = F.forall(F.col("v"), lambda c: F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False)))
        return (df.select(F.col(key).cast("long").alias("id"), x.alias("v"))
                .where(F.col("id").isNotNull() & F.col("v").isNotNull() & ok))

    def meet(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                width = max([1, *np.frombuffer(row.dims, "int32"), *np.frombuffer(row.q_dims, "int32")])
                x_ids, x = _matrix(row.ids, row.dims, row.comps, width)
                q_ids, q = _matrix(row.q_ids, row.q_dims, row.q_comps, width)
                found = list(scan_lists(np.floor(q), q_ids, np.floor(x), x_ids, k))
                yield pd.DataFrame({
                    "query_id": np.concatenate([np.full(len(i), a) for a, i, _ in found]).astype("int64"),
                    "vec_id": np.concatenate([i for _, i, _ in found]).astype("int64"),
                    "score": np.concatenate([s for _, _, s in found]).astype("int64")})

    wanted = clean(queries).dropDuplicates(["id"])
    blocks = max(1, -(-wanted.count() // QUERY_BLOCK))
    asked = _query_blocks(wanted, blocks).select("q_block", *[F.col(c).alias("q_" + c) for c in ("ids", "dims", "comps")])
    # A stated set of queries against all rows: every block of rows is sent to each block of queries.
    held = _candidate_blocks(clean(vectors)).withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    pairs = held.join(asked, "q_block").select("ids", "dims", "comps", "q_ids", "q_dims", "q_comps")
    best = pairs.repartition(F.xxhash64("ids", "q_ids")).mapInPandas(meet, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x : floor(1024 * x::DOUBLE)::HUGEINT) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x : x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p : p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


@query("op8_exact_top_k", ORACLE)
def op8(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))
