"""Hard-negative mining with exact scores by the method of four Russians."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import query, stored, table

#: Vectors in one block of candidates; of anchors; and blocks of candidates in one slice.
BLOCK, ANCHORS, SLICE = 4096, 512, 8
#: Candidates and anchors scored together: a table of 8 components is 256 x 128 numbers and stays in cache.
TILE, TABLE = 512, 128
#: Components that share one table.
GROUP = 8
LONG = (-(1 << 63), (1 << 63) - 1)


def _whole(values: np.ndarray) -> np.ndarray:
    """Whole-valued doubles as 64-bit integers, or as Python integers where those do not suffice."""
    if values.size and np.abs(values).max() >= 2.0 ** 62:
        return np.vectorize(int, otypes=[object])(values)
    return values.astype("int64")


def _rows(flat: np.ndarray, dims: np.ndarray) -> np.ndarray:
    """Components end to end as the rows of a matrix whose width is a multiple of GROUP; zeros fill up."""
    width = -(-max(1, int(dims.max(initial=0))) // GROUP) * GROUP
    out = np.zeros((len(dims), width))
    out[np.repeat(np.arange(len(dims)), dims), np.arange(len(flat)) - np.repeat(np.cumsum(dims) - dims, dims)] = flat
    return out


def bit_planes(comps: np.ndarray) -> np.ndarray:
    """Bytes (plane, group, row): bit i of a byte is one binary digit of component i of a group of eight.

    Digits are those of the two's complement, lowest plane first; the last plane holds the signs.
    """
    n, width = comps.shape
    low, high = (int(comps.min()), int(comps.max())) if comps.size else (0, 0)
    planes = max((-1 - low).bit_length() if low < 0 else 0, high.bit_length() if high > 0 else 0) + 1
    digits = [((comps >> j) & 1).astype("uint8").reshape(n, width // GROUP, GROUP) for j in range(planes)]
    return np.ascontiguousarray(np.packbits(np.stack(digits), axis=-1, bitorder="little")[..., 0].transpose(0, 2, 1))


def subset_sums(comps: np.ndarray) -> np.ndarray:
    """Tables (group, 256, anchor): for each byte the sum of the components whose bits it has, by doubling."""
    n, width = comps.shape
    sums = np.zeros((width // GROUP, 1, n), comps.dtype)
    for i in range(GROUP):
        sums = np.concatenate((sums, sums + comps[:, i::GROUP].T[:, None, :]), axis=1)
    return sums


def scores(planes: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Inner products (row, anchor): a table lookup per byte, planes added from the signs down with a shift."""
    groups = min(planes.shape[1], len(tables))  # what one side lacks is zero
    out = np.zeros((planes.shape[2], tables.shape[2]), tables.dtype)
    part = np.empty_like(out)
    for j in range(len(planes) - 1, -1, -1):
        out += out
        for g in range(groups):
            np.take(tables[g], planes[j, g], axis=0, out=part, mode="clip")
            if j == len(planes) - 1:
                out -= part
            else:
                out += part
    return out


def _packed(rows: pd.DataFrame) -> pd.DataFrame:
    """One block as one row: identifiers in ascending order, labels, components end to end."""
    rows = rows.sort_values("id", kind="stable")
    dims = np.array([len(v) for v in rows["v"]], "int32")
    flat = np.concatenate([np.zeros(0), *[np.asarray(v, "float64") for v in rows["v"]]])
    return pd.DataFrame({"ids": [rows["id"].to_numpy("int64").tobytes()], "labels": [rows["label"].to_numpy("int64").tobytes()],
                         "dims": [dims.tobytes()], "comps": [flat.tobytes()]})


def candidate_index(vectors: DataFrame) -> DataFrame:
    """The vectors of each partition in blocks of at most BLOCK rows, with their components as bit planes."""
    def pack(batches):
        def block(rows):
            rows = rows.sort_values("id", kind="stable")
            dims = np.array([len(v) for v in rows["v"]], "int32")
            comps = _whole(_rows(np.concatenate([np.zeros(0), *[np.asarray(v, "float64") for v in rows["v"]]]), dims))
            planes = bit_planes(comps)
            return pd.DataFrame({
                "ids": [rows["id"].to_numpy("int64").tobytes()], "labels": [rows["label"].to_numpy("int64").tobytes()],
                "planes": [planes.tobytes()], "n_planes": [len(planes)], "largest": [float(np.abs(comps).max(initial=0))]})

        held = None
        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            while len(held) >= BLOCK:
                yield block(held.iloc[:BLOCK])
                held = held.iloc[BLOCK:].reset_index(drop=True)
        if held is not None and len(held):
            yield block(held)

    return vectors.mapInPandas(pack, "ids binary, labels binary, planes binary, n_planes int, largest double")


def _scored(row, anchors: np.ndarray, at: np.ndarray):
    """Bit planes of a block of candidates, and the function that scores some of them with the anchors `at`."""
    n = len(row.ids) // 8
    planes = np.frombuffer(row.planes, "uint8").reshape(row.n_planes, -1, n)
    bound = float(np.abs(anchors).max(initial=0)) * row.largest * max(1, planes.shape[1] * GROUP)
    # The scores are multiplied by 100 later on. Tables of narrow numbers where nothing can overflow.
    kind = np.int32 if bound < 2.0 ** 30 else np.int64 if bound < 2.0 ** 55 else object
    tables = subset_sums(anchors[at].astype(kind))

    def of(rows: np.ndarray) -> np.ndarray:
        parts = [scores(np.ascontiguousarray(planes[:, :, rows[lo:lo + TILE]]), tables) for lo in range(0, len(rows), TILE)]
        out = np.concatenate(parts) if parts else np.zeros((0, len(at)), kind)
        return np.ascontiguousarray(out.T)

    return of


def _held(x) -> int:
    return min(max(int(x), LONG[0]), LONG[1])


def _best_same(row, k: int):
    """Of one pair of blocks: for each anchor its k best other rows with the same label."""
    ids, labels = np.frombuffer(row.ids, "int64"), np.frombuffer(row.labels, "int64")
    a_ids, a_labels = np.frombuffer(row.a_ids, "int64"), np.frombuffer(row.a_labels, "int64")
    anchors = _whole(_rows(np.frombuffer(row.a_comps), np.frombuffer(row.a_dims, "int32")))
    for label in np.unique(a_labels):
        rows = np.flatnonzero(labels == label)
        who = np.flatnonzero(a_labels == label)
        for lo in range(0, len(who) if len(rows) else 0, TABLE):
            at = who[lo:lo + TABLE]
            s = _scored(row, anchors, at)(rows)
            order = np.argsort(-s, axis=1, kind="stable")[:, :k + 1]  # rows lie by identifier: ties are right
            for i, a in enumerate(at):
                best = [j for j in order[i] if ids[rows[j]] != a_ids[a]]
                if len(best) < min(k, len(rows)) and len(rows) > k + 1:  # the anchor's identifier occurs more than once
                    best = [j for j in np.argsort(-s[i], kind="stable") if ids[rows[j]] != a_ids[a]]
                for j in best[:k]:
                    yield int(a_ids[a]), int(ids[rows[j]]), _held(s[i, j])


def _best_other(row, k: int, low: int, high: int):
    """Of one pair of blocks: for each anchor and positive the first k rows of other labels in its score band."""
    ids, labels = np.frombuffer(row.ids, "int64"), np.frombuffer(row.labels, "int64")
    a_ids, a_labels = np.frombuffer(row.a_ids, "int64"), np.frombuffer(row.a_labels, "int64")
    anchors = _whole(_rows(np.frombuffer(row.a_comps), np.frombuffer(row.a_dims, "int32")))
    positives = [[(p["nth"], p["score"]) for p in ps] for ps in row.positives]
    asked = np.flatnonzero([len(p) > 0 for p in positives])
    everyone = np.arange(len(ids))
    for lo in range(0, len(asked), TABLE):
        at = asked[lo:lo + TABLE]
        s = _scored(row, anchors, at)(everyone)
        for i, a in enumerate(at):
            other = np.flatnonzero((labels != a_labels[a]) & (ids != a_ids[a]))
            fall = -s[i, other]
            order = np.argsort(fall, kind="stable")
            fall = fall[order]
            for nth, score in positives[a]:
                first = int(np.searchsorted(fall, -(high * score // 100), "left"))
                for j in range(first, min(first + k, len(fall))):
                    if 100 * -int(fall[j]) < low * score:
                        break
                    yield int(a_ids[a]), nth, int(ids[other[order[j]]]), _held(-fall[j])


def hard_negatives(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
                   key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: float = 256.0) -> DataFrame:
    """For each anchor and each of its best rows of the same label, the first rows of other labels that score
    between `low` and `high` percent of it.

    Components become floor(scale * x) with x as double; scores are integer inner products, exact up
    to 64 bits and held at their limits beyond, a positive's before its negatives are sought. Candidates are packed once into blocks of bit planes
    and written to the shared folder. A task pairs a block of anchors with a slice of candidate blocks:
    it sums the anchor's components for all 256 subsets of each group of eight, looks each plane's bytes up in
    those tables, and adds the planes with a shift. A first round scores pairs with equal labels, a second
    one, given the positives, all pairs; each hands on at most a few rows per anchor and block. No
    task holds more than one block of each side, whatever label or key is frequent.

    Rows whose identifier, label or vector is NULL, or whose vector holds NULL or non-finite components
    (also after scaling), take no part. Shorter vectors count as filled up with zeros. Ties go to the
    smaller identifier. Rows with the anchor's identifier are never its positives or negatives. Other
    repeated rows count as often as they occur; of several anchor rows with one identifier the one with
    the smallest label, then vector, is the anchor. Empty tables give no rows.
    Returns anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.
    """
    spark = vectors.sparkSession

    def clean(df):
        # No fractions from here on: floor of a double stays a double, exact for whole numbers.
        x = F.transform(F.col(vector).cast("array<double>"), lambda c: c * F.lit(float(scale)))
        ok = F.forall(F.col("v"), lambda c: F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False)))
        return (df.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), x.alias("v"))
                .where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ok))

    def floored(batches):
        for pdf in batches:
            yield pdf.assign(v=[np.floor(v) for v in pdf["v"]])

    index = stored(candidate_index(clean(vectors).mapInPandas(floored, "id long, label long, v array<double>")), "bit-planes")
    slices = max(1, -(-index.count() // SLICE))
    index = index.withColumn("slice", F.expr(f"pmod(xxhash64(ids), {slices}L)").cast("int"))

    wanted = clean(anchors).groupBy("id").agg(F.min(F.struct("label", "v")).alias("a")).select("id", "a.label", "a.v")
    blocks = max(1, -(-wanted.count() // ANCHORS))
    dealt = wanted.withColumn("a_block", F.expr(f"pmod(xxhash64(id), {blocks}L)").cast("int"))
    names = "ids binary, labels binary, dims binary, comps binary"
    asked = stored(dealt.mapInPandas(floored, "id long, label long, v array<double>, a_block int").groupBy("a_block").applyInPandas(
        lambda pdf: _packed(pdf).assign(a_block=pdf["a_block"].iloc[0]), names + ", a_block int"), "anchors")
    asked = asked.select("a_block", *[F.col(c).alias("a_" + c) for c in ("ids", "labels", "dims", "comps")])

    width = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def cells(side):
        """Each slice of candidates with each block of anchors: a stated query set against all rows."""
        held = index.withColumn("a_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        side = side.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
        return held.repartition(width, "a_block", "slice").join(side.repartition(width, "a_block", "slice"), ["a_block", "slice"])

    def same(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                yield pd.DataFrame(list(_best_same(row, positives)), columns=["a", "p", "score"]).astype("int64")

    best = Window.partitionBy("a").orderBy(F.desc("score"), "p")
    found = (cells(asked).mapInPandas(same, "a long, p long, score long").withColumn("nth", F.row_number().over(best))
             .where(F.col("nth") <= positives))
    found = stored(found, "positives")

    # The positives of a block's anchors, in the order of its identifiers.
    theirs = found.groupBy("a").agg(F.collect_list(F.struct("nth", "score")).alias("ps"))
    ids = dealt.select("a_block", F.col("id").alias("a")).join(theirs, "a", "left")
    none = F.array().cast("array<struct<nth:int,score:bigint>>")
    lists = ids.groupBy("a_block").agg(F.array_sort(F.collect_list(F.struct("a", F.coalesce("ps", none).alias("ps")))).alias("l"))
    armed = asked.join(lists.select("a_block", F.col("l.ps").alias("positives")), "a_block")

    def other(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                yield pd.DataFrame(list(_best_other(row, negatives, low, high)), columns=["a", "nth", "negative_id", "negative_score"]).astype("int64")

    first = Window.partitionBy("a", "nth").orderBy(F.desc("negative_score"), "negative_id")
    mined = (cells(armed).mapInPandas(other, "a long, nth long, negative_id long, negative_score long")
             .withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= negatives))
    return mined.join(found.select("a", F.col("nth").cast("long").alias("nth"), "p", "score"), ["a", "nth"]).select(
        F.col("a").alias("anchor_id"), F.col("p").alias("positive_id"), F.col("rank").cast("int").alias("rank"), "negative_id",
        F.col("score").alias("positive_score"), "negative_score")


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x : floor(256 * x::DOUBLE)::HUGEINT) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x : x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS a, c.vec_id AS c, a.label = c.label AS same,
    list_sum(list_transform(list_zip(a.e, c.e), lambda p : p[1] * p[2]))::HUGEINT AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0
), p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, c) AS nth FROM s WHERE same) WHERE nth <= 5
), n AS (
  SELECT p.a, p.c AS positive_id, p.score AS positive_score, s.c AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.a, p.nth ORDER BY s.score DESC, s.c)::INTEGER AS rank
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
)
SELECT a AS anchor_id, positive_id, rank, negative_id, positive_score::BIGINT AS positive_score, negative_score::BIGINT AS negative_score
FROM n WHERE rank <= 3
"""


@query("op11_hard_negatives", ORACLE)
def op11(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)"))
    return hard_negatives(vectors, vectors.where("vec_id % 50 = 0"))
