"""How far the sources of each language differ in their terms, by cells of a three-dimensional cube."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import rolling as R
from .common import query, stored, table

#: A term is kept where at least so many documents of the language have it.
LEAST_DOCS = 10
#: Scale of the smoothed shares.
UNIT = 1_000_000_000
#: Groups in a block, and terms in a block on average: a cell works on two dense slices of these sizes.
GROUPS, TERMS = 32, 2048
#: Different (group, term) counts that a task holds before it hands them on.
HELD = 200_000
#: Bytes of one text that are split at a time.
PIECE = 1 << 22
#: Capital letters to small ones, everything that no term contains to a space.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term in every group, summed per task only.

    The text is worked on as UTF-8 bytes, in which terms are the runs of letters and of bytes from 128 on.
    A long text is split piece by piece at a byte that no term contains.
    """
    names = ["lang", "source", "term", "n", "docs"]

    def pieces(raw):
        at = 0
        while at < len(raw):
            end = min(at + PIECE, len(raw))
            while end < len(raw) and LETTERS[raw[end]] != 32:
                end += 1
            yield raw[at:end].translate(LETTERS).split()
            at = end

    def out(count, seen):
        rows = [(*g, t, n, seen[g][t]) for g, terms in count.items() for t, n in terms.items()]
        cols = list(zip(*rows)) or [[]] * 5
        kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
        arrays = [pa.array(c, k) for c, k in zip(cols, kinds)]
        arrays[2] = arrays[2].cast(pa.string())
        return pa.RecordBatch.from_arrays(arrays, names)

    def work(batches):
        count, seen, size = {}, {}, 0
        for batch in batches:
            data, at = R.text_column(batch, "t")
            langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
            for i in range(len(langs)):
                g = langs[i], sources[i]
                own = set()
                for some in pieces(data[at[i]:at[i + 1]].tobytes()):
                    if some:
                        terms = count.setdefault(g, Counter())
                        size -= len(terms)
                        terms.update(some)
                        size += len(terms)
                        own.update(some)
                if own:
                    seen.setdefault(g, Counter()).update(own)
                if size > HELD:
                    yield out(count, seen)
                    count, seen, size = {}, {}, 0
        yield out(count, seen)

    rows = docs.select("lang", "source", "t")
    return rows.mapInArrow(work, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n, total, terms):
    """Smoothed share of a count in whole UNITs, plus 1; a decimal numerator, so no count is too large."""
    whole = (F.lit(UNIT).cast("decimal(10,0)") * (n + 2).cast("decimal(20,0)")).alias("x")
    return F.expr("1") + F.call_function("div", whole, (total + 2 * terms).cast("decimal(20,0)"))


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)); shares are at most UNIT + 1, so squares fit into 64 bits."""
    return (p - q) ** 2 // (p + q)


def _dense(cell, side: str, terms: int) -> np.ndarray:
    """Shares (group, term) of one slice: a count of 0 where the slice has no entry."""
    totals = [int(x) for x in cell[f"{side}_totals"]]
    counts = np.zeros((len(totals), terms), "int64")
    if cell[f"{side}_cells"] is not None:
        g, t, n = (np.frombuffer(b, k) for b, k in zip(cell[f"{side}_cells"], ("int32", "int32", "int64")))
        counts[g, t] = n
    out = np.empty_like(counts)
    for i, total in enumerate(totals):
        below = total + 2 * int(cell["vocabulary"])
        if counts[i].max(initial=0) < (1 << 62) // UNIT:
            out[i] = 1 + UNIT * (counts[i] + 2) // below
        else:
            out[i] = [1 + UNIT * (int(n) + 2) // below for n in counts[i]]
    return out


def _numbered(df: DataFrame, by: list[str], order: str, size: int, name: str) -> DataFrame:
    """Rows dealt to blocks of about `size` by a digest, and numbered from 0 within their block.

    A block is a window group of its own, so a large `by` group is spread over many.
    """
    counts = stored(df.groupBy(*by).agg(F.count("*").alias("_n")), "sizes")  # known to be small: no shuffle by `by` alone
    dealt = df.join(counts, by).withColumn(name, F.expr(f"cast(pmod(xxhash64({order}), ceil(_n / {size})) as int)")).drop("_n")
    return dealt.withColumn(f"{name}_at", F.row_number().over(Window.partitionBy(*by, name).orderBy(order)) - 1)


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = 10, groups: int = GROUPS, terms: int = TERMS,
                      lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """Divergence of every two sources of a language, and the terms that set each source apart.

    Each language keeps the terms that at least `least_docs` of its documents have. A group (language,
    source) and the language as a whole give each kept term a smoothed share; f(p, q) = floor((p - q)^2 /
    (p + q)) measures how far two shares lie apart. Part "pair": for each other source of the language the sum
    of f over all kept terms, of any count. Part "term": kept terms that the group has and uses more
    than the language does, the `top` largest f.

    Counts are made per task and then summed. Groups and terms are cut into blocks; the counts of a block of
    groups in a block of terms are one slice. A task owns a cell (group block, group block, term block)
    and gets the two slices it needs, each replicated to all cells of its row; partial sums of the cells are
    added along the term axis. No task holds more than two dense slices, whatever language or
    source is frequent. Arithmetic is exact in whole numbers.

    NULL text, language or source count as ''; repeated rows count as often as they occur. Groups
    without kept terms, and languages without any, still give their pairs (value 0 without kept terms).
    A source alone in its language has no pair. An empty table gives no rows.
    Returns lang, source, part, item, value, rank (from 1 per group and part: value descending, item ascending).
    """
    def plain(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    spark = docs.sparkSession
    rows = docs.select(plain(lang).alias("lang"), plain(source).alias("source"), plain(text).alias("t"))
    counts = stored(term_counts(rows), "terms")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    kept = stored(_numbered(kept.drop("docs"), ["lang"], "term", terms, "t_block"), "kept")
    held = stored(counts.select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "held")

    sizes = kept.groupBy("lang").agg(F.count("*").alias("vocabulary"), F.sum("total").alias("lang_total"))
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("group_total"))
    known = rows.select("lang", "source").distinct().join(sizes, "lang", "left").join(totals, ["lang", "source"], "left")
    known = known.fillna(0, ["vocabulary", "lang_total", "group_total"])
    known = stored(_numbered(known, ["lang"], "source", groups, "g_block"), "groups")

    # Slices: every block of groups with every block of terms of its language, counts or none.
    t_blocks = kept.groupBy("lang", "t_block").agg(F.count("*").alias("terms"))
    g_blocks = known.groupBy("lang", "g_block", "vocabulary").agg(
        F.array_sort(F.collect_list(F.struct("g_block_at", "source", "group_total"))).alias("g")).select(
        "lang", "g_block", "vocabulary", F.col("g.source").alias("sources"), F.col("g.group_total").alias("totals"))

    def packed(key, pdf):
        flat = [pdf["g_block_at"].to_numpy("int32"), pdf["t_block_at"].to_numpy("int32"), pdf["n"].to_numpy("int64")]
        return pd.DataFrame({"lang": [key[0]], "g_block": [key[1]], "t_block": [key[2]], "cells": [[x.tobytes() for x in flat]]})

    filled = held.join(known.select("lang", "source", "g_block", "g_block_at"), ["lang", "source"]).select(
        "lang", "g_block", "t_block", "g_block_at", "t_block_at", "n").groupBy("lang", "g_block", "t_block").applyInPandas(
        packed, "lang string, g_block int, t_block int, cells array<binary>")
    # A language without kept terms has one block of none, so that its pairs appear.
    slices = (g_blocks.join(t_blocks, "lang", "left").fillna(0, ["t_block", "terms"])
              .join(filled, ["lang", "g_block", "t_block"], "left").join(known.groupBy("lang").agg(F.max("g_block").alias("last")), "lang"))
    slices = stored(slices, "slices")

    first = slices.select("lang", "t_block", "terms", "vocabulary", F.col("g_block").alias("x"), F.explode(F.sequence("g_block", "last")).alias("y"),
                          *[F.col(c).alias(f"a_{c}") for c in ("sources", "totals", "cells")])
    second = slices.select("lang", "t_block", F.explode(F.sequence(F.lit(0), "g_block")).alias("x"), F.col("g_block").alias("y"),
                           *[F.col(c).alias(f"b_{c}") for c in ("sources", "totals", "cells")])
    width, cell = int(spark.conf.get("spark.sql.shuffle.partitions")), ["lang", "x", "y", "t_block"]
    cube = first.repartition(width, *cell).join(second.repartition(width, *cell), cell)

    def diverge(batches):
        for pdf in batches:
            for c in pdf.to_dict("records"):
                p, q = _dense(c, "a", c["terms"]), _dense(c, "b", c["terms"])
                sums = np.stack([_f(p, x).sum(axis=1) for x in q], axis=1)
                a, b = (np.array(list(c[f"{s}_sources"]), object) for s in "ab")
                i, j = np.indices(sums.shape).reshape(2, -1)
                if c["x"] == c["y"]:
                    i, j = i[i != j], j[i != j]
                    found = (a[i], b[j], sums[i, j])
                else:
                    found = (np.concatenate((a[i], b[j])), np.concatenate((b[j], a[i])), np.tile(sums[i, j], 2))
                yield pd.DataFrame({"lang": c["lang"], "source": found[0], "item": found[1], "value": found[2]})

    pairs = cube.mapInPandas(diverge, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(
        F.sum("value").alias("value")).withColumn("part", F.lit("pair"))

    n = {c: F.col(c) for c in ("n", "total", "group_total", "lang_total", "vocabulary")}
    shared = held.join(known.select("lang", "source", "group_total", "lang_total", "vocabulary"), ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"), share(n["n"], n["group_total"], n["vocabulary"]).alias("p"),
        share(n["total"], n["lang_total"], n["vocabulary"]).alias("q")).where("p > q")
    apart = shared.select("lang", "source", "item", F.expr("(p - q) * (p - q) div (p + q)").alias("value"), F.lit("term").alias("part"))

    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    best = apart.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    ranked = pairs.withColumn("rank", F.row_number().over(order))
    return ranked.select("lang", "source", "part", "item", "value", "rank").unionByName(
        best.select("lang", "source", "part", "item", "value", "rank"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x{00}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+') AS w FROM documents
), t AS (
  SELECT row, lang, source, unnest(w) AS term FROM d
), k AS (
  SELECT lang, term, count(*)::HUGEINT AS total FROM t GROUP BY 1, 2 HAVING count(DISTINCT row) >= 10
), c AS (
  SELECT lang, source, term, count(*)::HUGEINT AS n FROM t JOIN k USING (lang, term) GROUP BY 1, 2, 3
), l AS (
  SELECT lang, count(k.term)::HUGEINT AS v, coalesce(sum(total), 0)::HUGEINT AS nl FROM (SELECT DISTINCT lang FROM d) LEFT JOIN k USING (lang) GROUP BY 1
), g AS (
  SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS ng FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY 1, 2
), s AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (g.ng + 2 * l.v) AS p,
    1 + (1000000000 * (k.total + 2)) // (l.nl + 2 * l.v) AS q
  FROM g JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value FROM s x
    JOIN s y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3) f
  ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
), r AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value,
    row_number() OVER (PARTITION BY lang, source ORDER BY (p - q) * (p - q) // (p + q) DESC, term) AS rank FROM s WHERE n > 0 AND p > q) WHERE rank <= 10
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM r
"""


@query("op13_source_divergence", ORACLE)
def op13(spark, sf_dir):
    return source_divergence(table(spark, sf_dir, "documents"))
