"""Removal of repeated word passages by compacting a De Bruijn graph of word windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import repeats
from .common import inner_id, keyed, outer_id, query, table

#: Words of an anchor, the content-chosen part of a window under which windows are compared.
ANCHOR = 8


def repeated_spans(docs: DataFrame, window: int = 20) -> DataFrame:
    """(d, tv, s, e): stretches of words covered by a window that also starts earlier.

    Every window of `window` words is an edge of a De Bruijn graph whose nodes are its first and last
    window - 1 words. Consecutive edges with the same anchor make a path. A path is written as one
    row, with digests of its whole content, instead of one row per edge:
    * paths with equal content collapse, first within a task, then after one shuffle by anchor;
    * an anchor under which only one content occurs does not branch, and all of its paths but the first
      are repeats as a whole;
    * where an anchor has several contents, the graph branches: one copy of each content is opened
      into its single edges, and the edges that another content has earlier are found.
    The source coordinates (document, word) of the first copy decide which copies go. Two 64-bit digests,
    of the anchor and of the whole content, must agree.
    """
    paths = repeats.shared_runs(docs, True, ANCHOR, window, "paths")
    later = paths.where("not first").select("d", "tv", F.col("a").alias("s"), (F.col("b") + window).alias("e"))
    # Not stored: the plan then reads the documents' exchange for the last join once more instead of a second one.
    edges = repeats.windows_of(docs, paths.where("first and open"), True, window)
    earlier = Window.partitionBy("w1", "w2").orderBy("d", "tv", "s")
    again = (edges.withColumn("nth", F.rank().over(earlier)).where((F.col("nth") > 1) | (F.col("z") == repeats.COPY))
             .select("d", "tv", "s", (F.col("s") + window).alias("e")))
    return later.unionByName(again)


def remove_repeats(docs: DataFrame, window: int = 20, key: str = "doc_id", text: str = "text", keep_text: bool = True) -> DataFrame:
    """Documents without the words covered by a window of `window` words that also starts earlier.

    Earlier means a smaller identifier, or the same document and a smaller position; a NULL identifier
    is smallest. Windows are judged on the input. NULL and empty texts, and texts shorter than a window,
    keep what they have. Repeated rows (equal identifier and text) are one document and get equal
    results; rows that share only the identifier are ordered by a digest of their text.
    Returns key, n (words), n_removed, n_spans, kept_sha256 and, with keep_text, the kept words joined
    by one space (`kept`) and the word spans taken out (`removed`).
    """
    rows = keyed(docs, key, text).withColumn("d", inner_id())
    done = repeats.cut_texts(rows, repeated_spans(rows, window), True, keep_text)
    return done.select(outer_id().alias(key), *[c for c in done.columns if c not in ("d", "tv")])


@query("op7_substring_dedup")
def op7(spark, sf_dir):
    done = remove_repeats(table(spark, sf_dir, "documents"), keep_text=False)
    return done.select("doc_id", F.col("n").alias("n_words"), "n_removed", "kept_sha256", "n_spans")
