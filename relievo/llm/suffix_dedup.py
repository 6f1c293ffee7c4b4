"""Removal of repeated byte strings with suffix arrays over anchored contexts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats
from . import rolling as R
from .common import inner_id, keyed, outer_id, query, stored, table

#: Bytes of an anchor.
ANCHOR = 64
#: Contexts of one anchor that one suffix array holds, 736 bytes each at most; with more, strings are counted.
TREE_ROWS = 20_000
#: Bytes from which on repeats are reported, whatever is removed: about 50 words of ordinary prose.
REPORTED = 250


def _common(x: bytes, y: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    return n - ((int.from_bytes(x[:n], "big") ^ int.from_bytes(y[:n], "big")).bit_length() + 7) // 8


def _intervals(lcp: list[int], least: int):
    """Common-prefix intervals (depth, low, high) of a sorted list, by one scan with a stack.

    lcp[i] is the common prefix of entries i - 1 and i. Only depths of at least `least` are given.
    """
    stack = [(0, 0)]
    for i in range(1, len(lcp) + 1):
        depth = lcp[i] if i < len(lcp) else -1
        low = i - 1
        while stack and stack[-1][0] > depth:
            top, low = stack.pop()
            if top >= least and i - 1 > low:
                yield top, low, i - 1
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, low))


def maximal_repeats(left: list[bytes], right: list[bytes], least: int):
    """Maximal repeat groups around one anchor: (members, bytes to the left, bytes to the right).

    `right[i]` is the text from the anchor on, `left[i]` the text before it, backwards. The texts from
    the anchor on, sorted, are a suffix array; its common-prefix intervals are the strings that several
    members share to the right. Inside each interval the same scan over the sorted left contexts
    tells where left extensions part: a group is given where its left extension is diverse (longer
    ones are shared by fewer members) and left and right together reach `least` bytes. A group that
    lies in a deeper interval as a whole is not maximal to the right and is given there only.
    All members of a group are given, not just neighbours.
    """
    m = len(right)
    order = sorted(range(m), key=right.__getitem__)
    lcp = [0] + [_common(right[order[i - 1]], right[order[i]]) for i in range(1, m)]
    far = max(map(len, left))
    for depth, lo, hi in _intervals(lcp, max(1, least - far)):
        need = max(0, least - depth)
        inside = sorted(order[lo:hi + 1], key=left.__getitem__)
        shared = [0] + [_common(left[inside[i - 1]], left[inside[i]]) for i in range(1, len(inside))]
        branch = dict(zip(order[lo:hi + 1], np.cumsum([0] + [lcp[i] <= depth for i in range(lo + 1, hi + 1)]).tolist()))
        groups = [(d, x, y) for d, x, y in _intervals(shared, max(1, need))]
        if need == 0 and min(shared[1:]) == 0:
            groups.append((0, 0, len(inside) - 1))
        for extent, x, y in groups:
            members = inside[x:y + 1]
            if len({branch[i] for i in members}) > 1:
                yield members, extent, depth


def _contexts(docs: DataFrame, places: DataFrame, window: int) -> DataFrame:
    """Left and right context of the anchor of one run of each content."""
    def work(batches):
        names = ["h", "k", "single", "d", "tv", "p", "left", "right"]
        for batch in batches:
            ids, tvs = (np.asarray(batch.column(c)) for c in ("d", "tv"))
            col = batch.column("r")
            cut = np.asarray(col.offsets)
            f = {x: np.asarray(col.values.field(x)).astype("int64").tolist() for x in ("h", "k", "single", "a", "b", "p")}
            data, at = R.text_column(batch, "t")
            raw = data.tobytes() if len(data) < (1 << 26) else memoryview(data)
            rows = []
            for i in range(len(ids)):
                base = int(at[i])
                for j in range(cut[i], cut[i + 1]):
                    a, b, p = base + f["a"][j], base + f["b"][j], base + f["p"][j]
                    rows.append((f["h"][j], f["k"][j], f["single"][j], ids[i], tvs[i], f["p"][j], bytes(raw[a:p])[::-1], bytes(raw[p:b + window])))
                    if len(rows) >= 4000:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names)

    held = places.groupBy("d", "tv").agg(F.collect_list(F.struct("h", "k", F.col("single").cast("int").alias("single"), "a", "b", "p")).alias("r"))
    return docs.join(held, ["d", "tv"]).select("d", "tv", "t", "r").mapInArrow(
        work, "h long, k long, single long, d long, tv long, p long, left binary, right binary")


def _tree_spans(contexts: DataFrame, window: int) -> DataFrame:
    """Spans of single contents that a maximal repeat group covers, anchor by anchor."""
    def work(batches):
        def spans(rows):
            rows = list({(r["d"], r["tv"], r["p"]): r for r in rows}.values())  # equal rows are one document
            if len(rows) < 2:
                return
            reach: dict[int, tuple[int, int]] = {}  # all strings around the anchor hold it: their union is one span
            for members, x, y in maximal_repeats([r["left"] for r in rows], [r["right"] for r in rows], window):
                for i in members:
                    u, v = reach.get(i, (0, 0))
                    reach[i] = max(u, x), max(v, y)
            for i, (x, y) in reach.items():
                if rows[i]["single"]:
                    yield rows[i]["d"], rows[i]["tv"], rows[i]["p"] - x, rows[i]["p"] + y

        def out(found):
            cols = list(zip(*found)) if found else [[], [], [], []]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4)], ["d", "tv", "s", "e"])

        held, found = [], []
        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0]["h"] != row["h"]:
                    found.extend(spans(held))
                    held = []
                held.append(row)
            yield out(found)
            found = []
        yield out(list(spans(held)))

    return contexts.repartition("h").sortWithinPartitions("h").mapInArrow(work, "d long, tv long, s long, e long")


def _string_spans(contexts: DataFrame, window: int) -> DataFrame:
    """Spans of the strings that occur in several contexts, by counting every string of every context."""
    def work(batches):
        for batch in batches:
            ids, tvs, p = (np.asarray(batch.column(c)) for c in ("d", "tv", "p"))
            for i in range(0, len(ids), 1000):
                some = slice(i, i + 1000)
                left, right = (batch.column(c)[some].to_pylist() for c in ("left", "right"))
                before = np.array([len(x) for x in left], "int64")
                counts = before + np.array([len(x) for x in right], "int64")
                data = np.frombuffer(b"".join([x[::-1] + y for x, y in zip(left, right)]), "uint8")
                one, two = R.of_bytes(data, 0), R.of_bytes(data, 1)
                n, first = counts - window + 1, np.cumsum(counts) - counts
                row = np.repeat(np.arange(len(n)), n)
                nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                s = first[row] + nth
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (one.digest(s, s + window).view("int64"), two.digest(s, s + window).view("int64"),
                                           ids[some][row], tvs[some][row], (p[some] - before)[row] + nth)],
                    ["w1", "w2", "d", "tv", "s"])

    strings = stored(contexts.mapInArrow(work, "w1 long, w2 long, d long, tv long, s long"), "strings")
    at = F.struct("d", "tv", "s")
    twice = strings.groupBy("w1", "w2").agg(F.min(at).alias("x"), F.max(at).alias("y")).where("x < y").select("w1", "w2")
    return strings.join(twice, ["w1", "w2"]).select("d", "tv", "s", (F.col("s") + window).alias("e"))


def repeated_spans(docs: DataFrame, window: int = 400) -> DataFrame:
    """(d, tv, s, e): bytes covered by a string of `window` bytes that also starts anywhere else.

    Only strings with equal anchors can be equal. Runs whose whole content occurs twice are repeats as
    they stand. Where an anchor has several contents, one copy of each is brought together and a
    suffix array over their texts from the anchor on, with its common-prefix intervals, gives the maximal
    repeat groups. Anchors with more than TREE_ROWS different contents, as a passage that very many
    documents share has, are compared window by window in a distributed count instead, to the same result.
    """
    shared = repeats.shared_runs(docs, False, ANCHOR, window, "runs")
    whole = shared.where("copied or not first").select("d", "tv", F.col("a").alias("s"), (F.col("b") + window).alias("e"))
    parted = shared.where("first and open").select("h", (~F.col("copied")).alias("single"), "d", "tv", "a", "b", "p")
    parted = parted.join(parted.groupBy("h").agg(F.count("*").alias("k")), "h")
    contexts = stored(_contexts(docs, parted, window), "contexts")
    tree = _tree_spans(contexts.where(F.col("k") <= TREE_ROWS), window)
    flat = _string_spans(contexts.where(F.col("k") > TREE_ROWS), window)
    return whole.unionByName(tree).unionByName(flat)


def _repeated_parts(docs: DataFrame, spans: DataFrame, window: int) -> DataFrame:
    """(d, tv, part, s, t, n_repeated, n_repeats): the repeated bytes of each document that `spans` reach.

    Spans are united first. One row per united span of at least `window` bytes, with its bytes `t` and a
    digest `part` of place and document; a document without any has one row with t NULL. n_repeated and n_repeats
    count all bytes and spans of the document.
    """
    def work(batches):
        names = ["d", "tv", "s", "t", "n_repeated", "n_repeats"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
        for batch in batches:
            ids, tvs = (np.asarray(batch.column(c)) for c in ("d", "tv"))
            col = batch.column("r")
            cut = np.asarray(col.offsets)
            lo, hi = (np.asarray(col.values.field(x)).astype("int64") for x in ("s", "e"))
            data, at = R.text_column(batch, "t")
            rows, size = [], 0
            for i in range(len(ids)):
                s, e = repeats.merged(lo[cut[i]:cut[i + 1]], hi[cut[i]:cut[i + 1]])
                total, long = int((e - s).sum()), np.flatnonzero(e - s >= window)
                for x, y in zip(s[long].tolist(), e[long].tolist()) if len(long) else [(0, None)]:
                    t = None if y is None else data[at[i] + x:at[i] + y].tobytes()
                    rows.append((ids[i], tvs[i], x, t, total, len(s)))
                    size += len(t or b"")
                    if size > 4 * R.CHUNK_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    held = repeats.with_spans(docs.select("d", "tv", "t"), spans, "inner", ["s", "e"])
    found = held.mapInArrow(work, "d long, tv long, s long, t binary, n_repeated long, n_repeats long")
    return found.withColumn("part", F.xxhash64("tv", "s"))


def spans_and_report(docs: DataFrame, window: int, least: int) -> tuple[DataFrame, DataFrame]:
    """`repeated_spans` of `window` bytes, and (d, tv, n_repeated, n_repeats) for repeats of at least `least` bytes.

    A string of `window` bytes that recurs lies within the union of the recurring strings of `least`
    bytes. So the whole texts are searched once, for the shorter length, and only what recurs
    there is searched again for the longer one.
    """
    parts = stored(_repeated_parts(docs, repeated_spans(docs, least), window), "parts")
    report = parts.groupBy("d", "tv").agg(F.max("n_repeated").alias("n_repeated"), F.max("n_repeats").alias("n_repeats"))
    again = parts.where("t is not null")
    spans = repeated_spans(again.select("d", F.col("part").alias("tv"), "t"), window).withColumnRenamed("tv", "part")
    place = again.select("d", "part", F.col("tv").alias("tv"), F.col("s").alias("at")).distinct()
    return spans.join(place, ["d", "part"]).select("d", "tv", (F.col("s") + F.col("at")).alias("s"), (F.col("e") + F.col("at")).alias("e")), report


def remove_repeats(docs: DataFrame, window: int = 400, key: str = "doc_id", text: str = "text", keep_text: bool = True,
                   others: tuple[str, ...] = (), least: int | None = None) -> DataFrame:
    """Documents without the bytes covered by a string of `window` bytes that also starts elsewhere.

    Elsewhere is another document or another place of the same one; all occurrences go, the first
    too. Strings are judged on the input and never cross documents. NULL and empty texts, and texts
    shorter than the string, keep what they have. Repeated rows (equal identifier and text) are one
    document: they do not repeat each other, and get equal results.
    Returns key, n (bytes), n_removed, n_spans (maximal removed runs), kept_sha256 and, with keep_text,
    the rest as text (`kept`; a character cut in two is left out) and the byte spans (`removed`). With `least`,
    a shorter length, n_repeated and n_repeats follow: bytes in strings of `least` bytes that start elsewhere too,
    and their maximal runs; they are reported, not removed.
    Columns named in `others` come last, unchanged.
    """
    rows = keyed(docs, key, text, others).withColumn("d", inner_id())
    plain = rows.select("d", "tv", "t")
    if least is None:
        done = repeats.cut_texts(rows, repeated_spans(plain, window), False, keep_text)
    else:
        if not ANCHOR < least <= window:
            raise ValueError(f"least lies between {ANCHOR} and the window")
        spans, report = spans_and_report(plain, window, least)
        done = repeats.cut_texts(rows, spans, False, keep_text).join(report, ["d", "tv"], "left").fillna(0, ["n_repeated", "n_repeats"])
    own = [c for c in done.columns if c not in ("d", "tv") and not c.startswith("other ")]
    return done.select(outer_id().alias(key), *own, *[F.col(f"other {c}").alias(c) for c in others])


@query("op9_suffix_array_dedup")
def op9(spark, sf_dir):
    done = remove_repeats(table(spark, sf_dir, "documents"), keep_text=False, least=REPORTED)
    return done.select("doc_id", F.col("n").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256", "n_repeated", "n_repeats")
