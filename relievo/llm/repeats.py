"""What both repeat removers share: runs of windows as rows, their grouping, and cutting spans from texts."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rolling as R
from .common import stored

RUN = "h long, c long, d long, tv long, place long, z int"
#: States of a run's row: alone so far, with copies in the same batch, or itself such a copy.
ALONE, COPIED, COPY = 0, 1, 2
#: A window start and, relative to it, the last start and the anchor, in one number.
BITS = 12


def _lane(data: np.ndarray, at: np.ndarray, by_words: bool, lane: int):
    """Digests over the words or bytes of some rows, and how many each row has."""
    one = R.of_bytes(data, lane)
    if not by_words:
        return one, np.diff(at)
    start, end, counts = R.words(data, at)
    return R.Stretches(one.digest(start, end), lane), counts


def _rows(batch):
    """(rows i to j, their bytes, their offsets) of a batch with a text column `t`."""
    data, at = R.text_column(batch, "t")
    for i, j in R.parts(at):
        yield i, j, data[at[i]:at[j]], at[i:j + 1] - at[i]


def _new(cols: list[np.ndarray]) -> np.ndarray:
    """Positions of rows that differ from the row before; rows are sorted."""
    if not len(cols[0]):
        return np.zeros(0, "int64")
    return np.concatenate(([0], np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in cols])) + 1))


def _once(cols: list[np.ndarray]) -> list[np.ndarray]:
    """Sorted rows without repetitions, as a document that occurs in two equal rows has them."""
    start = _new(cols)
    return [x[start] for x in cols]


def runs(docs: DataFrame, by_words: bool, k: int, window: int) -> DataFrame:
    """One row per run of windows with one anchor: digests of anchor and content, place, state.

    Copies are pre-aggregated: of the runs of one batch that have the same content only the first is
    compared with others; the rest are known to be copies and get a key of their own, so a passage
    that a third of all documents share does not pile up.
    """
    if window > 1 << BITS:
        raise ValueError(f"a window has at most {1 << BITS} words or bytes")

    def work(batches):
        for batch in batches:
            ids, tvs = (np.asarray(batch.column(c)) for c in ("d", "tv"))
            found = []
            for i, j, data, at in _rows(batch):
                one, counts = _lane(data, at, by_words, 0)
                a, b, p, h, c = R.anchored_runs(one, counts, k, window)
                first = np.cumsum(counts) - counts
                row = np.searchsorted(first + counts, a, "right")
                base = first[row] if len(a) else a
                found.append((h.view("int64"), c.view("int64"), ids[i:j][row], tvs[i:j][row],
                              ((a - base) << 2 * BITS) | ((b - a) << BITS) | (p - a)))
            if not found:
                continue
            cols = [np.concatenate(x) for x in zip(*found)]
            order = np.lexsort(cols[::-1])
            cols = _once([x[order] for x in cols])
            h, c, d, tv, place = cols
            copy = np.zeros(len(h), bool)
            copy[1:] = (h[1:] == h[:-1]) & (c[1:] == c[:-1])
            z = np.where(copy, COPY, ALONE).astype("int32")
            z[:-1][copy[1:] & ~copy[:-1]] = COPIED
            h = np.where(copy, R.mix((d ^ place).view("uint64")).view("int64"), h)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h, c, d, tv, place, z)], ["h", "c", "d", "tv", "place", "z"])

    return docs.select("d", "tv", "t").mapInArrow(work, RUN)


def shared_runs(docs: DataFrame, by_words: bool, k: int, window: int, name: str) -> DataFrame:
    """Runs that matter: h, d, tv, a, b, p, `first`, `copied`, `open`.

    `first` is the first run of its content (by document, then place), `copied` says that the content
    occurs again, `open` that the anchor has other contents too. A first run that is neither copied
    nor open, as most of ordinary text, ends here. Rows are sorted by anchor and content and read as a
    stream; only the last first run is held back, so no anchor is gathered in memory.
    """
    def work(batches):
        names = ["h", "c", "d", "tv", "place", "z"]
        held, known_open = None, False

        def out(h, d, tv, place, first, copied, opened):
            a = place >> 2 * BITS
            keep = ~first | copied | opened
            cols = (h, d, tv, a, a + ((place >> BITS) & ((1 << BITS) - 1)), a + (place & ((1 << BITS) - 1)), first, copied, opened)
            return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in cols], ["h", "d", "tv", "a", "b", "p", "first", "copied", "open"])

        for batch in batches:
            cols = [np.asarray(batch.column(c)) for c in names]
            copy = cols[5] == COPY
            if copy.any():
                h, c, d, tv, place, z = (x[copy] for x in cols)
                yes = np.ones(len(h), bool)
                yield out(h, d, tv, place, ~yes, yes, ~yes)
                cols = [x[~copy] for x in cols]
            if held is not None:
                cols = [np.concatenate((x, y)) for x, y in zip(held, cols)]
            if not len(cols[0]):
                continue
            start = _new(cols[:5])
            cols = [x[start] for x in cols[:5]] + [np.maximum.reduceat(cols[5], start)]
            h, c, d, tv, place, z = cols
            new_h, new_c = np.ones(len(h), bool), np.ones(len(h), bool)
            new_h[1:] = h[1:] != h[:-1]
            new_c[1:] = new_h[1:] | (c[1:] != c[:-1])
            at = np.flatnonzero(new_c)
            copied, opened = z == COPIED, np.zeros(len(h), bool)
            copied[at] |= np.diff(np.append(at, len(h))) > 1
            opened[at] = ~new_h[at]
            opened[at[:-1]] |= ~new_h[at[1:]]
            opened[0] |= known_open
            last = at[-1]
            ready = np.ones(len(h), bool)
            ready[last] = False
            yield out(h[ready], d[ready], tv[ready], place[ready], new_c[ready], copied[ready], opened[ready])
            held = [x[last:last + 1] for x in cols]
            held[5] = np.array([COPIED if copied[last] else ALONE], "int32")
            known_open = bool(opened[last])
        if held is not None:
            h, c, d, tv, place, z = held
            yield out(h, d, tv, place, np.ones(1, bool), z == COPIED, np.array([known_open]))

    rows = runs(docs, by_words, k, window).repartition("h").sortWithinPartitions("h", "c", "d", "tv", "place")
    return stored(rows.mapInArrow(
        work, "h long, d long, tv long, a long, b long, p long, first boolean, copied boolean, open boolean"), name)


def windows_of(docs: DataFrame, places: DataFrame, by_words: bool, window: int) -> DataFrame:
    """(w1, w2, d, tv, s, z): every window of the runs at `places` (d, tv, a, b) by its digests and start.

    As with runs, a window that an earlier one of the batch equals is marked as COPY and gets other digests.
    """
    def work(batches):
        for batch in batches:
            ids, tvs = (np.asarray(batch.column(c)) for c in ("d", "tv"))
            col = batch.column("r")
            cut = np.asarray(col.offsets).astype("int64")
            lo, hi = (np.asarray(col.values.field(x)).astype("int64") for x in ("a", "b"))
            found = []
            for i, j, data, at in _rows(batch):
                one, counts = _lane(data, at, by_words, 0)
                two, _ = _lane(data, at, by_words, 1)
                first = np.cumsum(counts) - counts
                row = np.repeat(np.arange(i, j), np.diff(cut[i:j + 1]))
                a, b = lo[cut[i]:cut[j]], hi[cut[i]:cut[j]]
                n = b - a + 1
                row, a = np.repeat(row, n), np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                s = a + first[row - i]
                found.append((one.digest(s, s + window).view("int64"), two.digest(s, s + window).view("int64"), ids[row], tvs[row], a))
            if not found:
                continue
            cols = [np.concatenate(x) for x in zip(*found)]
            order = np.lexsort(cols[::-1])
            w1, w2, d, tv, s = _once([x[order] for x in cols])
            copy = np.zeros(len(w1), bool)
            copy[1:] = (w1[1:] == w1[:-1]) & (w2[1:] == w2[:-1])
            w1 = np.where(copy, R.mix((d ^ s).view("uint64")).view("int64"), w1)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (w1, w2, d, tv, s, np.where(copy, COPY, ALONE).astype("int32"))],
                                             ["w1", "w2", "d", "tv", "s", "z"])

    return with_spans(docs.select("d", "tv", "t"), places, "inner", ["a", "b"]).mapInArrow(work, "w1 long, w2 long, d long, tv long, s long, z int")


def with_spans(docs: DataFrame, spans: DataFrame, how: str, ends: list[str]) -> DataFrame:
    """Documents with the array `r` of their spans; a document's spans are bounded by its length.

    Columns of `docs` besides d, tv and t are handed on.
    """
    held = spans.groupBy("d", "tv").agg(F.collect_list(F.struct(*ends)).alias("r"))
    none = F.array().cast("array<struct<" + ",".join(f"{e}:bigint" for e in ends) + ">>")
    others = [c for c in docs.columns if c not in ("d", "tv", "t")]
    return docs.join(held, ["d", "tv"], how).select("d", "tv", "t", F.coalesce("r", none).alias("r"), *others)


def merged(s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of spans as disjoint spans that do not touch."""
    if not len(s):
        return s, e
    order = np.argsort(s, kind="stable")
    s, e = s[order], np.maximum.accumulate(e[order])
    new = np.concatenate(([True], s[1:] > e[:-1]))
    return s[new], e[np.append(np.flatnonzero(new)[1:], len(s)) - 1]


def cut_texts(docs: DataFrame, spans: DataFrame, by_words: bool, keep_text: bool) -> DataFrame:
    """Texts without the words or bytes that `spans` (d, tv, s, e) cover.

    Returns d, tv, n (words or bytes), n_removed, n_spans, kept_sha256, and with keep_text the rest as
    `kept` (words joined by one space; bytes with characters cut in two left out) and the merged
    spans as `removed`. Columns of `docs` besides d, tv and t are handed on.
    """
    others = [f for f in docs.schema if f.name not in ("d", "tv", "t")]
    fields = [("d", pa.int64()), ("tv", pa.int64()), ("n", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
              ("kept_sha256", pa.string())]
    ddl = "d long, tv long, n long, n_removed long, n_spans long, kept_sha256 string"
    if keep_text:
        span = pa.struct([("s", pa.int64()), ("e", pa.int64())])
        fields += [("kept", pa.string()), ("removed", pa.list_(span))]
        ddl += ", kept string, removed array<struct<s: long, e: long>>"
    ddl += "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in others)
    names = [f.name for f in others]

    def rest_of_words(text, s, e):
        start, end, _ = R.words(text, np.array([0, len(text)]))
        keep = np.zeros(len(start) + 1, "int64")
        np.add.at(keep, s, 1)
        np.add.at(keep, e, -1)
        keep = np.cumsum(keep)[:-1] == 0
        raw = text.tobytes()
        return len(start), b" ".join([raw[x:y] for x, y in zip(start[keep].tolist(), end[keep].tolist())])

    def rest_of_bytes(text, s, e):
        raw, out, at = text.tobytes(), [], 0
        for x, y in zip(s.tolist(), e.tolist()):
            out.append(raw[at:x])
            at = y
        out.append(raw[at:])
        return len(raw), b"".join(out)

    rest = rest_of_words if by_words else rest_of_bytes

    def work(batches):
        for batch in batches:
            ids, tvs = (np.asarray(batch.column(c)) for c in ("d", "tv"))
            col = batch.column("r")
            cut = np.asarray(col.offsets)
            lo, hi = (np.asarray(col.values.field(x)).astype("int64") for x in ("s", "e"))
            data, at = R.text_column(batch, "t")
            out, size, done = [], 0, 0

            def made(to):
                cols = list(zip(*out)) or [[]] * len(fields)
                arrays = [pa.array(x, kind) for x, (_, kind) in zip(cols, fields)]
                arrays += [batch.column(c).slice(done, to - done) for c in names]
                return pa.RecordBatch.from_arrays(arrays, [f for f, _ in fields] + names)

            for i in range(len(ids)):
                s, e = lo[cut[i]:cut[i + 1]], hi[cut[i]:cut[i + 1]]
                s, e = merged(s, e)
                n, kept = rest(data[at[i]:at[i + 1]], s, e)
                row = [ids[i], tvs[i], n, int((e - s).sum()), len(s), hashlib.sha256(kept).hexdigest()]
                if keep_text:
                    row += [kept.decode("utf-8", "ignore"), [{"s": x, "e": y} for x, y in zip(s.tolist(), e.tolist())]]
                    size += len(kept)
                out.append(row)
                if size > 4 * R.CHUNK_BYTES:
                    yield made(i + 1)
                    out, size, done = [], 0, i + 1
            yield made(len(ids))

    return with_spans(docs, spans, "left", ["s", "e"]).mapInArrow(work, ddl)
