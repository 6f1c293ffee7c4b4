"""SimHash fingerprints and near copies by pigeonring filtering."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rolling as R
from .common import inner_id, outer_id, query, stored, table, texts
from .graph import components

#: Words of a shingle, seed of its digest, most differing bits of a link.
WORDS, SEED, FAR = 4, 42, 4
#: Widths of the segments of a fingerprint, from its lowest bits up: one more segment than FAR.
SEGMENTS = (13, 13, 13, 13, 12)
#: Rows under one key that are compared in one task; a key with more is lengthened, and at the longest cut into tiles.
BUCKET = 2048
#: Longest chain that is enumerated as a key.
LONGEST = 3
#: Digests whose bits are counted in one go.
COUNTED = 1 << 15
#: Pairs of fingerprints that are compared in one go.
PAIRS = 1 << 20
SHIFT = (0, 13, 26, 39, 52)


def fingerprint(digests: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each row the bits that are set in over half of its digests; `first` has one entry more than rows.

    Digests are counted COUNTED at a time, so a very long text takes no more memory than a short one.
    """
    rows = len(first) - 1
    count = np.zeros((rows, 64), "int64")
    for lo in range(0, len(digests), COUNTED):
        hi = min(lo + COUNTED, len(digests))
        bits = np.unpackbits(digests[lo:hi].view("uint8").reshape(-1, 8), axis=1, bitorder="little")
        a, b = np.searchsorted(first, lo, "right") - 1, np.searchsorted(first, hi, "left")
        starts = np.maximum(first[a:b], lo) - lo
        full = np.flatnonzero(np.diff(np.append(starts, hi - lo)))
        count[a + full] += np.add.reduceat(bits, starts[full], axis=0, dtype="int64")
    over = (2 * count > np.diff(first)[:, None]).astype("uint8")
    return np.packbits(over, axis=1, bitorder="little").view("<u8").ravel()


def shingle_digests(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle of some rows, and where each row's shingles begin (one more for the end).

    Words are lower-cased in A-Z and joined by one space; `data` begins at the first row.
    """
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype("uint8")
    start, end, counts = R.words(data, at)
    # Each word and the byte after it, as a space: shingles are stretches of what is left.
    gap = np.append(data, np.uint8(32))
    keep = (gap != 32) & ((gap < 9) | (gap > 13))
    gap[end[~keep[end]]] = 32
    keep[end] = True
    place = np.concatenate(([0], np.cumsum(keep)))
    start, end = place[start], place[end]
    size = np.where(counts >= WORDS, counts - WORDS + 1, np.minimum(counts, 1))
    first = np.concatenate(([0], np.cumsum(size)))
    lead = np.cumsum(counts) - counts
    s = np.repeat(lead - first[:-1], size) + np.arange(first[-1])
    e = s + np.repeat(np.minimum(counts, WORDS), size) - 1
    raw, digest, out = gap[keep].tobytes(), xxhash.xxh64_intdigest, np.zeros(first[-1], "uint64")
    for lo in range(0, len(out), COUNTED):
        some = slice(lo, lo + COUNTED)
        out[some] = [digest(raw[a:b], SEED) for a, b in zip(start[s[some]].tolist(), end[e[some]].tolist())]
    return out, first


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(d, fp): the fingerprint of every whole text as a signed number, 0 without words. Map-only."""
    def work(batches):
        for batch in batches:
            data, at = R.text_column(batch, "t")
            found = [np.zeros(0, "uint64")]
            for i, j in R.parts(at):
                digests, first = shingle_digests(data[at[i]:at[j]], at[i:j + 1] - at[i])
                found.append(fingerprint(digests, first))
            yield pa.RecordBatch.from_arrays([batch.column("d"), pa.array(np.concatenate(found).view("int64"))], ["d", "fp"])

    rows = texts(docs, key, text).withColumn("d", inner_id())
    return rows.mapInArrow(work, "d long, fp long")


# --- keys: the first segments of a chain

def _ring(fp: np.ndarray, start: int) -> np.ndarray:
    """Fingerprints turned so that segment `start` comes lowest."""
    k = np.uint64(SHIFT[start])
    return fp if start == 0 else (fp >> k) | (fp << (np.uint64(64) - k))


def _width(start: int, length: int) -> int:
    return sum(SEGMENTS[(start + i) % len(SEGMENTS)] for i in range(length))


def _budget(length: int) -> int:
    """Most differing bits in the first `length` segments of a chain: its share of FAR."""
    return length * FAR // len(SEGMENTS)


def variants(start: int, length: int) -> np.ndarray:
    """All differences that the first `length` segments of a chain may have: within budget at every length."""
    masks = {0}
    for i in range(length):
        low = _width(start, i)
        bits = range(low, low + SEGMENTS[(start + i) % len(SEGMENTS)])
        masks = {m | sum(1 << b for b in flips) for m in masks for n in range(_budget(i + 1) - m.bit_count() + 1)
                 for flips in combinations(bits, n)}
    return np.array(sorted(masks), "uint64")


def chain_keys(prints: DataFrame, length: int) -> DataFrame:
    """(k, fp, other): the keys of chains of `length` segments, of rows (fp, start).

    A fingerprint shows its own first segments, and, as `other`, each variant of them that is within
    budget. Two fingerprints whose chain from `start` is viable meet where one shows its own.
    """
    def work(batches):
        for batch in batches:
            fp, start = np.asarray(batch.column("fp")).view("uint64"), np.asarray(batch.column("start"))
            for s in range(len(SEGMENTS)):
                mine = fp[start == s]
                if not len(mine):
                    continue
                head = _ring(mine, s) & np.uint64((1 << _width(s, length)) - 1)
                mark = np.uint64(s << 60)
                for m in variants(s, length):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(((head ^ m) | mark).view("int64")), pa.array(mine.view("int64")), pa.array(np.full(len(mine), m != 0))],
                        ["k", "fp", "other"])

    return prints.select("fp", "start").mapInArrow(work, "k long, fp long, other boolean")


# --- links under one key

def viable(own: np.ndarray, many: np.ndarray, start: int):
    """Positions (in `own`, in `many`) of the pairs that link over a chain from `start`, some at a time.

    The cumulative difference is held to its budget segment by segment; only what is left at the end,
    at the full length, has met the limit of the whole fingerprint. `many` begins with `own`, and a pair
    within `own` is given once.
    """
    step = max(1, PAIRS // max(1, len(many)))
    for lo in range(0, len(own), step):
        left = _ring(own[lo:lo + step, None] ^ many[None, :], start).ravel()
        at = np.arange(len(left))
        for length in range(1, len(SEGMENTS) + 1):
            head = left & np.uint64((1 << _width(start, length)) - 1)
            ok = np.flatnonzero(np.bitwise_count(head) <= _budget(length))
            at, left = at[ok], left[ok]
        i, j = at // len(many) + lo, at % len(many)
        yield i[j > i], j[j > i]


def spanning_links(own: np.ndarray, many: np.ndarray, start: int):
    """Links (fp, fp) that connect what the pairs of `own` with `many` connect, fewer than there are fingerprints.

    A pair that earlier links connect already adds nothing, so a dense cluster gives a tree, not all its pairs.
    """
    root = np.arange(len(many))
    for i, j in viable(own, many, start):
        while True:
            apart = np.flatnonzero(root[i] != root[j])
            if not len(apart):
                break
            i, j = i[apart[0]:], j[apart[0]:]
            roots = np.unique(root[np.append(j[:np.searchsorted(i, i[0], "right")], i[0])])
            for r in roots[1:]:
                yield many[roots[0]], many[r]
            root[np.isin(root, roots[1:])] = roots[0]


LINKS = "a long, b long"


def _links(found) -> pa.RecordBatch:
    a, b = (np.array(x, "uint64").view("int64") for x in (zip(*found) if found else ([], [])))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _bucket_links(rows: DataFrame, by: list[str]) -> DataFrame:
    """Links under each key: rows (by..., fp, other) are sorted and read as a stream, one key at a time."""
    def work(batches):
        def links(own, others, k):
            if not own:
                return []
            mine = np.unique(np.concatenate(own))
            many = np.concatenate((mine, np.setdiff1d(np.concatenate(others), mine))) if others else mine
            return list(spanning_links(mine, many, (k >> 60) & 7)) if len(many) > 1 else []

        now, own, others = None, [], []
        for batch in batches:
            cols = [np.asarray(batch.column(c)) for c in by]
            fp, other = np.asarray(batch.column("fp")).view("uint64"), np.asarray(batch.column("other"))
            if not len(fp):
                continue
            new = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in cols])) + 1
            found = []
            for lo, hi in zip(np.concatenate(([0], new)).tolist(), np.append(new, len(fp)).tolist()):
                k = tuple(int(x[lo]) for x in cols)
                if k != now:
                    found += links(own, others, now[0]) if now else []
                    now, own, others = k, [], []
                part = fp[lo:hi], other[lo:hi]
                for held, x in ((own, part[0][~part[1]]), (others, part[0][part[1]])):
                    if len(x):
                        held.append(x)
            yield _links(found)
        yield _links(links(own, others, now[0]) if now else [])

    return rows.repartition(*by).sortWithinPartitions(*by).select(*by, "fp", "other").mapInArrow(work, LINKS)


def links(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between distinct fingerprints (fp) that connect all that differ in at most FAR bits.

    If two fingerprints differ in at most FAR bits, then on the ring of segments some chain of
    consecutive ones keeps within the proportional budget at each of its lengths (0, 1, 2, 3, 4 bits for 1
    to 5 segments). The first segment of that chain is the key; fingerprints under one key are compared
    along the chain. Where more than `bucket` rows share a key, its fingerprints get the keys of the next
    longer chain instead, with the variants its budget allows, so only they pay for it. Keys of LONGEST
    segments that are still shared by more are cut into tiles of `bucket` rows, each compared with each.
    """
    starts = F.explode(F.array(*[F.lit(i) for i in range(len(SEGMENTS))]))
    todo, found = prints.select("fp", starts.alias("start")), []
    for length in range(1, LONGEST + 1):
        rows = stored(chain_keys(todo, length), "chains")
        many = stored(rows.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > bucket), "crowded")
        crowded = many.count() > 0
        found.append(_bucket_links(rows.join(many, "k", "left_anti") if crowded else rows, ["k"]))
        if not crowded:
            break
        rows = rows.join(many, "k")
        if length < LONGEST:
            todo = rows.select("fp", F.shiftrightunsigned("k", 60).cast("int").alias("start")).distinct()
            continue
        # Tile x of the fingerprints that show their own segments meets every tile y of those under the key.
        tiles = F.ceil(F.col("n") / bucket).cast("int")
        tiled = rows.withColumn("tiles", tiles).withColumn("tile", F.expr("cast(pmod(xxhash64(fp), tiles) as int)"))
        own = tiled.where("not other").select("k", F.col("tile").alias("x"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("y"), "fp", "other")
        seen = tiled.select("k", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("x"), F.col("tile").alias("y"), "fp", F.lit(True).alias("other"))
        found.append(_bucket_links(own.unionByName(seen), ["k", "x", "y"]))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", bucket: int = BUCKET) -> DataFrame:
    """Fingerprint of every document and the class that links of at most FAR differing bits make.

    A fingerprint bit is set if it is set in over half the XXH64 digests (seed 42) of the four-word
    shingles of the text, repeats included; words are lower-cased in A-Z, fewer words are one shingle.
    NULL, empty and wordless texts have fingerprint 0 and link like others. Documents with equal
    fingerprints are one node before anything is compared. A NULL identifier sorts first, so a class with one has
    component_id NULL; texts under one identifier are separate documents. Repeated rows get equal
    results, an empty table none.
    Returns key, fingerprint (16 lowercase hexadecimal digits), component_id (smallest identifier in reach).
    """
    rows = stored(fingerprints(docs, key, text), "fingerprints")
    prints = stored(rows.groupBy("fp").agg(F.min("d").alias("least")), "distinct")
    linked = stored(links(prints, bucket), "links")
    roots = components(linked, "a", "b")
    placed = prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("least").alias("component"))
    named = placed.join(least, "root").select("fp", "component")
    return rows.join(named, "fp").select(
        outer_id().alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), outer_id("component").alias("component_id"))


@query("op12_simhash_near_dedup")
def op12(spark, sf_dir):
    return near_copies(table(spark, sf_dir, "documents"))
