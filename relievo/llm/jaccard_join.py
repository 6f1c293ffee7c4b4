"""N-gram Jaccard self-join with parity sketches, and the groups of near copies it links."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rolling as R
from .common import inner_id, keyed, outer_id, query, stored, table
from .graph import components

#: Words of a shingle; and the similarity as a fraction: linked from 80 / 100 on.
WORDS, LEAST, OF = 5, 80, 100
#: Bits of the whole-set sketch that filters candidate pairs.
SKETCH_BITS = 1024
#: Bits of the parity vector of one block (its set bits are kept, not the vector).
BLOCK_BITS = 20
#: A size band reaches from r / BAND to r; a block holds between 1 and about SHARE shingles on average.
BAND, SHARE = 2.5, 3.2
#: Members of a bucket that are compared in one go.
TILE = 512
BAND_TOPS = np.unique(np.ceil(4 * BAND ** np.arange(0, 24))).astype("int64")


def furthest(n):
    """Largest symmetric difference between a set of n shingles and any set it can link with.

    100 * both >= 80 * all means |difference| <= (|A| + |B|) / 9 with |B| <= 1.25 n: at most n / 4.
    """
    return n // 4


def _blocks_of(band: np.ndarray) -> np.ndarray:
    """Number of blocks that sets of a band are cut into."""
    return np.minimum(np.ceil(BAND_TOPS[band] / SHARE).astype("int64") + 8, 1 << 22)


def _sets(data: np.ndarray, at: np.ndarray):
    """Distinct shingle digests of each row: digests sorted within rows, and rows' starts."""
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype("uint8")
    start, end, counts = R.words(data, at)
    words = R.Stretches(R.of_bytes(data, 0).digest(start, end), 1)
    first = np.cumsum(counts) - counts
    size = np.where(counts >= WORDS, counts - WORDS + 1, np.minimum(counts, 1))
    row = np.repeat(np.arange(len(counts)), size)
    s = np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    digest = words.digest(s, s + np.minimum(WORDS, counts[row])) if len(s) else np.zeros(0, "uint64")
    order = np.lexsort((digest, row))
    row, digest = row[order], digest[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (digest[1:] != digest[:-1])
    row, digest = row[new], digest[new]
    return digest, np.searchsorted(row, np.arange(len(counts) + 1))


def _segments(values, starts, ufunc):
    """ufunc.reduceat that gives 0 for empty segments; `starts` has one entry more than rows."""
    out = np.zeros(len(starts) - 1, values.dtype)
    full = np.flatnonzero(np.diff(starts))
    if len(full):
        out[full] = ufunc.reduceat(values, starts[full])
    return out


def _keys(digest: np.ndarray, cut: np.ndarray, band: np.ndarray, rows: np.ndarray):
    """Keys of the sets `rows` in their `band`: (row, key) and which rows need the second kind of key.

    Shingles are dealt to the band's blocks. A block's sketch has a bit per position, flipped by each
    shingle that lands on it, so the bits in which two blocks differ are at most the shingles in which
    they differ. Two sets that differ in d shingles differ in at most d blocks: with more than d blocks
    that are not empty, one of these is equal. Of these a set needs to show only the first d + 1 in an order
    that all sets share, here by set bits, most first, so that one common shingle alone rarely makes a key.
    A set with d or fewer blocks in use shows them all, and the first d + 1 of its shingles
    besides; two such sets that link have one of these in common.
    """
    n = np.diff(cut)[rows]
    nth = np.repeat(np.arange(len(rows)), n)
    src = np.repeat(cut[rows], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    x = R.mix(digest[src] ^ np.uint64(0x5851F42D4C957F2D))
    blocks = _blocks_of(band).astype("uint64")
    block = (x >> np.uint64(32)) % blocks[nth]
    code = np.sort((nth.astype("uint64") << np.uint64(42)) | (block << np.uint64(20)) | (x & np.uint64((1 << BLOCK_BITS) - 1)))
    code, flips = np.unique(code, return_counts=True)
    code = code[flips % 2 == 1]
    group = code >> np.uint64(20)
    new = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else np.zeros(0, "int64")
    owner = (group[new] >> np.uint64(22)).astype("int64")
    bits = np.diff(np.append(new, len(code)))
    inside = (code & np.uint64((1 << 42) - 1)) | (band.astype("uint64")[owner[np.repeat(np.arange(len(new)), bits)]] << np.uint64(48)) if len(code) else code
    sketch = np.bitwise_xor.reduceat(R.mix(inside), new) if len(new) else np.zeros(0, "uint64")
    key = R.mix(sketch + (group[new] & np.uint64((1 << 22) - 1)))
    order = np.lexsort((key, -bits, owner))
    owner, key = owner[order], key[order]
    used = np.bincount(owner, minlength=len(rows))
    shown = np.arange(len(owner)) - np.repeat(np.cumsum(used) - used, used) <= furthest(n)[owner]
    return rows[owner[shown]], key[shown], rows[used <= furthest(n)]


def describe(digest: np.ndarray, cut: np.ndarray):
    """For each set: size, two set digests, key rows and keys, and the whole-set parity sketch."""
    n = np.diff(cut)
    s1 = R.mix(_segments(R.mix(digest ^ np.uint64(0x94D049BB133111EB)), cut, np.add) + n.astype("uint64"))
    s2 = _segments(R.mix(digest ^ np.uint64(0xBF58476D1CE4E5B9)), cut, np.add)
    some = np.flatnonzero(n > 0)
    own = np.searchsorted(BAND_TOPS, n[some])
    # A set also visits the next band if a set it can link with may lie there.
    guest = some[(n[some] * OF // LEAST > BAND_TOPS[own])]
    rows, keys, short = zip(*(_keys(digest, cut, band, who) for band, who in
                              ((own, some), (np.searchsorted(BAND_TOPS, n[guest]) + 1, guest))))
    short = np.unique(np.concatenate(short))
    take = np.minimum(furthest(n[short]) + 1, n[short])
    src = np.repeat(cut[short], take) + np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take)
    row, key = np.concatenate([*rows, np.repeat(short, take)]), np.concatenate([*keys, R.mix(digest[src] + np.uint64(1))])
    order = np.argsort(row, kind="stable")
    bit = np.repeat(np.arange(len(n)), n) * SKETCH_BITS + (digest % np.uint64(SKETCH_BITS)).astype("int64")
    parity = (np.bincount(bit, minlength=len(n) * SKETCH_BITS) & 1).astype("uint8").reshape(len(n), SKETCH_BITS)
    return n, s1, s2, row[order], key[order], np.packbits(parity, axis=1)


def profiles(docs: DataFrame) -> DataFrame:
    """(d, tv, n, s1, s2, keys, sketch) of each document of `keyed`.

    keys and sketch are NULL for a set that the same task has shown before, so that exact copies are
    pre-aggregated before anything is shuffled.
    """
    names = ["d", "tv", "n", "s1", "s2", "keys", "sketch"]

    def work(batches):
        seen: set[int] = set()
        for batch in batches:
            ids, tvs = (np.asarray(batch.column(c)) for c in ("d", "tv"))
            data, at = R.text_column(batch, "t")
            for i, j in R.parts(at):
                n, s1, s2, row, key, sketch = describe(*_sets(data[at[i]:at[j]], at[i:j + 1] - at[i]))
                fresh = np.zeros(len(n), bool)
                for r, s in enumerate(s1.tolist()):
                    if n[r] and s not in seen:
                        seen.add(s)
                        fresh[r] = True
                cuts = np.searchsorted(row, np.arange(len(n) + 1))
                shown = fresh[row]
                lengths = np.where(fresh, np.diff(cuts), 0)
                ends = np.concatenate(([0], np.cumsum(lengths))).astype("int32")
                keys = pa.ListArray.from_arrays(pa.array(ends), pa.array(key[shown].view("int64")))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[i:j]), pa.array(tvs[i:j]), pa.array(n), pa.array(s1.view("int64")), pa.array(s2.view("int64")), keys,
                     pa.array([x.tobytes() if f else None for x, f in zip(sketch, fresh)], pa.binary())], names)

    return docs.select("d", "tv", "t").mapInArrow(
        work, "d long, tv long, n long, s1 long, s2 long, keys array<long>, sketch binary")


#: Members that each bucket's others are tried with first, and members of a bucket held in memory at once.
CENTRES, HELD = 4, 1_000_000


def _buckets(profile: DataFrame) -> DataFrame:
    """(k, s, centres): members of every key that several different sets show, and a few of them as centres.

    Rows of 16 bytes are sorted by key and read as a stream. The centres are the members that come
    first in CENTRES fixed random orders of all sets, so buckets with like members have like centres. A
    bucket of more than HELD members is handed on in parts with centres of their own.
    """
    def out(k, s, more=False):
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1])
        k, s = k[new], s[new]
        first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, "int64")
        size = np.diff(np.append(first, len(k)))
        several = np.repeat((size > 1) | more, size)
        centres = []
        for c in range(CENTRES):
            order = R.mix(s.view("uint64") + np.uint64(c * 0x9E3779B97F4A7C15 % (1 << 64)))
            least = np.repeat(np.minimum.reduceat(order, first), size) if len(k) else order
            at = np.flatnonzero(order == least)  # one in each bucket: the orders have no ties
            centres.append(np.repeat(s[at], size))
        flat = np.stack(centres, axis=1)[several].ravel() if len(k) else np.zeros(0, "int64")
        ends = np.arange(0, len(flat) + 1, CENTRES, dtype="int32")
        return pa.RecordBatch.from_arrays(
            [pa.array(k[several]), pa.array(s[several]), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["k", "s", "centres"])

    def work(batches):
        held, parted = (np.zeros(0, "int64"),) * 2, False  # the last key may go on in the next batch
        for batch in batches:
            k, s = (np.concatenate((h, np.asarray(batch.column(c)))) for h, c in zip(held, ("k", "s")))
            if not len(k):
                continue
            start = int(np.searchsorted(k, k[-1]))
            if start:
                if parted:
                    end = int(np.searchsorted(k, k[0], "right"))
                    yield out(k[:end], s[:end], True)
                    yield out(k[end:start], s[end:start])
                else:
                    yield out(k[:start], s[:start])
                parted = False
            held = k[start:], s[start:]
            if len(held[0]) > HELD:
                yield out(*held, True)
                held, parted = (held[0][-1:], held[1][-1:]), True
        yield out(*held, parted)

    rows = profile.where("keys is not null and size(keys) > 0").select(F.explode("keys").alias("k"), F.col("s1").alias("s"))
    return rows.repartition("k").sortWithinPartitions("k", "s").mapInArrow(work, "k long, s long, centres array<long>")


def _near(na, nb, xa, xb):
    """Whether sizes and sketches allow a link: the bits in which parities differ never exceed the difference."""
    apart = np.bitwise_count(xa ^ xb).sum(axis=-1, dtype="int64")
    return (OF * np.minimum(na, nb) >= LEAST * np.maximum(na, nb)) & (9 * apart <= na + nb)


def _sketches(column) -> np.ndarray:
    """A column of equally long byte strings as rows of 64-bit words."""
    return np.frombuffer(b"".join(column.to_pylist()), "uint64").reshape(len(column), SKETCH_BITS // 64)


def _likely(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs (x, y) that pass the sketch filter."""
    def work(batches):
        for b in batches:
            ok = _near(np.asarray(b.column("nx")), np.asarray(b.column("ny")), _sketches(b.column("kx")), _sketches(b.column("ky")))
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(b.column(c))[ok]) for c in ("x", "y")], ["x", "y"])

    one = sketches.select(F.col("s").alias("x"), F.col("n").alias("nx"), F.col("sketch").alias("kx"))
    two = sketches.select(F.col("s").alias("y"), F.col("n").alias("ny"), F.col("sketch").alias("ky"))
    return pairs.join(one, "x").join(two, "y").select("x", "y", "nx", "ny", "kx", "ky").mapInArrow(work, "x long, y long")


def _tiled(members: DataFrame) -> DataFrame:
    """Likely pairs (x, y) of different components among the members (k, s, c, n, sketch, tiles) of each bucket.

    A bucket is cut into tiles of about TILE members and each pair of tiles is compared by itself, so
    no task holds a bucket; only pairs that pass the sketch filter leave the comparison.
    """
    def compare(s, c, n, x, tile, i, j):
        a, b = np.flatnonzero(tile == i), np.flatnonzero(tile == j)
        for p in a.tolist():
            q = b[s[b] > s[p]] if i == j else b
            q = q[c[q] != c[p]]
            q = q[_near(n[p], n[q], x[p], x[q])]
            if len(q):
                yield np.minimum(s[p], s[q]), np.maximum(s[p], s[q])

    def work(batches):
        import pandas as pd

        def out(pdf):
            found = []
            x = np.frombuffer(b"".join(pdf["sketch"]), "uint64").reshape(len(pdf), -1)
            s, c, n, tile = (pdf[f].to_numpy() for f in ("s", "c", "n", "tile"))
            for (_, i, j), at in pdf.groupby(["k", "i", "j"], sort=False).indices.items():
                found.extend(compare(s[at], c[at], n[at], x[at], tile[at], i, j))
            cols = [np.concatenate(f) for f in zip(*found)] if found else [np.zeros(0, "int64")] * 2
            return pa.RecordBatch.from_arrays([pa.array(f) for f in cols], ["x", "y"])

        held = None
        for batch in batches:
            pdf = batch.to_pandas()
            pdf = pd.concat([held, pdf]) if held is not None else pdf
            last = pdf.iloc[-1] if len(pdf) else None
            if last is None:
                continue
            tail = ((pdf["k"] == last["k"]) & (pdf["i"] == last["i"]) & (pdf["j"] == last["j"])).to_numpy()
            if not tail.all():
                yield out(pdf[~tail])
            held = pdf[tail]
        if held is not None and len(held):
            yield out(held)

    spread = (members.withColumn("tile", F.expr("pmod(xxhash64(s), tiles)").cast("int"))
              .withColumn("other", F.explode(F.expr("sequence(0, cast(tiles as int) - 1)")))
              .select("k", "s", "c", "n", "sketch", "tile", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j")))
    return spread.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j").mapInArrow(work, "x long, y long").distinct()


def _sets_of(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(s, set): the sorted shingle digests of one document of each set in `places` (s, d, tv)."""
    def work(batches):
        for batch in batches:
            s = np.asarray(batch.column("s"))
            data, at = R.text_column(batch, "t")
            for i, j in R.parts(at):
                digest, cut = _sets(data[at[i]:at[j]], at[i:j + 1] - at[i])
                raw = [digest[x:y].tobytes() for x, y in zip(cut[:-1].tolist(), cut[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(s[i:j]), pa.array(raw, pa.binary())], ["s", "set"])

    return docs.join(places, ["d", "tv"]).select("s", "t").mapInArrow(work, "s long, set binary")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (x, y) whose sets really reach the similarity."""
    def work(batches):
        for batch in batches:
            ok = []
            for a, b in zip(batch.column("ax"), batch.column("by")):
                a, b = np.frombuffer(a.as_py(), "uint64"), np.frombuffer(b.as_py(), "uint64")
                both = len(np.intersect1d(a, b, assume_unique=True))
                ok.append(OF * both >= LEAST * (len(a) + len(b) - both))
            ok = np.array(ok, bool)
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(batch.column(c))[ok]) for c in ("x", "y")], ["x", "y"])

    one, two = sets.select(F.col("s").alias("x"), F.col("set").alias("ax")), sets.select(F.col("s").alias("y"), F.col("set").alias("by"))
    return pairs.join(one, "x").join(two, "y").select("x", "y", "ax", "by").mapInArrow(work, "x long, y long")


def link(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Groups of documents linked by a 5-word-shingle Jaccard similarity of 0.8 or more.

    1. Each document becomes a set of shingle digests, cut into blocks by size band, and shows a key for
       as many blocks as its size requires (see `_keys`); exact copies show theirs once per task.
    2. Sets that share a key are candidates. First each member is tried with a few centres of its bucket;
       the sketches of the two whole sets rule out most wrong pairs, the real sets decide on the rest.
       This links large groups of near copies without pairing them all.
    3. Members of one bucket that are still in different components are compared tile by tile, sketch
       filter first; whatever passes is decided by the real sets. No link between different sets is
       left out: every pair in a bucket is linked through others, ruled out, or tried.
    4. Components of all links.

    Lower-cases A to Z; fewer than five words: the whole sequence is one shingle; NULL, empty or
    wordless text: empty set, linked with nothing. Equal sets are one group. Rows with a NULL
    identifier take part, but name no component: one of only such rows has a NULL component_id.
    Sets are told apart by 64-bit digests.
    Returns key, n_shingles, component_id (smallest identifier of the group), text_digest (xxhash64).
    """
    rows = keyed(docs, key, text).withColumn("d", inner_id())
    profile = stored(profiles(rows), "profiles")
    sketches = (profile.where("sketch is not null").groupBy(F.col("s1").alias("s"))
                .agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    bucket = stored(_buckets(profile), "buckets")
    star = bucket.select("s", F.explode(F.array_distinct("centres")).alias("c")).where("s <> c")
    stars = star.select(F.least("s", "c").alias("x"), F.greatest("s", "c").alias("y")).distinct()
    tried = stored(_likely(stars, sketches), "pairs")

    def decide(pairs):
        named = pairs.select(F.col("x").alias("s1")).union(pairs.select(F.col("y").alias("s1"))).distinct()
        one_of = profile.where("sketch is not null").join(named, "s1").groupBy(F.col("s1").alias("s")).agg(
            F.min(F.struct("d", "tv")).alias("p")).select("s", "p.d", "p.tv")
        sets = stored(_sets_of(rows, one_of).dropDuplicates(["s"]), "sets")
        return stored(_verified(pairs, sets), "links")

    links = decide(tried)
    if not links.isEmpty() or not bucket.isEmpty():
        group = components(links)
        tagged = bucket.select("k", "s").distinct().join(group.select(F.col("node").alias("s"), "root"), "s", "left").select(
            "k", "s", F.coalesce("root", "s").alias("c"))
        mixed = (tagged.groupBy("k").agg(F.min("c").alias("p"), F.max("c").alias("q"), F.count("*").alias("m")).where("p <> q")
                 .select("k", F.ceil(F.col("m") / TILE).alias("tiles")))
        rest = stored(_tiled(tagged.join(mixed, "k").join(sketches, "s")).join(tried, ["x", "y"], "left_anti"), "pairs")
        if not rest.isEmpty():
            links = links.unionByName(decide(rest))
            group = components(links)
    else:
        group = components(links)

    member = profile.select("d", "tv", "n", "s1").join(group.select(F.col("node").alias("s1"), "root"), "s1", "left")
    member = stored(member.select("d", "tv", "n", F.when(F.col("n") > 0, F.coalesce("root", "s1")).alias("g")), "groups")
    least = member.where("g is not null").groupBy("g").agg(F.min(outer_id()).alias("least"))
    return (member.join(least, "g", "left")
            .select(outer_id().alias(key), F.col("n").alias("n_shingles"),
                    F.when(F.col("g").isNull(), outer_id()).otherwise(F.col("least")).alias("component_id"),
                    F.col("tv").alias("text_digest")))


@query("op3_jaccard_join")
def op3(spark, sf_dir):
    return link(table(spark, sf_dir, "documents")).drop("text_digest")
