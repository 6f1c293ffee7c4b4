"""Hard negatives, SimHash classes and source divergence against plain versions."""

import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from relievo.llm import divergence, hard_negatives, simhash
from relievo.llm.queries import load_all

from . import brute as B

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = load_all()
DOCS = B.sample_docs()


@pytest.fixture(scope="module")
def docs(spark):
    return B.clashing(spark, DOCS).repartition(3, "text").persist()


def connected():
    con = duckdb.connect()
    for n in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{SF}/{n}.parquet'")
    return con


def rows_of(df):
    names = sorted(df.columns)
    return sorted(tuple(r[c] for c in names) for r in df.select(*names).collect())


def sql_rows(name):
    out = connected().execute(ORACLES[name])
    names = [d[0] for d in out.description]
    order = [names.index(c) for c in sorted(names)]
    return sorted(tuple(r[i] for i in order) for r in out.fetchall())


# --- hard negatives

def brute_negatives(rows, anchors, positives=5, negatives=3, scale=256):
    def clean(rows):
        return [(i, n, [math.floor(float(x) * scale) for x in v]) for i, v, n in rows if i is not None and n is not None and v is not None
                and all(x is not None and math.isfinite(x) for x in v)]

    def dot(a, b):
        return sum(x * y for x, y in zip(a, b))

    rows, of = clean(rows), {}
    for i, n, v in sorted(clean(anchors)):
        of.setdefault(i, (n, v))
    out = []
    for a, (label, v) in of.items():
        scored = sorted((-dot(v, x), i, n) for i, n, x in rows if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            fit = [x for x in scored if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s][:negatives]
            out += [(a, p, r, i, -s, -t) for r, (t, i, _) in enumerate(fit, 1)]
    return sorted(out)


def odd_vectors(dims=19, spread=1.0):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-0.4, 1.0) * spread for _ in range(dims)], rng.choice([0, 0, 0, 1, 2, -1])) for i in range(220)]
    rows += [(300, rows[7][1], 0), (301, rows[7][1], 1), (302, rows[7][1], 1), (303, None, 1), (304, [1.0, None], 1), (305, [float("nan")] * 3, 0),
             (306, [float("inf")], 0), (307, [], 2), (308, [0.5], 0), (309, rows[8][1] + [0.25, 0.5], 1), (310, rows[9][1], None),
             (None, rows[9][1], 1), (40, rows[40][1], rows[40][2]), (41, rows[41][1], 1), (311, rows[12][1], 0), (311, rows[12][1], 0)]
    return rows


NAMES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.mark.parametrize("spread", [1.0, 3e4, 3e5, 1e12])
def test_negatives_match_brute_force(spark, monkeypatch, spread):
    """Ties, repeated rows, odd vectors; scores of 32 bits, 64 bits and beyond."""
    monkeypatch.setattr(hard_negatives, "ANCHORS", 7)
    rows = odd_vectors(spread=spread)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("slice", F.lit("x")).repartition(5, "vec_id")
    out = hard_negatives.hard_negatives(df, df.where("vec_id % 5 = 0"))
    got = sorted(tuple(r[c] for c in NAMES) for r in out.collect())
    want = brute_negatives(rows, [r for r in rows if r[0] is not None and r[0] % 5 == 0])
    if spread < 1e12:
        assert got == want and len(want) > 100
    else:
        assert all(r[4] == (1 << 63) - 1 for r in got)


def test_negatives_query(spark):
    out = QUERIES["op11_hard_negatives"](spark, SF)
    assert rows_of(out) == sql_rows("op11_hard_negatives") != []
    empty = spark.read.parquet(f"{SF}/embeddings.parquet").limit(0)
    assert hard_negatives.hard_negatives(empty, empty).collect() == []


def test_subset_tables():
    rng = np.random.default_rng(1)
    x, q = rng.integers(-300, 300, (40, 16)), rng.integers(-300, 300, (9, 16))
    assert (hard_negatives.scores(hard_negatives.bit_planes(x), hard_negatives.subset_sums(q)) == x @ q.T).all()
    one = np.full((3, 8), -1)
    assert (hard_negatives.scores(hard_negatives.bit_planes(one), hard_negatives.subset_sums(q[:, :8])) == one @ q[:, :8].T).all()


# --- SimHash

def brute_print(t):
    w = B.words((t or "").translate(B.UPPER))
    grams = [" ".join(w[i:i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(prints):
    root = list(range(len(prints)))
    p = np.array(prints, "uint64")
    for i in range(len(p)):
        for j in np.flatnonzero(np.bitwise_count(p ^ p[i]) <= 4).tolist():
            a, b = sorted((root[i], root[j]))
            if a != b:
                root = [a if r == b else r for r in root]
    return root


def expected(rows):
    prints = [brute_print(t) for _, t in rows]
    root = brute_classes(prints)
    least = {}
    for r, (d, _) in zip(root, rows):
        least[r] = min(least.get(r, (1, 0)), (d is not None, d or 0)) if r in least else (d is not None, d or 0)
    return Counter((d, f"{p:016x}", least[r][1] if least[r][0] else None) for (d, _), p, r in zip(rows, prints, root))


def test_simhash_matches_brute_force(docs):
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_copies(docs).collect())
    assert got == expected(DOCS)
    assert simhash.near_copies(docs.limit(0)).collect() == []


def test_simhash_query(spark):
    table = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in QUERIES["op12_simhash_near_dedup"](spark, SF).collect())
    assert got == expected(table)


@pytest.mark.parametrize("bucket", [2048, 40, 6])
def test_simhash_links(spark, bucket):
    """Clusters, chains and strangers; small buckets lead to longer keys and to tiles."""
    rng = random.Random(9)
    prints = {rng.getrandbits(64) for _ in range(300)}
    for _ in range(4):
        centre = rng.getrandbits(64)
        prints |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3]))) for _ in range(60)}
    walk = rng.getrandbits(64)
    for _ in range(40):
        walk ^= sum(1 << b for b in rng.sample(range(64), rng.choice([4, 4, 5])))
        prints.add(walk)
    same_head = rng.getrandbits(64) & ~((1 << 25) - 1)
    prints |= {same_head | rng.getrandbits(25) for _ in range(120)} | {0, (1 << 64) - 1}
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    found = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.links(df, bucket).collect()]
    at = {p: i for i, p in enumerate(prints)}
    root = list(range(len(prints)))
    for a, b in found:
        x, y = sorted((root[at[a]], root[at[b]]))
        root = [x if r == y else r for r in root]
    assert root == brute_classes(prints)


def test_chain_always_exists():
    """Any difference of at most FAR bits has a start from which the budgets hold."""
    rng = random.Random(2)
    for _ in range(2000):
        x = np.uint64(sum(1 << b for b in rng.sample(range(64), 4)))
        assert any(len(simhash.viable(np.array([0], "uint64"), np.array([0, x], "uint64"), s).__next__()[0]) for s in range(5))


def test_long_text_is_counted_in_parts(monkeypatch):
    monkeypatch.setattr(simhash, "COUNTED", 7)
    t = "one Two  three\nfour five " * 30
    raw = [t.encode(), b"", b"x y", t.encode()[:60]]
    data, at = np.frombuffer(b"".join(raw), "uint8"), np.cumsum([0, *map(len, raw)])
    assert simhash.fingerprint(*simhash.shingle_digests(data, at)).tolist() == [brute_print(x.decode()) for x in raw]


# --- divergence

def brute_divergence(rows, least=10, top=10):
    """rows: (lang, source, text)."""
    import re
    term = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    seen, count, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, t in rows:
        lang, source = lang or "", source or ""
        w = term.findall((t or "").translate(B.UPPER))
        groups.add((lang, source))
        seen[lang].update(set(w))
        count[lang, source].update(w)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in seen[lang].items() if n >= least]
        mine = sorted(g for g in groups if g[0] == lang)
        whole = sum((count[g] for g in mine), Counter())

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        q, p = shares(whole), {g: shares(count[g]) for g in mine}
        for g in mine:
            pairs = [(-sum((p[g][t] - p[o][t]) ** 2 // (p[g][t] + p[o][t]) for t in kept), o[1].encode()) for o in mine if o != g]
            terms = [(-((p[g][t] - q[t]) ** 2 // (p[g][t] + q[t])), t.encode()) for t in kept if count[g][t] and p[g][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(item.decode(), lang, part, rank, g[1], -v) for rank, (v, item) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(32, 2048), (2, 5)])
def test_divergence_matches_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(divergence, "HELD", 50)
    monkeypatch.setattr(divergence, "PIECE", 11)
    rng = random.Random(4)
    vocab = ["Ångström", "wort", "Über", "the", "THE", "x", "日本", "a1b", "don't", "straße", "q", "zebra"]
    rows = []
    for n in range(260):
        lang, source = rng.choice(["en", "en", "de", None, "rare"]), rng.choice(["s0", "s0", "s1", "s2", "", None, "s3", "só"])
        rows.append((lang if n % 90 else "few", source, " ".join(rng.choices(vocab, [9, 5, 4, 3, 3, 2, 2, 1, 1, 1, 1, 1], k=rng.randrange(0, 25))) + rng.choice(["", ".", "\n\t"])))
    rows += [("en", "s1", None), ("alone", "one", "the the"), ("en", "s0", "the " * 2000), (None, None, None), ("en", "nothing", "1234 --")]
    df = spark.createDataFrame(rows, "lang string, source string, text string").withColumn("n", F.lit(1)).repartition(3, "text")
    out = divergence.source_divergence(df, groups=blocks[0], terms=blocks[1])
    assert rows_of(out) == brute_divergence(rows)
    assert divergence.source_divergence(df.limit(0)).collect() == []


def test_divergence_query(spark):
    out = QUERIES["op13_source_divergence"](spark, SF)
    assert rows_of(out) == sql_rows("op13_source_divergence") != []


def test_divergence_of_huge_counts():
    """Counts whose product with the unit passes 64 bits."""
    cell = {"a_totals": [3 * 10**12], "a_cells": [np.array(x, k).tobytes() for x, k in (([0, 0], "int32"), ([0, 2], "int32"), ([2 * 10**12, 10**12], "int64"))], "vocabulary": 3}
    assert divergence._dense(cell, "a", 3).tolist() == [[1 + 10**9 * (n + 2) // (3 * 10**12 + 6) for n in (2 * 10**12, 0, 10**12)]]
