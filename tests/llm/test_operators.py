"""Each operator against a plain version, on documents with every odd case and on the smallest tables."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from relievo.llm import bpe, jaccard_join, packing, pii, quality, sharding, substring_dedup, suffix_dedup, token_counts, topk
from relievo.llm.graph import components
from relievo.llm.queries import load_all

from . import brute as B

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = load_all()
DOCS = B.sample_docs()


@pytest.fixture(scope="module")
def docs(spark):
    return B.clashing(spark, DOCS).repartition(3, "text").persist()


@pytest.fixture(scope="module")
def table():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def sha(b):
    return hashlib.sha256(b).hexdigest()


# --- personal data

def expected_pii(rows):
    return sorted((str(d), len(B.base_pii(t)), sha(",".join(f"{k}:{a}:{b}" for k, a, b in B.base_pii(t)).encode())) for d, t in rows)


def test_pii_base(docs):
    out = pii.find_pii(docs).collect()
    got = []
    for r in out:
        base = [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["base"]]
        got.append((str(r["doc_id"]), len(base), sha(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode())))
    assert sorted(got) == expected_pii(DOCS)


def test_pii_query(spark, table):
    out = QUERIES["op1_pii"](spark, SF).collect()
    assert sorted((str(r["doc_id"]), r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"], r["base_sha256"]) for r in out) == expected_pii(table)


def test_pii_long_runs(spark):
    """Runs without end stay linear: a quadratic search would not return."""
    n = 50_000
    text = "1" * n + " " + "a" * n + " " + "1." * n + " +1" + " " * n + "(at" * n
    r = pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    first = 2 * n + 2
    assert [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["base"]] == [
        ("ip", first + 8 * i, first + 8 * i + 7) for i in range(n // 4)]


def test_pii_adds_what_labelers_agree_on(spark):
    rows = [(i, f"please call phone: (2{i:02d}) 555-24{i:02d} soon") for i in range(40)]
    rows += [(100 + i, f"table 4{i:02d}.555.24{i:02d} page") for i in range(5)]
    out = {r["doc_id"]: r["spans"] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all([s["kind"] for s in out[i]] == ["phone"] and not out[i][0]["base"] for i in range(40))


def test_pii_reliabilities():
    # Two labelers that agree and one that errs: the estimate puts the third below the others.
    rows = [("p", (1, 1, 1), 60), ("p", (1, 1, 0), 40), ("p", (0, 0, 1), 40), ("p", (0, 0, 0), 60)]
    chance, rates = pii.estimate(rows)
    assert chance[0] > 0.9 and chance[1] > 0.9 and chance[2] < 0.1 and chance[3] < 0.1
    assert rates["hit"][2] < 0.7 < rates["hit"][0]


def test_redaction(docs):
    out = pii.redact_pii(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r["text"] for r in out.where("doc_id in (20, 80, 23)").collect()}
    assert got[20] is None and got[23] == "one"
    assert got[80].startswith("mail [EMAIL] now, bob@x, [EMAIL][EMAIL]; call [PHONE] or +1 2; ip [IP] or 300.1.1.1, [IP].5")
    assert out.count() == len(DOCS)


# --- BPE

def test_bpe_matches_library(docs):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(bpe.default_path("byte_bpe_50k.json"))
    got = Counter((r["doc_id"], bytes(r["ids"]), r["text"]) for r in bpe.decode(bpe.encode(docs)).collect())
    want = Counter()
    for d, t in DOCS:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want[d, np.array(ids, "<u4").tobytes(), tok.decode(ids, skip_special_tokens=False)] += 1
    assert got == want


@pytest.mark.parametrize("remembered", [0, 1 << 20])
def test_bpe_in_parts(docs, monkeypatch, remembered):
    """Texts above the size of a run, a cache that is emptied each time, and the one-worker form."""
    import pyarrow as pa
    monkeypatch.setattr(bpe, "CHUNK_BYTES", 300)
    monkeypatch.setattr(bpe, "REMEMBERED", remembered)
    v = bpe.Vocabulary(bpe.default_path("byte_bpe_50k.json"))
    values = [t or "" for _, t in DOCS]
    parts = list(bpe._parts(pa.RecordBatch.from_pydict({"t": values})))
    assert [t for _, p in parts for t in p] == values and len(parts) > 10
    assert all(values[at:at + len(p)] == p for at, p in parts)
    assert [v.decode(b) for _, p in parts for b in v.encode(p)] == values
    both = Counter((r["doc_id"], bytes(r["ids"]), r["text"]) for r in bpe.round_trip(docs).collect())
    assert both == Counter((r["doc_id"], bytes(r["ids"]), r["text"]) for r in bpe.decode(bpe.encode(docs)).collect())


def test_bpe_random_strings():
    import random

    from tokenizers import Tokenizer
    tok, v, rng = Tokenizer.from_file(bpe.default_path("byte_bpe_50k.json")), bpe.vocabulary(bpe.default_path("byte_bpe_50k.json")), random.Random(3)
    alphabet = "aaab  \n\t'sdlé日 ​1!?<|endoftext|>　"
    values = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 60))) for _ in range(3000)]
    assert [np.frombuffer(b, "<u4").tolist() for b in v.encode(values)] == [tok.encode(x, add_special_tokens=False).ids for x in values]


def test_bpe_query(spark, table):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(bpe.default_path("byte_bpe_50k.json"))
    got = {r["doc_id"]: r for r in QUERIES["op2_bpe_round_trip"](spark, SF).collect()}
    for d, t in table:
        ids = tok.encode(t, add_special_tokens=False).ids
        assert (got[d]["n_tokens"], got[d]["ids_sha256"], got[d]["decoded_sha256"]) == (
            len(ids), sha(np.array(ids, "<u4").tobytes()), sha(tok.decode(ids, skip_special_tokens=False).encode()))


# --- Jaccard join

def expected_groups(rows):
    sets = [B.shingles(t) for _, t in rows]
    root = B.components(sets)
    least = {}
    for (d, _), r in zip(rows, root):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return sorted(str((d, len(s), least.get(r) if s else d)) for (d, _), s, r in zip(rows, sets, root))


def test_jaccard_groups(docs):
    out = jaccard_join.link(docs).collect()
    assert sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in out) == expected_groups(DOCS)


def test_jaccard_query(spark, table):
    out = QUERIES["op3_jaccard_join"](spark, SF).collect()
    assert sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in out) == expected_groups(table)


def test_jaccard_near_the_threshold(spark):
    """Pairs just above and below the similarity, in many sizes; none is lost, none invented."""
    import random
    rng, rows = random.Random(11), []
    for n in [*range(5, 40), 60, 100, 200, 400]:
        base = [f"w{rng.randrange(10**6)}" for _ in range(n + 4)]
        cut = rng.randrange(0, max(1, n // 5) + 2)
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(base[cut:])), (len(rows) + 2, " ".join(base[:n + 4 - cut // 2] + ["end"]))]
    out = jaccard_join.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in out) == expected_groups(rows)


def test_jaccard_hot_group_in_tiles(spark, monkeypatch):
    """A bucket larger than what is held or compared at once gives the same groups."""
    import random
    monkeypatch.setattr(jaccard_join, "TILE", 4)
    monkeypatch.setattr(jaccard_join, "CENTRES", 1)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        w = base[:]
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(120)] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    out = jaccard_join.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in out) == expected_groups(rows)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (102, 102), (100, 200)] + [(500, 500 + i) for i in range(1, 50)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and got[200] == got[101] == 100 and got[549] == 500 and 102 not in got


# --- packing

def check_packing(rows, out):
    tok = packing.lookup(packing.default_path("word_bpe_49k.json")).tokenizer
    want = Counter()
    for d, t in rows:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        for i, lo in enumerate(range(0, len(ids), 4096)):
            own = ids[lo:lo + 4096]
            want[d, i, lo, len(own), zlib.crc32(own.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r["length"] for r in out)
    assert len(by) <= max(2, 1.03 * -(-total // 4096))


def test_packing(docs):
    check_packing(DOCS, packing.pack_documents(docs).collect())


def test_packing_query(spark, table):
    check_packing(table, QUERIES["op4_best_fit_packing"](spark, SF).collect())


def test_packing_plans_place_every_item():
    import random
    rng = random.Random(1)
    for _ in range(20):
        counts = Counter(rng.randrange(1, 4097) for _ in range(rng.randrange(1, 3000)))
        sizes, items, plan = packing.plan_large({x: n for x, n in counts.items() if x > 512}, 4096, 512, 32)
        used = Counter()
        for times, use in plan:
            assert sum(sizes[g] * n for g, n in use.items()) <= 4096
            for g, n in use.items():
                used[g] += times * n
        assert [used[g] for g in range(len(items))] == items
        little = {x: n for x, n in counts.items() if x <= 512}
        moves, _ = packing.plan_small({700: 3, 40: 2}, little, 4096)
        placed = Counter()
        for x, first, n, _, _ in moves:
            assert first == placed[x]
            placed[x] += n
        assert placed == Counter(little)


# --- sharding

def check_shards(rows, out, shards=8):
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter(
        (d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    by = {}
    for r in out:
        by.setdefault(r["shard"], []).append(r["slot"])
    sizes = [len(by.get(i, [])) for i in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_shards(docs):
    check_shards(DOCS, sharding.interleave(docs).collect())


def test_shard_query_keeps_the_mixture(spark, table):
    out = QUERIES["op5_sharding"](spark, SF).collect()
    check_shards(table, out)
    mix, total = Counter((r["shard"], r["stratum"]) for r in out), Counter(r["stratum"] for r in out)
    assert all(abs(mix[s, k] - n / 8) <= 2 for k, n in total.items() for s in range(8))


def test_shards_do_not_depend_on_slices(docs, monkeypatch):
    monkeypatch.setattr(sharding, "SLICE_ROWS", 3)
    fine = {(r["doc_id"], r["text_crc32"], r["shard"], r["slot"]) for r in sharding.interleave(docs).collect()}
    monkeypatch.setattr(sharding, "SLICE_ROWS", 10_000)
    assert fine == {(r["doc_id"], r["text_crc32"], r["shard"], r["slot"]) for r in sharding.interleave(docs).collect()}


# --- quality

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_quality_statistics(spark, docs):
    trusted = spark.createDataFrame([(1,), (2,), (None,)], "doc_id long")
    out = quality.assess(docs, trusted).collect()
    assert Counter((r["doc_id"], *[r[c] for c in STATS]) for r in out) == Counter((d, *B.quality(t)) for d, t in DOCS)
    assert not any(r["kept"] for r in out if r["base_failed"])


def test_quality_verdict(spark):
    import pandas as pd
    out = QUERIES["op6_quality_rules"](spark, SF).toPandas()
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    assert Counter(tuple(x) for x in out[["doc_id", *STATS]].itertuples(index=False)) == Counter((d, *B.quality(t)) for d, t in rows)
    labels = duckdb.sql(f"SELECT * FROM '{SF}/labels.parquet'").df()
    seen = pd.merge(out[~out.base_failed], labels, on="doc_id")
    good, bad = seen[(seen.quality == 1) & (seen.toxic == 0)], seen[seen.quality == 0]
    assert good.kept.mean() > 0.98 and (len(bad) == 0 or bad.kept.mean() < 0.1)


def test_quality_on_held_out_labels(spark):
    """Half of the labelled documents are held back from training; the verdict still tells them apart."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    half = quality.trusted_of(labels.where("pmod(xxhash64(doc_id), 2) = 0"))
    seen = quality.assess(d, half).join(labels.where("pmod(xxhash64(doc_id), 2) = 1"), "doc_id").where("not base_failed").toPandas()
    assert seen[(seen.quality == 1)].kept.mean() > 0.98 and seen[seen.quality == 0].kept.mean() < 0.1


def test_quality_without_trusted(spark, docs):
    out = quality.assess(docs, spark.createDataFrame([], "doc_id long")).collect()
    assert all(r["kept"] == (not r["base_failed"]) and r["score"] == 0 for r in out)


# --- repeats

def test_word_repeats(docs):
    want = B.word_repeats(DOCS)
    expected = Counter((d, *want[d, t]) for d, t in DOCS)
    out = substring_dedup.remove_repeats(docs).collect()
    assert Counter((r["doc_id"], r["n"], r["n_removed"], r["kept_sha256"]) for r in out) == expected
    assert all(sha(r["kept"].encode()) == r["kept_sha256"] and r["n_removed"] == sum(s["e"] - s["s"] for s in r["removed"]) for r in out)


def test_word_repeats_query(spark, table):
    want = B.word_repeats(table)
    out = QUERIES["op7_substring_dedup"](spark, SF).collect()
    assert {(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out} == {(d, *want[d, t]) for d, t in table}


@pytest.mark.parametrize("tree", [2000, 2])
def test_byte_repeats(docs, monkeypatch, tree):
    monkeypatch.setattr(suffix_dedup, "TREE_ROWS", tree)
    want = B.byte_repeats(DOCS)
    out = suffix_dedup.remove_repeats(docs, others=("source", "hits")).collect()
    assert Counter((r["doc_id"], r["n"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out) == Counter((d, *want[d, t]) for d, t in DOCS)
    assert {r["hits"] for r in out} == {"z"}


@pytest.mark.parametrize("window,least", [(400, 250), (400, 400), (150, 65)])
def test_byte_repeats_with_report(docs, window, least):
    """The shorter repeats are reported; what is removed is the same as without the report."""
    want, short = B.byte_repeats(DOCS, window), B.byte_repeats(DOCS, least)
    out = suffix_dedup.remove_repeats(docs, window, least=least).collect()
    assert Counter((r["doc_id"], r["n"], r["n_removed"], r["n_spans"], r["kept_sha256"], r["n_repeated"], r["n_repeats"]) for r in out) == Counter(
        (d, *want[d, t], *short[d, t][1:3]) for d, t in DOCS)
    assert suffix_dedup.remove_repeats(docs.limit(0), window, least=least).collect() == []


def test_byte_repeats_query(spark, table):
    want, short = B.byte_repeats(table), B.byte_repeats(table, 250)
    out = QUERIES["op9_suffix_array_dedup"](spark, SF).collect()
    assert {(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], r["n_repeated"], r["n_repeats"]) for r in out} == {
        (d, *want[d, t], *short[d, t][1:3]) for d, t in table}


def test_maximal_repeats_give_all_occurrences():
    left = [x[::-1].encode() for x in ("xxabcd", "yyabcd", "zzzbcd", "qqqqqq")]
    right = [x.encode() for x in ("efghij", "efghkk", "efgmmm", "efghij")]
    got = {(tuple(sorted(m)), l, r) for m, l, r in suffix_dedup.maximal_repeats(left, right, 6)}
    assert ((0, 1), 4, 4) in got and ((0, 1, 2), 3, 3) in got and ((0, 3), 0, 6) in got


# --- search

def brute_top(rows, wanted, k):
    def ok(v):
        return v is not None and all(x is not None and np.isfinite(x) for x in v)
    vec = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if ok(v)]
    out = set()
    for q, a in {i: a for i, a in vec if wanted(i)}.items():
        scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in vec if i != q)
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])}
    return out


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 5) / 4]) for i in range(150)]
    rows += [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0]), (202, [float("nan")] * 5), (203, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (204, [0.5, 0.5]), (205, [])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    got = topk.top_k(df, df.where("vec_id % 10 = 0"), 7).collect()
    assert {tuple(r) for r in got} == brute_top(rows, lambda i: i % 10 == 0, 7)
    few = df.where("vec_id < 4")
    assert {tuple(r) for r in topk.top_k(few, few, 10).collect()} == brute_top(rows[:4], lambda i: True, 10)


def test_top_k_stops_reading(monkeypatch):
    """Decided queries are not read on, candidates that are out are not read again, and the answer stays exact."""
    rounds, bounds = [], topk.score_bounds

    def seen(plus, minus, x, *rest):
        rounds.append((len(plus), len(x)))
        return bounds(plus, minus, x, *rest)

    monkeypatch.setattr(topk, "score_bounds", seen)
    rng = np.random.default_rng(2)
    x = np.floor(1024 * rng.normal(size=(800, 2)) ** 3)
    x[:, 1] = np.floor(x[:, 1] / 50)
    ids = np.arange(800)
    for q in (x[:40], np.sign(x[:40]), np.array([[1.0, 0.0]])):
        rounds.clear()
        for i, (qi, got, scores) in enumerate(topk.scan_lists(q, ids[:len(q)], x, ids, 5)):
            want = sorted((-int(v), int(j)) for v, j in zip(x @ q[i], ids) if j != qi)[:5]
            assert list(zip((-scores).tolist(), got.tolist())) == want
        assert rounds[0] == (len(q), 800 - (len(q) == 1))  # a query is no candidate of its own
        assert all(b[0] < a[0] and b[1] <= a[1] for a, b in zip(rounds, rounds[1:])), rounds
    assert rounds == [(1, 799)]  # one component: the first eighth of its list holds the five best


def test_top_k_beyond_doubles(spark):
    """Scores above 2^53 are exact; those above 63 bits are held at the limit."""
    rows = [(i, [1e6 + i / 1024, 1e6 - (i % 5) / 512]) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {tuple(r) for r in topk.top_k(df, df.where("vec_id = 0"), 5).collect()} == brute_top(rows, lambda i: i == 0, 5)
    far = spark.createDataFrame([(i, [1e12 * (i + 1)]) for i in range(3)], "vec_id long, embedding array<double>")
    assert {r["score"] for r in topk.top_k(far, far, 5).collect()} == {(1 << 63) - 1}


def test_top_k_query(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in QUERIES["op8_exact_top_k"](spark, SF).collect()}
    assert got == {(r[0], r[1], r[2], r[3]) for r in con.execute(ORACLES["op8_exact_top_k"]).fetchall()}


# --- token counts

def test_token_counts(docs):
    from tokenizers import Tokenizer, models, normalizers
    u = token_counts.unigram(token_counts.default_path("piece_bpe_32k.model"))
    tok = Tokenizer(models.Unigram(u.vocab, 0, True))
    tok.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    odd = ["", " ", "  a   b ", "\x00\x01 a\tb\n\n c", "<0x0A> <s> </s>", "▁▁ x▁y", " " * 500 + "zz", "ÀÉ́ ﷽"]
    assert u.counts(odd) == [len(tok.encode(x, add_special_tokens=False).ids) for x in odd]
    got = Counter((r["doc_id"], r["n_tokens"]) for r in token_counts.token_counts(docs).collect())
    assert got == Counter((d, len(tok.encode(t or "", add_special_tokens=False).ids)) for d, t in DOCS)


# --- empty tables, columns, names

@pytest.mark.parametrize("apply", [
    lambda d: pii.find_pii(d), lambda d: pii.redact_pii(d), lambda d: bpe.decode(bpe.encode(d)), lambda d: jaccard_join.link(d),
    lambda d: packing.pack_documents(d), lambda d: sharding.interleave(d),
    lambda d: quality.assess(d, d.select("doc_id")), lambda d: substring_dedup.remove_repeats(d),
    lambda d: suffix_dedup.remove_repeats(d, others=("source",)), lambda d: token_counts.token_counts(d),
    lambda d: topk.top_k(d.select("doc_id", F.array(F.lit(1.0)).alias("e")), d.select("doc_id", F.array(F.lit(1.0)).alias("e")), 3, "doc_id", "e")])
def test_empty_tables(empty, apply):
    out = apply(empty)
    assert out.count() == 0 and out.columns


def test_native_operators_run_no_python(spark):
    for name in ("op1_pii", "op6_quality_rules"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan), name
