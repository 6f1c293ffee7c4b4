"""The corpus pipeline, stage by stage, against plain versions of its stages."""

import re
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from relievo.llm import packing, quality
from relievo.session import materialise

from . import brute as B

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = corpus_pipeline.table(spark, SF, "documents")
    names, rows, kept = docs.columns, {}, docs
    for name, stage in corpus_pipeline.STAGES:
        kept = materialise(stage(spark, kept, SF), "test")
        rows[name] = kept.collect()
        if name != "best-fit packing":
            assert kept.columns == names
    start = {r["doc_id"]: r["text"] for r in docs.collect()}

    verdict = quality.assess(docs, quality.trusted_of(corpus_pipeline.table(spark, SF, "labels"))).where("kept").collect()
    one = {r["doc_id"]: r["text"] for r in rows["quality rules"]}
    assert one == {r["doc_id"]: start[r["doc_id"]] for r in verdict}

    order = sorted(one)
    root = B.components([B.shingles(one[d]) for d in order])
    two = {r["doc_id"]: r["text"] for r in rows["n-gram Jaccard join"]}
    assert sorted(two) == sorted({min(d for d, x in zip(order, root) if x == r) for r in set(root)})
    assert all(two[d] == one[d] for d in two)

    three = {r["doc_id"]: r["text"] for r in rows["suffix-array dedup"]}
    want = B.byte_repeats(list(two.items()), corpus_pipeline.PASSAGE)
    assert set(three) == set(two)
    for d, t in two.items():
        size, removed, _, _ = want[d, t]
        assert size - removed - 8 <= len(three[d].encode()) <= size - removed

    four = {r["doc_id"]: r["text"] for r in rows["PII"]}
    assert set(four) == set(three)
    for d, t in three.items():
        if not B.base_pii(t):
            assert four[d] == t or re.search(r"\[(EMAIL|IP|CARD|PHONE|ID|NAME)\]", four[d])
        for _, a, b in B.base_pii(t):
            assert t[a:b] not in four[d]
    assert all(r["n_chars"] == len(r["text"]) for r in rows["PII"])

    tok = packing.lookup(packing.default_path("word_bpe_49k.json")).tokenizer
    ids = {d: np.array(tok.encode(t, add_special_tokens=False).ids + [1], "<u4") for d, t in four.items()}
    assert Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in rows["best-fit packing"]) == Counter(
        (d, i, zlib.crc32(x[lo:lo + 4096].tobytes())) for d, x in ids.items() for i, lo in enumerate(range(0, len(x), 4096)))


def test_odd_documents(spark):
    docs = B.clashing(spark, B.sample_docs()).selectExpr("doc_id", "text", "cast(null as string) as lang", "source", "cast(1 as bigint) as n_chars")
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, SF)
            assert out.count() >= 0
            if name != "best-fit packing":
                assert out.columns == table.columns
