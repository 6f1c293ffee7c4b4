"""Plan shapes that have to hold at scale."""

import re

import pytest

from relievo.functions import radiometry as R
from relievo.operators import masks, stencil
from relievo.operators import resample as S
from relievo.plans import bindings as B
from relievo.plans import load_all

SF = "/root/testdata/sf0.001"
QUERIES, _ = load_all()
RUNS_JOBS = ("streamed_", "evaluation_table", "ingest_tiles", "stored_split")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return len(re.findall(r"(?<!Broadcast)Exchange (?:hash|range|Round)", plan(df)))


def test_stencils_shuffle_once(spark):
    dem = B.dem(spark, SF)
    assert shuffles(stencil.sobel(dem, "z", 10.0)) == 1
    assert shuffles(stencil.render(dem, "z", 0.6, (1.0, 0.0), 10.0)) == 1
    d = dem.withColumn("rv", R.rv_from_dn("z"))
    assert shuffles(masks.stereo_trust_mask(d, "z", True, "rv", True)) == 1


def test_enlarging_shuffles_only_the_coarse_grid(spark):
    up = S.upsample_posts(B.dem(spark, SF), "z", 62, B.H, B.W, B.H * 62, B.W * 62)
    text = plan(up)
    assert shuffles(up) == 1
    assert text.index("Generate explode") < text.index("Exchange")  # printed from the top: made after the exchange


def test_scan_reads_only_needed_columns(spark):
    text = plan(QUERIES["decode_dn"](spark, SF))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert "l_extendedprice" not in schema and "l_discount" not in schema


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith(RUNS_JOBS)))
def test_no_query_compares_all_pairs(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text
