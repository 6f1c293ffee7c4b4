"""Registered queries beside their SQL checks; RELIEVO_ALL=1 runs every one."""

import os

import pytest

from relievo.plans import load_all
from tools.check import connect, difference

SF = "/root/testdata/sf0.01"
QUERIES, ORACLES = load_all()
QUICK = ["decode_dn", "quad_physics_mae", "stereo_trust", "gaussian_reduce", "altimetry_upsampled", "bilinear_points",
         "merged_cap", "fitted_temperature", "calibration_report", "incidence_profile", "datum_tie", "blended_mosaic",
         "points_in_boxes", "mosaic_windows", "strided_tiles", "terrain_headers", "index_codes", "region_product",
         "parsed_features", "feature_search", "profile_stats", "split_tiles", "dihedral_tiles", "run_status",
         "log_progress", "streamed_mosaic", "total_objective", "physics_objective"]
NAMES = sorted(QUERIES) if os.environ.get("RELIEVO_ALL") else QUICK


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got) > 0
    assert difference(got, duck.execute(ORACLES[name]).df()) is None


def test_entry(spark):
    import __spark_entry__ as e
    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
