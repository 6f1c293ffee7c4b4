import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from relievo.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[8]", "tests", **{"spark.sql.shuffle.partitions": 8, "spark.driver.memory": "6g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def frame(spark):
    """A 2-D array (or several of one shape) as a pixel frame with one tile."""
    def make(tile=0, **bands):
        first = next(iter(bands.values()))
        r, c = np.mgrid[:first.shape[0], :first.shape[1]]
        cols = {"tile": np.full(r.size, tile, "int64"), "row": r.ravel().astype("int32"), "col": c.ravel().astype("int32")}
        cols.update({k: v.ravel() for k, v in bands.items()})
        return spark.createDataFrame(pd.DataFrame(cols))
    return make


def grid(df, band, shape=None):
    """A pixel frame back to an array."""
    pdf = df.toPandas()
    shape = shape or (pdf["row"].max() + 1, pdf["col"].max() + 1)
    out = np.full(shape, np.nan)
    out[pdf["row"], pdf["col"]] = pdf[band].astype(float)
    return out
