import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shelfsense.schemas import SALES  # noqa: E402
from shelfsense.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session(master="local[4]", shuffle_partitions=4, app_name="shelfsense-tests")
    yield s
    s.stop()


@pytest.fixture
def make_sales(spark):
    """Build a sales frame from tuples (property, cluster, category, product,
    period, units[, dollars]); flag/city/state derive from the property."""

    def _make(rows):
        full = []
        for r in rows:
            p, c, cat, d, m, u = r[:6]
            dollars = r[6] if len(r) > 6 else (None if u is None else float(u) * 2.0)
            full.append((p, c, cat, d, m, u, dollars, f"F-{p}", f"City-{p}", f"ST-{p}"))
        return spark.createDataFrame(full, SALES)

    return _make
