import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(__file__), os.path.dirname(os.path.dirname(os.path.abspath(__file__)))]
from helpers import SF, compare  # noqa: E402

from rowloom.plans.catalogue import ORACLES, QUERIES  # noqa: E402


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        compare(df, ORACLES[name])
    else:
        assert df.count() > 0
