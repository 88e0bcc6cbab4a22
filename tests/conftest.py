import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from siteledger.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return build_session("siteledger-tests", cores=4, shuffle_partitions=4)


@pytest.fixture
def values(spark):
    """Evaluate column expressions on one row and return their values."""

    def run(*columns):
        row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).collect()[0]
        return list(row)

    return run
