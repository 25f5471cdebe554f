import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gridspark.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"
# A well-known puzzle with 30 clues and one solution.
SAMPLE = (
    "530070000600195000098000060800060003400803001700020006060000280000419005000080079"
)


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, 4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def puzzle_rows(spark):
    """DataFrame of (puzzle_id, clues) from strings of 81 digits."""
    def make(texts):
        rows = [(i, [int(ch) for ch in t]) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "puzzle_id bigint, clues array<int>")

    return make
