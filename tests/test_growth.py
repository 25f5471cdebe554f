"""What belongs to one puzzle or image is not unfolded to be gathered again: J17, V7, J1."""

import pytest

from conftest import SMALL
from gridspark.plans import QUERIES


@pytest.mark.parametrize("name,unwanted", [
    ("peer_digits", "explode("), ("rows81", "explode("), ("rows81", "collect_list("), ("scored_by_join", "collect_list("),
])
def test_cells_stay_in_their_row(spark, name, unwanted):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert unwanted not in plan


@pytest.mark.parametrize("name", ["structured_choice", "score5_by_quad"])
def test_quads_are_moved_once_as_their_numbers(spark, name):
    tree = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    by_key = [line for line in tree.splitlines() if "Exchange hashpartitioning(" in line]
    assert len(by_key) == 2 and all("hashpartitioning(image_id" in line for line in by_key)


@pytest.mark.parametrize("unwanted", ["explode(", "collect_list("])
def test_readings_are_made_behind_the_join(spark, unwanted):
    assert unwanted not in QUERIES["read_and_solve"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
