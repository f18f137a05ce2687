"""Ridge and boosting are fitted for every expanding split, with validation and test rows of each."""

from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
@pytest.mark.parametrize("name", ["R19_ridge", "R20_boosting"])
def test_every_split(spark, name):
    got = {(r.split_id, r.role) for r in entry.queries()[name](spark, str(DATA)).select("split_id", "role").distinct().collect()}
    assert got == {(f"test_{y}", r) for y in (1999, 2000, 2001) for r in ("validation", "test")}
