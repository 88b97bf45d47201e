"""Every registered query runs to its end and gives every row: ``count`` alone would prune what fails."""

import pytest

import __spark_entry__

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(__spark_entry__.queries()))
def test_collects(spark, name):
    frame = __spark_entry__.queries()[name](spark, SF_DIR)
    assert len(frame.columns) == len(set(frame.columns))
    frame.toPandas()
