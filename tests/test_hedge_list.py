"""Long hedges of the original's list count by default."""

import pytest
from pyspark.sql import functions as F

from veridex.functions import text


@pytest.mark.parametrize("x", ["there is no clear evidence", "needs more study", "to some degree", "generally speaking", "it is difficult to say"])
def test_long_hedges(spark, x):
    assert spark.createDataFrame([(x,)], "x string").select(F.expr(text.term_count("x", text.HEDGE_TERMS))).first()[0] >= 1


def test_size_of_the_list():
    assert (len(text.HEDGE_TERMS), len(set(text.HEDGE_TERMS))) == (345, 340)
