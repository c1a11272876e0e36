"""The two previews of the star-schema trips."""

import re

from tripmill.operators import preview
from tripmill.plans.catalog import TRIP_LOOKUPS
from tripmill.sources import starview

SF_DIR = "/root/testdata/sf0.001"


def test_the_plain_preview_stops_before_the_lookups(spark):
    """The limit is taken on the trips, below the joins that add columns."""
    trips = starview.trips(spark, SF_DIR, *TRIP_LOOKUPS)
    shown = preview.raw_preview(trips, 7)
    optimized = shown._jdf.queryExecution().optimizedPlan().toString()
    lookups = optimized.index("Join LeftOuter")
    assert re.search(r"LocalLimit 7", optimized[lookups:])
    assert shown.count() == 7


def test_the_repeatable_preview_puts_nulls_last(spark):
    rows = spark.createDataFrame(
        [(2, None), (None, 1), (1, None), (1, 5), (1, 3)], "a int, b int"
    )
    first = preview.first_rows(rows, 4)
    assert [tuple(row) for row in first.collect()] == [(1, 3), (1, 5), (1, None), (2, None)]
    assert "TakeOrderedAndProject" in first._jdf.queryExecution().executedPlan().toString()
