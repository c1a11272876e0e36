"""Trip analytics on Spark: monthly taxi trips in, dashboard answers out."""

from tripmill.operators.selection import TripFilter
from tripmill.plans.dashboard import refresh
from tripmill.sources.store import TripStore

__all__ = ["TripFilter", "TripStore", "refresh"]
