"""Shop analytics on Spark: daily marts, metric queries, quality checks and refresh jobs."""

from martwright.ranges import DateRange
from martwright.settings import Settings

__all__ = ["DateRange", "Settings"]
