"""Statistics expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_corr(x: str, y: str) -> Column:
    """Pearson r as an aggregate that never raises.

    ``corr`` divides by zero (an error under ANSI) for a constant column; this
    form returns null for a constant column or a single row, and equals
    ``corr`` otherwise.  All inputs are aggregated in one pass with partial
    (map-side) aggregation, so it scales with the number of rows, not groups.
    """
    cx, cy = F.col(x).cast("double"), F.col(y).cast("double")
    return F.try_divide(F.covar_pop(cx, cy), F.stddev_pop(cx) * F.stddev_pop(cy))
