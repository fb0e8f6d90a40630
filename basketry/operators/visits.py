"""Visits: distinct (fecha, sucursal_id, cliente_id) of the fact."""

from pyspark.sql import DataFrame

from basketry.schemas import VISIT_KEY


def visits(enriched: DataFrame) -> DataFrame:
    """A visit ("transaction") is a customer at a branch on a date with at
    least one unit.  Distinct with map-side partial aggregation: repeated
    lines of the same visit collapse before the shuffle, and the three-part
    key spreads a dominant branch or date over all reducers."""
    return enriched.select(*VISIT_KEY).distinct()
