"""Display-text expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Display texts of the reports.
#   feature display names (other names pass through), label prefixes,
#   the hover separator and the unit word after a visit count.
FEATURE_LABELS = {
    "frecuencia": "Frecuencia",
    "total_cantidad": "Total cantidad",
    "productos_distintos": "Prod. distintos",
    "categorias_distintas": "Cat. distintas",
}
PRODUCT_PREFIX = "Producto "
CUSTOMER_PREFIX = "Cliente "
HOVER_SEPARATOR = "<br>"
VISITS_SUFFIX = " transacciones"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def prefixed_label(prefix: str, value: Column | str) -> Column:
    return F.concat(F.lit(prefix), _c(value).cast("string"))


def thousands(value: Column | str) -> Column:
    """Integer text with comma thousands separators (1234567 -> "1,234,567")."""
    return F.format_number(_c(value), 0)


def feature_label(name: Column | str) -> Column:
    pairs = []
    for k, v in FEATURE_LABELS.items():
        pairs += [F.lit(k), F.lit(v)]
    col = _c(name)
    return F.coalesce(F.create_map(*pairs)[col], col)
