"""Column-expression helpers; everything here is a built-in Spark expression."""

from basketry.functions.basket import product_tokens, token_to_product
from basketry.functions.dates import iso_date, parse_iso_date, weekday_label, weekday_number
from basketry.functions.stats import safe_corr
from basketry.functions.text import feature_label, prefixed_label, thousands

__all__ = [
    "product_tokens",
    "token_to_product",
    "iso_date",
    "parse_iso_date",
    "weekday_label",
    "weekday_number",
    "safe_corr",
    "feature_label",
    "prefixed_label",
    "thousands",
]
