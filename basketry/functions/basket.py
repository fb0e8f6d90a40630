"""Basket-string expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Products in a receipt are separated by any run of whitespace.
TOKEN_SEPARATOR = r"\s+"


def product_tokens(raw: Column | str) -> Column:
    """``"20 3 1"`` -> ``["20", "3", "1"]``.  Empty tokens from leading/trailing
    blanks survive here and are turned into nulls by :func:`token_to_product`."""
    return F.split(F.col(raw) if isinstance(raw, str) else raw, TOKEN_SEPARATOR)


def token_to_product(token: Column | str) -> Column:
    """Token -> INT product id; empty, non-numeric or out-of-range tokens give
    null instead of failing the job under ANSI mode."""
    col = F.col(token) if isinstance(token, str) else token
    return col.try_cast("int")
