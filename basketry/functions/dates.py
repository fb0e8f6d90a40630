"""Date expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

DATE_PATTERN = "yyyy-MM-dd"

# Weekday abbreviations shown for Spark's dayofweek numbering
# (1 = Sunday ... 7 = Saturday); unknown numbers are shown as "?".
WEEKDAY_ABBREVIATIONS = {1: "Dom", 2: "Lun", 3: "Mar", 4: "Mié", 5: "Jue", 6: "Vie", 7: "Sáb"}
UNKNOWN_WEEKDAY = "?"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_iso_date(text: Column | str) -> Column:
    """Text -> DATE with ``yyyy-MM-dd``; invalid text gives null (never an error)."""
    return F.try_to_date(_c(text), DATE_PATTERN)


def iso_date(date: Column | str) -> Column:
    return F.date_format(_c(date), DATE_PATTERN)


def weekday_number(date: Column | str) -> Column:
    return F.dayofweek(_c(date))


def weekday_label(number: Column | str) -> Column:
    pairs = []
    for k, v in WEEKDAY_ABBREVIATIONS.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.coalesce(F.create_map(*pairs)[_c(number)], F.lit(UNKNOWN_WEEKDAY))
