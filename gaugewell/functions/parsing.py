"""Strict text parsing shared by retyping, validation and time detection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugewell.functions.columns import quoted

# The date-time formats text is tried against, in order.
DATETIME_FORMATS = (
    ("%Y-%m-%d %H:%M:%S", "yyyy-M-d H:m:s"),
    ("%Y-%m-%d %H:%M:%S.%f", "yyyy-M-d H:m:s.[SSSSSS][SSSSS][SSSS][SSS][SS][S]"),
    ("%Y-%m-%d", "yyyy-M-d"),
    ("%Y/%m/%d %H:%M:%S", "yyyy/M/d H:m:s"),
    ("%Y/%m/%d", "yyyy/M/d"),
    ("%d/%m/%Y %H:%M:%S", "d/M/yyyy H:m:s"),
    ("%d/%m/%Y", "d/M/yyyy"),
    ("%d-%m-%Y %H:%M:%S", "d-M-yyyy H:m:s"),
    ("%d-%m-%Y", "d-M-yyyy"),
)

# Words read as booleans, and those that mean true.
BOOLEAN_WORDS = ("true", "false", "1", "0", "yes", "no", "y", "n")
TRUE_WORDS = ("true", "1", "yes", "y")

# One shape per format above, so that only text that can parse is handed to the parser.
_DAY = {"%Y-%m-%d": r"\d{4}-\d{1,2}-\d{1,2}", "%Y/%m/%d": r"\d{4}/\d{1,2}/\d{1,2}", "%d/%m/%Y": r"\d{1,2}/\d{1,2}/\d{4}", "%d-%m-%Y": r"\d{1,2}-\d{1,2}-\d{4}"}
_DAY |= {"%m/%d/%Y": _DAY["%d/%m/%Y"], "%m-%d-%Y": _DAY["%d-%m-%Y"]}
ANY_DATE = r"^\d{1,4}[-/]\d{1,2}[-/]\d{1,4}"

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
INTEGER = r"^-?[0-9]+$"
UNICODE_BLANKS = r"(?U)^\s+|\s+$"


def text(c: str | Column) -> Column:
    return (quoted(c) if isinstance(c, str) else c).cast("string")


def trimmed(c: str | Column) -> Column:
    """Text without surrounding Unicode blanks."""
    return F.regexp_replace(text(c), UNICODE_BLANKS, "")


def parse_double(c: str | Column) -> Column:
    """Decimal literal to double, anything else null."""
    t = trimmed(c)
    return F.when(t.rlike(NUMBER), t.try_cast("double"))


def format_shape(strptime: str) -> str:
    """Anchored regular expression of a strptime format."""
    day, _, clock = strptime.partition(" ")
    tail = {"": "", "%H:%M:%S": r" +\d{1,2}:\d{1,2}:\d{1,2}", "%H:%M:%S.%f": r" +\d{1,2}:\d{1,2}:\d{1,2}\.\d{1,6}"}[clock]
    return f"^{_DAY[day]}{tail}$"


def first_format(t: Column, formats=DATETIME_FORMATS) -> Column:
    """Timestamp by the first format that fits; failing texts never reach the parser."""
    tries = [F.when(t.rlike(format_shape(py)), F.try_to_timestamp(t, F.lit(j))) for py, j in formats]
    return F.when(t.rlike(ANY_DATE), F.coalesce(*tries))


def parse_timestamp(c: str | Column) -> Column:
    """First format that fits, else ISO 8601, else null."""
    t = trimmed(c)
    return F.coalesce(first_format(t), iso_timestamp(t))


def iso_timestamp(t: Column) -> Column:
    shape = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})?$"
    return F.when(t.rlike(shape), F.try_to_timestamp(t))


def is_datetime_text(c: str | Column) -> Column:
    return first_format(trimmed(c)).isNotNull()


def is_boolean_text(c: str | Column) -> Column:
    return F.lower(trimmed(c)).isin(*BOOLEAN_WORDS)
