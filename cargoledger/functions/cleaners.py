"""Cell cleaners: raw column -> typed column, built-in expressions only."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Whitespace characters, number suffixes that are no number, day-first and ISO date
# texts by their number of colons, and return references.
BLANKS_PATTERN = (
    "[ \\t\\n\\x0b\\f\\r\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"
)
# Letters without blanks among them, single plain spaces between, and plain ones that a trim takes. The possessive loops read a text
# once; a text with letters beyond these is not wrong, only cleaned by the pattern above.
PLAIN_TEXT = "\\A ?[!-~\\xa1-\\u167f]*+(?: [!-~\\xa1-\\u167f]++)*+ ?\\z"
NOT_NUMBER_ENDINGS = ("d", "D", "f", "F", "n", "N", "y", "Y")
DAY_FIRST_FORMATS = ("d/M/yyyy", "d/M/yyyy H:m", "d/M/yyyy H:m:s")
ISO_FORMATS = ("yyyy-M-d", "yyyy-M-d H:m", "yyyy-M-d H:m:s")
# a fraction of a second and a zone behind the time of an ISO text; the day is the written one
ISO_TAIL = r"(?<=:[0-9]{1,2})([.,][0-9]+)?\s*(Z|[+-][0-9]{2}:?[0-9]{2})?$"
RETURN_PATTERN = "^(?i:RT)[0-9]{10}$"
ORIGIN_PATTERN = "[0-9]{10}"
WIDE = T.DecimalType(38, 6)


def as_text(c: Column, kind: T.DataType = T.StringType()) -> Column:
    """Cell as text; whole floating numbers lose the exponent and the fraction."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        whole = (c == F.floor(c)) & (F.abs(c) < F.lit(1e18))
        return F.when(whole, c.cast("bigint").cast("string")).otherwise(c.cast("string"))
    return c.cast("string")


def has_text(c: Column, kind: T.DataType = T.StringType()) -> Column:
    """Whether ``clean_text`` would leave something."""
    if isinstance(kind, T.StringType):
        return F.coalesce(c.rlike(f"[^{BLANKS_PATTERN[1:-2]}]"), F.lit(False))
    return c.isNotNull()


def collapsed(c: Column, kind: T.DataType = T.StringType()) -> Column:
    """Text with single plain spaces inside and none outside.

    Most cells hold single plain spaces at most; only others meet the pattern.
    """
    text = as_text(c, kind)
    return F.trim(F.when(text.rlike(PLAIN_TEXT), text).otherwise(F.regexp_replace(text, BLANKS_PATTERN, " ")))


def clean_text(c: Column, kind: T.DataType = T.StringType()) -> Column:
    """Collapse whitespace, trim, and turn empty text into NULL."""
    return F.nullif(collapsed(c, kind), F.lit(""))


def clean_texts(cells: Column) -> Column:
    """`clean_text` of an array of texts. The second pass reads what the first has worked out; in one, each cell would be
    cleaned twice, since a lambda shares no common parts."""
    return F.transform(F.transform(cells, collapsed), lambda x: F.nullif(x, F.lit("")))


def clean_amounts(cells: Column, target: T.DecimalType) -> Column:
    """`clean_number` of an array of texts as decimals, each cast once: to the widest type, then tested for its range."""
    limit = F.lit(Decimal(10) ** (target.precision - target.scale)).cast(WIDE)
    refusal = F.raise_error(F.lit("amount too large")).cast(target)

    def fitted(x: Column) -> Column:
        return F.when(F.abs(x) >= limit, refusal).otherwise(F.coalesce(x, F.lit(0).cast(WIDE)).cast(target))

    return F.transform(F.transform(cells, lambda x: x.try_cast(WIDE)), fitted)


def holds_too_large(cells: Column, target: T.DecimalType) -> Column:
    """Whether an array of texts has an amount that the type cannot hold."""
    limit = F.lit(Decimal(10) ** (target.precision - target.scale)).cast(WIDE)
    return F.exists(cells, lambda x: F.coalesce(F.abs(x.try_cast(WIDE)) >= limit, F.lit(False)))


def clean_number_or_null(
    c: Column, target: str | T.DataType = "double", kind: T.DataType = T.StringType()
) -> Column:
    """Number, or NULL when the cell is empty or not a number.

    A text ending in a type suffix (``12d``), an infinity or a NaN casts to a double, so such
    endings are refused; decimals have no such forms.
    """
    if isinstance(kind, T.StringType) and target == "double":
        number = c.try_cast(target)
        return F.when(~F.substring(F.trim(c), -1, 1).isin(*NOT_NUMBER_ENDINGS), number)
    number = c.try_cast(target)
    if not isinstance(target, T.DecimalType) and not target.startswith("decimal"):
        return number
    # an amount beyond the type must not pass for an empty cell
    too_large = number.isNull() & c.try_cast("decimal(38,6)").isNotNull()
    error = F.raise_error(F.concat(F.lit("amount too large: "), c.cast("string"))).cast(target)
    return F.when(too_large, error).otherwise(number)


def clean_number(
    c: Column, target: str | T.DataType = "double", kind: T.DataType = T.StringType()
) -> Column:
    """Number, or zero when the cell is empty or not a number."""
    return F.coalesce(clean_number_or_null(c, target, kind), F.lit(0).cast(target))


def clean_integer_or_null(c: Column, kind: T.DataType = T.StringType()) -> Column:
    """Integer; text must be a whole number, a numeric cell is truncated."""
    if isinstance(kind, T.StringType):
        text = F.trim(c)
        return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("int"))
    return c.try_cast("int")


def clean_pieces(c: Column, kind: T.DataType = T.StringType()) -> Column:
    """Piece count, truncated to an integer, else NULL."""
    return clean_number_or_null(c, "double", kind).try_cast("int")


def clean_date(
    c: Column,
    kind: T.DataType = T.StringType(),
    formats: tuple[str, ...] = DAY_FIRST_FORMATS,
) -> Column:
    """Date of a timestamp cell, or of text in one of ``formats``; anything else is NULL."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return c.cast("date")
    if not isinstance(kind, T.StringType):
        return F.lit(None).cast("date")
    text = F.trim(c)
    if formats == ISO_FORMATS:
        text = F.regexp_replace(F.regexp_replace(text, "(?<=[0-9])T(?=[0-9])", " "), ISO_TAIL, "")
    colons = F.length(text) - F.length(F.replace(text, F.lit(":"), F.lit("")))
    parsed = F.lit(None).cast("timestamp")
    for count, form in enumerate(formats):  # the colons tell the one format that can match
        parsed = F.when(colons == count, F.try_to_timestamp(text, F.lit(form))).otherwise(parsed)
    return parsed.cast("date")


def detect_return(reference: Column) -> Column:
    """Whether a cleaned reference marks a return shipment, in any case.

    The pattern ignores case itself: mapping every text to upper case costs far more.
    """
    return F.coalesce(reference.rlike(RETURN_PATTERN), F.lit(False))


def return_origin(is_return: Column, reference: Column) -> Column:
    """Original waybill named by a return's reference; never the empty string."""
    digits = F.nullif(F.regexp_extract(reference, ORIGIN_PATTERN, 0), F.lit(""))
    return F.when(is_return, digits)


def month_of(c: Column) -> Column:
    """Accounting month as ``YYYY-MM`` text."""
    return F.date_format(c, "yyyy-MM")
