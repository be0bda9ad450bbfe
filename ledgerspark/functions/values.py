"""Cell values: blanks, numbers, periods and comparison forms.

Raw cells are text. Functions that can fail on bad text come with an ``*_invalid`` twin that tells
which rows would fail, so a job can report them instead of stopping at the first one.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: code points that count as white space at the ends of a cell.
WHITESPACE = "".join(
    chr(code)
    for code in [
        *range(0x09, 0x0E),
        *range(0x1C, 0x21),
        0x85,
        0xA0,
        0x1680,
        *range(0x2000, 0x200B),
        0x2028,
        0x2029,
        0x202F,
        0x205F,
        0x3000,
    ]
)

# Full-width parentheses and the half-width forms they stand for.
WIDE_PARENTHESES = "（）"
NARROW_PARENTHESES = "()"

# Fixed value: a cell that holds only dashes means zero.
DASHES_ONLY = "^[-—–－]+$"

# Fixed value: the period conditions see while rules are checked without a period.
VALIDATION_PERIOD = "200001"

# Sums run on this type. Six decimals leave 22 digits before the point.
NUMBER = "decimal(28,6)"
WIDE_NUMBER = "decimal(38,6)"

_PERIOD_WITH_SEPARATOR = r"^\D*(\d{4})\D{1,3}(\d{1,2})(\D|$)"
_PERIOD_COMPACT = r"^\D*(\d{4})(\d{2})"


def strip(value: Column) -> Column:
    return F.btrim(value, F.lit(WHITESPACE))


def is_blank(value: Column) -> Column:
    return value.isNull() | (strip(value.cast("string")) == "")


def has_value(value: Column) -> Column:
    return ~is_blank(value)


def blank_to_null(value: Column) -> Column:
    return F.nullif(strip(value), F.lit(""))


def clean_cell(value: Column) -> Column:
    """Cell text without its leading back-ticks."""
    return F.ltrim(value, F.lit("`"))


def numeric_text(value: Column) -> Column:
    bare = strip(F.translate(value.cast("string"), ",`", ""))
    return F.when(bare.rlike(DASHES_ONLY), F.lit("0")).otherwise(bare)


def as_number(value: Column) -> Column:
    """Text to a number, NULL for blank or unreadable text."""
    return numeric_text(value).try_cast(NUMBER)


def as_number_invalid(value: Column) -> Column:
    return has_value(value) & (numeric_text(value) != "") & as_number(value).isNull()


def sum_value(value: Column, optional: bool) -> Column:
    """The number a SUM rule adds; a blank cell of an optional rule adds zero."""
    number = as_number(value)
    if optional:
        return F.when(_nothing_to_add(value), F.lit(0).cast(NUMBER)).otherwise(number)
    return number


def sum_empty(value: Column) -> Column:
    """True where a required SUM cell holds nothing."""
    return _nothing_to_add(value)


def sum_unreadable(value: Column) -> Column:
    return ~_nothing_to_add(value) & as_number(value).isNull()


def _nothing_to_add(value: Column) -> Column:
    return F.coalesce(numeric_text(value) == "", F.lit(True))


# Doubles from here on add up as decimals. Below it a group may hold billions of rows before a sum of
# whole units leaves a bigint.
WIDE = float(1 << 30)
# How near to a half a rest in millionths may lie before its digits decide. A double below ``WIDE`` and the
# shortest text of it lie at most 0.06 millionths apart.
NEAR_HALF = 0.125


def large_number(value: Column) -> Column:
    """A double as a decimal, digit by digit, where only that rounds it surely; NULL for others."""
    size = F.abs(value)
    rest = (size - F.floor(F.least(size, F.lit(WIDE)))) * 1e6
    unsure = F.abs(rest - F.floor(F.least(rest, F.lit(2e6))) - 0.5) <= NEAR_HALF
    return F.when((size >= WIDE) | unsure, value.try_cast(NUMBER))


def split_number(value: Column, large: Column) -> tuple[Column, Column, Column]:
    """Whole units and millionths of a double as two bigints, NULL where it is no number; a wide one instead
    as a decimal, beside two zeros.

    One rule for all sizes: the shortest digits of the double, rounded half up to millionths, as a cast to
    a decimal rounds them. Bigint sums are exact and stay on primitive values; a decimal sum costs several
    times as much per row, but for almost all rows it has nothing to add. ``large`` is
    ``large_number(value)``, best kept as a column.
    """
    is_wide = F.abs(value) >= WIDE
    whole = F.when(is_wide, F.when(large.isNotNull(), F.lit(0).cast("bigint"))).otherwise(value.try_cast("bigint"))
    rest = (
        F.when(is_wide, F.when(large.isNotNull(), F.lit(0).cast("bigint")))
        .when(large.isNull(), F.rint((value - whole) * 1e6).cast("bigint"))
        .otherwise(((large - whole.cast(NUMBER)) * 1_000_000).cast("bigint"))
    )
    return whole, rest, F.when(is_wide, large)


def joined_number(units: Column, millionths: Column, wide: Column | None = None) -> Column:
    """The exact number behind sums of what ``split_number`` gives."""
    small = (
        units.cast("decimal(38,6)")
        + (millionths.cast("decimal(20,0)") * F.lit(Decimal("0.000001"))).cast("decimal(38,6)")
    ).cast(WIDE_NUMBER)
    if wide is None:
        return small
    return (small + F.coalesce(wide, F.lit(0).cast(NUMBER)).cast(WIDE_NUMBER)).cast(WIDE_NUMBER)


def period_of(value: Column) -> Column:
    """``YYYYMM`` of a date, a timestamp cast to text, or free date text; NULL if there is none."""
    text = value.cast("string")
    year = F.regexp_extract(text, _PERIOD_WITH_SEPARATOR, 1)
    month = F.lpad(F.regexp_extract(text, _PERIOD_WITH_SEPARATOR, 2), 2, "0")
    compact_year = F.regexp_extract(text, _PERIOD_COMPACT, 1)
    compact_month = F.regexp_extract(text, _PERIOD_COMPACT, 2)
    return (
        F.when((year != "") & month.between("01", "12"), F.concat(year, month))
        .when(year != "", F.lit(None).cast("string"))
        .when(compact_month.between("01", "12"), F.concat(compact_year, compact_month))
    )


def period_of_date(value: Column) -> Column:
    """``YYYYMM`` of a date or timestamp column, by arithmetic instead of formatting."""
    month = F.year(value) * 100 + F.month(value)
    return F.lpad(month.cast("string"), 6, "0")


def shift_period(period: Column, months: Column | int) -> Column:
    """Move a ``YYYYMM`` text by a number of months."""
    offset = F.lit(months) if isinstance(months, int) else months
    first_day = F.try_to_date(period, "yyyyMM")
    return F.date_format(F.add_months(first_day, offset), "yyyyMM")


def display_text(value: Column) -> Column:
    return F.translate(value, WIDE_PARENTHESES, NARROW_PARENTHESES)


def canon_key(value: Column) -> Column:
    """Comparison form of a key or field: one text per business value.

    Numbers lose thousands separators, leading and trailing zeros, and keep two decimals at most.
    The decimal detour keeps ids of up to 32 digits distinct.
    """
    text = display_text(blank_to_null(value.cast("string")))
    number = F.replace(text, F.lit(","), F.lit("")).try_cast(WIDE_NUMBER)
    return F.coalesce(plain_number_text(number), text)


def plain_number_text(number: Column) -> Column:
    rounded = F.round(number, 2).cast("decimal(38,2)").cast("string")
    return F.regexp_replace(rounded, r"\.?0+$", "")


def canon_scalar(value: Column, digits: int = 2) -> Column:
    """Comparison form of a scalar in a reconciliation, as text: numbers carry ``digits`` decimals."""
    text = blank_to_null(value.cast("string"))
    number = F.replace(text, F.lit(","), F.lit("")).try_cast(WIDE_NUMBER)
    rounded = F.round(number, digits).cast(f"decimal(38,{digits})").cast("string")
    return F.coalesce(rounded, display_text(text))


def typed_for_target(value: Column, field_type: int | None) -> Column:
    """Outbound form for a target column: number columns parse text and blank becomes NULL."""
    if field_type != 2:
        return value
    return strip(value.cast("string")).try_cast(NUMBER)


def typed_for_target_invalid(value: Column, field_type: int | None) -> Column:
    if field_type != 2:
        return F.lit(False)
    return has_value(value) & typed_for_target(value, field_type).isNull()
