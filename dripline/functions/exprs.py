"""Column helpers: rounding, guarded ratios, number parsing and display text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from dripline.schema import MISSING_LABEL, MISSING_TEXTS

# A plain decimal number with an optional exponent. Rules out what the JVM parser would accept
# beyond that, such as "1d", "3f" or "NaN".
_NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

_BLANKS = " \t\n\r\f\v"

# Date layouts tried after ISO, in this order, each on texts of its shape only.
DEFAULT_DATE_FORMATS = (
    ("M/d/yyyy", r"^\d+/\d+/\d+$"),
    ("M/d/yyyy H:mm", r"^\d+/\d+/\d+ \d+:\d+$"),
    ("M/d/yyyy H:mm:ss", r"^\d+/\d+/\d+ \d+:\d+:\d+$"),
    ("d-MMM-yyyy", r"^\d+-[A-Za-z]{3}-\d+$"),
    ("d MMM yyyy", r"^\d+ [A-Za-z]{3} \d+$"),
    ("MMM d, yyyy", r"^[A-Za-z]{3} \d+, \d+$"),
)


def half_even_sql(value: str, places: int | None) -> str:
    """SQL that rounds the scaled value half to even, as numpy does; ``None`` leaves it alone."""
    if places is None:
        return value
    if places == 0:
        return f"rint({value})"
    scale = f"{10**places}.0D"
    return f"rint(({value}) * {scale}) / {scale}"


def half_even(value: str, places: int | None) -> Column:
    """:func:`half_even_sql` as a column."""
    return F.expr(half_even_sql(value, places))


def guarded_sql(numerator: str, denominator: str, places: int | None, percent: bool) -> str:
    """SQL of ``numerator / denominator`` (x 100 for a percentage), 0 without a denominator."""
    top, bottom = f"cast({numerator} AS double)", f"cast({denominator} AS double)"
    ratio = f"try_divide({top}, {bottom})"
    if percent:
        ratio = f"{ratio} * 100.0D"
    return f"CASE WHEN {bottom} > 0.0D THEN {half_even_sql(ratio, places)} ELSE 0.0D END"


def guarded(numerator: str, denominator: str, places: int | None, percent: bool) -> Column:
    """:func:`guarded_sql` as a column."""
    return F.expr(guarded_sql(numerator, denominator, places, percent))


def missing_to_null(text: Column) -> Column:
    """Null out the texts that mean "missing"."""
    return F.when(text.isin(*MISSING_TEXTS), F.lit(None).cast("string")).otherwise(text)


def parse_number(text: Column, strip_nan: bool = True) -> Column:
    """Number from report text: commas dropped, anything that is not a number becomes 0."""
    plain = F.replace(F.coalesce(text.cast("string"), F.lit("0")), F.lit(","), F.lit(""))
    if strip_nan:
        plain = F.replace(plain, F.lit("nan"), F.lit("0"))
    number = F.when(plain.rlike(_NUMBER_PATTERN), F.btrim(plain, F.lit(_BLANKS)).try_cast("double"))
    return F.coalesce(number, F.lit(0.0))


def normalize_text(text: Column, trim: bool = True, missing_label: str = MISSING_LABEL) -> Column:
    """Text with missing values labelled and outer blanks removed."""
    filled = F.coalesce(text.cast("string"), F.lit(missing_label))
    return F.btrim(filled, F.lit(_BLANKS)) if trim else filled


def parse_day(
    text: Column, strict: bool = False, formats: Sequence[tuple[str, str]] = DEFAULT_DATE_FORMATS
) -> Column:
    """Timestamp from text, each row on its own; ``formats`` pairs layouts with their shape.

    Unreadable text gives null, or fails the job under ``strict``.
    """
    readings = [F.try_to_timestamp(text)]
    for layout, shape in formats:
        readings.append(F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(layout))))
    parsed = F.coalesce(*readings)
    if not strict:
        return parsed
    message = F.concat(F.lit("unreadable date: "), F.coalesce(text, F.lit("missing")))
    return F.coalesce(parsed, F.raise_error(message).cast("timestamp"))


def iso_date_text(moment: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` with a midnight time left off."""
    return F.replace(F.date_format(moment, "yyyy-MM-dd HH:mm:ss"), F.lit(" 00:00:00"), F.lit(""))


def count_text(value: Column) -> Column:
    """Whole number with thousands separators; fractions are cut, not rounded."""
    return F.format_number(value.cast("bigint"), 0)


def count_text_or_blank(value: Column) -> Column:
    return F.when(value > 0, count_text(value)).otherwise(F.lit(""))


def percent_text(value: Column, places: int) -> Column:
    return F.concat(plain_number_text(value, places), F.lit("%"))


def money_text(value: Column, places: int, prefix: str = "₹", grouped: bool = True) -> Column:
    number = F.format_number(value, places) if grouped else plain_number_text(value, places)
    return F.concat(F.lit(prefix), number)


def multiplier_text(value: Column, places: int) -> Column:
    return F.concat(plain_number_text(value, places), F.lit("x"))


def plain_number_text(value: Column, places: int) -> Column:
    """Fixed decimal places without thousands separators."""
    return F.replace(F.format_number(value, places), F.lit(","), F.lit(""))


def week_label(day: Column) -> Column:
    """Year and Sunday-first week number; days before the first Sunday are week 00."""
    number = F.floor((F.dayofyear(day) + F.lit(7) - F.dayofweek(day)) / F.lit(7))
    return F.concat(
        F.date_format(day, "yyyy"), F.lit("-W"), F.lpad(number.cast("string"), 2, "0")
    )


def week_start(day: Column) -> Column:
    """The Monday on or before the day."""
    return F.date_trunc("week", day).cast("date")
