"""Blank, number and default handling."""

from pyspark.sql import functions as F

from cashtide.schemas import AMOUNT, DEFAULT_CHANNEL, MONEY

WHITESPACE = " \t\n\r\f\x0b"


def text(value):
    return F.col(value) if isinstance(value, str) else value


def strip(value):
    return F.trim(text(value).cast("string"), F.lit(WHITESPACE))


def blank_to_null(value):
    """Empty text counts as absent."""
    return F.nullif(text(value), F.lit(""))


def first_filled(*values):
    """First argument that is neither null nor empty text."""
    return F.coalesce(*[blank_to_null(v) for v in values])


def channel_or_default(value):
    return F.coalesce(blank_to_null(value), F.lit(DEFAULT_CHANNEL))


def to_number(value, default=None):
    """Text or number to double; unreadable text and NaN become null, then ``default``."""
    number = text(value).try_cast("double")
    number = F.when(~F.isnan(number), number)
    return number if default is None else F.coalesce(number, F.lit(float(default)))


def to_money(value):
    """Number or text to exact decimal; a double goes through its shortest text form."""
    return text(value).try_cast(MONEY)


def to_amount(value):
    """An amount with all its digits; null when unreadable or too large to hold."""
    return text(value).try_cast(AMOUNT)


def clip_non_negative(value):
    """Negative, missing and NaN become 0."""
    value = text(value)
    return F.when(value > 0, F.nanvl(value, F.lit(0.0))).otherwise(F.lit(0.0))
