"""Calendar expressions. Weekday is Monday = 0 throughout."""

from pyspark.sql import functions as F

from cashtide.functions.clean import text


def event_date(date_text, event_ts):
    """Stated date, else the UTC date of the timestamp; null (not today) when unreadable."""
    stated = text(date_text).try_cast("date")
    stamp = text(event_ts).try_cast("timestamp")
    leading = F.substring(text(event_ts).cast("string"), 1, 10).try_cast("date")
    return F.coalesce(stated, F.to_date(stamp), leading)


def utc_timestamp(value):
    """Naive text is UTC (session zone), text with an offset is converted to UTC."""
    return text(value).try_cast("timestamp")


def date_parts(day="date"):
    day = text(day)
    return [
        F.weekday(day).cast("int").alias("day_of_week"),
        F.month(day).cast("int").alias("month"),
        F.quarter(day).cast("int").alias("quarter"),
    ]


def is_weekend(day):
    return (F.weekday(text(day)) >= 5).cast("int")


def is_month_end(day):
    """Training form: the true last day of the month."""
    return (text(day) == F.last_day(text(day))).cast("int")


def is_payday(day):
    """Training form: the 15th or the last day of the month."""
    day = text(day)
    return ((F.dayofmonth(day) == 15) | (day == F.last_day(day))).cast("int")


def _day_or_mid(day):
    return F.coalesce(F.dayofmonth(text(day)), F.lit(15))


def is_month_end_serving(day):
    """Serving form: day 25 or later; an unreadable date counts as the 15th."""
    return (_day_or_mid(day) >= 25).cast("int")


def is_payday_serving(day):
    number = _day_or_mid(day)
    return ((number == 15) | (number >= 25)).cast("int")


def is_month_start(day):
    return (F.dayofmonth(text(day)) <= 5).cast("int")


def is_fixed_payday(day):
    # Pay days of the seasonal profile.
    return F.dayofmonth(text(day)).isin(15, 25, 26, 27, 28, 29, 30, 31).cast("int")


def month_yyyymm(day):
    return (F.year(text(day)) * 100 + F.month(text(day))).cast("int")
