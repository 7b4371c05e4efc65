"""Lag, rolling, calendar and forward-looking columns over daily series.

Every window is partitioned by the series keys and runs over a daily table, one row per
series and date. With no keys the window has one partition, whose size is the number of
calendar days in the table, not the number of transactions.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from cashtide.functions import dates
from cashtide.functions.clean import channel_or_default
from cashtide.schemas import TARGETS

DIRECTIONS = (("in", "cash_in"), ("out", "cash_out"))
HORIZONS = (("h7_sum", 7), ("next_month_sum", 30))
LAGS = (1, 7)


def by_date(series_keys):
    keys = list(series_keys) or [F.lit(0)]
    return Window.partitionBy(*keys).orderBy("date")


def trailing_mean(column, rows, window):
    """Mean of the last ``rows`` rows; an exact decimal sum divided once."""
    frame = window.rowsBetween(1 - rows, 0)
    count = F.count(column).over(frame)
    return F.sum(column).over(frame).cast("double") / count


def lag_and_rolling(daily, series_keys=(), means=(7, 30), fill=None):
    """lag1 / lag7 and trailing means of both directions.

    ``fill``: None keeps nulls, ``zero`` puts 0, ``backfill`` takes the next known value
    of the column, then the value of the day, then 0.
    """
    window = by_date(series_keys)
    new = {}
    for tag, column in DIRECTIONS:
        for k in LAGS:
            new[f"lag{k}_{tag}"] = F.lag(F.col(column).cast("double"), k).over(window)
        for k in means:
            new[f"roll_mean_{k}_{tag}"] = trailing_mean(column, k, window)
    wide = daily.withColumns(new)
    if fill == "zero":
        return wide.fillna(0.0, subset=list(new))
    if fill == "backfill":
        # Newest first, so that "the next known value" is a growing frame, linear in rows.
        keys = list(series_keys) or [F.lit(0)]
        newest_first = Window.partitionBy(*keys).orderBy(F.col("date").desc())
        ahead = newest_first.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        today = {f"_{tag}": column for tag, column in DIRECTIONS}
        return wide.withColumns(
            {
                name: F.coalesce(
                    F.last(name, ignorenulls=True).over(ahead),
                    F.col(today["_" + name.rsplit("_", 1)[1]]).cast("double"),
                    F.lit(0.0),
                )
                for name in new
            }
        )
    return wide


def forward_targets(daily, series_keys=(), strict=False):
    """Next-day value and the sums of the next 7 and 30 rows.

    ``strict`` leaves a sum null unless the whole horizon exists; otherwise the tail
    holds partial sums.
    """
    window = by_date(series_keys)
    new = {}
    for _, column in DIRECTIONS:
        new[f"{column}_next_day"] = F.lead(F.col(column).cast("double"), 1).over(window)
        for suffix, k in HORIZONS:
            frame = window.rowsBetween(1, k)
            total = F.sum(column).over(frame).cast("double")
            if strict:
                total = F.when(F.count(F.lit(1)).over(frame) == k, total)
            new[f"{column}_{suffix}"] = total
    return daily.withColumns(new)


def target_calendar_month(daily, series_keys=()):
    """Sum of the next calendar month, by a join of monthly totals (null when absent)."""
    month = F.trunc("date", "MM")
    months = daily.groupBy(*series_keys, month.alias("_month")).agg(
        F.sum("cash_in").cast("double").alias("cash_in_calendar_month"),
        F.sum("cash_out").cast("double").alias("cash_out_calendar_month"),
    )
    shifted = months.withColumn("_month", F.add_months("_month", -1))
    keyed = daily.withColumn("_month", month)
    return keyed.join(shifted, [*series_keys, "_month"], "left").drop("_month")


def date_spine(daily, series_keys=()):
    """Every calendar day between the first and last date of a series; gaps hold 0."""
    span = daily.groupBy(*series_keys).agg(F.min("date").alias("_lo"), F.max("date").alias("_hi"))
    days = span.select(*series_keys, F.explode(F.sequence("_lo", "_hi")).alias("date"))
    filled = days.join(daily, [*series_keys, "date"], "left")
    return filled.fillna(0, subset=["cash_in", "cash_out"])


def calendar_exact(daily, series_keys=()):
    """Lags and means by calendar distance on a gappy series, without filling rows."""
    number = F.datediff("date", F.lit("1970-01-01").cast("date"))
    keys = list(series_keys) or [F.lit(0)]
    window = Window.partitionBy(*keys).orderBy(number)
    new = {}
    for tag, column in DIRECTIONS:
        for k in LAGS:
            value = F.max(F.col(column).cast("double")).over(window.rangeBetween(-k, -k))
            new[f"lag{k}_{tag}"] = value
        week = F.sum(column).over(window.rangeBetween(-6, 0)).cast("double")
        new[f"mean_7d_{tag}"] = week / F.lit(7.0)
    return daily.withColumns(new)


def running_balance(daily, series_keys=()):
    frame = by_date(series_keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    net = F.col("cash_in") - F.col("cash_out")
    return daily.withColumn("running_balance", F.sum(net).over(frame))


def period_change(periods, metric, period, keys=()):
    """Relative change against the previous period; null at the first or after a zero."""
    window = Window.partitionBy(*(list(keys) or [F.lit(0)])).orderBy(period)
    previous = F.lag(metric).over(window)
    change = F.when(previous != 0, (F.col(metric) - previous) / previous)
    return periods.withColumns({"previous": previous, "change": change})


def calendar_flags(daily, serving=False):
    month_end = dates.is_month_end_serving if serving else dates.is_month_end
    payday = dates.is_payday_serving if serving else dates.is_payday
    return daily.withColumns(
        {
            "dow": F.weekday("date").cast("int"),
            "is_weekend": dates.is_weekend("date"),
            "is_month_end": month_end("date"),
            "is_payday": payday("date"),
        }
    )


def base_values(daily):
    """Current-day values as doubles, the net flow and the channel."""
    cash_in, cash_out = (F.col(c).cast("double") for c in ("cash_in", "cash_out"))
    channel = F.col("channel") if "channel" in daily.columns else F.lit(None).cast("string")
    return daily.withColumns(
        {
            "cash_in_d0": cash_in,
            "cash_out_d0": F.coalesce(cash_out, F.lit(0.0)),
            "cash_net_d0": cash_in - F.coalesce(cash_out, F.lit(0.0)),
            "channel": channel_or_default(channel),
        }
    )


def feature_frame(daily, series_keys=()):
    """Training features: back-filled lags, 7-row means, calendar flags."""
    wide = lag_and_rolling(base_values(daily), series_keys, means=(7,), fill="backfill")
    return calendar_flags(wide)


def training_set(daily, series_keys=()):
    """Features and the six strict targets, one row per series and date."""
    return forward_targets(feature_frame(daily, series_keys), series_keys, strict=True)


def drop_incomplete(rows, features, target):
    return rows.dropna(subset=[*features, target])


def unpivot_targets(rows, id_columns, targets=TARGETS):
    """One row per (row, target) with the target value in ``y``; null targets dropped."""
    long = rows.unpivot(list(id_columns), list(targets), "target", "y")
    return long.filter(F.col("y").isNotNull())


def latest_features(daily, series_keys=(), minimum_rows=7):
    """Serving vector of the newest row of each series with enough history."""
    window = by_date(series_keys)
    whole = window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    wide = lag_and_rolling(base_values(daily), series_keys, means=(7,), fill="zero")
    wide = wide.withColumns(
        {
            "data_points": F.count(F.lit(1)).over(whole),
            "_next": F.lead("date").over(window),
        }
    )
    newest = wide.filter(F.col("_next").isNull() & (F.col("data_points") >= minimum_rows))
    return calendar_flags(newest.drop("_next"), serving=True)


def project_features(rows, features):
    """Feature columns in fixed order; unknown columns ignored, missing ones null."""
    return rows.select(
        *[
            (F.col(name) if name in rows.columns else F.lit(None)).cast(
                "string" if name == "channel" else "double"
            ).alias(name)
            for name in features
        ]
    )


def require_vnd(rows):
    """Scoring takes VND only: rows stating another currency are refused."""
    if "currency" not in rows.columns:
        return rows
    code = F.upper(F.coalesce("currency", F.lit("VND")))
    return rows.filter(
        F.when(code == "VND", True).otherwise(
            F.raise_error(F.concat(F.lit("currency not supported: "), code)).cast("boolean")
        )
    )
