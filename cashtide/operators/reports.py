"""Report series: monthly volume, counts by class, totals with success rate."""

from pyspark.sql import functions as F

from cashtide.functions.labels import class_label


def volume_by_month(rows):
    return rows.groupBy(F.trunc("event_date", "MM").alias("month")).agg(
        F.sum("amount_vnd").alias("volume"), F.count(F.lit(1)).alias("num_tx")
    )


def count_by_type(rows, form_type="type"):
    return rows.groupBy(class_label(form_type).alias("class")).agg(
        F.count(F.lit(1)).alias("num_tx"), F.sum("amount_vnd").alias("volume")
    )


def period_start(last_day, period):
    """First day of a report period ending on ``last_day``."""
    if period == "year":
        return F.trunc(last_day, "YEAR")
    return F.date_sub(last_day, int(period) - 1)


def totals(rows, periods=("30", "90", "year")):
    """Volume, count, active accounts and success rate per period up to the newest day.

    Rows before the earliest start are cut first, so that days are pruned; the others are
    reduced to (day, account) before the periods are applied.
    """
    last_day = rows.agg(F.max("event_date")).scalar()
    earliest = F.least(*[period_start(last_day, p) for p in periods]) if len(periods) > 1 else (
        period_start(last_day, periods[0])
    )
    rows = rows.filter(F.col("event_date") >= earliest)
    per_account_day = rows.groupBy("event_date", "account_id").agg(
        F.sum("amount_vnd").alias("volume"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("status") == "SETTLED").alias("settled"),
    )
    labels = F.explode(
        F.array(
            *[
                F.struct(F.lit(p).alias("period"), period_start(last_day, p).alias("start"))
                for p in periods
            ]
        )
    )
    inside = per_account_day.select("*", labels.alias("_p")).filter(
        F.col("event_date") >= F.col("_p.start")
    )
    per_account = inside.groupBy(F.col("_p.period").alias("period"), "account_id").agg(
        F.sum("volume").alias("volume"), F.sum("n").alias("n"), F.sum("settled").alias("settled")
    )
    return per_account.groupBy("period").agg(
        F.sum("volume").alias("total_volume"),
        F.sum("n").alias("transaction_count"),
        F.count("account_id").alias("active_accounts"),
        (F.sum("settled") / F.sum("n")).alias("success_rate"),
    )
