"""KPI tables: last write wins per key, daily and monthly metrics, company statistics."""

from pyspark.sql import functions as F

from cashtide.functions.dates import month_yyyymm


def upsert(kpis, changes, keys=("event_date", "metric")):
    """Newest ``updated_at`` per key; on a tie the larger value, so the result is stable.

    One aggregation with map-side combine: repeated writes of a key collapse before the
    shuffle.
    """
    rows = kpis.unionByName(changes)
    newest = F.max(F.struct("updated_at", "value"))
    picked = rows.groupBy(*keys).agg(newest.alias("newest"))
    return picked.select(
        *keys, F.col("newest.value").alias("value"), F.col("newest.updated_at").alias("updated_at")
    )


def get(kpis, day, metric=None):
    hits = kpis.filter(F.col("event_date") == F.lit(day))
    return hits if metric is None else hits.filter(F.col("metric") == metric)


def between(kpis, first_day, last_day):
    hits = kpis.filter(F.col("event_date").between(F.lit(first_day), F.lit(last_day)))
    return hits.orderBy("event_date", "metric")


def long_form(rows, keys, metrics):
    """One row per (key, metric)."""
    wide = rows.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics])
    return wide.unpivot(list(keys), list(metrics), "metric", "value")


def daily_kpis(daily, updated_at="date"):
    """cash_in, cash_out and num_tx of each day in long form."""
    rows = daily.select(
        F.col("date").alias("event_date"),
        "cash_in",
        "cash_out",
        F.col("transaction_count").alias("num_tx"),
        F.col(updated_at).cast("timestamp").alias("updated_at"),
    )
    long = long_form(rows, ("event_date", "updated_at"), ("cash_in", "cash_out", "num_tx"))
    return long.select("event_date", "metric", "value", "updated_at")


MONTHLY_METRICS = ("total_amount", "num_tx", "avg_ticket", "fail_rate")


def _monthly(rows, keys):
    """Totals per month; money is summed exactly and divided once."""
    failed = F.when(F.col("status") == "FAILED", 1).otherwise(0)
    month = month_yyyymm("event_date").alias("month_yyyymm")
    sums = rows.groupBy(*keys, month).agg(
        F.sum("amount_vnd").cast("double").alias("total_amount"),
        F.count(F.lit(1)).cast("double").alias("num_tx"),
        F.sum(failed).cast("double").alias("_failed"),
        F.max("event_ts").alias("updated_at"),
    )
    wide = sums.withColumns(
        {
            "avg_ticket": F.col("total_amount") / F.col("num_tx"),
            "fail_rate": F.col("_failed") / F.col("num_tx"),
        }
    )
    return long_form(wide, (*keys, "month_yyyymm", "updated_at"), MONTHLY_METRICS)


def monthly(rows):
    return _monthly(rows, ())


def monthly_by_account(rows):
    return _monthly(rows, ("account_id",))


def account_days(rows):
    """Totals in and out and count per (day, account), from one pass over the ledger."""
    credit = F.when(F.col("cash_direction") == "cash_in", F.col("amount_vnd")).otherwise(0)
    debit = F.when(F.col("cash_direction") == "cash_out", F.col("amount_vnd")).otherwise(0)
    return rows.groupBy("event_date", "account_id").agg(
        F.sum(credit).alias("in_"), F.sum(debit).alias("out_"), F.count(F.lit(1)).alias("n")
    )


def company_statistics(days, by="day"):
    """Totals, count and active accounts per day or month, from ``account_days``.

    Accounts are first reduced to one row per (period, account), so counting them never
    gathers the transactions of a busy period in one task.
    """
    period = F.col("event_date") if by == "day" else F.trunc("event_date", "MM")
    per_account = days.groupBy(period.alias("period"), "account_id").agg(
        F.sum("in_").alias("in_"), F.sum("out_").alias("out_"), F.sum("n").alias("n")
    )
    return per_account.groupBy("period").agg(
        F.sum("in_").alias("total_in"),
        F.sum("out_").alias("total_out"),
        F.sum("n").alias("transaction_count"),
        F.count("account_id").alias("active_accounts"),
    )
