"""Daily roll-up of cash rows and merging of daily tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from cashtide.functions.clean import channel_or_default
from cashtide.functions.dates import date_parts
from cashtide.schemas import MONEY_SUM


def _total(name):
    zero = F.lit(0).cast(MONEY_SUM)
    return F.coalesce(F.sum(F.col(name).cast(MONEY_SUM)), zero).cast(MONEY_SUM).alias(name)


def roll_up(rows, series_keys=()):
    """One row per (series, date): totals, count, net and date parts; null dates dropped."""
    rows = rows.filter(F.col("date").isNotNull())
    days = rows.groupBy(*series_keys, "date").agg(
        _total("cash_in"), _total("cash_out"), F.count(F.lit(1)).alias("transaction_count")
    )
    return with_net(days)


def with_net(days):
    parts = date_parts("date")
    net = (F.col("cash_in") - F.col("cash_out")).cast(MONEY_SUM).alias("balance")
    kept = [c for c in days.columns if c not in ("balance", "day_of_week", "month", "quarter")]
    return days.select(*kept, net, *parts)


def roll_up_stats(rows):
    """Run statistics: rows read, days written, total in and out."""
    days = roll_up(rows)
    return days.agg(
        F.sum("transaction_count").alias("rows_processed"),
        F.count(F.lit(1)).alias("days"),
        F.sum("cash_in").alias("cash_in_total"),
        F.sum("cash_out").alias("cash_out_total"),
    )


def first_channel(rows, order=("event_ts", "tx_id"), series_keys=()):
    """Channel of the earliest row of a day."""
    picked = F.min_by(channel_or_default("channel"), F.struct(*order))
    return rows.groupBy(*series_keys, "date").agg(picked.alias("channel_first"))


def common_channel(rows, by=("date",)):
    """Most common channel, ties to the smallest name; ``by=()`` covers the whole table.

    Counting per channel first keeps the state of a day at one row per channel.
    """
    counts = rows.groupBy(*by, channel_or_default("channel").alias("channel")).agg(
        F.count(F.lit(1)).alias("n")
    )
    best = F.min(F.struct((-F.col("n")).alias("rank"), "channel"))
    return counts.groupBy(*by).agg(best.alias("best")).select(
        *by, F.col("best.channel").alias("channel_mode")
    )


def by_channel(rows):
    """Totals per (date, channel) straight from ledger rows."""
    return roll_up(rows, ("channel",)).select(
        "date", "channel", "cash_in", "cash_out", "transaction_count"
    )


def merge_additive(history, batch, series_keys=()):
    """Dates in both tables are summed and the net recomputed; others are appended.

    The channel of a date comes from the history when it has one.
    """
    sides = [
        side.withColumn("_side", F.lit(rank)) for rank, side in enumerate((history, batch))
    ]
    rows = sides[0].unionByName(sides[1], allowMissingColumns=True)
    rows = rows.withColumn(
        "_channel", F.when(F.col("channel").isNotNull(), F.struct("_side", "channel"))
    )
    merged = rows.groupBy(*series_keys, "date").agg(
        _total("cash_in"),
        _total("cash_out"),
        channel_or_default(F.min("_channel")["channel"]).alias("channel"),
    )
    return with_net(merged)


def merge_replace(history, batch, series_keys=(), prefer=None):
    """The new batch replaces whole dates of the history; columns are aligned by name.

    A batch that repeats a date counts with its first row in ``prefer`` order, by default the
    one with most rows behind it, then the larger amounts.
    """
    keys = [*series_keys, "date"]
    if prefer is None:
        ranked = ("transaction_count", "cash_in", "cash_out")
        prefer = [F.col(c).desc_nulls_last() for c in ranked if c in batch.columns]
    batch = one_row_per_date(batch, prefer, series_keys)
    kept = history.join(batch.select(*keys), keys, "left_anti")
    return kept.unionByName(batch, allowMissingColumns=True)


def one_row_per_date(rows, prefer, series_keys=()):
    """Keep one row per date, the one first in ``prefer`` order."""
    order = Window.partitionBy(*series_keys, "date").orderBy(*prefer)
    ranked = rows.withColumn("_rank", F.row_number().over(order))
    return ranked.filter(F.col("_rank") == 1).drop("_rank")


def union_evolving(*tables):
    """Append tables whose columns differ; absent columns become null."""
    result = tables[0]
    for table in tables[1:]:
        result = result.unionByName(table, allowMissingColumns=True)
    return result
