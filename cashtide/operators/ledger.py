"""Ledger reads, transfer pairing, balances and statements."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from cashtide.functions import jsonmap
from cashtide.functions.clean import first_filled


def _newest_first():
    return [F.col("event_ts").desc(), F.col("tx_id").asc()]


def account_day(ledger, account_id, day, limit=50):
    """Newest rows of one account on one day; both filters reach the scan."""
    hits = ledger.filter((F.col("account_id") == account_id) & (F.col("event_date") == F.lit(day)))
    return hits.orderBy(*_newest_first()).limit(limit)


def account_range(ledger, account_id, first_day, last_day, limit=200):
    """Newest rows of one account in an inclusive date range, in one pruned scan."""
    hits = ledger.filter(
        (F.col("account_id") == account_id)
        & F.col("event_date").between(F.lit(first_day), F.lit(last_day))
    )
    order = [F.col("event_date").desc(), *_newest_first()]
    return hits.orderBy(*order).limit(limit)


def by_tx_id(ledger, tx_id, account_id=None, day=None):
    """One row by id, the newest where an id was given twice.

    Account and day, when known, prune the scan; the id alone skips row groups by their bloom
    filters.
    """
    hits = ledger.filter(F.col("tx_id") == tx_id)
    if account_id is not None:
        hits = hits.filter(F.col("account_id") == account_id)
    if day is not None:
        hits = hits.filter(F.col("event_date") == F.lit(day))
    return hits.orderBy(*_newest_first(), "account_id").limit(1)


def most_recent(ledger, limit=500):
    return ledger.orderBy(*_newest_first()).limit(limit)


def newest_per_account(ledger, k):
    """Newest ``k`` rows of every account; the rank filter trims map-side before the shuffle."""
    order = Window.partitionBy("account_id").orderBy(*_newest_first())
    ranked = ledger.withColumn("rank", F.row_number().over(order).cast("int"))
    return ranked.filter(F.col("rank") <= k)


def paired_transfers(legs):
    """One row per transfer from its two legs (``extra.mirror_of`` names the sender leg)."""
    mirror_of = jsonmap.text_at("extra", "mirror_of")
    receiver = legs.filter(mirror_of.isNotNull()).select(
        mirror_of.alias("sender_tx_id"),
        F.col("tx_id").alias("receiver_tx_id"),
        F.col("account_id").alias("to_account"),
    )
    sender = legs.filter(jsonmap.text_at("extra", "p2p_role") == "sender").select(
        F.col("tx_id").alias("sender_tx_id"),
        F.col("account_id").alias("from_account"),
        "amount",
        "currency",
        F.col("event_ts").alias("created_at"),
        first_filled("status", F.lit("PENDING")).alias("status"),
    )
    return sender.join(receiver, "sender_tx_id")


def _signed():
    return F.when(F.col("cash_direction") == "cash_in", F.col("amount_vnd")).otherwise(
        -F.col("amount_vnd")
    )


def account_balances(rows):
    return rows.groupBy("account_id").agg(
        F.sum(_signed()).cast("decimal(38,2)").alias("balance"),
        F.max("event_ts").alias("updated_at"),
    )


def daily_statements(rows):
    """Open, close, debit, credit and count per account and day.

    Rows are first reduced to one per account-day, so the running window of an account
    sorts days, never transactions.
    """
    credit = F.when(F.col("cash_direction") == "cash_in", F.col("amount_vnd"))
    debit = F.when(F.col("cash_direction") == "cash_out", F.col("amount_vnd"))
    zero = F.lit(0).cast("decimal(38,2)")
    days = rows.groupBy("account_id", F.col("event_date").alias("day")).agg(
        F.coalesce(F.sum(debit), zero).alias("total_debit"),
        F.coalesce(F.sum(credit), zero).alias("total_credit"),
        F.count(F.lit(1)).alias("num_tx"),
        F.max("event_ts").alias("updated_at"),
    )
    running = (
        Window.partitionBy("account_id")
        .orderBy("day")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    net = F.col("total_credit") - F.col("total_debit")
    days = days.withColumn("balance_close", F.sum(net).over(running).cast("decimal(38,2)"))
    return days.withColumn("balance_open", (F.col("balance_close") - net).cast("decimal(38,2)"))


def month_summary(rows):
    """Per account and month: totals in and out, count, and balance at the month's end."""
    days = daily_statements(rows).withColumn("month", F.trunc("day", "MM"))
    return days.groupBy("account_id", "month").agg(
        F.sum("total_credit").alias("total_in"),
        F.sum("total_debit").alias("total_out"),
        F.sum("num_tx").alias("transaction_count"),
        F.max_by("balance_close", "day").alias("balance"),
    )


def accounts_of_customers(accounts, customers):
    return customers.join(accounts, "customer_id")


def search_customers(customers, needle, columns):
    """Case-insensitive substring match on any of the columns."""
    needle = needle.lower()
    hit = F.lit(False)
    for name in columns:
        hit = hit | F.contains(F.lower(F.col(name).cast("string")), F.lit(needle))
    return customers.filter(hit)
