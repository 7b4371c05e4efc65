"""Currency conversion into VND."""

from pyspark.sql import functions as F

from cashtide.functions.clean import first_filled, to_amount, to_number
from cashtide.schemas import AMOUNT, DEFAULT_CURRENCY, MONEY_SUM

# VND per unit of currency.
VND_RATES = {
    "VND": 1,
    "USD": 23650,
    "EUR": 25800,
    "GBP": 29800,
    "JPY": 160,
    "AUD": 15400,
    "SGD": 17500,
}


def currency_code(value):
    return F.upper(first_filled(value, F.lit(DEFAULT_CURRENCY)))


def vnd_rate(value):
    """Rate of a currency, null when unsupported; a literal lookup inside the projection."""
    pairs = [F.lit(part) for pair in VND_RATES.items() for part in pair]
    return F.create_map(*pairs)[currency_code(value)]


def amount_vnd(amount, currency):
    """Absolute amount in VND: converted with all its digits, then rounded once.

    Null when the currency is unsupported. Unreadable amounts count as 0, amounts too large
    to hold give null; ``reject_reason`` names both.
    """
    units = F.when(to_number(amount).isNull(), F.lit(0).cast(AMOUNT)).otherwise(to_amount(amount))
    return (F.abs(units) * vnd_rate(currency).cast("decimal(6,0)")).cast(MONEY_SUM)


def rate_table(spark):
    rows = [(code, float(rate)) for code, rate in VND_RATES.items()]
    return spark.createDataFrame(rows, "currency string, rate double")


def join_rates(df, rates, currency="currency"):
    """Left join against a caller's rate table.

    No broadcast hint: the optimizer broadcasts it while it is below the threshold.
    """
    keyed = df.withColumn("currency_code", currency_code(currency))
    rates = rates.select(F.upper("currency").alias("currency_code"), F.col("rate"))
    return keyed.join(rates, "currency_code", "left")
