"""Adapters from the given tables to payloads, API calls, daily series and customers."""

from pyspark.sql import functions as F

from cashtide.operators import daily as D
from cashtide.operators import ingest
from cashtide.schemas import MONEY, PAYLOAD

# How event rows are read as transactions.
TYPE_BY_EVENT = {
    "purchase": " Withdraw ",
    "signup": "deposit",
    "click": "CASH_IN",
    "view": "cashout",
}
CURRENCIES = ("VND", "USD", "EUR", "GBP", "JPY", "AUD", "SGD", "XXX")


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def payloads_of(events):
    """Event rows as transaction payloads (``ts`` is read as UTC)."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.lit(None).cast("string")
    for event, label in TYPE_BY_EVENT.items():
        kind = F.when(F.col("event_type") == event, label).otherwise(kind)
    codes = F.array(*[F.lit(code) for code in CURRENCIES])
    account = F.concat(F.lit("ACC"), "user_id")
    peer = F.col("k") % 7 == 0
    own_direction = (F.col("event_type") == "error") & (F.col("k") % 2 == 0)
    status = F.when(F.col("k") % 10 == 0, "FAILED").when(F.col("k") % 10 == 1, "PENDING")
    return events.withColumn("k", k).select(
        account.alias("account_id"),
        F.concat_ws("-", F.col("user_id").cast("string"), F.col("k").cast("string")).alias(
            "client_tx_id"
        ),
        F.lit(None).cast("string").alias("client_transfer_id"),
        F.when(F.col("k") % 5 == 0, -F.col("value")).otherwise(F.col("value")).alias("amount"),
        F.get(codes, (F.col("user_id") % 8).cast("int")).alias("currency"),
        kind.alias("transaction_type"),
        F.when(F.col("k") % 11 != 0, F.col("event_type")).alias("merchant"),
        status.otherwise("SETTLED").alias("status"),
        F.when(own_direction, '{"direction":"out"}').otherwise(F.col("props")).alias("extra_json"),
        F.when(peer, account).alias("sender_id"),
        F.when(peer, F.concat(F.lit("ACC"), (F.col("user_id") + 1).cast("string"))).alias(
            "receiver_id"
        ),
        F.when(peer, "p2p").alias("type"),
        F.lit(None).cast("string").alias("description"),
        F.col("ts").cast("timestamp").alias("event_ts"),
        F.col("event_id").cast("string").alias("tx_id"),
        "k",
    )


def payloads(spark, sf_dir):
    return payloads_of(table(spark, sf_dir, "events"))


def cash_rows(spark, sf_dir):
    """Classified transactions, one per event, refused rows included."""
    return ingest.classify(ingest.normalize_payload(payloads(spark, sf_dir)))


def accepted_rows(spark, sf_dir):
    """What the ledger counts: the first of repeated payloads, both legs, refused rows out."""
    return ingest.accepted(ingest.cash_legs(payloads(spark, sf_dir)))


def api_calls(spark, sf_dir):
    return api_calls_of(table(spark, sf_dir, "events"))


def api_calls_of(events):
    """Events as API calls: the day is absent on every third row."""
    ts = F.col("ts").cast("timestamp")
    return events.select(
        F.when(F.col("event_id") % 3 != 0, F.to_date(ts)).alias("day"),
        ts.alias("ts"),
        F.concat(F.lit("/"), "event_type").alias("endpoint"),
        F.lit("POST").alias("method"),
        F.when(F.col("event_type") == "error", "500").otherwise("200").alias("status"),
        F.concat(F.lit("ACC"), "user_id").alias("account_id"),
        F.lit(None).cast("string").alias("client_ip"),
        F.col("props").alias("extra_json"),
        F.col("value").alias("latency_ms"),
    )


def staging_of(orders):
    """Orders as daily staging rows: status F and O are money in, P is money out."""
    price = F.col("o_totalprice").cast(MONEY)
    zero = F.lit(0).cast(MONEY)
    return orders.select(
        F.to_date("o_orderdate").alias("date"),
        F.when(F.col("o_orderstatus").isin("F", "O"), price).otherwise(zero).alias("cash_in"),
        F.when(F.col("o_orderstatus") == "P", price).otherwise(zero).alias("cash_out"),
        F.col("o_orderpriority").alias("channel"),
        F.col("o_orderkey").alias("tx_id"),
        F.col("o_orderdate").cast("timestamp").alias("event_ts"),
        F.col("o_custkey").alias("customer_id"),
    )


def staging(spark, sf_dir):
    return staging_of(table(spark, sf_dir, "orders"))


def daily(spark, sf_dir, series_keys=()):
    return D.roll_up(staging(spark, sf_dir), series_keys)


def payload_lines(rows):
    """Payloads as lines of JSON, and for every 13th key one more line that breaks off."""
    names = [c for c in PAYLOAD.fieldNames() if c in rows.columns]
    options = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    whole = F.to_json(F.struct(*names), options)
    broken = F.concat(F.lit('{"tx_id":"'), "tx_id", F.lit('","amount":'))
    lines = F.filter(F.array(whole, F.when(F.col("k") % 13 == 0, broken)), lambda x: x.isNotNull())
    return rows.select(F.explode(lines).alias("value"))
