"""Explicit schemas of every table the library reads or writes."""

from pyspark.sql import types as T

_STR, _DBL, _INT = T.StringType(), T.DoubleType(), T.IntegerType()
_DATE, _TS = T.DateType(), T.TimestampType()
MONEY = T.DecimalType(18, 2)
MONEY_SUM = T.DecimalType(38, 2)
#: An amount as it came, before conversion: more digits than any currency has.
AMOUNT = T.DecimalType(28, 10)


def _struct(**fields):
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


PAYLOAD = _struct(
    account_id=_STR, client_tx_id=_STR, client_transfer_id=_STR, amount=_DBL, currency=_STR,
    transaction_type=_STR, merchant=_STR, status=_STR, extra_json=_STR, sender_id=_STR,
    receiver_id=_STR, type=_STR, description=_STR, event_ts=_TS, tx_id=_STR,
)

LEDGER = _struct(
    account_id=_STR, event_date=_DATE, event_ts=_TS, tx_id=_STR, transfer_id=_STR, direction=_STR,
    counterparty_account_id=_STR, amount=AMOUNT, currency=_STR, merchant=_STR, status=_STR,
    extra_json=_STR,
)

DEDUP_KEYS = _struct(account_id=_STR, client_tx_id=_STR, tx_id=_STR, created_at=_TS)

DAILY_STAGING = _struct(
    date=_DATE, cash_in=_DBL, cash_out=_DBL, channel=_STR, day_of_week=_INT, month=_INT,
    quarter=_INT, balance=_DBL, client_tx_id=_STR,
)

DAILY = _struct(
    date=_DATE, cash_in=_DBL, cash_out=_DBL, day_of_week=_INT, month=_INT, quarter=_INT,
    balance=_DBL, channel=_STR,
)

KPI = _struct(event_date=_DATE, metric=_STR, value=_DBL, updated_at=_TS)

API_CALLS = _struct(
    day=_DATE, ts=_TS, endpoint=_STR, method=_STR, status=_INT, account_id=_STR, client_ip=_STR,
    extra_json=_STR,
)

# The feature columns of each direction and the six targets.
FEATURES_IN = (
    "cash_in_d0", "cash_out_d0", "cash_net_d0", "lag1_in", "lag7_in", "roll_mean_7_in",
    "dow", "is_weekend", "is_month_end", "is_payday", "channel",
)
FEATURES_OUT = (
    "cash_in_d0", "cash_out_d0", "cash_net_d0", "lag1_out", "lag7_out", "roll_mean_7_out",
    "dow", "is_weekend", "is_month_end", "is_payday", "channel",
)
TARGETS = (
    "cash_in_next_day",
    "cash_out_next_day",
    "cash_in_h7_sum",
    "cash_out_h7_sum",
    "cash_in_next_month_sum",
    "cash_out_next_month_sum",
)
DEFAULT_CURRENCY = "VND"
DEFAULT_CHANNEL = "DEFAULT"


def features_for(target):
    """Feature columns for a target: a name mentioning ``out`` uses the cash-out lags."""
    return FEATURES_OUT if "out" in target.lower() else FEATURES_IN


def numeric_features_for(target):
    return tuple(name for name in features_for(target) if name != "channel")
