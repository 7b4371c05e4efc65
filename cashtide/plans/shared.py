"""Pieces shared by the registered queries and by their SQL oracles."""

from pyspark.sql import functions as F

from cashtide.functions.money import VND_RATES
from cashtide.sources.tables import CURRENCIES, TYPE_BY_EVENT

TS = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def stamp(column):
    """Timestamps leave a query as text, so that both engines print them alike."""
    return F.date_format(column, TS).alias(column if isinstance(column, str) else "ts")


def as_double(*names):
    return [F.col(n).cast("double").alias(n) for n in names]


def as_long(*names):
    return [F.col(n).cast("bigint").alias(n) for n in names]


def _cases(subject, pairs, quote=True):
    arms = " ".join(
        f"WHEN {key!r} THEN {value!r}" if quote else f"WHEN {key!r} THEN {value}"
        for key, value in pairs
    )
    return f"CASE {subject} {arms} END"


#: A payload line that breaks off, as ``tables.payload_lines`` adds for every 13th key.
BROKEN_LINE_SQL = """'{"tx_id":"' || tx_id || '","amount":'"""

SQL_TS = "'%Y-%m-%d %H:%M:%S.%f'"
_KIND = _cases("event_type", TYPE_BY_EVENT.items())
_CODES = "CASE user_id % 8 " + " ".join(
    f"WHEN {i} THEN '{code}'" for i, code in enumerate(CURRENCIES)
) + " END"
_RATE = _cases("currency", VND_RATES.items(), quote=False)


def norm_sql(value):
    label = f"lower(trim({value}))"
    return (
        f"CASE WHEN {label} IN ('cash_in','in','deposit','cashin') THEN 'cash_in' "
        f"WHEN {label} IN ('cash_out','out','withdraw','withdrawal','cashout') THEN 'cash_out' "
        f"ELSE nullif({label}, '') END"
    )


PAYLOAD = f"""
ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
payload AS (
  SELECT 'ACC' || user_id AS account_id, user_id || '-' || k AS client_tx_id,
         CAST(event_id AS VARCHAR) AS tx_id, ts AS event_ts, CAST(ts AS DATE) AS event_date,
         CASE WHEN k % 5 = 0 THEN -value ELSE value END AS amount,
         {_KIND} AS raw_type, {_CODES} AS currency,
         CASE WHEN k % 11 <> 0 THEN event_type END AS merchant,
         CASE k % 10 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'PENDING' ELSE 'SETTLED' END AS status,
         CASE WHEN event_type = 'error' AND k % 2 = 0 THEN '{{"direction":"out"}}'
              ELSE props END AS extra_json,
         CASE WHEN k % 7 = 0 THEN 'ACC' || user_id END AS sender_id,
         CASE WHEN k % 7 = 0 THEN 'ACC' || (user_id + 1) END AS receiver_id,
         CASE WHEN k % 7 = 0 THEN 'p2p' END AS type, k
  FROM ev)"""

UUID_SQL = (
    "substr(h,1,8) || '-' || substr(h,9,4) || '-' || substr(h,13,4) || '-' || substr(h,17,4) "
    "|| '-' || substr(h,21,12)"
)

# First of repeated payloads, then one row for each leg of a transfer.
LEDGER_LEGS = f"""{PAYLOAD},
first_rows AS (
  SELECT *, sha256(tx_id || '~receiver') AS h FROM payload QUALIFY row_number() OVER
    (PARTITION BY account_id, client_tx_id ORDER BY event_ts, tx_id) = 1),
leg AS (
  SELECT * EXCLUDE (h), CASE WHEN receiver_id IS NOT NULL THEN 'sender' END AS p2p_role,
         CAST(NULL AS VARCHAR) AS mirror_of
  FROM first_rows
  UNION ALL
  SELECT * EXCLUDE (h) REPLACE (receiver_id AS account_id, {UUID_SQL} AS tx_id,
                                'cash_in' AS raw_type), 'receiver', tx_id
  FROM first_rows WHERE receiver_id IS NOT NULL)"""


def _rows(source, steps):
    return f"""{steps},
typed AS (
  SELECT *, {norm_sql("coalesce(raw_type, type)")} AS transaction_type,
         {norm_sql("json_extract_string(extra_json, '$.direction')")} AS inner_type,
         {_RATE} AS rate, coalesce(merchant, 'DEFAULT') AS channel
  FROM {source}),
classified AS (
  SELECT *,
    CASE WHEN transaction_type IN ('cash_in','cash_out') THEN transaction_type
         WHEN inner_type IN ('cash_in','cash_out') THEN inner_type
         WHEN amount < 0 THEN 'cash_out' ELSE 'cash_in' END AS cash_direction,
    CAST(CAST(abs(amount) AS DECIMAL(28,10)) * rate AS DECIMAL(38,2)) AS amount_vnd,
    CASE WHEN rate IS NULL THEN 'unsupported_currency'
         WHEN amount = 0 THEN 'zero_amount' END AS reject_reason
  FROM typed),
good AS (SELECT * FROM classified WHERE reject_reason IS NULL)"""


#: Payloads as they came, classified; and the legs that the ledger counts.
ROWS = _rows("payload", PAYLOAD)
LEDGER_ROWS = _rows("leg", LEDGER_LEGS)

STAGING = """
staging AS (
  SELECT CAST(o_orderdate AS DATE) AS date,
         CASE WHEN o_orderstatus IN ('F','O') THEN CAST(o_totalprice AS DECIMAL(18,2))
              ELSE 0 END AS cash_in,
         CASE WHEN o_orderstatus = 'P' THEN CAST(o_totalprice AS DECIMAL(18,2))
              ELSE 0 END AS cash_out,
         o_orderpriority AS channel, o_orderkey AS tx_id, o_orderdate AS event_ts,
         o_custkey AS customer_id
  FROM orders)"""

DAILY = f"""{STAGING},
daily AS (
  SELECT date, sum(cash_in) AS cash_in, sum(cash_out) AS cash_out, count(*) AS transaction_count
  FROM staging GROUP BY date)"""

DAILY_BY_CHANNEL = f"""{STAGING},
daily AS (
  SELECT channel, date, sum(cash_in) AS cash_in, sum(cash_out) AS cash_out,
         count(*) AS transaction_count
  FROM staging GROUP BY channel, date)"""

DATE_PARTS = """CAST(isodow(date) - 1 AS INTEGER) AS day_of_week,
       CAST(month(date) AS INTEGER) AS month, CAST(quarter(date) AS INTEGER) AS quarter"""
