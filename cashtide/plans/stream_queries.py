"""Streaming queries: each consumes the whole events table and returns the table it wrote."""

from pyspark.sql import functions as F

from cashtide.functions import jsonmap
from cashtide.operators import kpi
from cashtide.plans.shared import (
    BROKEN_LINE_SQL,
    DAILY,
    LEDGER_LEGS,
    LEDGER_ROWS,
    SQL_TS,
    as_double,
    as_long,
    stamp,
)
from cashtide.schemas import DEDUP_KEYS
from cashtide.session import fresh_dir
from cashtide.sources import files, tables
from cashtide.sources.tables import payloads_of
from cashtide.streaming import jobs

QUERIES, ORACLE = {}, {}


def query(sql=None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return register


def _payloads(spark, sf):
    return payloads_of(jobs.table_stream(spark, sf, "events"))


def _ledger(spark, sf):
    """The folder of a ledger that a stream over all events has written."""
    uri, state = fresh_dir(spark, "stream-ledger"), fresh_dir(spark, "state")
    jobs.ingest_batches(_payloads(spark, sf), uri, state)
    return uri


@query(f"""WITH {LEDGER_ROWS}
SELECT account_id, event_date, tx_id, CAST(CAST(amount AS DECIMAL(28,10)) AS DOUBLE) AS amount,
       currency, p2p_role FROM good""")
def stream_ingest(spark, sf):
    rows = files.read_ledger(spark, f"{_ledger(spark, sf)}/ledger")
    role = jsonmap.text_at(jsonmap.decode("extra_json"), "p2p_role").alias("p2p_role")
    return rows.select(
        "account_id", "event_date", "tx_id", *as_double("amount"), "currency", role
    )


@query(f"""WITH {LEDGER_ROWS}
SELECT account_id, tx_id, reject_reason, NULL AS raw_line FROM classified
WHERE reject_reason IS NOT NULL
UNION ALL SELECT NULL, NULL, 'unreadable_line', {BROKEN_LINE_SQL} FROM payload WHERE k % 13 = 0""")
def stream_rejects(spark, sf):
    """Legs that a stream of payload lines refused, with their reason, and the text of lines that
    break off."""
    source = fresh_dir(spark, "payload-lines")
    tables.payload_lines(tables.payloads(spark, sf)).write.text(source)
    uri, state = fresh_dir(spark, "stream-ledger"), fresh_dir(spark, "state")
    jobs.ingest_batches(jobs.payload_stream(spark, source), uri, state)
    rows = spark.read.parquet(f"{uri}/rejects")
    known = F.when(F.col("raw_line").isNull(), F.col("tx_id")).alias("tx_id")
    return rows.select("account_id", known, "reject_reason", "raw_line")


@query(f"""WITH {LEDGER_LEGS}
SELECT account_id, client_tx_id, tx_id, strftime(event_ts, {SQL_TS}) AS created_at
FROM first_rows""")
def stream_dedup(spark, sf):
    """Keys that the stream has stored, each with the row that won."""
    rows = spark.read.schema(DEDUP_KEYS).parquet(f"{_ledger(spark, sf)}/keys")
    return rows.select("account_id", "client_tx_id", "tx_id", stamp("created_at"))


@query(f"""WITH {LEDGER_ROWS} SELECT event_date AS date,
  CAST(sum(CASE WHEN cash_direction = 'cash_in' THEN amount_vnd ELSE 0 END) AS DOUBLE) AS cash_in,
  CAST(sum(CASE WHEN cash_direction = 'cash_out' THEN amount_vnd ELSE 0 END) AS DOUBLE)
    AS cash_out, count(*) AS transaction_count
FROM good GROUP BY event_date""")
def stream_daily_rollup(spark, sf):
    uri, state = fresh_dir(spark, "stream-daily"), fresh_dir(spark, "state")
    ledger = jobs.ledger_stream(spark, _ledger(spark, sf))
    jobs.append_versions(jobs.daily_totals(ledger), uri, state, ["date"])
    rows = jobs.newest_versions(spark, uri, ["date"])
    return rows.select("date", *as_double("cash_in", "cash_out"), *as_long("transaction_count"))


@query(f"""WITH {LEDGER_ROWS} SELECT account_id,
  CAST(sum(CASE WHEN cash_direction = 'cash_in' THEN amount_vnd ELSE -amount_vnd END) AS DOUBLE)
    AS balance, strftime(max(event_ts), {SQL_TS}) AS updated_at
FROM good GROUP BY account_id""")
def stream_account_balance(spark, sf):
    uri, state = fresh_dir(spark, "stream-balances"), fresh_dir(spark, "state")
    ledger = jobs.ledger_stream(spark, _ledger(spark, sf))
    jobs.append_versions(jobs.account_totals(ledger), uri, state, ["account_id"])
    rows = jobs.newest_versions(spark, uri, ["account_id"])
    return rows.select("account_id", *as_double("balance"), stamp("updated_at"))


@query(f"""WITH {DAILY}, kpi AS (
  SELECT date, 'cash_in' AS metric, CAST(cash_in AS DOUBLE) AS value FROM daily
  UNION ALL SELECT date, 'cash_out', CAST(cash_out AS DOUBLE) FROM daily
  UNION ALL SELECT date, 'num_tx', CAST(transaction_count AS DOUBLE) FROM daily)
SELECT date AS event_date, metric, value + 1 AS value FROM kpi""")
def stream_kpi(spark, sf):
    """Each KPI written twice to a stream, the newer write first; the newer one stands."""
    first = kpi.daily_kpis(tables.daily(spark, sf))
    later = first.withColumns(
        {
            "value": F.col("value") + 1,
            "updated_at": F.col("updated_at") + F.expr("INTERVAL 1 HOUR"),
        }
    )
    source, uri, state = (fresh_dir(spark, n) for n in ("kpi-writes", "stream-kpi", "state"))
    for rows in (later, first):
        rows.write.mode("append").parquet(source)
    stream = spark.readStream.schema(first.schema).parquet(source)
    jobs.append_versions(jobs.kpi_totals(stream), uri, state, ["event_date", "metric"])
    newest = jobs.newest_versions(spark, uri, ["event_date", "metric"])
    return newest.select("event_date", "metric", "value")


@query(f"""SELECT CAST(ts AS DATE) AS day, strftime(ts, {SQL_TS}) AS ts, '/' || event_type AS endpoint,
  CAST(CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS INTEGER) AS status,
  'ACC' || user_id AS account_id FROM events""")
def stream_api_log(spark, sf):
    uri, state = fresh_dir(spark, "stream-calls"), fresh_dir(spark, "state")
    calls = tables.api_calls_of(jobs.table_stream(spark, sf, "events"))
    jobs.append_api_calls(calls, uri, state)
    rows = files.read_api_calls(spark, uri)
    return rows.select("day", stamp("ts"), "endpoint", "status", "account_id")
