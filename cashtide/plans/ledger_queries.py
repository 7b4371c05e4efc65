"""Queries over transactions: normalisation, ingest, ledger reads, balances, reports."""

from pyspark.sql import functions as F

from cashtide.functions import clean, dates, jsonmap, labels, money
from cashtide.operators import daily as D
from cashtide.operators import dedup, ingest, kpi, ledger, profile, reports
from cashtide.plans.shared import (
    BROKEN_LINE_SQL,
    LEDGER_LEGS,
    LEDGER_ROWS,
    PAYLOAD,
    ROWS,
    SQL_TS,
    UUID_SQL,
    as_double,
    as_long,
    norm_sql,
    stamp,
)
from cashtide.session import cut, fresh_dir
from cashtide.sources import files, tables

QUERIES, ORACLE = {}, {}


def query(sql=None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return register


# ---------------------------------------------------------------- scalar functions


@query(f"""WITH {PAYLOAD}
SELECT tx_id, {norm_sql("raw_type")} AS tx_type, {norm_sql("merchant")} AS merchant_type
FROM payload""")
def norm_tx_type(spark, sf):
    return tables.payloads(spark, sf).select(
        "tx_id",
        labels.normalize_type("transaction_type").alias("tx_type"),
        labels.normalize_type("merchant").alias("merchant_type"),
    )


@query(f"WITH {ROWS} SELECT tx_id, transaction_type, cash_direction FROM classified")
def infer_direction(spark, sf):
    return tables.cash_rows(spark, sf).select("tx_id", "transaction_type", "cash_direction")


@query(f"""WITH {ROWS}
SELECT tx_id, currency, CAST(rate AS DOUBLE) AS rate, CAST(amount_vnd AS DOUBLE) AS amount_vnd
FROM classified WHERE amount_vnd IS NULL OR amount_vnd > 0""")
def fx_to_vnd(spark, sf):
    rows = money.join_rates(tables.payloads(spark, sf), money.rate_table(spark))
    vnd = F.abs(clean.to_amount("amount")) * F.col("rate").cast("decimal(6,0)")
    rows = rows.withColumn("amount_vnd", vnd.cast("decimal(38,2)").cast("double"))
    keep = F.col("amount_vnd").isNull() | (F.col("amount_vnd") > 0)
    return rows.filter(keep).select("tx_id", "currency", "rate", "amount_vnd")


@query(f"""WITH {PAYLOAD}, t AS (
  SELECT tx_id, k, event_ts,
    CASE k % 4 WHEN 0 THEN strftime(event_ts, '%Y-%m-%d') WHEN 1 THEN 'not a date' END AS stated,
    CASE WHEN k % 3 = 0 THEN strftime(event_ts + INTERVAL 7 HOUR, '%Y-%m-%dT%H:%M:%S') || '+07:00'
         WHEN k % 3 = 1 THEN strftime(event_ts, '%Y-%m-%dT%H:%M:%S') END AS ts_text
  FROM payload)
SELECT tx_id,
  coalesce(TRY_CAST(stated AS DATE), CASE WHEN ts_text IS NOT NULL THEN CAST(event_ts AS DATE) END)
    AS event_date,
  CASE WHEN ts_text IS NOT NULL THEN strftime(event_ts, '%Y-%m-%d %H:%M:%S') END AS utc
FROM t""")
def derive_event_date(spark, sf):
    """Stated day, readable or not, against naive and offset timestamp text."""
    rows = tables.payloads(spark, sf)
    k, iso = F.col("k"), "yyyy-MM-dd'T'HH:mm:ss"
    offset = F.date_format(F.col("event_ts") + F.expr("INTERVAL 7 HOURS"), iso)
    rows = rows.withColumns(
        {
            "stated": F.when(k % 4 == 0, F.date_format("event_ts", "yyyy-MM-dd")).when(
                k % 4 == 1, "not a date"
            ),
            "ts_text": F.when(k % 3 == 0, F.concat(offset, F.lit("+07:00"))).when(
                k % 3 == 1, F.date_format("event_ts", iso)
            ),
        }
    )
    return rows.select(
        "tx_id",
        dates.event_date("stated", "ts_text").alias("event_date"),
        F.date_format(dates.utc_timestamp("ts_text"), "yyyy-MM-dd HH:mm:ss").alias("utc"),
    )


def _odd_json(k, props):
    return (
        F.when(k % 6 == 0, "")
        .when(k % 6 == 1, "[1,2]")
        .when(k % 6 == 2, "{broken")
        .otherwise(props)
    )


@query(f"""WITH {PAYLOAD}
SELECT tx_id, CASE WHEN k % 6 > 2 THEN CAST(k AS VARCHAR) END AS k_text,
       CASE WHEN k % 6 > 2 THEN 1 ELSE 0 END AS is_object,
       CASE WHEN k % 6 > 2 THEN '{{"k":' || k || ',"o":{{"a":[1,true,null]}},"t":"x"}}' END AS encoded
FROM payload""")
def json_decode(spark, sf):
    rows = tables.payloads(spark, sf)
    whole = F.concat(F.lit('{"k": '), "k", F.lit(', "o": {"a": [1, true, null]}, "t": "x"}'))
    raw = _odd_json(F.col("k"), whole)
    rows = rows.withColumn("m", jsonmap.decode(raw))
    return rows.select(
        "tx_id",
        jsonmap.text_at("m", "k").alias("k_text"),
        F.col("m").isNotNull().cast("int").alias("is_object"),
        jsonmap.encode("m").alias("encoded"),
    )


@query(f"""WITH {PAYLOAD}
SELECT tx_id,
  CASE WHEN merchant IS NOT NULL THEN merchant ELSE CAST(k AS VARCHAR) END AS merged_k,
  receiver_id AS merged_peer, CAST(k AS VARCHAR) AS kept_k, status AS kept_status,
  CASE WHEN receiver_id IS NULL THEN 1 ELSE 2 END AS merged_size
FROM payload""")
def json_merge(spark, sf):
    """Additions win in ``merge``; existing keys win in ``set_default``."""
    base = jsonmap.of_texts(F.create_map(F.lit("k"), F.col("k").cast("string")))
    added = jsonmap.additions(k="merchant", peer="receiver_id")
    defaults = jsonmap.additions(k=F.lit("x"), status="status")
    rows = tables.payloads(spark, sf).select(
        "tx_id",
        jsonmap.merge(base, added).alias("merged"),
        jsonmap.set_default(base, defaults).alias("kept"),
    )
    return rows.select(
        "tx_id",
        jsonmap.text_at("merged", "k").alias("merged_k"),
        jsonmap.text_at("merged", "peer").alias("merged_peer"),
        jsonmap.text_at("kept", "k").alias("kept_k"),
        jsonmap.text_at("kept", "status").alias("kept_status"),
        F.size("merged").alias("merged_size"),
    )


def _sparse_payloads(spark, sf):
    """Payloads with gaps: no account, type, client id or currency on some rows."""
    k = F.col("k")
    return tables.payloads(spark, sf).withColumns(
        {
            "account_id": F.when((k % 7 != 0) & (k % 13 != 1), F.col("account_id")),
            "receiver_id": F.when(k % 13 == 1, F.col("account_id")).otherwise(
                F.col("receiver_id")
            ),
            "transaction_type": F.when(k % 3 != 0, F.col("transaction_type")),
            "type": F.when(k % 21 != 0, F.col("type")),
            "client_tx_id": F.when(k % 17 != 0, F.col("client_tx_id")),
            "client_transfer_id": F.when(k % 2 == 0, F.concat(F.lit("T"), "tx_id")),
            "currency": F.when(k % 9 != 0, F.col("currency")).otherwise(""),
            "description": F.when(k % 4 == 0, "note").otherwise(""),
        }
    )


@query(f"""WITH {PAYLOAD}, gaps AS (
  SELECT tx_id, k, sender_id, sha256(tx_id || '~client') AS h,
    CASE WHEN k % 7 <> 0 AND k % 13 <> 1 THEN account_id END AS acc,
    CASE WHEN k % 13 = 1 THEN account_id ELSE receiver_id END AS receiver_id,
    CASE WHEN k % 3 <> 0 THEN raw_type END AS tt, CASE WHEN k % 21 <> 0 THEN type END AS type,
    CASE WHEN k % 17 <> 0 THEN client_tx_id END AS cid,
    CASE WHEN k % 9 <> 0 THEN currency ELSE 'VND' END AS currency
  FROM payload)
SELECT tx_id, coalesce(acc, sender_id, receiver_id) AS account_id,
  coalesce(tt, type, CASE WHEN acc IS NULL THEN
    CASE WHEN sender_id IS NOT NULL THEN 'cash_out' WHEN receiver_id IS NOT NULL THEN 'cash_in' END
  END) AS transaction_type,
  coalesce(cid, CASE WHEN k % 2 = 0 THEN 'T' || tx_id END, {UUID_SQL}) AS client_tx_id,
  currency, sender_id AS extra_sender, receiver_id AS extra_receiver, type AS extra_form_type,
  CASE WHEN k % 4 = 0 THEN 'note' END AS extra_description
FROM gaps""")
def normalize_payload(spark, sf):
    rows = ingest.normalize_payload(_sparse_payloads(spark, sf))
    return rows.select(
        "tx_id",
        "account_id",
        "transaction_type",
        "client_tx_id",
        "currency",
        jsonmap.text_at("extra", "sender_id").alias("extra_sender"),
        jsonmap.text_at("extra", "receiver_id").alias("extra_receiver"),
        jsonmap.text_at("extra", "form_type").alias("extra_form_type"),
        jsonmap.text_at("extra", "description").alias("extra_description"),
    )


_LEGS = f"""{PAYLOAD}, base AS (
  SELECT *, coalesce(raw_type, type) AS tt, sha256(tx_id || '~receiver') AS h FROM payload),
legs AS (
  SELECT account_id, client_tx_id, tt AS transaction_type, tx_id, amount, currency, event_ts,
         event_date, merchant, status, type, k,
         CASE WHEN receiver_id IS NOT NULL THEN 'sender' END AS p2p_role,
         receiver_id AS counterparty, CAST(NULL AS VARCHAR) AS mirror_of, extra_json
  FROM base
  UNION ALL
  SELECT receiver_id, NULL, 'cash_in', {UUID_SQL}, amount, currency, event_ts, event_date, merchant,
         status, type, k, 'receiver', sender_id, tx_id, extra_json
  FROM base WHERE receiver_id IS NOT NULL)"""


@query(f"""WITH {_LEGS}
SELECT account_id, transaction_type, tx_id, amount, p2p_role, counterparty, mirror_of FROM legs""")
def p2p_split(spark, sf):
    legs = ingest.split_transfers(ingest.normalize_payload(tables.payloads(spark, sf)))
    return legs.select(
        "account_id",
        "transaction_type",
        "tx_id",
        "amount",
        jsonmap.text_at("extra", "p2p_role").alias("p2p_role"),
        jsonmap.text_at("extra", "counterparty_account_id").alias("counterparty"),
        jsonmap.text_at("extra", "mirror_of").alias("mirror_of"),
    )


_STORED_TYPE = "coalesce(transaction_type, json_extract_string(extra_json, '$.direction'))"


@query(f"""WITH {LEDGER_ROWS}
SELECT account_id, event_date, tx_id, CAST(CAST(amount AS DECIMAL(28,10)) AS DOUBLE) AS amount,
       currency, merchant, status, {_STORED_TYPE} AS transaction_type,
       coalesce(inner_type, transaction_type) AS direction_label, type AS form_type
FROM good""")
def decode_ledger_row(spark, sf):
    """Stored rows decoded again: names inside the JSON text come back as columns."""
    rows = ingest.decode_ledger(ingest.ingest(tables.payloads(spark, sf))[0])
    return rows.select(
        "account_id",
        "event_date",
        "tx_id",
        "amount",
        "currency",
        "merchant",
        "status",
        "transaction_type",
        labels.normalize_type("direction").alias("direction_label"),
        jsonmap.text_at("extra", "form_type").alias("form_type"),
    )


@query(f"""WITH {PAYLOAD}
SELECT tx_id, TRY_CAST(CASE k % 3 WHEN 0 THEN 'bad' WHEN 1 THEN CAST(k AS VARCHAR) END AS DOUBLE)
         AS number,
       coalesce(TRY_CAST(CASE k % 3 WHEN 0 THEN 'bad' WHEN 1 THEN CAST(k AS VARCHAR) END
         AS DOUBLE), 0.0) AS number_or_zero
FROM payload""")
def coerce_numeric(spark, sf):
    k = F.col("k")
    raw = F.when(k % 3 == 0, "bad").when(k % 3 == 1, k.cast("string"))
    return tables.payloads(spark, sf).select(
        "tx_id",
        clean.to_number(raw).alias("number"),
        clean.to_number(raw, 0.0).alias("number_or_zero"),
    )


@query(f"""WITH {PAYLOAD}
SELECT tx_id, CASE WHEN k % 4 IN (0, 1) OR amount < 0 THEN 0.0 ELSE amount END AS clipped
FROM payload""")
def clip_non_negative(spark, sf):
    k = F.col("k")
    value = F.when(k % 4 == 0, F.lit(float("nan"))).when(k % 4 != 1, F.col("amount"))
    return tables.payloads(spark, sf).select(
        "tx_id", clean.clip_non_negative(value).alias("clipped")
    )


@query(f"""WITH {ROWS}
SELECT tx_id, CASE WHEN coalesce(type, transaction_type) = 'p2p' THEN 'customer'
  WHEN coalesce(type, transaction_type) IN ('cash_in', 'cash_out') THEN 'treasury'
  ELSE 'unknown' END AS class FROM classified""")
def tx_class_label(spark, sf):
    form = F.coalesce("type", "transaction_type")
    rows = tables.cash_rows(spark, sf)
    return rows.select("tx_id", labels.class_label(form).alias("class"))


@query(f"""WITH {LEDGER_ROWS}
SELECT event_date AS date, tx_id,
  CAST(CASE WHEN cash_direction = 'cash_in' THEN amount_vnd ELSE 0 END AS DOUBLE) AS cash_in,
  CAST(CASE WHEN cash_direction = 'cash_out' THEN amount_vnd ELSE 0 END AS DOUBLE) AS cash_out
FROM good""")
def split_in_out(spark, sf):
    rows = ingest.split_in_out(tables.accepted_rows(spark, sf))
    return rows.select("date", "tx_id", *as_double("cash_in", "cash_out"))


# ---------------------------------------------------------------- ingest and dedup


@query(f"""WITH {LEDGER_ROWS}
SELECT account_id, event_date, tx_id, CAST(CAST(amount AS DECIMAL(28,10)) AS DOUBLE) AS amount,
       currency, {_STORED_TYPE} AS transaction_type FROM good""")
def ingest_bulk(spark, sf):
    """Payloads written as JSON lines, read back with the payload schema and ingested."""
    uri = fresh_dir(spark, "payloads")
    tables.payloads(spark, sf).drop("k").write.json(uri)
    stored, _ = ingest.ingest(files.read_payloads(spark, uri))
    rows = ingest.decode_ledger(stored)
    return rows.select("account_id", "event_date", "tx_id", "amount", "currency",
                       "transaction_type")


@query(f"""WITH {LEDGER_ROWS}
SELECT account_id, event_date, tx_id, strftime(event_ts, {SQL_TS}) AS event_ts,
       CAST(CAST(amount AS DECIMAL(28,10)) AS DOUBLE) AS amount, currency, merchant, status,
       mirror_of
FROM good""")
def ledger_write_read(spark, sf):
    uri = fresh_dir(spark, "ledger")
    files.append_ledger(ingest.ingest(tables.payloads(spark, sf))[0], uri)
    back = files.read_ledger(spark, uri)
    return back.select(
        "account_id",
        "event_date",
        "tx_id",
        stamp("event_ts"),
        *as_double("amount"),
        "currency",
        "merchant",
        "status",
        jsonmap.text_at(jsonmap.decode("extra_json"), "mirror_of").alias("mirror_of"),
    )


@query(f"""WITH {ROWS}, gaps AS (
  SELECT *, CASE WHEN k % 19 = 0 AND k % 7 <> 0 THEN 'missing_account'
                 WHEN k % 23 = 0 THEN 'missing_date' WHEN k % 29 = 0 AND rate IS NOT NULL
                 THEN 'zero_amount' ELSE reject_reason END AS reason FROM classified)
SELECT tx_id, reason AS reject_reason, NULL AS raw_line FROM gaps WHERE reason IS NOT NULL
UNION ALL SELECT NULL, 'unreadable_line', {BROKEN_LINE_SQL} FROM payload WHERE k % 13 = 0""")
def ingest_rejects(spark, sf):
    """Payload lines with gaps, and lines that are cut off: each comes back with its reason, an
    unreadable one with its text."""
    k = F.col("k")
    rows = tables.payloads(spark, sf).withColumns(
        {
            "account_id": F.when(k % 19 != 0, F.col("account_id")),
            "event_ts": F.when(k % 23 != 0, F.col("event_ts")),
            "amount": F.when(k % 29 != 0, F.col("amount")).otherwise(0.0),
        }
    )
    uri = fresh_dir(spark, "payload-lines")
    tables.payload_lines(rows).write.text(uri)
    classified = ingest.classify(ingest.normalize_payload(files.read_payloads(spark, uri)))
    return ingest.rejected(classified).select("tx_id", "reject_reason", "raw_line")


_FIRST = """first AS (
  SELECT * FROM payload QUALIFY row_number() OVER
    (PARTITION BY account_id, client_tx_id ORDER BY event_ts, tx_id) = 1)"""


@query(f"""WITH {PAYLOAD}, {_FIRST}
SELECT account_id, client_tx_id, tx_id, strftime(event_ts, {SQL_TS}) AS event_ts, amount
FROM first""")
def dedup_first_wins(spark, sf):
    rows = dedup.first_wins(tables.payloads(spark, sf))
    return rows.select("account_id", "client_tx_id", "tx_id", stamp("event_ts"), "amount")


@query(f"""WITH {PAYLOAD}, {_FIRST}
SELECT p.account_id, p.client_tx_id, p.tx_id, f.tx_id AS first_tx_id, 'duplicate' AS status
FROM payload p JOIN first f USING (account_id, client_tx_id) WHERE p.tx_id <> f.tx_id""")
def dedup_duplicates_report(spark, sf):
    report = dedup.duplicates_report(tables.payloads(spark, sf))
    return report.select("account_id", "client_tx_id", "tx_id", "first_tx_id", "status")


@query(f"""WITH {PAYLOAD}
SELECT count(*) AS rows, count(DISTINCT client_tx_id) AS unique_ids FROM payload""")
def dedup_evidence(spark, sf):
    return dedup.evidence(tables.payloads(spark, sf)).select(*as_long("rows", "unique_ids"))


@query(f"""WITH {_LEGS}
SELECT s.tx_id AS sender_tx_id, r.tx_id AS receiver_tx_id, s.account_id AS from_account,
       r.account_id AS to_account, s.amount, s.currency, s.status,
       strftime(s.event_ts, {SQL_TS}) AS created_at
FROM legs s JOIN legs r ON r.mirror_of = s.tx_id""")
def p2p_pairing(spark, sf):
    legs = ingest.split_transfers(ingest.normalize_payload(tables.payloads(spark, sf)))
    return ledger.paired_transfers(legs).select(
        "sender_tx_id",
        "receiver_tx_id",
        "from_account",
        "to_account",
        "amount",
        "currency",
        "status",
        stamp("created_at"),
    )


# ---------------------------------------------------------------- ledger reads

_READ = ("account_id", "event_date", "tx_id", "amount", "transaction_type")
_READ_SQL = (
    f"account_id, event_date, tx_id, strftime(event_ts, {SQL_TS}) AS event_ts, amount, "
    f"{_STORED_TYPE} AS transaction_type"
)


def _read(rows):
    return rows.select(*_READ, stamp("event_ts"))


def _stored(spark, sf):
    """The ledger as it is stored, by day and sorted by account."""
    uri = fresh_dir(spark, "ledger")
    files.append_ledger(ingest.ingest(tables.payloads(spark, sf))[0], uri)
    return files.read_ledger(spark, uri)


def _decoded(rows):
    return _read(ingest.decode_ledger(rows))


@query(f"""WITH {LEDGER_ROWS} SELECT {_READ_SQL} FROM good c
WHERE account_id = 'ACC1' AND event_date = DATE '2024-01-10'
ORDER BY c.event_ts DESC, tx_id LIMIT 50""")
def tx_by_account_day(spark, sf):
    rows = _stored(spark, sf)
    return _decoded(ledger.account_day(rows, "ACC1", _day("2024-01-10"), 50))


@query(f"""WITH {LEDGER_ROWS} SELECT {_READ_SQL} FROM good c
WHERE account_id = 'ACC1' AND event_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'
ORDER BY event_date DESC, c.event_ts DESC, tx_id LIMIT 200""")
def tx_by_account_range(spark, sf):
    rows = _stored(spark, sf)
    return _decoded(ledger.account_range(rows, "ACC1", _day("2024-01-05"), _day("2024-01-20"), 200))


def _day(text):
    import datetime

    return datetime.date.fromisoformat(text)


@query(f"""WITH {LEDGER_ROWS} SELECT {_READ_SQL} FROM good c WHERE tx_id = '42'
UNION ALL SELECT {_READ_SQL} FROM good c WHERE tx_id = '42'""")
def tx_by_id(spark, sf):
    """The same row by id alone and by (account, day, id)."""
    rows = _stored(spark, sf)
    alone = ledger.by_tx_id(rows, "42")
    found = alone.select("account_id", "event_date").collect()  # one row at most
    account, day = found[0] if found else ("", _day("1970-01-01"))
    pruned = ledger.by_tx_id(rows, "42", account, day)
    return _decoded(alone).unionByName(_decoded(pruned))


@query(f"""WITH {LEDGER_ROWS} SELECT {_READ_SQL} FROM good c
ORDER BY c.event_ts DESC, tx_id LIMIT 500""")
def tx_all_recent(spark, sf):
    return _decoded(ledger.most_recent(_stored(spark, sf), 500))


@query(f"""WITH {LEDGER_ROWS}, r AS (SELECT *, row_number() OVER
  (PARTITION BY account_id ORDER BY event_ts DESC, tx_id) AS rank FROM good)
SELECT {_READ_SQL}, CAST(rank AS INTEGER) AS rank FROM r AS c WHERE rank <= 3""")
def topk_per_account(spark, sf):
    rows = ledger.newest_per_account(ingest.decode_ledger(_stored(spark, sf)), 3)
    return rows.select(*_READ, stamp("event_ts"), "rank")


# ---------------------------------------------------------------- balances, KPIs, reports

_SIGNED = "CASE WHEN cash_direction = 'cash_in' THEN amount_vnd ELSE -amount_vnd END"


@query(f"""WITH {LEDGER_ROWS}
SELECT account_id, CAST(sum({_SIGNED}) AS DOUBLE) AS balance,
       strftime(max(event_ts), {SQL_TS}) AS updated_at FROM good GROUP BY account_id""")
def account_balances(spark, sf):
    rows = ledger.account_balances(tables.accepted_rows(spark, sf))
    return rows.select("account_id", *as_double("balance"), stamp("updated_at"))


_STATEMENTS = f"""{LEDGER_ROWS}, days AS (
  SELECT account_id, event_date AS day,
    sum(CASE WHEN cash_direction = 'cash_out' THEN amount_vnd ELSE 0 END) AS total_debit,
    sum(CASE WHEN cash_direction = 'cash_in' THEN amount_vnd ELSE 0 END) AS total_credit,
    count(*) AS num_tx
  FROM good GROUP BY account_id, event_date),
st AS (SELECT *, sum(total_credit - total_debit) OVER
  (PARTITION BY account_id ORDER BY day) AS balance_close FROM days)"""


@query(f"""WITH {_STATEMENTS}
SELECT account_id, day, CAST(balance_close - total_credit + total_debit AS DOUBLE) AS balance_open,
  CAST(balance_close AS DOUBLE) AS balance_close, CAST(total_debit AS DOUBLE) AS total_debit,
  CAST(total_credit AS DOUBLE) AS total_credit, num_tx FROM st""")
def balance_daily_snapshots(spark, sf):
    rows = ledger.daily_statements(tables.accepted_rows(spark, sf))
    return rows.select(
        "account_id",
        "day",
        *as_double("balance_open", "balance_close", "total_debit", "total_credit"),
        *as_long("num_tx"),
    )


@query(f"""WITH {_STATEMENTS}, m AS (
  SELECT account_id, CAST(date_trunc('month', day) AS DATE) AS month, sum(total_credit) AS ti,
    sum(total_debit) AS tot, CAST(sum(num_tx) AS BIGINT) AS transaction_count,
    arg_max(balance_close, day) AS bal FROM st GROUP BY 1, 2)
SELECT c.c_name AS customer, m.account_id, m.month, CAST(ti AS DOUBLE) AS total_in,
  CAST(tot AS DOUBLE) AS total_out, transaction_count, CAST(bal AS DOUBLE) AS balance
FROM m JOIN customer c ON m.account_id = 'ACC' || c.c_custkey""")
def account_stats_month(spark, sf):
    """Month summary of the accounts of every customer."""
    months = ledger.month_summary(tables.accepted_rows(spark, sf))
    customers = tables.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("customer")
    )
    accounts = months.withColumn(
        "customer_id", F.substring("account_id", 4, 20).try_cast("bigint")
    )
    rows = ledger.accounts_of_customers(accounts, customers)
    return rows.select(
        "customer",
        "account_id",
        "month",
        *as_double("total_in", "total_out"),
        *as_long("transaction_count"),
        *as_double("balance"),
    )


def _monthly_sql(keys):
    prefix = "".join(f"{k}, " for k in keys)
    return f"""WITH {LEDGER_ROWS}, m AS (
  SELECT {prefix}CAST(year(event_date) * 100 + month(event_date) AS INTEGER) AS month_yyyymm,
    CAST(sum(amount_vnd) AS DOUBLE) AS total_amount, CAST(count(*) AS DOUBLE) AS num_tx,
    CAST(sum(CASE WHEN status = 'FAILED' THEN 1 ELSE 0 END) AS DOUBLE) AS failed
  FROM good GROUP BY {prefix}month_yyyymm)
SELECT {prefix}month_yyyymm, 'total_amount' AS metric, total_amount AS value FROM m
UNION ALL SELECT {prefix}month_yyyymm, 'num_tx', num_tx FROM m
UNION ALL SELECT {prefix}month_yyyymm, 'avg_ticket', round(total_amount / num_tx, 4) FROM m
UNION ALL SELECT {prefix}month_yyyymm, 'fail_rate', round(failed / num_tx, 4) FROM m"""


def _rounded_value():
    ratio = F.col("metric").isin("avg_ticket", "fail_rate")
    return F.when(ratio, F.round("value", 4)).otherwise(F.col("value")).alias("value")


@query(_monthly_sql(()))
def kpi_monthly(spark, sf):
    rows = kpi.monthly(tables.accepted_rows(spark, sf))
    return rows.select("month_yyyymm", "metric", _rounded_value())


@query(_monthly_sql(("account_id",)))
def kpi_monthly_by_account(spark, sf):
    rows = kpi.monthly_by_account(tables.accepted_rows(spark, sf))
    return rows.select("account_id", "month_yyyymm", "metric", _rounded_value())


def _company_sql(period, label):
    return f"""SELECT '{label}' AS granularity, {period} AS period,
  CAST(sum(CASE WHEN cash_direction = 'cash_in' THEN amount_vnd ELSE 0 END) AS DOUBLE) AS total_in,
  CAST(sum(CASE WHEN cash_direction = 'cash_out' THEN amount_vnd ELSE 0 END) AS DOUBLE)
    AS total_out,
  count(*) AS transaction_count, count(DISTINCT account_id) AS active_accounts
FROM good GROUP BY 2"""


@query(f"""WITH {LEDGER_ROWS}
{_company_sql('event_date', 'day')}
UNION ALL {_company_sql("CAST(date_trunc('month', event_date) AS DATE)", 'month')}""")
def company_stats(spark, sf):
    days = cut(kpi.account_days(tables.accepted_rows(spark, sf)), "account-days")
    parts = []
    for by in ("day", "month"):
        stats = kpi.company_statistics(days, by)
        parts.append(
            stats.select(
                F.lit(by).alias("granularity"),
                "period",
                *as_double("total_in", "total_out"),
                *as_long("transaction_count", "active_accounts"),
            )
        )
    return parts[0].unionByName(parts[1])


@query(f"""WITH {LEDGER_ROWS}
SELECT event_date AS date, channel,
  CAST(sum(CASE WHEN cash_direction = 'cash_in' THEN amount_vnd ELSE 0 END) AS DOUBLE) AS cash_in,
  CAST(sum(CASE WHEN cash_direction = 'cash_out' THEN amount_vnd ELSE 0 END) AS DOUBLE)
    AS cash_out, count(*) AS transaction_count
FROM good GROUP BY 1, 2""")
def ledger_daily_channel(spark, sf):
    rows = D.by_channel(ingest.split_in_out(tables.accepted_rows(spark, sf)))
    return rows.select(
        "date", "channel", *as_double("cash_in", "cash_out"), *as_long("transaction_count")
    )


@query(f"""WITH {LEDGER_ROWS}
SELECT CAST(date_trunc('month', event_date) AS DATE) AS month,
       CAST(sum(amount_vnd) AS DOUBLE) AS volume, count(*) AS num_tx FROM good GROUP BY 1""")
def report_volume_by_month(spark, sf):
    rows = reports.volume_by_month(tables.accepted_rows(spark, sf))
    return rows.select("month", *as_double("volume"), *as_long("num_tx"))


@query(f"""WITH {LEDGER_ROWS}
SELECT CASE WHEN coalesce(type, transaction_type) = 'p2p' THEN 'customer'
  WHEN coalesce(type, transaction_type) IN ('cash_in', 'cash_out') THEN 'treasury'
  ELSE 'unknown' END AS class, count(*) AS num_tx, CAST(sum(amount_vnd) AS DOUBLE) AS volume
FROM good GROUP BY 1""")
def report_by_type(spark, sf):
    form = F.coalesce("type", "transaction_type")
    rows = reports.count_by_type(tables.accepted_rows(spark, sf), form)
    return rows.select("class", *as_long("num_tx"), *as_double("volume"))


@query(f"""WITH {LEDGER_ROWS}, m AS (SELECT max(event_date) AS d FROM good),
p AS (SELECT '30' AS period, CAST(d - INTERVAL 29 DAY AS DATE) AS s FROM m
  UNION ALL SELECT '90', CAST(d - INTERVAL 89 DAY AS DATE) FROM m
  UNION ALL SELECT 'year', CAST(date_trunc('year', d) AS DATE) FROM m)
SELECT period, CAST(sum(amount_vnd) AS DOUBLE) AS total_volume, count(*) AS transaction_count,
  count(DISTINCT account_id) AS active_accounts,
  round(CAST(sum(CASE WHEN status = 'SETTLED' THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 4)
    AS success_rate
FROM p JOIN good ON event_date >= s GROUP BY period""")
def report_totals(spark, sf):
    rows = reports.totals(tables.accepted_rows(spark, sf))
    return rows.select(
        "period",
        *as_double("total_volume"),
        *as_long("transaction_count", "active_accounts"),
        F.round("success_rate", 4).alias("success_rate"),
    )


@query("""SELECT c_custkey, c_name, c_mktsegment FROM customer
WHERE contains(lower(c_name), '12') OR contains(lower(CAST(c_custkey AS VARCHAR)), '12')
   OR contains(lower(c_mktsegment), '12')""")
def customer_search(spark, sf):
    customers = tables.table(spark, sf, "customer")
    hits = ledger.search_customers(customers, "12", ("c_name", "c_custkey", "c_mktsegment"))
    return hits.select("c_custkey", "c_name", "c_mktsegment")


# ---------------------------------------------------------------- API log

_CALLS = """calls AS (SELECT CAST(ts AS DATE) AS day, ts, '/' || event_type AS endpoint,
  CAST(CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS INTEGER) AS status,
  'ACC' || user_id AS account_id, value FROM events)"""


@query(f"""WITH {_CALLS}
SELECT day, strftime(ts, {SQL_TS}) AS ts, endpoint, 'POST' AS method, status, account_id
FROM calls""")
def audit_log_append(spark, sf):
    uri = fresh_dir(spark, "api-calls")
    files.append_api_calls(tables.api_calls(spark, sf), uri)
    rows = files.read_api_calls(spark, uri)
    return rows.select("day", stamp("ts"), "endpoint", "method", "status", "account_id")


@query(f"""WITH {_CALLS}, r AS (SELECT endpoint, value,
    row_number() OVER (PARTITION BY endpoint ORDER BY value) AS rn,
    count(*) OVER (PARTITION BY endpoint) AS n FROM calls)
SELECT endpoint, round(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*), 4) AS mean,
  count(*) AS calls, max(CASE WHEN rn = greatest(CAST(floor(n * 0.95) AS BIGINT), 1)
  THEN value END) AS p95
FROM r GROUP BY endpoint""")
def latency_p95(spark, sf):
    rows = profile.latency_summary(tables.api_calls(spark, sf), ("endpoint",), "latency_ms")
    return rows.select(
        "endpoint", F.round("mean", 4).alias("mean"), *as_long("calls"), "p95"
    )
