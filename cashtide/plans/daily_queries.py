"""Queries over daily series: roll-up, merge, features, targets, KPIs, profiles."""

from pyspark.sql import functions as F

from cashtide.functions import dates
from cashtide.functions.clean import to_number
from cashtide.operators import daily as D
from cashtide.operators import features as X
from cashtide.operators import kpi, profile
from cashtide.plans.shared import (
    DAILY,
    DAILY_BY_CHANNEL,
    DATE_PARTS,
    STAGING,
    as_double,
    as_long,
)
from cashtide.schemas import DAILY as DAILY_SCHEMA
from cashtide.schemas import FEATURES_OUT
from cashtide.session import cut, fresh_dir
from cashtide.sources import files, tables

QUERIES, ORACLE = {}, {}
CHANNEL = ("channel",)


def query(sql=None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return register


def _money(*names):
    return as_double(*names)


def _rounded(*names):
    return [F.round(F.col(n).cast("double"), 4).alias(n) for n in names]


_DAILY_OUT = f"""date, CAST(cash_in AS DOUBLE) AS cash_in, CAST(cash_out AS DOUBLE) AS cash_out,
  CAST(cash_in - cash_out AS DOUBLE) AS balance, {DATE_PARTS}"""


def _daily_out(days, *extra):
    return days.select(
        "date", *_money("cash_in", "cash_out", "balance"), "day_of_week", "month", "quarter",
        *extra,
    )


# ---------------------------------------------------------------- roll-up and files


@query(f"""WITH {DAILY} SELECT {_DAILY_OUT}, transaction_count FROM daily""")
def daily_rollup(spark, sf):
    return _daily_out(tables.daily(spark, sf), *as_long("transaction_count"))


@query(f"""WITH {DAILY} SELECT CAST(sum(transaction_count) AS BIGINT) AS rows_processed,
  count(*) AS days, CAST(sum(cash_in) AS DOUBLE) AS cash_in_total,
  CAST(sum(cash_out) AS DOUBLE) AS cash_out_total FROM daily""")
def daily_rollup_stats(spark, sf):
    stats = D.roll_up_stats(tables.staging(spark, sf))
    return stats.select(
        *as_long("rows_processed", "days"), *_money("cash_in_total", "cash_out_total")
    )


@query(f"""WITH {STAGING}, c AS (SELECT date, channel, count(*) AS n FROM staging GROUP BY ALL),
w AS (SELECT channel, count(*) AS n FROM staging GROUP BY ALL),
f AS (SELECT date, arg_min(channel, tx_id) AS channel_first FROM staging GROUP BY date),
m AS (SELECT date, channel FROM c QUALIFY row_number() OVER
  (PARTITION BY date ORDER BY n DESC, channel) = 1)
SELECT date, channel_first, m.channel AS channel_mode,
  (SELECT channel FROM w ORDER BY n DESC, channel LIMIT 1) AS channel_table
FROM f JOIN m USING (date)""")
def daily_channel(spark, sf):
    """First, most common per day, and most common of the whole table."""
    rows = tables.staging(spark, sf)
    first = D.first_channel(rows)
    common = D.common_channel(rows)
    overall = D.common_channel(rows, by=()).select("channel_mode").scalar()
    both = first.join(common, "date")
    return both.withColumn("channel_table", overall)


@query(f"""WITH {STAGING} SELECT date, CAST(cash_in AS DOUBLE) AS cash_in,
  CAST(cash_out AS DOUBLE) AS cash_out, channel, {DATE_PARTS} FROM staging""")
def scan_csv_daily(spark, sf):
    """Staging rows exported as CSV and scanned again with the fixed schema."""
    uri = fresh_dir(spark, "staging-csv")
    rows = tables.staging(spark, sf).select(
        "date", *_money("cash_in", "cash_out"), "channel", *dates.date_parts("date"),
        F.lit(0.0).alias("balance"), F.col("tx_id").cast("string").alias("client_tx_id"),
    )
    files.write_csv(rows, uri)
    back = files.read_daily_csv(spark, uri)
    return back.drop("balance", "client_tx_id")


@query(f"""WITH {DAILY} SELECT {_DAILY_OUT} FROM daily ORDER BY date LIMIT 5""")
def preview_head(spark, sf):
    return files.preview(_daily_out(tables.daily(spark, sf)), ["date"], 5)


_SPLIT = "DATE '1998-01-01'"
_OVERLAP = "DATE '1997-12-02'"


def _history_and_batch(spark, sf):
    """The daily table split at 1998 with a 30-day overlap; the batch has extra columns."""
    days = tables.daily(spark, sf).withColumn("channel", F.lit("POS"))
    history = days.filter(F.col("date") < F.expr(_SPLIT)).select(*DAILY_SCHEMA.fieldNames())
    batch = X.lag_and_rolling(days, fill="zero").filter(F.col("date") >= F.expr(_OVERLAP))
    return history, batch.withColumn("channel", F.lit("ATM"))


@query(f"""WITH {DAILY} SELECT date, CAST(cash_in AS DOUBLE) AS cash_in,
  CASE WHEN date >= {_OVERLAP} THEN 'ATM' ELSE 'POS' END AS channel,
  CASE WHEN date >= {_OVERLAP} THEN transaction_count END AS transaction_count FROM daily""")
def daily_merge_replace(spark, sf):
    history, batch = _history_and_batch(spark, sf)
    merged = D.merge_replace(history, batch)
    return merged.select("date", *_money("cash_in"), "channel", *as_long("transaction_count"))


@query(f"""WITH {DAILY}, parts AS (
  SELECT date, cash_in, cash_out, 0 AS side FROM daily WHERE date < {_SPLIT}
  UNION ALL SELECT date, cash_in, cash_out, 1 FROM daily WHERE date >= {_OVERLAP}),
merged AS (SELECT date, sum(cash_in) AS cash_in, sum(cash_out) AS cash_out,
  CASE WHEN min(side) = 0 THEN 'POS' ELSE 'ATM' END AS channel FROM parts GROUP BY date)
SELECT {_DAILY_OUT}, channel FROM merged""")
def daily_merge_additive(spark, sf):
    history, batch = _history_and_batch(spark, sf)
    return _daily_out(D.merge_additive(history, batch), "channel")


@query(f"""WITH {DAILY} SELECT date, CAST(cash_in AS DOUBLE) AS cash_in, 'POS' AS channel,
  CAST(NULL AS BIGINT) AS transaction_count FROM daily WHERE date < {_SPLIT}
UNION ALL SELECT date, CAST(cash_in AS DOUBLE), 'ATM', transaction_count FROM daily
  WHERE date >= {_OVERLAP}""")
def union_evolving_schema(spark, sf):
    rows = D.union_evolving(*_history_and_batch(spark, sf))
    return rows.select("date", *_money("cash_in"), "channel", *as_long("transaction_count"))


@query(f"""WITH {DAILY} SELECT date, CAST(cash_in AS DOUBLE) AS cash_in,
  CAST(CASE WHEN date >= {_SPLIT} THEN 2 * cash_out ELSE cash_out END AS DOUBLE) AS cash_out
FROM daily""")
def daily_sink_roundtrip(spark, sf):
    """Whole table written by month, then the months from 1998 on written again."""
    uri = fresh_dir(spark, "daily")
    days = tables.daily(spark, sf).select("date", "cash_in", "cash_out")
    files.write_daily(days, uri)
    later = days.filter(F.col("date") >= F.expr(_SPLIT))
    files.write_daily(later.withColumn("cash_out", _twice("cash_out")), uri)
    return files.read_daily(spark, uri).select("date", *_money("cash_in", "cash_out"))


def _twice(name):
    return (F.col(name) * 2).cast("decimal(38,2)")


# ---------------------------------------------------------------- calendar


@query(f"""WITH {STAGING} SELECT tx_id, date, {DATE_PARTS} FROM staging""")
def calendar_parts(spark, sf):
    return tables.staging(spark, sf).select("tx_id", "date", *dates.date_parts("date"))


@query(f"""WITH {STAGING} SELECT tx_id,
  CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS is_weekend,
  CASE WHEN date = last_day(date) THEN 1 ELSE 0 END AS is_month_end,
  CASE WHEN day(date) = 15 OR date = last_day(date) THEN 1 ELSE 0 END AS is_payday,
  CASE WHEN day(date) >= 25 THEN 1 ELSE 0 END AS serving_month_end,
  CASE WHEN day(date) = 15 OR day(date) >= 25 THEN 1 ELSE 0 END AS serving_payday,
  CASE WHEN day(date) <= 5 THEN 1 ELSE 0 END AS is_month_start,
  CASE WHEN day(date) = 15 OR day(date) >= 25 THEN 1 ELSE 0 END AS is_fixed_payday
FROM staging""")
def calendar_flags(spark, sf):
    return tables.staging(spark, sf).select(
        "tx_id",
        dates.is_weekend("date").alias("is_weekend"),
        dates.is_month_end("date").alias("is_month_end"),
        dates.is_payday("date").alias("is_payday"),
        dates.is_month_end_serving("date").alias("serving_month_end"),
        dates.is_payday_serving("date").alias("serving_payday"),
        dates.is_month_start("date").alias("is_month_start"),
        dates.is_fixed_payday("date").alias("is_fixed_payday"),
    )


# ---------------------------------------------------------------- features and targets

_LAGS = ("lag1_in", "lag7_in", "lag1_out", "lag7_out")
_MEANS7 = ("roll_mean_7_in", "roll_mean_7_out")
_MEANS30 = ("roll_mean_30_in", "roll_mean_30_out")


def _lag_sql(fill="NULL"):
    parts = []
    for tag, column in X.DIRECTIONS:
        for k in (1, 7):
            parts.append(
                f"CAST(lag({column}, {k}) OVER w AS DOUBLE) AS lag{k}_{tag}"
                if fill == "NULL"
                else f"coalesce(CAST(lag({column}, {k}) OVER w AS DOUBLE), {fill}) AS lag{k}_{tag}"
            )
    return ", ".join(parts)


def _mean_sql(*sizes, digits=4):
    frame = "(PARTITION BY {p} ORDER BY date ROWS BETWEEN {k} PRECEDING AND CURRENT ROW)"
    parts = []
    for size in sizes:
        for tag, column in X.DIRECTIONS:
            over = frame.format(p="channel", k=size - 1)
            mean = f"CAST(sum({column}) OVER {over} AS DOUBLE) / count(*) OVER {over}"
            mean = mean if digits is None else f"round({mean}, {digits})"
            parts.append(f"{mean} AS roll_mean_{size}_{tag}")
    return ", ".join(parts)


@query(f"""WITH {DAILY_BY_CHANNEL} SELECT channel, date, CAST(cash_in AS DOUBLE) AS cash_in,
  CAST(cash_out AS DOUBLE) AS cash_out, CAST(cash_in - cash_out AS DOUBLE) AS cash_net_d0,
  {_lag_sql("0.0")}, {_mean_sql(7, 30)}
FROM daily WINDOW w AS (PARTITION BY channel ORDER BY date)""")
def daily_features(spark, sf):
    days = tables.daily(spark, sf, CHANNEL)
    wide = X.lag_and_rolling(days, CHANNEL, fill="zero")
    net = (F.col("cash_in") - F.col("cash_out")).cast("double").alias("cash_net_d0")
    return wide.select(
        "channel", "date", *_money("cash_in", "cash_out"), net, *_LAGS,
        *_rounded(*_MEANS7, *_MEANS30),
    )


def backfilled_sql(daily, digits=4):
    return f"""{daily},
wide AS (SELECT channel, date, cash_in, cash_out, {_lag_sql()}, {_mean_sql(7, digits=digits)}
  FROM daily WINDOW w AS (PARTITION BY channel ORDER BY date)),
firsts AS (SELECT channel, arg_min(cash_in, date) AS first_in, arg_min(cash_out, date) AS first_out,
  count(*) AS n FROM daily GROUP BY channel),
feat AS (SELECT w.channel, date, CAST(cash_in AS DOUBLE) AS cash_in_d0,
  CAST(cash_out AS DOUBLE) AS cash_out_d0, CAST(cash_in - cash_out AS DOUBLE) AS cash_net_d0,
  coalesce(lag1_in, CASE WHEN n > 1 THEN CAST(first_in AS DOUBLE) END, CAST(cash_in AS DOUBLE))
    AS lag1_in,
  coalesce(lag7_in, CASE WHEN n > 7 THEN CAST(first_in AS DOUBLE) END, CAST(cash_in AS DOUBLE))
    AS lag7_in,
  coalesce(lag1_out, CASE WHEN n > 1 THEN CAST(first_out AS DOUBLE) END,
    CAST(cash_out AS DOUBLE)) AS lag1_out,
  coalesce(lag7_out, CASE WHEN n > 7 THEN CAST(first_out AS DOUBLE) END,
    CAST(cash_out AS DOUBLE)) AS lag7_out,
  roll_mean_7_in, roll_mean_7_out, CAST(isodow(date) - 1 AS INTEGER) AS dow,
  CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS is_weekend,
  CASE WHEN date = last_day(date) THEN 1 ELSE 0 END AS is_month_end,
  CASE WHEN day(date) = 15 OR date = last_day(date) THEN 1 ELSE 0 END AS is_payday
FROM wide w JOIN firsts USING (channel))"""


_BACKFILLED = backfilled_sql(DAILY_BY_CHANNEL)


@query(f"WITH {_BACKFILLED} SELECT channel, date, lag1_in, lag7_in, lag1_out, lag7_out FROM feat")
def lag_backfill(spark, sf):
    wide = X.lag_and_rolling(tables.daily(spark, sf, CHANNEL), CHANNEL, (7,), fill="backfill")
    return wide.select("channel", "date", *_LAGS)


def target_sql(strict):
    parts = []
    for _, column in X.DIRECTIONS:
        parts.append(f"CAST(lead({column}) OVER w AS DOUBLE) AS {column}_next_day")
        for suffix, k in X.HORIZONS:
            over = (
                "(PARTITION BY channel ORDER BY date "
                f"ROWS BETWEEN 1 FOLLOWING AND {k} FOLLOWING)"
            )
            total = f"CAST(sum({column}) OVER {over} AS DOUBLE)"
            if strict:
                total = f"CASE WHEN count(*) OVER {over} = {k} THEN {total} END"
            parts.append(f"{total} AS {column}_{suffix}")
    return ", ".join(parts)


def _targets(spark, sf, strict):
    days = X.forward_targets(tables.daily(spark, sf, CHANNEL), CHANNEL, strict)
    return days.select("channel", "date", *X.TARGETS)


@query(f"""WITH {DAILY_BY_CHANNEL} SELECT channel, date, {target_sql(False)} FROM daily
WINDOW w AS (PARTITION BY channel ORDER BY date)""")
def forward_targets(spark, sf):
    return _targets(spark, sf, strict=False)


@query(f"""WITH {DAILY_BY_CHANNEL} SELECT channel, date, {target_sql(True)} FROM daily
WINDOW w AS (PARTITION BY channel ORDER BY date)""")
def forward_targets_strict(spark, sf):
    return _targets(spark, sf, strict=True)


@query(f"""WITH {DAILY_BY_CHANNEL}, m AS (
  SELECT channel, CAST(date_trunc('month', date) AS DATE) AS mon, sum(cash_in) AS ci,
    sum(cash_out) AS co FROM daily GROUP BY 1, 2)
SELECT d.channel, d.date, CAST(ci AS DOUBLE) AS cash_in_calendar_month,
  CAST(co AS DOUBLE) AS cash_out_calendar_month
FROM daily d LEFT JOIN m ON m.channel = d.channel
  AND m.mon = CAST(date_trunc('month', d.date) + INTERVAL 1 MONTH AS DATE)""")
def target_calendar_month(spark, sf):
    rows = X.target_calendar_month(tables.daily(spark, sf, CHANNEL), CHANNEL)
    return rows.select("channel", "date", "cash_in_calendar_month", "cash_out_calendar_month")


_SPINE = f"""{DAILY_BY_CHANNEL},
span AS (SELECT channel, min(date) AS lo, max(date) AS hi FROM daily GROUP BY channel),
spine AS (SELECT channel, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date
  FROM span),
days AS (SELECT s.channel, s.date, coalesce(cash_in, 0) AS cash_in,
  coalesce(cash_out, 0) AS cash_out, CASE WHEN d.date IS NULL THEN 1 ELSE 0 END AS gap
  FROM spine s LEFT JOIN daily d ON d.channel = s.channel AND d.date = s.date),
filled AS (SELECT channel, date, gap, CAST(lag(cash_in, 7) OVER w AS DOUBLE) AS spine_lag7_in,
  CAST(lag(cash_out, 7) OVER w AS DOUBLE) AS spine_lag7_out
  FROM days WINDOW w AS (PARTITION BY channel ORDER BY date))"""


@query(f"""WITH {_SPINE}, exact AS (SELECT a.channel, a.date,
    CAST(max(b.cash_in) AS DOUBLE) AS lag7_in, CAST(max(b.cash_out) AS DOUBLE) AS lag7_out
  FROM daily a LEFT JOIN daily b ON b.channel = a.channel AND b.date = a.date - 7 GROUP BY 1, 2),
week AS (SELECT a.channel, a.date,
    round(CAST(sum(b.cash_in) AS DOUBLE) / 7, 4) AS mean_7d_in,
    round(CAST(sum(b.cash_out) AS DOUBLE) / 7, 4) AS mean_7d_out
  FROM daily a JOIN daily b ON b.channel = a.channel AND b.date BETWEEN a.date - 6 AND a.date
  GROUP BY 1, 2)
SELECT f.channel, f.date, f.gap, f.spine_lag7_in, f.spine_lag7_out, e.lag7_in, e.lag7_out,
  w.mean_7d_in, w.mean_7d_out
FROM filled f LEFT JOIN exact e ON e.channel = f.channel AND e.date = f.date
  LEFT JOIN week w ON w.channel = f.channel AND w.date = f.date""")
def date_spine_features(spark, sf):
    """Row-based lags on the gap-free spine next to calendar lags on the gappy series."""
    days = tables.daily(spark, sf, CHANNEL)
    spine = X.date_spine(days, CHANNEL)
    gap = F.col("transaction_count").isNull().cast("int").alias("gap")
    filled = X.lag_and_rolling(spine, CHANNEL, means=(7,)).select(
        "channel", "date", gap, F.col("lag7_in").alias("spine_lag7_in"),
        F.col("lag7_out").alias("spine_lag7_out"),
    )
    exact = X.calendar_exact(days, CHANNEL).select(
        "channel", "date", "lag7_in", "lag7_out", *_rounded("mean_7d_in", "mean_7d_out")
    )
    return filled.join(exact, ["channel", "date"], "left")


@query(f"""WITH {DAILY_BY_CHANNEL} SELECT channel, date,
  CAST(sum(cash_in - cash_out) OVER (PARTITION BY channel ORDER BY date) AS DOUBLE)
    AS running_balance FROM daily""")
def running_balance(spark, sf):
    rows = X.running_balance(tables.daily(spark, sf, CHANNEL), CHANNEL)
    return rows.select("channel", "date", *_money("running_balance"))


@query(f"""WITH {DAILY_BY_CHANNEL}, m AS (
  SELECT channel, CAST(date_trunc('month', date) AS DATE) AS month,
    CAST(sum(cash_in) AS DOUBLE) AS volume FROM daily GROUP BY 1, 2),
p AS (SELECT *, lag(volume) OVER (PARTITION BY channel ORDER BY month) AS previous FROM m)
SELECT channel, month, volume, previous,
  CASE WHEN previous <> 0 THEN round((volume - previous) / previous, 4) END AS change FROM p""")
def period_change(spark, sf):
    months = (
        tables.daily(spark, sf, CHANNEL)
        .groupBy("channel", F.trunc("date", "MM").alias("month"))
        .agg(F.sum("cash_in").cast("double").alias("volume"))
    )
    rows = X.period_change(months, "volume", "month", CHANNEL)
    return rows.withColumn("change", F.round("change", 4))


_FEATURE_NUMBERS = ("cash_in_d0", "cash_out_d0", "cash_net_d0", *_LAGS)
_FLAGS = ("dow", "is_weekend", "is_month_end", "is_payday")


@query(f"""WITH {_BACKFILLED}, tgt AS (SELECT channel, date, {target_sql(True)} FROM daily
  WINDOW w AS (PARTITION BY channel ORDER BY date))
SELECT f.*, {", ".join(f"t.{n}" for n in X.TARGETS)} FROM feat f JOIN tgt t USING (channel, date)
WHERE t.cash_out_h7_sum IS NOT NULL""")
def training_set(spark, sf):
    rows = X.training_set(tables.daily(spark, sf, CHANNEL), CHANNEL)
    complete = X.drop_incomplete(rows, FEATURES_OUT, "cash_out_h7_sum")
    return complete.select(
        "channel", "date", *_FEATURE_NUMBERS, *_rounded(*_MEANS7), *_FLAGS, *X.TARGETS
    )


@query(f"""WITH {_BACKFILLED} SELECT cash_in_d0, cash_out_d0, cash_net_d0, lag1_out, lag7_out,
  roll_mean_7_out, CAST(dow AS DOUBLE) AS dow, CAST(is_weekend AS DOUBLE) AS is_weekend,
  CAST(is_month_end AS DOUBLE) AS is_month_end, CAST(NULL AS DOUBLE) AS is_payday, channel
FROM feat""")
def feature_projection(spark, sf):
    """Cash-out features in order, one of them absent, others ignored; VND rows only."""
    rows = X.feature_frame(tables.daily(spark, sf, CHANNEL), CHANNEL).drop("is_payday")
    rows = X.require_vnd(rows.withColumn("currency", F.lit("vnd")))
    wide = X.project_features(rows, FEATURES_OUT)
    return wide.withColumn("roll_mean_7_out", F.round("roll_mean_7_out", 4))


@query(f"""WITH {_BACKFILLED}, z AS (SELECT channel, date, {_lag_sql("0.0")},
    row_number() OVER (PARTITION BY channel ORDER BY date DESC) AS rn,
    count(*) OVER (PARTITION BY channel) AS data_points
  FROM daily WINDOW w AS (PARTITION BY channel ORDER BY date))
SELECT f.channel, f.date, data_points, cash_in_d0, cash_out_d0, cash_net_d0, z.lag1_in, z.lag7_in,
  z.lag1_out, z.lag7_out, roll_mean_7_in, roll_mean_7_out, dow, is_weekend,
  CASE WHEN day(f.date) >= 25 THEN 1 ELSE 0 END AS is_month_end,
  CASE WHEN day(f.date) = 15 OR day(f.date) >= 25 THEN 1 ELSE 0 END AS is_payday
FROM feat f JOIN z ON z.channel = f.channel AND z.date = f.date
WHERE rn = 1 AND data_points >= 7""")
def latest_features(spark, sf):
    rows = X.latest_features(tables.daily(spark, sf, CHANNEL), CHANNEL)
    return rows.select(
        "channel", "date", *as_long("data_points"), *_FEATURE_NUMBERS, *_rounded(*_MEANS7), *_FLAGS
    )


# ---------------------------------------------------------------- quality, profile, metrics


@query(f"""WITH {DAILY_BY_CHANNEL} SELECT channel, count(*) AS rows,
  CAST(max(date) - min(date) + 1 - count(*) AS BIGINT) AS missing_dates,
  CAST(0 AS BIGINT) AS null_rows,
  CAST(sum(CASE WHEN cash_in - cash_out < -250000 THEN 1 ELSE 0 END) AS BIGINT) AS negative_rows,
  CASE WHEN count(*) >= 30 THEN 1 ELSE 0 END AS enough_next_day,
  CASE WHEN count(*) >= 40 THEN 1 ELSE 0 END AS enough_h7,
  CASE WHEN count(*) >= 90 THEN 1 ELSE 0 END AS enough_next_month
FROM daily GROUP BY channel""")
def dq_report(spark, sf):
    """Report on series whose net flow, shifted by 250,000, plays the cash-in column."""
    days = tables.daily(spark, sf, CHANNEL)
    shifted = days.withColumn("cash_in", F.col("balance") + 250000)
    rows = profile.quality_report(shifted, CHANNEL)
    return rows.select(
        "channel",
        *as_long("rows", "missing_dates", "null_rows", "negative_rows"),
        "enough_next_day", "enough_h7", "enough_next_month",
    )


@query(f"""WITH {DAILY}, s AS (SELECT count(*) AS rows, min(date) AS date_min,
  max(date) AS date_max FROM daily)
SELECT s.*, 'cash_in' AS "column", (SELECT CAST(min(cash_in) AS DOUBLE) FROM daily) AS min,
  (SELECT CAST(max(cash_in) AS DOUBLE) FROM daily) AS max,
  (SELECT round(CAST(sum(cash_in) AS DOUBLE) / count(*), 4) FROM daily) AS mean FROM s
UNION ALL SELECT s.*, 'cash_out', (SELECT CAST(min(cash_out) AS DOUBLE) FROM daily),
  (SELECT CAST(max(cash_out) AS DOUBLE) FROM daily),
  (SELECT round(CAST(sum(cash_out) AS DOUBLE) / count(*), 4) FROM daily) FROM s""")
def dataset_profile(spark, sf):
    rows = profile.dataset_profile(tables.daily(spark, sf), "date", ("cash_in", "cash_out"))
    return rows.withColumn("mean", F.round("mean", 4))


@query(f"WITH {STAGING} SELECT channel, count(*) AS n FROM staging GROUP BY channel")
def channel_counts(spark, sf):
    return profile.value_counts(tables.staging(spark, sf), "channel")


@query(f"""WITH {DAILY_BY_CHANNEL}, p AS (SELECT channel, CAST(cash_in AS DOUBLE) AS y,
    CAST(lag(cash_in) OVER (PARTITION BY channel ORDER BY date) AS DOUBLE) AS yhat FROM daily),
m AS (SELECT channel, count(*) AS n, avg((y - yhat) * (y - yhat)) AS mse, avg(abs(y - yhat)) AS mae,
  var_pop(y) AS v FROM p WHERE yhat IS NOT NULL GROUP BY channel)
SELECT channel, n, round(sqrt(mse), 4) AS rmse, round(1 - mse / v, 4) AS r2,
  round(mae, 4) AS mae FROM m""")
def regression_metrics(spark, sf):
    """Yesterday's cash-in as the prediction of today's."""
    wide = X.lag_and_rolling(tables.daily(spark, sf, CHANNEL), CHANNEL, means=())
    scored = wide.select(
        "channel", to_number("cash_in").alias("y"), F.col("lag1_in").alias("prediction")
    ).dropna()
    rows = profile.regression_metrics(scored, CHANNEL)
    return rows.select("channel", *as_long("n"), *_rounded("rmse", "r2", "mae"))


# ---------------------------------------------------------------- KPIs


def _kpis(spark, sf):
    """KPI rows written twice: the second write is one higher and a day later."""
    first = kpi.daily_kpis(tables.daily(spark, sf))
    later = first.withColumns(
        {
            "value": F.col("value") + 1,
            "updated_at": F.col("updated_at") + F.expr("INTERVAL 1 DAY"),
        }
    )
    return kpi.upsert(first, later)


_KPI = f"""{DAILY}, k AS (SELECT date AS event_date, 'cash_in' AS metric,
    CAST(cash_in AS DOUBLE) + 1 AS value FROM daily
  UNION ALL SELECT date, 'cash_out', CAST(cash_out AS DOUBLE) + 1 FROM daily
  UNION ALL SELECT date, 'num_tx', CAST(transaction_count AS DOUBLE) + 1 FROM daily)"""


@query(f"""WITH {_KPI} SELECT *, strftime(event_date + INTERVAL 1 DAY, '%Y-%m-%d') AS updated_at
FROM k""")
def kpi_upsert(spark, sf):
    rows = _kpis(spark, sf)
    return rows.withColumn("updated_at", F.date_format("updated_at", "yyyy-MM-dd"))


@query(f"""WITH {_KPI} SELECT 'range' AS kind, * FROM k
  WHERE event_date BETWEEN DATE '1997-01-01' AND DATE '1997-03-31'
UNION ALL SELECT 'day', * FROM k WHERE event_date = DATE '1997-05-05'
UNION ALL SELECT 'point', * FROM k WHERE event_date = DATE '1997-05-05' AND metric = 'num_tx'""")
def kpi_get_list(spark, sf):
    import datetime

    day = datetime.date(1997, 5, 5)
    kpis = cut(_kpis(spark, sf), "kpis")
    months = kpi.between(kpis, datetime.date(1997, 1, 1), datetime.date(1997, 3, 31))
    parts = {"range": months, "day": kpi.get(kpis, day), "point": kpi.get(kpis, day, "num_tx")}
    named = [part.withColumn("kind", F.lit(name)) for name, part in parts.items()]
    rows = D.union_evolving(*named)
    return rows.select("kind", "event_date", "metric", "value")
