"""Daily tables, features and order statistics on small frames, against pandas."""

import datetime
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cashtide.operators import daily as D
from cashtide.operators import features as X
from cashtide.operators import kpi, profile, ranks
from cashtide.session import fresh_dir
from cashtide.sources import files

START = datetime.date(2023, 1, 1)


def series(spark, values, outs=None, step=1):
    outs = outs or [float(i) for i in range(len(values))]
    rows = [
        (START + datetime.timedelta(days=step * i), v, o, "POS")
        for i, (v, o) in enumerate(zip(values, outs, strict=True))
    ]
    return spark.createDataFrame(rows, "date date, cash_in double, cash_out double, channel string")


def test_row_features_match_pandas(spark):
    rng = random.Random(1)
    values = [round(rng.uniform(0, 100), 2) for _ in range(45)]
    got = X.lag_and_rolling(series(spark, values)).orderBy("date").toPandas()
    s = pd.Series(values)
    np.testing.assert_allclose(got["lag7_in"], s.shift(7))
    np.testing.assert_allclose(got["roll_mean_7_in"], s.rolling(7, min_periods=1).mean())
    np.testing.assert_allclose(got["roll_mean_30_in"], s.rolling(30, min_periods=1).mean())
    strict = X.forward_targets(series(spark, values), strict=True).orderBy("date").toPandas()
    expected = s.rolling(30, min_periods=1).sum().shift(-30)
    np.testing.assert_allclose(strict["cash_in_next_month_sum"], expected)
    assert strict["cash_in_h7_sum"].isna().sum() == 7
    partial = X.forward_targets(series(spark, values)).orderBy("date").toPandas()
    assert partial["cash_in_h7_sum"].isna().sum() == 1


def test_backfill_takes_the_next_known_value(spark):
    got = X.lag_and_rolling(series(spark, [5.0, None, 7.0]), fill="backfill").orderBy("date")
    rows = got.collect()
    assert [r.lag1_in for r in rows] == [5.0, 5.0, 7.0]
    assert [r.lag7_in for r in rows] == [5.0, 0.0, 7.0]


def test_latest_features_need_history(spark):
    assert X.latest_features(series(spark, [1.0] * 6)).count() == 0
    row = X.latest_features(series(spark, [float(i) for i in range(8)])).first()
    assert (row.lag1_in, row.lag7_in, row.roll_mean_7_in) == (6.0, 0.0, 4.0)
    row = X.latest_features(series(spark, [float(i) for i in range(7)])).first()
    assert row.lag7_in == 0.0 and row.data_points == 7


def test_calendar_features_skip_gaps(spark):
    gappy = series(spark, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0], step=7)
    exact = X.calendar_exact(gappy).orderBy("date").collect()
    assert [r.lag7_in for r in exact][:3] == [None, 1.0, 2.0]
    assert exact[1].mean_7d_in == pytest.approx(2 / 7)
    spine = X.date_spine(gappy)
    assert spine.count() == 50 and spine.agg(F.sum("cash_in")).first()[0] == 36.0


def test_merge_rules(spark):
    old = series(spark, [1.0, 2.0, 3.0])
    new = series(spark, [10.0, 20.0, 30.0, 40.0]).filter(F.col("date") > START)
    new = new.withColumn("channel", F.lit("ATM"))
    added = D.merge_additive(old, new).orderBy("date").collect()
    assert [float(r.cash_in) for r in added] == [1, 22, 33, 40]
    assert [r.channel for r in added] == ["POS", "POS", "POS", "ATM"]
    replaced = D.merge_replace(old, new.withColumn("extra", F.lit(1))).orderBy("date").collect()
    assert [r.cash_in for r in replaced] == [1, 20, 30, 40]
    assert [r.extra for r in replaced] == [None, 1, 1, 1]


def test_null_dates_and_all_null_sums(spark):
    rows = spark.createDataFrame(
        [(None, 1.0, 1.0), (START, None, None)], "date date, cash_in double, cash_out double"
    )
    day = D.roll_up(rows).collect()
    assert [(float(r.cash_in), float(r.cash_out)) for r in day] == [(0.0, 0.0)]


def test_daily_sink_replaces_only_what_it_is_given(spark):
    uri = fresh_dir(spark, "daily")
    days = series(spark, [float(i) for i in range(60)])
    files.write_daily(days, uri)
    files.write_daily(
        days.filter(F.month("date") == 2).withColumn("cash_in", F.lit(0.0)), uri
    )
    back = files.read_daily(spark, uri)
    assert back.count() == 60
    assert back.filter("cash_in = 0").count() == 28 + 1
    # A batch with one day of a month leaves the month's other days as they are.
    files.write_daily(days.limit(1).withColumn("cash_in", F.lit(-5.0)), uri)
    back = files.read_daily(spark, uri)
    assert back.count() == 60 and back.filter("cash_in = -5").count() == 1


def test_kpi_last_write_wins(spark):
    t = datetime.datetime(2024, 1, 1)
    schema = "event_date date, metric string, value double, updated_at timestamp"
    old = spark.createDataFrame([(START, "a", 1.0, t), (START, "b", 1.0, t)], schema)
    new = spark.createDataFrame([(START, "a", 0.5, t + datetime.timedelta(hours=1))], schema)
    got = {r.metric: r.value for r in kpi.upsert(old, new).collect()}
    assert got == {"a": 0.5, "b": 1.0}


def test_running_totals(spark):
    rng = random.Random(2)
    data = [
        (g, round(rng.gauss(0, 50), 1)) for g, n in (("hot", 3000), ("b", 7), ("c", 1))
        for _ in range(n)
    ]
    df = spark.createDataFrame(data, "g string, v double")
    counted = df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    got = ranks.running_totals(counted, ["g"], "v")
    got = got.withColumn("next_value", F.col("next.v")).drop("next").toPandas()
    for g, part in got.groupby("g"):
        part = part.sort_values("v")
        np.testing.assert_array_equal(part["cum_n"], part["n"].cumsum())
        assert set(part["total_n"]) == {sum(1 for x in data if x[0] == g)}
        np.testing.assert_array_equal(part["next_value"][:-1], part["v"][1:])
        assert np.isnan(part["next_value"].astype(float).iloc[-1])


def test_bands_follow_the_values(spark):
    """Values lying close together are spread over many bands all the same."""
    for scale, base in ((1e-2, 1000.0), (1e-6, 0.0), (10.0, 1e6)):
        df = spark.range(1000).select(
            F.lit("g").alias("g"), (F.col("id") * scale + base).alias("v"), F.lit(1).alias("n")
        )
        bands = ranks.with_bands(df, ["g"], "v").groupBy("_band").count().collect()
        assert len(bands) > 200 and max(r["count"] for r in bands) < 20


def test_nearest_rank_is_exact(spark):
    rng = random.Random(3)
    data = [("x", rng.expovariate(0.01)) for _ in range(997)] + [("y", 5.0)]
    got = {
        r.g: r.v
        for r in ranks.nearest_rank(
            spark.createDataFrame(data, "g string, v double"), ["g"], "v", 0.95
        ).collect()
    }
    ordered = sorted(v for g, v in data if g == "x")
    assert got == {"x": ordered[int(0.95 * 997) - 1], "y": 5.0}


def test_metrics_against_numpy(spark):
    rng = np.random.default_rng(4)
    y, p = rng.normal(1e7, 1e3, 200), rng.normal(1e7, 1e3, 200)
    pairs = zip(y.tolist(), p.tolist(), strict=True)
    df = spark.createDataFrame([("m", a, b) for a, b in pairs], "m string, y double, p double")
    row = profile.regression_metrics(df, ["m"], "y", "p").first()
    assert row.rmse == pytest.approx(np.sqrt(np.mean((y - p) ** 2)), rel=1e-9)
    assert row.r2 == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum(), rel=1e-9)
    assert row.mae == pytest.approx(np.abs(y - p).mean(), rel=1e-9)


def test_foreign_currency_is_refused_for_scoring(spark):
    rows = spark.createDataFrame([("usd",)], "currency string")
    with pytest.raises(Exception, match="currency not supported"):
        X.require_vnd(rows).collect()


def test_windows_are_partitioned_by_series(spark):
    days = series(spark, [1.0, 2.0])
    plan = X.lag_and_rolling(days, ("channel",))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(channel" in plan and "SinglePartition" not in plan


def test_a_batch_that_repeats_a_date_counts_once(spark):
    schema = "date date, cash_in double, cash_out double, transaction_count long"
    history = spark.createDataFrame([(START, 1.0, 1.0, 1)], schema)
    batch = spark.createDataFrame([(START, 5.0, 2.0, 3), (START, 4.0, 2.0, 9)], schema)
    assert [r.cash_in for r in D.merge_replace(history, batch).collect()] == [4.0]
