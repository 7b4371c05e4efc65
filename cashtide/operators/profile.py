"""Profiles, counts, quality report, nearest-rank latency and regression metrics."""

from pyspark.sql import functions as F

from cashtide import session
from cashtide.operators.ranks import counted_values, rank_of_counted


def dataset_profile(df, day, numeric):
    """Long form: one row per numeric column with min, max, mean; dates and rows repeated."""
    stats = [F.count(F.lit(1)).alias("rows"), F.min(day).alias("d0"), F.max(day).alias("d1")]
    for name in numeric:
        column = F.col(name)
        stats += [
            F.min(column).cast("double").alias(f"{name}__min"),
            F.max(column).cast("double").alias(f"{name}__max"),
            (F.sum(column).cast("double") / F.count(column)).alias(f"{name}__mean"),
        ]
    entries = F.array(
        *[
            F.struct(
                F.lit(name).alias("column"),
                F.col(f"{name}__min").alias("min"),
                F.col(f"{name}__max").alias("max"),
                F.col(f"{name}__mean").alias("mean"),
            )
            for name in numeric
        ]
    )
    return df.agg(*stats).select(
        "rows", F.col("d0").alias("date_min"), F.col("d1").alias("date_max"), F.inline(entries)
    )


def value_counts(df, column):
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def latency_summary(calls, group, value):
    """Exact mean and nearest-rank p95 per group."""
    counted = session.cut(counted_values(calls, group, value), "latency-values")
    known = counted.filter(F.col(value).isNotNull())
    p95 = rank_of_counted(known, group, value, 0.95).withColumnRenamed(value, "p95")
    weighted = F.sum(F.col(value) * F.col("n"))
    mean = counted.groupBy(*group).agg(
        (weighted / F.sum(F.when(F.col(value).isNotNull(), F.col("n")))).alias("mean"),
        F.sum("n").alias("calls"),
    )
    return mean.join(p95, list(group))


def regression_metrics(scored, keys, y="y", prediction="prediction"):
    """rmse, r2 and mae per model.

    The total sum of squares uses the centred variance aggregate, which stays accurate
    for values far from zero.
    """
    error = F.col(y) - F.col(prediction)
    sums = scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(error * error).alias("_mse"),
        F.avg(F.abs(error)).alias("mae"),
        F.var_pop(y).alias("_var"),
    )
    perfect = F.when(F.col("_mse") == 0, 1.0).otherwise(0.0)
    return sums.select(
        *keys,
        "n",
        F.sqrt("_mse").alias("rmse"),
        F.when(F.col("_var") > 0, 1 - F.col("_mse") / F.col("_var"))
        .otherwise(perfect)
        .alias("r2"),
        "mae",
    )


# Rows a series needs before each group of targets can be trained.
MINIMUM_ROWS = {"next_day": 30, "h7": 40, "next_month": 90}


def quality_report(daily, series_keys=()):
    """Rows, missing dates, nulls and negative amounts per series, and which targets fit."""
    missing = F.col("cash_in").isNull() | F.col("cash_out").isNull()
    negative = (F.col("cash_in") < 0) | (F.col("cash_out") < 0)
    report = daily.groupBy(*series_keys).agg(
        F.count(F.lit(1)).alias("rows"),
        (F.datediff(F.max("date"), F.min("date")) + 1 - F.count_distinct("date"))
        .cast("bigint")
        .alias("missing_dates"),
        F.count_if(missing).alias("null_rows"),
        F.count_if(negative).alias("negative_rows"),
    )
    enough = {
        f"enough_{name}": (F.col("rows") >= rows).cast("int")
        for name, rows in MINIMUM_ROWS.items()
    }
    return report.withColumns(enough)
