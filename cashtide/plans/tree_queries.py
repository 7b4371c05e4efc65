"""Queries over model trees: preparation, split search, training, scoring, explanation."""

from pyspark.sql import functions as F

from cashtide.functions import dates
from cashtide.modeltree import prep as P
from cashtide.modeltree import split as S
from cashtide.modeltree import train as T
from cashtide.modeltree.grow import grow
from cashtide.modeltree.params import TreeParams
from cashtide.operators import daily as D
from cashtide.operators import features as X
from cashtide.plans import tree_sql as Q
from cashtide.plans.shared import as_long
from cashtide.schemas import TARGETS, numeric_features_for
from cashtide.session import cut, fresh_dir
from cashtide.sources import files, tables

QUERIES, ORACLE = {}, {}
PARAMS = TreeParams()


def query(sql=None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return register


# Weekday and pay-day factors of the seasonal profile.
WEEKEND_FACTOR = 0.2
PAYDAY_FACTOR = 1.5


def seasonal_fixture(daily):
    """A daily table scaled by a weekday / pay-day pattern, so that trees have something to split."""
    weekend, payday = (F.lit(f).cast("decimal(3,2)") for f in (WEEKEND_FACTOR, PAYDAY_FACTOR))
    one = F.lit(1).cast("decimal(3,2)")
    factor = F.when(F.weekday("date") >= 5, weekend).otherwise(one)
    factor = factor * F.when(dates.is_fixed_payday("date") == 1, payday).otherwise(one)
    return daily.withColumns(
        {c: (F.col(c).cast("decimal(28,2)") * factor).cast("decimal(38,2)")
         for c in ("cash_in", "cash_out")}
    )


def series(spark, sf, seasonal=False):
    """The daily series of the whole table with each day's most common channel."""
    rows = tables.staging(spark, sf)
    days = D.roll_up(rows)
    days = seasonal_fixture(days) if seasonal else days
    return days.join(D.common_channel(rows), "date").withColumnRenamed("channel_mode", "channel")


def training(spark, sf, seasonal=False):
    return X.training_set(series(spark, sf, seasonal))


# ---------------------------------------------------------------- oracle pieces

_SERIES, _per_target = Q.SERIES, Q.per_target
_LONG = f"{_SERIES}, long AS ({_per_target(Q.long_features)})"


# ---------------------------------------------------------------- preparation


def _mapping_sql(target):
    numerics = " UNION ALL ".join(
        f"SELECT '{target}' AS model_id, {i} AS feature, '{name}' AS name"
        for i, name in enumerate(numeric_features_for(target))
    )
    width = len(numeric_features_for(target))
    return (
        f"{numerics} UNION ALL SELECT '{target}', CAST({width} - 1 + "
        f"row_number() OVER (ORDER BY c) AS INTEGER), 'channel_' || c FROM (SELECT DISTINCT "
        f"channel_mode AS c FROM full_rows WHERE {target} IS NOT NULL)"
    )


@query(f"WITH {_SERIES} {_per_target(_mapping_sql)}")
def feature_mapping(spark, sf):
    rows = P.training_rows(training(spark, sf))
    return P.feature_names(P.fit(rows), P.channels(rows))


_GAPS = """, gappy AS (SELECT model_id, date, feature,
    CASE WHEN day(date) % 9 <> 0 THEN value END AS value FROM long),
stats AS (SELECT model_id, feature, avg(value) AS mean, sqrt(sum((value - m) * (value - m))
    / any_value(rows)) AS scale
  FROM (SELECT *, avg(value) OVER w AS m, count(*) OVER w AS rows FROM gappy
    WINDOW w AS (PARTITION BY model_id, feature)) GROUP BY model_id, feature)"""


def _gappy_rows(spark, sf):
    """Training rows whose numerics are missing on days 9, 18 and 27."""
    rows = P.training_rows(training(spark, sf))
    missing = F.dayofmonth(F.col("row_id").cast("date")) % 9 == 0
    blank = F.transform("num", lambda v: F.when(~missing, v))
    return rows.withColumn("num", blank)


@query(f"""WITH {_LONG}{_GAPS} SELECT model_id, CAST(feature AS INTEGER) AS feature,
  round(mean, 4) AS mean, round(CASE WHEN scale = 0 THEN 1 ELSE scale END, 4) AS scale FROM stats
""")
def prep_impute_scale(spark, sf):
    prep = P.fit(_gappy_rows(spark, sf))
    cells = prep.select("model_id", F.posexplode("scales").alias("feature", "s"))
    return cells.select(
        "model_id",
        "feature",
        F.round("s.mean", 4).alias("mean"),
        F.round("s.scale", 4).alias("scale"),
    )


def _one_hot_sql(target):
    return (
        f"SELECT '{target}' AS model_id, r.date, c.c AS category, "
        f"CASE WHEN r.channel_mode = c.c THEN 1.0 ELSE 0.0 END AS value FROM full_rows r CROSS "
        f"JOIN (SELECT DISTINCT channel_mode AS c FROM full_rows WHERE {target} IS NOT NULL) c "
        f"WHERE r.{target} IS NOT NULL"
    )


@query(f"WITH {_SERIES} {_per_target(_one_hot_sql)}")
def prep_one_hot(spark, sf):
    """Spread out for the reader; the trees keep a channel as one number."""
    rows = P.training_rows(training(spark, sf))
    every = P.channels(rows).withColumnRenamed("channel", "category")
    is_own = P.channel_key() == F.col("category")
    return rows.join(every, "model_id").select(
        "model_id",
        F.col("row_id").cast("date").alias("date"),
        "category",
        F.when(is_own, 1.0).otherwise(0.0).alias("value"),
    )


# ---------------------------------------------------------------- split search at the root

_Q = Q.QUANTILES
_THRESHOLDS = f"""{_LONG}, th AS (SELECT DISTINCT model_id, feature, threshold FROM (
  SELECT model_id, feature, unnest(quantile_cont(value, {_Q})) AS threshold
  FROM long GROUP BY model_id, feature HAVING max(value) > min(value)))"""
_SDR = f"""{_THRESHOLDS}, centred AS (SELECT *, y - avg(y) OVER (PARTITION BY model_id, feature)
    AS yc FROM long),
sides AS (SELECT t.model_id, t.feature, t.threshold, count(*) AS n,
    sum(CASE WHEN l.value <= t.threshold THEN 1 ELSE 0 END) AS n_left,
    stddev_pop(yc) AS sd, stddev_pop(CASE WHEN l.value <= t.threshold THEN yc END) AS sd_left,
    stddev_pop(CASE WHEN l.value > t.threshold THEN yc END) AS sd_right
  FROM th t JOIN centred l ON l.model_id = t.model_id AND l.feature = t.feature
  GROUP BY 1, 2, 3),
sdr AS (SELECT model_id, CAST(feature AS INTEGER) AS feature, threshold,
    CAST(n_left AS BIGINT) AS n_left, CAST(n - n_left AS BIGINT) AS n_right,
    sd - (n_left * 1.0 / n * sd_left + (n - n_left) * 1.0 / n * sd_right) AS sdr
  FROM sides WHERE n_left >= 4 AND n - n_left >= 4)"""


def _root_rows(spark, sf):
    """Every training row in the root of its model, numerics unscaled, with their bands."""
    rows = P.training_rows(training(spark, sf))
    means = rows.groupBy("model_id").agg(F.avg("y").alias("mean"))
    joined = rows.join(means, "model_id").select(
        "model_id", F.lit(1).alias("node_id"), (F.col("y") - F.col("mean")).alias("y"),
        F.col("num").alias("x"),
    )
    return cut(S.with_bands(cut(joined, "root-rows")), "root-bands")


def _rounded(*names):
    return [F.round(n, 3).alias(n) for n in names]


@query(f"""WITH {_THRESHOLDS} SELECT DISTINCT model_id, CAST(feature AS INTEGER) AS feature,
  round(threshold, 3) AS threshold FROM th""")
def split_candidates(spark, sf):
    cands = S.candidates(_root_rows(spark, sf), PARAMS)
    flat = F.col("n") == F.col("total_n")
    return cands.filter(~flat).select("model_id", "feature", *_rounded("threshold")).distinct()


@query(f"""WITH {_SDR} SELECT DISTINCT model_id, feature, round(threshold, 3) AS threshold, n_left,
  n_right, round(sdr, 3) AS sdr FROM sdr""")
def split_sdr(spark, sf):
    cands = S.candidates(_root_rows(spark, sf), PARAMS)
    rows = S.score(cands, PARAMS)
    return rows.select(
        "model_id", "feature", *_rounded("threshold"), *as_long("n_left", "n_right"),
        *_rounded("sdr"),
    ).distinct()


@query(f"""WITH {_SDR} SELECT model_id, feature, round(threshold, 3) AS threshold, n_left, n_right,
  round(sdr, 3) AS sdr FROM sdr QUALIFY row_number() OVER
  (PARTITION BY model_id ORDER BY round(sdr, 6) DESC, feature, threshold) = 1""")
def split_best(spark, sf):
    cands = S.candidates(_root_rows(spark, sf), PARAMS)
    rows = S.best(S.score(cands, PARAMS))
    return rows.select(
        "model_id", "feature", *_rounded("threshold"), *as_long("n_left", "n_right"),
        *_rounded("sdr"),
    )


# ---------------------------------------------------------------- trained models

_trained = {}


def _stamp(spark, df):
    """Names, lengths and times of the files of a table: other data have another stamp."""
    jvm, found = spark._jvm, []
    for name in sorted(df.inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        found.append((name, status.getLen(), status.getModificationTime()))
    return tuple(found)


def trained(spark, sf):
    """Models of the seasonal series, trained once for each state of its input files."""
    stamp = _stamp(spark, tables.table(spark, sf, "orders"))
    key = (spark.sparkContext.applicationId, stamp)
    if key not in _trained:
        uri = fresh_dir(spark, "tree-models")
        T.ensure(training(spark, sf, seasonal=True), uri)
        _trained[key] = uri
    return T.load(spark, _trained[key])


@query()
def m5p_train_all_targets(spark, sf):
    """Six targets of every channel's series, grown together in the same jobs."""
    days = seasonal_fixture(D.roll_up(tables.staging(spark, sf), ("channel",)))
    models = T.train(X.training_set(days, ("channel",)), ("channel",))
    return models.stats()


@query(Q.tree_sql(Q.RIDGE))
def node_ridge(spark, sf):
    """Coefficients of every kept node, inner nodes included, one row per feature."""
    models = trained(spark, sf)
    about = models.nodes.select("model_id", "node_id", "n", "used", whole("level", -1))
    terms = models.coefficients().filter("value <> 0")
    return terms.join(about, ["model_id", "node_id"]).select(
        "model_id", "node_id", "feature", "name", "n", "used", whole("value").alias("coef"), "level"
    )


def whole(name, digits=0):
    """Rounded to whole units, without a negative zero."""
    return (F.round(name, digits) + F.lit(0.0)).alias(name)


def _node_table(grown):
    return grown.select(
        "model_id", "node_id", *as_long("n"), F.round("mean", 2).alias("mean"),
        F.round("sd", 2).alias("sd"),
    )


@query(Q.grown_sql(Q.NODES))
def m5p_tree_nodes(spark, sf):
    return _node_table(trained(spark, sf).grown)


DEEP = TreeParams(min_std_reduction=0.002, max_depth=4)


@query(Q.grown_sql(Q.NODES, DEEP))
def m5p_deep_nodes(spark, sf):
    """Trees grown four levels down, where almost any reduction is accepted."""
    prep, _, ready = T.prepared(P.training_rows(training(spark, sf, seasonal=True)))
    numbered = prep.drop("model_id").withColumnRenamed("number", "model_id")
    grown, _ = grow(ready, numbered, DEEP)
    return _node_table(T.named(grown, prep))


def _kept_table(nodes):
    return nodes.select(
        "model_id", "node_id", "depth", "is_leaf", F.round(F.col("error") / 1e6).alias("error"),
        "feature", F.round("threshold", 6).alias("threshold"), F.round("sdr", 2).alias("sdr"),
        F.round("sd", 2).alias("sd"), "n",
    )


@query(Q.tree_sql(Q.PRUNED))
def m5p_pruned_nodes(spark, sf):
    return _kept_table(trained(spark, sf).nodes)


def _scored(spark, sf, smooth):
    rows = P.training_rows(training(spark, sf, seasonal=True))
    scored = trained(spark, sf).predict(rows, smooth)
    return scored.select("model_id", "row_id", "y", "node_id", whole("prediction", -2))


@query(Q.tree_sql(Q.predicted("raw")))
def m5p_predict_raw(spark, sf):
    return _scored(spark, sf, smooth=False)


@query(Q.tree_sql(Q.predicted("smooth")))
def m5p_predict(spark, sf):
    return _scored(spark, sf, smooth=True)


@query(Q.tree_sql(Q.PREDICTED_ALL))
def m5p_predict_all(spark, sf):
    """All six targets of every day as columns, never negative."""
    wide = trained(spark, sf).predict_all(X.feature_frame(series(spark, sf, seasonal=True)))
    return wide.select("date", *[whole(t, -2) for t in TARGETS])


@query(Q.tree_sql(Q.IMPORTANCES))
def top_importances(spark, sf):
    rows = trained(spark, sf).top_importances()
    return rows.withColumn("importance", F.round("importance", 9))


@query(Q.tree_sql(Q.STATS))
def m5p_tree_stats(spark, sf):
    return trained(spark, sf).stats()


@query(Q.tree_sql(Q.RULES))
def m5p_rules(spark, sf):
    return trained(spark, sf).rules(digits=0)


@query(Q.tree_sql(Q.METRICS))
def m5p_train_metrics(spark, sf):
    found = T.metrics(trained(spark, sf), training(spark, sf, seasonal=True))
    return found.select("model_id", "n", whole("rmse", -1), F.round("r2", 6).alias("r2"), whole("mae", -1))


FOLD_PARAMS = TreeParams(max_depth=3)


@query(Q.tree_sql(Q.FOLDS, FOLD_PARAMS, folds=3))
def m5p_rolling_origin(spark, sf):
    """Three expanding windows by date, all trained together, each tested on the days after it."""
    found = T.rolling_origin(training(spark, sf, seasonal=True), 3, params=FOLD_PARAMS)
    return found.select("model_id", "n", whole("rmse", -1), F.round("r2", 6).alias("r2"), whole("mae", -1))


@query(Q.tree_sql(Q.SAVED))
def model_save_load(spark, sf):
    """A saved artefact read back: rows of each part, and whether they are the rows saved."""
    models = trained(spark, sf)
    uri = fresh_dir(spark, "saved-models")
    models.save(uri)
    back = T.load(spark, uri)
    found = F.lit(T.has_models(spark, uri)).alias("found")
    parts = []
    for part in T.PARTS:
        saved, read = getattr(models, part), getattr(back, part)
        read = read.select(*saved.columns)
        sides = saved.withColumn("_side", F.lit(1)).unionByName(read.withColumn("_side", F.lit(-1)))
        gaps = sides.groupBy(*saved.columns).agg(F.sum("_side").alias("gap"), F.expr("count_if(_side < 0) AS rows"))
        parts.append(
            gaps.agg(F.sum("rows").alias("rows"), F.max(F.abs("gap")).alias("gap")).select(
                F.lit(part).alias("part"), "rows", (F.col("gap") == 0).alias("same"), found
            )
        )
    return D.union_evolving(*parts)


@query(Q.tree_sql(Q.STATS, seasonal=False))
def m5p_unaltered(spark, sf):
    """Statistics of the trees of the amounts as they are, where a split is rare."""
    return T.train(training(spark, sf)).stats()


def csv_models(spark, sf):
    """Models of the default depth, trained from the seasonal days exported as CSV."""
    uri = fresh_dir(spark, "daily-csv")
    rows = series(spark, sf, seasonal=True).select(
        "date", "cash_in", "cash_out", "channel", *dates.date_parts("date"), F.lit(0.0).alias("balance"),
        F.col("date").cast("string").alias("client_tx_id"),
    )
    files.write_csv(rows, uri)
    return T.train_from_csv(spark, uri, params=PARAMS)


@query(Q.tree_sql(Q.PRUNED))
def train_from_csv(spark, sf):
    """Days exported as CSV, models trained from the file: the nodes of their trees."""
    return _kept_table(csv_models(spark, sf).nodes)


def daily_models(spark, sf):
    """Models of the default depth, retrained on a daily table cut in two and merged back."""
    days = series(spark, sf, seasonal=True)
    early = F.col("date") < F.lit("1998-01-01").cast("date")
    uri = fresh_dir(spark, "job-models")
    _, models = T.daily_job(days.filter(early), days.filter(~early), uri, params=PARAMS)
    return models


@query(Q.tree_sql(Q.PRUNED))
def daily_job_retrain(spark, sf):
    """The daily table cut in two, the later part merged back and all retrained: the trees' nodes."""
    return _kept_table(daily_models(spark, sf).nodes)
