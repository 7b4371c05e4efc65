"""Training, artefacts and metrics."""

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cashtide.modeltree import explain, prune, score
from cashtide.modeltree import prep as P
from cashtide.modeltree.grow import grow
from cashtide.modeltree.params import TreeParams
from cashtide.modeltree.ridge import node_models
from cashtide.operators import daily
from cashtide.operators.features import by_date, training_set
from cashtide.operators.ingest import require_cash_columns
from cashtide.operators.profile import regression_metrics
from cashtide.schemas import FEATURES_IN, FEATURES_OUT, TARGETS
from cashtide.session import cut, scratch
from cashtide.sources import commits
from cashtide.sources.files import read_daily_csv

PARTS = ("nodes", "models", "grown", "names", "effects", "lookup")


@dataclass
class TreeModels:
    """All trained models as tables keyed by ``model_id``."""

    nodes: DataFrame
    models: DataFrame
    grown: DataFrame
    names: DataFrame
    effects: DataFrame
    lookup: DataFrame
    max_depth: int

    def predict(self, rows, smooth=True):
        return score.predict(rows, self.models, self.lookup, self.max_depth, smooth)

    def predict_all(self, features, series_keys=(), targets=TARGETS):
        return score.predict_wide(
            features, self.models, self.lookup, series_keys, targets, self.max_depth
        )

    def top_importances(self, k=10):
        return explain.top_importances(self.nodes, self.names, k)

    def stats(self):
        return explain.tree_stats(self.nodes, self.grown)

    def rules(self, digits=3):
        return explain.rules(self.nodes, self.names, self.effects, digits)

    def coefficients(self):
        """The equation of every kept node, one row per feature."""
        found = explain.coefficients(self.nodes, self.effects)
        return found.join(self.names, ["model_id", "feature"])

    def save(self, uri):
        """Write a new version and commit it last; readers see the old one until then.

        Of several writers that start from the same version one wins; the others get a
        ``commits.Conflict`` and leave it in place.
        """
        spark = self.nodes.sparkSession
        number, _ = commits.newest(spark, uri)
        version = uuid.uuid4().hex
        for part in PARTS:
            getattr(self, part).write.parquet(f"{uri}/versions/{version}/{part}")
        commits.commit(spark, uri, number + 1, {"version": version, "max_depth": self.max_depth})

    def schema(self):
        """Per model: target, ordered features and the names of the encoded ones."""
        target = F.substring_index("model_id", "~", -1)
        required = F.when(F.contains(F.lower(target), F.lit("out")), _texts(FEATURES_OUT)).otherwise(
            _texts(FEATURES_IN)
        )
        ordered = F.sort_array(F.collect_list(F.struct("feature", "name")))
        encoded = self.names.groupBy("model_id").agg(
            F.transform(ordered, lambda f: f["name"]).alias("all_feature_names")
        )
        return encoded.select(
            "model_id",
            target.alias("target_column"),
            required.alias("required_features"),
            "all_feature_names",
        )

    def targets(self):
        """Targets of the models held."""
        rows = self.models.select(F.substring_index("model_id", "~", -1).alias("target"))
        return {r["target"] for r in rows.distinct().collect()}  # a handful of names

    def joined(self, newer):
        """These models, with those of ``newer`` in place of the same targets."""
        replaced = sorted(newer.targets())
        target = F.substring_index("model_id", "~", -1)
        parts = {
            part: getattr(self, part).filter(~target.isin(replaced)).unionByName(getattr(newer, part))
            for part in PARTS
        }
        return TreeModels(**parts, max_depth=max(self.max_depth, newer.max_depth))


def _texts(names):
    return F.array(*[F.lit(name) for name in names])


def published(spark, uri):
    """What the newest committed version says of itself, ``None`` when there is none."""
    return commits.newest(spark, uri)[1]


def load(spark, uri):
    """The newest published version, with the depth it was grown to."""
    about = published(spark, uri)
    if about is None:
        raise ValueError(f"no models are published in {uri}")
    folder = f"{uri}/versions/{about['version']}"
    tables = {part: spark.read.parquet(f"{folder}/{part}") for part in PARTS}
    return TreeModels(**tables, max_depth=about["max_depth"])


def has_models(spark, uri):
    return published(spark, uri) is not None


def prepared(rows):
    """Preparation table, channels and prepared rows, written once for the loop to re-read.

    Inside the loop a model goes by a number, given when the preparation table is written:
    the rows that are read at every level carry 8 bytes in place of a name. A series comes out of
    its windows in one task, so its rows are dealt anew before they are written.
    """
    rows = cut(rows.repartition("model_id", "row_id"), "training-rows")
    prep = cut(P.fit(rows).withColumn("number", F.monotonically_increasing_id()), "prep")
    numbered = cut(P.channels(rows), "channels")
    return prep, numbered, cut(P.apply(rows, prep, numbered, "number"), "prepared-rows")


def fit(rows, params=None):
    """Train one tree per ``model_id`` present in ``rows``."""
    params = params or TreeParams()
    prep, channels, ready = prepared(rows)
    by_number = prep.drop("model_id").withColumnRenamed("number", "model_id")
    grown, splits = grow(ready, by_number, params)
    models, effects = node_models(ready, splits, params)
    models = cut(models, "node-models")
    absolute = None
    if params.prune and params.pruning_method == "mae":
        absolute = prune.absolute_errors(ready, models, effects, splits, params.max_depth)
    errors = prune.node_errors(models, params, absolute)
    kept = prune.prune(errors) if params.prune else prune.keep_all(errors)
    nodes = node_table(kept, models, grown, splits, by_number)
    nodes = cut(named(nodes, prep), "nodes")
    effects = named(effects, prep)
    return TreeModels(
        nodes=nodes,
        models=cut(score.compile_models(prep, nodes, params), "models"),
        grown=named(grown, prep),
        names=P.feature_names(prep, channels),
        effects=effects,
        lookup=cut(score.compile_channels(channels, nodes, effects, params), "channel-lookup"),
        max_depth=params.max_depth,
    )


def named(rows, prep):
    """Model numbers back to names."""
    keys = prep.select("model_id", "number")
    return rows.withColumnRenamed("model_id", "number").join(keys, "number").drop("number")


def node_table(kept, models, grown, splits, prep):
    """Kept nodes with model, spread, split and reduction."""
    keys = ["model_id", "node_id"]
    depth = F.floor(F.log2("node_id")).cast("int")
    rows = (
        kept.join(models.drop("sse"), keys)
        .join(grown.select(*keys, "sd"), keys)
        .join(prep.select("model_id", "y_mean"), "model_id")
    )
    if splits is None:
        empty = {"feature": "int", "threshold": "double", "sdr": "double"}
        rows = rows.withColumns({c: F.lit(None).cast(t) for c, t in empty.items()})
    else:
        rows = rows.join(splits.select(*keys, "feature", "threshold", "sdr"), keys, "left")
    inner = ~F.col("is_leaf")
    for name in ("feature", "threshold", "sdr"):
        rows = rows.withColumn(name, F.when(inner, F.col(name)))
    return rows.withColumns({"depth": depth, "level": F.col("intercept") + F.col("y_mean")}).drop(
        "y_mean"
    )


def train(features, series_keys=(), targets=TARGETS, params=None):
    """Train all targets of all series in the same jobs."""
    return fit(P.training_rows(features, series_keys, targets), params)


def holdout(features, cutoff):
    """Time-ordered split: rows before the cut-off date train, the others test."""
    early = F.col("date") < F.lit(cutoff)
    return features.filter(early), features.filter(~early)


def metrics(model, features, series_keys=(), targets=TARGETS):
    """rmse, r2 and mae of each model on labelled rows (in-sample unless held out)."""
    rows = P.training_rows(features, series_keys, targets)
    return regression_metrics(model.predict(rows), ("model_id",))


#: Rows that a target looks ahead, by the end of its name.
AHEAD = {"next_day": 1, "h7_sum": 7, "next_month_sum": 30}


def folds_of(features, folds, series_keys=()):
    """Expanding windows by date: (train, test), each with a ``fold`` from 1 on.

    The days of a series are cut into ``folds + 1`` equal spans. Fold k trains on the rows whose
    target is known before the end of span k, so nothing it learns from lies in its future, and
    is tested on span k + 1. All cuts follow from the first and last day of the series.
    """
    keys = [*series_keys, "_all"]
    known = {
        f"_known_{name}": F.lead("date", ahead).over(by_date(series_keys))
        for name, ahead in AHEAD.items()
    }
    rows = features.withColumns({**known, "_all": F.lit(0)})
    days = rows.groupBy(*keys).agg(
        F.min("date").alias("_first"), (F.datediff(F.max("date"), F.min("date")) + 1).alias("_days")
    )
    cuts = days.select("*", F.explode(F.sequence(F.lit(1), F.lit(folds))).alias("fold"))

    def cut_at(k):
        return F.date_add("_first", F.floor(F.col("_days") * k / (folds + 1)).cast("int"))

    cuts = cuts.select(
        *keys, "fold", cut_at(F.col("fold")).alias("_cut"), cut_at(F.col("fold") + 1).alias("_until")
    )
    joined = rows.join(cuts, keys)

    def seen(target):
        known = next(f"_known_{name}" for name in AHEAD if target.endswith(name))
        return F.when(F.col(known) < F.col("_cut"), F.col(target))

    held = [c for c in features.columns if c not in TARGETS]
    train_rows = joined.filter("date < _cut").select("fold", *held, *[seen(t).alias(t) for t in TARGETS])
    test_rows = joined.filter("date >= _cut AND date < _until").select("fold", *features.columns)
    return train_rows, test_rows


def rolling_origin(features, folds=3, series_keys=(), targets=TARGETS, params=None):
    """rmse, r2 and mae of each fold's models on the days after those it was trained on.

    The folds of all series and targets are trained together, as so many more models.
    """
    early, late = folds_of(features, folds, series_keys)
    keys = ("fold", *series_keys)
    model = train(early, keys, targets, params)
    return metrics(model, late, keys, targets)


def ensure(features, uri, series_keys=(), targets=TARGETS, params=None, force=False):
    """Models of all ``targets``: stored ones are loaded, missing ones are trained and stored
    with them; ``force`` retrains all."""
    spark = features.sparkSession
    held = load(spark, uri) if not force and has_models(spark, uri) else None
    missing = [t for t in targets if held is None or t not in held.targets()]
    if missing:
        with scratch(spark):
            newer = train(features, series_keys, missing, params)
            (newer if held is None else held.joined(newer)).save(uri)
    return load(spark, uri)


def train_from_csv(spark, uri, series_keys=(), targets=TARGETS, params=None):
    """Models from a CSV file of daily rows (or raw transactions), as the reader finds it."""
    rows = require_cash_columns(read_daily_csv(spark, uri))
    days = daily.roll_up(rows, series_keys).join(
        daily.common_channel(rows, (*series_keys, "date")), [*series_keys, "date"]
    )
    features = training_set(days.withColumnRenamed("channel_mode", "channel"), series_keys)
    return train(features, series_keys, targets, params)


def daily_job(history, batch, models_uri, series_keys=(), targets=TARGETS, params=None):
    """The day's work: merge a batch into the daily table, rebuild features, retrain, publish.

    Returns the merged table and the models.
    """
    merged = cut(daily.merge_additive(history, batch, series_keys), "daily-merged")
    features = training_set(merged, series_keys)
    return merged, ensure(features, models_uri, series_keys, targets, params, force=True)
