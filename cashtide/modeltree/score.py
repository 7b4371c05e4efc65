"""Compiled models and scoring.

Smoothing walks from the leaf to the root, blending in each ancestor with a weight that
grows by k per step. The walk has a closed form, (n * leaf + k * sum of ancestors) /
(n + k * number of ancestors), which is linear in x. It is therefore folded into one
coefficient vector per leaf; scoring is a route and one dot product. Channels are kept apart: what
a channel adds in each leaf is one row per model and channel, which a row meets by its own channel.
"""

from pyspark.sql import functions as F

from cashtide.functions.clean import clip_non_negative
from cashtide.modeltree.grow import by_node, route, split_cells
from cashtide.modeltree.prep import (
    channel_key,
    feature_arrays,
    scaled,
    series_name,
    with_channel,
)
from cashtide.modeltree.prune import dot
from cashtide.modeltree.ridge import ancestors


def smoothed_leaves(nodes, smoothing):
    """Each leaf with its own and its smoothed coefficients."""
    parts = leaf_paths(nodes, smoothing).join(
        nodes.select("model_id", "node_id", "coef", "intercept"), ["model_id", "node_id"]
    )
    ordered = F.sort_array(
        F.collect_list(F.struct("node_id", "w", "coef", "intercept")), asc=False
    )
    grouped = parts.groupBy("model_id", "leaf").agg(ordered.alias("path"))
    total = F.aggregate("path", F.lit(0.0), lambda acc, p: acc + p["w"])
    own = F.get("path", 0)
    zeros = F.transform(own["coef"], lambda _: F.lit(0.0))
    blended = F.aggregate(
        "path",
        zeros,
        lambda acc, p: F.zip_with(acc, p["coef"], lambda a, c: a + p["w"] * c),
    )
    level = F.aggregate("path", F.lit(0.0), lambda acc, p: acc + p["w"] * p["intercept"])
    return grouped.withColumn("_total", total).select(
        "model_id",
        F.col("leaf").alias("node_id"),
        own["coef"].alias("raw_coef"),
        own["intercept"].alias("raw_intercept"),
        F.transform(blended, lambda c: c / F.col("_total")).alias("coef"),
        (level / F.col("_total")).alias("intercept"),
    )


def compile_models(prep, nodes, params):
    """One row per model: scales, split array and leaf array."""
    equation = ("coef", "intercept", "raw_coef", "raw_intercept")
    leaves = by_node(smoothed_leaves(nodes, params.smoothing), equation, "leaves")
    splits = split_cells(nodes.filter("NOT is_leaf"))
    base = prep.select("model_id", "n", "y_mean", "scales")
    return base.join(leaves, "model_id").join(splits, "model_id", "left")


def compile_channels(numbered, nodes, effects, params):
    """One row per model and channel: its number and, by leaf, what it adds to a prediction."""
    steps = leaf_paths(nodes, params.smoothing)
    whole = steps.groupBy("model_id", "leaf").agg(F.sum("w").alias("whole"))
    parts = steps.join(effects, ["model_id", "node_id"])
    own = F.when(F.col("node_id") == F.col("leaf"), F.col("coef"))
    blended = parts.groupBy("model_id", "leaf", "c").agg(
        F.sum(F.col("w") * F.col("coef")).alias("coef"), F.max(own).alias("raw_coef")
    )
    blended = blended.join(whole, ["model_id", "leaf"]).select(
        "model_id", "c", F.col("leaf").alias("node_id"), (F.col("coef") / F.col("whole")).alias("coef"),
        F.coalesce("raw_coef", F.lit(0.0)).alias("raw_coef"),
    )
    arrays = by_node(blended, ("coef", "raw_coef"), "effects", ("model_id", "c"))
    return numbered.select("model_id", "channel", "c").join(arrays, ["model_id", "c"], "left")


def leaf_paths(nodes, smoothing):
    """(model_id, leaf, node_id, w): the nodes above each leaf with their weight in its blend."""
    steps = nodes.filter("is_leaf").select(
        "model_id",
        F.col("node_id").alias("leaf"),
        F.col("n").alias("leaf_n"),
        F.explode(ancestors("node_id")).alias("node_id"),
    )
    is_own = F.col("node_id") == F.col("leaf")
    weight = F.when(is_own, F.col("leaf_n")).otherwise(F.lit(smoothing)).cast("double")
    return steps.select("model_id", "leaf", "node_id", weight.alias("w"))


def value_of(model, leaf, effect, x, prefix=""):
    """A prediction from a model's mean, its leaf's equation and what the channel adds."""
    added = F.coalesce(effect[f"{prefix}coef"], F.lit(0.0))
    return model + leaf[f"{prefix}intercept"] + dot(leaf[f"{prefix}coef"], x) + added


def predict(rows, models, lookup, max_depth, smooth=True):
    """Add ``node_id`` and ``prediction``, null for rows without a model.

    The joins adapt to the size of the tables; a row meets only its own channel.
    """
    joined = rows.join(models.drop("n"), "model_id", "left")
    joined = with_channel(joined, lookup, "c", "effects").withColumn("x", scaled())
    reached = F.when(F.col("leaves").isNotNull(), route("splits", "x", "c", max_depth))
    joined = joined.withColumn("node_id", reached)
    joined = joined.withColumns(
        {"_leaf": F.get("leaves", F.col("node_id") - 1), "_effect": F.get("effects", F.col("node_id") - 1)}
    )
    prefix = "" if smooth else "raw_"
    value = value_of(F.col("y_mean"), F.col("_leaf"), F.col("_effect"), F.col("x"), prefix)
    return joined.withColumn("prediction", value).drop(
        "_leaf", "_effect", "leaves", "splits", "scales", "y_mean", "x", "c", "effects", "num"
    )


def by_series(models, targets, columns, keys=()):
    """One row per series (and ``keys``) with one struct column per target."""
    target = F.substring_index("model_id", "~", -1)
    series = F.regexp_replace(F.col("model_id"), "~?[^~]*$", "")
    rows = models.select(
        series.alias("_series"), *keys, target.alias("_target"), F.struct(*columns).alias("_model")
    )
    return rows.groupBy("_series", *keys).pivot("_target", list(targets)).agg(F.first("_model"))


def predict_wide(features, models, lookup, series_keys, targets, max_depth):
    """One column per target, clipped at 0; null where a series has no model for it.

    All models of a series arrive in one join and all of its channel's effects in another, and
    every target is an expression on the row, so nothing is exploded by target or pivoted back.
    """
    table = by_series(models, targets, ("y_mean", "scales", "splits", "leaves"))
    if not series_keys:
        table = F.broadcast(table)  # a single row
    hot = by_series(lookup, targets, ("c", "effects"), ("channel",)).select(
        F.col("_series"), F.col("channel").alias("_channel"), *[F.col(t).alias(f"_hot_{t}") for t in targets]
    )
    series = series_name(series_keys) if series_keys else F.lit("")
    kept = list(dict.fromkeys([*series_keys, "date", "num_in", "num_out"]))
    rows = feature_arrays(features).select(
        *kept, series.alias("_series"), channel_key().alias("_channel")
    )
    joined = rows.join(table, "_series", "left").join(hot, ["_series", "_channel"], "left")
    for name in targets:
        num = "num_out" if "out" in name else "num_in"
        joined = joined.withColumn(f"_x_{name}", scaled(num, F.col(name)["scales"]))
    nodes = {
        f"_node_{t}": route(f"{t}.splits", f"_x_{t}", f"_hot_{t}.c", max_depth) for t in targets
    }
    joined = joined.withColumns(nodes)
    values = []
    for t in targets:
        at = F.col(f"_node_{t}") - 1
        leaf, effect = F.get(F.col(t)["leaves"], at), F.get(F.col(f"_hot_{t}")["effects"], at)
        value = value_of(F.col(t)["y_mean"], leaf, effect, F.col(f"_x_{t}"))
        values.append(F.when(F.col(t).isNotNull(), clip_non_negative(value)).alias(t))
    return joined.select(*series_keys, "date", *values)
