"""What a fitted tree looks like: importances, statistics, rules."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from cashtide.modeltree.prep import WIDTH
from cashtide.modeltree.ridge import ancestors


def importances(nodes, names):
    """Spread reduction times rows per split feature, as a share of the model's total."""
    gains = nodes.filter(~F.col("is_leaf")).groupBy("model_id", "feature").agg(
        F.sum(F.col("sdr") * F.col("n")).alias("gain")
    )
    all_features = names.join(gains, ["model_id", "feature"], "left").fillna(0.0, ["gain"])
    whole = F.sum("gain").over(Window.partitionBy("model_id"))
    share = F.when(whole > 0, F.col("gain") / whole).otherwise(0.0)
    return all_features.select("model_id", "feature", "name", share.alias("importance"))


def top_importances(nodes, names, k=10):
    order = Window.partitionBy("model_id").orderBy(F.col("importance").desc(), "feature")
    ranked = importances(nodes, names).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k)


def tree_stats(nodes, grown):
    """Depth and leaves of the kept tree, nodes kept and nodes grown."""
    kept = nodes.groupBy("model_id").agg(
        F.max("depth").alias("depth"),
        F.count_if("is_leaf").alias("leaves"),
        F.count(F.lit(1)).alias("nodes"),
    )
    built = grown.groupBy("model_id").agg(F.count(F.lit(1)).alias("nodes_grown"))
    return kept.join(built, "model_id")


def coefficients(nodes, effects):
    """(model_id, node_id, feature, value): numerics and channels of every kept node."""
    numerics = nodes.select("model_id", "node_id", F.posexplode("coef").alias("feature", "value"))
    channels = effects.select(
        "model_id", "node_id", (F.col("c") + WIDTH).cast("int").alias("feature"),
        F.col("coef").alias("value"),
    )
    kept = nodes.select("model_id", "node_id")
    return numerics.unionByName(channels.join(kept, ["model_id", "node_id"], "left_semi"))


def rules(nodes, names, effects, digits=3):
    """One row per leaf: conditions from the root and the linear equation."""
    number = f"%.{digits}f"
    path = nodes.filter("is_leaf").select(
        "model_id",
        F.col("node_id").alias("leaf"),
        F.explode(ancestors("node_id")).alias("step"),
    )
    parent = F.floor(F.col("step") / 2).cast("int")
    steps = path.filter(F.col("step") > 1).withColumn("node_id", parent)
    inner = nodes.filter(~F.col("is_leaf")).select("model_id", "node_id", "feature", "threshold")
    steps = steps.join(inner, ["model_id", "node_id"]).join(names, ["model_id", "feature"])
    sign = F.when(F.col("step") % 2 == 0, "≤").otherwise(">")
    text = F.concat_ws(" ", "name", sign, F.format_string("%.3f", "threshold"))
    ordered = F.sort_array(F.collect_list(F.struct("step", text.alias("text"))))
    conditions = steps.groupBy("model_id", F.col("leaf").alias("node_id")).agg(
        F.concat_ws(" AND ", F.transform(ordered, lambda s: s["text"])).alias("condition")
    )

    leaves = nodes.filter("is_leaf").select("model_id", "node_id", "n", "coef", "level", "used")
    terms = coefficients(leaves, effects)
    terms = terms.filter(F.col("value") != 0).join(names, ["model_id", "feature"])
    term = F.concat(F.col("name"), F.lit("="), F.format_string(number, "value"))
    terms = terms.groupBy("model_id", "node_id").agg(
        F.sort_array(F.collect_list(F.struct("feature", term.alias("text")))).alias("terms")
    )
    level = F.format_string(number, "level")
    linear = F.concat_ws(", ", F.transform("terms", lambda t: t["text"]))
    equation = F.when(F.col("used") == 0, F.concat(level, F.lit(" (constant)"))).otherwise(
        F.concat(linear, F.lit(" + "), level)
    )
    keys = ["model_id", "node_id"]
    full = leaves.join(terms, keys, "left").join(conditions, keys, "left")
    return full.select(
        *keys,
        "n",
        F.coalesce("condition", F.lit("ROOT")).alias("condition"),
        equation.alias("equation"),
    )
