"""Training rows per model, and imputation, scaling and the channel's index.

Rows are ``(model_id, row_id, y, num array<double>, channel)``. A prepared row holds ``x``, the
scaled numerics; ``c``, the number of its channel among those of the model; and ``b``, the band of
each numeric. Feature ``WIDTH + c`` is the 0/1 entry of channel ``c``: it is never written out, so
no row grows with the number of channels.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from cashtide.operators.features import unpivot_targets
from cashtide.schemas import FEATURES_IN, FEATURES_OUT, TARGETS, numeric_features_for

MISSING = "__MISSING__"
WIDTH = len(numeric_features_for(""))
#: Bands of a numeric within a model, and the limits of a block that are searched together.
BANDS = 256
BLOCK = 16


def series_name(series_keys):
    """Series keys as one text that no other keys give: the separator is escaped and null
    has a mark of its own. Empty without keys."""

    def part(key):
        value = F.replace(F.col(key).cast("string"), F.lit("%"), F.lit("%25"))
        return F.coalesce(F.replace(value, F.lit("~"), F.lit("%7E")), F.lit("%00"))

    return F.concat_ws("~", *[part(k) for k in series_keys])


def model_name(series_keys, target="target"):
    """Series name and target, told apart by the last separator."""
    return F.concat_ws("~", *([series_name(series_keys)] if series_keys else []), F.col(target))


def _numeric(features):
    return F.array(*[F.col(name).cast("double") for name in features if name != "channel"])


def feature_arrays(rows):
    """Both feature sets as arrays, in the fixed order."""
    return rows.withColumns({"num_in": _numeric(FEATURES_IN), "num_out": _numeric(FEATURES_OUT)})


def _for_target(target="target"):
    return F.when(F.contains(F.lower(F.col(target)), F.lit("out")), F.col("num_out")).otherwise(
        F.col("num_in")
    )


def training_rows(features, series_keys=(), targets=TARGETS):
    """Long form: one row per (series, date, target), incomplete rows dropped."""
    wide = feature_arrays(features)
    ids = list(dict.fromkeys([*series_keys, "date", "num_in", "num_out", "channel"]))
    long = unpivot_targets(wide.select(*ids, *targets), ids, targets)
    rows = long.select(
        model_name(series_keys).alias("model_id"),
        model_name(series_keys, "date").alias("row_id"),
        "y",
        _for_target().alias("num"),
        "channel",
    )
    complete = F.forall("num", lambda v: v.isNotNull()) & F.col("channel").isNotNull()
    return rows.filter(complete)


def channel_key():
    return F.coalesce("channel", F.lit(MISSING))


def limits_of(value):
    """About ``BANDS`` percentiles of a column, lowest first; bands hold what lies between two."""
    # One text in place of hundreds of literals keeps the plan small.
    shares = F.split(F.lit(" ".join(str(i / BANDS) for i in range(1, BANDS))), " ").cast("array<double>")
    found = F.array_distinct(F.percentile_approx(value, shares, F.lit(4 * BANDS)))
    return F.coalesce(found, F.array().cast("array<double>"))


def searchable(limits):
    """Limits of each numeric with the last of every block of them, for ``bands``."""
    last = F.transform(
        limits, lambda ls: F.filter(ls, lambda _, at: at % BLOCK == BLOCK - 1)
    )
    return F.arrays_zip(limits.alias("limits"), last.alias("lasts"))


def bands(x="x", limits="limits"):
    """Per numeric the number of its limits below the value, found by blocks."""
    blocks = f"size(filter({limits}[i].lasts, l -> l < v))"
    within = f"size(filter(slice({limits}[i].limits, k * {BLOCK} + 1, {BLOCK}), l -> l < v))"
    # The one-element array names the block that was found.
    found = f"transform(array({blocks}), k -> k * {BLOCK} + {within})[0]"
    return F.expr(f"transform({x}, (v, i) -> {found})")


def fit(rows):
    """One row per model: mean and scale of each numeric, band limits, target moments.

    One aggregation with map-side partials, as wide as the numerics. A missing numeric counts as
    the mean, so its squared deviation is 0 while it still counts as a row. Limits are those of the
    scaled values; whatever they are, splits are exact.
    """
    aggs = ["count(1) AS n", "avg(y) AS y_mean", "stddev_pop(y) AS y_sd"]
    for i in range(WIDTH):
        value = f"get(num, {i})"
        aggs += [f"avg({value}) AS m{i}", f"stddev_pop({value}) AS s{i}", f"count({value}) AS c{i}"]
    limits = [limits_of(F.get("num", F.lit(i))).alias(f"l{i}") for i in range(WIDTH)]
    stats = rows.groupBy("model_id").agg(*map(F.expr, aggs), *limits)
    sds = [f"s{i} * sqrt(c{i} / n)" for i in range(WIDTH)]
    scales = ", ".join(
        f"struct(coalesce(m{i}, 0D) AS mean, IF({sd} > 0, {sd}, 1D) AS scale)"
        for i, sd in enumerate(sds)
    )
    plain = ", ".join(f"l{i}" for i in range(WIDTH))
    held = stats.selectExpr(
        "model_id", "n", "y_mean", "y_sd", f"array({scales}) AS scales", f"array({plain}) AS plain"
    )
    scaled = F.zip_with(
        "plain",
        "scales",
        lambda ls, s: F.array_distinct(F.transform(ls, lambda v: (v - s["mean"]) / s["scale"])),
    )
    held = held.withColumn("plain", scaled)
    return held.withColumn("limits", searchable(F.col("plain"))).drop("plain")


def channels(rows):
    """(model_id, channel, c): the channels of each model, numbered in their order."""
    found = rows.select("model_id", channel_key().alias("channel")).distinct()
    order = Window.partitionBy("model_id").orderBy("channel")
    return found.withColumn("c", F.row_number().over(order) - 1)


def scaled(num="num", scales="scales"):
    """Imputed and scaled numerics."""
    return F.zip_with(
        num, scales, lambda v, s: (F.coalesce(v, s["mean"]) - s["mean"]) / s["scale"]
    )


def with_channel(rows, numbered, *columns):
    """``rows`` with ``columns`` of their model's channel, null for one that it has not seen."""
    held = numbered.select("model_id", F.col("channel").alias("_channel"), *columns)
    keyed = rows.withColumn("_channel", channel_key())
    return keyed.join(held, ["model_id", "_channel"], "left").drop("_channel")


#: Rows of a model that stay together; a larger model is dealt to several tasks.
ROWS_TOGETHER = 50_000


def apply(rows, prep, numbered, key="model_id"):
    """Prepared rows under ``key``, dealt by model so that sums combine before they move.

    Scales and limits of a model are hundreds of times as wide as a row, so they meet the rows only
    where these are dealt to: one copy of them for each share of a model.
    """
    shares = F.ceil(F.col("n") / ROWS_TOGETHER)
    sizes = prep.select(*dict.fromkeys(["model_id", key]), shares.alias("_shares"))
    joined = with_channel(rows, numbered, "c").join(sizes, "model_id")
    salt = F.pmod(F.xxhash64("row_id"), F.col("_shares"))
    dealt = joined.select(F.col(key).alias("_key"), salt.alias("_salt"), "y", "num", "c")
    each = F.explode(F.sequence(F.lit(0).cast("bigint"), shares - 1)).alias("_salt")
    params = prep.select(F.col(key).alias("_key"), each, "scales", "limits", "y_mean")
    together = dealt.repartition("_key", "_salt").join(params, ["_key", "_salt"])
    # The band comes from the stored scale, once the scaled values are there.
    ready = together.select(
        F.col("_key").alias("model_id"), (F.col("y") - F.col("y_mean")).alias("y"),
        scaled().alias("x"), "c", "limits",
    )
    return ready.select("model_id", "y", "x", "c", bands().alias("b"))


def feature_names(prep, numbered):
    """(model_id, feature, name): numerics first, then ``channel_<value>``."""
    target = F.substring_index("model_id", "~", -1)
    is_out = F.contains(F.lower(target), F.lit("out"))
    names = F.when(is_out, _literal(FEATURES_OUT)).otherwise(_literal(FEATURES_IN))
    numerics = prep.select("model_id", F.posexplode(names).alias("feature", "name"))
    hot = numbered.select(
        "model_id",
        (F.col("c") + WIDTH).cast("int").alias("feature"),
        F.concat(F.lit("channel_"), "channel").alias("name"),
    )
    return numerics.unionByName(hot)


def _literal(features):
    return F.array(*[F.lit(name) for name in features if name != "channel"])
