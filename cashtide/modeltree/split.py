"""Split search for every node of every model in two looks per tree level.

Rows are ``(model_id, node_id, y, x, c, b)`` with ``y`` centred on the node mean. Band limits are
fixed once per model and numeric. The first look adds up the target per (model, node, numeric, band),
combined in each map task, so what is shuffled grows with the bands and not with the rows. Running
totals over the bands tell which of them hold a percentile; the second look reads the exact values in
those bands alone, and their running totals, offset by the bands below, give each percentile
threshold and the target moments on its left side. A node's mean travels with its sums.

The 0/1 entry of a channel has one threshold that matters; its two sides follow from the sums of the
channel's rows, so channels cost one small row each and are never spread out.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from cashtide.modeltree import prep as P
from cashtide.modeltree.params import FLAT
from cashtide.session import cut

NODE = ("model_id", "node_id")
FEATURE = (*NODE, "feature")
SUMS = ("n", "s1", "s2")
_MOMENTS = ("count(1) AS n", "sum(y) AS s1", "sum(y * y) AS s2")


def with_bands(rows):
    """Rows (model_id, node_id, y, x) that no preparation has banded; they have no channel."""
    width = P.WIDTH
    limits = F.array(*[P.limits_of(F.get("x", F.lit(i))) for i in range(width)]).alias("limits")
    per_model = rows.groupBy("model_id").agg(limits)
    per_model = cut(per_model.withColumn("limits", P.searchable(F.col("limits"))), "limits")
    joined = rows.join(per_model, "model_id")
    return joined.select(
        *NODE, "y", "x", F.lit(None).cast("int").alias("c"), P.bands().alias("b"),
        F.lit(0.0).alias("mean"),
    )


def band_sums(located):
    """Sums of the target per node, feature and band, and the band's least and largest value; a
    channel's entry has one band, its rows."""
    cells = (
        "concat(transform(b, (band, i) -> struct(i AS feature, band AS band, get(x, i) AS value)), "
        f"IF(c IS NULL, array(), array(struct(c + {P.WIDTH} AS feature, 0 AS band, 1D AS value))))"
    )
    long = located.selectExpr(*NODE, "y", "mean", f"inline({cells})")
    reach = ("min(value) AS low", "max(value) AS high", "first(mean) AS mean")
    return long.groupBy(*FEATURE, "band").agg(*map(F.expr, (*_MOMENTS, *reach)))


def _at(params):
    """Positions of the percentiles among ``total_n`` sorted rows."""
    spots = ", ".join(f"{q!r}D" for q in params.quantiles())
    return f"transform(array({spots}), q -> (total_n - 1) * q)"


def looked_into(sums, params):
    """The bands that hold the value at, or the one after, a percentile, with the totals below."""
    order = Window.partitionBy(*FEATURE).orderBy("band")
    start, end = Window.unboundedPreceding, Window.unboundedFollowing
    below, whole = order.rowsBetween(start, -1), order.rowsBetween(start, end)
    offsets = {f"below_{c}": F.coalesce(F.sum(c).over(below), F.lit(0)) for c in SUMS}
    offsets |= {f"total_{c}": F.sum(c).over(whole) for c in SUMS}
    offsets |= {"next_low": F.lead("low").over(order), "last_high": F.lag("high").over(order)}
    holds = " OR ".join(
        f"({side}(a) >= below_n AND {side}(a) < below_n + n)" for side in ("floor", "ceil")
    )
    numerics = sums.filter(F.col("feature") < P.WIDTH)
    held = numerics.withColumns(offsets).filter(f"exists({_at(params)}, a -> {holds})")
    return held.drop(*SUMS, "low", "high")


def value_sums(located, wanted):
    """Distinct values in the bands that are looked into, with the sums of their rows."""
    listed = F.collect_list(F.struct("feature", "band")).alias("cells")
    of_feature = "transform(filter(cells, s -> s.feature = i), s -> s.band)"
    looks = wanted.groupBy(*NODE).agg(listed).selectExpr(
        *NODE, f"transform(sequence(0, {P.WIDTH - 1}), i -> {of_feature}) AS looks"
    )
    cell = "struct(i AS feature, band AS band, get(x, i) AS value)"
    cells = f"transform(b, (band, i) -> IF(array_contains(get(looks, i), band), {cell}, NULL))"
    long = located.join(looks, list(NODE)).selectExpr(
        *NODE, "y", f"inline(filter({cells}, s -> s IS NOT NULL))"
    )
    return long.groupBy(*FEATURE, "band", "value").agg(*map(F.expr, _MOMENTS))


def running_totals(values, wanted):
    """``values`` with the running totals of their node and feature, and the values around them.

    Sums run inside a band; before the first and after the last value of a band stand the largest
    of the band below and the least of the band above.
    """
    band = [*FEATURE, "band"]
    inside = Window.partitionBy(*band).orderBy("value")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    new = {f"_in_{c}": F.sum(c).over(upto) for c in SUMS}
    new |= {"_next": F.lead("value").over(inside), "_last": F.lag("value").over(inside)}
    joined = values.withColumns(new).join(wanted, band)
    return joined.select(
        *FEATURE, "mean", "value", "n", *[f"total_{c}" for c in SUMS],
        *[(F.col(f"_in_{c}") + F.col(f"below_{c}")).alias(f"cum_{c}") for c in SUMS],
        F.coalesce("_next", "next_low").alias("next"), F.coalesce("_last", "last_high").alias("last"),
    )


def candidates(located, params, sums=None):
    """Percentile thresholds (linear interpolation) of the numerics with left-side totals."""
    sums = cut(band_sums(located), "band-sums") if sums is None else sums
    wanted = cut(looked_into(sums, params), "looked-into")
    return thresholds(running_totals(value_sums(located, wanted), wanted), params)


def _between(low, high):
    """Linear interpolation at the fraction of ``_at``, from the nearer end."""
    part = "(_at - floor(_at))"
    return (
        f"CASE WHEN {part} >= 0.5 THEN {high} - ({high} - {low}) * (1 - {part}) "
        f"ELSE {low} + ({high} - {low}) * {part} END"
    )


def thresholds(totals, params):
    """The percentiles among values with running totals.

    A value covers the ranks [cum_n - n, cum_n); it yields the percentiles whose lower rank falls
    there. An interpolation that rounds up to the next value is that value's: its rows then go left
    too. So a value also yields the percentiles from the rank before its own that round up to it.
    """
    steps, last = params.percentiles + 1, "nullif(total_n - 1, 0)"
    low = f"int(greatest(ceil({steps} * (cum_n - n - 1) / {last}) - 1, 1))"
    high = f"int(least(floor({steps} * cum_n / {last}) + 1, {params.percentiles}))"
    rows = totals.selectExpr("*", f"{low} AS _low", f"{high} AS _high").filter("_low <= _high")
    rows = rows.selectExpr("*", f"explode(slice({_at(params)}, _low, _high - _low + 1)) AS _at")
    found = (
        "CASE WHEN floor(_at) >= cum_n - n AND ceil(_at) < cum_n THEN value "
        f"WHEN floor(_at) >= cum_n - n AND floor(_at) < cum_n AND {_between('value', 'next')} < next "
        f"THEN {_between('value', 'next')} "
        "WHEN floor(_at) = cum_n - n - 1 AND ceil(_at) = cum_n - n "
        f"AND {_between('last', 'value')} >= value THEN {_between('last', 'value')} END AS threshold"
    )
    kept = [f"total_{c}" for c in SUMS] + [f"cum_{c}" for c in SUMS]
    return rows.selectExpr(*FEATURE, "mean", "n", found, *kept).filter("threshold IS NOT NULL")


def channel_candidates(sums, params):
    """The threshold between 0 and 1 of every channel's entry in every node.

    Of the percentiles between the zeros and the ones the lowest counts, as all split alike: 0
    itself, or what the first percentile interpolates.
    """
    ones = sums.filter(F.col("feature") >= P.WIDTH)
    whole = sums.filter("feature = 0").groupBy(*NODE).agg(
        F.first("mean").alias("mean"), *[F.sum(c).alias(f"total_{c}") for c in SUMS]
    )
    first = params.quantiles()[0]
    rows = ones.drop("mean").join(whole, list(NODE)).selectExpr(
        *FEATURE,
        "mean",
        f"greatest((total_n - 1) * {first!r}D - (total_n - n - 1), 0D) AS threshold",
        *[f"total_{c}" for c in SUMS],
        *[f"total_{c} - {c} AS cum_{c}" for c in SUMS],
    )
    return rows.filter("threshold < 1 AND cum_n > 0")


def _deviation(n, s1, s2):
    # Below the rounding of the squared sums the spread is indistinguishable from zero.
    variance = f"{s2} / {n} - ({s1} / {n}) * ({s1} / {n})"
    return f"CASE WHEN {variance} > {s2} / {n} * 1e-14D THEN sqrt({variance}) ELSE 0D END"


MEASURES = (
    "sdr", "sd", "n", "n_left", "n_right", "mean_left", "mean_right", "sd_left", "sd_right",
)


def score(cands, params):
    """Standard-deviation reduction of each candidate that leaves enough rows per side."""
    sides = cands.selectExpr(
        *FEATURE, "mean", "threshold", "total_n AS n", "total_s1", "total_s2", "cum_n AS n_left",
        "cum_s1 AS s1_left", "cum_s2 AS s2_left", "total_n - cum_n AS n_right",
        "total_s1 - cum_s1 AS s1_right", "total_s2 - cum_s2 AS s2_right",
    )
    least = params.min_samples_leaf
    sides = sides.filter(f"n_left >= {least} AND n_right >= {least}").selectExpr(
        "*",
        _deviation("n", "total_s1", "total_s2") + " AS sd",
        _deviation("n_left", "s1_left", "s2_left") + " AS sd_left",
        _deviation("n_right", "s1_right", "s2_right") + " AS sd_right",
        "s1_left / n_left AS mean_left",
        "s1_right / n_right AS mean_right",
    )
    sdr = "sd - (n_left / n * sd_left + n_right / n * sd_right) AS sdr"
    return sides.selectExpr("*", sdr).select(*FEATURE, "threshold", *MEASURES, "mean")


def best(scored):
    """Largest reduction per node; ties go to the first feature, then the lowest threshold.

    The reduction is compared at 11 digits relative to the node's spread, so that the order
    in which partial sums were added cannot decide a tie.
    """
    rank = f"-round(sdr / greatest(sd, {FLAT!r}D), 11)"
    fields = ["'rank'", rank]
    kept = ("feature", "threshold", *MEASURES, "mean")
    fields += [part for c in kept for part in (f"'{c}'", c)]
    top = F.expr(f"min(named_struct({', '.join(fields)})) AS top")
    picked = scored.groupBy(*NODE).agg(top)
    return picked.select(*NODE, *[f"top.{c}" for c in kept])


def best_splits(located, params):
    """Accepted splits of one level: the reduction reaches the share of the node's spread."""
    sums = cut(band_sums(located), "band-sums")
    numerics = candidates(located, params, sums).drop("n")
    both = numerics.unionByName(channel_candidates(sums, params))
    found = best(score(both, params))
    return found.filter(f"sdr >= {params.min_std_reduction} * sd")
