"""Exact order statistics of groups of any size.

Values are first counted per (group, value). Running counts are then taken inside value
bands, and bands are offset by the totals of the bands below them. A group's band limits are
approximate percentiles of its own values, so bands hold about as many values each however
close together these lie; results are exact whatever the limits. A group holding a third of
the table is thus sorted by many tasks, one per band, and no row is dropped.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

BANDS = 256


def with_bands(rows, group, value):
    """Add ``_band``: how many of its group's limits lie below a value."""
    shares = F.array(*[F.lit(i / BANDS) for i in range(1, BANDS)])
    limits = rows.groupBy(*group).agg(
        F.array_distinct(F.percentile_approx(value, shares, F.lit(4 * BANDS))).alias("_limits")
    )
    keys = [F.col(f"_g{i}").eqNullSafe(F.col(c)) for i, c in enumerate(group)]
    named = limits.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], "_limits")
    below = F.size(F.filter("_limits", lambda limit: limit < F.col(value)))
    return rows.join(named, keys).select(*rows.columns, below.alias("_band"))


def running_totals(rows, group, value, sums=()):
    """Distinct values of each group with running totals.

    ``rows`` holds one row per (group, value) with the columns ``n`` and ``sums``. Adds
    ``cum_<c>`` (inclusive) and ``total_<c>`` per column, and ``next``: the value and
    columns of the next larger value.
    """
    group, columns = list(group), ["n", *sums]
    start, end, here = Window.unboundedPreceding, Window.unboundedFollowing, Window.currentRow
    this = F.struct(value, *columns)
    rows = with_bands(rows, group, value)
    bands = rows.groupBy(*group, "_band").agg(
        *[F.sum(c).alias(f"_{c}") for c in columns], F.min(this).alias("_lowest")
    )
    by_band = Window.partitionBy(*group).orderBy("_band")
    below, whole = by_band.rowsBetween(start, -1), by_band.rowsBetween(start, end)
    offsets = {
        f"_below_{c}": F.coalesce(F.sum(f"_{c}").over(below), F.lit(0)) for c in columns
    }
    offsets |= {f"total_{c}": F.sum(f"_{c}").over(whole) for c in columns}
    offsets["_next_band"] = F.lead("_lowest").over(by_band)
    bands = bands.withColumns(offsets).drop("_lowest", *[f"_{c}" for c in columns])

    inside = Window.partitionBy(*group, "_band").orderBy(value)
    new = {f"_in_{c}": F.sum(c).over(inside.rowsBetween(start, here)) for c in columns}
    new["_next_in"] = F.lead(this).over(inside)
    joined = rows.withColumns(new).join(bands, [*group, "_band"])
    final = {f"cum_{c}": F.col(f"_in_{c}") + F.col(f"_below_{c}") for c in columns}
    final["next"] = F.coalesce("_next_in", "_next_band")
    helpers = ["_band", "_next_in", "_next_band"]
    helpers += [f"_in_{c}" for c in columns] + [f"_below_{c}" for c in columns]
    return joined.withColumns(final).drop(*helpers)


def counted_values(rows, group, value):
    """Distinct values of each group with their number of rows."""
    return rows.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))


def nearest_rank(rows, group, value, q):
    """The value at position floor(q * n) of each sorted group (at least the first)."""
    known = rows.filter(F.col(value).isNotNull())
    return rank_of_counted(counted_values(known, group, value), group, value, q)


def rank_of_counted(counted, group, value, q):
    """As ``nearest_rank``, of values that are counted already."""
    group = list(group)
    ranked = running_totals(counted, group, value)
    position = F.greatest(F.floor(F.col("total_n") * F.lit(q)), F.lit(1))
    hit = (F.col("cum_n") >= position) & (F.col("cum_n") - F.col("n") < position)
    return ranked.filter(hit).select(*group, value)
