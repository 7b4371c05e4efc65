"""Ridge regression in every node from additive Gram sums, without a matrix as wide as the channels.

A row's vector is its numerics and one 0/1 entry per channel, so the Gram matrix has a dense block
of numerics, a diagonal one of channels, and between them the sums of the numerics in each channel.
The dense block is one aggregation of packed triangle sums per deepest node, the rest one small row
per (node, channel); rows are dealt by model, so both combine inside the task that reads them. Sums
are taken once at the deepest nodes and added up the tree.

The diagonal block is eliminated by sums over a node's channels (its Schur complement), which leaves
a system as wide as the numerics; all systems of a batch are solved at once. The coefficient of each
channel then follows from its own sums. Centring costs no precision: the channels' centred sums
add up to zero, which takes the intercept out of their block in closed form.
"""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from cashtide.modeltree.grow import route, split_cells
from cashtide.modeltree.params import FLAT
from cashtide.modeltree.prep import WIDTH
from cashtide.session import cut

KEYS = ["model_id", "node_id"]
PAIRS = [(i, j) for i in range(WIDTH) for j in range(i, WIDTH)]


def deepest_nodes(rows, splits, max_depth):
    """Rows with the leaf they reach in the unpruned tree."""
    if splits is None:
        return rows.withColumn("node_id", F.lit(1))
    # A model without splits has no row here: its null array routes every row to the root.
    joined = rows.join(split_cells(splits), "model_id", "left")
    return joined.withColumn("node_id", route("splits", "x", "c", max_depth)).drop("splits")


def ancestors(node="node_id"):
    """The node and all nodes above it up to the root."""
    levels = F.floor(F.log2(F.col(node))).cast("int")
    return F.transform(
        F.sequence(F.lit(0), levels),
        lambda up: F.call_function("shiftright", F.col(node), up).cast("int"),
    )


def _summed(rows, keys, sums, least=(), most=()):
    aggs = [f"sum({c}) AS {c}" for c in sums]
    aggs += [f"min({c}) AS {c}" for c in least] + [f"max({c}) AS {c}" for c in most]
    return rows.groupBy(*keys).agg(*map(F.expr, aggs))


def _of_numerics(pattern):
    """A piece of SQL for each numeric; ``#`` stands for its number."""
    return [pattern.replace("#", str(i)) for i in range(WIDTH)]


def _listed(pattern):
    return f"array({', '.join(_of_numerics(pattern))})"


GRAM = {"n": "1", "sy": "y", "syy": "y * y"}
GRAM |= {f"x{i}": f"get(x, {i})" for i in range(WIDTH)}
GRAM |= {f"xy{i}": f"get(x, {i}) * y" for i in range(WIDTH)}
GRAM |= {f"x{i}x{j}": f"get(x, {i}) * get(x, {j})" for i, j in PAIRS}
LOW = {f"low{i}": f"get(x, {i})" for i in range(WIDTH)}
HIGH = {f"high{i}": f"get(x, {i})" for i in range(WIDTH)}
HOT = {"cn": "1", "cy": "y"} | {f"c{i}": f"get(x, {i})" for i in range(WIDTH)}


def gram_sums(leaves):
    """Per node, inner ones included: sums of 1, y, y^2, x, xy and the triangle of xx, and limits."""
    cells = leaves.selectExpr(*KEYS, *[f"{v} AS {k}" for k, v in (GRAM | LOW | HIGH).items()])
    per_leaf = _summed(cells, KEYS, GRAM, LOW, HIGH)
    return _summed(per_leaf.withColumn("node_id", F.explode(ancestors())), KEYS, GRAM, LOW, HIGH)


def channel_sums(leaves):
    """Per node and channel: rows, sum of y and of each numeric."""
    cells = leaves.filter("c IS NOT NULL").selectExpr(
        *KEYS, "c", *[f"{v} AS {k}" for k, v in HOT.items()]
    ).withColumnRenamed("c", "channel")
    keys = [*KEYS, "channel"]
    per_leaf = _summed(cells, keys, HOT)
    paths = per_leaf.withColumn("node_id", F.explode(ancestors()))
    return _summed(paths, keys, HOT).withColumnRenamed("channel", "c")


def centred_channels(grams, hot, alpha):
    """Per node and channel: its centred products with y (``b``) and each numeric (``b0`` ...), and
    its diagonal entry ``d``. A channel that all rows share does not vary and is left out."""
    rows = hot.join(grams.select(*KEYS, "n", "sy", *_of_numerics("x#")), KEYS)
    return rows.filter("cn < n").selectExpr(
        *KEYS, "c", "cn", "cy - sy * (cn / n) AS b", f"cn + {alpha!r}D AS d",
        *_of_numerics("c# - x# * (cn / n) AS b#"),
    )


def eliminated(channels):
    """Per node the sums over channels that take their block out of the system."""
    pairs = ", ".join(f"sum(b{i} * b{j} / d)" for i, j in PAIRS)
    sums = (
        f"array({pairs}) AS bb", f"{_listed('sum(b# * b / d)')} AS `by`", f"{_listed('sum(b# / d)')} AS m",
        "sum(b / d) AS e", "sum(cn / d) AS g", "count(1) AS k",
    )
    return channels.groupBy(*KEYS).agg(*map(F.expr, sums))


SOLUTION = "coef array<double>, used int, gamma double, gain double"


def solver(alpha):
    """Coefficients of the numerics of many nodes at once.

    ``gamma`` is what each channel's coefficient owes to the shared intercept; ``gain`` is what
    the numerics take from the squared error.
    """

    def square(packed):
        full = np.zeros((len(packed), WIDTH, WIDTH))
        rows, columns = np.triu_indices(WIDTH)
        full[:, rows, columns] = packed
        full[:, columns, rows] = packed
        return full

    @F.pandas_udf(SOLUTION)
    def solve(sums: pd.Series) -> pd.DataFrame:
        held = np.array(sums.tolist(), float)
        parts, at = [], 0
        for size in (1, 1, WIDTH, WIDTH, len(PAIRS), WIDTH, WIDTH, len(PAIRS), WIDTH, WIDTH, 1, 1, 1):
            parts.append(held[:, at : at + size])
            at += size
        n, sy, sx, sxy, sxx, low, high, bb, by, m, e, g, k = parts
        varies = high - low > 2 * FLAT
        used = varies.sum(1) + k[:, 0]
        fits = (used > 0) & (n[:, 0] >= used + 1)
        share = np.where(k > 0, alpha / np.where(g > 0, g, 1), 0)  # (1, 1) without channels
        gram = square(sxx) - sx[:, :, None] * sx[:, None, :] / n[:, :, None]
        gram -= square(bb) + share[:, :, None] * m[:, :, None] * m[:, None, :]
        plain = sxy - sx * sy / n
        right = np.where(varies, plain - by - share * m * e, 0)
        both = varies[:, :, None] & varies[:, None, :]
        eye = np.eye(WIDTH)
        gram = np.where(both, gram + alpha * eye, eye)
        coef = np.linalg.solve(gram, right[:, :, None])[:, :, 0] * fits[:, None]
        gamma = np.where(k[:, 0] > 0, (e[:, 0] - (m * coef).sum(1)) / np.where(g[:, 0] > 0, g[:, 0], 1), 0)
        gain = (coef * plain).sum(1) + alpha * (coef**2).sum(1)
        return pd.DataFrame(
            {"coef": list(coef), "used": np.where(fits, used, 0).astype(int), "gamma": gamma, "gain": gain}
        )

    return solve


def node_models(rows, splits, params):
    """Ridge models of every node, targets still centred on the model mean.

    Returns the nodes with the coefficients of their numerics, and (model_id, node_id, c, coef)
    with those of their channels.
    """
    alpha = params.ridge_alpha
    leaves = deepest_nodes(rows, splits, params.max_depth)
    grams = cut(gram_sums(leaves), "gram-sums")
    channels = cut(centred_channels(grams, channel_sums(leaves), alpha), "channel-sums")

    def array(name, size):
        return f"coalesce({name}, array_repeat(0D, {size}))"

    triangle = ", ".join(f"x{i}x{j}" for i, j in PAIRS)
    sums = (
        "array(double(n), sy)", _listed("x#"), _listed("xy#"), f"array({triangle})", _listed("low#"),
        _listed("high#"), array("bb", len(PAIRS)), array("`by`", WIDTH), array("m", WIDTH),
        "array(coalesce(e, 0D), coalesce(g, 0D), double(coalesce(k, 0)))",
    )
    joined = grams.join(eliminated(channels), KEYS, "left")
    solved = joined.withColumn("fit", solver(alpha)(F.expr(f"concat({', '.join(sums)})"))).selectExpr(
        *KEYS, "n", "sy", "syy - sy * sy / n AS total",
        " + ".join(_of_numerics("get(fit.coef, #) * x#")) + " AS fitted", "fit.*",
    )
    left = " - ".join(["b", *_of_numerics("b# * get(coef, #)")])
    held = channels.join(solved.filter("used > 0").select(*KEYS, "coef", "gamma"), KEYS)
    effects = cut(
        held.selectExpr(*KEYS, "c", "cn", "b", f"({left} - gamma * cn) / d AS coef"),
        "channel-coefficients",
    )
    gains = effects.groupBy(*KEYS).agg(
        F.expr("sum(coef * cn) AS hot_fitted"),
        F.expr(f"sum(coef * b + {alpha!r}D * coef * coef) AS hot_gain"),
    )
    models = solved.join(gains, KEYS, "left").selectExpr(
        *KEYS, "coef", "(sy - fitted - coalesce(hot_fitted, 0D)) / n AS intercept", "used",
        "bigint(n) AS n", "greatest(total - gain - coalesce(hot_gain, 0D), 0D) AS sse",
    )
    return models, effects.select(*KEYS, "c", "coef")
