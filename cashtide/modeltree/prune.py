"""Bottom-up pruning on the node table."""

import pandas as pd
from pyspark.sql import functions as F

from cashtide.modeltree.ridge import ancestors, deepest_nodes

KEPT = "model_id bigint, node_id int, is_leaf boolean, error double"


def dot(coef, x):
    products = F.zip_with(coef, x, lambda a, b: a * b)
    return F.aggregate(products, F.lit(0.0), lambda total, v: total + v)


def absolute_errors(rows, models, effects, splits, max_depth):
    """Mean absolute residual of every node over all rows below it (for ``mae`` pruning)."""
    paths = deepest_nodes(rows, splits, max_depth).withColumn("node_id", F.explode(ancestors()))
    fitted = paths.join(
        models.select("model_id", "node_id", "coef", "intercept"), ["model_id", "node_id"]
    )
    of_channel = effects.withColumnRenamed("coef", "effect")
    fitted = fitted.join(of_channel, ["model_id", "node_id", "c"], "left")
    level = F.col("intercept") + F.coalesce("effect", F.lit(0.0))
    residual = F.abs(F.col("y") - level - dot("coef", "x"))
    return fitted.groupBy("model_id", "node_id").agg(F.avg(residual).alias("raw_error"))


def node_errors(models, params, absolute=None):
    """Training error of each node with the penalty for its number of coefficients."""
    penalty = 1 + params.pruning_factor * (F.col("used") + 1) / F.col("n")
    if absolute is not None:
        models = models.join(absolute, ["model_id", "node_id"])
        raw = F.col("raw_error")
    else:
        raw = F.col("sse") / F.col("n")
    return models.select("model_id", "node_id", "n", (raw * penalty).alias("error"))


def _collapse(nodes: pd.DataFrame) -> pd.DataFrame:
    """Turn a node into a leaf when its own error is not above that of its children."""
    error = dict(zip(nodes["node_id"], nodes["error"], strict=True))
    count = dict(zip(nodes["node_id"], nodes["n"], strict=True))
    best, leaf = dict(error), {}
    for node in sorted(error, reverse=True):
        left, right = 2 * node, 2 * node + 1
        leaf[node] = left not in error
        if not leaf[node]:
            below = (count[left] * best[left] + count[right] * best[right]) / (
                count[left] + count[right]
            )
            leaf[node] = error[node] <= below
            best[node] = error[node] if leaf[node] else below
    kept, queue = [], [1]
    while queue:
        node = queue.pop()
        kept.append(node)
        if not leaf[node]:
            queue += [2 * node, 2 * node + 1]
    return pd.DataFrame(
        {
            "model_id": nodes["model_id"].iloc[0],
            "node_id": kept,
            "is_leaf": [leaf[k] for k in kept],
            "error": [best[k] for k in kept],
        }
    )


def prune(errors):
    """Nodes that stay. A group is one tree: at most 2^(max_depth + 1) - 1 rows."""
    return errors.groupBy("model_id").applyInPandas(_collapse, KEPT)


def keep_all(errors):
    """The unpruned tree in the same form."""
    parents = errors.filter(F.col("node_id") > 1).select(
        "model_id", F.floor(F.col("node_id") / 2).cast("int").alias("node_id")
    )
    inner = parents.distinct().withColumn("_inner", F.lit(True))
    joined = errors.join(inner, ["model_id", "node_id"], "left")
    return joined.select(
        "model_id", "node_id", F.col("_inner").isNull().alias("is_leaf"), "error"
    )
