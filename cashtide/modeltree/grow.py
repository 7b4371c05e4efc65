"""Level-by-level growth of all trees at once.

Nodes are numbered like a heap: root 1, children 2i and 2i + 1. Rows never store their
node: each level routes them through the splits found so far, which are one small row per
model. Only split tables are written between levels, so an executor loss costs one level.
"""

from pyspark.sql import functions as F

from cashtide.modeltree.params import FLAT
from cashtide.modeltree.prep import WIDTH
from cashtide.modeltree.split import best_splits
from cashtide.session import cut, store


def by_node(rows, fields, name, keys=("model_id",)):
    """One row per model with an array of structs indexed by node number (null = absent)."""
    cell = ", ".join(f"'{f}', {f}" for f in fields)
    per_model = rows.groupBy(*keys).agg(
        F.expr(
            f"map_from_entries(collect_list(struct(node_id, named_struct({cell})))) AS _entries"
        ),
        F.expr("max(node_id) AS _last"),
    )
    cells = f"transform(sequence(1, _last), i -> _entries[i]) AS {name}"
    return per_model.selectExpr(*keys, cells)


def route(cells, x, c, max_depth):
    """Node reached from the root (``x <= threshold`` goes left); stops where no split is.

    A feature beyond the numerics is 1 for the rows of its channel ``c`` and 0 for all others.
    """
    cell = f"get({cells}, node - 1)"
    value = (
        f"CASE WHEN {cell}.feature < {WIDTH} THEN get({x}, {cell}.feature) "
        f"ELSE double({c} <=> {cell}.feature - {WIDTH}) END"
    )
    step = (
        f"CASE WHEN {cell}.feature IS NULL THEN node "
        f"WHEN {value} <= {cell}.threshold THEN node * 2 ELSE node * 2 + 1 END"
    )
    return F.expr(f"aggregate(sequence(1, {max_depth}), 1, (node, i) -> {step})")


def split_cells(splits):
    return by_node(splits, ("feature", "threshold"), "splits")


def locate(rows, frontier, splits, max_depth):
    """Rows lying in a frontier node, with the target centred on that node's mean.

    Splits and frontier are gathered in one array per model, joined to the rows by a
    broadcast while it is small.
    """
    fields = ("feature", "threshold", "mean")
    cells = frontier.selectExpr(
        "model_id", "node_id", "int(null) AS feature", "double(null) AS threshold", "mean"
    )
    if splits is not None:
        inner = ("model_id", "node_id", "feature", "threshold", "double(null) AS mean")
        cells = cells.unionByName(splits.selectExpr(*inner))
    state = cut(by_node(cells, fields, "cells"), "tree-cells")
    joined = rows.join(state, "model_id").withColumn("node_id", route("cells", "x", "c", max_depth))
    placed = joined.selectExpr(
        "model_id", "node_id", "y", "x", "c", "b", "get(cells, node_id - 1).mean AS _mean"
    )
    return placed.filter("_mean IS NOT NULL").selectExpr(
        "model_id", "node_id", "y - _mean AS y", "x", "c", "b", "_mean AS mean"
    )


def root_nodes(prep):
    """Targets are stored centred on the model mean, so the root mean is 0."""
    return prep.select(
        "model_id",
        F.lit(1).alias("node_id"),
        "n",
        F.lit(0.0).alias("mean"),
        F.col("y_sd").alias("sd"),
    )


def child_nodes(splits):
    """Both children of each split, with count, mean and spread."""

    def child(side, offset):
        return (
            f"struct(node_id * 2 + {offset} AS node_id, n_{side} AS n, "
            f"mean + mean_{side} AS mean, sd_{side} AS sd)"
        )

    return splits.selectExpr(
        "model_id", f"inline(array({child('left', 0)}, {child('right', 1)}))"
    )


def growable(nodes, params):
    return nodes.filter(f"n >= {2 * params.min_samples_leaf} AND sd >= {FLAT!r}D")


def grow(rows, prep, params):
    """All nodes and all splits of every model.

    The loop runs at most ``max_depth`` times, whatever the number of models or rows. The
    only value the driver sees per level is whether a split was found.
    """
    spark = rows.sparkSession
    frontier, splits, paths = root_nodes(prep), None, []
    for depth in range(params.max_depth):
        frontier = growable(frontier, params)
        located = locate(rows, frontier, splits, params.max_depth)
        best = best_splits(located, params)
        paths.append(store(best, f"splits-{depth}"))
        found = spark.read.schema(best.schema).parquet(paths[-1])
        if found.isEmpty():
            break
        splits = spark.read.schema(best.schema).parquet(*paths)
        frontier = child_nodes(found)
    nodes = root_nodes(prep)
    if splits is not None:
        nodes = nodes.unionByName(child_nodes(splits))
    return nodes, splits
