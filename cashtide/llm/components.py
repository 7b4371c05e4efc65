"""Connected components by least labels with pointer jumping.

Each round gives every node the least label among its neighbours, then replaces labels by
their own labels, so that long chains halve. Rounds are written tables; a lost executor costs one
round at most.
"""

from pyspark.sql import functions as F

from cashtide import session


def components(edges):
    """Rows (node, root) for every node of ``edges`` (a, b); ``root`` is the component's least node."""
    both = edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b")
    held = session.cut(
        both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root")),
        "labels",
    )
    while not held.isEmpty():
        seen = held.select(F.col("node").alias("b"), F.col("root").alias("near"))
        nearest = both.join(seen, "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        lower = held.join(nearest, "node").select(
            "node", F.col("root").alias("old"), F.least("root", "near").alias("root")
        )
        above = held.select(F.col("node").alias("root"), F.col("root").alias("top"))
        jumped = lower.join(above, "root", "left").select(
            "node", "old", F.least("root", F.coalesce("top", "root")).alias("root")
        )
        found = session.cut(jumped, "labels")
        held = found.drop("old")
        if found.filter("old <> root").isEmpty():
            break
    return held
