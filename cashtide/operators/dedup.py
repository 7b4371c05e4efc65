"""Idempotent insert: the first row of a (account, client id) key wins."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from cashtide import session
from cashtide.functions.clean import blank_to_null

KEYS = ("account_id", "client_tx_id")
ORDER = ("event_ts", "tx_id")


def key_of(client_id="client_tx_id", row_id="tx_id"):
    """Rows with no client id are never repeats: each gets a key of its own.

    Rows with no id at all must be given one first (``ingest.draw_ids``); until then they
    share a key with nothing but refuse to be grouped.
    """
    key = F.coalesce(blank_to_null(client_id), F.concat(F.lit("row:"), F.col(row_id)))
    missing = F.raise_error(F.lit("rows without any id: apply ingest.draw_ids first"))
    return F.coalesce(key, missing.cast("string"))


def first_wins(rows):
    """Keep the earliest row per key.

    The rank filter lets Spark keep one row per key inside each map task before the
    shuffle, so a key holding a large share of the rows costs one row per task.
    """
    order = Window.partitionBy("account_id", key_of()).orderBy(*ORDER)
    ranked = rows.withColumn("_rank", F.row_number().over(order))
    return ranked.filter(F.col("_rank") == 1).drop("_rank")


def unseen(rows, seen):
    """Rows whose key is not in the stored key table; rows with no client id always pass.

    Apply it after ``first_wins``, when a key has one row left. Rows with no client id
    carry a key of their own, so they spread over all tasks.
    """
    known = seen.select("account_id", F.col("client_tx_id").alias("_key"))
    keyed = rows.withColumn("_key", key_of())
    return keyed.join(known, ["account_id", "_key"], "left_anti").drop("_key").select(rows.columns)


def winners(rows):
    """Per repeated key: the id of the first row and the number of rows."""
    first = F.min(F.struct(*ORDER))
    keyed = rows.filter(blank_to_null("client_tx_id").isNotNull())
    counted = keyed.groupBy(*KEYS).agg(first.alias("first"), F.count(F.lit(1)).alias("copies"))
    return counted.select(*KEYS, F.col("first.tx_id").alias("first_tx_id"), "copies")


def duplicates_report(rows, max_hot=10_000):
    """Every refused row with status ``duplicate`` and the id of the row that won.

    Keys holding more than 1/``max_hot`` of the repeated rows are joined by broadcast:
    at most ``max_hot`` such keys can exist, whatever the size of the table. All other
    keys go through an ordinary join.
    """
    repeated = session.cut(winners(rows).filter(F.col("copies") > 1), "repeated")
    total = repeated.agg(F.sum("copies")).scalar()
    is_hot = F.col("copies") * max_hot > total
    hot = repeated.filter(is_hot).select(*KEYS, F.col("first_tx_id").alias("hot_tx_id"))
    cold = repeated.filter(~is_hot).select(*KEYS, "first_tx_id")

    marked = rows.join(F.broadcast(hot), list(KEYS), "left")
    from_hot = marked.filter(F.col("hot_tx_id").isNotNull()).withColumnRenamed(
        "hot_tx_id", "first_tx_id"
    )
    from_cold = marked.filter(F.col("hot_tx_id").isNull()).drop("hot_tx_id")
    from_cold = from_cold.join(cold, list(KEYS))
    both = from_hot.unionByName(from_cold)
    return both.filter(F.col("tx_id") != F.col("first_tx_id")).withColumn(
        "status", F.lit("duplicate")
    )


def evidence(rows):
    """Rows against distinct client ids, counted in two exact steps."""
    per_id = rows.groupBy("client_tx_id").agg(F.count(F.lit(1)).alias("n"))
    return per_id.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.count("client_tx_id").alias("unique_ids"),
    )
