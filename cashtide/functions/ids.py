"""Deterministic identifiers, stable when a task is retried."""

from pyspark.sql import functions as F

from cashtide.functions.clean import text


def drawn_id():
    """A random id, for rows that bring none; store the row before using it twice."""
    return F.uuid()


def hash_id(*parts):
    """UUID-shaped text from the SHA-256 of the parts."""
    columns = [F.coalesce(text(part).cast("string"), F.lit("")) for part in parts]
    digest = F.sha2(F.concat_ws("~", *columns), 256)
    return F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12}).*$", "$1-$2-$3-$4-$5")
