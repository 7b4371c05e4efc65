"""Helpers the operators share: table access, Arrow tasks, state kept by a Python worker."""

import sys
import types

import pyarrow as pa
from pyspark.sql import functions as F

from cashtide.sources.tables import table

#: Rows of one Arrow batch; whole texts are processed one at a time within a batch.
BATCH_ROWS = 1000


def documents(spark, sf_dir):
    small_batches(spark)
    return table(spark, sf_dir, "documents")


def small_batches(spark):
    """Keep Arrow batches of long texts small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def in_arrow(df, task, schema):
    """Run ``task`` over the Arrow batches of each partition.

    ``task`` maps an iterator of record batches to an iterator of column dicts.
    """

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        wanted = to_arrow_schema(schema)
        for columns in task(batches):
            arrays = [as_array(columns[f.name], f.type) for f in wanted]
            yield pa.RecordBatch.from_arrays(arrays, schema=wanted)

    if isinstance(schema, str):
        from pyspark.sql.types import StructType

        schema = StructType.fromDDL(schema)
    return df.mapInArrow(run, schema)


def as_array(values, kind):
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def filter_in_arrow(docs, make_decide):
    """The rows of ``docs``, all columns kept, for which the decision on their text is true.

    ``make_decide`` runs once in each task and returns a function from UTF-8 bytes or ``None``.
    """
    # Columns travel in a struct, so that no name of theirs can clash.
    held = docs.select(F.struct("*").alias("row"), F.col("text").alias("text"))

    def run(batches):
        decide = make_decide()
        for batch in batches:
            keep = pa.array([decide(data) for data in utf8(batch.column(1))], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep)], names=["row"])

    return held.mapInArrow(run, held.select("row").schema).select("row.*")


def marked(column):
    """A column as text behind its length; null has a mark that no value gives."""
    value = F.col(column).cast("string")
    return F.coalesce(F.concat(F.length(value).cast("string"), F.lit("="), value), F.lit("-"))


def row_key(text_hash, *more):
    """One text for the hash of a row's text, its doc_id and ``more`` columns, nulls included."""
    hashed = F.col(text_hash) if isinstance(text_hash, str) else text_hash
    return F.concat_ws(":", hashed.cast("string"), *map(marked, ("doc_id", *more)))


def row_order(schema, row="row"):
    """Sort keys over all columns of the struct ``row`` but the text.

    Rows that are equal in them and in their text are the same, so any of them may be taken.
    """
    keys = []
    for field in schema:
        column = F.col(row)[field.name]
        if field.name != "text":
            plain = not any(kind in field.dataType.simpleString() for kind in ("map<", "variant"))
            keys.append(column if plain else F.to_json(F.struct(column)))
    return keys


def utf8(column):
    """The UTF-8 bytes of a string column, ``None`` for nulls."""
    for value in column.cast(pa.binary()):
        yield value.as_py()


def worker_state(name, make):
    """An object built once in each Python worker process and kept between its tasks.

    Task functions are shipped by value, so their own globals do not outlive a task. A worker
    keeps one object at a time: what the operator before has remembered goes.
    """
    home = sys.modules.setdefault("cashtide_worker_state", types.ModuleType("state"))
    if getattr(home, "name", None) != name:
        home.held = None
        pa.default_memory_pool().release_unused()
        home.held, home.name = make(), name
    return home.held


#: Longer keys are not remembered, so that a number of entries bounds the bytes they hold.
LONGEST_KEY = 32


class Memo(dict):
    """A dict that fills itself by ``make`` and starts over when it holds ``most`` entries.

    Keys are texts or bytes and values no longer than a few bytes for each of the key's, so an
    entry takes less than 400 bytes.
    """

    def __init__(self, make, most):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= LONGEST_KEY:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


def span_text(spans):
    """``kind:start:end`` of an array of span structs, joined by commas."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(
                ":", s["kind"], s["start"].cast("string"), s["end"].cast("string")
            ),
        ),
        ",",
    )
