"""Line dedup with levelled sorted runs of line hashes.

A line goes by its key, the line stripped and with A-Z lower-cased; a key is held as two seeded
64-bit hashes. A store of keys is a set of runs. Each run is a table sorted by key and dealt into the
same buckets as all others, so that a batch meets it by merging, without moving or sorting the run
again. A row is a key, the number of documents of that batch that hold it, and whether the key has
reached ``least`` documents ("found").

A batch of documents counts its keys (combined in each map task), leaves out the keys that some run
has found already (one merge anti-join a run), adds up what the runs hold of the rest (one merge a
run) and becomes a run of level 0. ``fanout`` runs of a level are compacted to one of the next, so
that there are at most ``fanout - 1`` runs of each of log(batches) levels. With ``least`` 1 a key is
found by its first document, and the anti-join leaves exactly the lines that are new.

The runs that count are listed in numbered manifests, each created only if absent: a batch that is
lost half-way leaves no trace in the store, a repeated batch number is ignored, and of two writers
one fails.

To drop lines, the keys of all lines (two numbers a line, no text) meet the found keys in a
semi-join, whose hot keys Spark splits at run time; the places to drop come back to the whole text
once. Documents with the same id and text share these places. Null text is one empty line; a line
that is empty when stripped has no key and always stays. Rows with null ids and repeated rows count as
documents of their own; an empty table gives an empty result; further columns are kept in ``row``.
"""

import json
import uuid
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from cashtide import session
from cashtide.llm.common import documents

# The least number of documents of a repeated line, and the stripped characters.
LEAST = 10
STRIPPED = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Batches that the query deals its documents into, and runs of a level until it is compacted.
BATCHES, FANOUT = 4, 3
#: Lines in one bucket, and the most buckets of a table.
BUCKET_LINES = 2_000_000
MOST_BUCKETS = 100_000
#: Seeds of the two hashes of a key.
SEEDS = (7, 1_000_003)

KEY = ["h1", "h2"]
RUN = "h1 BIGINT, h2 BIGINT, n BIGINT, found BOOLEAN"


def lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n")


def keys(text):
    """Per line of a text the hashes of its key, null for a line that is empty when stripped."""
    whole = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(whole) == F.char_length(whole)
    lowered = F.when(ascii_only, F.lower(whole)).otherwise(F.translate(whole, UPPER, LOWER))
    stripped = F.transform(F.split(lowered, "\n"), lambda s: F.btrim(s, F.lit(STRIPPED)))
    hashes = [F.lit(seed) for seed in SEEDS]
    return F.transform(
        stripped,
        lambda s: F.when(
            s != "",
            F.struct(*[F.xxhash64(h, s).alias(name) for h, name in zip(hashes, KEY, strict=True)]),
        ),
    )


def line_keys(docs):
    """Rows (doc_id, text_hash, keys) of whole documents, in place of their texts."""
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), keys(F.col("text")).alias("keys"))


def buckets_for(keyed):
    total = keyed.agg(F.sum(F.size("keys"))).first()[0] or 0
    return min(MOST_BUCKETS, max(4, -(-total // BUCKET_LINES)))


@contextmanager
def settings(spark, **wanted):
    """Session settings inside the block; those before return after it."""
    names = {name.replace("__", "."): value for name, value in wanted.items()}
    before = {name: spark.conf.get(name, None) for name in names}
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


class LineRuns:
    """A store of line keys in a shared folder."""

    def __init__(self, spark, folder, least=LEAST, buckets=64, fanout=FANOUT):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.held, self.registered = self._newest(), set()
        if self.held is None:
            self.held = {
                "version": 0, "least": least, "buckets": buckets, "fanout": fanout,
                "batch": -1, "runs": [],
            }

    # -- manifests -------------------------------------------------------------------------------

    def _newest(self):
        try:
            listed = self.spark.read.text(f"{self.folder}/manifests", wholetext=True)
            newest = listed.orderBy(F.desc(F.get_json_object("value", "$.version").cast("int"))).first()
        except AnalysisException:
            return None
        return json.loads(newest["value"]) if newest else None

    def _publish(self, runs, batch):
        held = {**self.held, "runs": runs, "batch": batch, "version": self.held["version"] + 1}
        path = self.spark._jvm.org.apache.hadoop.fs.Path(
            f"{self.folder}/manifests/{held['version']:09d}.json"
        )
        system = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        stream = system.create(path, False)  # fails when another writer was first
        stream.write(bytearray(json.dumps(held).encode()))
        stream.close()
        self.held = held

    # -- runs ------------------------------------------------------------------------------------

    def _aligned(self):
        """Shuffles deal rows like the buckets, and a bucket's order counts as sorted."""
        return settings(
            self.spark,
            spark__sql__shuffle__partitions=str(self.held["buckets"]),
            spark__sql__legacy__bucketedTableScan__outputOrdering="true",
            spark__sql__sources__bucketing__autoBucketedScan__enabled="false",
            # A union of bucketed tables does not line their buckets up; compaction must shuffle.
            spark__sql__unionOutputPartitioning="false",
        )

    def _write(self, rows, level):
        name = f"line_run_{uuid.uuid4().hex}"
        path = f"{self.folder}/runs/level-{level}/{name}"
        writer = rows.select(*KEY, "n", "found").write.bucketBy(self.held["buckets"], *KEY)
        writer.sortBy(*KEY).option("path", path).format("parquet").saveAsTable(name)
        self.registered.add(name)
        return {"name": name, "path": path, "level": level}

    def _read(self, run):
        if run["name"] not in self.registered:
            cluster = ", ".join(KEY)
            self.spark.sql(
                f"CREATE TABLE IF NOT EXISTS {run['name']} ({RUN}) USING parquet "
                f"OPTIONS (path '{run['path']}') CLUSTERED BY ({cluster}) "
                f"SORTED BY ({cluster}) INTO {self.held['buckets']} BUCKETS"
            )
            self.registered.add(run["name"])
        return self.spark.table(run["name"])

    def add(self, keyed, batch):
        """Add documents (``line_keys``) as batch number ``batch``; earlier numbers are ignored."""
        if batch <= self.held["batch"]:
            return self
        with self._aligned():
            each = keyed.select(F.explode(F.array_distinct("keys")).alias("k")).filter("k IS NOT NULL")
            rest = each.groupBy(*[F.col("k")[c].alias(c) for c in KEY]).agg(F.count(F.lit(1)).alias("n"))
            for run in self.held["runs"]:
                rest = rest.join(self._read(run).filter("found").hint("merge"), KEY, "left_anti")
            rest = rest.withColumn("total", F.col("n"))
            if self.held["least"] > 1:
                for run in self.held["runs"]:
                    held = self._read(run).filter("NOT found").select(*KEY, F.col("n").alias("held"))
                    rest = rest.join(held.hint("merge"), KEY, "left").select(
                        *KEY, "n", (F.col("total") + F.coalesce("held", F.lit(0))).alias("total")
                    )
            rest = rest.withColumn("found", F.col("total") >= self.held["least"])
            runs = [*self.held["runs"], self._write(rest, 0)]
            runs = self._compacted(runs)
        self._publish(runs, batch)
        return self

    def _compacted(self, runs):
        level = 0
        while len(same := [r for r in runs if r["level"] == level]) >= self.held["fanout"]:
            rows = self._read(same[0])
            for run in same[1:]:
                rows = rows.unionByName(self._read(run))
            merged = rows.groupBy(*KEY).agg(F.sum("n").alias("n"), F.max("found").alias("found"))
            runs = [r for r in runs if r["level"] != level] + [self._write(merged, level + 1)]
            level += 1
        return runs

    def found(self):
        """The keys held by ``least`` documents or more, each once."""
        paths = [run["path"] for run in self.held["runs"]]
        if not paths:
            return self.spark.createDataFrame([], "h1 bigint, h2 bigint")
        rows = self.spark.read.schema(RUN.lower()).parquet(*paths)
        return rows.filter("found").select(*KEY)  # a found key is left out of all later runs

    def close(self):
        """Forget the tables' names; the files stay."""
        for name in sorted(self.registered):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.registered.clear()


def places(keyed, found):
    """Per (doc_id, text_hash): the places of its lines whose key is found."""
    each = keyed.select("doc_id", "text_hash", F.posexplode("keys").alias("place", "k"))
    each = each.filter("k IS NOT NULL").select(
        "doc_id", "text_hash", "place", *[F.col("k")[c].alias(c) for c in KEY]
    )
    hit = each.join(found, KEY, "left_semi")
    return hit.groupBy("doc_id", "text_hash").agg(F.collect_set("place").alias("dropped"))


def without(text, dropped):
    """A text without the lines at some places."""
    # Both arrays are elements of one outer array, so that each is made once a row.
    both = F.struct(lines(text).alias("lines"), F.coalesce(dropped, F.array().cast("array<int>")).alias("out"))
    kept = F.transform(
        F.array(both),
        lambda t: F.array_join(
            F.transform(
                F.array_except(F.sequence(F.lit(0), F.size(t["lines"]) - 1), t["out"]),
                lambda place: F.get(t["lines"], place),
            ),
            "\n",
        ),
    )
    return F.when(dropped.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.get(kept, F.lit(0)))


def drop_lines(docs, keyed, found):
    """Rows (row, n_lines, n_dropped, kept): each document, its lines and what is left of its text."""
    rows = docs.select(
        F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash")
    )
    at = places(keyed, found)
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash"))
    text = F.col("row")["text"]
    return rows.join(at, same, "left").select(
        "row",
        F.size(lines(text)).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("bigint").alias("n_dropped"),
        without(text, F.col("dropped")).alias("kept"),
    )


def dedup_lines(docs, least=LEAST, batches=BATCHES, fanout=FANOUT):
    """``docs`` without the lines whose key at least ``least`` documents hold."""
    spark = docs.sparkSession
    path = session.fresh_dir(spark, "line-keys")
    number = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(batches))
    line_keys(docs).withColumn("batch", number).write.partitionBy("batch").parquet(path)
    keyed = spark.read.schema(
        "doc_id bigint, text_hash bigint, keys array<struct<h1: bigint, h2: bigint>>, batch bigint"
    ).parquet(path)
    store = LineRuns(spark, session.fresh_dir(spark, "line-runs"), least, buckets_for(keyed), fanout)
    for batch in range(batches):
        store.add(keyed.filter(F.col("batch") == batch), batch)
    found = store.found()
    store.close()
    return drop_lines(docs, keyed, found)


def op11_line_dedup(spark, sf_dir):
    return dedup_lines(documents(spark, sf_dir)).select(
        F.col("row.doc_id").alias("doc_id"),
        "n_lines",
        "n_dropped",
        F.sha2("kept", 256).alias("kept_sha256"),
    )


OP11_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS w
  FROM documents),
l AS (SELECT doc_id, r, unnest(w) AS line, unnest(range(len(w))) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    '{UPPER}', '{LOWER}') AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= {LEAST})
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.key IS NULL), ''))
    AS kept_sha256
FROM k LEFT JOIN f ON f.key = k.key GROUP BY r, doc_id
"""
