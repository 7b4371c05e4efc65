"""Transaction streams: ingest, de-duplication, daily roll-up, balances, KPIs, API log.

All jobs use the column functions of the batch operators. Aggregates run in update mode
without a watermark, so a row for any old day is accepted; their state is one row per
(series, day), per account or per key. Each micro-batch hands over absolute totals of the keys it
touched, stored as a version. Commits name the versions that count, a bounded number of them: a
stream merges them when they get many, and a merge from outside and a running stream leave each
other's versions in place. Readers take the newest version of each key.
"""

import uuid
from contextlib import contextmanager

from pyspark.sql import functions as F

from cashtide import session
from cashtide.operators import ingest
from cashtide.operators.dedup import KEYS, key_of
from cashtide.schemas import LEDGER
from cashtide.sources import commits, files


PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Versions that readers merge at most, before a stream merges them into one.
MOST_LIVE = 8


def use_rocksdb(spark):
    """Keep stream state on disk with RocksDB, for key sets larger than executor memory."""
    spark.conf.set(PROVIDER, ROCKSDB)


@contextmanager
def on_rocksdb(spark):
    """Streams started inside the block keep their state in RocksDB."""
    before = spark.conf.get(PROVIDER, None)
    use_rocksdb(spark)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def payload_stream(spark, uri, files_per_trigger=None):
    """Payload files (JSON lines) as a stream; each file is consumed once and unreadable lines
    are kept as text."""
    reader = files.payload_lines(spark.readStream)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(uri)


def table_stream(spark, sf_dir, name, files_per_trigger=None):
    """One Parquet table of a folder as a stream."""
    schema = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(sf_dir)


def dedup(payloads, delay):
    """First arrival per (account, client id) with bounded state: keys are kept for ``delay``
    behind the newest event. ``ingest_batches`` remembers keys for ever."""
    rows = ingest.normalize_payload(ingest.draw_ids(payloads))
    return rows.withWatermark("event_ts", delay).dropDuplicatesWithinWatermark(list(KEYS))


def first_arrivals(payloads):
    """Per key the payload that came first, and whether the batch brought the key.

    Keys are remembered for ever as keyed state: a batch looks up its own keys, whatever the
    number of keys seen before. Of the rows that bring a key in one batch the first by
    (event_ts, tx_id) wins. The arrival is the batch's own time, so a replayed batch gives the
    same rows.
    """
    names = payloads.columns
    rows = ingest.draw_ids(payloads).select(F.struct(*names).alias("payload"))
    keyed = ingest.normalize_payload(rows.select("payload", "payload.*")).select(
        "payload", "account_id", key_of().alias("key"), "event_ts", "tx_id",
        F.current_timestamp().alias("arrival"),
    )
    order = F.struct("arrival", "event_ts", "tx_id")
    held = keyed.groupBy("account_id", "key").agg(
        F.min_by("payload", order).alias("payload"),
        F.min("arrival").alias("first"),
        F.max("arrival").alias("last"),
    )
    return held.select("payload.*", (F.col("first") == F.col("last")).alias("is_new"))


def ingest_batches(payloads, uri, checkpoint):
    """Payloads to the ledger, through the same steps as the batch ingest.

    Each micro-batch drops rows whose key has come before, and writes the legs it
    accepts under ``uri/ledger``, those it refuses, with their reason and the text of
    unreadable lines, under ``uri/rejects`` and its keys under ``uri/keys``. A replayed batch
    overwrites its own parts.
    """

    def write(batch, batch_id):
        spark = batch.sparkSession
        with session.scratch(spark):
            rows = session.cut(batch.filter("is_new").drop("is_new"), "stream-batch")
            rows = ingest.normalize_payload(rows)
            keys = rows.select(
                "account_id", "client_tx_id", "tx_id", F.col("event_ts").alias("created_at")
            )
            legs = ingest.classify(ingest.split_transfers(rows))
            part = f"batch={batch_id}"
            files.append_ledger(
                ingest.to_ledger(ingest.accepted(legs)), f"{uri}/ledger/{part}", "overwrite"
            )
            files.append_rejects(ingest.rejected(legs), f"{uri}/rejects/{part}", "overwrite")
            keys.write.mode("overwrite").parquet(f"{uri}/keys/{part}")

    with on_rocksdb(payloads.sparkSession):
        stream = first_arrivals(payloads).writeStream.outputMode("update")
        return _run(stream.foreachBatch(write), checkpoint)


def _parts(spark, uri, name, wanted):
    """Folders ``name=<number>`` below ``uri`` whose number is wanted."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        return []
    found = [s.getPath() for s in system.listStatus(path)]
    numbers = {str(p.getName()): str(p.toString()) for p in found}
    return sorted(
        p for n, p in numbers.items() if n.startswith(f"{name}=") and wanted(int(n.split("=")[1]))
    )


def ledger_stream(spark, uri, files_per_trigger=None):
    """The ledger that ``ingest_batches`` writes, as a stream of decoded rows."""
    reader = spark.readStream.schema(LEDGER)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    rows = reader.parquet(f"{uri}/ledger").select(*LEDGER.fieldNames())
    return ingest.decode_ledger(rows)


def cash_rows(ledger):
    """Ledger rows with direction, VND amount and channel."""
    return ingest.classify(ledger)


def daily_totals(ledger, series_keys=()):
    """Totals per UTC calendar day, as a tumbling one-day window."""
    rows = ingest.split_in_out(cash_rows(ledger))
    day = F.window("event_ts", "1 day")
    totals = rows.groupBy(*series_keys, day.alias("_day")).agg(
        F.sum("cash_in").cast("decimal(38,2)").alias("cash_in"),
        F.sum("cash_out").cast("decimal(38,2)").alias("cash_out"),
        F.count(F.lit(1)).alias("transaction_count"),
    )
    return totals.withColumn("date", F.to_date("_day.start")).drop("_day")


def account_totals(ledger):
    """Current balance and last update per account."""
    signed = F.when(F.col("cash_direction") == "cash_in", F.col("amount_vnd")).otherwise(
        -F.col("amount_vnd")
    )
    return cash_rows(ledger).groupBy("account_id").agg(
        F.sum(signed).cast("decimal(38,2)").alias("balance"),
        F.max("event_ts").alias("updated_at"),
    )


def kpi_totals(kpis):
    """Newest value per (event_date, metric)."""
    newest = F.max(F.struct("updated_at", "value")).alias("newest")
    picked = kpis.groupBy("event_date", "metric").agg(newest)
    return picked.select("event_date", "metric", "newest.value", "newest.updated_at")


def _run(writer, checkpoint, wait=True):
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    if wait:
        query.awaitTermination()
    return query


def append(stream, uri, checkpoint, partition_by):
    """Exactly-once append to a partitioned Parquet table; consumes what is available."""
    writer = stream.writeStream.format("parquet").outputMode("append")
    return _run(writer.partitionBy(partition_by).option("path", uri), checkpoint)


def append_versions(stream, uri, checkpoint, keys=None):
    """Keep each micro-batch as a version; a replayed batch takes the place of its own version.

    A version holds only the keys its batch touched, with their new totals. Versions carry on
    from the highest one there, so a new checkpoint on an old folder overwrites nothing. With
    ``keys``, versions are merged whenever there are more than ``MOST_LIVE``.
    """
    spark = stream.sparkSession
    state = _parts(spark, checkpoint, "offset", lambda n: True)
    held = commits.newest(spark, uri)[1] or {"last": -1}
    base = int(state[0].rsplit("=", 1)[1]) if state else 1 + held["last"]
    if not state:
        # The offset belongs to the checkpoint: its batches keep their numbers on a restart.
        spark.range(0).write.parquet(f"{checkpoint}/offset={base}")

    def write(batch, batch_id):
        version = {"version": base + batch_id, "path": _store_version(batch, uri)}

        def added(old):
            live = [v for v in _live(old) if v["version"] != version["version"]]
            return _manifest(old, [*live, version])

        now = commits.update(spark, uri, added)
        if keys and len(now["live"]) > MOST_LIVE:
            compact(spark, uri, keys)

    return _run(stream.writeStream.outputMode("update").foreachBatch(write), checkpoint)


def _store_version(rows, uri):
    path = f"{uri}/versions/{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return path


def _live(state):
    return (state or {}).get("live", [])


def _manifest(old, live):
    last = max([v["version"] for v in live] + [(old or {}).get("last", -1)])
    return {"live": live, "last": last}


def _merged(spark, live, keys):
    """Newest row of every key in some versions."""
    rows = None
    for held in live:
        each = spark.read.parquet(held["path"]).withColumn("version", F.lit(held["version"]))
        rows = each if rows is None else rows.unionByName(each)
    values = [c for c in rows.columns if c not in keys and c != "version"]
    newest = F.max(F.struct("version", *values)).alias("newest")
    return rows.groupBy(*keys).agg(newest).select(*keys, *[f"newest.{c}" for c in values])


def newest_versions(spark, uri, keys, schema=None):
    """Newest version of every key; an empty table of ``schema`` when none was written."""
    live = _live(commits.newest(spark, uri)[1])
    if not live:
        if schema is None:
            raise ValueError(f"nothing was written to {uri}; pass the schema of its rows")
        return spark.createDataFrame([], schema)
    return _merged(spark, live, keys)


def compact(spark, uri, keys):
    """Merge the versions that count now into one; a stream may go on writing meanwhile.

    Versions that the stream adds before the merge is committed stay beside it. Files that no
    commit names any more stay until ``vacuum``, for readers that began before.
    """
    live = _live(commits.newest(spark, uri)[1])
    if len(live) < 2:
        return
    whole = {
        "version": max(v["version"] for v in live),
        "path": _store_version(_merged(spark, live, keys), uri),
    }
    gone = {v["path"] for v in live}

    def merged(old):
        if not gone <= {v["path"] for v in _live(old)}:
            return old  # another merge was first
        return _manifest(old, [whole, *[v for v in _live(old) if v["path"] not in gone]])

    commits.update(spark, uri, merged)


def vacuum(spark, uri):
    """Remove versions that no longer count; for times when neither readers nor writers run."""
    live = {v["path"].rsplit("/", 1)[1] for v in _live(commits.newest(spark, uri)[1])}
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{uri}/versions")
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in system.listStatus(path) if system.exists(path) else []:
        if str(status.getPath().getName()) not in live:
            system.delete(status.getPath(), True)


def append_api_calls(calls, uri, checkpoint):
    return append(files.api_call_rows(calls), uri, checkpoint, "day")
