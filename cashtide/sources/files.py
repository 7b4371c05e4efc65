"""File readers and writers: CSV, JSON payloads, partitioned Parquet tables."""

from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from cashtide import session
from cashtide.schemas import API_CALLS, DAILY_STAGING, LEDGER, PAYLOAD


def _exists(spark, uri):
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def read_daily_csv(spark, uri, schema=DAILY_STAGING):
    """Daily staging CSV with a header, on any Hadoop URI; no inference pass."""
    return spark.read.schema(schema).option("header", True).csv(uri)


def write_csv(df, uri):
    """CSV export with a header, one file per task."""
    df.write.mode("errorifexists").option("header", True).csv(uri)


def preview(df, order, n=5):
    """First ``n`` rows in a stated order."""
    return df.orderBy(*order).limit(n)


#: Payloads with the text of each line that does not parse, null for all others.
PAYLOAD_LINES = StructType([*PAYLOAD, StructField("raw_line", StringType())])


def payload_lines(reader):
    """A JSON reader, of a batch or a stream, that keeps the text of unreadable lines."""
    return reader.schema(PAYLOAD_LINES).option("columnNameOfCorruptRecord", "raw_line")


def read_payloads(spark, uri):
    """Bulk payloads, one JSON object per line; a line that does not parse is kept as text."""
    return payload_lines(spark.read).json(uri)


def append_ledger(ledger, uri, mode="append"):
    """Ledger table by day, sorted by account so that row groups can be skipped.

    Each row group carries a bloom filter of its ids, as large as they need, so that a lookup by
    id alone reads the few groups that may hold it. The rebalance hint lets AQE split a busy day over several tasks and merge quiet days,
    so files come out near the advisory size whatever the skew between days.
    """
    by_day = ledger.hint("rebalance", F.col("event_date"))
    ordered = by_day.sortWithinPartitions(
        "event_date", "account_id", F.col("event_ts").desc(), "tx_id"
    )
    writer = ordered.write.mode(mode).partitionBy("event_date")
    writer = writer.option("parquet.bloom.filter.enabled#tx_id", "true")
    writer.option("parquet.bloom.filter.adaptive.enabled", "true").parquet(uri)


def read_ledger(spark, uri):
    return spark.read.schema(LEDGER).parquet(uri).select(*LEDGER.fieldNames())


def append_rejects(rejected, uri, mode="append"):
    """Refused rows with their reason; maps are stored as JSON text."""
    plain = {c: F.to_json(c) for c, kind in rejected.dtypes if kind.startswith("map")}
    rejected.withColumns(plain).write.mode(mode).parquet(uri)


def write_daily(daily, uri):
    """Replace exactly the dates present in ``daily``; all others stay untouched.

    Files lie by month. Of the months that ``daily`` touches, the stored dates it does not
    bring are read first and written again with it.
    """
    daily = daily.withColumn("part", F.trunc("date", "MM"))
    spark = daily.sparkSession
    with session.scratch(spark):
        if _exists(spark, uri):
            stored = spark.read.parquet(uri)
            kept = stored.join(daily.select("part").distinct(), "part", "left_semi").join(
                daily.select("date").distinct(), "date", "left_anti"
            )
            daily = daily.unionByName(session.cut(kept, "kept-days"), allowMissingColumns=True)
        (
            daily.hint("rebalance", F.col("part"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("part")
            .parquet(uri)
        )


def read_daily(spark, uri):
    return spark.read.parquet(uri).drop("part")


def api_call_rows(calls):
    """API log rows: the day falls back to the date of ``ts``, status is an integer."""
    return calls.select(
        F.coalesce("day", F.to_date("ts")).alias("day"),
        "ts",
        "endpoint",
        "method",
        F.col("status").try_cast("int").alias("status"),
        "account_id",
        "client_ip",
        "extra_json",
    )


def append_api_calls(calls, uri):
    api_call_rows(calls).write.mode("append").partitionBy("day").parquet(uri)


def read_api_calls(spark, uri):
    return spark.read.schema(API_CALLS).parquet(uri)
