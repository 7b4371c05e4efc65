"""Session defaults and the shared folder for intermediate tables."""

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

_local_roots = {}


def local_session(cores="*", partitions=8, **extra):
    """A local session for tests and the bench; clusters bring their own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("cashtide")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_root(spark):
    """Folder for intermediate tables: ``spark.checkpoint.dir``, shared by all executors.

    Only a local session may fall back to a temporary folder; a cluster without the
    setting is refused, since a machine-local folder would not survive an executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="cashtide-")
    return _local_roots[app]


def fresh_dir(spark, label):
    return f"{work_root(spark)}/cashtide/{label}-{uuid.uuid4().hex}"


_scratch = []


@contextmanager
def scratch(spark):
    """Tables that ``store`` writes inside the block are removed when it ends.

    For jobs that finish inside the block: what they return must not read those tables.
    """
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            discard(spark, path)


def discard(spark, path):
    """Remove a folder of the shared file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def store(df, label, lasting=False):
    """Write ``df`` as Parquet in the shared folder; returns the path.

    A ``lasting`` table outlives the ``scratch`` block it is written in.
    """
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    if _scratch and not lasting:
        _scratch[-1].append(path)
    return path


def cut(df, label, lasting=False):
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage durably and gives the optimizer real sizes, so later joins
    broadcast a table only when the written files are below the broadcast threshold.
    """
    return df.sparkSession.read.schema(df.schema).parquet(store(df, label, lasting))
