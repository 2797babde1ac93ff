"""Session settings and the few helpers that talk to the cluster."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Run-time settings the operators rely on. Shuffle width, memory and the
# broadcast threshold stay with whoever runs the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A customer, session or product may hold a large share of all rows: split
    # its partition in joins even when that costs one more exchange.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

# Upper bound on rows of a table that may be broadcast after counting it.
BROADCAST_ROWS = 200_000


def tune(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to an existing session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the local benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("basketcast")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; local runs may get their own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="basketcast-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage of small statistics with a checkpoint."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Have the file system remove an intermediate when the driver ends."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)


def run_folder(spark: SparkSession, kind: str) -> str:
    """A folder of this run in the shared folder, deleted when the driver ends."""
    path = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    delete_at_end(spark, path)
    return path


def store(df: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write a large intermediate once as a table in the shared folder.

    Readers prune its columns and partitions, which a checkpoint does not allow,
    and a lost executor costs no recomputation.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    delete_at_end(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table of ``store`` that is not needed any more."""
    spark = df.sparkSession
    for path in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def broadcast_if_small(df: DataFrame, rows: int | None = None, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only when the number of rows proves the table small.

    ``df`` should be materialised: without a known count it is counted, which
    then reads stored rows. Larger tables are returned unchanged, and the join
    shuffles.
    """
    if rows is None:
        rows = df.limit(max_rows + 1).count()
    return F.broadcast(df) if rows <= max_rows else df


def row_counts(df: DataFrame, label: str) -> dict[str, int]:
    """Rows per label of a materialised table with a handful of labels."""
    return {r[0]: r[1] for r in df.groupBy(label).count().collect()}


def one_row(df: DataFrame) -> Column:
    """A one-row frame as a struct column, through a scalar subquery.

    Attach it once as a column and read its fields from there: every further
    use of the subquery itself would be planned again.
    """
    return df.select(F.struct("*").alias("row")).scalar()
