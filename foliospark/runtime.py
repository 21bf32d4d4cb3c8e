"""Session helpers: shared storage for cut lineage, and joins whose broadcast side is measured first."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if its files have at most so many bytes and, counted, so many rows.
BROADCAST_BYTES = 16 << 20
BROADCAST_ROWS = 200_000
#: Paths of this process's materialized tables.
TABLES: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. A local session that names none gets one until the process ends; a cluster must name one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="foliospark-")
    atexit.register(shutil.rmtree, path, True)
    spark.sparkContext.setCheckpointDir(path)
    return path


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder; a session that has ended leaves its folder to whoever set it."""
    try:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.sc().hadoopConfiguration()).delete(place, True)
    except Exception:  # noqa: BLE001 - at the end of a session there may be no JVM any more
        pass


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there and survives lost executors.

    The tables of a session are deleted by release(), or when the process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not TABLES:
        atexit.register(release, spark)
    TABLES.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete all tables that were materialized so far: for when the results that read them are written."""
    while TABLES:
        drop_table(spark, TABLES.pop())


def size_of(df: DataFrame) -> int:
    """Bytes of a materialized table's files, as the plan knows them without a job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def measured_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a materialized small side: broadcast if its files have at most BROADCAST_BYTES and `rows` rows, else a shuffled join (AQE splits skew)."""
    if size_of(small) <= BROADCAST_BYTES and small.limit(rows + 1).count() <= rows:
        return big.join(F.broadcast(small), on, how)
    return big.join(small.hint("merge"), on, how)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Rows over all shuffle partitions by columns, before work that costs far more than its bytes show (which AQE would join into few tasks)."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)
