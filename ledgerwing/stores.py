"""Tables written to the folder that driver and executors share, and keys with very many rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key counts as heavy beyond this share of all rows (and beyond ``LIGHT`` rows), so
#: fewer than ``SHARE`` keys can be heavy, whatever the data.
SHARE, LIGHT = 10_000, 500
#: Rows for each of which a large shuffle has a partition, and the bytes up to which small ones are put together: rows of a few
#: numbers compress to some 5 bytes, so the session's own size may hold far more of them than a task has memory for.
DEAL, PIECE = 1_000_000, "8m"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BROADCAST, _MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


def _root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tables-{spark.sparkContext.applicationId}"


def shared_dir(spark: SparkSession) -> str:
    """A new folder for this application below ``spark.checkpoint.dir``.  Only a local
    session without that setting gets a temporary one; a cluster without it is an error."""
    return f"{_root(spark)}/{uuid.uuid4().hex}"


def partitions(spark: SparkSession, rows: int) -> int:
    """As many as the session sets, or more, so that each has some ``DEAL`` rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // DEAL))


def saved(df: DataFrame, codec: str = "zstd", rows: int = 0, measured: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read back: the work is done once, lineage ends
    there, and a lost executor costs only its running tasks.  Once all is written, nothing needs the shuffle
    files that led to it; they are deleted.  With ``rows``, about how many rows its shuffles deal, their partitions
    grow in number instead of in size.  With ``measured``, a side of a join is sent to all tasks only if what was shuffled of it is small, whatever
    the sizes of its files: rows that repeat themselves look small there, and fill the driver.
    """
    spark = df.sparkSession
    path, now = shared_dir(spark), {_CLEANUP: "true"}
    if measured:
        now |= {_BROADCAST: "-1", _MEASURED: spark.conf.get(_MEASURED, None) or spark.conf.get(_BROADCAST)}
    if rows:
        now |= {"spark.sql.shuffle.partitions": str(partitions(spark, rows)), "spark.sql.adaptive.advisoryPartitionSizeInBytes": PIECE}
    before = {k: spark.conf.get(k, "false" if k == _CLEANUP else None) for k in now}
    try:
        for k, v in now.items():
            spark.conf.set(k, v)
        df.write.option("compression", codec).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def saved_as_measured(df: DataFrame) -> DataFrame:
    return saved(df, measured=True)


def sweep(spark: SparkSession) -> None:
    """Delete what this application saved.  For the end of a job, when the results that
    read it have been written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def heavy(counts: DataFrame, key: str, total: int, count: str = "n") -> DataFrame:
    """(key, pieces) of the heavy keys of (key, count), and into how many pieces each is cut."""
    limit = max(LIGHT, total // SHARE)
    return counts.where(F.col(count) > limit).select(key, F.ceil(F.col(count) / limit).cast("int").alias("pieces"))


def heavy_join(rows: DataFrame, lookup: DataFrame, key: str, by: str, total: int, count: str = "n") -> DataFrame:
    """``rows`` inner-joined on ``key`` to one row of ``lookup`` each, which has ``count``, the number
    of the key's rows; the rows of heavy keys are dealt by ``by`` to several tasks."""
    big = F.broadcast(heavy(lookup, key, total, count))
    one = F.coalesce("pieces", F.lit(1))
    left = rows.join(big, key, "left").withColumn("_piece", F.pmod(F.xxhash64(by), one).cast("int")).drop("pieces")
    right = lookup.join(big, key, "left").withColumn("_piece", F.explode(F.sequence(F.lit(0), one - 1))).drop("pieces")
    return left.join(right, [key, "_piece"]).drop("_piece")
