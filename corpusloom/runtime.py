"""What every operator shares: reading tables, the shared folder, size-checked broadcasts, joins of hot keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one of this machine in local mode (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("a cluster needs a shared folder: set spark.checkpoint.dir")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="corpusloom-"))
    return sc.getCheckpointDir().rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Eager checkpoint in the shared folder: cuts the lineage and survives lost executors."""
    shared_dir(df.sparkSession)
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def small_enough(df: DataFrame, most_rows: int) -> bool:
    """True if df has at most most_rows rows; reads no more than that many and one."""
    return df.limit(most_rows + 1).count() <= most_rows


def broadcast_if_small(df: DataFrame, most_rows: int) -> DataFrame:
    """df with a broadcast hint if its checked size allows it, else df as it is (Spark then shuffles)."""
    return F.broadcast(df) if small_enough(df, most_rows) else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


HOT_ROWS = 200_000  # rows of one key that one task may get in a join


def joined_hot(rows: DataFrame, keyed: DataFrame, keys: Sequence[str], spread: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """rows joined with keyed, which has one row per key and in column ``n`` the number of rows of that key; n is dropped.

    A key of more than hot_rows rows is salted by the column ``spread``: it gets as many salts as keep a task below the bound, and its
    row of keyed is repeated for each. There are fewer such keys than rows over hot_rows; up to a million of them are
    broadcast, more are joined. keyed is read three times, so it should be written or cheap.
    """
    salts = F.ceil(F.col("n") / hot_rows).cast("int")
    hot = keyed.where(F.col("n") > hot_rows).select(*keys, salts.alias("_salts"))
    salted = rows.join(broadcast_if_small(hot, 1_000_000), list(keys), "left")
    salted = salted.withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(spread), F.col("_salts")).cast("int"), F.lit(0))).drop("_salts")
    sides = keyed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1))).drop("n")
    return salted.join(sides, [*keys, "_salt"]).drop("_salt")
