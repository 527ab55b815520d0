"""Session helpers: where intermediate tables go, and how lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


FILE_ROWS = 50_000  # narrow rows of a file, for tables whose size is known beforehand


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by the session.

    A cluster names it in ``spark.checkpoint.dir``.  Only a local session may fall back to a
    folder of its own, because there every task runs on this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    own = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str = "stage", most: int | None = None, per_file: int = FILE_ROWS) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: survives lost executors.

    ``most``: a bound of its rows, where one is known.  Then no more tasks write it than files of ``per_file`` rows ask for, however many
    partitions the session has: each file costs its task a few calls of the store, on a local disk even processes of their own.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if most is not None:
        df = df.coalesce(max(1, -(-most // per_file)))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
