"""Session helpers shared by every query.

Nothing here assumes a local machine: the folder for cut lineage is the one
the cluster names in ``spark.checkpoint.dir``. Only a session that names none
(tests on ``local[*]``) gets a folder of our own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors can reach; set only where it is unset."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(named)
        return named
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="bookloom-"))
    return sc._jsc.sc().getCheckpointDir().get()


#: Tables that this process has written and not cleaned away.
_tables: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as parquet to the shared folder and reads it back: no lineage, and columns can still be pruned.

    The table is read when the result is, so it stays until :func:`clean`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tables.append(path)
    return spark.read.parquet(path)


def clean(spark: SparkSession) -> int:
    """Deletes the tables that this process has written; for after all results are read. Gives how many there were."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    n = len(_tables)
    while _tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(_tables.pop())
        path.getFileSystem(conf).delete(path, True)
    return n


def checked_broadcast_rows(df: DataFrame, limit: int, what: str) -> list:
    """Collects a table that must stay below ``limit`` rows; raises beyond, so nothing unbounded reaches the driver."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what} has more than {limit} rows; it may not be sent to every executor")
    return rows
