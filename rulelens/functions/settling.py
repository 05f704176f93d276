"""Cutting long plans: a table written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def settled_table(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder that the cluster names, so that later steps reread it instead of planning it anew."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local["):
            raise ValueError("a cluster needs spark.checkpoint.dir: a folder that the driver and all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="rulelens-"))
    return df.checkpoint(eager=True)


def written_table(df: DataFrame) -> DataFrame:
    """``settled_table`` as Parquet beside the checkpoints: for large tables, which take a fraction of the room in columns."""
    spark = df.sparkSession
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        settled_table(df.limit(0))  # names a folder, or refuses
        folder = sc.getCheckpointDir()
    place = f"{folder.rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(place)
    return spark.read.parquet(place)


#: Rows that a task is dealt where steps sort and group many narrow rows.
ROWS_A_PART = 250_000


def parts_for(df: DataFrame, rows: int) -> int:
    """How many parts ``rows`` rows make, no fewer than there are cores."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_A_PART))


@contextmanager
def narrow_rows(spark: SparkSession, parts: int):
    """Shuffles of what is settled within go to ``parts`` parts at least and are joined again, or split where keys are frequent, to 4 MB.

    Adaptive execution sizes parts by compressed bytes. Narrow rows take some twenty times as much in memory, so its usual
    64 MB are over a gigabyte for one task.
    """
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "4m", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16m", "spark.sql.shuffle.partitions": str(max(usual, parts))}
    before = {k: spark.conf.get(k, None) for k in sizes}
    try:
        for k, v in sizes.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
