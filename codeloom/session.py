"""Session settings and the helpers that keep plans safe on a cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "codeloom", master: str | None = None,
                  shuffle_partitions: int | None = None) -> SparkSession:
    b = (SparkSession.builder.appName(app)
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.enabled", "false"))
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a temporary one only on local masters."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="codeloom-ckpt-")
    sc.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Written once to the shared folder: survives the loss of any executor and bounds plan growth.

    A table and no checkpoint, which Spark writes row by row and as a rule uncompressed.
    """
    return as_table(df)


#: Folders that this process has written with as_table and not dropped yet.
_TABLES: list[str] = []


def drop_tables(spark: SparkSession) -> None:
    """Delete the tables of this process; call it when no frame of a run is read any more."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _TABLES:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_TABLES.pop())
        path.getFileSystem(conf).delete(path, True)


def as_table(df: DataFrame) -> DataFrame:
    """Write once as Parquet in the shared folder and read back.

    Cuts lineage like a checkpoint; later reads take only the columns they need,
    which matters for relations that carry source text.
    """
    folder = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    _TABLES.append(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def ordinal(*cols: str | Column) -> Column:
    """Comparable position key: structs compare field by field."""
    return F.struct(*cols)
