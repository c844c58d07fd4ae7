"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors see.

    It is what ``spark.checkpoint.dir`` names. Only where that is unset and all runs in
    one JVM (tests) a temporary folder is chosen and set as the checkpoint folder; on a
    cluster that would be a folder that nobody else sees, and an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="loomgraph-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/loomgraph/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage: a lost executor costs a reread, never a recomputation, and
    later jobs all see the same rows. ``by``: a column that rows lie together by, in as
    many buckets as a shuffle has partitions: what groups, ranks or joins by it needs no
    exchange. ``df`` should come dealt by it, or each task writes to each bucket.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if by is None:
        df.write.option("compression", "zstd").parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
    else:
        table = "loomgraph_" + path.rsplit("-", 1)[1]
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.format("parquet").options(path=path, compression="zstd").bucketBy(n, by).saveAsTable(table)
        out = spark.read.table(table)
        out._loomgraph_table = table
    out._loomgraph_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Remove a table that ``write_table`` made; only once nothing reads it any more."""
    path = getattr(df, "_loomgraph_path", None)
    if path is None:
        return
    spark = df.sparkSession
    if table := getattr(df, "_loomgraph_table", None):
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


def redeal(df: DataFrame, *by: str) -> DataFrame:
    """``df`` dealt out once more, evenly over the values of ``by``.

    Put around the aggregated side of a join: both sides then come straight from an
    exchange, so that Spark can split a hot key's partition when it runs.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.hash(*by))
