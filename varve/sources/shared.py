"""Tables written once into the folder that all executors share, and read by many stages."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; make one only for a local session that has none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="varve-checkpoint-")
    sc.setCheckpointDir(shared)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for one run inside the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows read back from a columnar table: lineage ends here and readers prune columns."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._written_to = path
    return back


def bucketed(df: DataFrame, name: str, column: str, buckets: int, **options: object) -> DataFrame:
    """As ``written``, dealt into buckets by a column without a shuffle: a join by that column leaves these rows in place.

    The other side has to be repartitioned by its column into as many partitions. ``options`` go to the Parquet writer.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    table = f"varve_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(buckets, column).options(**options).option("path", path).saveAsTable(table)
    back = spark.table(table)
    back._written_to, back._table = path, table
    return back


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` returned, once nothing that is still to be computed reads them."""
    for table in tables:
        path = getattr(table, "_written_to", None)
        if path is not None:
            jvm, sc = table.sparkSession._jvm, table.sparkSession.sparkContext
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
            table._written_to = None
        if getattr(table, "_table", None) is not None:
            table.sparkSession.sql(f"DROP TABLE IF EXISTS {table._table}")
            table._table = None
