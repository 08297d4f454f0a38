"""Registry of table versions: batch ingest, listing and the partitioned version store.

The registry is a table with one row per (table_name, version). A whole batch of documents for many
tables is ingested at once; windows run inside one table's few versions.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varve.sources.shared import discard, written

SCHEMA = "table_name string, version int, hash string, created_at timestamp, last_seen timestamp, row_count bigint, snapshot_date string"


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def classify(incoming: DataFrame, registry: DataFrame) -> DataFrame:
    """Version and action of each incoming document (table_name, arrival, hash).

    A hash equal to any stored version, or to an earlier document of the batch, changes nothing. Documents that
    arrive at the same moment are told apart by their hashes, so versions are gapless and distinct.
    """
    known = registry.select("table_name", "hash", F.col("version").alias("known_version"))
    last = registry.groupBy("table_name").agg(F.max("version").alias("last_version"))
    copies = Window.partitionBy("table_name", "hash")
    by_hash = copies.orderBy("arrival")
    whole = by_hash.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # equal arrivals are taken in order of their hashes, one row after the other
    by_table = Window.partitionBy("table_name").orderBy("arrival", "hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        incoming.join(known, ["table_name", "hash"], "left")
        .join(last, "table_name", "left")
        .withColumn("copy_no", F.row_number().over(by_hash))
        .withColumn("is_new", F.col("known_version").isNull() & (F.col("copy_no") == 1))
        .withColumn("nth_new", F.sum(F.col("is_new").cast("int")).over(by_table))
        .withColumn("new_version", (F.coalesce("last_version", F.lit(0)) + F.col("nth_new")).cast("int"))
        .withColumn("version", F.coalesce("known_version", F.max(F.when(F.col("is_new"), F.col("new_version"))).over(whole)))
        .withColumn("action", F.when(~F.col("is_new"), "unchanged").when(F.col("version") == 1, "registered").otherwise("version_added"))
        .drop("known_version", "last_version", "copy_no", "nth_new", "new_version", "is_new")
    )


def ingest(registry: DataFrame, classified: DataFrame, now) -> DataFrame:
    """The registry after a batch: new versions added, last_seen moved for repeats."""
    seen = classified.groupBy("table_name", "version").agg(
        F.max_by("hash", F.col("action") != "unchanged").alias("new_hash"),
        F.bool_or(F.col("action") != "unchanged").alias("is_new"),
        F.max("row_count").alias("new_rows"),
        F.max("snapshot_date").alias("new_date"),
    )
    ts = F.lit(now).cast("timestamp")
    return registry.join(seen, ["table_name", "version"], "full").select(
        "table_name",
        "version",
        F.coalesce("hash", "new_hash").alias("hash"),
        F.coalesce("created_at", ts).alias("created_at"),
        F.when(F.col("is_new").isNotNull(), ts).otherwise(F.col("last_seen")).alias("last_seen"),
        F.coalesce("row_count", "new_rows").alias("row_count"),
        F.coalesce("snapshot_date", "new_date").alias("snapshot_date"),
    )


def write_registry(registry: DataFrame, path: str) -> None:
    """A new state of the registry under its own path; the state it was made from stays readable."""
    kinds = T.StructType.fromDDL(SCHEMA)
    registry.select(*[F.col(f.name).cast(f.dataType) for f in kinds]).write.parquet(path)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


# ── commits: several writers, one line of states ─────────────────────────────────────────────────


class RegistryLog:
    """A registry that several writers may change: numbered commits, each naming one written state.

    Commit n is a small file that is moved into place under the name n, which fails where it exists: of two
    writers that started from the same state one gets the number, the other sees its batch again on the new
    state. A state is written before its commit and never changed, so readers always find a whole one.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root
        self._jvm = spark._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._commits = self._jvm.org.apache.hadoop.fs.Path(f"{root}/commits")
        self._files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._commits.toUri(), self._conf)

    def commits(self) -> DataFrame:
        """number, state, batch of every commit."""
        schema = "number int, state string, batch string"
        if not self._files.util().exists(self._commits):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("pathGlobFilter", "*.json").json(f"{self.root}/commits")

    def latest(self) -> tuple[int, DataFrame]:
        """Number of the last commit and the registry it names; 0 and an empty one before the first."""
        last = self.commits().orderBy(F.desc("number")).first()
        return (last.number, read_registry(self.spark, last.state)) if last else (0, empty(self.spark))

    def publish(self, number: int, state: str, batch: str) -> bool:
        """Claim a commit number; False when another writer has it."""
        path = self._jvm.org.apache.hadoop.fs.Path
        draft, final = path(f"{self.root}/drafts/{uuid.uuid4().hex}.json"), path(f"{self.root}/commits/{number:08d}.json")
        fs = draft.getFileSystem(self._conf)
        fs.mkdirs(self._commits)
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps({"number": number, "state": state, "batch": batch}).encode()))
        out.close()
        none = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = none
        try:
            self._files.rename(draft, final, options)
        except Py4JJavaError as error:
            if "FileAlreadyExists" not in error.java_exception.getClass().getName():
                raise
            fs.delete(draft, False)
            return False
        return True

    def prepare(self, incoming: DataFrame, now) -> tuple[int, str, DataFrame]:
        """The next commit number, the state that the batch leads to from the latest one, and its actions."""
        number, registry = self.latest()
        classified = written(classify(incoming, registry), "registry-actions")
        state = f"{self.root}/states/{uuid.uuid4().hex}"
        write_registry(ingest(registry, classified, now), state)
        return number + 1, state, classified

    def commit(self, incoming: DataFrame, now, batch: str, attempts: int = 20) -> DataFrame | None:
        """Ingest one batch and return its actions (as ``classify``); None when ``batch`` is in the log already.

        A batch that another writer overtook is classified anew on the state that writer left, so versions of a
        table stay gapless and distinct. A retry of a batch changes nothing.
        """
        for _ in range(attempts):
            if not self.commits().where(F.col("batch") == batch).isEmpty():
                return None
            number, state, classified = self.prepare(incoming, now)
            if self.publish(number, state, batch):
                return classified
            discard(classified)
        raise RuntimeError(f"batch {batch} was overtaken {attempts} times")


def list_tables(registry: DataFrame) -> DataFrame:
    """Tables with their versions."""
    return registry.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("version_count"),
        F.min("created_at").alias("created_at"),
        F.array_sort(F.collect_list("version")).alias("versions"),
    )


def table_versions(registry: DataFrame, table_name: str) -> DataFrame:
    return registry.where(F.col("table_name") == table_name)


def resolve(registry: DataFrame, table_name: str, version: int) -> DataFrame:
    return table_versions(registry, table_name).where(F.col("version") == version)


def write_store(profiles: DataFrame, path: str) -> None:
    """K2: profile facts partitioned by table and version; a rerun replaces only its own versions."""
    (
        profiles.repartition("table_name", "version")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("table_name", "version")
        .parquet(path)
    )


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def load_version(store: DataFrame, table_name: str, version: int) -> DataFrame:
    """Facts of one version; only its partition is read."""
    return store.where((F.col("table_name") == table_name) & (F.col("version") == version))
