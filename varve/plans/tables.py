"""Modelling tables assembled from the raw star schema, each with an integer version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varve.sources.rows import OVERRIDE_SCHEMA, TableSpec
from varve.sources.shared import written

_ORDERS: dict[tuple[str, str], DataFrame] = {}


def forget() -> None:
    """Drop the written orders, so that the next query joins them again."""
    _ORDERS.clear()


def shared_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The joined orders, written once per session and source folder: two tables and every pass read them."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _ORDERS:
        _ORDERS[key] = written(orders_table(spark, sf_dir), "orders")
    return _ORDERS[key]


def orders_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order; version is the order year."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    orders = read("orders")
    lines = (
        read("lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.count(F.lit(1)).alias("n_lines"),
            # rounded: the float sum depends on row order, distinct counts must not
            F.round(F.avg("l_discount"), 6).alias("avg_discount"),
            F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("target"),
        )
    )
    customers = read("customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return (
        orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .join(customers, F.col("o_custkey") == F.col("c_custkey"), "left")
        .select(
            F.year("o_orderdate").alias("version"),
            F.col("o_orderkey").alias("order_id"),
            F.col("o_totalprice").alias("total_price"),
            F.col("c_acctbal").alias("acct_balance"),
            "n_lines",
            "avg_discount",
            F.col("c_mktsegment").alias("segment"),
            F.col("o_orderpriority").alias("priority"),
            F.col("o_orderstatus").alias("order_status"),
            "target",
        )
    )


def mutated_orders(base: DataFrame) -> DataFrame:
    """Known changes from given versions on, so that every drift and quality rule has work."""
    v, k = F.col("version"), F.col("order_id")
    return base.withColumns(
        {
            "total_price": F.when(v >= 1999, F.col("total_price") * 1.3).otherwise(F.col("total_price")),
            "acct_balance": F.when((v >= 1998) & (k % 10 == 0), None).otherwise(
                F.when(v >= 2001, F.col("acct_balance") * 2).otherwise(F.col("acct_balance"))
            ),
            "n_lines": F.when((v >= 2000) & (k % 10 < 6), None).otherwise(F.col("n_lines")),
            "segment": F.when((v >= 1999) & (k % 20 == 0), "").otherwise(F.col("segment")),
            "priority": F.when(v >= 2000, F.concat("priority", (k % 4).cast("string"))).otherwise(F.col("priority")),
            "target": F.when((v >= 2000) & (k % 5 == 0), 0).otherwise(F.col("target")),
            "const": F.lit(1),
        }
    )


def specs(spark: SparkSession, sf_dir: str) -> list[TableSpec]:
    base = shared_orders(spark, sf_dir)
    # whole weeks since 1970, so that weeks of different months and years stay apart
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("version", F.floor(F.unix_date(F.to_date("ts")) / 7).cast("int"))
    # a nested column, missing for some users
    events = events.withColumn("detail", F.when(F.col("user_id") % 7 != 0, F.from_json("props", "k int")))
    # a source without a number has no version
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("version", F.regexp_extract("source", r"(\d+)$", 1).try_cast("int"))
    return [
        TableSpec(
            "abt_orders",
            mutated_orders(base),
            present={"const": F.col("version") >= 2000, "order_status": F.col("version") < 2001},
            patterns={"priority": "^[1-5]-[A-Z ]+$"},
        ),
        TableSpec("abt_steady", base),
        TableSpec("events", events, columns=["event_id", "user_id", "event_type", "value", "props", "ts", "detail"], patterns={"props": '^\\{"k": [0-9]{2}\\}$'}),
        TableSpec("documents", docs, columns=["doc_id", "text", "lang", "source", "n_chars"]),
    ]


# Facts a data owner declares: scale and privacy.
DECLARED = [
    ("abt_orders", "order_id", "id", None),
    ("abt_orders", "acct_balance", "interval", "private"),
    ("abt_orders", "n_lines", "interval", None),
    ("abt_orders", "priority", "nominal", None),
    ("abt_steady", "order_id", "id", None),
    ("abt_steady", "n_lines", "interval", None),
    ("events", "event_id", "id", None),
    ("events", "user_id", "nominal", "private"),
    ("events", "props", "nominal", None),
    ("documents", "doc_id", "id", None),
    ("documents", "n_chars", "interval", None),
]


def overrides(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DECLARED, OVERRIDE_SCHEMA)
