"""Streaming profiles: each event-time window is a version of its table.

State per (window, column) is a handful of mergeable numbers and two sketches, so it stays small
whatever the rate. Windows are emitted once, when the watermark passes them; later rows are dropped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varve.config import Thresholds
from varve.functions.psi import cdf_at, divergence, normalised, psi_label

WINDOW = ["table_name", "window_start", "column_name"]


def read_events(spark: SparkSession, folder: str, pattern: str, files_per_trigger: int = 4) -> DataFrame:
    schema = spark.read.parquet(f"{folder}/{pattern}").schema
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .option("pathGlobFilter", pattern)
        .parquet(folder)
    )


def windowed_profile(
    events: DataFrame, table_name: str, ts: str, columns: list[str], width: str = "1 day", lateness: str = "1 hour", texts: Sequence[str] = ()
) -> DataFrame:
    """M1: profile of every column per tumbling window; the numbers of a text are its lengths."""
    # event time must be a timestamp; zone-free columns are read in the session zone
    def cell(name: str, num: Column, value: Column, blank: Column) -> Column:
        return F.struct(F.lit(name).alias("column_name"), num.alias("num"), F.when(value.isNotNull(), F.xxhash64(value)).alias("value"), blank.cast("int").alias("blank"))

    number = lambda c: cell(c, F.col(c).cast("double"), F.col(c).cast("double"), F.lit(None))
    text = lambda c: cell(c, F.length(c).cast("double"), F.col(c), F.trim(c) == "")
    cells = events.select(F.col(ts).cast("timestamp").alias(ts), F.array(*map(number, columns), *map(text, texts)).alias("cells")).withWatermark(ts, lateness)
    long = cells.select(ts, F.inline("cells"))
    v = F.col("num")
    return (
        long.groupBy(F.window(ts, width).alias("w"), "column_name")
        .agg(
            F.count(F.lit(1)).alias("row_count"),
            F.count(v).alias("n_present"),
            F.min(v).alias("min_val"),
            F.max(v).alias("max_val"),
            F.avg(v).alias("mean"),
            F.stddev_samp(v).alias("std"),
            F.sum("blank").alias("n_blank"),
            F.hll_sketch_agg("value").alias("distinct_sketch"),
            F.kll_sketch_agg_double(v).alias("quantile_sketch"),
        )
        .select(
            F.lit(table_name).alias("table_name"),
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "column_name", "row_count", "n_present", "min_val", "max_val", "mean", "std", "n_blank", "distinct_sketch", "quantile_sketch",
        )
    )


def merged(windows: DataFrame, period: Column) -> DataFrame:
    """Windows taken together to longer periods (days to weeks or months), from their own facts and sketches.

    ``period`` is an expression over the windows' columns. The result has the columns of windowed_profile with
    ``period`` beside the first start and the last end; counts, limits, mean and spread merge exactly, sketches as sketches.
    """
    n, mean = F.col("n_present"), F.col("mean")
    keyed = windows.withColumn("period", period)
    whole = keyed.groupBy("table_name", "period", "column_name").agg(F.try_divide(F.sum(n * mean), F.sum(n)).alias("whole_mean"))
    # squares about the mean of the whole period
    squares = F.coalesce(F.col("std") * F.col("std") * (n - 1), F.lit(0.0)) + n * F.pow(mean - F.col("whole_mean"), 2)
    return (
        keyed.join(whole, ["table_name", "period", "column_name"])
        .groupBy("table_name", "period", "column_name")
        .agg(
            F.min("window_start").alias("window_start"),
            F.max("window_end").alias("window_end"),
            F.sum("row_count").alias("row_count"),
            F.sum(n).alias("n_present"),
            F.min("min_val").alias("min_val"),
            F.max("max_val").alias("max_val"),
            F.max("whole_mean").alias("mean"),
            F.when(F.sum(n) > 1, F.sqrt(F.sum(F.when(n > 0, squares)) / (F.sum(n) - 1))).alias("std"),
            F.sum("n_blank").alias("n_blank"),
            F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
            F.kll_merge_agg_double("quantile_sketch").alias("quantile_sketch"),
        )
    )


def readable(windows: DataFrame) -> DataFrame:
    """Sketches turned into numbers."""
    quantile = lambda p: F.when(F.col("n_present") > 0, F.kll_sketch_get_quantile_double("quantile_sketch", F.lit(p)))
    return windows.withColumns(
        {
            "cardinality_estimate": F.hll_sketch_estimate("distinct_sketch"),
            "completeness_percent": 100.0 * F.col("n_present") / F.col("row_count"),
            "blank_percent": 100.0 * F.col("n_blank") / F.col("row_count"),
            **{n: quantile(p) for n, p in [("q25", 0.25), ("q50", 0.5), ("q75", 0.75)]},
        }
    ).drop("distinct_sketch", "quantile_sketch")


def against_baseline(windows: DataFrame, baseline: DataFrame, cfg: Thresholds = Thresholds()) -> DataFrame:
    """M2: verdict of each finished window against one baseline window per column."""
    facts = ["min_val", "q25", "q50", "q75", "max_val", "mean", "std", "completeness_percent", "row_count", "blank_percent", "cardinality_estimate"]
    base = baseline.select("table_name", "column_name", F.col("window_start").alias("base_start"), F.struct(*facts).alias("a"))
    df = windows.withColumn("b", F.struct(*facts)).join(base, ["table_name", "column_name"])
    edges: list[Column] = [
        F.least("a.min_val", "b.min_val"), F.col("a.q25"), F.col("a.q50"), F.col("a.q75"), F.greatest("a.max_val", "b.max_val"),
    ]
    for side in ("a", "b"):
        pts = [F.col(f"{side}.{f}") for f in facts[:5]]
        df = df.withColumns({f"_{side}f{i}": cdf_at(e, pts) for i, e in enumerate(edges)})
        df = df.withColumns({f"_{side}m{i}": F.greatest(F.lit(0.0), F.col(f"_{side}f{i + 1}") - F.col(f"_{side}f{i}")) for i in range(4)})
        df = normalised(df, [f"_{side}m{i}" for i in range(4)], [f"_{side}s{i}" for i in range(4)])
    terms = [divergence(F.col(f"_as{i}"), F.col(f"_bs{i}")) for i in range(4)]
    moved = F.abs(F.col("b.mean") - F.col("a.mean")) / F.greatest(F.col("a.std"), F.lit(1e-9))
    gap = F.col("a.completeness_percent") - F.col("b.completeness_percent")
    blanker = F.col("b.blank_percent") - F.col("a.blank_percent")
    distinct = F.col("b.cardinality_estimate") / F.greatest(F.col("a.cardinality_estimate"), F.lit(1)) - 1
    return (
        df.withColumns({"psi": terms[0] + terms[1] + terms[2] + terms[3], "mean_move": moved, "completeness_loss": gap, "blank_gain": blanker, "distinct_change": distinct})
        .withColumn("psi_label", psi_label(F.col("psi"), cfg))
        .withColumn(
            "verdict",
            F.when(F.col("b.completeness_percent") < cfg.blocker_completeness, "BLOCK")
            .when((F.col("psi") >= cfg.psi_monitor) | (F.col("mean_move") > cfg.drift_severe), "BACK_TEST_REQUIRED")
            .when((F.col("psi") >= cfg.psi_stable) | (F.col("completeness_loss") >= cfg.completeness_delta_min) | (F.col("blank_gain") >= cfg.completeness_delta_min), "MONITOR")
            .otherwise("CLEAR"),
        )
        .select(*WINDOW, "base_start", "psi", "psi_label", "mean_move", "completeness_loss", "blank_gain", "distinct_change", "verdict")
    )


def run_to_table(windows: DataFrame, path: str, checkpoint: str) -> None:
    """Drain the source into a table of finished windows (append)."""
    q = (
        windows.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()


def close_open(events: DataFrame, table_name: str, ts: str, columns: list[str], finished: DataFrame, width: str = "1 day", texts: Sequence[str] = ()) -> DataFrame:
    """M1 at the end of the input: the windows that the watermark has not passed, from the rows that lie in them.

    ``events`` is the same source read as a batch; only rows from the end of the last finished window on are read.
    """
    end = finished.agg(F.max("window_end").alias("end")).first()["end"]
    rest = events if end is None else events.where(F.col(ts).cast("timestamp") >= F.lit(end))
    return windowed_profile(rest, table_name, ts, columns, width, texts=texts)


def first_windows(finished: DataFrame, known: DataFrame) -> DataFrame:
    """The first window of each column that has none among the known."""
    new = finished.join(known, ["table_name", "column_name"], "left_anti")
    first = new.groupBy("table_name", "column_name").agg(F.min("window_start").alias("window_start"))
    return new.join(first, WINDOW, "left_semi")


def run_alerts(windows: DataFrame, store: str, alerts: str, checkpoint: str, cfg: Thresholds = Thresholds()) -> None:
    """M2: keep every finished window and append its verdict against the first window of its column.

    The first window of each column is kept in a table of its own, so a batch reads that and its own rows,
    however long the stream has run. All writes are keyed by the batch number, so a batch that is retried
    replaces its own output.
    """
    base = f"{store}-base"

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        readable(batch).write.mode("overwrite").parquet(f"{store}/batch={batch_id}")
        finished = spark.read.parquet(f"{store}/batch={batch_id}")
        schema = T.StructType([*finished.schema.fields, T.StructField("batch", T.LongType())])
        known = spark.read.schema(schema).parquet(base).where(F.col("batch") < batch_id).drop("batch") if batch_id else finished.limit(0)
        first_windows(finished, known).write.mode("overwrite").parquet(f"{base}/batch={batch_id}")
        baseline = known.unionByName(spark.read.schema(finished.schema).parquet(f"{base}/batch={batch_id}"))
        against_baseline(finished, baseline, cfg).write.mode("overwrite").parquet(f"{alerts}/batch={batch_id}")

    q = (
        windows.writeStream.outputMode("append")
        .foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()


def close_alerts(rest: DataFrame, store: str, cfg: Thresholds = Thresholds()) -> DataFrame:
    """M2 at the end of the input: verdicts of the windows of ``close_open`` against the baselines kept by ``run_alerts``."""
    rest = readable(rest)
    known = rest.sparkSession.read.schema(rest.schema).parquet(f"{store}-base").drop("batch")
    return against_baseline(rest, known.unionByName(first_windows(rest, known)), cfg)
