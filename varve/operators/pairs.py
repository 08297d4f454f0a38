"""The column × version grid and the version pairs read off it.

The grid has one row per column of a table and per version of that table, also where the column is
absent, so first/last/previous/next version are plain window functions over (table, column). It is
as large as the profile itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COLUMN = ["table_name", "column_name"]
SIDE = [
    "abt_name", "row_count", "data_type", "cas_data_type", "statistical_scale", "completeness_percent",
    "cardinality_count", "uniqueness_percent", "mean", "std", "min_val", "max_val", "skewness", "kurtosis",
    "q25", "q50", "q75", "has_outliers", "n_outliers", "blank_value_count", "mismatched_count", "status",
    "score", "g_privacy",
]


def versions(profiles: DataFrame) -> DataFrame:
    """One row per table version, numbered from 0 in version order; rows without a version are outside it."""
    order = Window.partitionBy("table_name").orderBy("version")
    return (
        profiles.where("version IS NOT NULL")
        .groupBy("table_name", "version")
        .agg(
            F.max("abt_name").alias("abt_name"),
            F.max("row_count").alias("row_count"),
            F.max("snapshot_date").alias("snapshot_date"),
            F.count(F.lit(1)).alias("col_count"),
        )
        .withColumn("ver_idx", F.row_number().over(order) - 1)
    )


def unversioned(profiles: DataFrame) -> DataFrame:
    """What has no version, counted apart: table_name, columns, row_count, missing_cells."""
    return profiles.where("version IS NULL").groupBy("table_name").agg(
        F.count(F.lit(1)).alias("columns"), F.max("row_count").alias("row_count"), F.sum("missing_count").alias("missing_cells")
    )


def column_universe(profiles: DataFrame) -> DataFrame:
    """Columns of a table over all versions with their first-seen place."""
    seen = F.min(F.struct("version", "col_seq")).alias("seen")
    return profiles.where("version IS NOT NULL").groupBy(*COLUMN).agg(seen).select(
        *COLUMN, F.col("seen.version").alias("first_version"), F.col("seen.col_seq").alias("first_seq")
    )


def grid(sc: DataFrame) -> DataFrame:
    """Every column of a table at every version of that table, with its facts or NULL (absent)."""
    per_table = (
        versions(sc)
        .groupBy("table_name")
        .agg(F.array_sort(F.collect_list(F.struct("ver_idx", "version", "abt_name", "row_count"))).alias("vs"))
    )
    places = (
        column_universe(sc)
        .join(per_table, "table_name")
        .select(*COLUMN, "first_version", "first_seq", F.size("vs").alias("n_versions"), F.inline("vs"))
        .select(
            *COLUMN, "first_version", "first_seq", "n_versions", "ver_idx", "version",
            F.col("abt_name").alias("ver_name"), F.col("row_count").alias("ver_rows"),
        )
    )
    facts = sc.select("table_name", "column_name", "version", F.struct(*SIDE).alias("p"))
    by_version = Window.partitionBy(*COLUMN).orderBy("ver_idx")
    return (
        places.join(facts, ["table_name", "column_name", "version"], "left")
        .withColumns(
            {
                "present": F.col("p").isNotNull(),
                # the column as it was in the first version of the table, NULL when not there yet
                "base": F.first("p").over(by_version.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
                "next_p": F.lead("p").over(by_version),
                "next_name": F.lead("ver_name").over(by_version),
                "next_version": F.lead("version").over(by_version),
                "next_rows": F.lead("ver_rows").over(by_version),
            }
        )
    )


def consecutive(g: DataFrame) -> DataFrame:
    """Pairs (i, i+1) per column; side ``a`` or ``b`` is NULL where the column is absent."""
    return g.where("next_version is not null").select(
        *COLUMN, "first_version", "first_seq", "n_versions",
        F.col("ver_idx").alias("pair_idx"),
        (F.col("ver_idx") == F.col("n_versions") - 2).alias("last_pair"),
        F.col("ver_name").alias("from_ver"),
        F.col("next_name").alias("to_ver"),
        F.col("version").alias("from_version"),
        F.col("next_version").alias("to_version"),
        F.col("ver_rows").alias("from_rows"),
        F.col("next_rows").alias("to_rows"),
        "base",
        F.col("p").alias("a"),
        F.col("next_p").alias("b"),
    )


def against_first(g: DataFrame) -> DataFrame:
    """Pairs (first version, each later version) per column."""
    return g.where("ver_idx > 0").select(
        *COLUMN, "first_version", "first_seq", "n_versions",
        F.col("ver_idx").alias("pair_idx"),
        F.col("ver_name").alias("to_ver"),
        F.col("version").alias("to_version"),
        F.col("base").alias("a"),
        F.col("p").alias("b"),
    )
