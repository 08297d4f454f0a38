"""Column-profile payloads: JSON documents from a catalog, one per table version.

Accepted forms: ``{abt_snapshot, items}``, an API response ``{count, items}``, a bare list of items,
and any of these quoted or embedded in other text. Items carry their facts under ``attributes`` or
flat. Everything is parsed with built-in JSON functions; documents that stay unreadable are kept
apart by ``unreadable``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varve.functions.scalars import finite

# source key -> (profile column, type, default)
FIELDS = {
    "dataType": ("data_type", "string", "num"),
    "casDataType": ("cas_data_type", "string", "double"),
    "statisticalScale": ("statistical_scale", "string", "interval"),
    "ordinalPosition": ("ordinal_position", "int", 0),
    "completenessPercent": ("completeness_percent", "double", 100.0),
    "missingCount": ("missing_count", "bigint", 0),
    "cardinalityCount": ("cardinality_count", "bigint", 0),
    "uniquenessPercent": ("uniqueness_percent", "double", 0.0),
    "mean": ("mean", "double", None),
    "median": ("median", "double", None),
    "standardDeviation": ("std", "double", None),
    "min": ("min_val", "double", None),
    "max": ("max_val", "double", None),
    "skewness": ("skewness", "double", None),
    "kurtosis": ("kurtosis", "double", None),
    "quantiles25": ("q25", "double", None),
    "quantiles50": ("q50", "double", None),
    "quantiles75": ("q75", "double", None),
    "hasOutliers": ("has_outliers", "boolean", False),
    "nOutliers": ("n_outliers", "bigint", 0),
    "mostCommonValue": ("most_common_value", "string", None),
    "leastCommonValue": ("least_common_value", "string", None),
    "mode": ("mode", "string", None),
    "blankValueCount": ("blank_value_count", "bigint", 0),
    "mismatchedCount": ("mismatched_count", "bigint", 0),
    "charsMaxCount": ("chars_max_count", "int", None),
    "charsMinCount": ("chars_min_count", "int", None),
    "informationPrivacy": ("information_privacy", "string", None),
    "semanticTypeId": ("semantic_type_id", "string", None),
    "semanticTypeScore": ("semantic_type_score", "double", None),
    "hasUniqueField": ("has_unique_field", "boolean", False),
    "actualDataType": ("actual_data_type", "string", None),
    "bestChartType": ("best_chart_type", "string", None),
    "rawLength": ("raw_length", "int", None),
}
# A flat item is recognised by any of these keys.
FLAT_MARKS = ["completenessPercent", "dataType", "statisticalScale"]
# Keys that change without a change of content.
VOLATILE = ["creationTimeStamp", "modifiedTimeStamp", "id", "links"]

# Scalars are read as text and cast with try_cast, so one bad value never loses its item.
_SNAPSHOT = "struct<name:string,table_name:string,version:int,row_count:bigint,snapshot_date:string>"
_DOC = f"struct<abt_snapshot:{_SNAPSHOT},count:bigint,items:array<map<string,string>>>"


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Files as rows: (path, payload)."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("payload"))


def repaired(text: Column) -> Column:
    """The first reading that yields a JSON object or list: plain, unquoted once or twice, embedded."""
    t = F.trim(text)
    unquote = lambda c: F.get_json_object(F.concat(F.lit('{"x":'), c, F.lit("}")), "$.x")
    once = unquote(t)
    embedded = F.regexp_extract(t, r"(?s)(\{.*\}|\[.*\])", 1)
    looks = lambda c: F.when(
        (F.trim(c).startswith("{") & F.from_json(c, "map<string,string>").isNotNull())
        | (F.trim(c).startswith("[") & F.from_json(c, "array<string>").isNotNull()),
        F.trim(c),
    )
    return F.coalesce(looks(t), looks(once), looks(unquote(once)), looks(embedded))


def documents(payloads: DataFrame) -> DataFrame:
    """Parsed documents with ``doc``; bare lists become ``{items}``."""
    whole = F.when(F.col("json").startswith("["), F.concat(F.lit('{"items":'), F.col("json"), F.lit("}"))).otherwise(F.col("json"))
    return payloads.withColumn("json", repaired(F.col("payload"))).withColumn("doc", F.from_json(whole, _DOC))


def unreadable(docs: DataFrame) -> DataFrame:
    """Documents that no reading could parse."""
    return docs.where("doc is null or doc.items is null")


def _value(key: str, kind: str, default) -> Column:
    text = F.coalesce(F.element_at("attrs", key), F.lit(None).cast("string"))
    if kind == "string":
        c = text
    elif kind == "double":
        c = finite(text.try_cast("double"))
    elif kind == "boolean":
        c = text.try_cast("boolean")
    else:
        c = F.coalesce(text.try_cast(kind), F.floor(text.try_cast("double")).cast(kind))
    return c if default is None else F.coalesce(c, F.lit(default))


def profiles(docs: DataFrame) -> DataFrame:
    """Profile facts of all documents. Needs columns table_name and version.

    Without a snapshot the row count falls back to ``count`` or to the number of items, which are
    numbers of columns; ``row_count_measured`` marks the rows where that happened.
    """
    snap = F.col("doc.abt_snapshot")
    items = docs.where("doc.items is not null").select(
        "table_name",
        F.coalesce(snap["version"], F.col("version")).alias("version"),
        F.coalesce(snap["name"], F.col("table_name")).alias("abt_name"),
        F.coalesce(snap["snapshot_date"], F.lit("unknown")).alias("snapshot_date"),
        F.coalesce(snap["row_count"], F.col("doc.count"), F.size("doc.items")).cast("bigint").alias("row_count"),
        snap["row_count"].isNotNull().alias("row_count_measured"),
        F.posexplode("doc.items").alias("col_seq", "item"),
    )
    nested = F.from_json(F.col("item")["attributes"], "map<string,string>")
    flat = F.exists(F.map_keys("item"), lambda k: k.isin(*FLAT_MARKS))
    attrs = F.when(F.coalesce(F.size(nested), F.lit(0)) > 0, nested).when(flat, F.col("item")).otherwise(F.create_map().cast("map<string,string>"))
    facts = items.withColumn("attrs", attrs).select(
        "table_name", "version", "abt_name", "snapshot_date", "row_count", "row_count_measured", "col_seq",
        F.coalesce(F.col("item")["name"], F.lit("")).alias("column_name"),
        *[_value(key, kind, default).alias(name) for key, (name, kind, default) in FIELDS.items()],
    )
    # nested columns have no distinct values; the default of 0 would make them constants
    counted = lambda c: F.when(F.col("data_type") != "other", F.col(c))
    return facts.withColumns({c: counted(c) for c in ("cardinality_count", "uniqueness_percent")})


def to_payloads(profile: DataFrame) -> DataFrame:
    """Write side of the same format: one document per table version."""
    attrs = F.struct(*[F.col(name).alias(key) for key, (name, _, _) in FIELDS.items()])
    item = F.struct("col_seq", F.struct(F.col("column_name").alias("name"), attrs.alias("attributes")).alias("item"))
    return (
        profile.groupBy("table_name", "version")
        .agg(
            F.max("abt_name").alias("name"),
            F.max("row_count").alias("row_count"),
            F.max("snapshot_date").alias("snapshot_date"),
            F.array_sort(F.collect_list(item), lambda x, y: F.when(x["col_seq"] < y["col_seq"], -1).when(x["col_seq"] > y["col_seq"], 1).otherwise(0))
            .getField("item")
            .alias("items"),
        )
        .select(
            "table_name",
            "version",
            F.to_json(
                F.struct(F.struct("name", "table_name", "version", "row_count", "snapshot_date").alias("abt_snapshot"), "items")
            ).alias("payload"),
        )
    )


def content_hash(docs: DataFrame) -> DataFrame:
    """Digest of the items, whatever their order, key order and volatile keys."""

    def canonical(m: Column) -> Column:
        return F.to_json(F.array_sort(F.map_entries(m)))

    def stable(item: Column) -> Column:
        kept = F.map_filter(item, lambda k, v: ~k.isin(*VOLATILE, "attributes"))
        attrs = F.from_json(item["attributes"], "map<string,string>")
        return F.struct(
            F.coalesce(item["name"], F.lit("")).alias("name"),
            F.concat(canonical(kept), F.coalesce(canonical(attrs), F.lit(""))).alias("body"),
        )

    bodies = F.transform(F.array_sort(F.transform("doc.items", stable)), lambda s: s["body"])
    return docs.withColumn("hash", F.sha2(F.concat_ws("\n", bodies), 256))
