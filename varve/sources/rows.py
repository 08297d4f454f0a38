"""Profiles straight from rows: raw table versions in, one fact row per (table, version, column) out.

All tables are melted to one long shape and profiled by the same few shuffles, so the number of
jobs does not grow with the number of tables or columns.

* Each column of the source is read once. Rows become *value counts* (group, value, count) with map-side
  combining, so a hot group or a hot value is already small when it is shuffled. Columns of one kind travel
  together, as narrow rows: one number for the group (column and version), one for the value. A text travels as
  a digest of 16 bytes and its first characters; whole texts are fetched from the source only for
  the most and least frequent values of a group, and only where the first characters do not do.
* Every other pass reads the value counts and has only mergeable aggregates.
* Exact quartiles are found by narrowing: count values per range of the group, keep the ranges that
  hold a wanted rank, split those again, and rank only inside the ranges that remain. No task ever
  orders a whole group.
* Sketch mode never builds value counts: one pass of mergeable sketches, one over the numeric columns
  for the outlier fences, one that counts the frequent values exactly.
* Rows without a version are a group of their own, profiled like any other; they are outside the order
  of versions, so comparisons leave them out.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varve.functions.scalars import finite
from varve.sources.shared import written

KEYS = ["table_name", "version", "column_name"]
CELL = ["num", "txt", "res", "has", "blank", "miss"]
#: Stands for a missing version while groups are joined by their keys, so that plain equality finds them.
NO_VERSION = -(2**31)
#: First characters of a text that travel with its digest.
HEAD = 16
#: Sketch mode: values a group's summary tracks, and how many of the most frequent ones are counted exactly. The
#: summary errs by at most 3.5 rows in 8192, so a value held by more than FREQUENT of a group's rows is among them.
TRACKED, CANDIDATES, FREQUENT = 4096, 256, 0.005
QUARTILES = (0.25, 0.50, 0.75)
SKETCH_ACCURACY = 10_000
RANGES = 2048
EXACT_DOUBLE_DIGITS = 15

OVERRIDE_SCHEMA = "table_name string, column_name string, statistical_scale string, information_privacy string"


@dataclass
class TableSpec:
    """Rows of one table with an integer version column.

    ``present`` limits a column to some versions; ``patterns`` gives the format of text columns, ``types`` the SQL
    type that their values should cast to. Blank and missing values are not mismatches.
    """

    name: str
    rows: DataFrame
    version: str = "version"
    columns: list[str] | None = None
    present: dict[str, Column] = field(default_factory=dict)
    patterns: dict[str, str] = field(default_factory=dict)
    types: dict[str, str] = field(default_factory=dict)

    def profiled(self) -> list[str]:
        return self.columns or [c for c in self.rows.columns if c != self.version]


    def only(self, kind: str) -> TableSpec | None:
        """The same table with its columns of one kind (num, char), if it has any."""
        names = [c for c in self.profiled() if _kind(self.rows.schema[c].dataType) == kind]
        return replace(self, columns=names) if names else None


#: Declared formats of columns: a pattern, a type to cast to, or both.
RULE_SCHEMA = "table_name string, column_name string, declared_type string, pattern string"


def with_rules(specs: list[TableSpec], rules: DataFrame) -> list[TableSpec]:
    """The tables with the formats of a rules table (RULE_SCHEMA), which is metadata: at most one row per column."""
    found: dict[tuple[str, str], tuple] = {(r.table_name, r.column_name): (r.declared_type, r.pattern) for r in rules.collect()}
    out = []
    for spec in specs:
        own = {c: found[spec.name, c] for c in spec.profiled() if (spec.name, c) in found}
        types = spec.types | {c: kind for c, (kind, _) in own.items() if kind}
        out.append(replace(spec, types=types, patterns=spec.patterns | {c: p for c, (_, p) in own.items() if p}))
    return out


def _kind(dt: T.DataType) -> str:
    if isinstance(dt, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "num"
    return "char" if isinstance(dt, (T.StringType, T.CharType, T.VarcharType)) else "other"


def _as_double(name: str, dt: T.DataType) -> Column:
    c = F.col(f"`{name}`")
    if isinstance(dt, T.BooleanType):
        return c.cast("int").cast("double")
    if isinstance(dt, T.DateType):
        return F.unix_date(c).cast("double") * 86400.0
    if isinstance(dt, T.TimestampNTZType):
        return F.unix_micros(c.cast("timestamp")) / F.lit(1e6)
    if isinstance(dt, T.TimestampType):
        return F.unix_micros(c) / F.lit(1e6)
    return finite(c.cast("double"))


def _beyond_double(c: Column) -> Column:
    return F.when(F.abs(c.cast("double")) >= 2.0**53, F.pmod(c, F.lit(4096)))


def _residual(name: str, dt: T.DataType) -> Column:
    """Tells apart large integers and decimals that share one double."""
    c = F.col(f"`{name}`")
    if isinstance(dt, T.LongType):
        return _beyond_double(c)
    if isinstance(dt, T.DecimalType) and dt.precision > EXACT_DOUBLE_DIGITS:
        return F.xxhash64(c)
    return F.lit(None).cast("bigint")


def _mismatch(spec: TableSpec, name: str, c: Column, blank: Column) -> Column:
    """The value misses the declared format of its column; null where none is declared."""
    wrong = [~c.rlike(spec.patterns[name])] if name in spec.patterns else []
    wrong += [c.try_cast(spec.types[name]).isNull()] if _kind(spec.rows.schema[name].dataType) == "char" and name in spec.types else []
    return ~blank & reduce(or_, wrong) if wrong else F.lit(None).cast("boolean")


def _cell(spec: TableSpec, name: str) -> Column:
    dt = spec.rows.schema[name].dataType
    kind, c = _kind(dt), F.col(f"`{name}`")
    number = _as_double(name, dt) if kind == "num" else F.lit(None).cast("double")
    words = c.cast("string") if kind == "char" else F.lit(None).cast("string")
    blank = (F.trim(c) == "") if kind == "char" else F.lit(None).cast("boolean")
    miss = _mismatch(spec, name, c, blank)
    return F.struct(
        number.alias("num"),
        words.alias("txt"),
        _residual(name, dt).alias("res"),
        (number if kind == "num" else c).isNotNull().alias("has"),
        blank.alias("blank"),
        miss.alias("miss"),
        spec.present.get(name, F.lit(True)).alias("in_schema"),
    ).alias(name)


def melt(spec: TableSpec, part: str | None = None) -> DataFrame:
    """Long form: one row per source row and column, in a single scan of the source; ``part`` is a column to carry along."""
    names = spec.profiled()
    carried = [F.col(part).cast("string").alias("part")] if part else []
    wide = spec.rows.select(F.col(spec.version).cast("int").alias("version"), *carried, *[_cell(spec, n) for n in names])
    ids = ["version", "part"] if part else ["version"]
    long = wide.unpivot(ids, names, "column_name", "cell")
    if spec.present:
        long = long.where("cell.in_schema")
    return long.select(F.lit(spec.name).alias("table_name"), *ids, "column_name", *[f"cell.{f}" for f in CELL])


def melt_all(specs: list[TableSpec], part: str | None = None) -> DataFrame:
    out = melt(specs[0], part)
    for spec in specs[1:]:
        out = out.unionByName(melt(spec, part))
    return out


def column_catalog(spark: SparkSession, specs: list[TableSpec]) -> DataFrame:
    """Schema facts of every profiled column (driver metadata only)."""
    rows = []
    for spec in specs:
        for seq, name in enumerate(spec.profiled()):
            dt = spec.rows.schema[name].dataType
            kind = _kind(dt)
            rows.append((spec.name, name, seq, kind, dt.simpleString()))
    return spark.createDataFrame(
        rows, "table_name string, column_name string, col_seq int, data_type string, cas_data_type string"
    )


def versioned(df: DataFrame) -> DataFrame:
    """Rows without a version under NO_VERSION."""
    return df.withColumn("version", F.coalesce("version", F.lit(NO_VERSION)))


def shown(df: DataFrame) -> DataFrame:
    """NO_VERSION as null again."""
    return df.withColumn("version", F.nullif("version", F.lit(NO_VERSION)))


def digest(text: Column) -> Column:
    """16 bytes that stand for a text."""
    return F.unhex(F.md5(text))


def value_counts(long: DataFrame) -> DataFrame:
    """Rows per distinct value, NULL included: num and res of a number, digest, len and head of a text of any length.

    For rows that are molten already; ``table_counts`` has the same rows from the tables, without the long form.
    """
    counted = (
        versioned(long).withColumns(
            {
                "len": F.length("txt"),
                # a text that ends within its head needs no digest to be told apart
                "digest": F.when(F.length("txt") > HEAD, digest(F.col("txt"))),
                "head": F.left("txt", F.lit(HEAD)),
                # 0.0 and -0.0 are one value
                "num": F.col("num") + F.lit(0.0),
            }
        )
        # the head is that of the digest's text
        .groupBy(*KEYS, "has", "num", "digest", "head", "res")
        # equal texts agree in length and in both checks
        .agg(F.count(F.lit(1)).alias("cnt"), *[F.max(c).alias(c) for c in ("len", "blank", "miss")])
    )
    # digests of short texts are taken once per value, not once per row
    return counted.withColumn("digest", F.coalesce("digest", digest(F.col("head"))))


#: How the values of a column travel until they are counted.
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)


def _carrier(dt: T.DataType) -> str:
    if isinstance(dt, WHOLE):
        return "whole"
    if isinstance(dt, T.DecimalType) and dt.precision > EXACT_DOUBLE_DIGITS:
        return "decimal"
    return {"num": "real", "char": "text", "other": "nested"}[_kind(dt)]


def _carried(spec: TableSpec, name: str, carrier: str) -> dict[str, Column]:
    """What travels of a cell: as little as tells its value apart."""
    dt, c = spec.rows.schema[name].dataType, F.col(f"`{name}`")
    if carrier == "whole":
        return {"whole": (c.cast("int") if isinstance(dt, T.BooleanType) else c).cast("bigint")}
    if carrier == "real":
        # 0.0 and -0.0 are one value
        return {"num": _as_double(name, dt) + F.lit(0.0)}
    if carrier == "decimal":
        return {"num": _as_double(name, dt) + F.lit(0.0), "res": _residual(name, dt)}
    if carrier == "nested":
        return {"has": c.isNotNull()}
    text = c.cast("string")
    # a text that ends within its head is told apart, and checked, by its head: once per value, not once per row
    long = lambda value: F.when(F.length(text) > HEAD, value)
    blank = F.trim(text) == ""
    return {
        "head": F.left(text, F.lit(HEAD)), "digest": long(digest(text)), "len": long(F.length(text)),
        "blank": long(blank), "miss": long(_mismatch(spec, name, text, blank)),
    }


def _group_no(place: int, version: Column) -> Column:
    """One number for a column, by its place among all columns, and a version."""
    return F.lit(place * 2**32 - NO_VERSION) + version.cast("bigint")


def _narrow(spec: TableSpec, places: dict[tuple[str, str], int], carrier: str) -> DataFrame | None:
    """The cells of the columns with one carrier: group number and what travels."""
    names = [c for c in spec.profiled() if _carrier(spec.rows.schema[c].dataType) == carrier]
    if not names:
        return None
    version = F.coalesce(F.col(spec.version).cast("int"), F.lit(NO_VERSION))
    wide, tuples = [], []
    for i, name in enumerate(names):
        group = _group_no(places[spec.name, name], version)
        cell = {"g": F.when(spec.present[name], group) if name in spec.present else group, **_carried(spec, name, carrier)}
        wide += [c.alias(f"{part}_{i}") for part, c in cell.items()]
        tuples.append(f"({', '.join(f'{part}_{i}' for part in cell)})")
    parts = ", ".join(cell)
    return spec.rows.sparkSession.sql(
        f"SELECT {parts} FROM {{wide}} UNPIVOT INCLUDE NULLS (({parts}) FOR cell IN ({', '.join(tuples)})) WHERE g IS NOT NULL",
        wide=spec.rows.select(*wide),
    )


def _short_checks(specs: list[TableSpec], places: dict[tuple[str, str], int]) -> Column:
    """Whether a text that is its head misses the format of its column."""
    miss = F.lit(None).cast("boolean")
    for spec in specs:
        for name in spec.profiled():
            if _carrier(spec.rows.schema[name].dataType) == "text" and (name in spec.patterns or name in spec.types):
                found = _mismatch(spec, name, F.col("head"), F.trim("head") == "")
                miss = F.when(_place_no() == places[spec.name, name], found).otherwise(miss)
    return miss


def _place_no() -> Column:
    return F.shiftright("g", 32).cast("int")


def table_counts(specs: list[TableSpec]) -> DataFrame:
    """The value counts of all tables under ``g``, the number of their group; ``keyed`` gives it its names.

    Every kind of value has its own narrow aggregate, so a number is hashed and shuffled as two or three numbers.
    """
    columns = [(spec.name, name) for spec in specs for name in spec.profiled()]
    places = {column: i for i, column in enumerate(columns)}
    none = lambda kind: F.lit(None).cast(kind)
    short = F.col("digest").isNull() & F.col("head").isNotNull()
    num_only = {"has": F.col("num").isNotNull(), "digest": none("binary"), "head": none("string"), "len": none("int"), "blank": none("boolean"), "miss": none("boolean")}
    shapes = {
        "whole": {**num_only, "has": F.col("whole").isNotNull(), "num": F.col("whole").cast("double"), "res": _beyond_double(F.col("whole"))},
        "real": {**num_only, "num": F.col("num"), "res": none("bigint")},
        "decimal": {**num_only, "num": F.col("num"), "res": F.col("res")},
        "nested": {**num_only, "has": F.col("has"), "num": none("double"), "res": none("bigint")},
        "text": {
            "has": F.col("head").isNotNull(), "num": none("double"), "res": none("bigint"), "head": F.col("head"),
            "digest": F.when(short, digest(F.col("head"))).otherwise(F.col("digest")),
            "len": F.when(short, F.length("head")).otherwise(F.col("len")),
            "blank": F.when(short, F.trim("head") == "").otherwise(F.col("blank")),
            "miss": F.when(short, _short_checks(specs, places)).otherwise(F.col("miss")),
        },
    }
    kinds = []
    for carrier, shape in shapes.items():
        cells = [c for c in (_narrow(spec, places, carrier) for spec in specs) if c is not None]
        if not cells:
            continue
        cells = reduce(DataFrame.unionByName, cells)
        # equal texts agree in length and in both checks
        along = [c for c in ("len", "blank", "miss") if c in cells.columns]
        value = [c for c in cells.columns if c not in along]
        counted = cells.groupBy(*value).agg(F.count(F.lit(1)).alias("cnt"), *[F.max(c).alias(c) for c in along])
        kinds.append(counted.select("g", *[shape[c].alias(c) for c in ("has", "num", "digest", "head", "res")], "cnt", *[shape[c].alias(c) for c in ("len", "blank", "miss")]))
    return reduce(DataFrame.unionByName, kinds).withMetadata("g", {"tables": [t for t, _ in columns], "columns": [c for _, c in columns]})


def keyed(df: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    """KEYS beside the group number."""
    name = lambda i: F.array(*[F.lit(c[i]) for c in columns])[_place_no()]
    version = (F.col("g").bitwiseAND(F.lit(2**32 - 1)) + F.lit(NO_VERSION)).cast("int")
    keys = {"table_name": name(0), "version": version, "column_name": name(1)}
    return df.select(*[c.alias(k) for k, c in keys.items()], *df.columns)


def columns_of(counts: DataFrame) -> list[tuple[str, str]]:
    """The columns (with their tables) that the group numbers of value counts stand for."""
    known = counts.schema["g"].metadata
    return list(zip(known["tables"], known["columns"]))


def _group(counts: DataFrame, *others: DataFrame) -> list[str]:
    """What tells groups apart: their number, which is joined and hashed faster than names, or their names."""
    return ["g"] if all("g" in df.columns for df in (counts, *others)) else KEYS


def _named(df: DataFrame, counts: DataFrame) -> DataFrame:
    """Facts of groups with KEYS first, whatever they were grouped by."""
    return keyed(df, columns_of(counts)) if "g" in df.columns else df


def written_counts(specs: list[TableSpec]) -> DataFrame:
    """Value counts of all tables as a table in the shared folder."""
    counts = written(table_counts(specs), "value-counts")
    # names are looked up where they are read: neither stored nor shuffled
    named = keyed(counts, columns_of(counts))
    named._written_to = counts._written_to
    return named


def valued() -> Column:
    """The row of value counts holds a comparable value."""
    return F.col("num").isNotNull() | F.col("digest").isNotNull()


def basic_facts(counts: DataFrame) -> DataFrame:
    """Counts, range, mean and text lengths per group."""
    c = F.col("cnt")
    of = lambda cond: F.sum(F.when(cond, c).otherwise(0))
    n_num = of(F.col("num").isNotNull())
    facts = counts.groupBy(*_group(counts)).agg(
        F.sum(c).alias("row_count"),
        of(F.col("has")).alias("n_present"),
        n_num.alias("n_num"),
        F.count_if(valued()).alias("cardinality_count"),
        F.min("num").alias("min_val"),
        F.max("num").alias("max_val"),
        F.try_divide(F.sum(c * F.col("num")), n_num).alias("mean"),
        of(F.col("blank")).alias("blank_value_count"),
        of(F.col("miss")).alias("mismatched_count"),
        F.max("len").alias("chars_max_count"),
        F.min("len").alias("chars_min_count"),
        F.max(F.when(valued(), c)).alias("top_cnt"),
        F.min(F.when(valued(), c)).alias("low_cnt"),
    )
    return _named(facts, counts)


def spread(v: Column) -> Column:
    """Monotone map that keeps long tails from crowding the middle into one range."""
    return F.signum(v) * F.log1p(F.abs(v))


def _range_no(v: Column, lo: Column, hi: Column) -> Column:
    """Non-decreasing range number of a value; halves keep the width of the widest ranges finite."""
    width = F.greatest(hi * 0.5 - lo * 0.5, F.lit(1e-300))
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v * 0.5 - lo * 0.5) / width)) * (RANGES - 1)).cast("int")


def _place(p: float) -> Column:
    return F.lit(p) * (F.col("n") - 1)


def _holds_wanted(start: str, end: str, shares: Sequence[float]) -> Column:
    """Some wanted rank lies in [start, end)."""
    hit = F.lit(False)
    for p in shares:
        for r in (F.floor(_place(p)), F.ceil(_place(p))):
            hit = hit | ((r >= F.col(start)) & (r < F.col(end)))
    return hit


def exact_quartiles(counts: DataFrame, stats: DataFrame) -> DataFrame:
    """Exact interpolated quartiles per numeric group."""
    found = exact_quantiles(counts, stats, QUARTILES)
    return found.select(*dict.fromkeys([*KEYS, *_group(found)]), *[F.col("quantiles")[i].alias(name) for i, name in enumerate(["q25", "q50", "q75"])])


def exact_quantiles(counts: DataFrame, stats: DataFrame, shares: Sequence[float]) -> DataFrame:
    """``quantiles``: the exact interpolated quantiles of the given shares per numeric group (see the module notes)."""
    by = _group(counts, stats)
    bounds = stats.where("min_val is not null").select(
        *by, F.col("n_num").alias("n"), spread(F.col("min_val")).alias("lo"), spread(F.col("max_val")).alias("hi")
    )
    numbers = counts.where("num is not null").select(*by, "num", "cnt")
    first = numbers.join(bounds, by).withColumn("r1", _range_no(spread(F.col("num")), F.col("lo"), F.col("hi")))
    end_1 = F.sum("c1").over(Window.partitionBy(*by).orderBy("r1"))
    # the hits are a few ranges of each group: written, their size is known and Spark broadcasts them itself
    hits_1 = written(
        first.groupBy(*by, "r1")
        .agg(F.sum("cnt").alias("c1"), F.min("num").alias("lo1"), F.max("num").alias("hi1"))
        .withColumn("end1", end_1)
        .withColumn("start1", F.col("end1") - F.col("c1"))
        .join(bounds, by)
        .where(_holds_wanted("start1", "end1", shares))
        .select(*by, "n", "r1", "start1", "lo1", "hi1"),
        "ranges",
    )
    # a few ranges' values, found by the limits of the ranges and written because two passes read them
    second = written(
        numbers.join(hits_1, by)
        .where((F.col("num") >= F.col("lo1")) & (F.col("num") <= F.col("hi1")))
        .withColumn("r2", _range_no(F.col("num"), F.col("lo1"), F.col("hi1")))
        # integers beyond 2^53 may share a double: one row per double from here on
        .groupBy(*by, "n", "r1", "start1", "r2", "num")
        .agg(F.sum("cnt").alias("cnt")),
        "range-values",
    )
    end_2 = F.col("start1") + F.sum("c2").over(Window.partitionBy(*by, "r1").orderBy("r2"))
    hits_2 = written(
        second.groupBy(*by, "n", "r1", "start1", "r2")
        .agg(F.sum("cnt").alias("c2"))
        .withColumn("end2", end_2)
        .withColumn("start2", F.col("end2") - F.col("c2"))
        .where(_holds_wanted("start2", "end2", shares))
        .select(*by, "r1", "r2", "start2"),
        "ranges",
    )
    ranked = (
        second.join(hits_2, [*by, "r1", "r2"])
        .withColumn("end_rank", F.col("start2") + F.sum("cnt").over(Window.partitionBy(*by, "r1", "r2").orderBy("num")))
        .withColumn("start_rank", F.col("end_rank") - F.col("cnt"))
    )
    at = lambda r: F.max(F.when((r >= F.col("start_rank")) & (r < F.col("end_rank")), F.col("num")))
    picks = []
    for i, p in enumerate(shares):
        picks += [at(F.floor(_place(p))).alias(f"f{i}"), at(F.ceil(_place(p))).alias(f"c{i}")]
    picked = ranked.groupBy(*by).agg(F.max("n").alias("n"), *picks)
    between = [F.col(f"f{i}") + (F.col(f"c{i}") - F.col(f"f{i}")) * (_place(p) - F.floor(_place(p))) for i, p in enumerate(shares)]
    return _named(picked.select(*by, F.array(*between).alias("quantiles")), counts)


def outlier_test() -> Column:
    """Outside the 1.5 interquartile fences."""
    iqr = F.col("q75") - F.col("q25")
    return (F.col("num") < F.col("q25") - 1.5 * iqr) | (F.col("num") > F.col("q75") + 1.5 * iqr)


def frequency_extremes(counts: DataFrame, stats: DataFrame, specs: list[TableSpec]) -> DataFrame:
    """The most and the least frequent value per group (the least value wins among equals).

    Numbers and texts are aggregated apart: numeric buffers allow hash aggregation, while a text
    buffer forces a sort, so only the heads of texts at an extreme frequency go there.
    """
    c, by = F.col("cnt"), _group(counts, stats)
    at_extreme = (
        counts.where(valued())
        .join(stats.select(*by, "top_cnt", "low_cnt"), by)
        .withColumns({"top": c == F.col("top_cnt"), "low": c == F.col("low_cnt")})
        .where("top OR low")
    )
    least = lambda kind: [F.min(F.when(F.col(end), F.col(kind))).alias(f"{end}_{kind}") for end in ("top", "low")]
    numbers = _named(at_extreme.where("num is not null").groupBy(*by).agg(*least("num")), counts).drop("g")
    texts = at_extreme.where("digest is not null").select(*by, "digest", "head", "len", "top", "low")
    # the least text has the least head: what is left are few values, written so that Spark knows how few
    heads = texts.groupBy(*by).agg(*least("head"))
    first = lambda end: F.col(end) & (F.col("head") == F.col(f"{end}_head"))
    winners = texts.join(heads, by).withColumns({"top": first("top"), "low": first("low")}).where("top OR low")
    winners = _named(winners.select(*by, "digest", "head", "len", "top", "low"), counts).drop("g")
    winners = written(winners, "extreme-texts")
    # a text that ends within its head is the least of those that begin so
    whole = lambda end: F.max(F.when(F.col(end) & (F.col("len") <= HEAD), F.col("head")))
    words = winners.groupBy(*KEYS).agg(whole("top").alias("top_txt"), whole("low").alias("low_txt"))
    long = winners.where(F.col("len") > HEAD)
    if not long.isEmpty():
        fetched = fetched_texts(long, specs).groupBy(*KEYS).agg(*least("txt"))
        fetched = fetched.select(*KEYS, *[F.col(f"{end}_txt").alias(f"{end}_fetched") for end in ("top", "low")])
        whole_or = lambda end: F.coalesce(f"{end}_txt", f"{end}_fetched").alias(f"{end}_txt")
        words = words.join(fetched, KEYS, "left").select(*KEYS, whole_or("top"), whole_or("low"))
    return numbers.join(words, KEYS, "full")


def fetched_texts(wanted: DataFrame, specs: list[TableSpec]) -> DataFrame:
    """The whole texts of the wanted digests, from one more scan of the columns that hold any."""
    held = {(r.table_name, r.column_name) for r in wanted.select("table_name", "column_name").distinct().collect()}
    scanned = [replace(s, columns=[c for c in s.profiled() if (s.name, c) in held]) for s in specs]
    cells = versioned(melt_all([s for s in scanned if s.columns]).where("txt IS NOT NULL").select(*KEYS, "txt"))
    return cells.withColumn("digest", digest(F.col("txt"))).join(wanted, [*KEYS, "digest"])


def value_facts(counts: DataFrame, stats: DataFrame, quartiles: DataFrame, specs: list[TableSpec]) -> DataFrame:
    """Central moments, outliers and extremes of frequency. ``stats`` and ``quartiles`` are written tables."""
    d, c = F.col("num") - F.col("mean"), F.col("cnt")
    by = _group(counts, stats, quartiles)
    # two small tables, joined one by one: of their join Spark would not know that it is small, and shuffle the counts
    numbers = (
        counts.where("num is not null")
        .join(stats.select(*by, "mean", "n_num"), by)
        .join(quartiles.select(*by, "q25", "q50", "q75"), by)
        .withColumn("d", d)
        .withColumn("d2", F.col("d") * F.col("d"))
        .groupBy(*by)
        .agg(
            F.max("n_num").cast("double").alias("n"),
            F.sum(c * F.col("d2")).alias("m2"),
            F.sum(c * F.col("d2") * F.col("d")).alias("m3"),
            F.sum(c * F.col("d2") * F.col("d2")).alias("m4"),
            F.sum(F.when(outlier_test(), c).otherwise(0)).alias("n_outliers"),
            *[F.max(q).alias(q) for q in ("q25", "q50", "q75")],
        )
    )
    n, m2 = F.col("n"), F.col("m2")
    spread = m2 > 0
    return (
        _named(numbers, counts).drop("g").join(frequency_extremes(counts, stats, specs), KEYS, "full")
        .withColumns(
            {
                "std": F.when(n > 1, F.sqrt(m2 / (n - 1))),
                "skewness": F.when(spread, F.sqrt(n) * F.col("m3") / (m2 * F.sqrt(m2))),
                "kurtosis": F.when(spread, n * F.col("m4") / (m2 * m2) - 3.0),
                "most_common_value": F.coalesce("top_txt", F.col("top_num").cast("string")),
                "least_common_value": F.coalesce("low_txt", F.col("low_num").cast("string")),
            }
        )
        .drop("n", "m2", "m3", "m4")
    )


def sketch_facts(specs: list[TableSpec]) -> tuple[DataFrame, DataFrame]:
    """The same facts from mergeable sketches: exact counts and moments, estimated ranks and distinct values.

    Distinct values err by about 1 % (standard error), quartiles by one rank in SKETCH_ACCURACY. The mode is the
    exactly counted most frequent value (``mode_count``) if more than FREQUENT of the rows hold it, or if the group
    has at most CANDIDATES values, which are then all counted; otherwise no value is frequent and it is NULL. The
    least frequent value is given in the second case only: no sketch can tell it among many.
    """
    long = hashed_cells(specs)
    stats = long.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if("has").alias("n_present"),
        F.approx_count_distinct("h", 0.01).alias("cardinality_count"),
        F.min("num").alias("min_val"),
        F.max("num").alias("max_val"),
        F.avg("num").alias("mean"),
        F.stddev_samp("num").alias("std"),
        F.skewness("num").alias("skewness"),
        F.kurtosis("num").alias("kurtosis"),
        F.count_if("blank").alias("blank_value_count"),
        F.count_if("miss").alias("mismatched_count"),
        F.max(F.length("txt")).alias("chars_max_count"),
        F.min(F.length("txt")).alias("chars_min_count"),
        F.percentile_approx("num", list(QUARTILES), SKETCH_ACCURACY).alias("q"),
        F.expr(f"approx_top_k(h, {CANDIDATES}, {TRACKED}) FILTER (WHERE h IS NOT NULL)").alias("frequent"),
    ).withColumns({name: F.col("q")[i] for i, name in enumerate(["q25", "q50", "q75"])}).drop("q")
    stats = written(stats, "sketch-facts")  # one row per group: small enough to broadcast against the rows
    numeric = [s for s in (spec.only("num") for spec in specs) if s]
    fences = stats.select(*KEYS, "q25", "q50", "q75")
    # both have one row per group, and are written so that Spark knows it
    facts = stats.select(*KEYS).join(written(frequent_values(specs, stats), "frequent"), KEYS, "left")
    if numeric:
        cells = versioned(melt_all(numeric).select(*KEYS, "num")).where("num IS NOT NULL")
        outliers = cells.join(fences, KEYS).groupBy(*KEYS).agg(F.count_if(outlier_test()).alias("n_outliers"))
        facts = facts.join(written(outliers, "outliers"), KEYS, "left")
    else:
        facts = facts.withColumn("n_outliers", F.lit(0).cast("bigint"))
    return stats.drop("frequent"), facts


def hashed_cells(specs: list[TableSpec]) -> DataFrame:
    """The long form with ``h``, a hash of each value that is there."""
    long = versioned(melt_all(specs)).withColumn("num", F.col("num") + F.lit(0.0))  # 0.0 and -0.0 are one value
    return long.withColumn("h", F.when(F.col("has"), F.xxhash64("num", "txt", "res")))


def frequent_values(specs: list[TableSpec], stats: DataFrame) -> DataFrame:
    """most_common_value, mode_count and least_common_value of the groups whose frequent values settle them."""
    # where nothing is frequent and not all values are listed, no candidate can be the mode
    listed, low = F.size("frequent") < CANDIDATES, F.lit(FREQUENT / 2) * F.col("row_count")
    found = stats.select(*KEYS, "row_count", F.filter("frequent", lambda x: x["count"] >= low).alias("often"), "frequent", listed.alias("listed"))
    chosen = F.when(F.col("listed"), F.col("frequent")).otherwise(F.col("often"))
    candidates = written(found.select(*KEYS, F.explode(F.transform(chosen, lambda x: x["item"])).alias("h")), "candidates")
    # only columns with candidates are read again; at most one row per column comes to the driver
    held = {(r.table_name, r.column_name) for r in candidates.select("table_name", "column_name").distinct().collect()}
    scanned = [replace(s, columns=[c for c in s.profiled() if (s.name, c) in held]) for s in specs]
    scanned = [s for s in scanned if s.columns] or specs[:1]
    counted = hashed_cells(scanned).where("h IS NOT NULL").join(candidates, [*KEYS, "h"]).groupBy(*KEYS, "num", "txt", "res").agg(F.count(F.lit(1)).alias("c"))
    counted = counted.withColumn("value", F.struct("num", "txt"))
    # at most CANDIDATES values of a group
    per = counted.groupBy(*KEYS).agg(
        F.min(F.struct((-F.col("c")).alias("c"), "value")).alias("most"), F.min(F.struct("c", "value")).alias("least"), F.sum("c").alias("covered")
    )
    shown_as = lambda v: F.coalesce(F.col(f"{v}.value.txt"), F.col(f"{v}.value.num").cast("string"))
    whole = F.col("covered") == F.col("n_present")
    settled = whole | (-F.col("most.c") > FREQUENT * F.col("row_count"))
    return per.join(stats.select(*KEYS, "row_count", "n_present"), KEYS).select(
        *KEYS,
        F.when(settled, shown_as("most")).alias("most_common_value"),
        F.when(settled, -F.col("most.c")).alias("mode_count"),
        F.when(whole, shown_as("least")).alias("least_common_value"),
    )


def infer_scale() -> Column:
    """Scale from counts; identifiers must be integral or text, since measures are often all distinct."""
    card, rows = F.col("cardinality_count"), F.col("row_count")
    discrete = (F.col("data_type") == "char") | F.col("cas_data_type").isin("tinyint", "smallint", "int", "bigint")
    return (
        F.when(F.col("data_type") == "other", "nested")
        .when(card <= 1, "unary")
        .when(card == 2, "binary")
        .when((card == rows) & discrete, "id")
        .when(F.col("data_type") == "char", "nominal")
        .otherwise("interval")
    )


PROFILE_COLUMNS = [
    "table_name", "version", "abt_name", "snapshot_date", "row_count", "col_seq", "column_name",
    "data_type", "cas_data_type", "statistical_scale", "ordinal_position", "completeness_percent",
    "missing_count", "cardinality_count", "uniqueness_percent", "mean", "median", "std", "min_val",
    "max_val", "skewness", "kurtosis", "q25", "q50", "q75", "has_outliers", "n_outliers",
    "most_common_value", "least_common_value", "mode", "blank_value_count", "mismatched_count",
    "chars_max_count", "chars_min_count", "information_privacy", "semantic_type_id",
    "semantic_type_score", "has_unique_field", "actual_data_type", "best_chart_type", "raw_length",
]


def profile(
    spark: SparkSession,
    specs: list[TableSpec],
    overrides: DataFrame | None = None,
    snapshot_date: str | None = None,
    mode: str = "exact",
    counts: DataFrame | None = None,
) -> DataFrame:
    """Profile facts of all tables and versions. ``mode`` is ``exact`` or ``sketch``.

    Exact mode reads value counts by several passes: they are written once, so the source is scanned
    once. Pass ``counts`` (from ``written_counts``) to share them with other work on the same rows.
    """
    if mode == "sketch":
        stats, facts = sketch_facts(specs)
    else:
        counts = written_counts(specs) if counts is None else counts
        stats = written(basic_facts(counts), "facts")
        facts = value_facts(counts, stats, written(exact_quartiles(counts, stats), "quartiles"), specs)
    return finished(spark, shown(stats.drop("g", "n_num", "top_cnt", "low_cnt").join(facts, KEYS, "left")), specs, overrides, snapshot_date)


def finished(spark: SparkSession, facts: DataFrame, specs: list[TableSpec], overrides: DataFrame | None = None, snapshot_date: str | None = None) -> DataFrame:
    """The profile from the measured facts of every group: schema, declared facts, shares and scales added."""
    if overrides is None:
        overrides = spark.createDataFrame([], OVERRIDE_SCHEMA)
    wide = (
        facts
        .join(column_catalog(spark, specs), ["table_name", "column_name"])
        .join(
            overrides.select(
                "table_name", "column_name", F.col("statistical_scale").alias("given_scale"), "information_privacy"
            ),
            ["table_name", "column_name"],
            "left",
        )
    )
    rows = F.col("row_count")
    # nested and binary columns have a completeness, but no values that could be told apart
    wide = wide.withColumn("cardinality_count", F.when(F.col("data_type") != "other", F.col("cardinality_count")))
    return wide.withColumns(
        {
            "abt_name": F.concat("table_name", F.lit("_v"), F.coalesce(F.col("version").cast("string"), F.lit("none"))),
            "snapshot_date": F.lit(snapshot_date or "unknown"),
            "statistical_scale": F.coalesce("given_scale", infer_scale()),
            "ordinal_position": F.col("col_seq"),
            "completeness_percent": 100.0 * F.col("n_present") / rows,
            "missing_count": rows - F.col("n_present"),
            "uniqueness_percent": 100.0 * F.col("cardinality_count") / rows,
            "median": F.col("q50"),
            "n_outliers": F.coalesce("n_outliers", F.lit(0)),
            "has_outliers": F.coalesce(F.col("n_outliers") > 0, F.lit(False)),
            "mode": F.col("most_common_value"),
            "has_unique_field": (F.col("cardinality_count") == rows) & (F.col("data_type") == "char")
            | (F.col("cardinality_count") == rows) & (F.col("cas_data_type").isin("int", "bigint")),
            "semantic_type_id": F.lit(None).cast("string"),
            "semantic_type_score": F.lit(None).cast("double"),
            "actual_data_type": F.col("cas_data_type"),
            "best_chart_type": F.when(F.col("data_type") == "num", "histogram").otherwise("bar"),
            "raw_length": F.col("chars_max_count"),
        }
    ).select(*PROFILE_COLUMNS)
