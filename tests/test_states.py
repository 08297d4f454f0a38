"""Profiles merged from stored states of parts, against one over all rows."""

from dataclasses import replace

import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from varve.plans import tables
from varve.sources import rows, states


def test_parts_merge_to_the_whole_profile_without_reading_old_rows(spark, tmp_path):
    path = str(tmp_path / "states")
    specs = tables.specs(spark, SF_DIR)[:3]
    parted = [replace(s, rows=s.rows.withColumn("load", F.pmod(F.hash(*s.profiled()[:2]), F.lit(3))), columns=s.profiled()) for s in specs]
    first = [replace(s, rows=s.rows.where("load < 2")) for s in parted]
    second = [replace(s, rows=s.rows.where("load = 2")) for s in parted]
    states.write_states(states.partial_states(first, "load"), path)
    before = {(r.table_name, r.version, r.column_name): r for r in states.profile_of_states(spark, states.read_states(spark, path), specs).collect()}
    for _ in range(2):  # loaded again, a part replaces itself
        states.write_states(states.partial_states(second, "load"), path)
    merged = states.profile_of_states(spark, states.read_states(spark, path), specs)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and "Python" not in plan
    got = {(r.table_name, r.version, r.column_name): r.asDict() for r in merged.collect()}
    want = {(r.table_name, r.version, r.column_name): r.asDict() for r in rows.profile(spark, specs).collect()}
    assert got.keys() == want.keys() and any(before[k].row_count < want[k]["row_count"] for k in before)
    for key, w in want.items():
        g = got[key]
        for name in ("row_count", "missing_count", "min_val", "max_val", "blank_value_count", "mismatched_count", "chars_max_count", "chars_min_count"):
            assert g[name] == w[name], (key, name)
        for name in ("mean", "std", "skewness", "kurtosis"):
            assert g[name] is None if w[name] is None else g[name] == pytest.approx(w[name], rel=1e-6, abs=1e-6), (key, name)
        if w["cardinality_count"] is not None:
            assert abs(g["cardinality_count"] - w["cardinality_count"]) <= max(1, 0.08 * w["cardinality_count"])
        if w["q50"] is not None and w["row_count"] > 50 and w["cardinality_count"] > 10:  # else a quartile is one of few values
            assert abs(g["q50"] - w["q50"]) <= 0.1 * (w["max_val"] - w["min_val"]) + 1e-9
            assert abs(g["n_outliers"] - w["n_outliers"]) <= 0.1 * w["row_count"]
    assert got["abt_orders", 1995, "segment"]["mode"] == want["abt_orders", 1995, "segment"]["mode"]


def test_moments_merge_far_from_zero(spark):
    df = spark.range(3000).select(F.lit(1).alias("version"), (F.col("id") % 7).alias("load"), (F.lit(1e8) + F.col("id") % 13 + (F.col("id") % 7) * 100).alias("x"))
    spec = rows.TableSpec("t", df, columns=["x"])
    g = states.profile_of_states(spark, states.partial_states([spec], "load"), [spec]).first()
    w = rows.profile(spark, [spec]).first()
    for name in ("mean", "std", "skewness", "kurtosis"):
        assert g[name] == pytest.approx(w[name], rel=1e-7)
