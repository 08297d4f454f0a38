import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    yield session
    session.stop()


PROFILE_SCHEMA = """table_name string, version int, abt_name string, snapshot_date string, row_count bigint, col_seq int,
column_name string, data_type string, cas_data_type string, statistical_scale string, ordinal_position int,
completeness_percent double, missing_count bigint, cardinality_count bigint, uniqueness_percent double, mean double,
median double, std double, min_val double, max_val double, skewness double, kurtosis double, q25 double, q50 double,
q75 double, has_outliers boolean, n_outliers bigint, blank_value_count bigint, mismatched_count bigint,
information_privacy string, has_unique_field boolean"""


@pytest.fixture(scope="session")
def make_profile(spark):
    """Profile rows from dicts; unnamed facts take plain defaults of a clean interval column."""

    def build(*rows):
        out = []
        for i, r in enumerate(rows):
            base = dict(
                table_name="t", version=1, snapshot_date="unknown", row_count=1000, col_seq=i, column_name="x",
                data_type="num", cas_data_type="double", statistical_scale="interval", ordinal_position=i,
                completeness_percent=100.0, missing_count=0, cardinality_count=100, uniqueness_percent=10.0, mean=50.0,
                median=50.0, std=29.0, min_val=0.0, max_val=100.0, skewness=0.0, kurtosis=-1.2, q25=25.0, q50=50.0,
                q75=75.0, has_outliers=False, n_outliers=0, blank_value_count=0, mismatched_count=0,
                information_privacy=None, has_unique_field=False,
            )
            base.update(r)
            base.setdefault("abt_name", f"{base['table_name']}_v{base['version']}")
            names = [c.strip().split()[0] for c in PROFILE_SCHEMA.replace("\n", " ").split(",")]
            out.append(tuple(base[n] for n in names))
        return spark.createDataFrame(out, PROFILE_SCHEMA)

    return build
