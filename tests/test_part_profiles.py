import random

import pytest
from pyspark.sql import functions as F

from riskloom.operators.part_profiles import merge_profiles, profile_parts, read_profiles, sketch_error, store_profiles
from riskloom.operators.profiling import profile_columns

SCHEMA = "month string, a double, b int, big double, text string, day date, nothing string"


@pytest.fixture(scope="module")
def df(spark):
    r = random.Random(8)
    rows = [
        (r.choice(["01", "02", "03"]), r.choice([None, -0.0, 0.0, r.gauss(5, 2)]), r.randint(0, 9), 1e9 + r.random(), f"t{r.randint(0, 4000)}" if i % 3 else None, None, None)
        for i in range(9000)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def check(merged, whole):
    found = {r["column_name"]: r for r in merged.collect()}
    assert len(found) == len(whole.columns)
    for want in profile_columns(whole).collect():
        got = found[want["column_name"]]
        assert (got["data_type"], got["n_missing"], got["min"], got["max"]) == (want["data_type"], want["n_missing"], want["min"], want["max"])
        for name in ("mean", "stddev"):
            assert got[name] == (None if want[name] is None else pytest.approx(want[name], rel=1e-6, abs=1e-12))  # a spread of 0.3 around 1e9
        assert abs(got["n_distinct"] - want["n_distinct"]) <= max(1, 4 * sketch_error() * want["n_distinct"])


def test_merged_parts_are_the_profile_of_the_table(spark, df, tmp_path):
    path = str(tmp_path / "profiles")
    month = F.col("month")
    store_profiles(profile_parts(df.filter("month <> '03'"), month), path)
    check(merge_profiles(read_profiles(spark, path)), df.filter("month <> '03'"))
    store_profiles(profile_parts(df.filter("month = '03'"), month), path)
    check(merge_profiles(read_profiles(spark, path)), df)
    # A corrected part takes the place of the old one, the others stay.
    corrected = df.filter("month = '02' and b < 5").withColumn("a", F.lit(1.0))
    store_profiles(profile_parts(corrected, month), path)
    check(merge_profiles(read_profiles(spark, path)), df.filter("month <> '02'").unionByName(corrected))


def test_single_rows_nulls_and_nothing(spark, df):
    one = df.limit(1)
    check(merge_profiles(profile_parts(one, F.col("month"))), one)
    empty = df.filter("a is null").limit(50)
    check(merge_profiles(profile_parts(empty, F.lit(None))), empty)
    assert merge_profiles(profile_parts(df.limit(0), F.col("month"))).collect() == []
