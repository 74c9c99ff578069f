import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.operators import profiling


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(3)
    n = 500
    pdf = pd.DataFrame(
        {
            "a": rng.normal(50, 3, n).round(3),
            "b": rng.exponential(9, n).round(2),
            "k": rng.integers(0, 4, n),
            "constant": np.full(n, 0.1),
            "text": rng.choice(["x", "y", None], n),
        }
    )
    pdf.loc[rng.random(n) < 0.2, "a"] = np.nan
    pdf.loc[rng.random(n) < 0.3, "b"] = np.nan
    return pdf


@pytest.fixture(scope="module")
def df(spark, sample):
    rows = [tuple(None if pd.isna(v) else v.item() if hasattr(v, "item") else v for v in r) for r in sample.values]
    rows = [(a, b, int(k), c, t) for a, b, k, c, t in rows]
    return spark.createDataFrame(rows, "a double, b double, k bigint, constant double, text string").repartition(5)


def by_name(frame, key="column_name"):
    return {r[key]: r for r in frame.collect()}


def test_shape_and_missing(df, sample):
    assert tuple(profiling.dataset_shape(df).first()) == (500, 5)
    got = {k: r["n_missing"] for k, r in by_name(profiling.missing_values(df)).items()}
    assert got == sample.isna().sum().to_dict()


def test_summary_includes_bigint(df, sample):
    got = by_name(profiling.summary_stats(df))
    assert set(got) == {"a", "b", "k", "constant"}
    for c in got:
        assert got[c]["n_values"] == sample[c].count()
        assert got[c]["mean"] == pytest.approx(sample[c].mean())
        assert got[c]["stddev"] == pytest.approx(sample[c].std(), abs=1e-12)
        assert (got[c]["min"], got[c]["max"]) == (sample[c].min(), sample[c].max())


def test_distinct_counts_null_as_a_value(spark, df, sample):
    got = {k: r["n_distinct"] for k, r in by_name(profiling.distinct_counts(df)).items()}
    assert got == {c: sample[c].nunique(dropna=False) for c in sample}
    zeros = spark.createDataFrame([(0.0,), (-0.0,), (None,)], "z double")
    assert profiling.distinct_counts(zeros).first()["n_distinct"] == 2
    assert profiling.distinct_counts(zeros.limit(0)).first()["n_distinct"] == 0
    rough = {k: r["n_distinct"] for k, r in by_name(profiling.approximate_distinct_counts(df)).items()}
    assert rough["k"] == 4


def test_profile_columns(df, sample):
    got = by_name(profiling.profile_columns(df))
    assert list(sorted(got)) == sorted(sample.columns)
    assert got["text"]["data_type"] == "string" and got["text"]["mean"] is None
    assert got["a"]["n_missing"] == sample["a"].isna().sum()


def test_correlation_uses_rows_where_both_are_known(df, sample):
    want = sample[["a", "b", "k", "constant"]].corr()
    got = {(r[0], r[1]): r[2] for r in profiling.correlation_matrix(df).collect()}
    assert len(got) == 16
    for (x, y), value in got.items():
        if "constant" in (x, y):
            assert value is None
        else:
            assert value == pytest.approx(want.loc[x, y], abs=1e-9)


def test_correlation_of_columns_never_known_together(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (None, 3.0), (None, 4.0)], "x double, y double")
    got = {(r[0], r[1]): r[2] for r in profiling.correlation_matrix(df).collect()}
    assert got[("x", "y")] is None and got[("x", "x")] == pytest.approx(1.0)


def test_histogram_covers_all_rows(spark, df, sample):
    values = sample["b"].dropna().to_numpy()
    want, _ = np.histogram(values, bins=50)
    got = {r["bin"]: r["n_rows"] for r in profiling.histogram(df, "b").collect()}
    assert sum(got.values()) == len(values)
    assert sum(abs(got.get(i, 0) - w) for i, w in enumerate(want)) <= 2  # bin edges may differ by rounding
    flat = spark.createDataFrame([(4.0,)] * 3, "v double")
    bins = sorted(tuple(r) for r in profiling.histogram(flat, "v").collect())
    assert len(bins) == 50 and bins[0] == (0, 4.0, 4.0, 3) and not any(r[3] for r in bins[1:])


def test_outliers(spark):
    df = spark.createDataFrame([(float(i % 5),) for i in range(200)] + [(500.0,), (None,)], "v double")
    assert [r[0] for r in profiling.outliers_3sigma(df, "v").collect()] == [500.0]


def test_duplicates_and_distinct(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, "a"), (1, "a"), (1, "a")], "x int, y string")
    assert profiling.duplicate_rows(df).first()[0] == 3
    assert profiling.distinct_rows(df).count() == 2
    assert profiling.duplicate_rows(df.limit(0)).first()[0] == 0


def test_top_values(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), (None,), (None,)], "v string")
    assert [tuple(r) for r in profiling.top_values(df, "v", 2).collect()] == [(None, 3), ("a", 1)]
    assert [r[0] for r in profiling.top_values(df, "v", keep_null=False).collect()] == ["a", "b"]
    weighted = spark.createDataFrame([("a", 5), ("b", 2), ("b", 4)], "v string, w bigint")
    assert [tuple(r) for r in profiling.top_values(weighted, "v", weight="w").collect()] == [("b", 6), ("a", 5)]


def test_numeric_columns_are_found(df):
    assert profiling.numeric_columns(df.withColumn("d", F.lit(1).cast("decimal(5,2)"))) == [
        "a", "b", "k", "constant", "d",
    ]
