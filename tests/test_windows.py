import random

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from riskloom.operators.features import add_peer_deviation, peer_average
from riskloom.operators.windows import over_groups, peer_comparison

COLUMNS = {"n": ("count", "v"), "s": ("sum", "v"), "m": ("avg", "v"), "lo": ("min", "v"), "hi": ("max", "v"), "last": ("max", "name")}


@pytest.fixture(scope="module")
def skewed(spark):
    """One group with most rows, a null group, a group without values; over many partitions."""
    r = random.Random(2)
    rows = [("hot" if r.random() < 0.8 else r.choice(["a", "b", None]), r.choice([1.5, 2.5, -4.0, None]), f"n{i % 7}") for i in range(3000)]
    rows += [("empty", None, "x")] * 3
    return spark.createDataFrame(rows, "g string, v double, name string").repartition(12)


def test_like_a_plain_window(spark, skewed):
    w = Window.partitionBy("g")
    plain = skewed.select(
        "*", F.count("v").over(w).alias("n"), F.sum("v").over(w).alias("s"), F.avg("v").over(w).alias("m"),
        F.min("v").over(w).alias("lo"), F.max("v").over(w).alias("hi"), F.max("name").over(w).alias("last"),
    )
    found = over_groups(skewed, ["g"], COLUMNS)
    assert found.columns == plain.columns
    order = lambda df: df.toPandas().sort_values(["g", "v", "name"], na_position="first").reset_index(drop=True)
    pd.testing.assert_frame_equal(order(found), order(plain), check_exact=False)


def test_no_group_is_gathered(spark, skewed):
    """The window sees a row per group and task, not the rows of the group."""
    from riskloom.operators import windows

    seen = []
    original = windows.stage

    def watched(df, name):
        out = original(df, name)
        seen.append((name, out.count()))
        return out

    windows.stage = watched
    try:
        assert over_groups(skewed, ["g"], {"n": ("count", "v")}).count() == skewed.count()
    finally:
        windows.stage = original
    assert dict(seen)["group-totals"] <= 5 * 12 < dict(seen)["pieces"]


def test_empty_and_two_keys(spark, skewed):
    assert over_groups(skewed.limit(0), ["g"], COLUMNS).collect() == []
    two = over_groups(skewed, ["g", "name"], {"n": ("count", "v")})
    w = Window.partitionBy("g", "name")
    plain = skewed.withColumn("n", F.count("v").over(w))
    assert two.exceptAll(plain).isEmpty() and plain.exceptAll(two).isEmpty()


def test_peer_comparison_like_the_join(spark, scored):
    level = scored.drop("peer_avg_payment", "peer_deviation_score")
    joined = {r["prescriber_id"]: r["peer_deviation_score"] for r in add_peer_deviation(level, peer_average(level)).collect()}
    for r in peer_comparison(level).collect():
        assert r["peer_deviation_score"] == pytest.approx(joined[r["prescriber_id"]], rel=1e-9)
