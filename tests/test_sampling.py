import hashlib
from collections import Counter
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.operators import exact_sampling
from riskloom.operators import sampling


def labelled(spark, sizes):
    rows = [(label, n) for label, n in sizes.items()]
    return (
        spark.createDataFrame(rows, "label int, n int")
        .select("label", F.explode(F.sequence(F.lit(1), "n")).alias("i"))
        .select("label", (F.col("label") * 1_000_000 + F.col("i")).alias("id"))
    )


def test_plan(spark):
    plan = {r["label"]: r for r in sampling.resample_plan(labelled(spark, {0: 100, 1: 20, 2: 3}), "label").collect()}
    assert {r["target"] for r in plan.values()} == {41}
    assert [plan[k]["fraction"] for k in (0, 1, 2)] == [0.41, 2.05, 10.0]


def test_plan_leaves_out_absent_classes(spark):
    plan = {r["label"]: r["target"] for r in sampling.resample_plan(labelled(spark, {0: 30, 2: 10}), "label").collect()}
    assert plan == {0: 20, 2: 20}


@pytest.mark.parametrize("resample", ["hash", "random"])
def test_resample_balances(spark, resample):
    df = labelled(spark, {0: 6000, 1: 2900, 2: 100})
    if resample == "hash":
        out = sampling.resample_hash(df, "label", "id")
        again = sampling.resample_hash(df.repartition(3), "label", "id")
        assert out.exceptAll(again).isEmpty()
        assert out.groupBy("id", "copy").count().filter("count > 1").isEmpty()
    else:
        out = sampling.resample_random(df, "label")
    sizes = {r[0]: r[1] for r in out.groupBy("label").count().collect()}
    assert sizes[0] == pytest.approx(3000, rel=0.07)
    assert sizes[1] == pytest.approx(3000, rel=0.07)
    assert sizes[2] == pytest.approx(1000, rel=0.2)  # at most ten copies of each
    assert out.join(df, "id", "left_anti").isEmpty()


def test_equal_classes_stay_as_they_are(spark):
    df = labelled(spark, {0: 50, 1: 50, 2: 50})
    assert sampling.resample_hash(df, "label", "id").count() == 150
    assert sampling.resample_random(df, "label").exceptAll(df).isEmpty()


def test_resampling_one_dominant_class_does_not_shuffle_rows(spark):
    df = labelled(spark, {0: 9000, 1: 10, 2: 10})
    plan = sampling.resample_hash(df, "label", "id")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan


@pytest.mark.parametrize("mark", [sampling.mark_holdout, sampling.mark_holdout_murmur])
def test_splits_by_key(spark, mark):
    df = spark.range(50_000).select(F.col("id").alias("prescriber_id"))
    train, holdout = sampling.split_marked(mark(df))
    assert train.join(holdout, "prescriber_id", "left_semi").isEmpty()
    assert train.count() + holdout.count() == 50_000
    assert holdout.count() == pytest.approx(10_000, rel=0.05)


def test_random_split_is_complete(spark):
    train, holdout = sampling.split_random(spark.range(5000))
    assert train.union(holdout).distinct().count() == 5000 == train.count() + holdout.count()


def test_samples(spark):
    df = spark.range(20_000).select(F.col("id").alias("k"))
    assert sampling.sample_uniform(df, 0.2).count() == pytest.approx(4000, rel=0.1)
    once = sampling.sample_hash(df, "k", 0.2)
    assert once.count() == pytest.approx(4000, rel=0.1)
    assert once.exceptAll(sampling.sample_hash(df.repartition(7), "k", 0.2)).isEmpty()


def test_standardize_fits_on_the_given_rows(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"x": rng.normal(5, 2, 300), "c": np.full(300, 3.0), "train": rng.random(300) < 0.7})
    rows = [(float(x), float(c), bool(t)) for x, c, t in pdf.itertuples(index=False, name=None)]
    df = spark.createDataFrame(rows, "x double, c double, train boolean")
    out = sampling.standardize(df, ["x", "c"], df.filter("train"))
    fit = pdf[pdf.train].x
    want = sorted((pdf.x - fit.mean()) / fit.std(ddof=0))
    assert sorted(r["x"] for r in out.collect()) == pytest.approx(want)
    assert {r["c"] for r in out.collect()} == {0.0}


def test_a_sample_can_be_split(spark):
    keys = spark.range(20_000).withColumnRenamed("id", "k")
    sample = sampling.sample_hash(keys, "k", 0.2)
    train, holdout = sampling.split_marked(sampling.mark_holdout(sample, "k"))
    share = holdout.count() / sample.count()
    assert 0.17 < share < 0.23 and train.count() > 0


def test_unlisted_labels_stop_balancing(spark):
    df = spark.createDataFrame([(i, i % 4) for i in range(400)], "id bigint, label int")
    for balance in (lambda d: sampling.resample_hash(d, "label", "id"), lambda d: sampling.resample_random(d, "label")):
        with pytest.raises(Exception, match="100 rows have a label"):
            balance(df).collect()
        with pytest.raises(Exception, match="rows have a label"):
            balance(spark.createDataFrame([(1, None)], "id bigint, label int")).collect()
    assert sampling.resample_hash(df, "label", "id", classes=range(4)).count() == 400


def test_most_copies_is_an_argument(spark):
    df = spark.createDataFrame([(i, 0 if i < 100 else 1) for i in range(102)], "id bigint, label int")
    assert sampling.resample_hash(df, "label", "id", most_copies=3.0).filter("label = 1").count() == 6


def exact_by_hand(pairs, most=10):
    """Copies of each (key, row) as the classes' sizes ask for: whole ones, and one more in hash order."""
    by_class = {}
    for key, label in pairs:
        by_class.setdefault(label, []).append(key)
    target = len(pairs) // len(by_class)
    out = Counter()
    for label, keys in by_class.items():
        size = min(target, most * len(keys))
        order = sorted(keys, key=lambda k: hashlib.sha256(f"balance:{k}".encode()).hexdigest()[:16])
        for place, key in enumerate(order):
            out[key, label] += size // len(keys) + (place < size % len(keys))
    return +out


@pytest.mark.parametrize("sizes", [(500, 40, 3), (70, 70, 70), (1, 1, 900), (5000, 0, 17)])
def test_exact_class_sizes(spark, sizes):
    pairs = [(f"k{c}-{i}", c) for c, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(pairs, "prescriber_id string, y int").repartition(7)
    out = exact_sampling.resample_exact(df, "y", "prescriber_id")
    rows = [tuple(r) for r in out.select("prescriber_id", "y").collect()]
    assert Counter(rows) == exact_by_hand(pairs)
    assert out.filter("copy < 1").isEmpty() and out.columns == ["prescriber_id", "y", "copy"]


def test_exact_sizes_with_one_key_in_most_rows(spark):
    """Rows of one key have the same hash; their numbers still tell them apart."""
    pairs = [("hot", 0)] * 4000 + [(None, 0)] * 20 + [(f"k{i}", 1) for i in range(300)]
    df = spark.createDataFrame(pairs, "prescriber_id string, y int").repartition(9)
    sizes = {r["y"]: r["n"] for r in exact_sampling.resample_exact(df, "y", "prescriber_id").groupBy("y").agg(F.count("*").alias("n")).collect()}
    assert sizes == {0: 2160, 1: 2160}
    assert exact_sampling.resample_exact(df.limit(0), "y", "prescriber_id").collect() == []


def test_bounds_need_enough_rows(spark):
    ordered = exact_sampling.with_order(spark.createDataFrame([("a", 0), ("b", 0)], "k string, y int"), "k")
    assert exact_sampling.least_bounds(ordered, "y", {0: 0}) == {}
    assert ordered.filter(F.col("_order") <= exact_sampling.least_bounds(ordered, "y", {0: 2})[0] + "~").count() == 2
    with pytest.raises(ValueError, match="fewer"):
        exact_sampling.least_bounds(ordered, "y", {0: 3})
