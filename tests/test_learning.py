import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from riskloom.learning import dataset, evaluation, scoring, training
from riskloom.schemas import MODEL_FEATURES, RULE_INPUTS
from riskloom.sources import models
from riskloom.sources.readers import MissingColumns, MissingInput


@pytest.fixture(scope="module")
def split(scored):
    return dataset.staged_split(scored)


@pytest.fixture(scope="module")
def forest(split):
    return training.train_forest(split[0], num_trees=8, max_depth=4)


def test_rule_inputs_are_refused_as_features():
    assert not set(MODEL_FEATURES) & set(RULE_INPUTS)
    with pytest.raises(dataset.LeakyFeature, match="opioid_claims"):
        dataset.assembler([*MODEL_FEATURES, "opioid_claims"])


def test_labels(spark, scored):
    with pytest.raises(MissingColumns):
        dataset.labelled(scored.drop("fraud_risk_category"))
    missing = spark.createDataFrame([("Low", "5"), (None, "1"), ("High", "x")], "fraud_risk_category string, total_claims string")
    got = [(r["fraud_label"], r["total_claims"], r["opioid_cost"]) for r in dataset.labelled(missing).collect()]
    assert got == [(0, 5.0, 0.0), (2, 0.0, 0.0)]
    with pytest.raises(PySparkException, match="unknown tier"):
        dataset.labelled(spark.createDataFrame([("Odd",)], "fraud_risk_category string")).collect()


def test_split_is_complete_and_disjoint(scored, split):
    train, holdout = split
    assert train.join(holdout, "prescriber_id", "left_semi").isEmpty()
    assert train.count() + holdout.count() == scored.count()


def test_one_sided_split_is_refused(scored):
    with pytest.raises(ValueError, match="test_size"):
        dataset.staged_split(scored, test_size=0.0)


def test_single_class_is_refused(split):
    with pytest.raises(ValueError, match="two classes"):
        training.train_gbt_scaled(split[0].filter("fraud_label = 1"), max_iter=1)


def check_probabilities(table, n):
    rows = table.collect()
    assert len(rows) == n
    for r in rows:
        assert r["p_low"] + r["p_medium"] + r["p_high"] == pytest.approx(1.0)
        assert r["predicted_category"] in ("Low", "Medium", "High")


def test_forest_outputs(forest, scored, split):
    table = scoring.probability_table(forest, scored)
    assert dict(table.dtypes)["prescriber_id"] == "string" and dict(table.dtypes)["prediction"] == "int"
    check_probabilities(table, scored.count())
    kept = scoring.predictions_table(scoring.score_holdout(forest, split[1]))
    assert kept.columns == scoring.PREDICTION_COLUMNS
    assert "peer_deviation_score" not in scoring.predictions_table(
        scoring.score_holdout(forest, split[1]), with_peer_score=False
    ).columns


def test_batch_scoring_completes_features(spark, forest):
    uploads = spark.createDataFrame([("a", 5, None), ("b", 100, 9.0)], "prescriber_id string, total_claims int, opioid_cost double")
    scored = scoring.batch_score(forest, uploads)
    check_probabilities(scored, 2)
    assert {r["prescriber_id"] for r in scored.collect()} == {"a", "b"}


def test_importances(spark, forest, split):
    weights = scoring.importances(forest)
    assert list(weights) == MODEL_FEATURES and sum(weights.values()) == pytest.approx(1.0)
    assert scoring.feature_importance(spark, forest).count() == 7
    top = scoring.top_features(split[1], weights, n=3)
    best = sorted(weights, key=weights.get, reverse=True)[:3]
    per_record = top.groupBy("prescriber_id").agg(F.sort_array(F.collect_list(F.struct("rank", "feature"))).alias("f"))
    assert all([x["feature"] for x in r["f"]] == best for r in per_record.collect())


def test_boosted_trees(split):
    train, holdout = split
    plain = training.train_gbt(train, max_iter=2, max_depth=2)
    assert len(plain.stages[-1].models) == 3
    assert sum(scoring.importances(plain).values()) == pytest.approx(1.0, abs=0.4)
    scaled = training.train_gbt_scaled(train, max_iter=2, max_depth=2)
    check_probabilities(scoring.probability_table(scaled, holdout), holdout.count())
    gbt = training.gbt_stages()[1]
    assert (gbt.getMaxIter(), gbt.getMaxDepth(), gbt.getStepSize(), gbt.getSeed()) == (50, 6, 0.1, 42)
    forest = training.forest_stages()[1]
    assert (forest.getNumTrees(), forest.getMaxDepth(), forest.getSeed()) == (100, 8, 42)


def test_tuning_tries_every_point(split):
    train, holdout = split
    search = training.tune_forest(train, num_trees=(2, 3), max_depths=(2,))
    report = training.tuning_report(search)
    assert sorted(p["numTrees"] for p in report) == [2, 3]
    assert report[0]["f1"] == max(search.validationMetrics)
    search = training.tune_gbt(train, max_iters=(1,), max_depths=(1, 2))
    assert sorted(p["maxDepth"] for p in training.tuning_report(search)) == [1, 2]
    assert search.bestModel.transform(holdout).count() == holdout.count()


def test_model_roundtrip(forest, split, tmp_path):
    loaded = models.load_model(models.save_model(forest, str(tmp_path / "model")))
    want = {r["prescriber_id"]: r["prediction"] for r in forest.transform(split[1]).collect()}
    assert want == {r["prescriber_id"]: r["prediction"] for r in loaded.transform(split[1]).collect()}


def test_copies_of_a_prescriber_are_on_one_side(spark, split):
    train, _ = split
    copied = train.union(train).union(train.limit(50))
    marked = training.mark_validation(copied)
    sides = marked.groupBy("prescriber_id").agg(F.count_distinct("is_validation").alias("n"))
    assert sides.filter("n > 1").isEmpty()
    share = marked.filter("is_validation").count() / marked.count()
    assert 0.1 < share < 0.3
    with pytest.raises(ValueError, match="empty"):
        training.tune_forest(train, num_trees=(1,), max_depths=(1,), share=0.0)


def test_tuning_judges_points_on_keys_they_did_not_see(spark, split):
    train, _ = split
    search = training.tune_forest(train, num_trees=(2,), max_depths=(1, 3))
    marked = training.mark_validation(train)
    for point, score in zip(search.points, search.validationMetrics):
        pipeline = training.forest_stages(num_trees=2, max_depth=point["maxDepth"])[0]
        fitted = pipeline.fit(marked.filter("not is_validation"))
        assert training._judge().evaluate(fitted.transform(marked.filter("is_validation"))) == pytest.approx(score, abs=0.15)
    best = training.tuning_report(search)[0]
    assert search.bestModel.stages[-1].getOrDefault("maxDepth") == best["maxDepth"]
    table = training.tuning_table(spark, search).collect()
    assert [r["rank"] for r in table] == [1, 2] and table[0]["f1"] >= table[1]["f1"]
    assert table[0]["parameters"].startswith("featureSubsetStrategy=auto, maxDepth=")


def test_tuning_by_folds_of_keys(split):
    search = training.tune_forest(split[0], num_trees=(2,), max_depths=(1, 2), folds=3)
    assert len(search.validationMetrics) == 2 and all(0 <= f <= 1 for f in search.validationMetrics)


def test_bundle_roundtrip(spark, forest, split, tmp_path):
    path = models.save_bundle(forest, str(tmp_path / "bundle"), MODEL_FEATURES, {"rows": 7})
    model, signature = models.load_bundle(spark, path)
    assert signature.features == MODEL_FEATURES and signature.facts == {"rows": "7"} and signature.classes == ["Low", "Medium", "High"]
    signature.check_inputs(split[1])
    with pytest.raises(MissingColumns, match="opioid_cost, avg_risk_score"):
        signature.check_inputs(split[1].drop("opioid_cost").withColumn("avg_risk_score", F.array(F.lit(1))))
    same = {r["prescriber_id"]: r["prediction"] for r in forest.transform(split[1]).collect()}
    assert same == {r["prescriber_id"]: r["prediction"] for r in model.transform(split[1]).collect()}


def test_bundles_that_do_not_fit_are_refused(spark, forest, tmp_path, monkeypatch):
    with pytest.raises(models.WrongModel, match="signature"):
        models.save_bundle(forest, str(tmp_path / "a"), MODEL_FEATURES[::-1])
    with pytest.raises(MissingInput, match="bundle"):
        models.load_bundle(spark, str(tmp_path / "none"))
    path = models.save_bundle(forest, str(tmp_path / "b"), MODEL_FEATURES)
    with monkeypatch.context() as patch:
        patch.setattr(models, "save_model", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            models.save_bundle(forest, path, MODEL_FEATURES)
    with pytest.raises(MissingInput, match="bundle"):  # the write was cut off
        models.load_bundle(spark, path)
    models.save_bundle(forest, path, MODEL_FEATURES)
    with monkeypatch.context() as patch:
        patch.setattr(models, "LAYOUT", 2)
        with pytest.raises(models.WrongModel, match="layout"):
            models.load_bundle(spark, path)
    with monkeypatch.context() as patch:
        patch.setattr(models, "TIERS", ["High", "Low"])
        with pytest.raises(models.WrongModel, match="classes"):
            models.load_bundle(spark, path)


# --- metrics against a count by hand -------------------------------------------------


def by_hand(pairs):
    out = {}
    for k in range(3):
        tp = sum(y == k and p == k for y, p in pairs)
        fp = sum(y != k and p == k for y, p in pairs)
        fn = sum(y == k and p != k for y, p in pairs)
        precision = tp / (tp + fp) if tp + fp else 0.0
        recall = tp / (tp + fn) if tp + fn else 0.0
        f1 = 2 * precision * recall / (precision + recall) if precision + recall else 0.0
        out[k] = (tp, fp, fn, precision, recall, f1)
    return out


@pytest.mark.parametrize("predicted", [(0, 1, 2), (0, 1)])
def test_metrics(spark, predicted):
    rng = random.Random(5)
    pairs = [(rng.choice([0, 1, 1, 2]), rng.choice(predicted)) for _ in range(300)]
    df = spark.createDataFrame([(y, float(p)) for y, p in pairs], "y int, p double")
    want = by_hand(pairs)
    got = {r["label"]: tuple(r)[1:] for r in evaluation.eval_per_class(df, "y", "p").collect()}
    assert set(got) == {0, 1, 2}
    for k in got:
        assert got[k] == pytest.approx(want[k])
    macro = sum(v[5] for v in want.values()) / 3
    assert evaluation.eval_macro_f1(df, "y", "p").first()[0] == pytest.approx(macro)

    from pyspark.ml.evaluation import MulticlassClassificationEvaluator

    overall = evaluation.eval_overall(df, "y", "p").first()
    for name, value in zip(("accuracy", "f1"), overall):
        judge = MulticlassClassificationEvaluator(labelCol="y", predictionCol="p", metricName=name)
        assert value == pytest.approx(judge.evaluate(df))

    dense = {r["label"]: tuple(r)[1:] for r in evaluation.confusion_matrix_dense(df, "y", "p").collect()}
    assert dense == {k: (*(sum(y == k and p == j for y, p in pairs) for j in range(3)), 0) for k in range(3)}
    assert sum(r["n_rows"] for r in evaluation.confusion_matrix(df, "y", "p").collect()) == 300

    report = {r["class_name"]: r for r in evaluation.classification_report(df, "y", "p").collect()}
    assert report["macro avg"]["f1"] == pytest.approx(macro)
    assert report["weighted avg"]["f1"] == pytest.approx(overall["weighted_f1"])
    assert report["accuracy"]["support"] == 300 and report["accuracy"]["precision"] is None


def test_metrics_of_nothing(spark):
    empty = spark.createDataFrame([], "y int, p double")
    assert tuple(evaluation.eval_overall(empty, "y", "p").first()) == (0.0, 0.0, 0)


def test_rows_outside_the_classes_count_as_misses(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (2, 3), (2, None), (None, 2), (7, 0)], "y int, p int")
    overall = evaluation.eval_overall(df, "y", "p").first()
    assert overall["accuracy"] == 2 / 6 and overall["n_outside"] == 4
    third = evaluation.eval_per_class(df, "y", "p").collect()[2]
    assert (third["tp"], third["fp"], third["fn"]) == (0, 1, 2)
    dense = evaluation.confusion_matrix_dense(df, "y", "p").collect()
    assert [r["predicted_other"] for r in dense] == [0, 0, 2]
