"""The queries. Each takes (spark, sf_dir), reads whole tables and returns a frame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.catalog import tables as t
from riskloom.functions.buckets import sha_bucket
from riskloom.functions.cleaning import currency_amount, safe_key, zip5
from riskloom.functions.labels import decode_tier, encode_tier, softmax
from riskloom.learning import dataset, evaluation, scoring, training
from riskloom.operators import (
    auditing,
    cleaning,
    exact_sampling,
    features,
    joining,
    part_profiles,
    profiling,
    projecting,
    rules,
    sampling,
    windows,
)
from riskloom.plans import etl, progress
from riskloom.schemas import (
    MODEL_FEATURES,
    PAYMENT_COLUMNS,
    PRESCRIBER_NUMERIC,
    RAW_PAYMENTS,
    RAW_PRESCRIBERS,
    SCORING_RANGES,
    SCORING_RECORD,
)
from riskloom.sources import models, readers, rejects, sinks, staging

Query = Callable[[SparkSession, str], DataFrame]

CLAIM_FEATURES = ["total_claims", "total_drug_cost", "opioid_cost", "antibiotic_claims", "avg_risk_score"]


def _rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Round columns whose last digits depend on the order of floating-point sums."""
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


PEER_DIGITS = {"peer_avg_payment": 6, "peer_deviation_score": 4}

# --- scans and sinks ---------------------------------------------------------------


def _as_csv(df: DataFrame, name: str) -> str:
    return sinks.write_table(df, staging.new_path(df.sparkSession, name), fmt="csv")


def scan_prescribers(spark, sf_dir):
    path = _as_csv(t.raw_prescribers(spark, sf_dir), "prescribers-csv")
    return projecting.project_prescribers(readers.scan_csv(spark, path, RAW_PRESCRIBERS))


def scan_payments(spark, sf_dir):
    path = _as_csv(t.raw_payments(spark, sf_dir), "payments-csv")
    scanned = projecting.project_payments(readers.scan_csv(spark, path, RAW_PAYMENTS))
    return scanned.withColumn("Payment_Amount", F.col("Payment_Amount").cast("double"))


def clean_payments(spark, sf_dir):
    path = _as_csv(t.raw_payments(spark, sf_dir, untidy=True), "payments-text-csv")
    return cleaning.clean_payments(readers.scan_csv_text(spark, path, list(PAYMENT_COLUMNS)))


def sink_roundtrip(spark, sf_dir):
    clean = t.prescribers(spark, sf_dir)
    path = sinks.write_table(clean, staging.new_path(spark, "prescribers"), order_by="prescriber_id")
    return readers.scan_parquet(spark, path, clean.schema)


def bounded_read(spark, sf_dir):
    return readers.first_rows(t.prescribers(spark, sf_dir), 100, ["prescriber_id"])


def scan_checked(spark, sf_dir):
    """Every line of a CSV file of untidy numbers, with what keeps it from being a typed row."""
    path = _as_csv(t.raw_prescribers_text(spark, sf_dir), "untidy-csv")
    accepted, rejected = rejects.scan_csv_checked(spark, path, RAW_PRESCRIBERS)
    told = F.array_join(F.transform("reasons", lambda r: F.concat(r["column_name"], F.lit("="), r["value"])), "|")
    parts = [accepted.select("PRSCRBR_NPI", F.lit("").alias("reasons")), rejected.select("PRSCRBR_NPI", told.alias("reasons"))]
    marked = [part.withColumn("accepted", F.lit(side)) for side, part in zip((True, False), parts)]
    return projecting.union_parts(marked).withColumnRenamed("PRSCRBR_NPI", "prescriber_id")


def reject_counts(spark, sf_dir):
    path = _as_csv(t.raw_prescribers_text(spark, sf_dir), "untidy-csv")
    return rejects.reject_counts(rejects.scan_csv_checked(spark, path, RAW_PRESCRIBERS)[1])


def align_scoring_schema(spark, sf_dir):
    return readers.align_to_schema(t.prescribers(spark, sf_dir), SCORING_RECORD)


# --- projection --------------------------------------------------------------------


def project_prescribers(spark, sf_dir):
    return projecting.project_prescribers(t.raw_prescribers_text(spark, sf_dir))


def project_payments(spark, sf_dir):
    return projecting.project_payments(t.raw_payments(spark, sf_dir, untidy=True))


def select_present(spark, sf_dir):
    wanted = ["prescriber_id", "state", "peer_deviation_score", "zip", "prediction"]
    return projecting.select_present(t.prescribers(spark, sf_dir), wanted)


def ensure_features(spark, sf_dir):
    raw = projecting.project_prescribers(t.raw_prescribers(spark, sf_dir))
    return projecting.ensure_features(raw, MODEL_FEATURES).select("prescriber_id", *MODEL_FEATURES)


def union_parts(spark, sf_dir):
    labelled = staging.stage(t.surrogate_predictions(spark, sf_dir).select("prescriber_id", "fraud_label"), "labelled")
    return projecting.union_parts([labelled.filter(F.col("fraud_label") == c) for c in sampling.CLASSES])


# --- cleaning ----------------------------------------------------------------------


def clean_amount(spark, sf_dir):
    text = t.table(spark, sf_dir, "events").select("event_id", F.expr(t.AMOUNT_TEXT).alias("amount_text"))
    return text.withColumns(
        {
            "amount": currency_amount(F.col("amount_text")),
            "strict_amount": currency_amount(F.col("amount_text"), strict=True),
        }
    )


def clean_zip(spark, sf_dir):
    text = t.table(spark, sf_dir, "events").select("event_id", F.expr(t.ZIP_TEXT).alias("zip_text"))
    return text.withColumn("zip", zip5(F.col("zip_text")))


def guard_numeric(spark, sf_dir):
    text = projecting.project_prescribers(t.raw_prescribers_text(spark, sf_dir))
    return cleaning.guard_numeric(text, PRESCRIBER_NUMERIC).select("prescriber_id", *PRESCRIBER_NUMERIC)


def fill_strings(spark, sf_dir):
    raw = projecting.project_prescribers(t.raw_prescribers(spark, sf_dir))
    return cleaning.fill_strings(raw).drop(*PRESCRIBER_NUMERIC)


def null_to_zero(spark, sf_dir):
    raw = projecting.project_prescribers(t.raw_prescribers(spark, sf_dir))
    return cleaning.null_to_zeros(raw.select("prescriber_id", *PRESCRIBER_NUMERIC), PRESCRIBER_NUMERIC)


def coerce_numeric(spark, sf_dir):
    text = projecting.project_prescribers(t.raw_prescribers_text(spark, sf_dir))
    return projecting.coerce_numeric(text, MODEL_FEATURES).select("prescriber_id", *MODEL_FEATURES)


def _keyed_events(spark, sf_dir):
    return t.table(spark, sf_dir, "events").select("event_id", F.expr(t.KEY_TEXT).alias("NPI"))


def safe_key_cast(spark, sf_dir):
    return _keyed_events(spark, sf_dir).withColumn("npi_number", safe_key(F.col("NPI")))


def filter_valid_keys(spark, sf_dir):
    return cleaning.valid_keys(_keyed_events(spark, sf_dir), "NPI", "npi_number")


# --- audits ------------------------------------------------------------------------


def audit_non_numeric(spark, sf_dir):
    raw = projecting.project_payments(t.raw_payments(spark, sf_dir, untidy=True))
    return auditing.audit_non_numeric(raw, {"Payment_Amount": auditing.SIGNED_DECIMAL, "Zip": auditing.DIGITS})


def audit_post_clean(spark, sf_dir):
    return auditing.audit_post_clean(cleaning.clean_payments(t.raw_payments(spark, sf_dir, untidy=True)))


def audit_residual_chars(spark, sf_dir):
    text = projecting.project_prescribers(t.raw_prescribers_text(spark, sf_dir))
    return auditing.audit_residual_chars(text, PRESCRIBER_NUMERIC)


def audit_bad_keys(spark, sf_dir):
    return auditing.bad_keys(_keyed_events(spark, sf_dir), "NPI")


# Which untidy text column plays each scoring input that the raw table lacks.
STAND_INS = {
    "payment_to_drug_cost_ratio": "female_patients",
    "peer_deviation_score": "male_patients",
    "payment_variability": "opioid_beneficiaries",
    "adjusted_risk_payment": "antibiotic_cost",
    "high_payment_flag": "opioid_rate",
    "high_opioid_flag": "avg_patient_age",
    "elderly_focus_flag": "total_beneficiaries",
}


def validate_ranges(spark, sf_dir):
    text = projecting.project_prescribers(t.raw_prescribers_text(spark, sf_dir))
    inputs = text.select("prescriber_id", *[F.col(STAND_INS.get(c, c)).alias(c) for c in SCORING_RANGES])
    checked = auditing.validate_ranges(inputs)
    return checked.select("prescriber_id", F.array_join("errors", "|").alias("errors"), "is_valid")


def validate_scored(spark, sf_dir):
    """The scoring inputs that the job itself has made, as the text that an upload would hold."""
    scored = t.scored(spark, sf_dir)
    entered = {c: F.when(F.col("prescriber_id") % 50 == 0, F.concat(F.lit("$"), F.col(c).cast("string"))).otherwise(F.col(c).cast("string")) for c in SCORING_RANGES}
    checked = auditing.validate_ranges(scored.select("prescriber_id", *[e.alias(c) for c, e in entered.items()]), t.TIGHT_RANGES)
    return checked.select("prescriber_id", F.array_join("errors", "|").alias("errors"), "is_valid")


# --- joins and aggregates ----------------------------------------------------------


def payment_aggregates(spark, sf_dir):
    return joining.payment_aggregates(t.payments(spark, sf_dir))


def prescriber_level(spark, sf_dir):
    return etl.prescriber_table(t.prescribers(spark, sf_dir), t.payments(spark, sf_dir))


def payment_level(spark, sf_dir):
    people = staging.stage(t.prescribers(spark, sf_dir), "prescribers")
    return joining.payment_level(t.payments(spark, sf_dir), people)


def _stored_predictions(spark, sf_dir):
    """Stored results exist for prescribers with claims only."""
    return t.surrogate_predictions(spark, sf_dir).filter("total_claims > 0").drop("fraud_label")


def join_predictions(spark, sf_dir):
    uploads = t.prescribers(spark, sf_dir).select("prescriber_id", "provider_type", "state", "avg_patient_age")
    return joining.join_predictions(uploads, staging.stage(_stored_predictions(spark, sf_dir), "predictions"))


def lookup_predictions(spark, sf_dir):
    asked = _keyed_events(spark, sf_dir).select(F.col("NPI").alias("prescriber_id")).distinct()
    stored = staging.stage(_stored_predictions(spark, sf_dir), "predictions")
    return joining.lookup(asked, stored)


# --- features and rules ------------------------------------------------------------

RATIOS_AND_FLAGS = [
    "payment_per_claim",
    "payment_to_drug_cost_ratio",
    "opioid_claim_ratio",
    "antibiotic_claim_ratio",
    "high_opioid_flag",
    "payment_variability",
    "high_payment_flag",
    "female_to_male_ratio",
    "elderly_focus_flag",
    "adjusted_risk_payment",
]


def feature_columns(spark, sf_dir):
    enriched = features.add_features(prescriber_level(spark, sf_dir), t.THRESHOLDS)
    return enriched.select("prescriber_id", *RATIOS_AND_FLAGS)


def peer_average(spark, sf_dir):
    return _rounded(features.peer_average(prescriber_level(spark, sf_dir)), {"peer_avg_payment": 6})


def peer_deviation(spark, sf_dir):
    level = prescriber_level(spark, sf_dir)
    peers = staging.stage(features.peer_average(level), "peer-average")
    compared = features.add_peer_deviation(level, peers)
    return _rounded(compared.select("prescriber_id", "provider_type", *PEER_DIGITS), PEER_DIGITS)


def peer_window(spark, sf_dir):
    compared = windows.peer_comparison(prescriber_level(spark, sf_dir))
    return _rounded(compared.select("prescriber_id", "provider_type", *PEER_DIGITS), PEER_DIGITS)


def peer_extremes(spark, sf_dir):
    """Each payment beside sum, count, mean and extremes of its recipient's state; a few states hold all rows."""
    money = {f"{kind}_amount": (kind, "Payment_Amount") for kind in ("count", "avg", "min", "max")}
    compared = windows.over_groups(t.payments(spark, sf_dir), ["State", "Payment_Form"], money)
    return _rounded(compared.select("NPI", "State", "Payment_Form", "Payment_Amount", *money), {"avg_amount": 6})


def scored_prescribers(spark, sf_dir):
    return _rounded(t.scored(spark, sf_dir), PEER_DIGITS).orderBy("prescriber_id")


def risk_score(spark, sf_dir):
    return t.scored(spark, sf_dir).select("prescriber_id", "fraud_risk_score", "fraud_risk_category")


def risk_distribution(spark, sf_dir):
    return rules.risk_distribution(t.scored(spark, sf_dir))


def fired_rules(spark, sf_dir):
    return rules.fired_rules(t.scored(spark, sf_dir), t.THRESHOLDS)


def rule_hits(spark, sf_dir):
    return rules.rule_hits(t.scored(spark, sf_dir), t.THRESHOLDS)


def scored_preview(spark, sf_dir):
    return _rounded(profiling.scored_preview(t.scored(spark, sf_dir)), {"peer_deviation_score": 4})


# --- profiles ----------------------------------------------------------------------


def _merged(spark, sf_dir):
    """The payment-level table, stored once because profiles read it several times."""
    return staging.stage(payment_level(spark, sf_dir), "payment-level")


def dataset_shape(spark, sf_dir):
    return profiling.dataset_shape(payment_level(spark, sf_dir))


def missing_values(spark, sf_dir):
    return profiling.missing_values(payment_level(spark, sf_dir))


def summary_stats(spark, sf_dir):
    digits = {"mean": 4, "stddev": 4}
    return _rounded(profiling.summary_stats(payment_level(spark, sf_dir)), digits)


def distinct_counts(spark, sf_dir):
    return profiling.distinct_counts(payment_level(spark, sf_dir))


def profile_columns(spark, sf_dir):
    return _rounded(profiling.profile_columns(_merged(spark, sf_dir)), {"mean": 4, "stddev": 4})


def _stored_profile(spark, sf_dir):
    """Profiles of the merged table by month, the last of them stored later and the first one stored twice."""
    merged = _merged(spark, sf_dir)
    month = F.substring("Payment_Date", 1, 7)
    bounds = merged.agg(F.min(month), F.max(month)).first()
    path = staging.new_path(spark, "profiles")
    for part in (merged.filter(month < bounds[1]), merged.filter(month == bounds[1]), merged.filter(month == bounds[0])):
        part_profiles.store_profiles(part_profiles.profile_parts(part, month), path)
    return part_profiles.read_profiles(spark, path)


def merged_profile(spark, sf_dir):
    merged = part_profiles.merge_profiles(_stored_profile(spark, sf_dir)).drop("n_distinct", "n_rows")
    return _rounded(merged, {"mean": 4, "stddev": 4})


def sketched_distinct(spark, sf_dir):
    """Exact numbers of distinct values, and whether the merged sketches are within four standard errors of them."""
    estimates = part_profiles.merge_profiles(_stored_profile(spark, sf_dir)).select("column_name", F.col("n_distinct").alias("estimate"))
    exact = distinct_counts(spark, sf_dir)
    most = F.greatest(F.col("n_distinct") * 4 * part_profiles.sketch_error(), F.lit(1.0))
    near = F.abs(F.col("estimate") - F.col("n_distinct")) <= most
    return exact.join(estimates, "column_name", "left").select("column_name", "n_distinct", F.coalesce(near, F.lit(False)).alias("is_near"))


def amount_stats(spark, sf_dir):
    stats = profiling.amount_stats(t.payments(spark, sf_dir), "Payment_Amount")
    return _rounded(stats, {"mean": 6, "stddev": 6})


def outliers_3sigma(spark, sf_dir):
    found = profiling.outliers_3sigma(t.payments(spark, sf_dir), "Payment_Amount")
    return found.select("NPI", "Payment_Amount", "Payment_Date")


def _with_repeats(spark, sf_dir):
    """The payments, which hold no row twice, and those of a tenth of the recipients once more."""
    payments = staging.stage(t.payments(spark, sf_dir), "payments")
    return payments.union(payments.filter(sha_bucket(F.col("NPI")) < 1000))


def duplicate_rows(spark, sf_dir):
    return profiling.duplicate_rows(_with_repeats(spark, sf_dir))


def distinct_rows(spark, sf_dir):
    return profiling.distinct_rows(_with_repeats(spark, sf_dir))


def histogram(spark, sf_dir):
    return _rounded(profiling.histogram(t.payments(spark, sf_dir), "Payment_Amount"), {"low": 6, "high": 6})


def correlation_matrix(spark, sf_dir):
    return _rounded(profiling.correlation_matrix(payment_level(spark, sf_dir)), {"correlation": 6})


def top_states(spark, sf_dir):
    return profiling.top_values(t.payments(spark, sf_dir), "State")


def top_specialties(spark, sf_dir):
    return profiling.top_values(t.payments(spark, sf_dir), "Specialty", keep_null=False)


def top_known_states(spark, sf_dir):
    """States of payments whose recipient is a prescriber; recipients that are none have no state here."""
    people = t.prescribers(spark, sf_dir).filter("total_claims > 0").select(F.col("prescriber_id").alias("NPI"), F.col("state").alias("home"))
    counts = staging.stage(joining.payment_summary(t.payments(spark, sf_dir)), "payment-summary")
    return profiling.top_values(counts.join(people, "NPI", "left"), "home", keep_null=False, weight="num_payments")


def top_known_zips(spark, sf_dir):
    raw = projecting.project_payments(t.raw_payments(spark, sf_dir))
    return profiling.top_values(raw, "Zip", keep_null=False)


def top_zips(spark, sf_dir):
    return profiling.top_values(t.payments(spark, sf_dir), "Zip")


def top_provider_types(spark, sf_dir):
    """Payments are counted per recipient first, so the join sees one row for each."""
    counts = staging.stage(joining.payment_summary(t.payments(spark, sf_dir)), "payment-summary")
    people = t.prescribers(spark, sf_dir).select(F.col("prescriber_id").alias("NPI"), "provider_type")
    return profiling.top_values(counts.join(people, "NPI", "left"), "provider_type", weight="num_payments")


# --- splits, samples and label codes -----------------------------------------------


def sample_uniform(spark, sf_dir):
    return sampling.sample_uniform(t.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), 0.2)


def sample_hash(spark, sf_dir):
    return sampling.sample_hash(t.prescribers(spark, sf_dir).select("prescriber_id", "state"), "prescriber_id", 0.2)


def _labels(spark, sf_dir):
    return t.surrogate_predictions(spark, sf_dir).select("prescriber_id", "fraud_label")


def resample_plan(spark, sf_dir):
    return sampling.resample_plan(_labels(spark, sf_dir), "fraud_label")


def resample_hash(spark, sf_dir):
    labels = staging.stage(_labels(spark, sf_dir), "labels")
    return sampling.resample_hash(labels, "fraud_label", "prescriber_id")


def resample_exact(spark, sf_dir):
    return exact_sampling.resample_exact(_labels(spark, sf_dir), "fraud_label", "prescriber_id")


def resample_random(spark, sf_dir):
    return sampling.resample_random(staging.stage(_labels(spark, sf_dir), "labels"), "fraud_label")


def sha_buckets(spark, sf_dir):
    customers = t.table(spark, sf_dir, "customer")
    return customers.select("c_custkey", sha_bucket(F.col("c_custkey")).alias("bucket"))


def split_sha(spark, sf_dir):
    return sampling.mark_holdout(t.prescribers(spark, sf_dir).select("prescriber_id"))


def split_murmur(spark, sf_dir):
    return sampling.mark_holdout_murmur(t.prescribers(spark, sf_dir).select("prescriber_id"))


def split_random(spark, sf_dir):
    customers = t.table(spark, sf_dir, "customer").select("c_custkey")
    sides = zip(("train", "holdout"), sampling.split_random(customers))
    return projecting.union_parts([side.withColumn("side", F.lit(name)) for name, side in sides])


def standardize(spark, sf_dir):
    staged = staging.stage(t.scored(spark, sf_dir).select("prescriber_id", *MODEL_FEATURES), "features")
    train, _ = sampling.split_marked(sampling.mark_holdout(staged))
    return _rounded(sampling.standardize(staged, MODEL_FEATURES, train), dict.fromkeys(MODEL_FEATURES, 6))


def label_encode(spark, sf_dir):
    tier = F.col("fraud_risk_category")
    return t.scored(spark, sf_dir).select("prescriber_id", encode_tier(tier).alias("fraud_label"))


def label_decode(spark, sf_dir):
    coded = t.table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 5).alias("code"))
    return coded.withColumn("tier", decode_tier(F.col("code")))


def softmax_scores(spark, sf_dir):
    raw = F.array("avg_risk_score", F.col("opioid_rate") / 50, F.col("avg_patient_age") / 50)
    scores = t.prescribers(spark, sf_dir).select("prescriber_id", softmax(raw).alias("p"))
    columns = [F.round(F.get("p", i), 9).alias(name) for i, name in enumerate(scoring.PROBABILITY_COLUMNS)]
    return scores.select("prescriber_id", *columns)


def assemble(spark, sf_dir):
    labelled = dataset.labelled(t.scored(spark, sf_dir))
    vectors = dataset.assembler().transform(labelled).select("prescriber_id", "fraud_label", "features")
    values = vector_to_array("features")
    return vectors.select(
        "prescriber_id", "fraud_label", *[F.get(values, i).alias(f"x{i}") for i in range(len(MODEL_FEATURES))]
    )


# --- metrics over the surrogate prediction -----------------------------------------


def _metric(compute) -> Query:
    return lambda spark, sf_dir: compute(t.surrogate_predictions(spark, sf_dir), "fraud_label", "prediction")


# --- models ------------------------------------------------------------------------
# All with the published parameters. What only reads a model has it fitted once per application and table.

_FITTED: dict[tuple[str, str, str], str] = {}


def _fitted(spark, sf_dir, name, fit):
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _FITTED:
        _FITTED[key] = models.save_model(fit(), staging.new_path(spark, name))
    return models.load_model(_FITTED[key])


def _split(spark, sf_dir):
    return dataset.staged_split(t.scored(spark, sf_dir))


def _outcome(model, holdout):
    scored = scoring.score_holdout(model, holdout)
    return scored.select("prescriber_id", "fraud_label", F.col("prediction").cast("int").alias("prediction"))


def train_gbt(spark, sf_dir):
    train, holdout = _split(spark, sf_dir)
    return _outcome(training.train_gbt(train), holdout)


def train_rf(spark, sf_dir):
    train, holdout = _split(spark, sf_dir)
    return _outcome(training.train_forest(train), holdout)


def train_gbt_scaled(spark, sf_dir):
    train, holdout = _split(spark, sf_dir)
    return _outcome(training.train_gbt_scaled(train), holdout)


def _balanced(train):
    return staging.stage(sampling.resample_hash(train, dataset.LABEL, "prescriber_id"), "balanced")


def tune_gbt(spark, sf_dir):
    train, holdout = _split(spark, sf_dir)
    search = training.tune_gbt(_balanced(train))
    return _outcome(search.bestModel, holdout)


def tune_rf(spark, sf_dir):
    train, holdout = _split(spark, sf_dir)
    search = training.tune_forest(_balanced(train))
    return _outcome(search.bestModel, holdout)


def tuning_report(spark, sf_dir):
    """Every grid point of the forest search with its F1 on the validation keys."""
    train, _ = _split(spark, sf_dir)
    return training.tuning_table(spark, training.tune_forest(_balanced(train)))


def tuning_sides(spark, sf_dir):
    """Rows and prescribers on each side of the search over balanced rows; none is on both."""
    train, _ = _split(spark, sf_dir)
    marked = training.mark_validation(exact_sampling.resample_exact(train, dataset.LABEL, "prescriber_id"))
    sides = staging.stage(marked, "sides").groupBy("prescriber_id").agg(
        F.count_if("is_validation").alias("n_validation"), F.count_if(~F.col("is_validation")).alias("n_fitting")
    )
    return sides.agg(
        *[F.sum(c).alias(c) for c in ("n_fitting", "n_validation")],
        F.count_if(F.expr("n_fitting > 0")).alias("fitting_keys"), F.count_if(F.expr("n_validation > 0")).alias("validation_keys"),
        F.count_if(F.expr("n_fitting > 0 and n_validation > 0")).alias("keys_on_both"),
    )


def _bundle(spark, sf_dir):
    """The forest as it is saved for scoring: with its features, classes and what it was trained on."""
    key = (spark.sparkContext.applicationId, sf_dir, "forest-bundle")
    if key not in _FITTED:
        model, train, _ = _forest(spark, sf_dir)
        _FITTED[key] = models.save_bundle(model, staging.new_path(spark, "bundle"), MODEL_FEATURES, {"n_train": train.count()})
    return models.load_bundle(spark, _FITTED[key])


def bundle_signature(spark, sf_dir):
    """What a loaded bundle says it needs: features by position, and the rows that it was trained on."""
    _, signature = _bundle(spark, sf_dir)
    rows = [(i, name, len(signature.classes), int(signature.facts["n_train"])) for i, name in enumerate(signature.features)]
    return spark.createDataFrame(rows, "position int, feature string, n_classes int, n_train bigint")


def _model_outcome(spark, sf_dir):
    model, _, holdout = _forest(spark, sf_dir)
    return staging.stage(_outcome(model, holdout), "outcome")


def model_report(spark, sf_dir):
    """Precision, recall and F1 per tier of the fitted forest on its holdout."""
    return evaluation.classification_report(_model_outcome(spark, sf_dir), "fraud_label", "prediction")


def model_per_class(spark, sf_dir):
    return evaluation.eval_per_class(_model_outcome(spark, sf_dir), "fraud_label", "prediction")


def model_overall(spark, sf_dir):
    return evaluation.eval_overall(_model_outcome(spark, sf_dir), "fraud_label", "prediction")


def _forest(spark, sf_dir):
    train, holdout = _split(spark, sf_dir)
    return _fitted(spark, sf_dir, "forest", lambda: training.train_forest(train)), train, holdout


def score_holdout(spark, sf_dir):
    model, _, holdout = _forest(spark, sf_dir)
    return scoring.score_holdout(model, holdout).select("prescriber_id", "fraud_label", "prediction")


def batch_score(spark, sf_dir):
    """Uploads that lack a feature, which counts as 0, and carry another as text; ``batch_score_facts`` has all of them."""
    model, _, _ = _forest(spark, sf_dir)
    variability = F.col("payment_variability").cast("string").alias("payment_variability")
    uploads = t.scored(spark, sf_dir).select("prescriber_id", "state", variability, *CLAIM_FEATURES)
    return scoring.batch_score(model, uploads)


def predictions_table(spark, sf_dir):
    model, _, holdout = _forest(spark, sf_dir)
    return scoring.predictions_table(scoring.score_holdout(model, holdout)).orderBy("prescriber_id")


def probability_table(spark, sf_dir):
    marked = dataset.staged_marked(t.scored(spark, sf_dir))
    train, _ = sampling.split_marked(marked)
    model = _fitted(spark, sf_dir, "scaled-gbt", lambda: training.train_gbt_scaled(train))
    return scoring.probability_table(model, marked)


def feature_importance(spark, sf_dir):
    model, _, _ = _forest(spark, sf_dir)
    return scoring.feature_importance(spark, model)


def top_features(spark, sf_dir):
    model, _, holdout = _forest(spark, sf_dir)
    return scoring.top_features(holdout, scoring.importances(model))


def model_roundtrip(spark, sf_dir):
    """Rows scored, and rows on which the saved and reloaded model disagrees with the fitted one."""
    model, train, holdout = _forest(spark, sf_dir)
    loaded = models.load_model(models.save_model(model, staging.new_path(spark, "model")))
    fitted = model.transform(projecting.union_parts([train, holdout])).withColumnRenamed("prediction", "fitted")
    both = loaded.transform(fitted.drop("features", "rawPrediction", "probability"))
    return both.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(~F.col("fitted").eqNullSafe(F.col("prediction"))).alias("n_different"),
    )


# --- facts about random and fitted results, which have no SQL form themselves --------


def sample_uniform_facts(spark, sf_dir):
    """Rows of the sample that are repeated or not in the table."""
    sample = staging.stage(sample_uniform(spark, sf_dir), "sample")
    strangers = sample.join(t.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), ["c_custkey", "c_mktsegment"], "left_anti")
    counts = sample.agg((F.count("*") - F.count_distinct("c_custkey")).alias("n_repeated"))
    return counts.withColumn("n_strangers", strangers.agg(F.count("*")).scalar())


def split_random_facts(spark, sf_dir):
    """Rows of both sides together, and keys among them."""
    return split_random(spark, sf_dir).agg(F.count("*").alias("n_rows"), F.count_distinct("c_custkey").alias("n_keys"))


def resample_random_facts(spark, sf_dir):
    """Classes after balancing, and rows that the labels do not have."""
    labels = staging.stage(_labels(spark, sf_dir), "labels")
    balanced = staging.stage(sampling.resample_random(labels, "fraud_label"), "balanced")
    strangers = balanced.join(labels, ["prescriber_id", "fraud_label"], "left_anti").agg(F.count("*")).scalar()
    return balanced.select("fraud_label").distinct().withColumn("n_strangers", strangers)


def score_holdout_facts(spark, sf_dir):
    """What the holdout's rows are, and whether each has the prediction of a class."""
    known = F.col("prediction").isin(*sampling.CLASSES).alias("has_class")
    return score_holdout(spark, sf_dir).select("prescriber_id", "fraud_label", known)


def predictions_facts(spark, sf_dir):
    """The columns of the predictions table that do not come from the model."""
    return predictions_table(spark, sf_dir).select("prescriber_id", "provider_type", "state", "total_claims", "fraud_risk_category")


def probability_facts(spark, sf_dir):
    """Whether each row's probabilities add up to one."""
    total = sum((F.col(c) for c in scoring.PROBABILITY_COLUMNS[1:]), F.col(scoring.PROBABILITY_COLUMNS[0]))
    return probability_table(spark, sf_dir).select("prescriber_id", (F.abs(total - 1) < 1e-9).alias("adds_up"))


def importance_facts(spark, sf_dir):
    """Features and the sum of importances, of the forest and of boosted trees (the mean of one against the rest)."""
    train, _ = _split(spark, sf_dir)
    gbt = _fitted(spark, sf_dir, "scaled-gbt", lambda: training.train_gbt_scaled(train))
    kinds = {"forest": _forest(spark, sf_dir)[0], "boosted": gbt}
    parts = [scoring.feature_importance(spark, m).withColumn("model", F.lit(name)) for name, m in kinds.items()]
    grouped = projecting.union_parts(parts).groupBy("model")
    return grouped.agg(F.count("*").alias("n_features"), F.round(F.sum("importance"), 1).alias("total"))


def batch_score_facts(spark, sf_dir):
    """Uploads with all features as text: whether probabilities add up, and whether the tier is the one of the scored numbers."""
    model, signature = _bundle(spark, sf_dir)
    scored = staging.stage(t.scored(spark, sf_dir), "scored")
    uploads = scored.select("prescriber_id", "state", *[F.col(c).cast("string").alias(c) for c in signature.features])
    predicted = scoring.batch_score(model, signature.check_inputs(uploads), signature.features)
    direct = scoring.with_prediction(model, scored, signature.features).select("prescriber_id", F.col("predicted_category").alias("tier"))
    total = F.abs(F.col("p_low") + F.col("p_medium") + F.col("p_high") - 1) < 1e-9
    same = F.col("predicted_category").eqNullSafe(F.col("tier"))
    return predicted.join(direct, "prescriber_id").select("prescriber_id", "state", total.alias("adds_up"), same.alias("is_same"))


def top_features_facts(spark, sf_dir):
    """Per record: features named, ranks from 1, and whether all values are the record's own."""
    top = top_features(spark, sf_dir)
    wide = _split(spark, sf_dir)[1].select("prescriber_id", F.map_from_arrays(F.array(*map(F.lit, MODEL_FEATURES)), F.array(*MODEL_FEATURES)).alias("own"))
    compared = top.join(wide, "prescriber_id").withColumn("is_own", F.col("your_value") == F.col("own")[F.col("feature")])
    return compared.groupBy("prescriber_id").agg(
        F.count_distinct("feature").alias("n_features"), F.max("rank").alias("last_rank"), F.bool_and("is_own").alias("all_own")
    )


def model_report_facts(spark, sf_dir):
    """Rows per line of the model's report, and whether its figures are shares and agree with each other."""
    report = staging.stage(model_report(spark, sf_dir), "report")
    named = F.map_from_entries(F.collect_list(F.struct("class_name", F.struct("precision", "recall", "f1"))))
    lines = report.agg(named.alias("m")).scalar()
    # Recall weighted by class size is the share of rows that are right, which is the accuracy line's F1 column.
    agree = F.abs(lines["weighted avg"]["recall"] - lines["accuracy"]["f1"]) < 1e-9
    shares = F.forall(F.array_compact(F.array("precision", "recall", "f1")), lambda x: x.between(0.0, 1.0))
    return report.select("class_name", "support", shares.alias("are_shares"), agree.alias("agree"))


# --- the written job ---------------------------------------------------------------------


def _resumed(spark, sf_dir):
    """The job with the published thresholds, then again in the same folder with those of the catalog."""
    folder = staging.new_path(spark, "etl")
    raw = staging.stage(t.raw_prescribers(spark, sf_dir), "raw-prescribers"), staging.stage(t.raw_payments(spark, sf_dir), "raw-payments")
    etl.resume_etl(spark, *raw, folder)
    return folder, etl.resume_etl(spark, *raw, folder, t.THRESHOLDS)


def etl_resumed(spark, sf_dir):
    folder, _ = _resumed(spark, sf_dir)
    return _rounded(readers.scan_parquet(spark, f"{folder}/scored_prescribers"), PEER_DIGITS)


def etl_progress(spark, sf_dir):
    """Rows of each table of the job, and whether the second run made it anew."""
    folder, again = _resumed(spark, sf_dir)
    records = progress.progress_table(spark, folder, list(etl.STAGE_TABLES))
    return records.select("stage", "table_name", "n_rows", F.col("stage").isin(*again).alias("made_again"))


def sample_then_train(spark, sf_dir):
    """A fifth of the prescribers, split and trained on: the holdout's rows with their predictions."""
    scored = t.scored(spark, sf_dir)
    train, holdout = dataset.staged_split(sampling.sample_hash(scored, "prescriber_id", 0.2))
    return _outcome(training.train_forest(train), holdout)


def sample_then_train_facts(spark, sf_dir):
    known = F.col("prediction").isin(*sampling.CLASSES).alias("has_class")
    return sample_then_train(spark, sf_dir).select("prescriber_id", "fraud_label", known)


def sample_then_split(spark, sf_dir):
    """A fifth of the prescribers, each on the side that the split of all of them puts it on."""
    people = t.prescribers(spark, sf_dir).select("prescriber_id")
    return sampling.mark_holdout(sampling.sample_hash(people, "prescriber_id", 0.2))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in [
        scan_prescribers, scan_payments, clean_payments, sink_roundtrip, bounded_read, align_scoring_schema,
        project_prescribers, project_payments, select_present, ensure_features, union_parts,
        clean_amount, clean_zip, guard_numeric, fill_strings, null_to_zero, coerce_numeric,
        safe_key_cast, filter_valid_keys,
        audit_non_numeric, audit_post_clean, audit_residual_chars, audit_bad_keys, validate_ranges,
        payment_aggregates, prescriber_level, payment_level, join_predictions, lookup_predictions,
        peer_average, peer_deviation, scored_prescribers, risk_score, risk_distribution,
        fired_rules, rule_hits, scored_preview,
        dataset_shape, missing_values, summary_stats, distinct_counts, profile_columns, amount_stats,
        outliers_3sigma, duplicate_rows, distinct_rows, histogram, correlation_matrix,
        top_states, top_specialties, top_zips, top_provider_types,
        sample_uniform, sample_hash, resample_plan, resample_hash, resample_random,
        split_sha, split_murmur, split_random, standardize, label_encode, label_decode, softmax_scores, assemble,
        train_gbt, train_rf, train_gbt_scaled, tune_gbt, tune_rf,
        score_holdout, batch_score, predictions_table, probability_table,
        feature_importance, top_features, model_roundtrip,
        sample_uniform_facts, split_random_facts, resample_random_facts, score_holdout_facts, predictions_facts,
        probability_facts, importance_facts, sample_then_split,
        scan_checked, reject_counts, validate_scored, peer_window, peer_extremes, merged_profile, sketched_distinct,
        top_known_states, top_known_zips, resample_exact, tuning_report, tuning_sides, bundle_signature,
        model_report, model_per_class, model_overall, model_report_facts, batch_score_facts, top_features_facts,
        etl_resumed, etl_progress, sample_then_train, sample_then_train_facts,
    ]
} | {
    "features": feature_columns,
    "sha_bucket": sha_buckets,
    "confusion_matrix": _metric(evaluation.confusion_matrix),
    "confusion_matrix_dense": _metric(evaluation.confusion_matrix_dense),
    "eval_overall": _metric(evaluation.eval_overall),
    "eval_per_class": _metric(evaluation.eval_per_class),
    "eval_macro_f1": _metric(evaluation.eval_macro_f1),
    "classification_report": _metric(evaluation.classification_report),
}
