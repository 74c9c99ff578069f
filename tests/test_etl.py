import pytest
from pyspark.sql import functions as F

from riskloom.catalog import tables
from riskloom.operators.cleaning import clean_payments, clean_prescribers
from riskloom.plans import etl
from riskloom.plans.etl import run_etl, score_prescribers
from riskloom.plans.progress import progress_table
from riskloom.schemas import PRESCRIBER_COLUMNS
from riskloom.sources.fingerprints import fingerprint
from riskloom.sources.readers import MissingInput


def test_stages_write_tables_of_the_right_shape(spark, sf_dir, tmp_path):
    raw_people, raw_paid = tables.raw_prescribers(spark, sf_dir), tables.raw_payments(spark, sf_dir)
    out = run_etl(spark, raw_people, raw_paid, str(tmp_path / "etl"), tables.THRESHOLDS)
    widths = {
        "clean_prescribers": 21,
        "clean_payments": 18,
        "prescriber_level": 25,
        "payment_level": 34,
        "prescriber_level_enriched": 37,
        "scored_prescribers": 39,
    }
    assert {k: len(out[k].columns) for k in widths} == widths
    people, paid = raw_people.count(), raw_paid.count()
    assert all(out[k].count() == people for k in ("clean_prescribers", "prescriber_level", "scored_prescribers"))
    assert out["payment_level"].count() == paid

    scored = out["scored_prescribers"]
    assert {r[0] for r in scored.select("fraud_risk_score").distinct().collect()} <= {0, 1, 2}
    names = {0: "Low", 1: "Medium", 2: "High"}
    pairs = scored.select("fraud_risk_score", "fraud_risk_category").distinct().collect()
    assert all(names[s] == c for s, c in pairs)
    assert scored.select("prescriber_id").distinct().count() == people

    direct = score_prescribers(clean_prescribers(raw_people), clean_payments(raw_paid), tables.THRESHOLDS)
    same = direct.select(*scored.columns)
    assert same.exceptAll(scored).isEmpty() and scored.exceptAll(same).isEmpty()


def test_a_stage_names_its_missing_input(spark, tmp_path):
    for stage, message in [
        (etl.aggregate_stage, "aggregate requires input table: .*clean_prescribers"),
        (etl.feature_stage, "features requires input table: .*prescriber_level"),
        (etl.score_stage, "score requires input table: .*prescriber_level_enriched"),
    ]:
        with pytest.raises(MissingInput, match=message):
            stage(spark, str(tmp_path))


def test_stages_can_be_run_again(spark, sf_dir, tmp_path):
    folder = str(tmp_path)
    etl.run_etl(spark, tables.raw_prescribers(spark, sf_dir), tables.raw_payments(spark, sf_dir), folder)
    calm = spark.read.parquet(f"{folder}/scored_prescribers").filter("fraud_risk_category = 'High'").count()
    etl.feature_stage(spark, folder, tables.THRESHOLDS)
    etl.score_stage(spark, folder, tables.THRESHOLDS)
    strict = spark.read.parquet(f"{folder}/scored_prescribers").filter("fraud_risk_category = 'High'").count()
    assert strict > calm


def test_known_tiers(spark):
    scored = tables.scored(spark, "/root/testdata/sf0.01")
    counts = {r[0]: r[1] for r in scored.groupBy("fraud_risk_category").count().collect()}
    assert counts == {"Low": 594, "Medium": 697, "High": 209}


def test_pruned_branch_skips_the_claims(spark, sf_dir):
    """Peer means need no claim columns, so the line items must not be read for them."""
    from riskloom.operators.features import peer_average
    from riskloom.plans.etl import prescriber_table

    level = prescriber_table(tables.prescribers(spark, sf_dir), tables.payments(spark, sf_dir))
    plan = peer_average(level)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and "l_orderkey" not in plan
    assert len(PRESCRIBER_COLUMNS) == 21


def files_of(folder):
    return {p.parent.name: p.name for p in sorted(folder.glob("*/part-*.parquet"))}


@pytest.fixture
def raw(spark, sf_dir):
    return tables.raw_prescribers(spark, sf_dir), tables.raw_payments(spark, sf_dir)


def test_a_killed_run_goes_on_from_its_finished_stages(spark, raw, tmp_path, monkeypatch):
    folder = tmp_path / "etl"

    def killed(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as patch:
        patch.setattr(etl, "score", killed)
        with pytest.raises(RuntimeError, match="killed"):
            run_etl(spark, *raw, str(folder), tables.THRESHOLDS)
    before = files_of(folder)
    assert "scored_prescribers" not in before and "prescriber_level_enriched" in before
    assert etl.resume_etl(spark, *raw, str(folder), tables.THRESHOLDS) == ["score"]
    after = files_of(folder)
    assert {k: after[k] for k in before} == before
    assert etl.resume_etl(spark, *raw, str(folder), tables.THRESHOLDS) == []
    whole = run_etl(spark, *raw, str(tmp_path / "whole"), tables.THRESHOLDS)["scored_prescribers"]
    resumed = spark.read.parquet(str(folder / "scored_prescribers"))
    assert whole.exceptAll(resumed).isEmpty() and resumed.exceptAll(whole).isEmpty()


def test_a_stage_killed_while_it_writes_is_run_again(spark, raw, tmp_path, monkeypatch):
    folder = str(tmp_path)
    run_etl(spark, *raw, folder)
    with monkeypatch.context() as patch:
        patch.setattr(etl.feat, "add_peer_deviation", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            etl.feature_stage(spark, folder, tables.THRESHOLDS)  # peer_average is replaced by now
    assert etl.resume_etl(spark, *raw, folder) == ["features", "score"]


def test_what_changes_decides_what_is_run_again(spark, raw, tmp_path):
    folder, everything = str(tmp_path), list(etl.STAGE_TABLES)
    people, paid = raw
    assert etl.resume_etl(spark, people, paid, folder) == everything
    assert etl.resume_etl(spark, people, paid.orderBy("Date_of_Payment"), folder) == []  # the same rows
    assert etl.resume_etl(spark, people, paid, folder, tables.THRESHOLDS) == ["features", "score"]
    assert etl.resume_etl(spark, people, paid.limit(100), folder, tables.THRESHOLDS) == everything
    assert etl.resume_etl(spark, people, paid, folder, versions=["p1", "p2"]) == everything
    assert etl.resume_etl(spark, people, paid, folder, versions=["p1", "p2"]) == []
    for damaged, again in (("payment_level", everything[1:]), ("scored_prescribers", ["score"])):
        table = spark.read.parquet(f"{folder}/{damaged}")
        table.limit(3).write.mode("overwrite").parquet(f"{folder}/other")
        spark.read.parquet(f"{folder}/other").write.mode("overwrite").parquet(f"{folder}/{damaged}")
        assert etl.resume_etl(spark, people, paid, folder, versions=["p1", "p2"]) == again
    rows = {r["table_name"]: r["n_rows"] for r in progress_table(spark, folder, everything).collect()}
    assert set(rows) == set(etl.TABLES) and rows["clean_payments"] == paid.count()


def test_fingerprints(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "x", None), (2, "x", None)], "i int, s string, t string")
    assert fingerprint(df) == fingerprint(df.orderBy(F.desc("i")).repartition(3))
    assert len({fingerprint(df), fingerprint(df.distinct()), fingerprint(df.select("i", "t", "s")), fingerprint(df.limit(0))}) == 4
    swapped = spark.createDataFrame([(1, "a", None), (2, None, "x"), (2, None, "x")], "i int, s string, t string")
    assert fingerprint(df) != fingerprint(swapped)
