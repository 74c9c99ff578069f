from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from riskloom.operators.cleaning import clean_payments
from riskloom.schemas import RAW_PAYMENTS, SCORING_RECORD
from riskloom.sources import rejects
from riskloom.sources import readers, sinks, staging


def test_missing_input_is_named(spark, tmp_path):
    with pytest.raises(readers.MissingInput, match="clean requires input table"):
        readers.scan_csv(spark, str(tmp_path / "none.csv"), RAW_PAYMENTS, "clean")
    with pytest.raises(readers.MissingInput):
        readers.scan_parquet(spark, str(tmp_path / "none"))


def test_csv_scan_finds_columns_by_name_in_a_wider_file(spark, tmp_path):
    names = list(reversed(RAW_PAYMENTS.fieldNames()))
    header = ["Extra_1", *names, "Extra_2"]
    values = {n: n[:3] for n in names} | {"Recipient_Zip_Code": "02134", "Total_Amount_of_Payment_USDollars": "12.5"}
    path = tmp_path / "wide.csv"
    path.write_text(",".join(header) + "\n" + ",".join(["e", *[values[n] for n in names], "e"]) + "\n")
    df = readers.scan_csv(spark, str(path), RAW_PAYMENTS)
    row = df.first()
    assert df.schema.fieldNames() == RAW_PAYMENTS.fieldNames()
    assert row["Recipient_Zip_Code"] == "02134"
    assert row["Total_Amount_of_Payment_USDollars"] == "12.5"


def test_dirty_amounts_survive_the_payments_scan(spark, tmp_path):
    names = RAW_PAYMENTS.fieldNames()
    path = tmp_path / "dirty.csv"
    amounts = ['"$1,234.56"', "12.5", "USD 7"]
    lines = [",".join(a if n == "Total_Amount_of_Payment_USDollars" else "x" for n in names) for a in amounts]
    path.write_text("\n".join([",".join(names), *lines]) + "\n")
    raw = readers.scan_csv(spark, str(path), RAW_PAYMENTS)
    assert [r["Payment_Amount"] for r in clean_payments(raw).collect()] == [1.0, 12.5, 7.0]
    assert [r["Payment_Amount"] for r in clean_payments(raw, strict=True).collect()] == [1234.56, 12.5, 7.0]


def test_folder_of_one_machine_is_refused_on_a_cluster():
    class Context:
        master = "spark://host:7077"

    class Session:
        conf = {"spark.checkpoint.dir": "file:/tmp/x"}
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="one machine"):
        staging.staging_root(Session())


def test_csv_scan_rejects_a_file_without_a_needed_column(spark, tmp_path):
    path = tmp_path / "narrow.csv"
    path.write_text("Covered_Recipient_NPI\n1\n")
    with pytest.raises(readers.MissingColumns, match="Recipient_Zip_Code"):
        readers.scan_csv(spark, str(path), RAW_PAYMENTS)


def test_text_scan_keeps_text(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b\n007,1.50\n")
    assert tuple(readers.scan_csv_text(spark, str(path), ["b", "a"]).first()) == ("1.50", "007")


def test_reader_options_are_passed_on(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text('a,b\n"said ""x"", left",1\n')
    assert readers.scan_csv_text(spark, str(path), ["a"], escape='"').first()[0] == 'said "x", left'


def test_align_to_schema(spark):
    df = spark.createDataFrame([(5, "3.5", 1)], "prescriber_id int, total_claims string, other int")
    out = readers.align_to_schema(df, SCORING_RECORD)
    assert [(f.name, f.dataType) for f in out.schema.fields] == [(f.name, f.dataType) for f in SCORING_RECORD.fields]
    row = out.first()
    assert row["prescriber_id"] == "5" and row["total_claims"] == 3.5 and row["state"] is None


def test_sink_sorts_and_splits_a_repeated_value(spark, tmp_path):
    """A third of the rows share one sort value; they must not all be written by one task."""
    df = spark.range(0, 40_000, 1, 16).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # keep tiny partitions apart
    try:
        path = sinks.write_table(df, str(tmp_path / "t"), order_by="k")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    again = readers.scan_parquet(spark, path, df.schema)
    files = again.withColumn("file", F.input_file_name())
    assert files.filter("k = 7").select("file").distinct().count() > 1
    ranges = files.groupBy("file").agg(F.min("k").alias("low"), F.max("k").alias("high")).orderBy("file").collect()
    assert all(a["high"] <= b["low"] for a, b in zip(ranges, ranges[1:]))
    keys = [r["k"] for r in sinks.globally_sorted(df, "k").select("k").collect()]
    assert keys == sorted(keys)
    assert again.columns == df.columns and again.exceptAll(df).isEmpty() and again.count() == 40_000


def test_sink_ignores_an_absent_sort_column_and_overwrites(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_table(spark.range(5), path, order_by="nope")
    sinks.write_table(spark.range(3), path)
    assert spark.read.parquet(path).count() == 3


def test_first_rows(spark):
    assert [r[0] for r in readers.first_rows(spark.range(100).orderBy(F.desc("id")), 3, ["id"]).collect()] == [0, 1, 2]


def test_stage_reads_back_the_same_rows_from_the_shared_folder(spark):
    staged = staging.stage(spark.range(10).withColumn("t", F.lit("x")), "numbers")
    assert staged.count() == 10
    assert all(staging.staging_root(spark) in f for f in staged.inputFiles())


def test_a_stage_leaves_no_shuffle_and_a_block_no_tables(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {f for f in map(str, disk.getAllFiles().mkString("\n").split("\n")) if "shuffle_" in f}
    before = shuffles()
    with staging.passing(spark) as keep:
        counts = staging.stage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
        total = keep(counts.agg(F.sum("count").alias("n")), "total")
        path = staging._PATHS[counts]
    assert not shuffles() - before
    assert total.first()["n"] == 1000
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
    staging.release(total)


def test_dropping_stages_leaves_other_files_alone(spark):
    context = spark.sparkContext
    other_app = SimpleNamespace(
        conf=spark.conf, sparkContext=SimpleNamespace(applicationId="app-2", _jvm=context._jvm, _jsc=context._jsc)
    )
    mine = staging.stage(spark.range(3), "mine")
    theirs = sinks.write_table(spark.range(3), staging.new_path(other_app, "theirs"))
    staging.drop_stages(other_app)
    assert mine.count() == 3
    with pytest.raises(readers.MissingInput):
        readers.scan_parquet(spark, theirs)


def _session(master, folder=None):
    made = []
    context = SimpleNamespace(
        master=master, getCheckpointDir=lambda: made[-1] if made else folder, setCheckpointDir=made.append
    )
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=context)


def test_cluster_without_a_shared_folder_is_refused():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        staging.staging_root(_session("spark://host:7077"))
    assert staging.staging_root(_session("yarn", "hdfs://x/y")) == "hdfs://x/y"
    local = _session("local[2]")
    assert staging.staging_root(local) == staging.staging_root(local)


def test_checked_scan_keeps_what_does_not_fit(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("id,amount,extra,when\n1,2.5,x,2024-01-02\n2,$3,x,2024-01-02\n3,,x,\n4,abc,x,soon\n")
    (tmp_path / "in" / "b.csv").write_text('id,amount,extra,when\n5,7,"quoted, comma",2024-05-05\n6,8\n7,9,x,2024-01-01,more,and more\nnine,1,x,2024-01-01\n')
    schema = "id bigint, amount double, when date"
    schema = spark.createDataFrame([], schema).schema
    accepted, rejected = rejects.scan_csv_checked(spark, str(tmp_path / "in"), schema)
    assert accepted.schema == schema
    assert sorted((r["id"], r["amount"]) for r in accepted.collect()) == [(1, 2.5), (3, None), (5, 7.0)]
    reasons = {r["id"]: [(x["column_name"], x["value"], x["wanted"]) for x in r["reasons"]] for r in rejected.collect()}
    assert reasons["2"] == [("amount", "$3", "double")]
    assert reasons["4"] == [("amount", "abc", "double"), ("when", "soon", "date")]
    assert reasons["nine"] == [("id", "nine", "bigint")]
    assert [x[:2] for x in reasons["6"]] == [("", "6,8")] and [x[:2] for x in reasons["7"]] == [("", "7,9,x,2024-01-01,more,and more")]
    counts = {r["column_name"]: r["n_values"] for r in rejects.reject_counts(rejected).collect()}
    assert counts == {"amount": 2, "when": 1, "id": 1, "": 2}
    with pytest.raises(readers.MissingColumns, match="other"):
        rejects.check_csv(spark, str(tmp_path / "in"), schema.add("other", "string"))
