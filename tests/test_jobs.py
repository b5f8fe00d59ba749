"""The jobs on copies of given tables: growing input, reruns, broken runs, odd rows."""

import os
import shutil
import subprocess
import sys

import pytest
from conftest import ROOT, same
from pyspark.sql import functions as F

from jobs import intake, queries, site_review

COLUMNS = ["record", "site", "modality", "bytes", "words", "sha256", "deliveries", "contents", "copies"]


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


def deliver(df, folder, name):
    """A file more in the folder, later than those there."""
    df.coalesce(1).write.mode("overwrite").parquet(f"{folder}-{name}")
    part = next(f for f in os.listdir(f"{folder}-{name}") if f.startswith("part-"))
    os.makedirs(folder, exist_ok=True)
    shutil.move(f"{folder}-{name}/{part}", f"{folder}/{name}.parquet")
    at = 1_700_000_000 + len(os.listdir(folder))
    os.utime(f"{folder}/{name}.parquet", (at, at))


def rows(df):
    return sorted(map(str, df.select(*COLUMNS).collect()))


def test_intake_of_growing_input(spark, docs, tmp_path):
    inbox, out, mark = (str(tmp_path / n) for n in ("inbox", "out", "mark"))
    deliver(docs.where("doc_id % 3 = 0"), inbox, "first")
    first = rows(intake.run(spark, inbox, out, mark))
    assert len(first) == docs.where("doc_id % 3 = 0").count()
    before = {p: os.stat(os.path.join(d, p)).st_mtime_ns for d, _, files in os.walk(f"{out}/current") for p in files if p.startswith("part-")}
    # Nothing new: the same rows, and no file is written.
    assert rows(intake.run(spark, inbox, out, mark)) == first
    assert before == {p: os.stat(os.path.join(d, p)).st_mtime_ns for d, _, files in os.walk(f"{out}/current") for p in files if p.startswith("part-")}
    # More of all sites, and one site's records again, some of them changed.
    again = docs.where("doc_id % 3 = 0 and source = 'src0'").withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit(" more"))).otherwise(F.col("text")))
    deliver(docs.where("doc_id % 3 = 1").union(again), inbox, "second")
    second = intake.run(spark, inbox, out, mark)
    ledger = spark.read.parquet(f"{out}/ledger")
    assert ledger.count() == docs.where("doc_id % 3 <> 2").count() + again.count()  # each file once
    changed = {r.record for r in second.where("contents = 2").collect()}
    assert changed == {r.doc_id for r in again.where("doc_id % 2 = 0").collect()} and all(r.deliveries == 2 for r in second.where(F.col("record").isin(list(changed))).collect())
    want = {r.doc_id: r.x for r in docs.where("doc_id % 3 = 1").union(again).select("doc_id", F.sha2("text", 256).alias("x")).collect()}
    assert all(r.sha256 == want[r.record] for r in second.collect() if r.record in want)
    # All files at once come to the same.
    assert rows(intake.run(spark, inbox, str(tmp_path / "out2"), str(tmp_path / "mark2"))) == rows(second)
    sites = {(r.site, r.modality): r for r in spark.read.parquet(f"{out}/sites").collect()}
    assert sum(r.records for r in sites.values()) == second.count() and sum(r.changed for r in sites.values()) == len(changed)
    due = docs.select("doc_id")
    assert intake.missing(second.withColumnRenamed("record", "doc_id"), due, ["doc_id"]).count() == docs.where("doc_id % 3 = 2").count()


def test_intake_goes_on_after_a_broken_run(spark, docs, tmp_path):
    inbox, out, mark = (str(tmp_path / n) for n in ("inbox", "out", "mark"))
    settings = {**intake.DEFAULTS, "files_a_batch": 1}
    deliver(docs.where("doc_id % 2 = 0"), inbox, "a")
    intake.run(spark, inbox, out, mark, settings)
    deliver(docs.where("doc_id % 2 = 1"), inbox, "b")
    # The ledger is complete, the present state isn't: the run broke off between them.
    intake.take(spark, inbox, f"{out}/ledger", mark, settings)
    assert intake.behind(spark.read.parquet(f"{out}/ledger"), spark.read.parquet(f"{out}/current")).count() > 0
    done = rows(intake.run(spark, inbox, out, mark, settings))
    assert len(done) == docs.count() and done == rows(intake.run(spark, inbox, str(tmp_path / "whole"), str(tmp_path / "whole-mark"), settings))


def test_jobs_on_odd_rows(spark, docs, data, tmp_path):
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "no id", "en", "", 5), (None, "no id", "en", "", 5), (None, None, "en", "12", None), (900_002, "w " * 200_000, "", "a/b=c", 1), (900_002, "", "", "a/b=c", 1), (3, "1234 !!\n\n", "en", "a/b=c", 9)], docs.schema)
    few = odd.union(docs.limit(40)).withColumns({c: F.lit("x") for c in ("identity", "site", "sha256", "z", "bad", "measure")})
    few.write.parquet(f"{tmp_path}/in/documents.parquet")
    got = intake.run(spark, f"{tmp_path}/in/documents.parquet", f"{tmp_path}/out", f"{tmp_path}/mark")
    assert got.count() == 45 and {r.site for r in got.select("site").distinct().collect()} >= {None, "", "12", "a/b=c"}
    assert {(r.deliveries, r.contents) for r in got.where("record = 900002").collect()} == {(2, 2)} and got.where("record is null and site = ''").first().deliveries == 2
    flags = site_review.run(spark, f"{tmp_path}/in/documents.parquet", f"{data}/labels.parquet", f"{tmp_path}/review")
    assert flags.count() == 46 and flags.where("record = 900002").count() == 2 and {r.qc_class for r in flags.where("site = 'a/b=c'").collect()} == {"not_assessed"}
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert intake.run(spark, f"{tmp_path}/none/documents.parquet", f"{tmp_path}/out0", f"{tmp_path}/mark0").columns == got.columns
    assert site_review.run(spark, f"{tmp_path}/none/documents.parquet", f"{data}/labels.parquet", f"{tmp_path}/review0").count() == 0


def test_review_flags_what_is_unlike(spark, docs, data, tmp_path):
    plain = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("some words "), 20 + F.col("id").cast("int") % 5), F.lit("here")).alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") < 50, "big").otherwise("small").alias("source"), F.lit(0).cast("long").alias("n_chars"))
    strange = spark.createDataFrame([(100, "9" * 250, "en", "big", 0), (101, "some words " * 22 + "!!!!", "en", "big", 0)], plain.schema)
    plain.union(strange).write.parquet(f"{tmp_path}/documents.parquet")
    flags = {r.record: r for r in site_review.run(spark, f"{tmp_path}/documents.parquet", f"{data}/labels.parquet", f"{tmp_path}/out", {"least_per_group": 20}).collect()}
    assert flags[100].qc_class == "exclude" and {flags[i].qc_class for i in range(50, 60)} == {"not_assessed"} and flags[50].max_z is None and flags[50].worst_measure is None
    assert {flags[i].qc_class for i in range(50)} == {"usable"}
    report = spark.read.parquet(f"{tmp_path}/out/report")
    assert report.agg(F.sum("records")).first()[0] == 62 and spark.read.parquet(f"{tmp_path}/out/validation").count() == 1


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, data, duck, name):
    conf = dict(spark.conf.getAll)
    same(queries.QUERIES[name](spark, data), duck.sql(queries.ORACLES[name]))
    assert conf == dict(spark.conf.getAll)


def test_command_lines(data, docs, tmp_path):
    env = {**os.environ, "PYTHONPATH": ROOT, "SPARK_CONF_DIR": str(tmp_path)}
    (tmp_path / "spark-defaults.conf").write_text("spark.master local[2]\nspark.sql.shuffle.partitions 2\nspark.ui.enabled false\n")
    run = lambda *args: subprocess.run([sys.executable, "-m", *args], cwd=ROOT, env=env, capture_output=True, text=True, timeout=300)
    done = run("jobs.intake", "--input", f"{data}/documents.parquet", "--output", f"{tmp_path}/o", "--checkpoint", f"{tmp_path}/c", "--expected", f"{data}/labels.parquet")
    assert done.returncode == 0 and "records read from" in done.stderr and os.path.isdir(f"{tmp_path}/o/missing"), done.stderr[-2000:]
    done = run("jobs.site_review", "--records", f"{data}/documents.parquet", "--truth", f"{data}/labels.parquet", "--output", f"{tmp_path}/r", "--config", "jobs/site_review.json")
    assert done.returncode == 0 and "validation:" in done.stderr and os.path.isdir(f"{tmp_path}/r/flags"), done.stderr[-2000:]
