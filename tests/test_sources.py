import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortis import schemas
from cohortis.sources import files, nifti
from cohortis.streaming import resume


def test_csv_round_trip_rounds_only_at_the_sink(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.123456, 0.123456, True), ("b", None, float("nan"), False)], "id string, v double, p_x double, ok boolean")
    files.write_csv(df, str(tmp_path / "t"), 4)
    got = {r.id: (r.v, r.p_x, r.ok) for r in files.read_csv(spark, str(tmp_path / "t"), df.schema).collect()}
    assert got == {"a": (0.1235, 0.123456, True), "b": (None, None, False)}


def test_evaluations_skip_summaries(spark, tmp_path):
    schema = schemas.struct("participant_id string, split string, model string, dice double")
    for name, body in (("evaluation_a.csv", "s1,test,a,0.5\ns2,training,a,0.1\n"), ("evaluation_b.csv", "s1,test,b,n/a\n"), ("evaluation_a_summary.csv", "x,test,a,9\n")):
        (tmp_path / name).write_text("participant_id,split,model,dice\n" + body)
    got = sorted(tuple(r) for r in files.read_evaluations(spark, str(tmp_path), schema).collect())
    assert got == [("s1", "test", "a", 0.5), ("s1", "test", "b", None)]


def test_documents_and_digests(spark, tmp_path):
    df = spark.createDataFrame([(2.2, None)], "t double, e double")
    files.write_document(df, str(tmp_path / "d"))
    assert files.read_document(spark, str(tmp_path / "d"), schemas.struct("t double, e double")).first().t == 2.2
    (tmp_path / "x.bin").write_bytes(b"abc")
    assert files.digests(spark, str(tmp_path / "x.bin")).first().sha1 == "a9993e364706816aba3e25717850c26c9cd0d89d"


def test_remote_listing(spark, tmp_path):
    entry = lambda d, n, kind="SHA-1": {"directoryLabel": d, "dataFile": {"id": 7, "filename": n, "filesize": 3, "checksum": {"type": kind, "value": "aa"}}}
    listing = {"latestVersion": {"versionNumber": 2, "versionMinorNumber": 1, "files": [entry("training/A B./0", "T1.nii"), entry("", "readme.")]}}
    (tmp_path / "l.json").write_text(json.dumps(listing))
    got = sorted(tuple(r)[:4] for r in files.remote_files(spark, str(tmp_path / "l.json")).collect())
    assert got == [("2.1", "7", "readme.", "readme_"), ("2.1", "7", "training/A B./0/T1.nii", "training/A_B_/0/T1.nii")]
    (tmp_path / "w.json").write_text(json.dumps({"status": "OK", "data": listing}))
    assert sorted(tuple(r)[:4] for r in files.remote_files(spark, str(tmp_path / "w.json")).collect()) == got
    (tmp_path / "n.json").write_text(json.dumps({"status": "ERROR"}))
    with pytest.raises(Exception, match="without latestVersion"):
        files.remote_files(spark, str(tmp_path / "n.json")).collect()
    (tmp_path / "m.json").write_text(json.dumps({"latestVersion": {"versionNumber": 1, "versionMinorNumber": 0, "files": [entry("", "x", "MD5")]}}))
    with pytest.raises(Exception, match="not a SHA-1"):
        files.remote_files(spark, str(tmp_path / "m.json")).collect()


def test_selected_files(spark):
    names = ["training/A/0/pre/FLAIR.nii", "test/A/1/pre/FLAIR.nii", "training/A/0/orig/T1.nii", "additional_annotations/observer_o3/training/A/0/result.nii.gz", "additional_annotations/observer_o9/training/A/0/result.nii.gz", "additional_annotations/observer_o3/training/A/0/other.nii.gz", "additional_annotations/observer_o33/training/A/0/result.nii.gz", "training/A B./C/12/pre/FLAIR.nii", "training/A/x/pre/FLAIR.nii", "training/0/pre/FLAIR.nii", "readme.txt"]
    df = spark.createDataFrame([(n,) for n in names], "remote_path string")
    got = [r[0] for r in files.selected_files(df, ["pre/FLAIR.nii"], ["observer_o3", "observer_o33"], ["readme.txt"], ["training"]).collect()]
    assert got == sorted([names[0], names[3], names[7], names[-1]])


def test_nifti_round_trip(spark, tmp_path):
    data = np.arange(24, dtype=np.float32)
    affine = np.diag([1.0, 1.0, 3.0, 1.0])
    (tmp_path / "sub-001_space-flair_T1w.nii.gz").write_bytes(gzip.compress(nifti.encode(data, (2, 3, 4), affine)))
    (tmp_path / "sub-002_mask.nii").write_bytes(nifti.encode(data > 3, (2, 3, 4), affine, "bool"))
    (tmp_path / "sub-003_bad.nii").write_bytes(b"nothing")
    got = {r.subject: r for r in nifti.read_volumes(spark, str(tmp_path)).collect()}
    one = got["sub-001"]
    assert (one.space, one.modality, one.shape, one.spacing) == ("flair", "T1w", [2, 3, 4], [1.0, 1.0, 3.0]) and one.data == data.tolist() and one.affine == affine.ravel().tolist()
    assert sum(got["sub-002"].data) == 20 and got["sub-003"].data is None and "NIfTI" in got["sub-003"].error
    with pytest.raises(ValueError, match="shape"):
        nifti.encode(data, (2, 2, 2), affine)


def test_resumable_upserts(spark, tmp_path):
    schema = schemas.struct("k int, v string")
    src, table, check = str(tmp_path / "src"), str(tmp_path / "table"), str(tmp_path / "check")
    spark.createDataFrame([(1, "a"), (2, "a")], schema).coalesce(1).write.parquet(src)
    resume.upsert_stream(spark, src, table, check, schema, ["k"])
    resume.upsert_stream(spark, src, table, check, schema, ["k"])  # nothing new
    spark.createDataFrame([(2, "b"), (3, "b")], schema).coalesce(1).write.mode("append").parquet(src)
    resume.upsert_stream(spark, src, table, check, schema, ["k"])
    assert sorted(tuple(r) for r in resume.latest(spark, table, schema).collect()) == [(1, "a"), (2, "b"), (3, "b")]


def test_a_repeated_batch_gives_the_same_version(spark, tmp_path):
    import shutil

    schema = schemas.struct("k int, v string")
    src, table, check = str(tmp_path / "src"), str(tmp_path / "table"), tmp_path / "check"
    for rows in ([(1, "a"), (2, "a")], [(2, "b"), (3, "b")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        resume.upsert_stream(spark, src, table, str(check), schema, ["k"])
    last = max(check.joinpath("commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    shutil.rmtree(check / "commits" / f".{last.name}.crc", ignore_errors=True)
    (check / "commits" / f".{last.name}.crc").unlink(missing_ok=True)
    resume.upsert_stream(spark, src, table, str(check), schema, ["k"])
    assert sorted(tuple(r) for r in resume.latest(spark, table, schema).collect()) == [(1, "a"), (2, "b"), (3, "b")]
    assert sorted(tuple(r) for r in resume.latest(spark, table, schema, 1).collect()) == [(1, "a"), (2, "a")]


def test_schema_comments(spark):
    made = schemas.struct(schemas.PARTICIPANTS, schemas.PARTICIPANT_COMMENTS)
    assert made["split"].metadata["comment"] == "training or test" and F.col("x") is not None
