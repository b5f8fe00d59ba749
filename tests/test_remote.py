"""Remote files fetched and placed, both forms of an image, and what a dataset's inventory says of odd subjects."""

import hashlib

import numpy as np
import pytest

from cohortis.functions.columns import named
from cohortis.operators import cohort, studies
from cohortis.operators import tabular as R
from cohortis.sources import nifti, remote


def test_fetch_checks_retries_and_skips(tmp_path):
    (tmp_path / "7").write_bytes(b"seven")
    sha, url, place, waits = hashlib.sha1(b"seven").hexdigest(), (tmp_path / "7").as_uri(), tmp_path / "raw" / "a" / "f", []
    assert remote.fetch(url, place, 5, sha, wait=waits.append) == "downloaded" and place.read_bytes() == b"seven" and waits == []
    assert remote.fetch("file:///nowhere", place, 5, sha) == "present"
    place.write_bytes(b"SEVEN")  # the size is right, the hash isn't
    assert remote.fetch("file:///nowhere", place, 5, sha, verify=False) == "present"
    assert remote.fetch(url, place, 5, sha) == "downloaded" and place.read_bytes() == b"seven"
    place.write_bytes(b"cut")
    with pytest.raises(OSError, match="3 attempts.*SHA-1"):
        remote.fetch(url, place, 5, "0" * 40, wait=waits.append)
    assert waits == [2, 4] and place.read_bytes() == b"cut" and [p.name for p in place.parent.iterdir()] == ["f"]


def test_failures_are_rows(spark, tmp_path):
    (tmp_path / "1").write_bytes(b"one")
    sha = hashlib.sha1(b"one").hexdigest()
    files = spark.createDataFrame([("r/1", "l/1", "1", 3, sha), ("r/2", "l/2", "2", 3, sha)], "remote_path string, local_path string, file_id string, size long, sha1 string")
    fetched = lambda: {r.remote_path: r for r in remote.fetch_all(files, str(tmp_path / "raw"), f"{tmp_path.as_uri()}/{{file_id}}", 2, retries=1).collect()}
    first, again = fetched(), fetched()
    assert (first["r/1"].status, first["r/2"].status, again["r/1"].status) == ("downloaded", "failed", "present") and first["r/1"].problem is None and "1 attempts" in first["r/2"].problem
    plan = spark.createDataFrame([("l/1", "sub-1/x"), ("l/2", "sub-1/y"), (None, "sub-1/z")], "from_path string, to_path string")
    placed = lambda: {r.to_path: r.status for r in remote.place_all(plan, str(tmp_path / "raw"), str(tmp_path / "out"), 2).collect()}
    assert placed() == {"sub-1/x": "hardlink", "sub-1/y": "missing", "sub-1/z": "missing"} and placed()["sub-1/x"] == "present"
    assert remote.fetch_all(files.limit(0), str(tmp_path), "file:///{file_id}").count() == 0


@pytest.mark.parametrize("flips", [(1, 1, 1), (-1, 1, 1), (-1, -1, 1), (1, -1, -1), (-1, -1, -1)])
def test_both_forms_hold_the_affine(flips):
    turn, _ = np.linalg.qr(np.random.default_rng(3).normal(size=(3, 3)))
    for linear in (np.diag(flips), turn * flips):
        affine = np.eye(4)
        affine[:3, :3], affine[:3, 3] = linear * [0.9, 1.2, 3.0], (-10, 20, 5)
        raw = nifti.encode(np.zeros(24), (2, 3, 4), affine)
        h = nifti.header(raw)
        assert np.allclose(h.qform, affine, atol=1e-4) and np.allclose(h.sform, affine, atol=1e-4) and nifti.described(raw)["forms_agree"] is True
        bare = bytearray(raw)
        bare[254:256] = b"\0\0"  # no sform: the qform decides
        assert np.allclose(np.reshape(nifti.decode(bytes(bare))["affine"], (4, 4)), affine, atol=1e-4) and nifti.described(bytes(bare))["forms_agree"] is None


def test_described_and_written_alike(spark, tmp_path):
    affine = np.array([[0, -2.0, 0, 1], [1, 0, 0, 2], [0, 0, 3, 3], [0, 0, 0, 1]])
    data = np.append(np.arange(23.0), np.nan)
    like = nifti.encode(data, (2, 3, 4), affine, codes=(2, 4))
    said = nifti.described(like, statistics=True)
    assert (said["axcodes"], said["qform_code"], said["sform_code"], said["dtype"], said["voxel_mm"]) == ("ALS", 2, 4, "float32", [1.0, 2.0, 3.0])
    assert (said["least"], said["p50"], said["greatest"]) == (0.0, 11.0, 22.0)
    mask = nifti.encode_like(data > 3, like, "bool")
    assert nifti.described(mask) | {"dtype": "float32"} == {k: said[k] for k in nifti.described(mask)} and nifti.decode(mask)["affine"] == nifti.decode(like)["affine"]
    with pytest.raises(ValueError, match="shape"):
        nifti.encode_like(data[:5], like)
    moving = bytearray(like)
    moving[40:50] = np.array([4, 2, 3, 2, 2], "<i2").tobytes()
    with pytest.raises(ValueError, match="4 axes"):
        nifti.decode(bytes(moving))
    (tmp_path / "a.nii").write_bytes(like)
    (tmp_path / "b.nii").write_bytes(b"no")
    rows = sorted(nifti.describe_files(spark, str(tmp_path)).collect(), key=lambda r: r.path)
    assert rows[0].axcodes == "ALS" and rows[0].error is None and rows[1].shape is None and "NIfTI" in rows[1].error


def test_inventory_of_odd_subjects(spark):
    eye = [float(i % 5 == 0) for i in range(16)]
    shape, fields = [2, 1, 1], "s int, kind string, shape array<int>, spacing array<double>, affine array<double>, axcodes string, dtype string, forms_agree boolean, data array<float>"
    row = lambda s, kind, data, agree=True, affine=eye: (s, kind, shape, [10.0, 10.0, 10.0], affine, "RAS", "int16", agree, data)
    rows = [row(1, "image", [0.0, 5.0], False), row(1, "one", [1.0, 2.0]), row(1, "mask", [0.0, 0.5]), row(2, "image", [1.0, 1.0], None), row(2, "one", [7.0, 1.0], affine=[2.0, *eye[1:]]), row(3, "one", [1.0, 1.0]), row(3, "one", [1.0, 1.0])]
    got = {r.s: r for r in cohort.inventory(spark.createDataFrame(rows, fields), "s", "image", {"one": "a"}, "mask").collect()}
    assert set(got) == {1, 2}  # a subject without the image has no row
    assert (got[1].shape, got[1].voxel_mm, got[1].forms_agree, got[1].a_valid, got[1].a_same_grid, got[1].a_wmh_ml, got[1].a_other_ml) == ("2x1x1", "10.00x10.00x10.00", False, True, True, 1.0, 1.0)
    assert (got[1].defaced, got[1].mask_partial_fraction, got[1].defaced_fraction, got[1].zero_where_defaced) == (True, 0.5, 0.5, True)
    assert (got[2].forms_agree, got[2].a_valid, got[2].a_same_grid, got[2].a_wmh_ml, got[2].defaced, got[2].defaced_fraction) == (True, False, False, None, False, None)
    assert cohort.inventory(spark.createDataFrame([], fields), "s", "image", {"one": "a"}, "mask").collect() == []


def test_templates_steps_cases_and_whole_batches(spark):
    assert R.steps(0, 0.3, 0.1) == [0.0, 0.1, 0.2, 0.3] and R.steps(1, 0.5, 0.1) == [] and R.steps(0.5, 0.95, 0.2) == [0.5, 0.7, 0.9]
    with pytest.raises(ValueError, match="positive"):
        R.steps(0, 1, 0)
    one = spark.createDataFrame([("s1", "done")], "participant_id string, status string")
    from pyspark.sql import functions as F

    assert one.select(named("{a}-x/{a}_{b}.gz", a=F.col("participant_id"), b=F.lit(2))).first()[0] == "s1-x/s1_2.gz"
    cases = studies.robustness_cases(one, {"noise": [0.0, 0.3], "bias": []}).orderBy("level").collect()
    assert [(r.artifact, r.level_index, r.case) for r in cases] == [("none", 0, None), ("noise", 1, "s1_noise1")]
    assert studies.accepted(one).first().status == "done"
    with pytest.raises(Exception, match="not done.*s2"):
        studies.accepted(one.union(spark.createDataFrame([("s2", "missing")], one.schema))).collect()
