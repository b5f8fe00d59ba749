import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortis.sources import images, nifti


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Two good images of 2 x 3 x 5, one of them packed, one cut off in its data, and a text."""
    images.register(spark)
    at = tmp_path_factory.mktemp("images")
    data, affine = np.arange(30, dtype=np.float32), np.diag([1.0, 1.0, 3.0, 1.0])
    plain = nifti.encode(data, (2, 3, 5), affine)
    (at / "deep").mkdir()
    (at / "a.nii").write_bytes(plain)
    (at / "deep" / "b.nii.gz").write_bytes(gzip.compress(plain))
    (at / "cut.nii").write_bytes(plain[:400])
    (at / "bad.nii").write_bytes(b"nothing")
    (at / "_hidden.nii").write_bytes(plain)
    (at / "notes.txt").write_text("x")
    return at


def load(spark, at, schema=None, **options):
    reader = spark.read.format("nifti1").options(**options)
    return (reader.schema(schema) if schema else reader).load(str(at))


def test_images_are_rows_and_bad_files_say_so(spark, folder):
    got = {r.path.rsplit("/", 1)[-1]: r for r in load(spark, folder).collect()}
    assert sorted(got) == ["a.nii", "b.nii.gz", "bad.nii", "cut.nii"]
    for name in ("a.nii", "b.nii.gz"):
        want = nifti.decode((folder / ("deep" if "b" in name else "") / name).read_bytes())
        r = got[name]
        assert (r.shape, r.spacing, r.affine, r.data) == (want["shape"], want["spacing"], want["affine"], want["data"].tolist()) and r.error is None and r.first == 0
    assert "NIfTI" in got["bad.nii"].error and "early" in got["cut.nii"].error and got["cut.nii"].data is None


def test_a_header_query_reads_no_data(spark, folder):
    # The data of cut.nii are missing, which only a query for them can notice.
    got = {r.path.rsplit("/", 1)[-1]: (r.shape, r.error) for r in load(spark, folder, "error string, shape array<int>, path string").collect()}
    assert got["cut.nii"] == ([2, 3, 5], None) and got["a.nii"] == got["b.nii.gz"] == ([2, 3, 5], None) and got["bad.nii"][0] is None
    with pytest.raises(Exception, match="no columns"):
        load(spark, folder, "path string, colour int").collect()


@pytest.mark.parametrize("slices", [1, 2, 3, 5, 9])
@pytest.mark.parametrize("size", [1, 100, 1 << 20])
def test_slices_in_any_pieces_make_the_image(spark, folder, slices, size):
    rows = load(spark, folder, slices=slices, bytes=size).where("error is null").where(~F.col("path").contains("cut"))
    for path in (folder / "a.nii", folder / "deep" / "b.nii.gz"):
        own = sorted(rows.where(F.col("path") == str(path)).collect(), key=lambda r: r.first)
        assert [r.first for r in own] == [*range(0, 5, slices)]
        assert [v for r in own for v in r.data] == list(range(30))


def test_filters_on_the_path_choose_the_files(spark, folder):
    df = load(spark, folder, "path string, error string")
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    some = df.where(F.col("path").endswith("a.nii"))
    assert [r.path for r in some.collect()] == [str(folder / "a.nii")] and "Filter " not in plan(some)
    assert df.where(F.col("path").isin(str(folder / "a.nii"), str(folder / "bad.nii"))).count() == 2
    assert df.where(F.col("path").startswith(str(folder / "deep"))).count() == 1 and df.where("path like '%nii' and error is not null").count() == 1


def test_paths_that_hold_nothing(spark, folder, tmp_path):
    assert load(spark, tmp_path).count() == 0 and load(spark, f"file://{folder}/a.nii").first().path == f"file://{folder}/a.nii"
    with pytest.raises(Exception, match="FileNotFound|none-such"):
        load(spark, folder / "none-such").collect()
