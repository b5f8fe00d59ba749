import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortis.operators import studies as S
from cohortis.operators.voxel import kernel
from cohortis.plans.workflow import Workflow
from cohortis.sources import reports
from cohortis.sources.files import MissingInput


def test_training_log(spark):
    text = """start
t: Epoch 0
t: Current learning rate: 1e-2
t: train_loss -0.5
t: val_loss -0.4
t: Pseudo dice [np.float32(0.61)]
t: Epoch time: 12.5 s
t: Epoch 1
t: train_loss -0.6"""
    rows = [("a", i, t) for i, t in enumerate(text.splitlines())] + [("b", 0, "t: Epoch 1"), ("b", 1, "t: train_loss -0.7"), ("b", 2, "t: train_loss -0.8")]
    got = {r.epoch: r for r in S.training_metrics(spark.createDataFrame(rows, "file string, n int, text string")).collect()}
    assert set(got) == {0, 1} and (got[0].lr, got[0].train_loss, got[0].pseudo_dice, got[0].epoch_s) == (0.01, -0.5, 0.61, 12.5)
    assert got[1].train_loss == -0.8 and got[1].lr is None, "the last record of an epoch counts"


def test_degrade():
    x = np.full((8, 8, 4), 100.0)
    brain = np.ones(x.shape, dtype=bool)
    assert (S.degrade(x, brain, "noise", 0, 1) == x).all() and abs(S.degrade(x, brain, "noise", 0.1, 1).std() - 10) < 2
    assert np.ptp(S.degrade(x, brain, "bias", 0.3, 1)) > 10 and (S.degrade(x, brain, "noise", 5, 1) >= 0).all()
    with pytest.raises(MissingInput, match="spike"):
        S.degrade(x, brain, "spike", 1, 1)


def test_tissue_masks():
    labels = np.ones((9, 9, 9), dtype=int)
    labels[4, 4, 4], labels[:, :, 0] = 7, 2
    wm, gm = S.tissue_masks(labels, np.ones(labels.shape, dtype=bool), [1], [2], 7, (1, 1, 1), 2.0)
    assert gm.sum() == 81 and not wm[4, 4, 6] and not wm[0].any() and wm[4, 4, 7]


def test_contracts(spark):
    wanted = spark.createDataFrame([("a",), ("b",)], "subject string")
    with pytest.raises(MissingInput, match="load its masks"):
        S.outcome("segmentation", None, wanted)
    with pytest.raises(MissingInput, match="lacks mask"):
        S.outcome("segmentation", wanted.withColumn("model", F.lit("m")), wanted)
    safe = S.captured(lambda x: [{"v": 1 / int(x.sum())}])
    df = spark.createDataFrame([(1, [1.0]), (2, [0.0])], "id int, a array<double>")
    got = {r.id: r.status for r in kernel(df, ["id"], ["a"], (1, 1, 1), safe, "v double, status string").collect()}
    assert got == {1: "ok", 2: "failed: division by zero"}


def test_points_and_field(spark):
    long = spark.createDataFrame([("s", x, y, 0, float(x)) for x in range(4) for y in range(4)], "s string, x int, y int, z int, v double")
    pts = S.sampled_points(long, ["s"], F.col("v") > 0, 5, [2, 0, 0, 1, 0, 1, 0, 0, 0, 0, 1, 0])
    assert pts.count() == 5 and all(r.x_mm in (3, 5, 7) for r in pts.collect())


def test_reports(spark, tmp_path):
    flags = spark.createDataFrame([("a", "s<1>", "usable"), ("b", "s<1>", "exclude")], "participant_id string, scanner string, qc_class string")
    z = spark.createDataFrame([("b", m, v) for m, v in (("w", 1.0), ("x", 9.0), ("y", 5.0), ("u", 2.0))], "participant_id string, metric string, z double")
    page = reports.build_html(*reports.report_rows(z, flags))
    assert "s&lt;1&gt;" in page and "x 9.0, y 5.0, u 2.0" in page and "w 1.0" not in page
    with pytest.raises(ValueError, match="highest"):
        reports.dataset_document("d", {}, {"ignore": 1, "lesion": 2}, 3)
    folds = json.loads(reports.folds_document(spark.createDataFrame([("c1", 0), ("c2", 1)], "case_id string, fold int"), 2))
    assert folds == [{"train": ["c2"], "val": ["c1"]}, {"train": ["c1"], "val": ["c2"]}]
    (tmp_path / "d").mkdir()
    (tmp_path / "d/b").write_text("x")
    (tmp_path / "d/a").write_text("y")
    assert reports.zip_folder(str(tmp_path / "d"), str(tmp_path / "o.zip")) == ["a", "b"]


def test_participants_and_sidecars(spark):
    scanners = spark.createDataFrame([("Site A", "A", "I", "M", "X", 3.0, True)], "site string, scanner string, institute string, manufacturer string, model string, field_strength_t double, seen_in_training boolean")
    subjects = spark.createDataFrame([("sub-001", 1, "test", "Site A")], "participant_id string, original_id int, split string, site string")
    assert reports.participants(subjects, scanners).first().scanner == "A"
    with pytest.raises(Exception, match="unknown site"):
        reports.participants(subjects.withColumn("site", F.lit("Z")), scanners).collect()
    scans = spark.createDataFrame([("s", "T1w", "M", 3.0, 5000.0, 10.0, None)], "participant_id string, modality string, manufacturer string, field_strength_t double, tr_ms double, te_ms double, ti_ms double")
    assert json.loads(reports.sidecar_documents(scans).first().document) == {"Manufacturer": "M", "MagneticFieldStrength": 3.0, "RepetitionTime": 5.0, "EchoTime": 0.01}


def test_workflow(spark, tmp_path):
    w = Workflow(spark, f"file://{tmp_path}/tables")
    w.rule("base")(lambda: spark.range(3))
    w.rule("twice", "base")(lambda b: b.withColumn("x", F.col("id") * 2))
    w.rule("sum", "twice")(lambda t: t.agg(F.sum("x").alias("s")))
    assert w.build("sum") == ["base", "twice", "sum"] and w.table("sum").first().s == 6
    assert w.build("sum") == [] and w.build("sum", force=("twice",)) == ["twice", "sum"]
    w.rule("a", "b")(lambda b: b)
    w.rule("b", "a")(lambda a: a)
    with pytest.raises(ValueError, match="one another"):
        w.build("a")
    with pytest.raises(MissingInput, match="no rule"):
        w.build("nothing")


def test_ghosting_damps_lines_of_the_spectrum():
    rng = np.random.default_rng(1)
    image = 5 + rng.uniform(0, 1, (8, 12, 3))
    for seed in range(6):
        got = S.ARTIFACTS["ghosting"](image, 0.4, seed)
        ratio = np.abs(np.fft.fftn(got) / np.fft.fftn(image))
        axis = int(np.random.default_rng(seed).integers(0, 2))
        n = image.shape[axis]
        lines = np.moveaxis(ratio, axis, 0)
        for k in range(n):
            assert np.allclose(lines[k], 0.6 if k % 4 == 0 and k else 1.0)
    # A point along the axis gets a copy at each quarter: the mean of the damped lines.
    point = np.zeros((8, 8, 1))
    point[0, 0, 0] = 1.0
    seed = next(s for s in range(20) if int(np.random.default_rng(s).integers(0, 2)) == 0)
    got = S.ARTIFACTS["ghosting"](point, 0.5, seed)[:, 0, 0]
    assert got[0] == pytest.approx(1 - 0.5 / 8) and got[4] == pytest.approx(0.5 / 8) and got[1] == pytest.approx(0.5 / 8)


def test_motion_changes_phases_only_where_nothing_turns(monkeypatch):
    rng = np.random.default_rng(2)
    image = 3 + rng.uniform(0, 1, (6, 8, 4))
    assert np.array_equal(S._turned(image, 0.0), image) and np.allclose(S._turned(image, 360.0)[1:-1, 1:-1], image[1:-1, 1:-1])
    monkeypatch.setattr(S, "_turned", lambda unit, degrees: unit)
    captured = []
    monkeypatch.setattr(np.fft, "ifftn", lambda x, real=np.fft.ifftn: captured.append(x) or real(x))
    S.ARTIFACTS["motion"](image, 2.0, 5)
    assert np.allclose(np.abs(captured[0]), np.abs(np.fft.fftn(image))) and not np.allclose(captured[0], np.fft.fftn(image))
    # Lines taken before the first movement are as they were.
    first = np.sort(np.random.default_rng(5).uniform(0, 1, 2))[0]
    _, when = S._lines(image.shape, 1)
    assert np.allclose(np.where(when < first, captured[0], 0), np.where(when < first, np.fft.fftn(image), 0))


@pytest.mark.parametrize("artifact", sorted(S.ARTIFACTS))
def test_degrading(artifact):
    rng = np.random.default_rng(3)
    image = rng.uniform(50, 100, (8, 8, 4))
    brain = np.ones(image.shape, dtype=bool)
    assert np.array_equal(S.degrade(image, brain, artifact, 0, 1), image)
    one, again, other = (S.degrade(image, brain, artifact, 0.3, seed) for seed in (1, 1, 2))
    assert np.array_equal(one, again) and (one >= 0).all() and not np.allclose(one, image) and one.shape == image.shape
    assert artifact == "bias" or not np.allclose(one, other)
