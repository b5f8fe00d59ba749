"""Studies built from the operators: work lists of comparisons, degraded copies against a clean cohort, mask and field
checks, tissue masks, training logs, and the contracts of stages that run outside the engine."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions.columns import named
from ..sources.files import MissingInput
from .tabular import first_n, robust_z
from .voxel import kernel

# -- comparisons -----------------------------------------------------------------------------------------------------


def comparison_tasks(subjects: DataFrame, pairs: Sequence[tuple[str, str, bool]], held_out: DataFrame, key: str = "participant_id") -> DataFrame:
    """key, rater, reference, shared: every pair for every subject; a pair marked held-out only where the subject is. shared
    says whether the subject is held out."""
    table = subjects.sparkSession.createDataFrame([*pairs], "rater string, reference string, held_out_only boolean")
    marked = subjects.select(key).join(held_out.select(key).distinct().withColumn("_held", F.lit(True)), key, "left").withColumn("shared", F.coalesce("_held", F.lit(False)))
    # Pairs are a stated list, so this product is as long as the subjects, times a few.
    return marked.crossJoin(F.broadcast(table)).where(F.col("shared") | ~F.col("held_out_only")).select(key, "rater", "reference", "shared")


def sources_by_split(subjects: DataFrame, sources: dict[str, Sequence[str]], default: Sequence[str] = (), key: str = "participant_id", split: str = "split") -> DataFrame:
    """key, split, source: each split's own list of sources, else the default's."""
    lists = F.array(*map(F.lit, default)) if default else F.array().cast("array<string>")
    for name, values in sources.items():
        lists = F.when(F.col(split) == name, F.array(*map(F.lit, values))).otherwise(lists)
    return subjects.select(key, split, F.explode(lists).alias("source"))


# -- degraded copies -------------------------------------------------------------------------------------------------


def chosen_subjects(flags: DataFrame, splits: DataFrame, n: int, key: str = "participant_id") -> DataFrame:
    """The first n usable test subjects of each scanner, by id."""
    usable = flags.where("qc_class = 'usable'").join(splits.where("split = 'test'").select(key), key, "left_semi")
    return first_n(usable, ["scanner"], [key], n).select(key, "scanner")


def degradations(subjects: DataFrame, levels: dict[str, Sequence[float]]) -> DataFrame:
    """Every subject with every artefact at every level, and once undegraded (`none`, 0)."""
    cases = [("none", 0.0), *((a, float(v)) for a, values in levels.items() for v in values)]
    return subjects.crossJoin(F.broadcast(subjects.sparkSession.createDataFrame(cases, "artifact string, level double")))


def robustness_cases(subjects: DataFrame, levels: dict[str, Sequence[float]], key: str = "participant_id") -> DataFrame:
    """key, artifact, level_index, level, case: what a model is run on. A list of levels begins with the undegraded one, which is the
    one case `none` for all artefacts, and needs no image of its own (case is null)."""
    listed = [("none", 0, 0.0), *((a, i, float(v)) for a, values in levels.items() for i, v in enumerate(values) if i)]
    # The levels are a stated list, so this product is as long as the subjects, times a few.
    met = subjects.select(key).crossJoin(F.broadcast(subjects.sparkSession.createDataFrame(listed, "artifact string, level_index int, level double")))
    case = F.when(F.col("level_index") > 0, named("{id}_{artifact}{index}", id=F.col(key), artifact=F.col("artifact"), index=F.col("level_index")))
    return met.withColumn("case", case)


def detected_by_class(cases: DataFrame, classes: Sequence[str] = ("check", "exclude")) -> DataFrame:
    """artifact, level, n, n_detected, rate: degraded cases that the outlier classes find, the forest's included. cases: artifact, level,
    qc_class; a case that wasn't classified counts as not found."""
    found = F.coalesce(F.col("qc_class").isin(*classes), F.lit(False)).cast("int")
    return cases.groupBy("artifact", "level").agg(F.count(F.lit(1)).alias("n"), F.sum(found).alias("n_detected"), F.avg(found).alias("rate"))


def _noise(unit: np.ndarray, level: float, seed: int) -> np.ndarray:
    """Gaussian noise; level: its deviation."""
    return unit + np.random.default_rng(seed).normal(0, level, unit.shape)


def _bias(unit: np.ndarray, level: float, seed: int) -> np.ndarray:
    """A smooth factor: the exponential of all monomials up to the third order in -1 to 1, each with the coefficient level."""
    axes = [np.linspace(-1, 1, n) if n > 1 else np.zeros(1) for n in unit.shape]
    powers = [np.stack([axis**p for p in range(4)]) for axis in axes]
    wanted = np.add.outer(np.add.outer(np.arange(4), np.arange(4)), np.arange(4)) <= 3
    return unit * np.exp(level * np.einsum("ijk,ix,jy,kz->xyz", wanted.astype(float), *powers))


#: Every so many phase lines are damped by ghosting; so many movements are made in a scan.
GHOSTS, MOVEMENTS = 4, 2


def _lines(shape: tuple[int, ...], axis: int) -> tuple[np.ndarray, ...]:
    """Of each phase line along an axis its frequency (whole cycles), shaped to be held against a spectrum, and when it is taken: from 0 to 1,
    lowest frequency first."""
    n = shape[axis]
    k = np.fft.fftfreq(n, 1 / n)
    when = (k - k.min()) / max(n - 1, 1)
    return tuple(np.expand_dims(x, tuple(a for a in range(len(shape)) if a != axis)) for x in (k, when))


def _ghosting(unit: np.ndarray, level: float, seed: int) -> np.ndarray:
    """Every GHOSTS-th phase line along one of the first two axes (by the seed) is damped by the share level, the middle one not: copies
    of the image appear at a GHOSTS-th of its width."""
    axis = int(np.random.default_rng(seed).integers(0, 2))
    k, _ = _lines(unit.shape, axis)
    return np.abs(np.fft.ifftn(np.fft.fftn(unit) * np.where((k % GHOSTS == 0) & (k != 0), 1 - level, 1.0)))


def _turned(unit: np.ndarray, degrees: float) -> np.ndarray:
    """Turned about the third axis' middle, linearly between voxels, 0 from outside."""
    c, s = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    nx, ny = unit.shape[:2]
    x, y = np.meshgrid(np.arange(nx) - (nx - 1) / 2, np.arange(ny) - (ny - 1) / 2, indexing="ij")
    px, py = c * x + s * y + (nx - 1) / 2, -s * x + c * y + (ny - 1) / 2
    out = np.zeros_like(unit, dtype=float)
    for i in (0, 1):
        for j in (0, 1):
            a, b = np.floor(px).astype(int) + i, np.floor(py).astype(int) + j
            weight = np.maximum(0, 1 - np.abs(px - a)) * np.maximum(0, 1 - np.abs(py - b))
            ok = (a >= 0) & (a < nx) & (b >= 0) & (b < ny)
            out += np.where(ok, weight, 0.0)[..., None] * unit[np.clip(a, 0, nx - 1), np.clip(b, 0, ny - 1)]
    return out


def _motion(unit: np.ndarray, level: float, seed: int) -> np.ndarray:
    """MOVEMENTS at random times of the scan, each a turn of up to level degrees about the third axis and a shift of up to level voxels along
    each axis. Lines along the second axis that are taken after one are those of the moved image; a shift is a change of phase."""
    rng = np.random.default_rng(seed)
    axis = min(1, unit.ndim - 1)
    _, when = _lines(unit.shape, axis)
    spectrum = np.fft.fftn(unit)
    for begin in np.sort(rng.uniform(0, 1, MOVEMENTS)):
        turn, shift = rng.uniform(-level, level), rng.uniform(-level, level, unit.ndim)
        phase = sum(_lines(unit.shape, a)[0] * shift[a] / unit.shape[a] for a in range(unit.ndim))
        spectrum = np.where(when >= begin, np.fft.fftn(_turned(unit, turn)) * np.exp(-2j * np.pi * phase), spectrum)
    return np.abs(np.fft.ifftn(spectrum))


#: What each artefact does to an image in units of the brain's median.
ARTIFACTS: dict[str, Callable[[np.ndarray, float, int], np.ndarray]] = {"noise": _noise, "bias": _bias, "motion": _motion, "ghosting": _ghosting}


def degrade(image: np.ndarray, brain: np.ndarray, artifact: str, level: float, seed: int) -> np.ndarray:
    """An image with one of ARTIFACTS; level 0: as it is. Never negative; the same seed gives the same image. Other artefacts are an external stage's."""
    if level and artifact not in ARTIFACTS:
        raise MissingInput(f"{artifact}: images degraded this way come from an imaging tool; give them as a table")
    unit = float(np.median(image[brain])) if level else 1.0
    return np.maximum(ARTIFACTS[artifact](image / unit, level, seed), 0) * unit if level else image.copy()


def detection_rates(degraded: DataFrame, clean: DataFrame, limit: float = 3.0, group: Sequence[str] = ("scanner", "metric")) -> DataFrame:
    """artifact, level, n, rate: the share of degraded cases whose worst z against the clean cohort of their scanner passes the
    limit. degraded: participant_id, scanner, artifact, level, metric, value (larger is worse); clean: scanner, metric, value."""
    med = clean.groupBy(*group).agg(F.median("value").alias("med"))
    mad = clean.join(med, [*group]).groupBy(*group).agg(F.median(F.abs(F.col("value") - F.col("med"))).alias("mad"))
    z = F.coalesce(F.try_divide(F.col("value") - F.col("med"), 1.4826 * F.col("mad")), F.lit(0.0))
    worst = degraded.join(med, [*group], "left").join(mad, [*group], "left").groupBy("participant_id", "artifact", "level").agg(F.max(z).alias("z"))
    return worst.groupBy("artifact", "level").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("z") >= limit).cast("int")).alias("rate"))


def robustness(scores: DataFrame, value: str = "dice", key: str = "participant_id") -> DataFrame:
    """artifact, level, mean and mean drop from the subject's own undegraded value (the least of several)."""
    base = F.min(F.when(F.col("artifact") == "none", F.col(value)))
    each = scores.join(scores.groupBy(key).agg(base.alias("_base")), key)
    return each.groupBy("artifact", "level").agg(F.avg(value).alias("mean"), F.avg(F.col(value) - F.col("_base")).alias("drop"))


def cohort_badness(long: DataFrame, signs: dict[str, int], least: int, group: Sequence[str] = ("scanner", "modality", "metric")) -> DataFrame:
    """long (group, value) with z turned so that larger is worse: robust z within scanner, modality and metric."""
    sign = F.create_map(*[x for k, v in signs.items() for x in (F.lit(k), F.lit(float(v)))])
    return robust_z(long, group, "value", least).withColumn("z", F.try_element_at(sign, F.col("metric")) * F.col("z"))


# -- masks, fields, tissues ------------------------------------------------------------------------------------------


def mask_checks(volumes: DataFrame, keys: Sequence[str], mask: str, head: str, shape, voxel_mm3: float) -> DataFrame:
    """Volume in ml, number of 6-connected components, the largest one's share, and the share inside the head."""

    def measure(m: np.ndarray, h: np.ndarray) -> list[dict]:
        m, h = m > 0.5, h > 0.5
        _, sizes = np.unique(K.components(m, 6)[m], return_counts=True)
        total = int(m.sum())
        return [{"ml": total * voxel_mm3 / 1000, "n_components": len(sizes), "largest_share": float(sizes.max() / total) if total else 0.0, "inside_head": float((m & h).sum() / max(total, 1))}]

    return kernel(volumes, keys, [mask, head], shape, measure, "ml double, n_components long, largest_share double, inside_head double")


def field_checks(long: DataFrame, keys: Sequence[str], mask: Column, value: str = "v") -> DataFrame:
    """Share of the volume in the mask, and the field's 5th and 95th percentiles inside it relative to its median."""
    q = long.groupBy(*keys).agg(F.avg(mask.cast("double")).alias("mask_fraction"), F.percentile(F.when(mask, F.col(value)), [0.05, 0.5, 0.95]).alias("q"))
    g = lambda i: F.get("q", F.lit(i))
    return q.select(*keys, "mask_fraction", F.try_divide(g(0), g(1)).alias("field_p5"), F.try_divide(g(2), g(1)).alias("field_p95"))


def tissue_masks(labels: np.ndarray, brain: np.ndarray, white: Sequence[int], grey: Sequence[int], lesion: int, spacing=(1.0, 1.0, 1.0), margin_mm: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """White matter, eroded (18 neighbours) and without lesions and a margin about them, and grey matter as it is."""
    wm = K.erode(np.isin(labels, white), 18) & brain
    wmh = labels == lesion
    if margin_mm > 0 and wmh.any():
        wm &= K.distance(wmh, spacing) > margin_mm
    return wm, np.isin(labels, grey) & brain


def sampled_points(long: DataFrame, keys: Sequence[str], mask: Column, n: int, affine: Sequence[float], seed: int = 42) -> DataFrame:
    """n voxels of each mask, by a seeded hash, in mm (affine: three rows of four)."""
    some = first_n(long.where(mask).withColumn("_h", F.xxhash64(F.lit(seed), "x", "y", "z")), keys, ["_h", "x", "y", "z"], n)
    mm = lambda r: affine[4 * r] * F.col("x") + affine[4 * r + 1] * F.col("y") + affine[4 * r + 2] * F.col("z") + affine[4 * r + 3]
    return some.select(*keys, *[mm(r).alias(f"{a}_mm") for r, a in enumerate("xyz")])


# -- training logs ---------------------------------------------------------------------------------------------------

# The words that a training log puts before a metric's number.
LOG_WORDS = {"lr": "Current learning rate:", "train_loss": "train_loss", "val_loss": "val_loss", "pseudo_dice": "Pseudo dice", "epoch_s": "Epoch time:"}
#: A number may stand in a list, and there in a constructor of its type; the first one counts.
LOG_PATTERNS = {k: rf"\b{words}\s+\[?(?:[A-Za-z_][\w.]*\()?([+-]?[0-9]*\.?[0-9]+(?:[eE][+-]?[0-9]+)?)" for k, words in LOG_WORDS.items()}
#: A line that begins a record ends with the word and the epoch's number, after its time stamp.
LOG_HEADER = r":\s+Epoch ([0-9]+)\s*$"


def training_metrics(lines: DataFrame) -> DataFrame:
    """epoch and a column for each of LOG_PATTERNS, from (file, line number n, text). A header line begins a record; lines
    before the first belong to none; of an epoch logged twice the last record counts (by file, then line)."""
    head = F.regexp_extract("text", LOG_HEADER, 1)
    started = F.last(F.when(head != "", F.struct(F.col("n").alias("start"), head.cast("int").alias("epoch"))), ignorenulls=True).over(Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    found = {k: F.regexp_extract("text", p, 1) for k, p in LOG_PATTERNS.items()}
    rows = lines.select("file", "n", started.alias("r"), *[F.when(v != "", v).cast("double").alias(k) for k, v in found.items()]).where("r is not null")
    last = [F.max_by(k, F.when(F.col(k).isNotNull(), F.col("n"))).alias(k) for k in LOG_PATTERNS]
    records = rows.groupBy("file", "r.start", "r.epoch").agg(*last)
    return records.groupBy("epoch").agg(F.max_by(F.struct(*LOG_PATTERNS), F.struct("file", "start")).alias("m")).select("epoch", "m.*")


# -- stages outside ---------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Stage:
    """A stage that an imaging tool runs: what it needs, the table it leaves, and how to make it."""

    name: str
    needs: tuple[str, ...]
    leaves: str
    how: str


STAGES = {
    s.name: s
    for s in (
        Stage("bias_correction", ("volumes", "masks"), "subject string, modality string, data array<float>, field array<float>", "run N4 on every volume and load the results with sources.nifti"),
        Stage("registration", ("volumes",), "subject string, transform array<double>, correlation double", "register T1 to FLAIR rigidly and load the transforms"),
        Stage("template_warp", ("volumes",), "subject string, correlation double, seconds double", "warp to the template and load the figures"),
        Stage("brain_mask", ("volumes",), "subject string, mask array<float>", "extract brains and load the masks"),
        Stage("segmentation", ("volumes",), "subject string, model string, mask array<float>", "run the model and load its masks"),
        Stage("tissue_labels", ("volumes",), "subject string, labels array<float>", "label tissues and load the label maps"),
    )
}


def outcome(stage: str, found: DataFrame | None, wanted: DataFrame, key: str = "subject") -> DataFrame:
    """wanted with the stage's columns and status (`done` or `missing`). Without any table: MissingInput, which says how to make it."""
    s = STAGES[stage]
    if found is None:
        raise MissingInput(f"{stage} needs {', '.join(s.needs)} and leaves ({s.leaves}): {s.how}")
    lacking = {c.split()[0] for c in s.leaves.split(", ")} - set(found.columns)
    if lacking:
        raise MissingInput(f"{stage} lacks {', '.join(sorted(lacking))}: {s.how}")
    met = wanted.select(key).join(found.withColumn("_found", F.lit(True)), key, "left")
    return met.withColumn("status", F.when(F.col("_found"), "done").otherwise("missing")).drop("_found")


def accepted(found: DataFrame) -> DataFrame:
    """outcome() whole: raises while it is run where a row is not `done`, so a batch that an external tool left half done isn't used."""
    left = F.raise_error(F.format_string("not done: %s", F.to_json(F.struct("*"))))
    return found.withColumn("status", F.when(F.col("status") == "done", F.col("status")).otherwise(left.cast("string")))


def captured(measure: Callable[..., list[dict]]) -> Callable[..., list[dict]]:
    """measure, with a row that says `failed: ...` instead of an exception: one bad volume doesn't stop a cohort."""

    def safe(*arrays: np.ndarray) -> list[dict]:
        try:
            return [r | {"status": "ok"} for r in measure(*arrays)]
        except Exception as e:  # noqa: BLE001  whatever it was becomes data
            return [{"status": f"failed: {e}"}]

    return safe
