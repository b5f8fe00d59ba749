"""Documents for people and trainers: quality report, dataset folder documents, participants table."""

from __future__ import annotations

import html
import json
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.tabular import crosstab, top_n
from .files import MissingInput


def report_rows(z: DataFrame, flags: DataFrame, classes=("usable", "check", "exclude", "not_assessed")) -> tuple[DataFrame, DataFrame]:
    """The class counts by scanner, and each flagged subject's three worst metrics. z: participant_id, metric, z."""
    counts = crosstab(flags, "scanner", "qc_class", list(classes))
    bad = flags.where(F.col("qc_class").isin("check", "exclude")).select("participant_id", "scanner", "qc_class")
    return counts, bad.join(top_n(z, ["participant_id"], "z", "metric", 3), "participant_id", "left")


def build_html(counts: DataFrame, flagged: DataFrame, title: str = "Quality report") -> str:
    """One page from report_rows(): scanners and flagged subjects, small tables by nature. All text is escaped."""
    text = lambda v: html.escape(str(v))
    rows = [r.asDict() for r in counts.orderBy("scanner").collect()]
    head = "".join(f"<th>{text(c)}</th>" for c in counts.columns)
    body = "".join("<tr>" + "".join(f"<td>{text(v)}</td>" for v in r.values()) + "</tr>" for r in rows)
    subjects = "".join(
        f"<li>{text(r.participant_id)} ({text(r.scanner)}, {text(r.qc_class)}): {', '.join(f'{text(x.name)} {-x.less:.1f}' for x in r.top or [])}</li>" for r in flagged.orderBy("participant_id").collect()
    )
    return f"<!doctype html><title>{text(title)}</title><h1>{text(title)}</h1><table><tr>{head}</tr>{body}</table><ul>{subjects}</ul>"


def dataset_document(name: str, channels: dict[str, str], labels: dict[str, int], n_training: int, licence: str = "", file_ending: str = ".nii.gz") -> str:
    """A trainer's dataset.json. An ignored label must be the highest, as the trainer wants it."""
    if "ignore" in labels and labels["ignore"] != max(labels.values()):
        raise ValueError("the ignored label has to be the highest")
    return json.dumps({"name": name, "licence": licence, "channel_names": channels, "labels": labels, "numTraining": n_training, "file_ending": file_ending}, indent=2)


def folds_document(folds: DataFrame, k: int, key: str = "case_id") -> str:
    """[{train, val}] for each fold, from (case, fold): one row a case."""
    rows = sorted((r[0], r[1]) for r in folds.select(key, "fold").collect())
    return json.dumps([{"train": [c for c, f in rows if f != i], "val": [c for c, f in rows if f == i]} for i in range(k)], indent=2)


def zip_folder(folder: str, out: str) -> list[str]:
    """Stored, members in order; returns their names."""
    names = sorted(str(p.relative_to(folder)) for p in Path(folder).rglob("*") if p.is_file())
    if not names:
        raise MissingInput(f"{folder} holds no files")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for n in names:
            z.write(Path(folder) / n, n)
    return names


def participants(subjects: DataFrame, scanners: DataFrame) -> DataFrame:
    """The participants dimension: subjects (participant_id, original_id, split, site) with their scanner's columns; an unknown site raises."""
    met = subjects.join(scanners.withColumn("_known", F.lit(True)), "site", "left")
    checked = met.withColumn("scanner", F.when(F.col("_known"), F.col("scanner")).otherwise(F.raise_error(F.concat(F.lit("unknown site: "), "site")).cast("string")))
    return checked.select("participant_id", "original_id", "split", "scanner", "institute", "manufacturer", "model", "field_strength_t", "seen_in_training")


def sidecar_documents(scans: DataFrame) -> DataFrame:
    """participant_id, modality and a JSON side file: times in seconds, keys without a value left out."""
    doc = F.to_json(F.struct(F.col("manufacturer").alias("Manufacturer"), F.col("field_strength_t").alias("MagneticFieldStrength"), (F.col("tr_ms") / 1000).alias("RepetitionTime"), (F.col("te_ms") / 1000).alias("EchoTime"), (F.col("ti_ms") / 1000).alias("InversionTime")))
    return scans.select("participant_id", "modality", doc.alias("document"))
