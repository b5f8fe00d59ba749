"""Declared schemas (DDL) and fixed vocabularies of the engine's tables. struct() makes a StructType once a session is there."""

from __future__ import annotations

from pyspark.sql import types as T


def struct(ddl: str, comments: dict[str, str] | None = None) -> T.StructType:
    """A schema from DDL, with column descriptions as field metadata."""
    made = T.StructType.fromDDL(ddl)
    for f in made.fields:
        if comments and f.name in comments:
            f.metadata = {"comment": comments[f.name]}
    return made


MANIFEST = "remote_path string, local_path string, file_id string, size long, sha1 string, status string, dataset_version string, checked_at string"
PARTICIPANTS = "participant_id string, original_id int, split string, scanner string, institute string, manufacturer string, model string, field_strength_t double, seen_in_training boolean"
#: Column descriptions of PARTICIPANTS.
PARTICIPANT_COMMENTS = {"participant_id": "identifier, sub-NNN", "split": "training or test", "scanner": "scanner label", "seen_in_training": "whether the scanner has training scans", "field_strength_t": "field strength in tesla"}
EVALUATION = "participant_id string, scanner string, split string, seen_in_training boolean, model string, dice double, hd95_mm double, avd_pct double, lesion_recall double, lesion_f1 double, true_ml double, pred_ml double"
BIOMARKERS = "participant_id string, scanner string, split string, source string, wmh_ml double, wmh_periventricular_ml double, wmh_deep_ml double, n_lesions_ge10mm3 long"
IQM = "participant_id string, scanner string, modality string, snr_wm double, snrd_wm double, cnr double, cjv double, efc double, fber double, inu_range double, fwhm double"
VOLUMES = "subject string, modality string, space string, shape array<int>, spacing array<double>, affine array<double>, data array<float>"
_VERSION = "struct<versionNumber: int, versionMinorNumber: int, files: array<struct<directoryLabel: string, dataFile: struct<id: long, filename: string, filesize: long, checksum: struct<type: string, value: string>>>>>"
#: A listing as the interface answers it, with the version inside `data`, or as some tools store it, without.
REMOTE_LISTING = f"data struct<latestVersion: {_VERSION}>, latestVersion {_VERSION}"

#: Metric -> whether a higher value is better.
METRICS = {"dice": True, "hd95_mm": False, "avd_pct": False, "lesion_recall": True, "lesion_f1": True}
#: Image-quality measure -> sign that makes a larger value worse.
BADNESS = {"snr_wm": -1, "snrd_wm": -1, "cnr": -1, "cjv": 1, "efc": 1, "fber": -1, "inu_range": 1, "fwhm": 1}
#: Percentiles that histogram landmarks are taken at.
LANDMARKS = (1, 10, 20, 30, 40, 50, 60, 70, 80, 90, 99)
