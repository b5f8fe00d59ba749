"""The jobs as registered queries: each runs twice into one new folder, and what it then holds is the result."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortis.session import shared_dir

from . import intake, site_review


def _new(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/jobs/{name}-{uuid.uuid4().hex}"


def job1_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The intake of `documents`: the present state of every record."""
    place = _new(spark, "intake")
    for _ in range(2):
        current = intake.run(spark, f"{sf_dir}/documents.parquet", f"{place}/out", f"{place}/checkpoint")
    return current.select("record", "site", "modality", "bytes", "words", "sha256", "deliveries", "contents", "copies")


def job2_site_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The review of `documents` against `labels`: every record's flags."""
    place = _new(spark, "site-review")
    for _ in range(2):
        flags = site_review.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", place)
    return flags.select("record", "site", "modality", "sha256", *site_review.DEFAULTS["worse_when"], "max_z", "worst_measure", "qc_class")


JOB1_SQL = r"""
WITH l AS (
  SELECT doc_id AS record, source AS site, lang AS modality, CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS words, sha256(coalesce(text, '')) AS sha256 FROM documents),
e AS (
  SELECT site AS site_part, coalesce(CAST(record AS VARCHAR), 'text:' || sha256) AS identity, max({'sha256': sha256, 'record': record, 'modality': modality, 'bytes': bytes, 'words': words}) AS r,
    count(*) AS deliveries, count(DISTINCT sha256) AS contents FROM l GROUP BY 1, 2)
SELECT r.record AS record, site_part AS site, r.modality AS modality, r.bytes AS bytes, r.words AS words, r.sha256 AS sha256, deliveries, contents,
  count(*) OVER (PARTITION BY site_part, r.sha256) AS copies
FROM e
"""

_MEASURES = {
    "chars": "CAST(length(text) AS DOUBLE)",
    "word_length": r"CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS DOUBLE) / nullif(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)",
    "digits": r"1 - length(regexp_replace(text, '[0-9]+', '', 'g')) / nullif(CAST(length(text) AS DOUBLE), 0)",
    "marks": r"1 - length(regexp_replace(text, '[!-/:-@\[-`{-~]+', '', 'g')) / nullif(CAST(length(text) AS DOUBLE), 0)",
    "breaks": r"1 - length(regexp_replace(text, '\n+', '', 'g')) / nullif(CAST(length(text) AS DOUBLE), 0)",
}
_LONG = " UNION ALL ".join(f"SELECT k, site, modality, {i} AS position, '{m}' AS measure, {m} AS value FROM m" for i, m in enumerate(_MEASURES))
JOB2_SQL = f"""
WITH d AS (SELECT DISTINCT doc_id AS record, source AS site, lang AS modality, coalesce(text, '') AS text FROM documents),
m AS (SELECT row_number() OVER () AS k, record, site, modality, sha256(text) AS sha256, {", ".join(f"{sql} AS {name}" for name, sql in _MEASURES.items())} FROM d),
l AS ({_LONG}),
c AS (SELECT site, modality, measure, count(*) AS n, median(value) AS med FROM l GROUP BY 1, 2, 3),
o AS (SELECT l.*, n, med FROM l JOIN c ON l.measure = c.measure AND l.site IS NOT DISTINCT FROM c.site AND l.modality IS NOT DISTINCT FROM c.modality),
s AS (SELECT site, modality, measure, median(abs(value - med)) AS mad FROM o GROUP BY 1, 2, 3),
z AS (
  SELECT k, position, o.measure, CASE WHEN n >= 8 THEN coalesce((value - med) / nullif(1.4826 * mad, 0), 0.0) END AS z
  FROM o JOIN s ON o.measure = s.measure AND o.site IS NOT DISTINCT FROM s.site AND o.modality IS NOT DISTINCT FROM s.modality),
t AS (
  SELECT k, max(bad) AS max_z, arg_max(measure, (bad, -position)) AS worst
  FROM (SELECT k, position, measure, CASE WHEN measure IN ('chars', 'word_length') THEN abs(z) ELSE z END AS bad FROM z) WHERE bad IS NOT NULL GROUP BY 1)
SELECT record, site, modality, sha256, {", ".join(f"round({m}, 6) AS {m}" for m in _MEASURES)}, round(max_z, 6) AS max_z, worst AS worst_measure,
  CASE WHEN max_z IS NULL THEN 'not_assessed' WHEN max_z >= 5 THEN 'exclude' WHEN max_z >= 3 THEN 'check' ELSE 'usable' END AS qc_class
FROM m LEFT JOIN t USING (k)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_intake": job1_intake, "job2_site_review": job2_site_review}
ORACLES: dict[str, str] = {"job1_intake": JOB1_SQL, "job2_site_review": JOB2_SQL}
