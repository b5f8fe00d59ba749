"""Review of a study's records: which of a site's are unlike the others there, in what, and whether that agrees with a judge.

    python -m jobs.site_review --records DIR --truth DIR --output DIR [--config jobs/site_review.json]

Records of one site and modality are alike in form, so each measure is held against the median and the median deviation of its
own site and modality. Writes, partitioned by site,

    OUTPUT/flags        a row for each different record: its measures, the worst robust z, the measure it is worst in, its class
    OUTPUT/report       records and judged quality for each site, modality and class
    OUTPUT/validation   one row: do flagged records have a lower judged quality than usable ones?

Texts are read once and reduced to numbers before anything is shuffled. Medians are exact for groups of any size. A rerun
replaces all three with the same rows.
"""

from __future__ import annotations

import argparse
import json
import logging
import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortis.functions import columns as C
from cohortis.operators import cohort
from cohortis.operators import tabular as R
from cohortis.session import ship

from .measures import counted, share, site_label

log = logging.getLogger("jobs.site_review")
DEFAULTS = json.load(open(os.path.join(os.path.dirname(__file__), "site_review.json")))
GROUP = ["site_part", "modality_part"]


def measures(chars: Column, counts: Column) -> dict[str, Column]:
    """Numbers of a text, by its characters and measures.counted(); those that divide by nothing are null."""
    return {
        "chars": chars.cast("double"),
        "word_length": F.try_divide(chars - counts["space"], counts["words"]),
        **{name: share(counts[name], chars) for name in ("digits", "marks", "breaks")},
    }


def measured(records: DataFrame, columns: dict[str, str]) -> DataFrame:
    """One row for each different record of a site and modality: record, site, modality, sha256, site_part, modality_part, and
    the measures, with `rows`, the number of rows read of it. A null text counts as empty; a record without an id is told by its contents."""
    text = F.coalesce(F.col(columns["text"]), F.lit(""))
    named = records.select(F.col(columns["record"]).alias("record"), F.col(columns["site"]).alias("site"), F.col(columns["modality"]).alias("modality"), F.sha2(text, 256).alias("sha256"), F.length(text).alias("_chars"), counted(text).alias("_counts"))
    found = measures(F.col("_chars"), F.col("_counts"))
    each = named.select("record", "site", "modality", "sha256", site_label(F.col("site")).alias("site_part"), site_label(F.col("modality")).alias("modality_part"), *[c.alias(n) for n, c in found.items()])
    return each.groupBy(*each.columns).agg(F.count(F.lit(1)).alias("rows"))


def flags(each: DataFrame, settings: dict) -> DataFrame:
    """measured() rows with max_z (null where a group is too small), worst_measure and qc_class. `high`: more is worse; `low`:
    less is; `apart`: either. Rows meet the limits of their group, and everything else is found within a row."""
    ways = settings["worse_when"]
    met = each.join(R.robust_limits(each, GROUP, [*ways]), GROUP)

    def bad(m: str, way: str) -> Column:
        z = F.coalesce(F.try_divide(F.col(m) - F.col(f"med_{m}"), 1.4826 * F.col(f"mad_{m}")), F.lit(0.0))
        return F.when(F.col("n") >= settings["least_per_group"], {"high": z, "low": -z}.get(way, F.abs(z)))

    top = F.array_max(F.array(*[F.struct(bad(m, way).alias("z"), F.lit(-i).alias("p"), F.lit(m).alias("m")) for i, (m, way) in enumerate(ways.items())]))  # of equal ones the first
    found = met.withColumn("_top", top).withColumns({"max_z": F.col("_top.z"), "worst_measure": F.when(F.col("_top.z").isNotNull(), F.col("_top.m"))})
    judged = C.qc_class(F.col("max_z"), F.lit(False), F.col("max_z").isNotNull(), settings["check"], settings["exclude"])
    return found.select("site_part", "record", "site", "modality", "sha256", *[F.round(m, 6).alias(m) for m in ways], F.round("max_z", 6).alias("max_z"), "worst_measure", judged.alias("qc_class"))


def report(judged: DataFrame, truth: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Records, how many of them a judge has seen, and their mean quality, by site, modality and class."""
    told = truth.groupBy(F.col(columns["record"]).alias("record")).agg(F.avg(columns["truth"]).alias("truth"))
    met = R.lookup(judged, told, "record")
    return met.groupBy("site_part", "site", "modality", "qc_class").agg(F.count(F.lit(1)).alias("records"), F.count("truth").alias("judged"), F.round(F.avg("truth"), 6).alias("mean_quality"), F.round(F.max("max_z"), 6).alias("max_z"))


def run(spark: SparkSession, records: str, truth: str, output: str, settings: dict | None = None) -> DataFrame:
    """One run; returns OUTPUT/flags."""
    settings = {**DEFAULTS, **(settings or {})}
    columns = settings["columns"]
    ship(spark)
    judge, made = spark.read.parquet(truth), measured(spark.read.parquet(records), columns)
    # The measures are written first: texts are read once, and what follows reads numbers only.
    made.write.mode("overwrite").parquet(f"{output}/measures")
    each = spark.read.schema(made.schema).parquet(f"{output}/measures")
    log.info("%d records read from %s", each.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0], records)
    found = flags(each, settings)
    dealt = found.repartition("site_part", F.pmod(F.xxhash64("record", "sha256"), F.lit(settings["files_a_site"])))
    dealt.write.mode("overwrite").partitionBy("site_part").parquet(f"{output}/flags")
    judged = spark.read.schema(found.schema).parquet(f"{output}/flags")  # of no records no file is written that tells it
    report(judged, judge, columns).coalesce(1).write.mode("overwrite").partitionBy("site_part").parquet(f"{output}/report")
    some = judged.where("max_z is not null").select(F.col("record"), "qc_class", "max_z")
    cohort.validated(some, judge.select(F.col(columns["record"]).alias("record"), F.col(columns["truth"]).cast("double").alias("truth")), "record", "max_z", "truth").coalesce(1).write.mode("overwrite").parquet(f"{output}/validation")
    for r in judged.groupBy("qc_class").count().orderBy("qc_class").collect():
        log.info("%d records %s, in %s/flags", r["count"], r.qc_class, output)
    return judged


def main(argv: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Flag the records of each site that are unlike the others there.")
    for name in ("records", "truth", "output"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config", help="a JSON file of settings that differ from jobs/site_review.json")
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
    settings = json.load(open(args.config)) if args.config else {}
    spark = SparkSession.builder.appName("site_review").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, args.records, args.truth, args.output, settings)
        for r in spark.read.parquet(f"{args.output}/validation").collect():
            log.info("validation: %s", r.asDict())
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
