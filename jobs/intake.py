"""Intake of deliveries: takes each new file of records once, keeps a ledger of what arrived, and the present state of each site.

    python -m jobs.intake --input DIR --output DIR --checkpoint DIR [--config jobs/intake.json]

A study's sites deliver files of records, now and then a record again with other contents. Reading the contents is what costs,
so it is done once a file: a file stream with a checkpoint measures and fingerprints what is new, and appends it to

    OUTPUT/ledger     a row for each delivered record, partitioned by site; Spark's file sink commits each batch once

and from the ledger, which has no contents, the sites that got anything are made anew:

    OUTPUT/current    a row for each record of a site: its last delivery, how many there were, and how many differ
    OUTPUT/sites      a row for each site and modality: records, redelivered, changed, copies, bytes

A run that was broken off anywhere is made good by the next: the stream goes on from its checkpoint, and a site is made anew when
its ledger has more rows than its present state counts. A run that finds nothing new changes nothing.
"""

from __future__ import annotations

import argparse
import json
import logging
import os
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortis.operators import tabular as R
from cohortis.session import ship

from .measures import counted, site_label

log = logging.getLogger("jobs.intake")
DEFAULTS = json.load(open(os.path.join(os.path.dirname(__file__), "intake.json")))


def ledger_rows(delivered: DataFrame, columns: dict[str, str]) -> DataFrame:
    """What is kept of each delivered record: identity, place, fingerprint and measures. A record without an id is told by its
    contents; a null text counts as empty."""
    text = F.coalesce(F.col(columns["text"]), F.lit(""))
    raw = F.encode(text, "UTF-8")
    record = F.col(columns["record"])
    made = delivered.select(
        record.alias("record"), F.col(columns["site"]).alias("site"), F.col(columns["modality"]).alias("modality"), F.octet_length(raw).cast("long").alias("bytes"),
        counted(text)["words"].alias("words"), F.sha2(raw, 256).alias("sha256"), F.col("_metadata.file_modification_time").alias("delivered_at"), F.col("_metadata.file_name").alias("file"),
    )
    return made.withColumns({"identity": F.coalesce(F.col("record").cast("string"), F.concat(F.lit("text:"), "sha256")), "site_part": site_label(F.col("site"))})


def take(spark: SparkSession, source: str, ledger: str, checkpoint: str, settings: dict) -> None:
    """Append what no earlier run took to the ledger. Rows of a site are dealt to a few files, so a large site is no single task's."""
    now = spark.read.parquet(source)
    reader = spark.readStream.schema(now.schema).option("maxFilesPerTrigger", settings["files_a_batch"])
    folder, _, name = source.rstrip("/").rpartition("/")
    if [f.rpartition("/")[2] for f in now.inputFiles()] == [name]:  # a file stream reads folders: of this one, the one file
        reader, source = reader.option("pathGlobFilter", name), folder
    stream = reader.parquet(source)
    rows = ledger_rows(stream, settings["columns"])
    dealt = rows.repartition("site_part", F.pmod(F.xxhash64("identity"), F.lit(settings["files_a_site"])))
    query = dealt.writeStream.format("parquet").partitionBy("site_part").option("path", ledger).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    for p in query.recentProgress:
        if p.numInputRows:
            log.info("batch %d: %d records read from %s and added to %s", p.batchId, p.numInputRows, source, ledger)


def states(ledger: DataFrame) -> DataFrame:
    """A row for each record of a site: its last delivery (by time, then file, then fingerprint), the number of deliveries, of
    different contents, and of records of the site with the same contents."""
    last = F.max(F.struct("delivered_at", "file", "sha256", "record", "site", "modality", "bytes", "words")).alias("last")
    each = ledger.groupBy("site_part", "identity").agg(last, F.count(F.lit(1)).alias("deliveries"), F.count_distinct("sha256").alias("contents"))
    each = each.select("site_part", "identity", "last.*", "deliveries", "contents")
    same = each.groupBy("site_part", "sha256").agg(F.count(F.lit(1)).alias("copies"))
    return each.join(same, ["site_part", "sha256"])


def behind(ledger: DataFrame, current: DataFrame | None) -> DataFrame:
    """The sites whose ledger has more rows than the present state counts. Both sides are counted from narrow columns."""
    arrived = ledger.groupBy("site_part").agg(F.count(F.lit(1)).alias("arrived"))
    if current is None:
        return arrived.select("site_part")
    counted = current.groupBy("site_part").agg(F.sum("deliveries").alias("counted"))
    return arrived.join(counted, "site_part", "left").where("counted is null or counted <> arrived").select("site_part")


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.option("basePath", path).parquet(path)
    except AnalysisException:  # nothing was written yet
        return None


def refresh(spark: SparkSession, output: str) -> list[str]:
    """Make the present state and the summary of the sites that are behind anew. Returns their labels."""
    ledger = _stored(spark, f"{output}/ledger")
    if ledger is None:
        return []
    sites = sorted(r.site_part for r in behind(ledger, _stored(spark, f"{output}/current")).collect())  # a study's sites are few
    if not sites:
        return []
    made = states(ledger.where(F.col("site_part").isin(sites)))
    put = lambda df, name: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("site_part").parquet(f"{output}/{name}")
    # The summary first: a site counts as done by its present state, which is the last to be put in place.
    summary = made.groupBy("site_part", "site", "modality").agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.col("deliveries") > 1).alias("redelivered"), F.count_if(F.col("contents") > 1).alias("changed"),
        F.count_if(F.col("copies") > 1).alias("with_copies"), F.sum("bytes").alias("bytes"), F.sum("words").alias("words"),
    )
    put(summary.coalesce(1), "sites")
    put(made, "current")
    return sites


def run(spark: SparkSession, source: str, output: str, checkpoint: str, settings: dict | None = None) -> DataFrame:
    """One run; returns OUTPUT/current. source: a folder (or one file) of Parquet, to which files are added."""
    settings = {**DEFAULTS, **(settings or {})}
    ship(spark)
    take(spark, source, f"{output}/ledger", checkpoint, settings)
    sites = refresh(spark, output)
    current = _stored(spark, f"{output}/current")
    if current is None:  # no record was ever delivered
        kinds = dict(spark.read.parquet(source).dtypes)
        told = ", ".join(f"{n} {kinds[settings['columns'][n]]}" for n in ("record", "site", "modality"))
        current = spark.createDataFrame([], f"sha256 string, identity string, delivered_at timestamp, file string, {told}, bytes long, words long, deliveries long, contents long, copies long, site_part string")
    log.info("%d sites made anew in %s: %s", len(sites), output, ", ".join(sites) or "none is behind")
    return current


def missing(current: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected records that no delivery has brought yet."""
    return R.todo(expected, current, keys)


def main(argv: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Take new deliveries into the ledger and bring the sites' state up to date.")
    for name in ("input", "output", "checkpoint"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config", help="a JSON file of settings that differ from jobs/intake.json")
    parser.add_argument("--expected", help="a Parquet table of the records that are due; what is missing is written to OUTPUT/missing")
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
    settings = json.load(open(args.config)) if args.config else {}
    spark = SparkSession.builder.appName("intake").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        current = run(spark, args.input, args.output, args.checkpoint, settings)
        log.info("%d records in %s/current", current.count(), args.output)
        if args.expected:
            due = spark.read.parquet(args.expected)
            record = {**DEFAULTS, **settings}["columns"]["record"]
            missing(current.withColumnRenamed("record", record), due, [record]).write.mode("overwrite").parquet(f"{args.output}/missing")
            log.info("%d records are missing, see %s/missing", spark.read.parquet(f"{args.output}/missing").count(), args.output)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
