"""Reading and writing the engine's tables: CSV and TSV with declared schemas, rounding sinks, JSON documents, listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import even_round, null_if_nan, sanitize
from ..schemas import REMOTE_LISTING, struct


class MissingInput(FileNotFoundError):
    """An input that an external stage has to make first; the message says how."""


def nan_to_null(df: DataFrame) -> DataFrame:
    reals = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType | T.FloatType)]
    return df.withColumns({c: null_if_nan(F.col(c)) for c in reals}) if reals else df


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = ",") -> DataFrame:
    """With a header, a declared schema, `n/a` and NaN as null."""
    return nan_to_null(spark.read.schema(schema).option("header", True).option("sep", sep).option("nullValue", "n/a").option("nanValue", "NaN").csv(path))


def read_tsv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return read_csv(spark, path, schema, "\t")


def read_evaluations(spark: SparkSession, folder: str, schema: T.StructType | str, split: str = "test") -> DataFrame:
    """evaluation_<model>.csv of a folder without the summaries, one table, rows of the split."""
    schema = struct(schema) if isinstance(schema, str) else schema
    rows = read_csv(spark, f"{folder}/evaluation_*.csv", schema)
    kept = rows.where(~F.col("_metadata.file_name").rlike(r"_summary\.csv$"))
    return kept.where(F.col("split") == split).select(*schema.fieldNames())


def write_csv(df: DataFrame, path: str, digits: int | None = None, exact: Sequence[str] = (), sep: str = ",") -> None:
    """Round reals half to even at the sink only, but columns that begin with p_ or are named exact."""
    if digits is not None:
        reals = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType | T.FloatType) and not f.name.startswith("p_") and f.name not in exact]
        df = df.withColumns({c: even_round(F.col(c), digits) for c in reals}) if reals else df
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def significant(c, digits: int):
    """A real with so many significant digits, as text (Java's %g)."""
    return F.format_string(f"%.{digits}g", c)


def write_document(df: DataFrame, path: str) -> None:
    """One JSON object a row; null fields are left out."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def read_document(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.text(path).select(F.from_json("value", schema).alias("d")).select("d.*")


def remote_files(spark: SparkSession, path: str) -> DataFrame:
    """version, file_id, remote_path, local_path, size, sha1 from a repository's JSON listing, as it is answered or without
    its `data`. A file without a version, or a checksum that isn't SHA-1, raises."""
    raw = spark.read.schema(REMOTE_LISTING).option("multiLine", True).json(path).select(F.coalesce("data.latestVersion", "latestVersion").alias("version"))
    listed = F.when(F.col("version.files").isNull(), F.raise_error(F.lit("a listing without latestVersion")).cast(raw.schema["version"].dataType["files"].dataType)).otherwise(F.col("version.files"))
    f = raw.select("version.versionNumber", "version.versionMinorNumber", F.explode(listed).alias("f"))
    d = F.col("f.dataFile")
    remote = F.concat_ws("/", F.when(F.col("f.directoryLabel") != "", F.col("f.directoryLabel")), d["filename"])
    sha = F.when(d["checksum"]["type"] == "SHA-1", d["checksum"]["value"]).otherwise(F.raise_error(F.concat(F.lit("not a SHA-1 checksum: "), remote)).cast("string"))
    return f.select(F.format_string("%d.%d", "versionNumber", "versionMinorNumber").alias("version"), d["id"].cast("string").alias("file_id"), remote.alias("remote_path"), sanitize(remote).alias("local_path"), d["filesize"].alias("size"), sha.alias("sha1"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """path, size and SHA-1 of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), F.sha1("content").alias("sha1"))


def selected_files(files: DataFrame, keep: Sequence[str], observers: Sequence[str], extra: Sequence[str], splits: Sequence[str]) -> DataFrame:
    """Files of subjects (split and rest allowed), results of allowed observers, and those named; sorted by path.

    A subject's file is <split>/<site ...>/<number>/<rest>, the number being the last folder that is one. An observer's is
    additional_annotations/observer_o<digit>/<split>/<site ...>/<number>/result.nii.gz.
    """
    parts = F.split("remote_path", "/")
    n, part = F.size(parts), lambda i: F.try_element_at(parts, F.lit(i))
    numbers = F.filter(F.sequence(F.lit(1), n), lambda i: (i >= 3) & (i < n) & F.element_at(parts, i).rlike("^[0-9]+$"))
    at = F.array_max(numbers)
    rest = F.array_join(F.slice(parts, at + 1, n), "/")
    subject = part(1).isin(*splits) & at.isNotNull() & rest.isin(*keep)
    observer = (part(1) == "additional_annotations") & part(2).rlike("^observer_o[0-9]$") & part(2).isin(*observers) & part(3).isin(*splits) & (n >= 6) & part(-2).rlike("^[0-9]+$") & (part(-1) == "result.nii.gz")
    chosen = F.coalesce(subject, F.lit(False)) | F.coalesce(observer, F.lit(False)) | F.col("remote_path").isin(*extra)
    return files.where(chosen).orderBy("remote_path")
