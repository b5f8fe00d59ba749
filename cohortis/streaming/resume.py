"""Resumable batches: new files of a folder, each once, upserted by key into a versioned Parquet table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.tabular import upserted


def latest(spark: SparkSession, table: str, schema: T.StructType, upto: int | None = None) -> DataFrame:
    """The newest version that was written whole (empty before the first), no newer than `upto` if given."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(table)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    done = []
    if fs.exists(hadoop):
        for s in fs.listStatus(hadoop):
            name = s.getPath().getName()
            if name.startswith("v=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")):
                done.append(int(name[2:]))
    done = [v for v in done if upto is None or v <= upto]
    return spark.read.schema(schema).parquet(f"{table}/v={max(done)}") if done else spark.createDataFrame([], schema)


def upsert_stream(spark: SparkSession, source: str, table: str, checkpoint: str, schema: T.StructType, keys: Sequence[str]) -> None:
    """Take the files of source that no earlier run took, and upsert them as versions v=<batch>. A repeated batch starts
    from the version before it and makes its own anew beside the table, then puts it in place, so each file counts once and
    no version is read while it is replaced. The last row of a key in a batch wins, by its order of all columns."""
    path = spark._jvm.org.apache.hadoop.fs.Path

    def one(batch: DataFrame, number: int) -> None:
        columns = [c for c in schema.fieldNames() if c not in keys]
        fresh = batch.groupBy(*keys).agg(F.max(F.struct(*columns)).alias("r")).select(*keys, "r.*").select(*schema.fieldNames())
        made = upserted(latest(spark, table, schema, number), fresh, keys).select(*schema.fieldNames())
        staged, target = path(f"{table}/_staged-{number + 1}"), path(f"{table}/v={number + 1}")
        made.write.mode("overwrite").parquet(staged.toString())
        fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.delete(target, True)
        if not fs.rename(staged, target):
            raise OSError(f"{staged} could not be renamed to {target}")

    query = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
