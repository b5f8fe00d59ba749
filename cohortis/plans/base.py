"""How queries are registered: one output specification shapes the DataFrame and the SQL alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, spec: str, sql: str | None = None):
    """Register a function of (spark, sf_dir). spec: output columns, each `name`, `name:l` (bigint) or `name:d` (double, 6 places)."""
    columns = [(c.split(":") + [""])[:2] for c in spec.split()]

    def register(make: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            df = make(spark, sf_dir)
            kinds = {"l": lambda c: F.col(c).cast("long"), "d": lambda c: F.round(F.col(c).cast("double"), 6), "": F.col}
            return df.select(*[kinds[k](c).alias(c) for c, k in columns])

        run.__name__, run.__doc__ = make.__name__, make.__doc__
        QUERIES[name] = run
        if sql is not None:
            shaped = ", ".join({"l": f'CAST("{c}" AS BIGINT) AS "{c}"', "d": f'round(CAST("{c}" AS DOUBLE), 6) AS "{c}"', "": f'"{c}"'}[k] for c, k in columns)
            ORACLES[name] = f"SELECT {shaped} FROM (\n{sql.strip()}\n) AS result"
        return make

    return register


# -- stand-ins for the cohort's tables on the driver's data ------------------------------------------------------------

METRICS = {"m_avg": True, "m_max": True, "m_min": False, "m_sum": True, "m_n": False}


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """participant (customer), scanner (region), seen."""
    dim = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf_dir, "customer").join(dim, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("participant"), F.col("r_name").alias("scanner"), (F.col("r_regionkey") < 3).alias("seen"), "c_acctbal", "c_mktsegment")


def evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """participant, model (order status), five metrics, scanner, seen. Orders are aggregated before they meet a dimension."""
    p = F.col("o_totalprice")
    fact = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("participant"), F.col("o_orderstatus").alias("model")).agg(F.avg(p).alias("m_avg"), F.max(p).alias("m_max"), F.min(p).alias("m_min"), F.sum(p).alias("m_sum"), F.count(F.lit(1)).cast("double").alias("m_n"))
    return fact.join(sites(spark, sf_dir).select("participant", "scanner", "seen"), "participant")


SITES_SQL = """sites AS (
  SELECT c_custkey AS participant, r_name AS scanner, r_regionkey < 3 AS seen, c_acctbal, c_mktsegment
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
EV_SQL = f"""{SITES_SQL},
ev AS (
  SELECT o.*, s.scanner, s.seen FROM (
    SELECT o_custkey AS participant, o_orderstatus AS model, avg(o_totalprice) AS m_avg, max(o_totalprice) AS m_max,
      min(o_totalprice) AS m_min, sum(o_totalprice) AS m_sum, CAST(count(*) AS DOUBLE) AS m_n
    FROM orders GROUP BY 1, 2) o JOIN sites s ON o.participant = s.participant)"""


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject (supplier), modality (return flag), scanner, and four measures."""
    fact = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("subject"), F.col("l_returnflag").alias("modality")).agg(F.avg("l_quantity").alias("snr"), F.avg("l_extendedprice").alias("cjv"), F.avg("l_discount").alias("cnr"), F.avg("l_tax").alias("efc"))
    dim = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    where = table(spark, sf_dir, "supplier").join(dim, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("subject"), F.col("r_name").alias("scanner"))
    return fact.join(where, "subject")


QUALITY_SQL = """q AS (
  SELECT f.*, r_name AS scanner FROM (
    SELECT l_suppkey AS subject, l_returnflag AS modality, avg(l_quantity) AS snr, avg(l_extendedprice) AS cjv,
      avg(l_discount) AS cnr, avg(l_tax) AS efc FROM lineitem GROUP BY 1, 2) f
  JOIN supplier ON subject = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
