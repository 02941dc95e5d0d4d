"""The relations that the analysis runs on, derived from the tables: probe series, field grid, scattered samples.

The SQL is plain enough for Spark and DuckDB alike, so that oracles start from the same text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DT, RHO = 0.03125, 100.0
BOX = (40.0, 30.0, 50.0)
SHAPE = (7, 6, 5)

PROBE_ROWS = """
SELECT CAST(FLOOR(event_id / 9) AS BIGINT) AS step, FLOOR(event_id / 9) * CAST(0.03125 AS DOUBLE) AS time_seconds,
  CAST(event_id % 9 AS BIGINT) AS sc,
  CASE WHEN event_id % 9 = 0 THEN 'H' ELSE CONCAT('N', CAST(event_id % 9 AS STRING)) END AS label,
  10 + 3 * (event_id % 9) + CAST(2.5 AS DOUBLE) * (FLOOR(event_id / 9) * CAST(0.03125 AS DOUBLE)) AS ux,
  20 + ((event_id % 9) * (event_id % 9)) % 7 + CAST(1.2 AS DOUBLE) * (FLOOR(event_id / 9) * CAST(0.03125 AS DOUBLE)) AS uy,
  30 + ((event_id % 9) * (event_id % 9) * (event_id % 9)) % 11
    + CAST(1.5 AS DOUBLE) * (FLOOR(event_id / 9) * CAST(0.03125 AS DOUBLE)) AS uz,
  value AS v1, CAST(user_id AS DOUBLE) AS v2, CAST(regexp_extract(props, '[0-9]+', 0) AS DOUBLE) AS v3
FROM events"""

#: Whole steps only.
PROBE = f"{PROBE_ROWS} WHERE event_id < 9 * FLOOR((SELECT COUNT(*) FROM events) / 9)"

GRID = """
SELECT CAST(l_linenumber - 1 AS BIGINT) AS ix, CAST(FLOOR((MONTH(l_shipdate) - 1) / 2) AS BIGINT) AS iy,
  CAST(FLOOR((l_quantity - 1) / 10) AS BIGINT) AS iz,
  CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) AS v1,
  CAST(SUM(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) AS v2,
  CAST(SUM(CAST(l_tax AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) AS v3
FROM lineitem GROUP BY 1, 2, 3"""

SAMPLES = """
SELECT s_suppkey AS sample_id, CAST(s_suppkey * 37 % 101 AS DOUBLE) / 100 AS x,
  CAST(s_suppkey * 53 % 97 AS DOUBLE) / 96 AS y, CAST(s_nationkey AS DOUBLE) / 24 AS z, s_acctbal AS v
FROM supplier"""

POINTS = """
SELECT p_partkey AS point_id, CAST(p_partkey * 37 % 101 AS DOUBLE) / 100 AS x,
  CAST(p_partkey * 53 % 97 AS DOUBLE) / 96 AS y, CAST(p_size AS DOUBLE) / 50 AS z
FROM part"""


def view(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """Run one of the texts above over the Parquet tables it names."""
    return spark.sql(sql.replace(f"FROM {tables[0]}", "FROM {t}"), t=spark.read.parquet(f"{sf_dir}/{tables[0]}.parquet"))


def probe_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, PROBE, "events")


def field_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, GRID, "lineitem")


def scattered_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, SAMPLES, "supplier")


def query_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, POINTS, "part")


def unpacked(rows: DataFrame, column: str, layout: Sequence[str], wanted: Sequence[str]) -> DataFrame:
    """Named components of an array column whose places ``layout`` names, beside the other columns."""
    if len(set(wanted)) != len(wanted) or not wanted:
        raise ValueError("name each component once")
    unknown = sorted(set(wanted) - set(layout))
    if unknown:
        raise ValueError(f"no component {', '.join(unknown)} among {', '.join(layout)}")
    return rows.select("*", *[F.get(column, F.lit(list(layout).index(w))).alias(w) for w in wanted]).drop(column)
