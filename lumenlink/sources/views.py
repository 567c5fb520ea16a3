"""Record sets and numbers derived from the star-schema tables, in DataFrame functions and in SQL.

Two record sets stand for two files about the same persons: names are letters drawn from digests of
the key, and the second set drops, changes and omits letters and persons by rules of the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_HEX, _LETTERS = "0123456789abcdef", "aeioubdfglmnrstk"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt to all cores by a key: a few megabytes of records are one split, but hours of digests."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, key)


def records_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_id, attr1, attr2, attr3, salt): two names, year of birth, market segment."""
    key = F.col("c_custkey")
    name = lambda at, size: F.translate(F.substring(F.md5(key.cast("string")), at, size), _HEX, _LETTERS)
    return spread(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey").select(key.cast("string").alias("entity_id"), name(1, 7).alias("attr1"), name(9, 5).alias("attr2"), (1930 + key % 70).cast("string").alias("attr3"), F.col("c_mktsegment").alias("salt"))


def records_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("entity_id").cast("long")
    first = F.when(key % 5 == 0, F.substring("attr1", 2, 10)).when(key % 7 == 0, F.translate("attr1", "a", "e")).otherwise(F.col("attr1"))
    second = F.when(key % 6 == 0, F.concat("attr2", F.lit("s"))).otherwise(F.col("attr2"))
    return records_a(spark, sf_dir).where(key % 11 != 0).select("entity_id", first.alias("attr1"), second.alias("attr2"), "attr3", "salt")


SQL_A = f"""rec_a AS (
  SELECT CAST(c_custkey AS VARCHAR) AS entity_id, translate(substr(md5(CAST(c_custkey AS VARCHAR)), 1, 7), '{_HEX}', '{_LETTERS}') AS attr1,
         translate(substr(md5(CAST(c_custkey AS VARCHAR)), 9, 5), '{_HEX}', '{_LETTERS}') AS attr2,
         CAST(1930 + c_custkey % 70 AS VARCHAR) AS attr3, c_mktsegment AS salt
  FROM customer)"""
SQL_B = f"""{SQL_A},
rec_b AS (
  SELECT entity_id,
         CASE WHEN k % 5 = 0 THEN substr(attr1, 2, 10) WHEN k % 7 = 0 THEN translate(attr1, 'a', 'e') ELSE attr1 END AS attr1,
         CASE WHEN k % 6 = 0 THEN attr2 || 's' ELSE attr2 END AS attr2, attr3, salt
  FROM (SELECT *, CAST(entity_id AS BIGINT) AS k FROM rec_a) WHERE k % 11 <> 0)"""

#: Domain of the numbers.
LOW, HIGH = 20.0, 80.0


def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, value): ages from 20 to 79 by a rule of the customer key."""
    key = F.col("c_custkey")
    return spread(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").select(key.alias("id"), (20 + F.pmod(key * 37, F.lit(60))).cast("double").alias("value"))


SQL_N = "num AS (SELECT c_custkey AS id, CAST(20 + (c_custkey * 37) % 60 AS DOUBLE) AS value FROM customer)"
