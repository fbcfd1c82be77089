"""Scans and look-ups; predicates reach the Parquet scan."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import TABLES

#: Longer lists of values become a table that is joined.
IN_LIST = 1000


class NotOne(ValueError):
    pass


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name].ddl)


def _plain_json(text: Column) -> Column:
    """A JSON text without spaces, its keys in order; null for what is no JSON."""
    return F.to_json(F.try_parse_json(text))


def _equal(column: str, value) -> Column:
    if value is None:
        return F.col(column).isNull()
    if isinstance(value, dict):
        return _plain_json(F.col(column)) == _plain_json(F.lit(json.dumps(value)))
    if isinstance(value, list | tuple):
        return F.col(column) == F.array(*map(F.lit, value))
    return F.col(column) == F.lit(value)


def read_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table as a stream of its rows, whether it is one file or a folder of files (a pattern may be either, a plain path may not)."""
    return spark.readStream.schema(read(spark, folder, name).schema).parquet(f"{folder}/{name}.parque[t]")


def find_many(df: DataFrame, where: dict | None = None) -> DataFrame:
    """Rows that equal all values; all rows without any. A dict equals JSON of the same content, however written."""
    return df.where(reduce(lambda a, b: a & b, (_equal(c, v) for c, v in where.items()))) if where else df


def by_id(df: DataFrame, value, key: str = "id") -> DataFrame:
    return df.where(F.col(key) == F.lit(value)).limit(1)


def find_in(df: DataFrame, column: str, values: list) -> DataFrame:
    """Rows with one of the values; none for an empty list. Long lists are joined."""
    values = [v for v in dict.fromkeys(values) if v is not None]
    if not values:
        return df.limit(0)
    if len(values) <= IN_LIST:
        return df.where(F.col(column).isin(values))
    wanted = df.sparkSession.createDataFrame([(v,) for v in values], df.select(F.col(column).alias("_wanted")).schema)
    return df.join(wanted, F.col(column) == F.col("_wanted"), "left_semi")


def find_one(df: DataFrame, where: dict):
    """The row, None if there is none, NotOne if there are several."""
    rows = find_many(df, where).limit(2).collect()
    if len(rows) > 1:
        raise NotOne(f"several rows for {sorted(where)}")
    return rows[0] if rows else None


def decode_json(df: DataFrame, column: str, ddl: str) -> DataFrame:
    return df.withColumn(column, F.from_json(column, ddl))


def blobs(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """key, content of the files in a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("key"), "content")


def with_blobs(df: DataFrame, key: str, stored: DataFrame) -> DataFrame:
    """Adds content, null where there is no such blob."""
    return df.join(stored.withColumnRenamed("key", "_key"), F.col(key) == F.col("_key"), "left").drop("_key")


def payload_equals(column: str, key: str, value: str) -> Column:
    return F.get_json_object(column, f"$.{key}") == value
