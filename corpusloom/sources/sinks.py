"""Inserts, upserts, updates and replacements as functions from tables to tables; Spark's writer commits them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _on(left: str, right: str, keys: tuple[str, ...], nulls_equal: bool) -> Column:
    one = lambda k: F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) if nulls_equal else F.col(f"{left}.{k}") == F.col(f"{right}.{k}")
    return reduce(lambda a, b: a & b, map(one, keys))


def create(existing: DataFrame, rows: DataFrame) -> DataFrame:
    return existing.unionByName(rows, allowMissingColumns=True)


def create_ignore(existing: DataFrame, rows: DataFrame, keys: tuple[tuple[str, ...], ...], order: str | None = None, nulls_equal: bool = False) -> DataFrame:
    """Adds rows that collide on no unique key, neither with the table nor with an earlier new row.

    Earlier is by ``order``, and among equals, or without it, by all columns.
    """
    turn = [*([order] if order else []), *rows.columns]
    for key in keys:
        rows = rows.alias("n").join(existing.select(*key).alias("e"), _on("n", "e", key, nulls_equal), "left_anti")
        first = F.row_number().over(Window.partitionBy(*key).orderBy(*turn))
        has_null = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in key))
        rows = rows.withColumn("_n", first).where((F.col("_n") == 1) | (F.lit(not nulls_equal) & has_null)).drop("_n")
    return create(existing, rows)


def upsert(existing: DataFrame, rows: DataFrame, key: tuple[str, ...], update: dict[str, Column] | None = None, nulls_equal: bool = False, order: str | None = None) -> DataFrame:
    """New rows replace the columns of existing ones with the same key; null keys are equal only if ``nulls_equal``.

    ``update`` gives columns from aliases e (existing) and n (new); by default all of n's. Of new rows that share a key the
    last counts, by ``order`` and then by all columns.
    """
    unique = F.lit(nulls_equal) | reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in key))
    last = rows.where(unique).groupBy(*key).agg(F.max_by(F.struct(*rows.columns), F.struct(*([order] if order else []), *rows.columns)).alias("_last")).select("_last.*")
    rows = last if nulls_equal else last.unionByName(rows.where(~unique))
    joined = existing.withColumn("_e", F.lit(1)).alias("e").join(rows.withColumn("_n", F.lit(1)).alias("n"), _on("e", "n", key, nulls_equal), "full_outer")
    both = F.col("e._e").isNotNull() & F.col("n._n").isNotNull()

    def value(c: str) -> Column:
        new = F.col(f"n.{c}") if c in rows.columns else F.lit(None)
        changed = (update or {}).get(c, new if update is None and c in rows.columns else F.col(f"e.{c}"))
        return F.when(both, changed).when(F.col("e._e").isNotNull(), F.col(f"e.{c}")).otherwise(new).alias(c)

    return joined.select(*map(value, existing.columns))


def update_where(df: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    return df.withColumns({c: F.when(F.coalesce(where, F.lit(False)), v).otherwise(F.col(c)) for c, v in values.items()})


def delete_where(df: DataFrame, where: Column) -> DataFrame:
    return df.where(~F.coalesce(where, F.lit(False)))


def replace_by_key(existing: DataFrame, rows: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """All rows of the new rows' keys go, the new rows come."""
    return create(existing.alias("e").join(rows.select(*key).distinct().alias("n"), _on("e", "n", key, True), "left_anti"), rows)


def set_embedding(existing: DataFrame, rows: DataFrame, order: str | None = None) -> DataFrame:
    """One embedding a readable: a new one replaces what is there."""
    return upsert(existing, rows, ("readable_type", "readable_id"), order=order)


def append_events(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def check_enum(df: DataFrame, column: str, values: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rows in quarantine)."""
    ok = F.coalesce(F.col(column).isin(list(values)), F.lit(False))
    return df.where(ok), df.where(~ok)


def check_contract(df: DataFrame, errors: Column) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rows in quarantine with the names of what is wrong in ``contract_errors``); ``errors`` is an array of names."""
    checked = df.withColumn("contract_errors", errors)
    wrong = F.coalesce(F.size("contract_errors") > 0, F.lit(False))
    return checked.where(~wrong).drop("contract_errors"), checked.where(wrong)


def put_blobs(df: DataFrame, folder: str) -> None:
    """Stores (key, content) rows as a table that ``stored_blobs`` reads; the writer commits all or nothing."""
    df.select("key", "content").write.mode("append").parquet(folder)


def stored_blobs(spark, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def seed(spark, name: str, rows: list[tuple]) -> DataFrame:
    """A logical table with the given rows."""
    from .schemas import TABLES

    return spark.createDataFrame(rows, TABLES[name].ddl)
