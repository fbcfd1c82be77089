"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import getpass
import re
import tempfile
import uuid
from contextlib import contextmanager
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words in the contracts: space, and tab to carriage return.
WORD_SEPARATORS = " \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
GAP_PATTERN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset and all of Spark is this one process
    (tests on one machine) a folder of this user is made and set; a cluster without the setting is an error, since
    its machines would not see what the driver writes to a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not hasattr(spark.sparkContext, "_corpusloom_dir"):
        spark.sparkContext._corpusloom_dir = tempfile.mkdtemp(prefix=f"corpusloom-{getpass.getuser()}-")
        spark.sparkContext.setCheckpointDir(spark.sparkContext._corpusloom_dir)
        atexit.register(_drop_local, spark.sparkContext._corpusloom_dir)
    return spark.sparkContext._corpusloom_dir


def _drop_local(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


#: Rows of an Arrow batch while a table is written: what a JVM and a Python worker hold of it at a time.
BATCH_ROWS = 2_500
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession):
    """Smaller Arrow batches for the actions inside; the session's own setting comes back afterwards."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def materialize(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends there, and lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/corpusloom/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    with small_batches(df.sparkSession):
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._corpusloom_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table that ``materialize`` wrote and that nothing reads any more."""
    spark, path = df.sparkSession, df._corpusloom_path
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: Bits of ``Marks`` at most: 16 MB.
MARK_BITS = 1 << 27


class Marks:
    """A Bloom filter of the values of a column, as one row that is broadcast; made and used by DataFrame functions alone.

    Its size is 16 bits a value up to ``max_bits`` and no more, whatever the number of values; beyond, more rows pass that
    need not. So it only spares work: what passes is to be looked at exactly. Tables that it filters are not shuffled.
    """

    HASHES = 4

    def __init__(self, values: DataFrame, max_bits: int = MARK_BITS) -> None:
        (name,) = values.columns
        self.bits = min(max_bits, 1 << max(16, (16 * values.count()).bit_length()))
        places = values.select(F.explode(F.array(*self._places(F.col(f"`{name}`")))).alias("place"))
        one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place").bitwiseAND(F.lit(63)).cast("int"))
        words = places.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(one).alias("ones"))
        # 1,024 words make a part, and all parts, each once, make the row
        full = values.sparkSession.range(max(1, self.bits >> 6)).join(words, F.col("id") == F.col("word"), "left")
        parts = full.groupBy(F.shiftright("id", 10).alias("part")).agg(F.array_sort(F.collect_list(F.struct("id", F.coalesce("ones", F.lit(0).cast("long")).alias("ones")))).alias("a"))
        parts = parts.select("part", F.transform("a", lambda x: x["ones"]).alias("a"))
        self.row = materialize(parts.agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "a"))), lambda x: x["a"]).alias("_marks")), "marks")

    def _places(self, value: Column) -> list[Column]:
        one, two = F.xxhash64(value), F.xxhash64(value, F.lit(1))
        return [F.pmod(F.shiftrightunsigned(one, 2) + F.lit(k).cast("long") * F.shiftrightunsigned(two, 8), F.lit(self.bits).cast("long")) for k in range(self.HASHES)]

    def split(self, df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
        """The rows whose ``column`` may be among the values, and those whose is not or is null."""
        name = free_name(df, "_marks")
        row = F.broadcast(self.row.withColumnRenamed("_marks", name))
        word = lambda p: F.get(F.get(F.col(name), F.shiftright(p, 16).cast("int")), F.shiftright(p, 6).bitwiseAND(F.lit(1023)).cast("int"))
        bit = lambda p: F.call_function("shiftright", word(p), p.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1
        there = F.col(f"`{column}`").isNotNull()
        for p in self._places(F.col(f"`{column}`")):
            there = there & bit(p)
        own = [F.col(f"`{c}`") for c in df.columns]
        return df.join(row, there, "left_semi").select(*own), df.join(row, there, "left_anti").select(*own)


def settle(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of tables that are written by now; else they stay until the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def words(text: Column) -> Column:
    """The array of words of a text; empty for null and for white space alone."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(WORD_SEPARATORS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, GAP_PATTERN))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or that with underscores where the input has a column of this name (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


@cache
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # other C libraries give memory back themselves
        return lambda _: None


def give_back() -> None:
    """Returns free memory to the system: a worker lives on, so what one batch took must not stay."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    _trim()(0)


def text_slices(batch, column: str, limit: int = 4_000_000):
    """Cuts an Arrow batch into pieces whose ``column`` holds about ``limit`` bytes, or one row if that is longer."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
    ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to
    give_back()
