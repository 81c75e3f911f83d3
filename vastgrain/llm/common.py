"""Helpers shared by the corpus operators: shared-folder tables, row keys, Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Internal row key. The leading underscores keep it clear of the users' own columns.
ROW = "__row"


def text_of(name: str = "text") -> Column:
    """The text column; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only a local session may go without and gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not folder:
        folder = context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="vastgrain-")
        context.setCheckpointDir(folder)
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; Hadoop's file system deletes it when the driver ends."""
    path = f"{shared_dir(spark)}/vastgrain/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


#: Rows of a narrow table that one file may hold.
FILE_ROWS = 250_000
#: Rows that Python functions over texts work on at a time. Whole batches of Spark's 10,000 rows, held on both sides, take more
#: memory than all the tables these functions look things up in.
TEXT_ROWS = 512
#: Spark's setting of the rows in a batch.
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs in here hands Python at most ``TEXT_ROWS`` rows at a time; afterwards the session is as it was."""
    before = spark.conf.get(BATCH_CONF)
    if not 0 < int(before) <= TEXT_ROWS:
        spark.conf.set(BATCH_CONF, str(TEXT_ROWS))
    try:
        yield
    finally:
        spark.conf.set(BATCH_CONF, before)


def materialize(df: DataFrame, name: str, rows: int | None = None, texts: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage, fixes values that depend on partition numbers, and survives lost executors. ``rows``, an upper
    bound of a narrow table's rows, keeps a small table from being scattered over many small files; ``texts`` says that
    texts go through Python on the way, in small batches.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    with small_batches(spark) if texts else contextlib.nullcontext():
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def forget(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialize` that nothing reads any more."""
    for table in tables:
        path = getattr(table, "_written_to", None)
        if path:
            jvm, context = table.sparkSession.sparkContext._jvm, table.sparkSession.sparkContext
            hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
            hadoop_path.getFileSystem(context._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores after it where ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_row_key(df: DataFrame, key: str = ROW) -> DataFrame:
    """Add a row key, unique per input row within one run of the plan. A second run may cut files otherwise, as executors come and go; see :func:`keyed_table`."""
    return df.withColumn(key, F.monotonically_increasing_id())


def keyed_table(df: DataFrame, name: str = "keyed", key: str = ROW) -> DataFrame:
    """``df`` with a row key, written, so that every later read sees the same keys."""
    return materialize(with_row_key(df, key), name)


def release() -> None:
    """Give freed memory back to the system: a Python worker outlives its task and waits beside those at work."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError, TypeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with a per-task setup: ``make()`` runs once in each Python task and returns the function of a batch, which gets ``TEXT_ROWS`` rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for lo in range(0, max(1, batch.num_rows), TEXT_ROWS):
                out = step(batch.slice(lo, TEXT_ROWS))
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out
        del step
        release()

    return df.mapInArrow(run, schema)


#: Bits for each value of a filter that keeps rows without a partner out of the exchange, and the most it may have (32 MB).
VALUE_BITS = 16
FILTER_BITS = 1 << 28


def maybe_among(few: DataFrame, column: str, n: int, each: bool = False):
    """A Bloom filter of the ``n`` rows of ``few``: a function of a column of arrays of longs that is true where any
    is in ``few`` (and now and then where none is), or with ``each`` leaves of them those that are. None where it would have more
    than ``FILTER_BITS`` bits.
    """
    size = 1 << max(16, (VALUE_BITS * n - 1).bit_length())
    if size > FILTER_BITS:
        return None
    hashed = [F.pmod(F.xxhash64(F.col(column), F.lit(k)), F.lit(size)) for k in range(2)]
    step = F.lit(size - 1)
    bits = few.select(F.explode(F.array(hashed[0], hashed[1], (hashed[0] + 2 * hashed[1] + 1).bitwiseAND(step), (hashed[0] + 4 * hashed[1] + 3).bitwiseAND(step))).alias("bit"))
    words = bits.groupBy(F.expr("bit div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("v")).toArrow()  # bounded by FILTER_BITS / 64
    table = np.zeros(size // 64, np.uint64)
    table[words.column("w").to_numpy()] = words.column("v").to_numpy().view(np.uint64)
    shared = few.sparkSession.sparkContext.broadcast(table)

    def held(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        have = np.ones(len(a), bool)
        for bit in (a, b, (a + 2 * b + 1) & (size - 1), (a + 4 * b + 3) & (size - 1)):
            have &= (shared.value[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) == 1
        return have

    @F.pandas_udf("boolean")
    def any_held(first: pd.Series, second: pd.Series) -> pd.Series:
        sizes = np.fromiter((len(x) for x in first), np.int64, len(first))
        if not sizes.sum():
            return pd.Series(np.zeros(len(first), bool))
        have = held(np.concatenate(first.tolist()).astype(np.int64), np.concatenate(second.tolist()).astype(np.int64))
        found = np.zeros(len(first), bool)
        found[np.repeat(np.arange(len(first)), sizes)[have]] = True
        return pd.Series(found)

    @F.pandas_udf("array<long>")
    def those_held(first: pd.Series, second: pd.Series, values: pd.Series) -> pd.Series:
        sizes = np.fromiter((len(x) for x in values), np.int64, len(values))
        if not sizes.sum():
            return values
        have = held(np.concatenate(first.tolist()).astype(np.int64), np.concatenate(second.tolist()).astype(np.int64))
        ends = np.cumsum(sizes)
        left = np.concatenate(values.tolist()).astype(np.int64)[have]
        return pd.Series(np.split(left, np.append(0, np.cumsum(have))[ends[:-1]]))

    hashes = lambda values, k: F.transform(values, lambda x: F.pmod(F.xxhash64(x, F.lit(k)), F.lit(size)))
    if each:
        return lambda values: those_held(hashes(values, 0), hashes(values, 1), values)
    return lambda values: any_held(hashes(values, 0), hashes(values, 1))


class Memo(dict):
    """A bounded cache of two generations: ``memo[key]`` computes and keeps (no value is None).

    When the young one holds ``limit`` keys, it becomes the old one; keys used again move back.
    """

    def __init__(self, compute: Callable, limit: int):
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def __missing__(self, key):
        value = self.old.pop(key, None)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
