"""One face over sources: open, describe, search, sample, stream, write."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import similarity, windows
from .plans import cost
from .plans.navigation import WindowedFrame
from .sources import dispatch, sinks
from .sources.readers import local_files


class Dataset:
    """A lazily read source with metadata-only answers for Parquet and bounded local iteration."""

    def __init__(self, spark: SparkSession, target: str | Sequence[str], budget: cost.Budget | None = None, **options):
        self.spark, self.target, self.budget = spark, target, budget
        self.frame = dispatch.load(spark, target, **options)

    # ---- metadata

    def files(self) -> list[str]:
        return [f for t in ([self.target] if isinstance(self.target, str) else self.target) for f in local_files(t)]

    def footers(self) -> DataFrame:
        return cost.footers(self.spark, self.files())

    def describe(self) -> DataFrame:
        """Per file: row groups, rows, bytes. No data pages are read."""
        groups = self.footers().select("file", "row_group", "rows", "bytes").distinct()
        return groups.groupBy("file").agg(F.count(F.lit(1)).alias("row_groups"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))

    def stats(self) -> DataFrame:
        return cost.column_stats(self.footers())

    def prune(self, column: str, lo: float, hi: float) -> DataFrame:
        return cost.prune_report(self.footers(), column, lo, hi)

    def plan(self, chunk_bytes: str | int = "64MB") -> DataFrame:
        """Chunks a budgeted reader takes: per file its rows, bytes a row, rows a chunk and the number of chunks."""
        size = cost.parse_size(chunk_bytes)
        per = self.describe().withColumn("row_bytes", F.col("bytes") / F.greatest("rows", F.lit(1)))
        rows = F.least(F.lit(4_194_304), F.greatest(F.lit(256), F.floor(F.lit(float(size)) / F.greatest("row_bytes", F.lit(1e-9)))))
        return per.withColumn("chunk_rows", rows.cast("long")).withColumn("chunks", F.ceil(F.col("rows") / F.col("chunk_rows")))

    # ---- rows

    def search(self, column: str, lo: float, hi: float, columns: Sequence[str] | None = None) -> DataFrame:
        return windows.range_search(self.frame, column, lo, hi, columns)

    def window(self, x: str, x0, x1, y: str | None = None, y0=None, y1=None, columns: Sequence[str] | None = None) -> DataFrame:
        return windows.lazy_window(self.frame, x, x0, x1, y, y0, y1, columns)

    def view(self, *axes: str, bytes_per_row: float = 64.0) -> WindowedFrame:
        return WindowedFrame.over(self.frame, *axes, bytes_per_row=bytes_per_row)

    def sample(self, k: int, seed: int | None = None) -> DataFrame:
        """Rows of k row groups spread over the files (jittered with a seed): a scan of those groups only."""
        groups = [(r["file"], r["row_group"]) for r in self.footers().select("file", "row_group").distinct().orderBy("file", "row_group").toLocalIterator()]
        picked = [groups[i] for i in similarity.spread_indices(len(groups), k, seed)]

        def read(frames):
            import pyarrow.parquet as pq

            for f in frames:
                for path, group in zip(f.column("file").to_pylist(), f.column("row_group").to_pylist(), strict=True):
                    yield from pq.ParquetFile(path).read_row_group(group).to_batches()

        parts = self.spark.createDataFrame(picked, "file string, row_group int").repartition(max(1, len(picked)))
        return parts.mapInArrow(read, self.frame.schema)

    def batches(self, columns: Sequence[str] | None = None, rows: int = 65_536) -> Iterator[pa.RecordBatch]:
        """Record batches on the driver, made by the executors and fetched a partition at a time; a batch is charged to the budget before it is unpacked."""
        from pyspark.sql.pandas.types import to_arrow_schema

        frame = self.frame.select(*columns) if columns else self.frame
        schema = to_arrow_schema(frame.schema)

        def packed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in parts:
                for at in range(0, batch.num_rows, rows):
                    piece = batch.slice(at, rows)
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, piece.schema) as out:
                        out.write_batch(piece)
                    yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([piece.nbytes])], ["data", "size"])

        for row in frame.mapInArrow(packed, "data binary, size long").toLocalIterator(prefetchPartitions=False):
            if self.budget:
                self.budget.acquire(row["size"])
            try:
                with pa.ipc.open_stream(row["data"]) as stream:
                    for batch in stream:
                        yield pa.RecordBatch.from_arrays(batch.columns, schema=pa.schema([f.with_name(n) for f, n in zip(batch.schema, schema.names, strict=True)]))
            finally:
                if self.budget:
                    self.budget.release(row["size"])

    def numpy(self, columns: Sequence[str], rows: int = 65_536) -> Iterator[dict[str, np.ndarray]]:
        for b in self.batches(columns, rows):
            yield {n: b.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(columns)}

    def to_arrow(self) -> pa.Table:
        """The whole frame on the driver; for what fits."""
        return self.frame.toArrow()

    def materialize(self, path: str, columns: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
        return sinks.materialize(self.frame, path, columns, limit)


def open(spark: SparkSession, target: str | Sequence[str], budget: str | int | None = None, **options) -> Dataset:  # noqa: A001
    """A dataset from a path, a glob, a folder or a list of paths."""
    return Dataset(spark, target, cost.Budget(cost.parse_size(budget)) if budget is not None else None, **options)


def scan(spark: SparkSession, target: str | Sequence[str], columns: Sequence[str] | None = None, **options) -> DataFrame:
    """A lazy DataFrame, projected."""
    return dispatch.load(spark, target, columns, **options)


def view(spark: SparkSession, target: str | Sequence[str], *axes: str, **options) -> WindowedFrame:
    """A window on a source's axes."""
    return open(spark, target, **options).view(*axes)


def to_frame(spark: SparkSession, value) -> DataFrame:
    """A DataFrame from an Arrow table, a dict of columns, a 1-D or 2-D array (columns c0, c1, …) or a pandas frame."""
    import pandas as pd

    if isinstance(value, pa.Table):
        return spark.createDataFrame(value)
    if isinstance(value, np.ndarray):
        a = value.reshape(len(value), -1)
        return spark.createDataFrame(pd.DataFrame(a, columns=[f"c{i}" for i in range(a.shape[1])]))
    return spark.createDataFrame(pd.DataFrame(value))


def narrow(table: pa.Table) -> pa.Table:
    """An Arrow table with 32-bit offsets: large strings, binaries and lists become the plain ones, dictionaries of them too."""

    def plain(kind: pa.DataType) -> pa.DataType:
        if pa.types.is_large_string(kind):
            return pa.string()
        if pa.types.is_large_binary(kind):
            return pa.binary()
        if pa.types.is_large_list(kind) or pa.types.is_list(kind):
            return pa.list_(plain(kind.value_type))
        if pa.types.is_dictionary(kind):
            return pa.dictionary(kind.index_type, plain(kind.value_type), kind.ordered)
        if pa.types.is_struct(kind):
            return pa.struct([pa.field(f.name, plain(f.type), f.nullable) for f in kind])
        return kind

    return table.cast(pa.schema([pa.field(f.name, plain(f.type), f.nullable, f.metadata) for f in table.schema]))


def resident_bytes(value) -> int:
    """Bytes that an array, table, frame, text or container of these holds; a DataFrame's are what the optimiser expects."""
    if isinstance(value, DataFrame):
        return int(str(value._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if isinstance(value, dict):
        return sum(map(resident_bytes, value.values()))
    if isinstance(value, (list, tuple, set)):
        return sum(map(resident_bytes, value))
    if hasattr(value, "memory_usage"):
        usage = value.memory_usage(deep=True)
        return int(usage.sum() if hasattr(usage, "sum") else usage)
    if hasattr(value, "nbytes"):
        return int(value.nbytes)
    return len(value.encode() if isinstance(value, str) else value) if isinstance(value, (str, bytes)) else 0
