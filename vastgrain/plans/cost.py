"""What a read will cost, from metadata: sizes, footers, plans, levels of detail, budgets."""

from __future__ import annotations

import re
import threading
import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def parse_size(text: str | int) -> int:
    """Bytes out of ``8GB``, ``1.5 GiB``, 512; steps of 1024; negative sizes are an error."""
    if isinstance(text, (int, float)):
        if text < 0:
            raise ValueError("negative size")
        return int(text)
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([kmgt]?)i?b?\s*", text.lower())
    if not m:
        raise ValueError(f"not a size: {text!r}")
    return int(float(m[1]) * 1024 ** " kmgt".index(m[2] or " "))


def human(n: int) -> str:
    """A size for people: steps of 1024, one decimal, TB at most."""
    value, unit = float(n), 0
    while value >= 1024 and unit < 4:
        value, unit = value / 1024, unit + 1
    return f"{n} B" if unit == 0 else f"{value:.1f} {('B', 'KB', 'MB', 'GB', 'TB')[unit]}"


@dataclass
class Budget:
    """Byte admission for what the driver holds (plans, local iteration); executors have Spark's own memory manager."""

    capacity: int
    used: int = 0
    peak: int = 0
    grants: int = 0
    waits: int = 0
    denials: int = 0
    _change: threading.Condition = field(default_factory=threading.Condition, repr=False)

    def try_acquire(self, n: int) -> bool:
        with self._change:
            if self.used + n > self.capacity:
                self.denials += 1
                return False
            self._grant(n)
            return True

    def _grant(self, n: int) -> None:
        self.used += n
        self.peak = max(self.peak, self.used)
        self.grants += 1

    def acquire(self, n: int, timeout: float = 60.0) -> None:
        """Wait up to ``timeout`` seconds for room; more than the whole capacity fails at once."""
        if n > self.capacity:
            self.denials += 1
            raise MemoryError(f"{human(n)} of a budget of {human(self.capacity)}")
        until = time.monotonic() + timeout
        with self._change:
            if self.used + n > self.capacity:
                self.waits += 1
            while self.used + n > self.capacity:
                left = until - time.monotonic()
                if left <= 0 or not self._change.wait(left):
                    self.denials += 1
                    raise TimeoutError(f"no {human(n)} within {timeout} s")
            self._grant(n)

    def release(self, n: int) -> None:
        with self._change:
            self.used = max(0, self.used - n)
            self._change.notify_all()

    @property
    def available(self) -> int:
        return self.capacity - self.used

    def default_chunk(self) -> int:
        """A quarter of what is free, but at least 1 MB or all of it."""
        return max(self.available // 4, min(1 << 20, self.available))


FOOTER_SCHEMA = "file string, row_group int, rows long, bytes long, column string, num_values long, nulls long, column_bytes long, low string, high string, low_number double, high_number double"


def footers(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Parquet footers as rows (file, row group, column) with typed bounds; no data pages are read. Footers are read on executors."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.parquet as pq

        for f in frames:
            for path in f["path"]:
                meta = pq.read_metadata(path)
                out = []
                for g in range(meta.num_row_groups):
                    group = meta.row_group(g)
                    for c in range(group.num_columns):
                        column = group.column(c)
                        s = column.statistics
                        low, high = (s.min, s.max) if s is not None and s.has_min_max else (None, None)
                        number = lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None
                        out.append((path, g, group.num_rows, group.total_byte_size, column.path_in_schema, column.num_values, s.null_count if s is not None else None, column.total_compressed_size, None if low is None else str(low), None if high is None else str(high), number(low), number(high)))
                yield pd.DataFrame(out, columns=[c.split()[0] for c in FOOTER_SCHEMA.split(", ")])

    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths), 64))).mapInPandas(read, FOOTER_SCHEMA)


def prune_plan(footer: DataFrame, column: str, lo: float, hi: float) -> DataFrame:
    """Row groups a range search has to read: those whose bounds meet [lo, hi], or that have none (blind)."""
    groups = footer.filter(F.col("column") == column)
    blind = F.col("low_number").isNull()
    return groups.withColumn("blind", blind).filter(blind | ((F.col("high_number") >= lo) & (F.col("low_number") <= hi))).select("file", "row_group", "rows", "bytes", "blind")


def prune_report(footer: DataFrame, column: str, lo: float, hi: float) -> DataFrame:
    """Groups, rows and bytes kept and in all, and the share of bytes."""
    kept = prune_plan(footer, column, lo, hi).agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count_if("blind").alias("blind"))
    every = footer.filter(F.col("column") == column).agg(F.count(F.lit(1)).alias("all_groups"), F.sum("rows").alias("all_rows"), F.sum("bytes").alias("all_bytes"))
    return kept.crossJoin(every).withColumn("selectivity", F.col("bytes") / F.col("all_bytes"))  # one row each


def column_stats(footer: DataFrame) -> DataFrame:
    """Values, nulls, bytes and bounds of each column over all groups and files."""
    return footer.groupBy("column").agg(F.sum("num_values").alias("num_values"), F.sum("nulls").alias("nulls"), F.sum("column_bytes").alias("bytes"), F.min("low_number").alias("low_number"), F.max("high_number").alias("high_number"), F.min("low").alias("low"), F.max("high").alias("high"))


def row_group_overview(footer: DataFrame, lo: int, hi: int) -> DataFrame:
    """Row groups that meet rows [lo, hi): ``middle, rows, bytes_per_row, spans`` (each numeric column's high less its low). From footers alone."""
    groups = footer.groupBy("file", "row_group").agg(F.max("rows").alias("rows"), F.max("bytes").alias("bytes"), F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("low_number").isNotNull(), F.struct("column", F.col("high_number") - F.col("low_number")))))).alias("spans"))
    end = F.sum("rows").over(Window.orderBy("file", "row_group"))  # a row a row group
    placed = groups.withColumn("__end", end).withColumn("__begin", F.col("__end") - F.col("rows")).filter((F.col("__end") > lo) & (F.col("__begin") < hi))
    return placed.select("file", "row_group", ((F.col("__begin") + F.col("__end")) / 2).alias("middle"), "rows", (F.col("bytes") / F.greatest("rows", F.lit(1))).alias("bytes_per_row"), "spans")


def entries_overview(matrix: DataFrame, lo: int, hi: int, buckets: int) -> DataFrame:
    """Genes detected in buckets of cells [lo, hi): ``bucket, cells, mean, most``; cells without an entry count as 0. ``matrix`` has ``cell, gene``."""
    width = max(1, -(-(hi - lo) // buckets))
    per = matrix.filter((F.col("cell") >= lo) & (F.col("cell") < hi)).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    held = per.groupBy(F.floor((F.col("cell") - lo) / F.lit(width)).cast("long").alias("bucket")).agg(F.sum("n").alias("total"), F.max("n").alias("most"))
    every = matrix.sparkSession.range(-(-(hi - lo) // width)).select(F.col("id").alias("bucket"), F.least(F.lit(width), F.lit(hi - lo) - F.col("id") * width).alias("cells"))
    return every.join(held, "bucket", "left").select("bucket", "cells", (F.coalesce("total", F.lit(0)) / F.col("cells")).alias("mean"), F.coalesce("most", F.lit(0)).alias("most"))


def index_cost(records: int, payload_bytes: int, lo: int, hi: int | None = None, offset_bytes: int = 16, budget: int = 1 << 30, chunk_bytes: int = 64 << 20) -> Cost:
    """What records [lo, hi) of an index take: their share of the payload, and an offset each."""
    n = max(0, min(records, records if hi is None else hi) - max(0, lo))
    return cost(n, payload_bytes / max(1, records) + offset_bytes, budget, chunk_bytes)


def rows_per_chunk(bytes_per_row: float, chunk_bytes: int) -> int:
    """Rows in a chunk, from 256 to 4,194,304."""
    return int(min(4_194_304, max(256, chunk_bytes / max(bytes_per_row, 1e-9))))


def pick_level(levels: DataFrame, bytes_per_row: int, cap: int) -> DataFrame:
    """The finest level (smallest bin) whose rows fit ``cap`` bytes."""
    return levels.filter(F.col("rows") * bytes_per_row <= cap).orderBy("bin").limit(1)


@dataclass(frozen=True)
class Cost:
    """What loading a window takes, and advice."""

    units: int
    chunks: int
    resident: int
    total: int
    fits: bool
    fits_whole: bool

    @property
    def advice(self) -> str:
        if self.fits_whole:
            return "load it whole"
        return f"read it in {self.chunks} chunks" if self.fits else "zoom out or select less"


def cost(units: int, bytes_per_unit: float, budget: int, chunk_bytes: int) -> Cost:
    total = int(units * bytes_per_unit)
    chunks = max(1, -(-total // max(1, chunk_bytes)))
    resident = min(total, chunk_bytes)
    return Cost(units, chunks, resident, total, resident <= budget, total <= budget)


def occupancy_rate(cells: float, hit: float) -> float:
    """The Poisson rate per cell under which ``hit`` of ``cells`` cells are occupied: cells * (1 - exp(-rate)) = hit, by bisection."""
    import math

    if hit <= 0:
        return 0.0
    if hit >= cells:
        return math.inf
    lo, hi = 0.0, 1.0
    while cells * (1 - math.exp(-hi)) < hit:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cells * (1 - math.exp(-mid)) < hit else (lo, mid)
    return hi
