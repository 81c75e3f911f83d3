"""Point clouds on grids: rasters, histograms, density summaries, pyramids, Z-order, pooling, projections.

Everything is integer arithmetic in a projection and one hash aggregate with partial sums before the exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import range_lookup


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pixel(c: str | Column, lo: int, hi: int, size: int) -> Column:
    """Integer pixel (c - lo) * size div (hi - lo), clipped to the raster."""
    shifted = F.expr("bigint(0)") + (_c(c).cast("long") - F.lit(lo)) * F.lit(size)
    return F.greatest(F.lit(0), F.least(F.lit(size - 1), F.floor(shifted / F.lit(hi - lo)))).cast("long")


def raster(points: DataFrame, window: tuple[int, int, int, int], shape: int, x: str = "x", y: str = "y", value: str = "count") -> DataFrame:
    """Sum of values on a shape x shape raster of a half-open window: ``iy, ix, total``."""
    x0, x1, y0, y1 = window
    inside = points.filter((F.col(x) >= x0) & (F.col(x) < x1) & (F.col(y) >= y0) & (F.col(y) < y1))
    return inside.groupBy(pixel(y, y0, y1, shape).alias("iy"), pixel(x, x0, x1, shape).alias("ix")).agg(F.sum(value).cast("long").alias("total"))


def thumbnail(levels: DataFrame, bins: Sequence[int], window: tuple[int, int, int, int], shape: int) -> DataFrame:
    """A raster of a window out of a pyramid (``bin, x, y, count``): of the coarsest level that still has a bin for each pixel, else the finest."""
    size = min(window[1] - window[0], window[3] - window[2])
    fine = [b for b in bins if size // b >= shape]
    chosen = max(fine) if fine else min(bins)
    return raster(levels.filter(F.col("bin") == chosen), window, shape)


def log_scaled(image: DataFrame, value: str = "total", low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Add ``level`` from 0 to 1 for display: log1p of the value between two percentiles of the values above 0 (all 0 where these are equal)."""
    bounds = image.filter(F.col(value) > 0).agg(F.percentile(F.log1p(value), F.array(F.lit(low), F.lit(high))).alias("q"))
    lo, hi, v = F.col("q")[0], F.col("q")[1], F.log1p(F.greatest(F.col(value), F.lit(0)))
    level = F.when(hi > lo, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - lo) / (hi - lo)))).otherwise(0.0)
    return image.crossJoin(bounds).withColumn("level", F.coalesce(level, F.lit(0.0))).drop("q")  # bounds is one row


def nice_ticks(lo: float, hi: float, n: int = 5) -> list[float]:
    """About ``n`` round places within [lo, hi]: multiples of 1, 2 or 5 times a power of ten."""
    import math

    if not hi > lo:
        return [lo]
    raw = (hi - lo) / max(1, n)
    power = 10.0 ** math.floor(math.log10(raw))
    share = raw / power
    step = (1 if share < 1.5 else 2 if share < 3.5 else 5 if share < 7.5 else 10) * power
    first = math.ceil(lo / step - 1e-9)
    return [k * step for k in range(first, math.floor(hi / step + 1e-9) + 1)]


def canvas_cell(c: str | Column, lo: float, hi: float, size: int) -> Column:
    """Cell of a floating value: floor, clipped, so that the last cell is closed."""
    f = F.floor((_c(c).cast("double") - F.lit(float(lo))) / F.lit(float(hi - lo)) * F.lit(float(size)))
    return F.greatest(F.lit(0), F.least(F.lit(size - 1), f)).cast("long")


def finite(*columns: str | Column) -> Column:
    """True where every value is there and finite."""
    cond = F.lit(True)
    for c in columns:
        v = _c(c).cast("double")
        cond = cond & v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return F.coalesce(cond, F.lit(False))


def canvas(points: DataFrame, bounds: tuple[float, float, float, float], shape: tuple[int, int], x: str, y: str) -> DataFrame:
    """2-D histogram ``iy, ix, n``; null and non-finite rows light no cell."""
    x0, x1, y0, y1 = bounds
    return points.filter(finite(x, y)).groupBy(canvas_cell(y, y0, y1, shape[0]).alias("iy"), canvas_cell(x, x0, x1, shape[1]).alias("ix")).agg(F.count(F.lit(1)).alias("n"))


def canvas_summary(points: DataFrame, bounds: tuple[float, float, float, float], shape: tuple[int, int], x: str, y: str) -> DataFrame:
    """Rows drawn and dropped, cells hit, and the share of cells hit."""
    x0, x1, y0, y1 = bounds
    ok = finite(x, y)
    cell = canvas_cell(y, y0, y1, shape[0]) * shape[1] + canvas_cell(x, x0, x1, shape[1])
    per = points.groupBy(F.when(ok, cell).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    hit = F.count("cell")
    return per.agg(
        F.coalesce(F.sum(F.when(F.col("cell").isNotNull(), F.col("n"))), F.lit(0)).alias("drawn"), F.coalesce(F.sum(F.when(F.col("cell").isNull(), F.col("n"))), F.lit(0)).alias("dropped"),
        hit.alias("cells_hit"), (hit / F.lit(shape[0] * shape[1])).alias("coverage"),
    )


def density_index(points: DataFrame, extent: tuple[int, int, int, int], grid: int, x: str = "x", y: str = "y", value: str = "count") -> DataFrame:
    """Density (sum) and occupancy (rows) of each cell of a coarse grid over a half-open extent: ``gy, gx, density, occupancy``."""
    x0, x1, y0, y1 = extent
    return points.groupBy(pixel(y, y0, y1, grid).alias("gy"), pixel(x, x0, x1, grid).alias("gx")).agg(F.sum(value).cast("long").alias("density"), F.count(F.lit(1)).alias("occupancy"))


def rows_in_window(index: DataFrame, extent: tuple[int, int, int, int], grid: int, window: tuple[int, int, int, int]) -> DataFrame:
    """Estimate of the rows in a window: all rows of the cells it touches (``rows``)."""
    (ex0, ex1, ey0, ey1), (x0, x1, y0, y1) = extent, window
    cell = lambda v, lo, hi: min(grid - 1, max(0, (v - lo) * grid // (hi - lo)))
    inside = F.col("gx").between(cell(x0, ex0, ex1), cell(x1 - 1, ex0, ex1)) & F.col("gy").between(cell(y0, ey0, ey1), cell(y1 - 1, ey0, ey1))
    return index.filter(inside).agg(F.coalesce(F.sum("occupancy"), F.lit(0)).cast("long").alias("rows"))


def rebin(index: DataFrame, grid: int, target: int) -> DataFrame:
    """A coarser grid out of a density index: cell * target div grid."""
    return index.groupBy(F.expr(f"gy * {target} div {grid}").alias("gy"), F.expr(f"gx * {target} div {grid}").alias("gx")).agg(F.sum("density").cast("long").alias("density"), F.sum("occupancy").cast("long").alias("occupancy"))


def pool(image: DataFrame, y: str = "y", x: str = "x", value: str = "value", labels: bool = False) -> DataFrame:
    """Halve an image: the mean of each 2 x 2 block's cells that are there (rounded half to even), or a label's first cell."""
    keys = [F.expr(f"{y} div 2").alias("y"), F.expr(f"{x} div 2").alias("x")]
    made = F.min_by(value, F.struct(y, x)) if labels else F.bround(F.avg(value)).cast("long")
    return image.groupBy(*keys).agg(made.alias("value"))


def max_projection(voxels: DataFrame, keep: Sequence[str], value: str) -> DataFrame:
    """Largest value along the axes that aren't kept."""
    return voxels.groupBy(*keep).agg(F.max(value).alias("value"))


def aggregate_points(points: DataFrame, x: str, y: str, value: str | None = None) -> DataFrame:
    """One row a location: the sum of values, or the count without one."""
    return points.groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg((F.sum(value) if value else F.count(F.lit(1))).cast("long").alias("total"))


def spread_bits(c: Column) -> Column:
    """A 32-bit integer with a zero after each bit, by halving steps: each keeps the halves that its mask leaves."""
    c = c.cast("long")
    shift = 16
    while shift:
        group = (1 << shift) - 1
        mask = sum(group << (2 * shift * i) for i in range(64 // (2 * shift)))
        mask = mask - (1 << 64) if mask >= 1 << 63 else mask
        c = (c.bitwiseOR(F.shiftleft(c, shift))).bitwiseAND(F.lit(mask))
        shift //= 2
    return c


def morton(ix: str | Column, iy: str | Column) -> Column:
    """Z-order key of two cells: bits of ix and iy by turns, ix lowest."""
    return spread_bits(_c(ix)).bitwiseOR(F.shiftleft(spread_bits(_c(iy)), 1))


def write_z_ordered(points: DataFrame, path: str, block: int, x: str = "x", y: str = "y", files: int = 8, rows_per_file: int = 0) -> None:
    """Write points in Z-order of their blocks, so that a window touches few row groups."""
    keyed = points.withColumn("__z", morton(F.expr(f"{x} div {block}"), F.expr(f"{y} div {block}")))
    writer = keyed.repartitionByRange(files, "__z").sortWithinPartitions("__z").drop("__z").write.mode("overwrite")
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.parquet(path)


def bin_pyramid(points: DataFrame, bins: Sequence[int], x: str = "x", y: str = "y", gene: str = "gene", value: str = "count") -> DataFrame:
    """All levels at once: ``bin, gene, x, y, count`` with coordinates at the bins' low corners. Each row is copied once a level, then summed."""
    levels = points.select(gene, x, y, value, F.explode(F.array(*[F.lit(b) for b in bins])).alias("bin"))
    return levels.groupBy("bin", F.col(gene).alias("gene"), F.expr(f"{x} - {x} % bin").alias("x"), F.expr(f"{y} - {y} % bin").alias("y")).agg(F.sum(value).cast("long").alias("count"))


def gene_offsets(points: DataFrame, gene: str = "gene") -> DataFrame:
    """Each gene's first row and number of rows in a table sorted by gene. The window runs over one row a gene."""
    per = points.groupBy(F.col(gene).alias("gene")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("gene").rowsBetween(Window.unboundedPreceding, -1)
    return per.select("gene", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_row"), "n")


def gene_of_row(rows: DataFrame, offsets: DataFrame, row: str = "row") -> DataFrame:
    """Add the gene whose range of rows holds the row; null where none does. An equi-join on buckets of row numbers."""
    ranges = offsets.select("gene", F.col("first_row").alias("__first"), (F.col("first_row") + F.col("n")).alias("__end"))
    return range_lookup(rows, ranges, row, "__first", "__end").drop("__first", "__end")


def top_genes(points: DataFrame, k: int, gene: str = "gene", value: str = "count") -> DataFrame:
    """The k genes with the largest sums; ties in gene order."""
    return points.groupBy(F.col(gene).alias("gene")).agg(F.sum(value).cast("long").alias("total")).orderBy(F.desc("total"), "gene").limit(k)


def centroids(points: DataFrame, genes: DataFrame, gene: str = "gene", x: str = "x", y: str = "y", value: str = "count") -> DataFrame:
    """Total, rows and weighted centre of each wanted gene; ``absent`` marks those without a row."""
    per = points.groupBy(F.col(gene).alias("gene")).agg(F.sum(value).cast("long").alias("total"), F.count(F.lit(1)).alias("rows"), (F.sum(F.col(x) * F.col(value)) / F.sum(value)).alias("cx"), (F.sum(F.col(y) * F.col(value)) / F.sum(value)).alias("cy"))
    joined = genes.join(per, "gene", "left")
    return joined.select("gene", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("rows", F.lit(0)).alias("rows"), "cx", "cy", F.col("rows").isNull().alias("absent"))


def hit_profile(hits: DataFrame, lo: int, hi: int, buckets: int, at: str = "record") -> DataFrame:
    """Equal-width histogram over [lo, hi], the last bucket closed: ``bucket, n``."""
    b = F.least(F.lit(buckets - 1), F.floor((F.col(at) - lo) * F.lit(buckets) / F.lit(hi - lo)).cast("long"))
    return hits.filter(F.col(at).between(lo, hi)).groupBy(b.cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def extent(points: DataFrame, x: str = "x", y: str = "y", gene: str = "gene") -> DataFrame:
    """Half-open bounds, rows and distinct genes."""
    return points.agg(F.min(x).alias("x0"), (F.max(x) + 1).alias("x1"), F.min(y).alias("y0"), (F.max(y) + 1).alias("y1"), F.count(F.lit(1)).alias("rows"), F.count_distinct(gene).alias("genes"))
