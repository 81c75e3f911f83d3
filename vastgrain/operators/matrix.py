"""Sparse matrices as (cell, gene, value) rows: quality control, filters, normalisation, variable genes, PCA."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored

MITO = ("MT-", "mt-")
RIBO = ("RPS", "RPL", "Rps", "Rpl")


def coo(entries: DataFrame, cell: str, gene: str, value: str) -> DataFrame:
    """The canonical form: duplicates summed."""
    return entries.groupBy(F.col(cell).alias("cell"), F.col(gene).alias("gene")).agg(F.sum(value).alias("value"))


def _starts(name: Column, prefixes: Sequence[str]) -> Column:
    cond = F.lit(False)
    for p in prefixes:
        cond = cond | name.startswith(p)
    return F.coalesce(cond, F.lit(False))


def qc_cells(matrix: DataFrame, genes: DataFrame, mito: Sequence[str] = MITO, ribo: Sequence[str] = RIBO) -> DataFrame:
    """Per cell: ``total, n_genes, pct_mito, pct_ribo`` (0 when the total is 0). ``genes`` has ``gene, name``."""
    named = matrix.join(genes.select("gene", _starts(F.col("name"), mito).alias("m"), _starts(F.col("name"), ribo).alias("r")), "gene", "left")
    per = named.groupBy("cell").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n_genes"), F.sum(F.when(F.col("m"), F.col("value"))).alias("mito"), F.sum(F.when(F.col("r"), F.col("value"))).alias("ribo"))
    pct = lambda c: F.when(F.col("total") > 0, 100.0 * F.coalesce(c, F.lit(0.0)) / F.col("total")).otherwise(0.0)
    return per.select("cell", "total", "n_genes", pct(F.col("mito")).alias("pct_mito"), pct(F.col("ribo")).alias("pct_ribo"))


def normalised(matrix: DataFrame, target: float = 1e4) -> DataFrame:
    """Add ``norm`` (value * target / the cell's total) and ``logged`` (log1p of it)."""
    totals = matrix.groupBy("cell").agg(F.sum("value").alias("__total"))
    joined = matrix.join(totals, "cell").filter(F.col("__total") > 0)
    return joined.withColumn("norm", F.col("value") * F.lit(target) / F.col("__total")).withColumn("logged", F.log1p("norm")).drop("__total")


def qc_genes(matrix: DataFrame, target: float = 1e4) -> DataFrame:
    """Per gene: cells, total, and sums of normalised and logged values and of their squares."""
    return normalised(matrix, target).groupBy("gene").agg(
        F.count(F.lit(1)).alias("n_cells"), F.sum("value").alias("total"), F.sum("norm").alias("s_norm"), F.sum(F.col("norm") * F.col("norm")).alias("ss_norm"),
        F.sum("logged").alias("s_log"), F.sum(F.col("logged") * F.col("logged")).alias("ss_log"),
    )


def filter_cells(qc: DataFrame, min_counts: float = 0, min_genes: int = 0, max_pct_mito: float = 100.0, max_counts: float | None = None) -> DataFrame:
    """Add ``kept``; all bounds are inclusive."""
    cond = (F.col("total") >= min_counts) & (F.col("n_genes") >= min_genes) & (F.col("pct_mito") <= max_pct_mito)
    return qc.withColumn("kept", cond if max_counts is None else cond & (F.col("total") <= max_counts))


def filter_genes(qc: DataFrame, min_cells: int = 1) -> DataFrame:
    return qc.withColumn("kept", F.col("n_cells") >= min_cells)


def variable_genes(qc: DataFrame, n_cells: int, n_top: int = 2000, n_bins: int = 20) -> DataFrame:
    """The genes with the largest dispersion for their mean: ``gene, mean, dispersion, z, rank``.

    Log of (sample variance / mean), in equal-width bins of log1p(mean), scaled within the bin by mean and sample
    deviation (a bin of one gives 0; deviation 0 counts as 1); ties by gene. Zeros count, as ``n_cells`` holds all cells.
    """
    mean = F.col("s_norm") / n_cells
    var = (F.col("ss_norm") / n_cells - mean * mean) * (n_cells / max(1, n_cells - 1))
    stats = qc.select("gene", mean.alias("mean"), var.alias("var")).filter("mean > 0 and var > 0").select("gene", "mean", F.log(F.col("var") / F.col("mean")).alias("dispersion"), F.log1p("mean").alias("lm"))
    ends = stats.agg(F.min("lm").alias("lo"), F.max("lm").alias("hi"))
    width = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("lm") - F.col("lo")) / (F.col("hi") - F.col("lo")) * n_bins)).otherwise(0)
    binned = stats.crossJoin(F.broadcast(ends)).withColumn("bin", F.least(F.lit(n_bins - 1), width))  # ends is one row
    per = binned.groupBy("bin").agg(F.avg("dispersion").alias("m"), F.stddev_samp("dispersion").alias("s"), F.count(F.lit(1)).alias("k"))
    dev = F.when(F.coalesce("s", F.lit(0.0)) == 0, 1.0).otherwise(F.col("s"))
    z = F.when(F.col("k") == 1, 0.0).otherwise((F.col("dispersion") - F.col("m")) / dev)
    scored = binned.join(F.broadcast(per), "bin").select("gene", "mean", "dispersion", z.alias("z"))  # n_bins rows
    top = scored.orderBy(F.desc("z"), "gene").limit(n_top)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("z"), "gene")))  # at most n_top rows


def totals(cells: DataFrame, matrix: DataFrame, cell: str = "cell") -> DataFrame:
    """Sum per cell, 0 for cells without an entry."""
    per = matrix.groupBy("cell").agg(F.sum("value").alias("total"))
    return cells.select(F.col(cell).alias("cell")).join(per, "cell", "left").select("cell", F.coalesce("total", F.lit(0.0)).alias("total"))


def modality_split(features: DataFrame, index: str = "index", kind: str = "feature_type") -> DataFrame:
    """Each modality's rows: first, last, count, and whether they are one unbroken range."""
    per = features.groupBy(F.col(kind).alias("modality")).agg(F.min(index).alias("first"), F.max(index).alias("last"), F.count(F.lit(1)).alias("n"))
    return per.withColumn("contiguous", F.col("last") - F.col("first") + 1 == F.col("n"))


def greedy_bounds(sizes: Sequence[int], most: int) -> list[tuple[int, int]]:
    """Cut rows into blocks of at most ``most`` bytes; a single larger row is a block of its own."""
    out, begin, held = [], 0, 0
    for i, s in enumerate(sizes):
        if i > begin and held + s > most:
            out.append((begin, i))
            begin, held = i, 0
        held += s
    if begin < len(sizes):
        out.append((begin, len(sizes)))
    return out


#: Rows of a Gram matrix that are summed together, and ways its parts are spread in the first step.
GRAM_ROWS, GRAM_WAYS = 64, 32


def _sum_blocks(frame: pd.DataFrame, *keys: str) -> pd.DataFrame:
    total = np.frombuffer(frame["g"].iloc[0]).copy()
    for g in frame["g"].iloc[1:]:
        total += np.frombuffer(g)
    return pd.DataFrame({**{k: [int(frame[k].iloc[0])] for k in keys}, "g": [total.tobytes()]})


def sum_grams(parts: DataFrame) -> dict[int, np.ndarray]:
    """Blocks of rows of a Gram matrix (``block, way, g``), summed in two steps on the executors, so that no task meets every partition's part."""
    some = parts.groupBy("block", "way").applyInPandas(lambda f: _sum_blocks(f, "block", "way"), "block int, way int, g binary")
    whole = some.groupBy("block").applyInPandas(lambda f: _sum_blocks(f, "block"), "block int, g binary")
    return {r["block"]: np.frombuffer(r["g"]) for r in whole.collect()}  # one matrix, bounded by the chosen genes


def pca(matrix: DataFrame, genes: Sequence, means: Sequence[float], deviations: Sequence[float], n_cells: int, n_comps: int, max_value: float = 10.0) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """Exact PCA of scaled, clipped values of chosen genes: (components, variances, scores DataFrame ``cell, pcs``).

    ``matrix`` has ``cell, gene, logged`` and is dealt by cell; absent entries count as scaled zeros. It is read twice, so it is
    stored first. The driver holds one Gram matrix of the chosen genes.
    """
    order = {g: i for i, g in enumerate(genes)}
    mu, sd = np.asarray(means, float), np.asarray(deviations, float)
    sd = np.where(sd == 0, 1.0, sd)
    zero = np.clip(-mu / sd, -max_value, max_value)
    k = len(order)

    def rows(frame: pd.DataFrame) -> tuple[list, np.ndarray]:
        cells, code = np.unique(frame["cell"].to_numpy(), return_inverse=True)
        dense = np.tile(zero, (len(cells), 1))
        g = frame["gene"].map(order)
        ok = g.notna().to_numpy()
        j = g[ok].astype(int).to_numpy()
        dense[code[ok], j] = np.clip((frame["logged"].to_numpy()[ok] - mu[j]) / sd[j], -max_value, max_value)
        return list(cells), dense

    def whole_cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None  # a cell may go on in the next batch
        for f in frames:
            f = f if held is None else pd.concat([held, f], ignore_index=True)
            if not len(f):
                continue
            tail = f["cell"] == f["cell"].iloc[-1]
            held = f[tail]
            if (~tail).any():
                yield f[~tail]
        if held is not None and len(held):
            yield held

    def gram(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        way, g = TaskContext.get().partitionId() % GRAM_WAYS, np.zeros((k + 1, k + 1))
        for f in whole_cells(frames):
            d = rows(f)[1]
            d = np.hstack([d, np.ones((len(d), 1))])  # its last row sums the columns and counts the cells
            g += d.T @ d
        for block, at in enumerate(range(0, k + 1, GRAM_ROWS)):
            yield pd.DataFrame({"block": [block], "way": [way], "g": [g[at : at + GRAM_ROWS].tobytes()]})

    chosen = stored(matrix.select("cell", "gene", "logged"), "chosen").repartition("cell").sortWithinPartitions("cell")
    blocks = sum_grams(chosen.mapInPandas(gram, "block int, way int, g binary"))
    whole = np.concatenate([blocks[b] for b in sorted(blocks)]).reshape(k + 1, k + 1) if blocks else np.zeros((k + 1, k + 1))
    g, s, n = whole[:k, :k].copy(), whole[k, :k].copy(), int(whole[k, k])
    missing = n_cells - n  # cells without any entry
    g += missing * np.outer(zero, zero)
    s += missing * zero
    centre = s / n_cells
    covariance = (g - n_cells * np.outer(centre, centre)) / max(1, n_cells - 1)
    values, vectors = np.linalg.eigh(covariance)
    best = np.argsort(values)[::-1][:n_comps]
    components = vectors[:, best].T
    sign = np.sign(components[np.arange(len(best)), np.abs(components).argmax(1)])
    components *= sign[:, None]

    def project(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in whole_cells(frames):
            cells, d = rows(f)
            yield pd.DataFrame({"cell": cells, "pcs": list((d - centre) @ components.T)})

    kind = matrix.schema["cell"].dataType.simpleString()
    return components, values[best], chosen.mapInPandas(project, f"cell {kind}, pcs array<double>")
