"""The preprocessing pipeline end to end, and table-shaped helpers around matrices."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import joins as J
from . import matrix as M


def prep(matrix: DataFrame, genes: DataFrame, path: str, min_counts: float = 0, min_genes: int = 0, max_pct_mito: float = 100.0, min_cells: int = 1, n_top: int = 2000, n_comps: int = 50, max_value: float = 10.0, mito: Sequence[str] = M.MITO, ribo: Sequence[str] = M.RIBO) -> dict:
    """Quality control, filters, normalisation, variable genes, PCA; writes ``obs``, ``var``, ``pca`` and ``prep`` (JSON) and returns the summary.

    Variable genes are chosen over all cells of the first pass; components over the kept ones.
    """
    spark = matrix.sparkSession
    M.filter_cells(M.qc_cells(matrix, genes, mito, ribo), min_counts, min_genes, max_pct_mito).write.mode("overwrite").parquet(f"{path}/obs")
    obs = spark.read.parquet(f"{path}/obs")
    M.filter_genes(M.qc_genes(matrix), min_cells).write.mode("overwrite").parquet(f"{path}/genes")
    qc = spark.read.parquet(f"{path}/genes")
    n = obs.count()
    top = M.variable_genes(qc.filter("kept"), n, n_top)
    qc.join(top.select("gene", "z", "rank"), "gene", "left").write.mode("overwrite").parquet(f"{path}/var")
    var = spark.read.parquet(f"{path}/var")
    kept = obs.filter("kept").select("cell")
    chosen = var.filter("rank is not null").select("gene")
    logged = M.normalised(matrix).join(kept, "cell", "left_semi").join(chosen, "gene")
    n_kept = kept.count()
    stats = logged.groupBy("gene").agg(F.sum("logged").alias("s"), F.sum(F.col("logged") * F.col("logged")).alias("ss")).orderBy("gene").collect()  # a row a chosen gene
    means = [r["s"] / n_kept for r in stats]
    devs = [(max(0.0, r["ss"] / n_kept - m * m) * n_kept / max(1, n_kept - 1)) ** 0.5 for r, m in zip(stats, means, strict=True)]
    _, variances, scores = M.pca(logged, [r["gene"] for r in stats], means, devs, n_kept, min(n_comps, len(stats)), max_value)
    scores.write.mode("overwrite").parquet(f"{path}/pca")
    summary = {"cells": n, "kept": n_kept, "genes": len(stats), "variances": [float(v) for v in variances]}
    spark.createDataFrame([(json.dumps(summary),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/prep")
    return summary


def write_by_cell(matrix: DataFrame, path: str, files: int = 8) -> None:
    """A matrix laid out by cell: duplicates summed, cells in ranges, genes sorted within."""
    M.coo(matrix, "cell", "gene", "value").repartitionByRange(files, "cell").sortWithinPartitions("cell", "gene").write.mode("overwrite").parquet(path)


def decode_categorical(codes: DataFrame, categories: DataFrame, code: str = "code") -> DataFrame:
    """Codes become their category's text; -1 is missing. ``categories`` (``code, label``) is a dimension."""
    return codes.join(categories.withColumnRenamed("label", "value"), code, "left").withColumn("value", F.when(F.col(code) >= 0, F.col("value"))).drop(code)


def checkpoint_before(wanted: DataFrame, checkpoints: DataFrame, at: str = "record") -> DataFrame:
    """The last checkpoint (``start, offset``) at or before each record; null where there is none.

    A checkpoint holds up to the next one, so this is a look-up in ranges. The window runs over the checkpoints of one index.
    """
    after = F.lead("start").over(Window.orderBy("start"))
    top = wanted.agg(F.max(at)).first()[0]
    ranges = checkpoints.select("start", "offset", F.coalesce(after, F.greatest(F.col("start"), F.lit(top).cast("long")) + 1).alias("__end"))
    return J.range_lookup(wanted.select(at).distinct(), ranges, at, "start", "__end").drop("__end")


def harmonise_long(table: DataFrame, gene_col: str, genes: DataFrame, key: str = "symbol") -> DataFrame:
    """A long table with ``gene_<key>``: names resolved through the gene map, unknown ones kept where they look like a symbol."""
    resolved = J.with_fallback(J.resolve(table, genes, gene_col, key), gene_col)
    return resolved.withColumn(f"gene_{key}", F.col("canonical")).drop("found", "candidates", "canonical")


def harmonise_wide(table: DataFrame, known: dict[str, str]) -> DataFrame:
    """A wide table with gene columns renamed by ``known``; names that clash get ``__2``, ``__3``."""
    seen: dict[str, int] = {}
    out = []
    for c in table.columns:
        to = known.get(c.upper(), c)
        seen[to] = seen.get(to, 0) + 1
        out.append(to if seen[to] == 1 else f"{to}__{seen[to]}")
    return table.toDF(*out)


def is_wide(columns: Sequence[str], gene_like) -> bool:
    """At least 20 gene-shaped columns, or at least 5 columns of which half are."""
    n = sum(map(gene_like, columns))
    return n >= 20 or (len(columns) >= 5 and n >= len(columns) / 2)
