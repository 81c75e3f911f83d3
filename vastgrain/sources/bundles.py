"""Bundles of a spatial run, opened as tables: matrix, features, barcodes, positions, transcripts, cells.

A bundle is a folder whose files go by known names. Tables that Spark reads itself stay lazy; matrices come from the
container sources.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .containers import open_matrix

# Columns of a positions table without a header.
POSITIONS = "barcode string, in_tissue int, array_row int, array_col int, pxl_row_in_fullres double, pxl_col_in_fullres double"


def _there(folder: str, names: Sequence[str]) -> str | None:
    """The first of some names that a folder has."""
    return next((os.path.join(folder, n) for n in names if os.path.exists(os.path.join(folder, n))), None)


def _named(what: str, path: str | None, folder: str) -> str:
    if path is None:
        raise FileNotFoundError(f"{folder} has no {what}")
    return path


@dataclass
class Bundle:
    """Where a run's files lie, and its tables."""

    spark: SparkSession
    path: str
    root: str = ""
    bins: list[int] = field(default_factory=list)

    @property
    def matrix_path(self) -> str:
        names = [f"{kind}_feature_bc_matrix{end}" for end in (".h5", "") for kind in ("filtered", "raw")]
        return _named("feature-barcode matrix", _there(self.root, [*names, "cell_feature_matrix.h5", "cell_feature_matrix"]), self.root)

    def matrix(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(entries ``cell, gene, value``, cells ``cell, name``, genes ``gene, name``)."""
        return open_matrix(self.spark, self.matrix_path)


@dataclass
class Visium(Bundle):
    """A Space Ranger folder; with binned outputs, one of its bin sizes."""

    def scale(self) -> dict[str, float]:
        path = _there(os.path.join(self.root, "spatial"), ["scalefactors_json.json"])
        if path is None:
            return {}
        with open(path) as f:
            return json.load(f)

    def positions(self) -> DataFrame:
        """``barcode, in_tissue, array_row, array_col, pxl_row_in_fullres, pxl_col_in_fullres``, of CSV with or without a header, or Parquet."""
        folder = os.path.join(self.root, "spatial")
        path = _named("tissue positions", _there(folder, ["tissue_positions.parquet", "tissue_positions.csv", "tissue_positions_list.csv"]), folder)
        if path.endswith(".parquet"):
            return self.spark.read.parquet(path)
        with open(path) as f:
            header = f.readline().split(",")[0].strip().strip('"') == "barcode"
        return self.spark.read.schema(POSITIONS).option("header", header).csv(path)

    def extent(self) -> DataFrame:
        """Half-open ``x0, x1, y0, y1`` in pixels of the full image."""
        low = lambda c: F.floor(F.min(c)).cast("long")
        high = lambda c: (F.floor(F.max(c)) + 1).cast("long")
        x, y = "pxl_col_in_fullres", "pxl_row_in_fullres"
        return self.positions().agg(low(x).alias("x0"), high(x).alias("x1"), low(y).alias("y0"), high(y).alias("y1"))

    def cells_in(self, window: tuple[float, float, float, float]) -> DataFrame:
        """``cell, name`` of the spots whose centre lies in a half-open window (x0, x1, y0, y1)."""
        x0, x1, y0, y1 = window
        x, y = F.col("pxl_col_in_fullres"), F.col("pxl_row_in_fullres")
        inside = self.positions().filter((x >= x0) & (x < x1) & (y >= y0) & (y < y1)).select(F.col("barcode").alias("name"))
        return self.matrix()[1].join(inside, "name", "left_semi").select("cell", "name")

    def image(self, which: str = "hires") -> str | None:
        return _there(os.path.join(self.root, "spatial"), [f"tissue_{which}_image.{e}" for e in ("png", "tif", "tiff")])


@dataclass
class Xenium(Bundle):
    """A Xenium folder: molecules with a place and a quality, and cells."""

    def transcripts(self, min_quality: float = 0.0, genes: Sequence[str] | None = None) -> DataFrame:
        """Molecules with ``gene, x, y`` and the file's columns. Filters reach the scan."""
        table = self.spark.read.parquet(_named("transcripts", _there(self.root, ["transcripts.parquet"]), self.root))
        if min_quality > 0:
            table = table.filter(F.col("qv") >= min_quality)
        if genes is not None:
            wanted = [g.encode() for g in genes] if table.schema["feature_name"].dataType.simpleString() == "binary" else list(genes)
            table = table.filter(F.col("feature_name").isin(*wanted))
        return table.withColumn("gene", F.col("feature_name").cast("string")).withColumn("x", F.col("x_location")).withColumn("y", F.col("y_location"))

    def cells(self) -> DataFrame:
        path = _named("cells table", _there(self.root, ["cells.parquet", "cells.csv.gz", "cells.csv"]), self.root)
        return self.spark.read.parquet(path) if path.endswith(".parquet") else self.spark.read.option("inferSchema", True).csv(path, header=True)

    def boundaries(self, what: str = "cell") -> DataFrame:
        """Vertices of cell or nucleus outlines."""
        return self.spark.read.parquet(_named(f"{what} boundaries", _there(self.root, [f"{what}_boundaries.parquet"]), self.root))


def open_visium(spark: SparkSession, path: str, bin_um: int | None = None) -> Visium:
    """A Visium folder; of binned outputs the size nearest to ``bin_um``, the coarsest by default."""
    path = path.removeprefix("file://").rstrip("/")
    binned = os.path.join(path, "binned_outputs")
    found = {int(m[1]): name for name in (os.listdir(binned) if os.path.isdir(binned) else []) if (m := re.fullmatch(r"square_0*(\d+)um", name))}
    bins = sorted(found)
    root = os.path.join(binned, found[min(bins, key=lambda b: abs(b - (bin_um or bins[-1])))]) if bins else path
    bundle = Visium(spark, path, root, bins)
    _ = bundle.matrix_path  # refused now rather than later
    return bundle


def open_xenium(spark: SparkSession, path: str) -> Xenium:
    path = path.removeprefix("file://").rstrip("/")
    bundle = Xenium(spark, path, path)
    _named("transcripts", _there(path, ["transcripts.parquet"]), path)
    return bundle
