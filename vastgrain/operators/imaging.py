"""Images and volumes as (y, x, value) rows: tiles, pyramids, two modalities on one grid, orientation, screen transforms."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .grid import pixel, pool


def tile_windows(spark: SparkSession, height: int, width: int, tile: int, overlap: int = 0) -> DataFrame:
    """``ty, tx, y0, y1, x0, x1``: a grid of tiles, each widened by ``overlap`` and cut at the image's edges. Tiles of under 16 pixels are an error."""
    if tile < 16:
        raise ValueError("a tile is at least 16 pixels")
    ys, xs = -(-height // tile), -(-width // tile)
    grid = spark.range(ys * xs).select(F.expr(f"cast(id div {xs} as int)").alias("ty"), F.expr(f"cast(id % {xs} as int)").alias("tx"))
    low = lambda t: F.greatest(F.lit(0), F.col(t) * tile - overlap)
    high = lambda t, n: F.least(F.lit(n), (F.col(t) + 1) * tile + overlap)
    return grid.select("ty", "tx", low("ty").alias("y0"), high("ty", height).alias("y1"), low("tx").alias("x0"), high("tx", width).alias("x1"))


def tiles_touched(window: tuple[int, int, int, int], tile: int) -> int:
    """Tiles a window decodes, whole: (x0, x1, y0, y1)."""
    x0, x1, y0, y1 = window
    return max(0, -(-x1 // tile) - x0 // tile) * max(0, -(-y1 // tile) - y0 // tile)


def image_pyramid(image: DataFrame, levels: int, labels: bool = False) -> DataFrame:
    """``level, y, x, value``: each level halves the one before (mean of what is there, or a label's first cell)."""
    current = image.select(F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col("value").cast("long").alias("value"))
    out = current.withColumn("level", F.lit(0))
    for k in range(1, levels):
        current = pool(current, labels=labels)
        out = out.unionByName(current.withColumn("level", F.lit(k)))
    return out.select("level", "y", "x", "value")


def paired(points: DataFrame, image: DataFrame, window: tuple[int, int, int, int], shape: int, scale: float, origin: tuple[float, float] = (0.0, 0.0), value: str = "count") -> DataFrame:
    """Expression and image on one shape x shape grid: ``iy, ix, total, value``.

    Points are summed per cell; the image pixel under a cell's centre is origin + scale * place. The lattice has shape^2 rows.
    """
    x0, x1, y0, y1 = window
    spark = points.sparkSession
    cells = spark.range(shape * shape).select(F.expr(f"id div {shape}").alias("iy"), F.expr(f"id % {shape}").alias("ix"))
    at = lambda i, lo, hi, o: F.floor(F.lit(float(o)) + F.lit(float(scale)) * (F.lit(float(lo)) + (F.col(i) + 0.5) * F.lit((hi - lo) / shape))).cast("long")
    lattice = cells.select("iy", "ix", at("iy", y0, y1, origin[1]).alias("y"), at("ix", x0, x1, origin[0]).alias("x"))
    inside = points.filter((F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1))
    sums = inside.groupBy(pixel("y", y0, y1, shape).alias("iy"), pixel("x", x0, x1, shape).alias("ix")).agg(F.sum(value).cast("long").alias("total"))
    sampled = lattice.join(image.select(F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), "value"), ["y", "x"], "left").select("iy", "ix", "value")
    return sampled.join(sums, ["iy", "ix"], "left").select("iy", "ix", F.coalesce("total", F.lit(0)).alias("total"), "value")


def axis_codes(directions: np.ndarray) -> str:
    """Anatomical letters of three direction columns in LPS: the largest part of each column names its axis, L/R, P/A or S/I."""
    out = []
    for column in np.asarray(directions, float).T:
        k = int(np.abs(column).argmax())
        out.append(("LR", "PA", "SI")[k][0 if column[k] > 0 else 1])
    return "".join(out)


@dataclass(frozen=True)
class Camera:
    """World to screen, keeping the aspect."""

    cx: float
    cy: float
    scale: float
    width: int
    height: int

    @classmethod
    def fit(cls, extent: tuple[float, float, float, float], width: int, height: int) -> Camera:
        x0, x1, y0, y1 = extent
        return cls((x0 + x1) / 2, (y0 + y1) / 2, min(width / max(x1 - x0, 1e-12), height / max(y1 - y0, 1e-12)), width, height)

    def to_pixel(self, x: float, y: float) -> tuple[float, float]:
        return (x - self.cx) * self.scale + self.width / 2, (y - self.cy) * self.scale + self.height / 2

    def to_world(self, px: float, py: float) -> tuple[float, float]:
        return (px - self.width / 2) / self.scale + self.cx, (py - self.height / 2) / self.scale + self.cy

    def zoom(self, factor: float, at: tuple[float, float] | None = None) -> Camera:
        """Scale about a pixel, whose world place stays put."""
        px, py = at or (self.width / 2, self.height / 2)
        wx, wy = self.to_world(px, py)
        s = self.scale * factor
        return replace(self, scale=s, cx=wx - (px - self.width / 2) / s, cy=wy - (py - self.height / 2) / s)

    def pan(self, dx: float, dy: float) -> Camera:
        return replace(self, cx=self.cx - dx / self.scale, cy=self.cy - dy / self.scale)

    def visible(self) -> tuple[float, float, float, float]:
        (x0, y0), (x1, y1) = self.to_world(0, 0), self.to_world(self.width, self.height)
        return x0, x1, y0, y1


def choose_level(costs: Sequence[float], cap: float, current: int | None, slack: float = 0.7) -> int:
    """The finest level (smallest index) that fits ``cap``, with hysteresis: finer than the current one only with slack, coarser only when it no longer fits."""
    fits = [i for i, c in enumerate(costs) if c <= cap]
    best = fits[0] if fits else len(costs) - 1
    if current is None:
        return best
    if costs[current] > cap:
        return best
    roomy = [i for i, c in enumerate(costs) if c <= cap * slack]
    return min(current, roomy[0]) if roomy else current


def replay_session(events: Sequence[tuple[str, tuple]], extent: tuple[float, float, float, float], width: int, height: int, margin: float = 0.25) -> list[tuple[str, bool, tuple]]:
    """What a viewer does over a session: after each event (``pan``, ``zoom``, ``fit``) whether it reloads, and the region held.

    A region is held with a margin; a view inside it is served from memory.
    """
    camera, held, out = Camera.fit(extent, width, height), None, []
    for kind, args in events:
        camera = camera.pan(*args) if kind == "pan" else camera.zoom(*args) if kind == "zoom" else Camera.fit(extent, width, height)
        x0, x1, y0, y1 = camera.visible()
        need = held is None or not (held[0] <= x0 and x1 <= held[1] and held[2] <= y0 and y1 <= held[3])
        if need:
            mx, my = (x1 - x0) * margin, (y1 - y0) * margin
            held = (x0 - mx, x1 + mx, y0 - my, y1 + my)
        out.append((kind, need, held))
    return out
