"""A window on a table: select, pan, zoom, and read at a stride. Moving it is arithmetic on the driver; reading it is one lazy plan."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cost import Cost, cost


@dataclass(frozen=True)
class WindowedFrame:
    """``frame`` with an axis column for each dimension, half-open integer ``extent`` and ``window`` per axis, and a zoom level.

    Rows of the first axis are kept where (place - window start) is a multiple of 2 ** zoom.
    """

    frame: DataFrame
    axes: tuple[str, ...]
    extent: tuple[tuple[int, int], ...]
    window: tuple[tuple[int, int], ...]
    level: int = 0
    bytes_per_row: float = 64.0

    @classmethod
    def over(cls, frame: DataFrame, *axes: str, bytes_per_row: float = 64.0) -> WindowedFrame:
        """A view of all of ``frame``; the extent comes from one aggregate."""
        r = frame.agg(*[f(a).alias(f"{n}{i}") for i, a in enumerate(axes) for n, f in (("lo", F.min), ("hi", F.max))]).first()
        extent = tuple((int(r[f"lo{i}"]), int(r[f"hi{i}"]) + 1) for i in range(len(axes)))
        return cls(frame, axes, extent, extent, 0, bytes_per_row)

    @property
    def stride(self) -> int:
        return 1 << max(0, self.level)

    def _clamped(self, window: Sequence[tuple[int, int]]) -> tuple[tuple[int, int], ...]:
        out = []
        for (lo, hi), (elo, ehi) in zip(window, self.extent, strict=True):
            lo = min(max(int(lo), elo), ehi - 1)
            out.append((lo, min(max(int(hi), lo + 1), ehi)))
        return tuple(out)

    def select(self, *bounds: tuple[int, int]) -> WindowedFrame:
        """The window, held inside the extent and never empty."""
        return replace(self, window=self._clamped(bounds))

    def select_fraction(self, *bounds: tuple[float, float]) -> WindowedFrame:
        return self.select(*[(lo + f0 * (hi - lo), lo + f1 * (hi - lo)) for (f0, f1), (lo, hi) in zip(bounds, self.extent, strict=True)])

    def reset(self) -> WindowedFrame:
        return replace(self, window=self.extent, level=0)

    def pan(self, *shift: float) -> WindowedFrame:
        """Move by shares of the window's size, stopping at the extent's edges."""
        return replace(self, window=tuple(self._placed(lo + s * (hi - lo), hi - lo, e) for s, (lo, hi), e in zip(shift, self.window, self.extent, strict=True)))

    @staticmethod
    def _placed(lo: float, size: int, extent: tuple[int, int]) -> tuple[int, int]:
        size = min(size, extent[1] - extent[0])
        at = int(min(max(lo, extent[0]), extent[1] - size))
        return at, at + size

    def zoom_in(self, factor: float = 2.0, center: Sequence[float] | None = None, constant_cost: bool = True) -> WindowedFrame:
        """Scale the window about its centre; with ``constant_cost`` the level follows the size actually reached."""
        window, moved = [], 0.0
        for i, ((lo, hi), e) in enumerate(zip(self.window, self.extent, strict=True)):
            size = max(1, min(round((hi - lo) / factor), e[1] - e[0]))
            mid = (lo + hi) / 2 if center is None else center[i]
            window.append(self._placed(mid - size / 2, size, e))
            moved = max(moved, (hi - lo) / size, key=lambda r: abs(r - 1)) if moved else (hi - lo) / size
        steps = 0
        while constant_cost and moved >= 2 ** (steps + 1) - 1e-9:
            steps += 1
        while constant_cost and moved <= 2 ** (steps - 1) + 1e-9 and moved < 1:
            steps -= 1
        return replace(self, window=tuple(window), level=self.level - steps)

    def zoom_out(self, factor: float = 2.0, center: Sequence[float] | None = None, constant_cost: bool = True) -> WindowedFrame:
        return self.zoom_in(1 / factor, center, constant_cost)

    def at_level(self, level: int) -> WindowedFrame:
        return replace(self, level=level)

    def load(self) -> DataFrame:
        """The window's rows at its stride, as a lazy plan."""
        cond = F.lit(True)
        for a, (lo, hi) in zip(self.axes, self.window, strict=True):
            cond = cond & (F.col(a) >= lo) & (F.col(a) < hi)
        out = self.frame.filter(cond)
        if self.stride > 1:
            out = out.filter(F.pmod(F.col(self.axes[0]) - self.window[0][0], F.lit(self.stride)) == 0)
        return out

    def units(self) -> int:
        """An estimate of the rows in the window, from its share of the first axis."""
        lo, hi = self.window[0]
        return -(-(hi - lo) // self.stride)

    def cost(self, budget: int, chunk_bytes: int = 64 << 20) -> Cost:
        return cost(self.units(), self.bytes_per_row, budget, chunk_bytes)

    def auto_zoom(self, budget: int, chunk_bytes: int = 64 << 20) -> WindowedFrame:
        """The finest level whose load takes at most 0.8 of the budget; an error names the cheapest if none does."""
        for level in range(0, 63):
            view = self.at_level(level)
            if view.cost(budget, chunk_bytes).total <= 0.8 * budget:
                return view
            if view.units() <= 1:
                break
        raise MemoryError(f"even level {level} takes {view.cost(budget).total} bytes")

    def chunks(self) -> Iterator[list]:
        """The same rows as :meth:`load`, a partition at a time on the driver, in the order of the first axis."""
        held: list = []
        for row in self.load().repartitionByRange(self.axes[0]).sortWithinPartitions(self.axes[0]).toLocalIterator(prefetchPartitions=False):
            held.append(row)
            if len(held) == 4096:
                yield held
                held = []
        if held:
            yield held

    def overview(self, value: str, buckets: int = 64) -> DataFrame:
        """Bucket, rows, mean and largest of a value along the first axis of the window."""
        lo, hi = self.window[0]
        per = max(1, -(-(hi - lo) // buckets))
        inside = replace(self, level=0).load()
        return inside.groupBy(F.expr(f"({self.axes[0]} - {lo}) div {per}").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("high"))
