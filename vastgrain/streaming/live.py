"""Streaming forms of incremental operators. Each equals its batch form over the same files once all are read."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..operators import grid as G
from ..operators.text import trigrams


def read_log(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """A growing folder of JSON-lines files; torn or foreign lines are dropped."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    return lines.select(F.from_json("value", schema).alias("r")).filter("r is not null").select("r.*")


def live_canvas(points: DataFrame, bounds: tuple[float, float, float, float], shape: tuple[int, int], x: str, y: str) -> DataFrame:
    """The progressive histogram: cells updated with each batch (update or complete mode). State is one row a cell."""
    return G.canvas(points, bounds, shape, x, y)


def live_hops(events: DataFrame, ts: str, value: str, span: str, stride: str, late: str) -> DataFrame:
    """Hopping-window features with a watermark; state older than ``late`` is dropped."""
    w = F.window(ts, span, stride)
    return events.withWatermark(ts, late).groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("high")).select(F.col("w.start").alias("start"), "n", "mean", "high")


def live_sessions(events: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    """Session windows per key."""
    return events.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("s")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def live_trigrams(lines: DataFrame, path: str, checkpoint: str, block_lines: int = 64) -> StreamingQuery:
    """Index appended lines (``line, text``): each batch's postings are appended; a reader takes distinct ones."""

    def add(batch: DataFrame, epoch: int) -> None:
        batch.select(F.expr(f"line div {block_lines}").alias("block"), F.explode(trigrams(F.col("text"))).alias("trigram")).distinct().write.mode("append").parquet(path)

    return lines.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


STATUSES = ("open", "described", "searched", "in-review", "confirmed", "refuted", "resolved")


def advance(now: str | None, to: str) -> str:
    """A status moves on its own only forward along open, described, searched; the review's own statuses are set as told."""
    if now is None or to not in STATUSES[:3]:
        return to
    if now not in STATUSES[:3]:
        return now
    return max(now, to, key=STATUSES.index)


class StatusMachine(StatefulProcessor):
    """Keeps each record's status over a stream of ``id, line, status``."""

    def init(self, handle) -> None:
        self.state = handle.getValueState("status", T.StructType([T.StructField("status", T.StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        now = self.state.get()[0] if self.state.exists() else None
        for f in rows:
            for to in f.sort_values("line")["status"]:
                now = advance(now, to)
        self.state.update((now,))
        yield pd.DataFrame({"id": [key[0]], "status": [now]})

    def close(self) -> None:
        pass


def live_status(events: DataFrame) -> DataFrame:
    kind = events.schema["id"].dataType.simpleString()
    return events.groupBy("id").transformWithStateInPandas(StatusMachine(), f"id {kind}, status string", "Update", "None")


def fold_status(events: DataFrame) -> DataFrame:
    """The batch form of :func:`live_status`, as one aggregate: the last status a review set, else the furthest automatic one."""
    automatic = F.array_position(F.array(*[F.lit(s) for s in STATUSES[:3]]), F.col("status"))
    told = F.max_by("status", F.when(automatic == 0, F.col("line")))
    return events.groupBy("id").agg(F.coalesce(told, F.max_by("status", F.when(automatic > 0, automatic))).alias("status"))
