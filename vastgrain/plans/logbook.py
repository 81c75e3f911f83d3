"""Append-only logs kept as folders of JSON lines: a catalogue, a journal, a book of selections. Reading folds them with Spark.

Each append is a file of its own, written whole and then renamed, so writers don't disturb each other and a line is never torn;
a reader still passes over lines that don't parse. :func:`compact` gathers the small files.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import folds as L

#: Facets of an entry.
FACETS = ("organism", "tissue", "assay", "disease", "sample", "donor", "condition", "platform")
STATUSES = ("open", "described", "searched", "in-review", "confirmed", "refuted", "resolved")
INTENTS = ("interesting", "need-data", "double-check", "artifact", "reference")


@dataclass
class Log:
    """A folder of JSON-lines files on a file system the driver mounts."""

    spark: SparkSession
    folder: str

    def append(self, event: dict) -> None:
        os.makedirs(self.folder, exist_ok=True)
        stamp = time.time_ns()
        line = json.dumps({"line": stamp, "ts": stamp / 1e9, **event}, sort_keys=True)
        path = os.path.join(self.folder, f"{stamp:020d}-{uuid.uuid4().hex[:8]}.jsonl")
        with open(path + ".part", "w", encoding="utf-8") as f:
            f.write(line + "\n")
        os.rename(path + ".part", path)

    def lines(self) -> DataFrame:
        """``value`` of every line, also from files another tool appended to."""
        if not os.path.isdir(self.folder) or not any(n.endswith((".jsonl", ".json")) for n in os.listdir(self.folder)):
            return self.spark.createDataFrame([], "value string")
        return self.spark.read.option("pathGlobFilter", "*.{jsonl,json}").text(self.folder)

    def tail(self, n: int = 20) -> DataFrame:
        return self.lines().withColumn("line", F.get_json_object("value", "$.line").cast("long")).orderBy(F.desc("line")).limit(n)

    def compact(self) -> None:
        """One file of all lines in order; the small ones go after it is there."""
        old = sorted(n for n in os.listdir(self.folder) if n.endswith(".jsonl"))
        path = os.path.join(self.folder, f"{0:020d}-{uuid.uuid4().hex[:8]}.jsonl")
        with open(path + ".part", "w", encoding="utf-8") as out:
            for n in old:
                with open(os.path.join(self.folder, n), encoding="utf-8") as f:
                    out.writelines(line if line.endswith("\n") else line + "\n" for line in f)
        os.rename(path + ".part", path)
        for n in old:
            os.remove(os.path.join(self.folder, n))


class Catalogue(Log):
    """What datasets there are: record, annotate, local copies, streamed bytes."""

    def record(self, key: str, target: str, facets: dict | None = None, **extra) -> None:
        self.append({"event": "record", "key": key, "payload": {"target": target, "facets": self._facets(facets), **extra}})

    def annotate(self, key: str, facets: dict | None = None, **fields) -> None:
        self.append({"event": "annotate", "key": key, "payload": {"facets": self._facets(facets), **fields}})

    def local(self, key: str, path: str) -> None:
        self.append({"event": "local", "key": key, "payload": {"path": path}})

    def streamed(self, key: str, nbytes: int) -> None:
        self.append({"event": "stream", "key": key, "payload": {"bytes": nbytes}})

    def opened(self, key: str, target: str = "") -> None:
        self.append({"event": "open", "key": key, "payload": {"target": target}})

    @staticmethod
    def _facets(facets: dict | None) -> dict:
        unknown = set(facets or {}) - set(FACETS)
        if unknown:
            raise KeyError(f"unknown facets {sorted(unknown)}; there are {', '.join(FACETS)}")
        return dict(facets or {})

    def events(self) -> DataFrame:
        get = lambda name: F.get_json_object("value", f"$.{name}")
        return self.lines().select(get("line").cast("long").alias("line"), get("ts").cast("double").alias("ts"), get("event").alias("event"), get("key").alias("key"), get("payload").alias("payload")).filter("key is not null and event is not null")

    def entries(self) -> DataFrame:
        return L.catalogue_fold(self.events())

    def facet_table(self) -> DataFrame:
        """A row a key with all facets, '' where unset."""
        return self.entries().select("key", *[F.coalesce(F.try_element_at("facets", F.lit(f)), F.lit("")).alias(f) for f in FACETS]).orderBy("key")

    def find(self, needle: str) -> DataFrame:
        text = F.lower(F.concat_ws(" ", "key", "target", "note", F.array_join(F.map_values("facets"), " ")))
        return self.entries().filter(text.contains(needle.lower()))

    def unsettled(self) -> DataFrame:
        return L.unsettled(self.entries())

    def view(self, name: str = "events") -> None:
        """The log as a SQL view."""
        self.events().createOrReplaceTempView(name)


JOURNAL = "line long, t double, op string, dataset string, unit string, window array<long>, level string, genes array<string>, units long, bytes long, seconds double, session string, note string"


class Journal(Log):
    """What was read: one entry an operation."""

    def record(self, op: str, dataset: str, window: Sequence[int] = (), **fields) -> None:
        self.append({"op": op, "dataset": dataset, "window": list(window), "t": time.time(), **fields})

    def entries(self) -> DataFrame:
        return L.parse_log(self.lines(), JOURNAL, ["op", "dataset"])

    def search(self, **conditions) -> DataFrame:
        return L.journal_filter(self.entries(), **conditions)

    def trails(self) -> DataFrame:
        return L.trails(self.entries(), "dataset", "op", "session", "t", "bytes")

    def coverage(self, dataset: str, extent: tuple[float, float, float, float], shape: int = 256) -> DataFrame:
        w = self.entries().filter((F.col("dataset") == dataset) & (F.size("window") == 4))
        return L.coverage_grid(w.select(*[F.col("window")[i].alias(c) for i, c in enumerate(("x0", "x1", "y0", "y1"))]), extent, shape)

    def view(self, name: str = "journal") -> None:
        self.entries().createOrReplaceTempView(name)


_AMBIENT: ContextVar[tuple[Journal | None, dict]] = ContextVar("ambient", default=(None, {}))


@contextmanager
def recording(journal: Journal, **tags):
    """Within the block :func:`note` writes to ``journal``; tags of nested blocks are merged, the inner ones win."""
    token = _AMBIENT.set((journal, {**_AMBIENT.get()[1], **tags}))
    try:
        yield journal
    finally:
        _AMBIENT.reset(token)


@contextmanager
def quiet():
    """Within the block nothing is recorded."""
    token = _AMBIENT.set((None, {}))
    try:
        yield
    finally:
        _AMBIENT.reset(token)


def note(op: str, dataset: str, window: Sequence[int] = (), **fields) -> bool:
    """Record an operation in the journal of the surrounding :func:`recording`; whether it was. A journal that can't be written never fails the operation."""
    journal, tags = _AMBIENT.get()
    if journal is None:
        return False
    try:
        journal.record(op, dataset, window, **{**tags, **fields})
    except (OSError, TypeError, ValueError):
        return False
    return True


class SelectionBook(Log):
    """Regions, intervals, loci, sequences and sets somebody marked, with a status and a history."""

    def add(self, kind: str, name: str, geometry: dict, intent: str = "interesting", **fields) -> str:
        if intent not in INTENTS:
            raise ValueError(f"intent must be one of {', '.join(INTENTS)}")
        key = uuid.uuid4().hex[:12]
        self.append({"event": "add", "id": key, "fields": {"kind": kind, "name": name, "geometry": json.dumps(geometry, sort_keys=True), "intent": intent, "status": "open", **fields}})
        return key

    def update(self, key: str, **fields) -> None:
        if fields.get("status", "open") not in STATUSES:
            raise ValueError(f"status must be one of {', '.join(STATUSES)}")
        self.append({"event": "update", "id": key, "fields": fields})

    def delete(self, key: str) -> None:
        self.append({"event": "delete", "id": key, "fields": {}})

    def _settle(self, key: str, status: str, note: str, by: str) -> None:
        self.update(key, status=status, **{k: v for k, v in (("note", note), ("by", by)) if v})

    def review(self, key: str, note: str = "", by: str = "") -> None:
        self._settle(key, "in-review", note, by)

    def confirm(self, key: str, note: str = "", by: str = "") -> None:
        self._settle(key, "confirmed", note, by)

    def refute(self, key: str, note: str = "", by: str = "") -> None:
        self._settle(key, "refuted", note, by)

    def resolve(self, key: str, note: str = "", by: str = "") -> None:
        self._settle(key, "resolved", note, by)

    def annotate(self, key: str, **fields) -> None:
        self.update(key, **fields)

    def link(self, a: str, b: str, relation: str = "related") -> None:
        """Link two selections both ways; the way back carries ``~`` before its relation."""
        self.append({"event": "link", "id": a, "fields": {"to": b, "relation": relation}})
        self.append({"event": "link", "id": b, "fields": {"to": a, "relation": relation.removeprefix("~") if relation.startswith("~") else f"~{relation}"}})

    def links(self) -> DataFrame:
        """``id, to, relation`` of links whose two ends live, each once."""
        get = lambda p: F.get_json_object("value", f"$.{p}")
        rows = self.lines().filter(get("event") == "link").select(get("id").alias("id"), get("fields.to").alias("to"), get("fields.relation").alias("relation")).distinct()
        alive = self.all().select("id")
        return rows.join(alive, "id", "left_semi").join(alive.withColumnRenamed("id", "to"), "to", "left_semi").select("id", "to", "relation")

    def history(self, key: str) -> DataFrame:
        """All events of one selection, in order."""
        get = lambda p: F.get_json_object("value", f"$.{p}")
        return self.lines().filter(get("id") == key).select(get("line").cast("long").alias("line"), get("event").alias("event"), get("fields").alias("fields")).orderBy("line")

    FIELDS = ("kind", "name", "geometry", "intent", "status", "note", "dataset", "by")

    def all(self) -> DataFrame:
        """Living selections, each field as last written since its add."""
        get = lambda p: F.get_json_object("value", f"$.{p}")
        events = self.lines().filter(get("event") != "link").select(get("line").cast("long").alias("line"), get("event").alias("event"), get("id").alias("id"), *[get(f"fields.{f}").alias(f) for f in self.FIELDS]).filter("id is not null")
        return L.book_fold(events, fields=self.FIELDS)

    def open_questions(self) -> DataFrame:
        return self.all().filter(((F.col("intent") == "need-data") & (F.col("status") != "resolved")) | ((F.col("intent") == "double-check") & ~F.col("status").isin("confirmed", "refuted", "resolved")))
