"""Append-only event logs: exact folds, their SQL-shaped forms, filters, trails and coverage of windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_write(events: DataFrame, key: str, order: str, fields: Sequence[str]) -> DataFrame:
    """Each field's last value that isn't null, per key. One hash aggregate; no sort, no window."""
    return events.groupBy(key).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields], F.max(order).alias("last"))


def book_fold(events: DataFrame, key: str = "id", order: str = "line", event: str = "event", fields: Sequence[str] = ("value",)) -> DataFrame:
    """Add, update and delete: a record lives from its last add, if no delete came later; updates count from that add on."""
    marks = events.groupBy(key).agg(F.max(F.when(F.col(event) == "add", F.col(order))).alias("__add"), F.max(F.when(F.col(event) == "delete", F.col(order))).alias("__del"))
    alive = marks.filter(F.col("__add").isNotNull() & (F.col("__del").isNull() | (F.col("__del") < F.col("__add")))).select(key, "__add")
    since = events.join(alive, key).filter(F.col(order) >= F.col("__add"))
    return last_write(since, key, order, fields)


_PAYLOAD = "target string, facets map<string,string>, local_paths array<string>, bytes_streamed long, confident boolean, note string, path string, bytes long"


def catalogue_fold(events: DataFrame) -> DataFrame:
    """The exact fold of a catalogue log, per key in line order: ``key, target, facets, local_paths, bytes_streamed, confident, note,
    last_seen``; ``events`` has ``line, ts, event, key`` and a JSON ``payload``.

    ``record`` replaces the entry; ``local`` appends a new path; ``stream`` adds bytes; ``annotate`` merges facets and sets what it
    names; ``open`` creates an entry only where none is. Other events before the first of these two are dropped.

    An entry begins at its last record or, without one, its first open event; what comes later adds up in any order but
    for last values, so each field is an aggregate with partial results, and a key's history is never gathered.
    """
    marks = events.groupBy("key").agg(F.max(F.when(F.col("event") == "record", F.col("line"))).alias("__record"), F.min(F.when(F.col("event") == "open", F.col("line"))).alias("__open"))
    since = events.join(marks.select("key", F.coalesce("__record", "__open").alias("__from")).filter("__from is not null"), "key").filter(F.col("line") >= F.col("__from"))
    rows = since.select("key", "line", F.col("ts").cast("double").alias("ts"), (F.col("line") == F.col("__from")).alias("base"), "event", F.from_json(F.coalesce("payload", F.lit("{}")), _PAYLOAD).alias("p"))
    base, record = F.col("base"), F.col("base") & (F.col("event") == "record")
    told = lambda field, by: F.max_by(F.col(f"p.{field}"), F.when(by & F.col(f"p.{field}").isNotNull(), F.col("line")))
    annotated = F.col("event") == "annotate"
    streamed = F.when(record, F.col("p.bytes_streamed")).when(~base & (F.col("event") == "stream"), F.col("p.bytes"))
    entry = rows.groupBy("key").agg(
        F.coalesce(told("target", base | annotated), F.lit("")).alias("target"), F.coalesce(F.sum(streamed), F.lit(0)).cast("long").alias("bytes_streamed"),
        told("confident", record | annotated).alias("confident"), F.coalesce(told("note", record | annotated), F.lit("")).alias("note"), F.max_by("ts", "line").alias("last_seen"),
    )
    # A facet's last value, and a path's first place; as many as the entry itself holds.
    facets = rows.filter(record | annotated).select("key", "line", F.explode("p.facets").alias("name", "value")).groupBy("key", "name").agg(F.max_by("value", "line").alias("value"))
    facets = facets.groupBy("key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("facets"))
    paths = F.when(record, F.col("p.local_paths")).when(~base & (F.col("event") == "local"), F.array("p.path"))
    paths = rows.select("key", "line", F.posexplode(paths).alias("at", "path")).groupBy("key", "path").agg(F.min(F.struct("line", "at")).alias("first"))
    paths = paths.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "path"))), lambda x: x["path"]).alias("local_paths"))
    whole = entry.join(facets, "key", "left").join(paths, "key", "left")
    return whole.select("key", "target", F.coalesce("facets", F.create_map().cast("map<string,string>")).alias("facets"), F.coalesce("local_paths", F.array().cast("array<string>")).alias("local_paths"), "bytes_streamed", "confident", "note", "last_seen")


def parse_log(lines: DataFrame, schema: str, need: Sequence[str]) -> DataFrame:
    """Rows out of JSON lines (``value``); torn lines and those without what is needed are skipped, unknown fields ignored."""
    parsed = lines.select(F.from_json("value", schema).alias("r"), "value").select("r.*", F.col("value").alias("raw"))
    cond = F.lit(True)
    for c in need:
        cond = cond & F.col(c).isNotNull()
    return parsed.filter(cond)


def windows_overlap(a: Column, b: Sequence[int]) -> Column:
    """Do two windows (lo, hi by turns) overlap on every axis, half-open? Windows of other arity never do."""
    cond = F.size(a) == len(b)
    for i in range(0, len(b), 2):
        cond = cond & (F.try_element_at(a, F.lit(i + 1)) < b[i + 1]) & (F.lit(b[i]) < F.try_element_at(a, F.lit(i + 2)))
    return F.coalesce(cond, F.lit(False))


def journal_filter(entries: DataFrame, *, dataset: str | None = None, ops: Sequence[str] | None = None, overlaps: Sequence[int] | None = None, since=None, until=None, genes: Sequence[str] | None = None, text: str | None = None, regex: bool = False) -> DataFrame:
    """Entries that meet all given conditions; time bounds are inclusive; ``genes`` must all be in the entry."""
    cond = F.lit(True)
    if dataset is not None:
        cond &= F.col("dataset") == dataset
    if ops is not None:
        cond &= F.col("op").isin(*ops)
    if overlaps is not None:
        cond &= windows_overlap(F.col("window"), overlaps)
    if since is not None:
        cond &= F.col("t") >= since
    if until is not None:
        cond &= F.col("t") <= until
    if genes is not None:
        cond &= F.size(F.array_except(F.array(*[F.lit(g) for g in genes]), "genes")) == 0
    if text is not None:
        cond &= F.col("raw").rlike(f"(?i){text}") if regex else F.lower("raw").contains(text.lower())
    return entries.filter(cond)


def trails(entries: DataFrame, key: str, op: str, session: str, t: str, nbytes: str) -> DataFrame:
    """Per dataset: entries, bytes, first, last, distinct sessions, and the operations' counts as ``op:n`` in order."""
    per = entries.groupBy(key, op).agg(F.count(F.lit(1)).alias("n"), F.sum(nbytes).alias("b"), F.min(t).alias("t0"), F.max(t).alias("t1"))
    ops = per.groupBy(key).agg(F.sum("n").alias("n"), F.sum("b").alias("bytes"), F.min("t0").alias("first"), F.max("t1").alias("last"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", op, F.col("n").cast("string")))), ",").alias("ops"))
    return ops.join(entries.groupBy(key).agg(F.count_distinct(session).alias("sessions")), key)


def coverage_grid(windows: DataFrame, extent: tuple[float, float, float, float], shape: int) -> DataFrame:
    """How many windows (``x0, x1, y0, y1``) touch each cell of a shape x shape grid: ``j, i, n``.

    A window changes the count at its four corners only; running sums along both axes of the grid do the rest. So each window
    makes four rows, which are summed before the exchange, and the sums run over shape x shape cells.
    """
    ex0, ex1, ey0, ey1 = extent
    lo = lambda c, a, b: F.greatest(F.lit(0), F.floor((F.col(c) - a) * F.lit(shape) / F.lit(b - a)).cast("int"))
    hi = lambda c, a, b: F.least(F.lit(shape), F.ceil((F.col(c) - a) * F.lit(shape) / F.lit(b - a)).cast("int"))
    cells = windows.select(lo("x0", ex0, ex1).alias("i0"), hi("x1", ex0, ex1).alias("i1"), lo("y0", ey0, ey1).alias("j0"), hi("y1", ey0, ey1).alias("j1")).filter("i0 < i1 and j0 < j1")
    corner = lambda j, i, d: F.struct(F.col(j).alias("j"), F.col(i).alias("i"), F.lit(d).alias("d"))
    corners = cells.select(F.explode(F.array(corner("j0", "i0", 1), corner("j0", "i1", -1), corner("j1", "i0", -1), corner("j1", "i1", 1))).alias("c"))
    deltas = corners.groupBy("c.j", "c.i").agg(F.sum("c.d").alias("d"))
    grid = windows.sparkSession.range(shape * shape).select(F.expr(f"cast(id div {shape} as int)").alias("j"), F.expr(f"cast(id % {shape} as int)").alias("i")).join(deltas, ["j", "i"], "left").withColumn("d", F.coalesce("d", F.lit(0)))
    along = grid.withColumn("d", F.sum("d").over(Window.partitionBy("j").orderBy("i")))
    return along.withColumn("n", F.sum("d").over(Window.partitionBy("i").orderBy("j"))).filter("n > 0").select("j", "i", "n")


def unsettled(entries: DataFrame, confident: str = "confident") -> DataFrame:
    """Entries nobody is confident of; missing counts as not."""
    return entries.filter(~F.coalesce(F.col(confident), F.lit(False)))


def status_forward(events: DataFrame, order: Sequence[str], key: str = "id", line: str = "line", status: str = "status") -> DataFrame:
    """The furthest automatic status each record reached; a status never goes back."""
    rank = F.array_position(F.array(*[F.lit(s) for s in order]), F.col(status))
    return events.groupBy(key).agg(F.max(F.struct(rank.alias("rank"), F.col(status).alias("status"))).alias("best")).select(key, "best.status")


def status_report(pieces: DataFrame, statuses: Sequence[str]) -> DataFrame:
    """Pieces and bytes of each status, also of those nobody has. ``pieces`` has ``status, bytes``."""
    spark = pieces.sparkSession
    dimension = spark.createDataFrame([(s, i) for i, s in enumerate(statuses)], "status string, rank int")
    per = pieces.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.count_if(F.col("bytes").isNull()).alias("unknown"))
    return dimension.join(per, "status", "left").select("status", "rank", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("unknown", F.lit(0)).alias("unknown"))


def lru_victims_of(residents: DataFrame, cache: str, order: Sequence[str], need: int, size: str = "bytes", pinned: str = "pinned") -> DataFrame:
    """The residents each cache gives up for ``need`` bytes: those in order (least recent first) until it has them, pinned ones never."""
    before = F.sum(size).over(Window.partitionBy(cache).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return residents.filter(~F.col(pinned)).withColumn("__before", F.coalesce(before, F.lit(0))).filter(F.col("__before") < need).drop("__before")


def lru_victims(residents: list[tuple[str, int, float, bool]], need: int, capacity: int) -> list[str] | None:
    """Whom a bounded cache evicts to take ``need`` bytes: the least recently used that aren't pinned; None if that isn't enough."""
    free = capacity - sum(size for _, size, _, _ in residents)
    out: list[str] = []
    for name, size, _, pinned in sorted(residents, key=lambda r: r[2]):
        if free >= need:
            break
        if not pinned:
            out.append(name)
            free += size
    return out if free >= need else None
