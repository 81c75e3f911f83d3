"""The joins of the domain: aligning feature axes, resolving names, evidence coverage, records that belong together, intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def alias_table(genes: DataFrame) -> DataFrame:
    """``key, rec, owner``: every name of every record; owner 0 for its symbol, 1 for its ids, 2 for an alias. ``genes`` has ``rec, symbol, ids array, aliases array``."""
    rows = genes.select(
        "rec", F.explode(F.concat(F.array(F.struct(F.col("symbol").alias("name"), F.lit(0).alias("owner"))), F.transform(F.coalesce("ids", F.array().cast("array<string>")), lambda n: F.struct(n.alias("name"), F.lit(1).alias("owner"))), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda n: F.struct(n.alias("name"), F.lit(2).alias("owner"))))).alias("x")
    )
    return rows.select(S.lookup_key(F.col("x.name")).alias("key"), "rec", F.col("x.owner").alias("owner")).filter("key != ''")


def resolve(names: DataFrame, genes: DataFrame, name: str = "name", id_col: str = "symbol") -> DataFrame:
    """Add ``found``: the record that answers to a name. A symbol's owner beats an alias's; then one with the wanted id; then the first.

    The winner of a name is chosen once in the (dimension-sized) alias table, so names of the fact side only look it up.
    """
    known = alias_table(genes).join(genes.select("rec", F.col(id_col).alias("found")), "rec")
    rank = F.struct("owner", F.col("found").isNull().alias("lacks"), "rec")
    best = known.groupBy("key").agg(F.min_by("found", rank).alias("found"), F.count_distinct("rec").alias("candidates"))
    return names.withColumn("key", S.lookup_key(F.col(name))).join(best, "key", "left").drop("key")


def with_fallback(resolved: DataFrame, name: str = "name") -> DataFrame:
    """Unknown names stand for themselves where they look like a symbol; else null."""
    return resolved.withColumn("canonical", F.coalesce("found", F.when(S.symbol_like(F.col(name)), F.trim(F.col(name)))))


def expand(names: DataFrame, members: DataFrame, name: str = "name", pos: str = "pos") -> DataFrame:
    """Groups become their members, in order, each once by first appearance. ``members`` has ``name, member, at``."""
    flat = names.join(members.withColumnRenamed(name, "__n"), F.col(name) == F.col("__n"), "left").select(F.coalesce("member", F.col(name)).alias("member"), F.struct(F.col(pos), F.coalesce("at", F.lit(0))).alias("place"))
    return flat.groupBy("member").agg(F.min("place").alias("place")).select("member", F.col("place").getField(pos).alias(pos))


def align(features: DataFrame, how: str, pieces: int, panel: DataFrame | None = None) -> DataFrame:
    """A shared axis out of ``piece, pos, id`` (id null where unmapped): ``id, pieces`` with its order ``place``.

    ``intersection`` keeps ids all pieces have, in the first piece's order; ``union`` keeps all, by first appearance; ``panel`` keeps the panel's (``id, place``).
    """
    first = features.filter("id is not null").groupBy("piece", "id").agg(F.min("pos").alias("pos"))
    per = first.groupBy("id").agg(F.count(F.lit(1)).alias("pieces"), F.min(F.struct("piece", "pos")).alias("place"))
    if how == "intersection":
        return per.filter(F.col("pieces") == pieces)
    if how == "union":
        return per
    if how == "panel" and panel is not None:
        return panel.join(per.drop("place"), "id", "left").select("id", F.coalesce("pieces", F.lit(0)).alias("pieces"), "place")
    raise ValueError(how)


def align_report(features: DataFrame) -> DataFrame:
    """Per piece: names in, mapped, duplicates, unmapped (in = mapped + duplicates + unmapped)."""
    per = features.groupBy("piece").agg(F.count(F.lit(1)).alias("n_in"), F.count_distinct("id").alias("mapped"), F.count("id").alias("named"))
    return per.select("piece", "n_in", "mapped", (F.col("named") - F.col("mapped")).alias("duplicate"), (F.col("n_in") - F.col("named")).alias("unmapped"))


def zero_filled(panel: DataFrame, cells: DataFrame, matrix: DataFrame) -> DataFrame:
    """All (cell, gene) of a few cells and a panel; absent ones are 0. The product is panel-sized for each cell, so for a selection of cells only."""
    grid = cells.select("cell").crossJoin(panel.select("gene"))  # the optimiser checks a side's size before it broadcasts it
    return grid.join(matrix, ["cell", "gene"], "left").select("cell", "gene", F.coalesce("value", F.lit(0.0)).alias("value"))


def coverage_codes(evidence: DataFrame) -> DataFrame:
    """Letters of each gene and piece, in the order P X x F R, out of rows ``gene, piece, code``; only pairs with evidence (sparse)."""
    held = F.collect_set("code")
    return evidence.groupBy("gene", "piece").agg(F.concat(*[F.when(F.array_contains(held, c), c).otherwise("") for c in "PXxFR"]).alias("codes"))


def coverage_counts(codes: DataFrame) -> DataFrame:
    """Per gene: pieces with each letter, and whether it is covered (P, X or R)."""
    per = codes.groupBy("gene").agg(*[F.count_if(F.col("codes").contains(c)).alias(f"n_{name}") for c, name in (("P", "protein"), ("X", "perturbed"), ("x", "genome_wide"), ("F", "focus"), ("R", "measured"))])
    return per.withColumn("covered", (F.col("n_protein") + F.col("n_perturbed") + F.col("n_measured")) > 0)


# Ways to a dataset, the best first.
STATUS_RANK = ("local", "vault", "catalogued", "streamable", "fetchable", "controlled", "manual", "unresolved")


def best_status(options: DataFrame, key: str = "piece") -> DataFrame:
    """Each piece's best status out of rows ``piece, status, lead``; ties by lead."""
    rank = F.array_position(F.array(*[F.lit(s) for s in STATUS_RANK]), F.col("status"))
    return options.groupBy(key).agg(F.min(F.struct(rank.alias("rank"), "lead", "status")).alias("best")).select(key, "best.status", "best.lead")


def token_lookup(files: DataFrame, needles: DataFrame, path: str = "path") -> DataFrame:
    """Files whose name holds a needle as a whole token (case aside): ``needle, path``. An equi-join on exploded tokens."""
    tokens = files.select(path, F.explode(F.array_distinct(F.split(F.lower(F.regexp_replace(F.substring_index(F.col(path), "/", -1), r"\.[^.]*$", "")), "[^a-z0-9]+"))).alias("token"))
    return needles.select("needle", F.lower("needle").alias("token")).join(tokens.filter("token != ''"), "token").select("needle", path)


def interval_overlap(a: DataFrame, b: DataFrame, width: int, key: str = "chrom") -> DataFrame:
    """Pairs of half-open intervals that overlap on one chromosome: ``a_id, b_id``.

    Both sides go to the buckets of ``width`` they touch; a pair is made in the bucket where the later one starts, so exactly once.
    """
    buckets = lambda d, p: d.select(F.col("id").alias(f"{p}_id"), key, F.col("start").alias(f"{p}_s"), F.col("end").alias(f"{p}_e"), F.explode(F.sequence(F.expr(f"start div {width}"), F.expr(f"greatest(start, end - 1) div {width}"))).alias("bucket"))
    joined = buckets(a, "a").join(buckets(b, "b"), [key, "bucket"])
    meet = (F.col("a_s") < F.col("b_e")) & (F.col("b_s") < F.col("a_e"))
    once = F.col("bucket") == F.floor(F.greatest("a_s", "b_s") / F.lit(width))
    return joined.filter(meet & once).select("a_id", "b_id")


def related(records: DataFrame, of: int, by: Sequence[str] = ("genes", "locus", "dataset", "links")) -> DataFrame:
    """Records that share something with one record: ``id, reasons``; linked ones first, then by the number of reasons.

    ``records`` has ``id, genes array, chrom, start, end, dataset, links array``. The one record is broadcast.
    """
    one = records.filter(F.col("id") == of).select(*[F.col(c).alias(f"o_{c}") for c in ("id", "genes", "chrom", "start", "end", "dataset", "links")])
    both = records.filter(F.col("id") != of).crossJoin(F.broadcast(one))  # one row
    tests = {
        "links": F.array_contains("links", F.col("o_id")) | F.array_contains("o_links", F.col("id")),
        "genes": F.arrays_overlap("genes", "o_genes"),
        "locus": (F.col("chrom") == F.col("o_chrom")) & (F.col("start") < F.col("o_end")) & (F.col("o_start") < F.col("end")),
        "dataset": F.col("dataset") == F.col("o_dataset"),
    }
    reasons = F.array_compact(F.array(*[F.when(F.coalesce(tests[k], F.lit(False)), F.lit(k)) for k in ("links", "genes", "locus", "dataset") if k in by]))
    return both.select("id", reasons.alias("reasons")).filter(F.size("reasons") > 0).orderBy(F.array_contains("reasons", "links").desc(), F.size("reasons").desc(), "id")


def overlap_rank(wanted: Sequence[str], candidates: DataFrame, have: str = "genes") -> DataFrame:
    """Share of the wanted items each candidate has, largest first: ``id, coverage``."""
    n = F.size(F.array_intersect(F.array(*[F.lit(w) for w in wanted]), F.col(have)))
    return candidates.select("id", (n / F.lit(len(set(wanted)))).alias("coverage")).filter("coverage > 0").orderBy(F.desc("coverage"), "id")


def complete_subjects(scans: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Subjects whose every session has all wanted sequences (relational division)."""
    need = F.array(*[F.lit(w) for w in wanted])
    per = scans.groupBy("subject", "session").agg(F.collect_set(F.when(F.col("sequence").isin(*wanted), F.col("sequence"))).alias("have"))
    return per.groupBy("subject").agg(F.bool_and(F.size(F.array_except(need, "have")) == 0).alias("ok"), F.count(F.lit(1)).alias("sessions")).filter("ok").select("subject", "sessions")


def suffixed(rows: DataFrame, key: str, order: str, sep: str = "_") -> DataFrame:
    """Duplicates of a key get ``_2``, ``_3`` … by order: ``unique_key``."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("unique_key", F.when(n == 1, F.col(key)).otherwise(F.concat(F.col(key), F.lit(sep), n.cast("string"))))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` after a merge of ``new`` by key, with ``action``: kept, new, same or updated. Both have the same columns; new values win."""
    fields = [c for c in old.columns if c != key]
    joined = old.select(key, F.struct(*fields).alias("__old")).join(new.select(key, F.struct(*[F.col(c).cast(old.schema[c].dataType).alias(c) for c in fields]).alias("__new")), key, "full")
    action = F.when(F.col("__new").isNull(), "kept").when(F.col("__old").isNull(), "new").when(F.col("__old").eqNullSafe(F.col("__new")), "same").otherwise("updated")
    return joined.select(key, action.alias("action"), F.coalesce("__new", "__old").alias("v")).select(key, *[f"v.{c}" for c in fields], "action")


def merge_records(records: DataFrame, key: str, lists: dict[str, str], first: dict[str, str]) -> DataFrame:
    """One record a key: ``n`` rows, the distinct sorted values of the ``lists`` columns, the smallest of the ``first`` ones (new name: column)."""
    gathered = [F.array_sort(F.collect_set(c)).alias(name) for name, c in lists.items()]
    return records.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *gathered, *[F.min(c).alias(name) for name, c in first.items()])


def union_ragged(tables: Sequence[DataFrame]) -> DataFrame:
    """All rows of tables with different columns; what a table lacks is null."""
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table, allowMissingColumns=True)
    return out


def panel_table(panel: DataFrame, genes: DataFrame, members: DataFrame | None = None, id_col: str = "symbol") -> DataFrame:
    """Every panel gene with what the gene map knows of it: ``pos, query, id, symbol, ids, aliases, known``.

    ``panel`` has ``query, pos``. A name of a group (``members``: ``name, member, at``) gives a row a member. A name the map
    doesn't know is kept, as its own id, with ``known`` false; its symbol is '' unless it looks like one.
    """
    wanted = panel.select("query", "pos", F.col("query").alias("name"), F.lit(0).alias("at"))
    if members is not None:
        parts = members.select(F.upper("name").alias("__group"), F.col("member").alias("__member"), F.col("at").alias("__at"))
        wanted = panel.join(parts, F.upper("query") == F.col("__group"), "left").select("query", "pos", F.coalesce("__member", "query").alias("name"), F.coalesce("__at", F.lit(0)).alias("at"))
    found = with_fallback(resolve(wanted, genes, "name", "rec"))
    joined = found.withColumn("__rec", F.col("found")).join(genes.withColumnRenamed("rec", "__rec"), "__rec", "left")
    known = F.col("__rec").isNotNull()
    empty = F.array().cast("array<string>")
    return joined.select(
        "pos", "at", "query", F.coalesce(F.when(known, F.col(id_col)), "name").alias("id"),
        F.when(known, F.col("symbol")).when(S.symbol_like(F.col("name")), F.trim("name")).otherwise("").alias("symbol"),
        F.coalesce("ids", empty).alias("ids"), F.coalesce("aliases", empty).alias("aliases"), known.alias("known"),
    ).orderBy("pos", "at").drop("at")


def range_lookup(rows: DataFrame, ranges: DataFrame, at: str, first: str = "first", end: str = "end") -> DataFrame:
    """Rows with the columns of the range ``[first, end)`` that holds ``at``; null where none does. Ranges don't overlap.

    An equi-join: ranges go to the buckets they touch, whose width is the mean length of a range, so there are about
    twice as many of these rows as ranges; a row looks into one bucket.
    """
    extent = ranges.agg(F.min(first).alias("lo"), F.max(end).alias("hi"), F.count(F.lit(1)).alias("n")).first()
    width = max(1, int((extent["hi"] - extent["lo"]) // max(1, extent["n"]))) if extent["n"] else 1
    bucket = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    touched = ranges.filter(F.col(first) < F.col(end)).withColumn("__b", F.explode(F.sequence(bucket(first), F.floor((F.col(end) - 1) / F.lit(width)).cast("long"))))
    left, right = rows.withColumn("__b", bucket(at)).alias("l"), touched.alias("r")
    inside = (F.col("l.__b") == F.col("r.__b")) & (F.col(f"l.{at}") >= F.col(f"r.{first}")) & (F.col(f"l.{at}") < F.col(f"r.{end}"))
    return left.join(right, inside, "left").select(*[F.col(f"l.{c}") for c in rows.columns], *[F.col(f"r.{c}") for c in ranges.columns])


def region_enrichment(region: DataFrame, background: DataFrame, min_count: float = 1) -> DataFrame:
    """Per gene: observed, expected (background share of the region's total), lfc, z, and the verdict. Both have ``gene, total``."""
    sums = background.agg(F.sum("total").alias("__bg")).crossJoin(region.agg(F.sum("total").alias("__fg")))  # one row each
    both = background.select("gene", F.col("total").alias("bg")).join(region.select("gene", F.col("total").alias("obs")), "gene", "full").crossJoin(F.broadcast(sums))
    obs, expected = F.coalesce("obs", F.lit(0)).cast("double"), F.coalesce("bg", F.lit(0)) / F.col("__bg") * F.col("__fg")
    out = both.select("gene", obs.alias("observed"), expected.alias("expected")).withColumn("lfc", F.log2((F.col("observed") + 1) / (F.col("expected") + 1))).withColumn("z", (F.col("observed") - F.col("expected")) / F.sqrt(F.col("expected") + 1))
    verdict = F.when((F.col("observed") >= min_count) & (F.col("lfc") > 0), "enriched").when((F.col("expected") >= min_count) & (F.col("lfc") < 0), "depleted").otherwise("neither")
    return out.withColumn("verdict", verdict)


def cell_enrichment(selected: DataFrame, matrix: DataFrame, n_cells: int) -> DataFrame:
    """Genes of chosen cells against all: expected = all * share of cells; ``lfc = log2((observed + 1) / (expected + 1))``."""
    chosen = selected.select("cell").distinct()
    share = chosen.agg((F.count(F.lit(1)) / F.lit(n_cells)).alias("share"))
    inside = matrix.join(chosen.withColumn("__in", F.lit(True)), "cell", "left")
    per = inside.groupBy("gene").agg(F.sum("value").alias("everywhere"), F.sum(F.when(F.col("__in"), F.col("value")).otherwise(0)).alias("observed"))
    joined = per.crossJoin(F.broadcast(share)).withColumn("expected", F.col("everywhere") * F.col("share"))
    return joined.select("gene", "observed", "expected", F.log2((F.col("observed") + 1) / (F.col("expected") + 1)).alias("lfc"))


def column_or_null(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None)
