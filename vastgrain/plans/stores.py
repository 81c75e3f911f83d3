"""Queries that go through sinks, sources, logs and footers: what is written has to come back, and metadata has to agree with the rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import api
from ..functions import scalars as S
from ..operators import grid as G
from ..operators import joins as J
from ..operators import library as B
from ..sources import dispatch, readers, sinks
from ..sources.shared import new_folder
from . import cost
from .logbook import Journal
from .navigation import WindowedFrame
from .registry import query
from .spatial import POINTS, points


def mounted(path: str) -> str:
    """The path of a folder on a mounted file system, for readers that open it with Python."""
    return path.removeprefix("file://").replace("file:/", "/", 1)


@query("zorder_window", f"SELECT gene, count(*) AS n, CAST(sum(count) AS BIGINT) AS total FROM {POINTS} WHERE x >= 100 AND x < 1500 AND y >= 2 AND y < 90 GROUP BY gene")
def zorder_window(t):
    """Points written in Z-order of their blocks, and a window of what was written."""
    path = new_folder(t.spark, "z-ordered")
    G.write_z_ordered(points(t), path, 64)
    inside = t.spark.read.parquet(path).filter("x >= 100 and x < 1500 and y >= 2 and y < 90")
    return inside.groupBy("gene").agg(F.count(F.lit(1)).alias("n"), F.sum("count").cast("long").alias("total"))


@query("fasta_roundtrip", "SELECT 'p' || p_partkey AS id, replace(upper(p_name), ' ', 'N') AS seq, CAST(length(p_name) AS INT) AS length FROM part")
def fasta_roundtrip(t):
    """Sequences of two lines each, read by records from parts of files."""
    path = new_folder(t.spark, "fasta")
    seq = F.translate(F.upper("p_name"), " ", "N")
    t.part.select(F.concat(F.lit(">p"), F.col("p_partkey").cast("string"), F.lit(" "), "p_type", F.lit("\n"), F.substr(seq, F.lit(1), F.lit(8)), F.lit("\n"), F.substr(seq, F.lit(9)))).coalesce(2).write.text(path)
    readers.register(t.spark)
    return t.spark.read.format("fastx").option("split_bytes", 4096).load(mounted(path)).select("id", "seq", "length")


@query("gem_roundtrip", f"SELECT gene, count(*) AS n, CAST(sum(count) AS BIGINT) AS total, CAST(min(x) AS INT) AS x0, CAST(max(x) AS INT) + 1 AS x1 FROM {POINTS} GROUP BY gene")
def gem_roundtrip(t):
    """Points as tables of tab-separated text with a header, read in parts of files."""
    path = new_folder(t.spark, "gem")
    points(t).select(F.col("gene").alias("geneID"), "x", "y", F.col("count").cast("long").alias("MIDCount")).coalesce(2).write.option("sep", "\t").option("header", True).csv(path)
    readers.register(t.spark)
    rows = t.spark.read.format("gem").option("split_bytes", 65536).load(mounted(path))
    return rows.groupBy("gene").agg(F.count(F.lit(1)).alias("n"), F.sum("count").alias("total"), F.min("x").alias("x0"), (F.max("x") + 1).alias("x1"))


@query("harvest_roundtrip", "SELECT n_nationkey, n_name, (SELECT count(*) FROM nation) AS rows, 'Asia' AS target FROM nation")
def harvest_roundtrip(t):
    """A result kept by name, with its manifest row."""
    h = sinks.Harvest(t.spark, new_folder(t.spark, "harvest"))
    h.add("nations", t.nation.select("n_nationkey", "n_name"), "orc", source="nation", targets=["Asia"])
    about = h.for_target("Asia").select("rows", F.col("targets")[0].alias("target"))
    return h.read("nations").crossJoin(about).select("n_nationkey", "n_name", "rows", "target")  # one row


@query("materialize_subset", "SELECT o_orderkey, o_totalprice FROM orders")
def materialize_subset(t):
    return sinks.materialize(t.orders, new_folder(t.spark, "subset"), ["o_orderkey", "o_totalprice"])


@query("bed_sink", "SELECT concat_ws(chr(9), 'chr' || c_nationkey, c_custkey * 7 % 1000, c_custkey * 7 % 1000 + 25, c_name || '|' || c_mktsegment || '|open', '0', '.') AS value FROM customer WHERE c_custkey % 9 <> 0")
def bed_sink(t):
    path = new_folder(t.spark, "bed")
    chrom = F.when(F.col("c_custkey") % 9 != 0, F.col("c_nationkey").cast("string"))
    sinks.write_bed(t.customer.select(chrom.alias("chrom"), F.expr("c_custkey * 7 % 1000").alias("start"), F.expr("c_custkey * 7 % 1000 + 25").alias("end"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("intent"), F.lit("open").alias("status"), F.lit("GRCh38").alias("build")), path)
    return t.spark.read.text(path)


def _journal(t) -> Journal:
    path = new_folder(t.spark, "journal")
    entry = t.events.select(F.col("event_id").alias("line"), F.col("event_type").alias("op"), F.expr("cast(user_id % 20 as string)").alias("dataset"), F.expr("cast(event_id as double)").alias("t"), F.expr("event_id % 1000").alias("bytes"), F.expr("cast(user_id as string)").alias("session"))
    entry.write.json(path)
    return Journal(t.spark, mounted(path))


@query("journal_trails", "WITH p AS (SELECT user_id % 20 AS d, event_type, count(*) AS n FROM events GROUP BY 1, 2), o AS (SELECT d, string_agg(event_type || ':' || n, ',' ORDER BY event_type) AS ops FROM p GROUP BY 1) SELECT CAST(user_id % 20 AS VARCHAR) AS dataset, count(*) AS n, CAST(sum(event_id % 1000) AS BIGINT) AS bytes, min(event_id)::DOUBLE AS first, max(event_id)::DOUBLE AS last, any_value(ops) AS ops, count(DISTINCT user_id) AS sessions FROM events JOIN o ON o.d = user_id % 20 GROUP BY 1")
def journal_trails(t):
    return _journal(t).trails()


@query("journal_sql", "SELECT event_type AS op, count(*) AS n, CAST(sum(event_id % 1000) AS BIGINT) AS bytes FROM events WHERE user_id % 20 < 5 GROUP BY 1")
def journal_sql(t):
    """SQL over a journal's view."""
    _journal(t).view("journal_entries")
    return t.spark.sql("SELECT op, count(*) AS n, sum(bytes) AS bytes FROM journal_entries WHERE CAST(dataset AS INT) < 5 GROUP BY op")


SCANS = "'data/sub-' || doc_id % 30 || '/ses-' || doc_id % 4 || '/anat_' || CASE doc_id % 3 WHEN 0 THEN 'T1w' WHEN 1 THEN 'FLAIR' ELSE 'notes' END || '_' || doc_id || '.nii.gz'"


@query("cohort_scan", f"WITH f AS (SELECT {SCANS} AS path, CAST(doc_id % 30 AS VARCHAR) AS subject, CAST(doc_id % 4 AS VARCHAR) AS session, CASE doc_id % 3 WHEN 0 THEN 'T1w' WHEN 1 THEN 'FLAIR' END AS seq FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY subject, session, seq ORDER BY path) AS n FROM f WHERE seq IS NOT NULL) SELECT subject, session, CASE WHEN n = 1 THEN seq ELSE seq || '_' || n END AS sequence, path FROM r")
def cohort_scan(t):
    return dispatch.cohort(t.documents.select(F.expr(SCANS).alias("path")))


@query("bundle_kinds", "WITH f AS (SELECT doc_id // 5 AS folder, CASE WHEN doc_id % 5 = 0 AND doc_id // 5 % 4 = 0 THEN 'mtx' WHEN doc_id % 5 = 1 AND doc_id // 5 % 3 = 0 THEN 'visium' WHEN doc_id % 5 = 2 AND doc_id // 5 % 3 = 1 THEN 'gef' END AS what FROM documents) SELECT folder, CASE WHEN bool_or(what = 'visium') THEN 'visium' WHEN bool_or(what = 'mtx') THEN 'mtx-triple' WHEN bool_or(what = 'gef') THEN 'stomics' ELSE 'directory' END AS kind FROM f GROUP BY folder")
def bundle_kinds(t):
    name = F.expr("case when doc_id % 5 = 0 and doc_id div 5 % 4 = 0 then 'a_matrix.mtx.gz' when doc_id % 5 = 1 and doc_id div 5 % 3 = 0 then 'spatial/scalefactors_json.json' when doc_id % 5 = 2 and doc_id div 5 % 3 = 1 then 'x.gef' else 'readme.txt' end")
    return dispatch.sniff_bundles(t.documents.select(F.expr("doc_id div 5").alias("folder"), name.alias("path")))


@query("token_lookup", "WITH k AS (SELECT url, unnest(list_distinct(string_split_regex(lower(regexp_replace(regexp_extract(url, '[^/]*$'), '\\.[^.]*$', '')), '[^a-z0-9]+'))) AS token FROM pages) SELECT CAST(n_nationkey AS VARCHAR) AS needle, url AS path FROM nation JOIN k ON token = CAST(n_nationkey AS VARCHAR)")
def token_lookup(t):
    return J.token_lookup(t.pages.select(F.col("url").alias("path")), t.nation.select(F.col("n_nationkey").cast("string").alias("needle")))


@query("sparkline_week", "WITH c AS (SELECT user_id, [count(*) FILTER (isodow(ts) = 1), count(*) FILTER (isodow(ts) = 2), count(*) FILTER (isodow(ts) = 3), count(*) FILTER (isodow(ts) = 4), count(*) FILTER (isodow(ts) = 5), count(*) FILTER (isodow(ts) = 6), count(*) FILTER (isodow(ts) = 7)] AS v FROM events GROUP BY 1), b AS (SELECT *, list_min(v) AS lo, list_max(v) AS hi FROM c) SELECT user_id, array_to_string([substr('▁▂▃▄▅▆▇█', 1 + CAST(CASE WHEN hi > lo THEN round_even((x - lo) / (hi - lo) * 7, 0) ELSE 0 END AS INT), 1) FOR x IN v], '') AS line FROM b")
def sparkline_week(t):
    days = F.array(*[F.count_if(F.weekday("ts") == i) for i in range(7)])
    return t.events.groupBy("user_id").agg(days.alias("v")).select("user_id", S.sparkline(F.col("v")).alias("line"))


@query("audit_lines", "SELECT event_id AS line, 'k' AS field, 'bigint' AS found FROM events WHERE json_type(props, '$.k') IN ('UBIGINT', 'BIGINT')")
def audit_lines(t):
    """Fields of another type than wanted; ``absent`` is nowhere, so nothing is said of it."""
    return B.audit(t.events.select(F.col("event_id").alias("line"), F.col("props").alias("value")), {"k": "string", "absent": "bigint"})


@query("facet_completion", "SELECT c_custkey AS key, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS segment, '' AS nation FROM customer")
def facet_completion(t):
    facets = F.when(F.col("c_custkey") % 3 != 0, F.create_map(F.lit("segment"), "c_mktsegment"))
    return B.missing_facets(t.customer.select(F.col("c_custkey").alias("key"), facets.alias("facets")), ["segment", "nation"])


@query("window_navigation", "WITH e AS (SELECT min(event_id) AS lo, max(event_id) + 1 AS hi FROM events), w AS (SELECT CAST(floor(lo + 0.25 * (hi - lo)) AS BIGINT) AS a, CAST(floor(lo + 0.5 * (hi - lo)) AS BIGINT) AS b FROM e) SELECT event_id, value FROM events, w WHERE event_id >= a AND event_id < b AND (event_id - a) % 4 = 0")
def window_navigation(t):
    """A share of the extent, zoomed out by two levels."""
    return WindowedFrame.over(t.events, "event_id").select_fraction((0.25, 0.5)).at_level(2).load().select("event_id", "value")


@query("window_overview", "WITH e AS (SELECT min(event_id) AS lo, greatest(1, CAST(ceil((max(event_id) + 1 - min(event_id)) / 16.0) AS BIGINT)) AS per FROM events) SELECT (event_id - lo) // per AS bucket, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS high FROM events, e GROUP BY 1")
def window_overview(t):
    return WindowedFrame.over(t.events, "event_id").overview("value", 16).select("bucket", "n", F.round("mean", 6).alias("mean"), "high")


@query("footer_describe", "SELECT count(*) AS rows, 1::BIGINT AS files FROM lineitem")
def footer_describe(t):
    """Rows and files from footers alone."""
    per = api.open(t.spark, f"{t.folder}/lineitem.parquet").describe()
    return per.agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("files"))


@query("footer_stats", "SELECT count(l_quantity) AS num_values, count(*) - count(l_quantity) AS nulls, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem")
def footer_stats(t):
    """A column's values, nulls and bounds from footers alone."""
    stats = api.open(t.spark, f"{t.folder}/lineitem.parquet").stats().filter("column = 'l_quantity'")
    return stats.select((F.col("num_values") - F.col("nulls")).alias("num_values"), "nulls", F.col("low_number").alias("low"), F.col("high_number").alias("high"))


@query("prune_report", "SELECT count(*) AS rows_within, 0::BIGINT AS rows_beyond, count(*) AS all_rows FROM lineitem")
def prune_report(t):
    """Rows of the row groups that a range can't rule out by its footer: all of them within the column's bounds, none beyond."""
    d = api.open(t.spark, f"{t.folder}/lineitem.parquet")
    within, beyond = d.prune("l_quantity", 0, 1000).select(F.col("rows").alias("rows_within"), "all_rows"), d.prune("l_quantity", 2000, 3000).select(F.col("rows").alias("rows_beyond"))
    return within.crossJoin(beyond).select("rows_within", "rows_beyond", "all_rows")  # one row each


@query("row_group_overview", "SELECT count(*) AS rows, max(l_quantity) - min(l_quantity) AS span FROM lineitem")
def row_group_overview(t):
    groups = cost.row_group_overview(cost.footers(t.spark, api.open(t.spark, f"{t.folder}/lineitem.parquet").files()), 0, 1 << 62)
    spread = F.max(F.try_element_at("spans", F.lit("l_quantity")))
    return groups.agg(F.sum("rows").alias("rows"), spread.alias("span"))


@query("entries_overview", "WITH m AS (SELECT DISTINCT l_orderkey AS cell, l_partkey AS gene FROM lineitem), h AS (SELECT max(cell) + 1 AS hi FROM m), w AS (SELECT hi, greatest(1, CAST(ceil(hi / 20.0) AS BIGINT)) AS width FROM h), per AS (SELECT cell, count(*) AS n FROM m GROUP BY cell), g AS (SELECT cell // width AS bucket, sum(n) AS total, max(n) AS most FROM per, w GROUP BY 1), b AS (SELECT i AS bucket, least(width, hi - i * width) AS cells FROM w, range(20) r(i) WHERE i * width < hi) SELECT b.bucket, cells, round(coalesce(total, 0) / cells, 6) AS mean, coalesce(most, 0) AS most FROM b LEFT JOIN g ON g.bucket = b.bucket")
def entries_overview(t):
    m = t.lineitem.select(F.col("l_orderkey").alias("cell"), F.col("l_partkey").alias("gene")).distinct()
    return cost.entries_overview(m, 0, m.agg(F.max("cell")).first()[0] + 1, 20).select("bucket", "cells", F.round("mean", 6).alias("mean"), "most")


THUMB = f"SELECT (y - y % 64) * 32 // 2048 AS iy, (x - x % 64) * 32 // 2048 AS ix, CAST(sum(count) AS BIGINT) AS total FROM {POINTS} WHERE x < 2048 AND y < 2048 GROUP BY 1, 2"


def _thumb(t):
    return G.thumbnail(G.bin_pyramid(points(t), [1, 8, 64]), [1, 8, 64], (0, 2048, 0, 2048), 32)


@query("thumbnail", THUMB)
def thumbnail(t):
    return _thumb(t)


@query("display_levels", f"WITH i AS ({THUMB}), q AS (SELECT quantile_cont(ln(1 + total), 0.01) AS lo, quantile_cont(ln(1 + total), 0.99) AS hi FROM i WHERE total > 0) SELECT iy, ix, total, round(CASE WHEN hi > lo THEN greatest(0, least(1, (ln(1 + greatest(total, 0)) - lo) / (hi - lo))) ELSE 0 END, 6) AS level FROM i, q")
def display_levels(t):
    return G.log_scaled(_thumb(t)).withColumn("level", F.round("level", 6))


@query("panel_table", "SELECT s_suppkey AS pos, 'G' || s_suppkey * 30 AS query, 'G' || s_suppkey * 30 AS id, 'G' || s_suppkey * 30 AS symbol, CASE WHEN p_partkey IS NULL THEN 0 ELSE 1 END AS n_ids, p_partkey IS NOT NULL AS known FROM supplier LEFT JOIN part ON p_partkey = s_suppkey * 30")
def panel_table(t):
    genes = t.part.select(F.col("p_partkey").alias("rec"), F.concat(F.lit("G"), F.col("p_partkey").cast("string")).alias("symbol"), F.array(F.concat(F.lit("ENSG"), F.lpad(F.col("p_partkey").cast("string"), 11, "0"))).alias("ids"), F.array().cast("array<string>").alias("aliases"))
    panel = t.supplier.select(F.concat(F.lit("G"), F.expr("s_suppkey * 30").cast("string")).alias("query"), F.col("s_suppkey").alias("pos"))
    return J.panel_table(panel, genes).select("pos", "query", "id", "symbol", F.size("ids").alias("n_ids"), "known")
