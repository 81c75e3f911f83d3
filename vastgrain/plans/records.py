"""Queries on records: names and axes, evidence, event logs, selections, series, plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import folds as L
from ..operators import joins as J
from ..operators import similarity as Y
from ..operators import windows as W
from .registry import Tables, query


def features(t: Tables) -> DataFrame:
    """Seven pieces' name lists: parts bought in the seven years, in order of purchase; multiples of 7 have no id."""
    return t.lineitem.select((F.year("l_shipdate") - 1992).alias("piece"), F.expr("l_orderkey * 10 + l_linenumber").alias("pos"), F.expr("if(l_partkey % 7 = 0, null, l_partkey)").alias("id"))


FEATURES = "f AS (SELECT year(l_shipdate) - 1992 AS piece, l_orderkey * 10 + l_linenumber AS pos, CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_partkey END AS id FROM lineitem), g AS (SELECT piece, id, min(pos) AS pos FROM f WHERE id IS NOT NULL GROUP BY 1, 2)"


@query("align_intersection", f"WITH {FEATURES} SELECT id, arg_min(pos, piece) AS pos FROM g GROUP BY id HAVING count(*) = 7")
def align_intersection(t):
    return J.align(features(t), "intersection", 7).select("id", F.col("place.pos").alias("pos"))


@query("align_union", f"WITH {FEATURES} SELECT id, count(*) AS pieces, min(piece) AS first_piece FROM g GROUP BY id")
def align_union(t):
    return J.align(features(t), "union", 7).select("id", "pieces", F.col("place.piece").cast("bigint").alias("first_piece"))


@query("align_report", f"WITH {FEATURES} SELECT piece, count(*) AS n_in, count(DISTINCT id) AS mapped, count(id) - count(DISTINCT id) AS duplicate, count(*) - count(id) AS unmapped FROM f GROUP BY piece")
def align_report(t):
    return J.align_report(features(t)).withColumn("piece", F.col("piece").cast("bigint"))


GENES = [(0, "CD3D", ["ENSG00000167286"], ["T3D", "CD3"]), (1, "CD3E", ["ENSG00000198851"], ["CD3", "T3E"]), (2, "T3D", ["915"], []), (3, "EGFR", ["ENSG00000146648", "P00533"], ["ERBB", "HER1"])]
NAMES = ["cd3d", "T3D", "CD3", "HER1", "ENSG00000146648.17", "P00533", "nope", "Unnamed: 0", "12345", ""]


@query("gene_resolve", "SELECT * FROM (VALUES ('cd3d', 'CD3D', 'CD3D'), ('T3D', 'T3D', 'T3D'), ('CD3', 'CD3D', 'CD3D'), ('HER1', 'EGFR', 'EGFR'), ('ENSG00000146648.17', 'EGFR', 'EGFR'), ('P00533', 'EGFR', 'EGFR'), ('nope', NULL, 'nope'), ('Unnamed: 0', NULL, NULL), ('12345', NULL, NULL), ('', NULL, NULL)) v(name, found, canonical)")
def gene_resolve(t):
    genes = t.spark.createDataFrame(GENES, "rec int, symbol string, ids array<string>, aliases array<string>")
    names = t.spark.createDataFrame([(n,) for n in NAMES], "name string")
    return J.with_fallback(J.resolve(names, genes)).select("name", "found", "canonical")


@query("gene_expand", "SELECT * FROM (VALUES ('CD3D', 0), ('CD3E', 0), ('EGFR', 1)) v(member, pos)")
def gene_expand(t):
    names = t.spark.createDataFrame([("CD3", 0), ("EGFR", 1), ("CD3E", 2)], "name string, pos int")
    members = t.spark.createDataFrame([("CD3", "CD3D", 0), ("CD3", "CD3E", 1)], "name string, member string, at int")
    return J.expand(names, members).select("member", "pos")


EVIDENCE = "ev AS (SELECT l_partkey % 200 AS gene, l_suppkey % 10 AS piece, CASE l_linestatus || l_returnflag WHEN 'OA' THEN 'P' WHEN 'OR' THEN 'X' WHEN 'FA' THEN 'x' WHEN 'FN' THEN 'F' ELSE 'R' END AS code FROM lineitem)"
CODES = f"{EVIDENCE}, co AS (SELECT gene, piece, CASE WHEN bool_or(code = 'P') THEN 'P' ELSE '' END || CASE WHEN bool_or(code = 'X') THEN 'X' ELSE '' END || CASE WHEN bool_or(code = 'x') THEN 'x' ELSE '' END || CASE WHEN bool_or(code = 'F') THEN 'F' ELSE '' END || CASE WHEN bool_or(code = 'R') THEN 'R' ELSE '' END AS codes FROM ev GROUP BY 1, 2)"


def codes(t: Tables) -> DataFrame:
    both = F.concat("l_linestatus", "l_returnflag")
    code = F.when(both == "OA", "P").when(both == "OR", "X").when(both == "FA", "x").when(both == "FN", "F").otherwise("R")
    return J.coverage_codes(t.lineitem.select(F.expr("l_partkey % 200").alias("gene"), F.expr("l_suppkey % 10").alias("piece"), code.alias("code")))


@query("coverage_codes", f"WITH {CODES} SELECT * FROM co")
def coverage_codes(t):
    return codes(t)


@query("coverage_counts", f"WITH {CODES} SELECT gene, count(*) FILTER (contains(codes, 'P')) AS n_protein, count(*) FILTER (contains(codes, 'X')) AS n_perturbed, count(*) FILTER (contains(codes, 'x')) AS n_genome_wide, count(*) FILTER (contains(codes, 'F')) AS n_focus, count(*) FILTER (contains(codes, 'R')) AS n_measured, count(*) FILTER (contains(codes, 'P')) + count(*) FILTER (contains(codes, 'X')) + count(*) FILTER (contains(codes, 'R')) > 0 AS covered FROM co GROUP BY gene")
def coverage_counts(t):
    return J.coverage_counts(codes(t))


@query("uncovered", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def uncovered(t):
    return t.part.join(t.lineitem.filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti").select("p_partkey")


STATUS = "CASE o_orderstatus WHEN 'F' THEN 'local' WHEN 'O' THEN 'fetchable' ELSE 'manual' END"


@query("resolve_min_rank", f"WITH o AS (SELECT o_custkey AS piece, {STATUS} AS status, o_orderkey AS lead, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 5 ELSE 7 END AS rank FROM orders) SELECT piece, arg_min(status, rank * 100000000 + lead) AS status, arg_min(lead, rank * 100000000 + lead) AS lead FROM o GROUP BY piece")
def resolve_min_rank(t):
    s = F.when(F.col("o_orderstatus") == "F", "local").when(F.col("o_orderstatus") == "O", "fetchable").otherwise("manual")
    return J.best_status(t.orders.select(F.col("o_custkey").alias("piece"), s.alias("status"), F.col("o_orderkey").alias("lead")))


RECORDS = "r AS (SELECT c_custkey AS id, [c_custkey % 11, c_custkey % 17 + 20] AS genes, c_nationkey AS chrom, c_custkey * 7 % 1000 AS s, c_custkey * 7 % 1000 + 25 AS e, c_mktsegment AS dataset FROM customer)"


@query("related_records", f"WITH {RECORDS}, o AS (SELECT * FROM r WHERE id = 42) SELECT r.id, rtrim(CASE WHEN len(list_intersect(r.genes, o.genes)) > 0 THEN 'genes,' ELSE '' END || CASE WHEN r.chrom = o.chrom AND r.s < o.e AND o.s < r.e THEN 'locus,' ELSE '' END || CASE WHEN r.dataset = o.dataset THEN 'dataset,' ELSE '' END, ',') AS reasons FROM r, o WHERE r.id <> 42 AND (len(list_intersect(r.genes, o.genes)) > 0 OR (r.chrom = o.chrom AND r.s < o.e AND o.s < r.e) OR r.dataset = o.dataset)")
def related_records(t):
    r = t.customer.select(F.col("c_custkey").alias("id"), F.expr("array(c_custkey % 11, c_custkey % 17 + 20)").alias("genes"), F.col("c_nationkey").alias("chrom"), F.expr("c_custkey * 7 % 1000").alias("start"), F.expr("c_custkey * 7 % 1000 + 25").alias("end"), F.col("c_mktsegment").alias("dataset"), F.array().cast("array<bigint>").alias("links"))
    return J.related(r, 42).select("id", F.array_join("reasons", ",").alias("reasons"))


@query("interval_overlap", "WITH a AS (SELECT s_suppkey AS id, s_nationkey AS chrom, s_suppkey * 13 % 5000 AS s, s_suppkey * 13 % 5000 + 400 AS e FROM supplier), b AS (SELECT c_custkey AS id, c_nationkey AS chrom, c_custkey * 7 % 5000 AS s, c_custkey * 7 % 5000 + 90 AS e FROM customer) SELECT a.id AS a_id, b.id AS b_id FROM a JOIN b ON a.chrom = b.chrom AND a.s < b.e AND b.s < a.e")
def interval_overlap(t):
    a = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("chrom"), F.expr("s_suppkey * 13 % 5000").alias("start"), F.expr("s_suppkey * 13 % 5000 + 400").alias("end"))
    b = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("chrom"), F.expr("c_custkey * 7 % 5000").alias("start"), F.expr("c_custkey * 7 % 5000 + 90").alias("end"))
    return J.interval_overlap(a, b, 250)


@query("array_overlap_rank", "WITH s AS (SELECT l_suppkey AS id, list(DISTINCT l_partkey % 40) AS g FROM lineitem GROUP BY 1) SELECT id, len(list_intersect([1, 2, 3, 5, 8, 13], g)) / 6.0::DOUBLE AS coverage FROM s WHERE len(list_intersect([1, 2, 3, 5, 8, 13], g)) > 0")
def array_overlap_rank(t):
    s = t.lineitem.groupBy(F.col("l_suppkey").alias("id")).agg(F.collect_set(F.expr("cast(l_partkey % 40 as string)")).alias("genes"))
    return J.overlap_rank(["1", "2", "3", "5", "8", "13"], s)


@query("facet_pivot", "SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY 1")
def facet_pivot(t):
    return t.events.groupBy("user_id").pivot("event_type", ["click", "purchase", "view"]).agg(F.count(F.lit(1))).na.fill(0)


@query("log_fold_last_write", "SELECT user_id, arg_max(value, event_id) FILTER (event_type = 'purchase') AS purchase, arg_max(props, event_id) FILTER (event_type = 'view') AS view, max(event_id) AS last FROM events GROUP BY 1")
def log_fold_last_write(t):
    e = t.events.select("user_id", "event_id", F.expr("if(event_type = 'purchase', value, null)").alias("purchase"), F.expr("if(event_type = 'view', props, null)").alias("view"))
    return L.last_write(e, "user_id", "event_id", ["purchase", "view"])


@query("log_fold_delete", "WITH e AS (SELECT user_id AS id, event_id AS line, CASE event_type WHEN 'signup' THEN 'add' WHEN 'error' THEN 'delete' ELSE 'update' END AS event, value FROM events), m AS (SELECT id, max(line) FILTER (event = 'add') AS a, max(line) FILTER (event = 'delete') AS d FROM e GROUP BY id) SELECT e.id, arg_max(value, line) AS value, max(line) AS last FROM e JOIN m ON e.id = m.id WHERE a IS NOT NULL AND (d IS NULL OR d < a) AND line >= a GROUP BY e.id")
def log_fold_delete(t):
    kind = F.when(F.col("event_type") == "signup", "add").when(F.col("event_type") == "error", "delete").otherwise("update")
    return L.book_fold(t.events.select(F.col("user_id").alias("id"), F.col("event_id").alias("line"), kind.alias("event"), "value"))


@query("dataset_trails", "WITH p AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), o AS (SELECT user_id, string_agg(event_type || ':' || n, ',' ORDER BY event_type) AS ops FROM p GROUP BY 1) SELECT e.user_id, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS bytes, min(ts) AS first, max(ts) AS last, any_value(ops) AS ops, count(DISTINCT CAST(ts AS DATE)) AS sessions FROM events e JOIN o ON o.user_id = e.user_id GROUP BY 1")
def dataset_trails(t):
    return L.trails(t.events.withColumn("day", F.to_date("ts")), "user_id", "event_type", "day", "ts", "event_id")


@query("journal_filter", "SELECT event_id FROM events WHERE event_type IN ('click', 'view') AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20' AND event_id % 1000 < 700 AND event_id % 1000 + 50 > 600 AND contains(lower(props), 'k')")
def journal_filter(t):
    e = t.events.select("event_id", F.col("event_type").alias("op"), F.col("ts").alias("t"), F.expr("array(event_id % 1000, event_id % 1000 + 50)").alias("window"), F.col("props").alias("raw"))
    stamp = lambda s: F.lit(s).cast("timestamp_ntz")
    return L.journal_filter(e, ops=["click", "view"], overlaps=[600, 700], since=stamp("2024-01-05"), until=stamp("2024-01-20"), text="K").select("event_id")


@query("window_coverage_grid", "WITH w AS (SELECT o_orderkey % 900 AS x0, o_orderkey % 900 + 60 AS x1, o_custkey % 900 AS y0, o_custkey % 900 + 30 AS y1 FROM orders), c AS (SELECT greatest(0, CAST(floor(x0 * 24 / 1000.0) AS INT)) AS i0, least(24, CAST(ceil(x1 * 24 / 1000.0) AS INT)) AS i1, greatest(0, CAST(floor(y0 * 24 / 1000.0) AS INT)) AS j0, least(24, CAST(ceil(y1 * 24 / 1000.0) AS INT)) AS j1 FROM w), i AS (SELECT j0, j1, unnest(range(i0, i1)) AS i FROM c), j AS (SELECT i, unnest(range(j0, j1)) AS j FROM i) SELECT CAST(j AS INT) AS j, CAST(i AS INT) AS i, count(*) AS n FROM j GROUP BY 1, 2")
def window_coverage_grid(t):
    w = t.orders.select(F.expr("o_orderkey % 900").alias("x0"), F.expr("o_orderkey % 900 + 60").alias("x1"), F.expr("o_custkey % 900").alias("y0"), F.expr("o_custkey % 900 + 30").alias("y1"))
    return L.coverage_grid(w, (0, 1000, 0, 1000), 24)


@query("status_report", f"WITH d AS (SELECT * FROM (VALUES ('local', 0), ('fetchable', 1), ('manual', 2), ('unresolved', 3)) v(status, rank)), p AS (SELECT {STATUS} AS status, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey END AS bytes FROM orders), g AS (SELECT status, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) FILTER (bytes IS NULL) AS unknown FROM p GROUP BY 1) SELECT d.status, rank, coalesce(n, 0) AS n, coalesce(bytes, 0) AS bytes, coalesce(unknown, 0) AS unknown FROM d LEFT JOIN g ON g.status = d.status")
def status_report(t):
    s = F.when(F.col("o_orderstatus") == "F", "local").when(F.col("o_orderstatus") == "O", "fetchable").otherwise("manual")
    return L.status_report(t.orders.select(s.alias("status"), F.expr("if(o_orderkey % 5 = 0, null, o_orderkey)").alias("bytes")), ["local", "fetchable", "manual", "unresolved"])


@query("review_queue", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE NOT coalesce(quality = 1, false)")
def review_queue(t):
    return L.unsettled(t.documents.join(t.labels.select("doc_id", (F.col("quality") == 1).alias("confident")), "doc_id", "left")).select("doc_id")


@query("dispatch_explode", "WITH x AS (SELECT doc_id, unnest(CASE WHEN doc_id % 10 = 0 THEN ['unassigned'] WHEN doc_id % 2 = 0 THEN [lang, source] ELSE [lang] END) AS target FROM documents) SELECT target, count(*) AS n, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS docs FROM x GROUP BY 1")
def dispatch_explode(t):
    targets = F.expr("case when doc_id % 10 = 0 then array() when doc_id % 2 = 0 then array(lang, source) else array(lang) end")
    x = t.documents.select("doc_id", F.explode_outer(targets).alias("t")).select("doc_id", F.coalesce("t", F.lit("unassigned")).alias("target"))
    return x.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda d: d.cast("string")), ",").alias("docs"))


@query("cohort_complete", "WITH s AS (SELECT user_id, date_trunc('week', ts) AS d, list(DISTINCT event_type) FILTER (event_type IN ('click', 'view')) AS have FROM events GROUP BY 1, 2) SELECT user_id AS subject, count(*) AS sessions FROM s GROUP BY 1 HAVING bool_and(len(coalesce(have, [])) = 2)")
def cohort_complete(t):
    return J.complete_subjects(t.events.select(F.col("user_id").alias("subject"), F.date_trunc("week", "ts").alias("session"), F.col("event_type").alias("sequence")), ["click", "view"])


@query("dup_suffix", "SELECT s_suppkey, CASE WHEN n = 1 THEN k ELSE k || '_' || n END AS unique_key FROM (SELECT s_suppkey, 'n' || s_nationkey AS k, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n FROM supplier)")
def dup_suffix(t):
    return J.suffixed(t.supplier.select("s_suppkey", F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("k")), "k", "s_suppkey").select("s_suppkey", "unique_key")


@query("one_per_run", "SELECT l_orderkey AS acc, l_partkey % 50 AS run, bool_or(l_returnflag = 'R') AS has_fastq, min(CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_quantity END) AS cost FROM lineitem GROUP BY 1, 2")
def one_per_run(t):
    from ..functions.routes import one_per_run as chosen

    fastq = F.col("l_returnflag") == "R"
    return chosen(t.lineitem.select(F.col("l_orderkey").alias("acc"), F.expr("l_partkey % 50").alias("run"), fastq.alias("has_fastq"), F.when(fastq, 0.0).otherwise(F.col("l_quantity")).alias("cost")), ["acc", "run"])


@query("route_rank", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, CASE WHEN o_orderstatus = 'P' THEN CAST('Infinity' AS DOUBLE) ELSE o_totalprice END, o_orderkey) AS INT) AS place FROM orders")
def route_rank(t):
    from ..functions.routes import ranked

    routes = t.orders.select("o_orderkey", "o_custkey", "o_orderpriority", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("cost"))
    return ranked(routes, ["o_custkey"], ["o_orderpriority"], "cost", "o_orderkey").select("o_orderkey", "place")


@query("cheapest_cost", "SELECT c, CASE WHEN r > 0 AND b = 0 THEN NULL ELSE round(b / 1073741824.0::DOUBLE * r, 9) END AS usd FROM (SELECT o_orderkey AS c, o_custkey * 1000000 AS b, CASE o_orderkey % 3 WHEN 0 THEN 0.0 WHEN 1 THEN 0.09 ELSE 0.12 END::DOUBLE AS r FROM orders)")
def cheapest_cost(t):
    from ..functions.scalars import egress_cost

    kind = F.expr("case o_orderkey % 3 when 0 then 'free' when 1 then 'aws-requester' else 'gcp-requester' end")
    return t.orders.select(F.col("o_orderkey").alias("c"), F.round(egress_cost(F.col("o_custkey") * 1_000_000, kind), 9).alias("usd"))


@query("time_hop_features", "WITH s AS (SELECT unnest([time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 6 HOUR]) AS start, value FROM events) SELECT start, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 4) AS sd, max(value) AS high, min(value) AS low FROM s GROUP BY 1")
def time_hop_features(t):
    return Y.hopping_features(t.events, "ts", "value", "12 hours", "6 hours").select("start", "n", F.round("mean", 6).alias("mean"), F.round("sd", 4).alias("sd"), "high", "low")


@query("describe_column_range", "WITH x AS (SELECT event_id, unnest([{'name': 'value', 'v': value}, {'name': 'user_id', 'v': CAST(user_id AS DOUBLE)}]) AS c FROM events) SELECT c.name AS name, round(avg(c.v) FILTER (event_id >= 1000 AND event_id < 3000), 6) AS mean_in, round(avg(c.v), 6) AS mean_all, round((avg(c.v) FILTER (event_id >= 1000 AND event_id < 3000) - avg(c.v)) / stddev_samp(c.v), 6) AS z FROM x GROUP BY 1")
def describe_column_range(t):
    return Y.describe_range(t.events, "event_id", 1000, 3000, ["value", "user_id"]).select("name", *[F.round(c, 6).alias(c) for c in ("mean_in", "mean_all", "z")])


@query("region_enrichment", "WITH bg AS (SELECT l_partkey AS gene, CAST(sum(l_quantity) AS BIGINT) AS t FROM lineitem GROUP BY 1), fg AS (SELECT l_partkey AS gene, CAST(sum(l_quantity) AS BIGINT) AS t FROM lineitem WHERE l_suppkey < 30 GROUP BY 1), j AS (SELECT bg.gene, coalesce(fg.t, 0)::DOUBLE AS o, bg.t / (SELECT sum(t) FROM bg) * (SELECT sum(t) FROM fg) AS e FROM bg LEFT JOIN fg ON fg.gene = bg.gene) SELECT gene, o AS observed, round(e, 6) AS expected, CASE WHEN abs(log2((o + 1) / (e + 1))) < 5e-7 THEN 0.0 ELSE round(log2((o + 1) / (e + 1)), 6) END AS lfc, CASE WHEN abs((o - e) / sqrt(e + 1)) < 5e-6 THEN 0.0 ELSE round((o - e) / sqrt(e + 1), 5) END AS z, CASE WHEN o >= 1 AND log2((o + 1) / (e + 1)) > 0 THEN 'enriched' WHEN e >= 1 AND log2((o + 1) / (e + 1)) < 0 THEN 'depleted' ELSE 'neither' END AS verdict FROM j")
def region_enrichment(t):
    per = lambda d: d.groupBy(F.col("l_partkey").alias("gene")).agg(F.sum("l_quantity").cast("bigint").alias("total"))
    return J.region_enrichment(per(t.lineitem.filter("l_suppkey < 30")), per(t.lineitem)).select("gene", "observed", F.round("expected", 6).alias("expected"), F.round("lfc", 6).alias("lfc"), F.round("z", 5).alias("z"), "verdict")


@query("evidence_softmax", "WITH l AS (SELECT * FROM (VALUES ('en', 0.5::DOUBLE), ('fr', 0.0), ('de', -0.5)) v(label, prior)), t AS (SELECT DISTINCT source AS target FROM documents), w AS (SELECT source AS target, lang AS label, sum(0.01::DOUBLE) AS w FROM documents GROUP BY 1, 2), e AS (SELECT t.target, l.label, exp(prior + coalesce(w, 0)) AS e FROM t CROSS JOIN l LEFT JOIN w ON w.target = t.target AND w.label = l.label) SELECT target, label, round(e / sum(e) OVER (PARTITION BY target), 6) AS p FROM e")
def evidence_softmax(t):
    ev = t.documents.select(F.col("source").alias("target"), F.col("lang").alias("label"), F.lit(0.01).alias("weight"))
    return Y.softmax_evidence(ev, {"en": 0.5, "fr": 0.0, "de": -0.5}).withColumn("p", F.round("p", 6))


@query("lru_prefix", "SELECT user_id, event_id FROM (SELECT user_id, event_id, sum(event_id % 50) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events WHERE event_type <> 'signup') WHERE coalesce(before, 0) < 300")
def lru_prefix(t):
    """Victims of each user's cache that needs 300 units: least recent first, pinned ones (signups) never."""
    residents = t.events.select("user_id", "event_id", "ts", F.expr("event_id % 50").alias("bytes"), (F.col("event_type") == "signup").alias("pinned"))
    return L.lru_victims_of(residents, "user_id", ["ts", "event_id"], 300).select("user_id", "event_id")


@query("relabel_offset", "WITH m AS (SELECT c_nationkey AS tile, max(c_custkey % 40) AS top FROM customer GROUP BY 1), o AS (SELECT tile, coalesce(sum(top) OVER (ORDER BY tile ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM m) SELECT c_custkey, CASE WHEN c_custkey % 40 = 0 THEN 0 ELSE CAST(c_custkey % 40 + base AS BIGINT) END AS label FROM customer JOIN o ON tile = c_nationkey")
def relabel_offset(t):
    from ..sources.sinks import relabelled

    return relabelled(t.customer.select("c_custkey", F.col("c_nationkey").alias("tile"), F.expr("c_custkey % 40").alias("label"))).select("c_custkey", "label")


@query("bitpack_widths", "WITH d AS (SELECT l_orderkey // 128 AS block, l_partkey AS v, l_partkey - lag(l_partkey) OVER (PARTITION BY l_orderkey // 128 ORDER BY l_orderkey, l_linenumber) AS d FROM lineitem), z AS (SELECT block, max(v) - min(v) AS r, max(CASE WHEN d < 0 THEN -2 * d - 1 ELSE 2 * d END) AS z FROM d GROUP BY block) SELECT block, CASE WHEN r = 0 THEN 0 ELSE length(bin(r)) END AS frame, CASE WHEN coalesce(z, 0) = 0 THEN 0 ELSE length(bin(z)) END AS delta FROM z")
def bitpack_widths(t):
    """Bits a value under a frame of reference and as zigzag deltas, per block; the narrower one is what a codec takes.

    Rows with the same line number of one order stay as they are stored: by file, in order of the names, and by row.
    """
    from ..functions.scalars import bit_width, zigzag

    w = Window.partitionBy("block").orderBy("l_orderkey", "l_linenumber", "file", "row_index")
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "_metadata.file_path", "_metadata.row_index")
    files = t.lineitem.select("_metadata.file_path").distinct().withColumn("file", F.row_number().over(Window.orderBy("file_path")))  # one row a file
    d = lines.join(F.broadcast(files), "file_path").withColumn("block", F.expr("l_orderkey div 128")).withColumn("d", F.col("l_partkey") - F.lag("l_partkey").over(w))
    z = d.groupBy("block").agg((F.max("l_partkey") - F.min("l_partkey")).alias("r"), F.max(zigzag(F.col("d"))).alias("z"))
    return z.select("block", bit_width(F.col("r")).cast("bigint").alias("frame"), bit_width(F.coalesce("z", F.lit(0))).cast("bigint").alias("delta"))


@query("spread_sample", "SELECT event_id, value FROM events WHERE event_id IN (SELECT i * n // least(40, n) FROM range(40) r(i), (SELECT count(*) AS n FROM events) WHERE i < n)")
def spread_sample(t):
    return t.events.filter(F.col("event_id").isin(*Y.spread_indices(t.events.count(), 40))).select("event_id", "value")


@query("read_plan_groups", "SELECT l_orderkey // 1000 AS grp, count(*) AS rows FROM lineitem GROUP BY 1 HAVING max(l_quantity) >= 49.5 AND min(l_quantity) <= 60")
def read_plan_groups(t):
    return t.lineitem.groupBy(F.expr("l_orderkey div 1000").alias("grp")).agg(F.count(F.lit(1)).alias("rows"), F.max("l_quantity").alias("hi"), F.min("l_quantity").alias("lo")).filter("hi >= 49.5 and lo <= 60").select("grp", "rows")


@query("union_ragged_columns", "SELECT s_suppkey AS key, s_name AS name, s_acctbal AS balance, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, NULL, c_mktsegment FROM customer")
def union_ragged_columns(t):
    a = t.supplier.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    b = t.customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return J.union_ragged([a, b])


@query("record_merge", "SELECT c_nationkey AS rec, count(*) AS n, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS aliases, min(c_name) AS symbol FROM customer GROUP BY 1")
def record_merge(t):
    merged = J.merge_records(t.customer, "c_nationkey", lists={"aliases": "c_mktsegment"}, first={"symbol": "c_name"})
    return merged.select(F.col("c_nationkey").alias("rec"), "n", F.array_join("aliases", ",").alias("aliases"), "symbol")


@query("upsert_merge", "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'kept' WHEN a.doc_id IS NULL THEN 'new' WHEN a.n_chars = b.item_len THEN 'same' ELSE 'updated' END AS action FROM (SELECT doc_id, n_chars FROM documents) a FULL OUTER JOIN (SELECT doc_id, quality AS item_len FROM labels) b ON a.doc_id = b.doc_id")
def upsert_merge(t):
    return J.upsert(t.documents.select("doc_id", "n_chars"), t.labels.select("doc_id", F.col("quality").alias("n_chars")), "doc_id").select("doc_id", "action")


@query("lazy_time_range", "SELECT event_id, value FROM events WHERE epoch(ts) >= 1704412800 AND epoch(ts) < 1704499200")
def lazy_time_range(t):
    from ..functions.scalars import epoch_seconds

    return W.lazy_window(t.events.withColumn("e", epoch_seconds(F.col("ts"))), "e", 1_704_412_800, 1_704_499_200, columns=["event_id", "value"])


@query("similar_tiles")
def similar_tiles(t):
    from .spatial import points

    profiles = Y.tile_profiles(points(t).withColumn("gene", F.expr("l_orderkey % 50")), 200, 100)
    return Y.similar_tiles(profiles, 2, 0, 200, 100, 5)


@query("sliding_similarity", "WITH d AS (SELECT CAST(ts AS DATE) AS day, avg(value) AS v FROM events GROUP BY 1), z AS (SELECT day, (v - (SELECT avg(v) FROM d)) / (SELECT stddev_pop(v) FROM d) AS z FROM d), w AS (SELECT day, z, lead(z, 1) OVER (ORDER BY day) AS z1, lead(z, 2) OVER (ORDER BY day) AS z2 FROM z) SELECT day, round(1 / (1 + (abs(z - 1) + abs(z1) + abs(z2 + 1)) / 3), 9) AS score FROM w WHERE z2 IS NOT NULL")
def sliding_similarity(t):
    series = t.events.groupBy(F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))
    return Y.sliding_distance(series, "day", "v", [1.0, 0.0, -1.0]).withColumn("score", F.round("score", 9))


@query(
    "catalogue_fold",
    """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id AS line, ts, CASE event_type WHEN 'signup' THEN 'record' WHEN 'view' THEN 'open' WHEN 'click' THEN 'stream' ELSE 'annotate' END AS ev FROM events),
       m AS (SELECT key, max(line) FILTER (ev = 'record') AS r, coalesce(max(line) FILTER (ev = 'record'), min(line) FILTER (ev = 'open')) AS s FROM e GROUP BY key)
       SELECT e.key, CASE WHEN r IS NULL THEN '' ELSE 't' || r END AS target, CAST(bool_or(ev = 'annotate') AS INT) AS n_facets, CAST(coalesce(sum(line % 100) FILTER (ev = 'stream'), 0) AS BIGINT) AS bytes_streamed,
           CASE WHEN bool_or(ev = 'annotate') THEN true END AS confident, arg_max(epoch_us(ts), line)::DOUBLE AS last_seen FROM e JOIN m ON m.key = e.key WHERE line >= s GROUP BY e.key, r""",
)
def catalogue_fold(t):
    kind = F.expr("case event_type when 'signup' then 'record' when 'view' then 'open' when 'click' then 'stream' else 'annotate' end")
    payload = F.when(F.col("event_type") == "click", F.format_string('{"bytes": %d}', F.expr("event_id % 100"))).when(F.col("event_type") == "signup", F.format_string('{"target": "t%d"}', F.col("event_id"))).otherwise(F.lit('{"facets": {"assay": "x"}, "confident": true}'))
    entries = L.catalogue_fold(t.events.select(F.col("event_id").alias("line"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), kind.alias("event"), F.col("user_id").cast("string").alias("key"), payload.alias("payload")))
    return entries.select("key", "target", F.size("facets").alias("n_facets"), "bytes_streamed", "confident", "last_seen")
