"""Further queries: images, libraries, vaults, cohorts, as-of checkpoints, harmonised tables, overviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import imaging as I
from ..operators import library as B
from ..operators import prep as R
from .matrices import COO, matrix
from .registry import query
from .spatial import POINTS, points

IMAGE = "img AS (SELECT CAST(l_suppkey AS BIGINT) AS y, CAST(l_partkey % 64 AS BIGINT) AS x, CAST(max(l_quantity) AS BIGINT) AS value FROM lineitem GROUP BY 1, 2)"


def image(t):
    return t.lineitem.groupBy(F.col("l_suppkey").cast("long").alias("y"), F.expr("l_partkey % 64").alias("x")).agg(F.max("l_quantity").cast("long").alias("value"))


@query(
    "image_pyramid",
    f"""WITH {IMAGE}, a AS (SELECT y // 2 AS y, x // 2 AS x, CAST(round_even(avg(value), 0) AS BIGINT) AS value FROM img GROUP BY 1, 2), b AS (SELECT y // 2 AS y, x // 2 AS x, CAST(round_even(avg(value), 0) AS BIGINT) AS value FROM a GROUP BY 1, 2)
    SELECT 0 AS level, * FROM img UNION ALL SELECT 1, * FROM a UNION ALL SELECT 2, * FROM b""",
)
def image_pyramid(t):
    return I.image_pyramid(image(t), 3)


@query("label_pyramid", f"WITH {IMAGE} SELECT y // 2 AS y, x // 2 AS x, arg_min(value, y * 1000 + x) AS value FROM img GROUP BY 1, 2")
def label_pyramid(t):
    return I.image_pyramid(image(t), 2, labels=True).filter("level = 1").drop("level")


@query(
    "cogrid_join",
    f"""WITH {IMAGE}, c AS (SELECT i // 16 AS iy, i % 16 AS ix FROM range(256) r(i)), l AS (SELECT iy, ix, CAST(floor(0.0 + 0.5 * (0.0 + (iy + 0.5) * (96 / 16))) AS BIGINT) AS y, CAST(floor(0.0 + 0.5 * (0.0 + (ix + 0.5) * (128 / 16))) AS BIGINT) AS x FROM c),
    s AS (SELECT y * 16 // 96 AS iy, x * 16 // 128 AS ix, CAST(sum(count) AS BIGINT) AS total FROM {POINTS} WHERE x < 128 AND y < 96 GROUP BY 1, 2)
    SELECT l.iy, l.ix, coalesce(total, 0) AS total, value FROM l LEFT JOIN img ON img.y = l.y AND img.x = l.x LEFT JOIN s ON s.iy = l.iy AND s.ix = l.ix""",
)
def cogrid_join(t):
    return I.paired(points(t), image(t), (0, 128, 0, 96), 16, 0.5)


@query("tile_windows", "SELECT CAST(i // 8 AS INT) AS ty, CAST(i % 8 AS INT) AS tx, CAST(greatest(0, i // 8 * 64 - 5) AS INT) AS y0, CAST(least(200, (i // 8 + 1) * 64 + 5) AS INT) AS y1, CAST(greatest(0, i % 8 * 64 - 5) AS INT) AS x0, CAST(least(500, (i % 8 + 1) * 64 + 5) AS INT) AS x1 FROM range(32) r(i)")
def tile_windows(t):
    return I.tile_windows(t.spark, 200, 500, 64, 5)


@query("library_query", "SELECT c_custkey AS id FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey = 7 AND c_custkey * 7 % 1000 < 800 AND c_custkey * 7 % 1000 + 40 > 100 AND contains(lower(c_name), '1')")
def library_query(t):
    r = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("kind"), F.col("c_nationkey").cast("string").alias("chrom"), F.expr("c_custkey * 7 % 1000").alias("start"), F.expr("c_custkey * 7 % 1000 + 40").alias("end"), F.col("c_name").alias("name"), F.lit("").alias("note"), F.col("c_custkey").alias("created"))
    return B.library_query(r, kind=("BUILDING", "MACHINERY"), locus=("7", 100, 800), text="1").select("id")


@query("vault_report", "SELECT CASE WHEN lang = 'es' THEN 'unprofiled' ELSE lang END AS assay, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS bytes, count(*) FILTER (lang <> 'es' AND NOT coalesce(quality = 1, false)) AS unsettled FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1")
def vault_report(t):
    d = t.documents.join(t.labels.select("doc_id", (F.col("quality") == 1).alias("confident")), "doc_id", "left")
    return B.vault_report(d.select(F.expr("if(lang = 'es', '', lang)").alias("assay"), F.col("n_chars").alias("bytes"), "confident"))


@query("vault_find", "SELECT page_id FROM pages WHERE regexp_matches(lower(url), '(^|[^a-z0-9])en($|[^a-z0-9])')")
def vault_find(t):
    return B.find_members(t.pages.select("page_id", F.col("url").alias("path"), F.octet_length("html").alias("bytes")), "en", exact=True).select("page_id")


@query("cohort_report", "SELECT user_id AS subject, count(DISTINCT CAST(ts AS DATE)) AS sessions, count(*) AS scans, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS sequences FROM events GROUP BY 1")
def cohort_report(t):
    return B.cohort_report(t.events.select(F.col("user_id").alias("subject"), F.to_date("ts").alias("session"), F.expr("if(event_id % 2 = 0, event_type, event_type || '_2')").alias("sequence")))


@query("longitudinal_pairs", "SELECT subject, before, after FROM (SELECT user_id AS subject, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS before, event_id AS after FROM events WHERE event_type = 'purchase') WHERE before IS NOT NULL")
def longitudinal_pairs(t):
    s = t.events.select(F.col("user_id").alias("subject"), F.col("event_id").alias("session"), F.col("event_type").alias("sequence"), F.col("props").alias("path"))
    return B.paired_sessions(s, "purchase").select("subject", "before", "after")


@query("asof_checkpoint", "WITH c AS (SELECT o_orderkey AS start, o_custkey AS off FROM orders WHERE o_orderkey % 500 = 0), w AS (SELECT doc_id AS record FROM documents) SELECT record, max(start) AS start, arg_max(off, start) AS \"offset\" FROM w LEFT JOIN c ON start <= record GROUP BY record")
def asof_checkpoint(t):
    c = t.orders.filter("o_orderkey % 500 = 0").select(F.col("o_orderkey").alias("start"), F.col("o_custkey").alias("offset"))
    return R.checkpoint_before(t.documents.select(F.col("doc_id").alias("record")), c)


@query("decode_categorical", "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE n_name END AS value FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def decode_categorical(t):
    codes = t.customer.select("c_custkey", F.expr("if(c_custkey % 7 = 0, -1, c_nationkey)").alias("code"))
    return R.decode_categorical(codes, t.nation.select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("label")))


@query("name_evidence", "SELECT url AS target, 'sequencing reads' AS label, 1.5::DOUBLE AS weight FROM pages WHERE regexp_matches(url, '\\.f(ast)?q(\\.gz)?$')")
def name_evidence(t):
    return B.name_evidence(t.pages, "url").filter("label = 'sequencing reads'").select("target", "label", "weight")


@query("dataset_keys", "SELECT page_id, substr(sha256(url || '|' || CAST(octet_length(encode(html)) AS VARCHAR)), 1, 16) AS key FROM pages")
def dataset_keys(t):
    return t.pages.select("page_id", B.dataset_key(F.col("url"), F.octet_length("html")).alias("key"))


@query("interval_vs_overview", f"WITH {COO}, tot AS (SELECT cell, sum(value) AS total FROM coo GROUP BY cell), b AS (SELECT cell // 500 AS bucket, avg(total) AS mean FROM tot GROUP BY 1) SELECT round(avg(mean) FILTER (bucket >= 4 AND bucket < 10), 6) AS mean_in, round(avg(mean), 6) AS mean_all, round((avg(mean) FILTER (bucket >= 4 AND bucket < 10) - avg(mean)) / stddev_pop(mean), 6) AS z FROM b")
def interval_vs_overview(t):
    per = matrix(t).groupBy("cell").agg(F.sum("value").alias("total"))
    b = per.groupBy(F.expr("cell div 500").alias("bucket")).agg(F.avg("total").alias("mean"))
    inside = F.avg(F.when((F.col("bucket") >= 4) & (F.col("bucket") < 10), F.col("mean")))
    return b.agg(F.round(inside, 6).alias("mean_in"), F.round(F.avg("mean"), 6).alias("mean_all"), F.round((inside - F.avg("mean")) / F.stddev_pop("mean"), 6).alias("z"))


@query("json_field_filter", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 50")
def json_field_filter(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k")).filter("k > 50")


@query("session_windows", "WITH s AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS grp FROM s) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS \"end\", count(*) AS n FROM g GROUP BY user_id, grp")
def session_windows(t):
    w = F.session_window("ts", "2 hours")
    return t.events.groupBy("user_id", w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


@query("reservation_replay")
def reservation_replay(t):
    from ..streaming.leases import Policy, replay

    e = t.events.select(F.expr("user_id % 10").alias("device"), F.expr("cast(event_id as double)").alias("t"), F.col("event_id").alias("line"), F.expr("case event_type when 'error' then 'release' when 'view' then 'touch' else 'reserve' end").alias("op"), F.col("user_id").cast("string").alias("holder"), F.expr("1 + event_id % 40").alias("amount"))
    return replay(e, 100, Policy(ttl=400, idle=150, max_share=0.5))


@query("status_machine", "WITH e AS (SELECT user_id AS id, event_id AS line, CASE event_type WHEN 'signup' THEN 'open' WHEN 'view' THEN 'described' WHEN 'click' THEN 'searched' WHEN 'error' THEN 'refuted' ELSE 'confirmed' END AS status FROM events) SELECT id, coalesce(arg_max(status, line) FILTER (status IN ('refuted', 'confirmed')), arg_max(status, CASE status WHEN 'open' THEN 1 WHEN 'described' THEN 2 WHEN 'searched' THEN 3 END)) AS status FROM e GROUP BY id")
def status_machine(t):
    from ..streaming.live import fold_status

    return fold_status(t.events.select(F.col("user_id").alias("id"), F.col("event_id").alias("line"), F.expr("case event_type when 'signup' then 'open' when 'view' then 'described' when 'click' then 'searched' when 'error' then 'refuted' else 'confirmed' end").alias("status")))


@query("bitpack_roundtrip", "SELECT l_orderkey // 1000 AS block, count(*) AS n, true AS same FROM lineitem GROUP BY 1")
def bitpack_roundtrip(t):
    from ..functions.codec import pack_column, unpack_column

    arrays = t.lineitem.groupBy(F.expr("l_orderkey div 1000").alias("block")).agg(F.array_sort(F.collect_list("l_partkey")).alias("v"))  # about 4000 values a block
    return arrays.select("block", F.size("v").cast("bigint").alias("n"), (unpack_column(pack_column(F.col("v"))) == F.col("v")).alias("same"))
