"""Queries on point clouds. ``lineitem`` plays the points: x = l_partkey, y = l_suppkey, gene = l_returnflag, count = l_quantity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import grid as G
from ..operators import windows as W
from .registry import Tables, query

POINTS = "(SELECT l_partkey AS x, l_suppkey AS y, l_returnflag AS gene, CAST(l_quantity AS BIGINT) AS count, l_orderkey, l_linenumber, l_extendedprice AS price FROM lineitem) p"
#: Half-open extents that hold at every scale factor used.
EXTENT = (0, 20_001, 0, 1_001)


def points(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_partkey").alias("x"), F.col("l_suppkey").alias("y"), F.col("l_returnflag").alias("gene"), F.col("l_quantity").cast("bigint").alias("count"), "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price"))


def px(c, lo, hi, size):
    return f"greatest(0, least({size - 1}, ({c} - {lo}) * {size} // {hi - lo}))"


@query("range_search", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE CAST(l_quantity AS DOUBLE) BETWEEN 10 AND 12")
def range_search(t):
    return W.range_search(t.lineitem, "l_quantity", 10, 12, ["l_orderkey", "l_linenumber"])


@query("lazy_window_2d", f"SELECT gene, count FROM {POINTS} WHERE x >= 100 AND x < 400 AND y >= 10 AND y < 60")
def lazy_window_2d(t):
    return W.lazy_window(points(t), "x", 100, 400, "y", 10, 60, ["gene", "count"])


@query("overlap_window", f"SELECT gene, x, y, count FROM {POINTS} WHERE x > 100 - 20 AND x < 300 AND y >= 0 AND y < 50 AND gene IN ('R', 'A')")
def overlap_window(t):
    return W.overlap_window(points(t), (100, 300, 5, 50), 20, genes=["R", "A"]).select("gene", "x", "y", "count")


@query("window_stride", "SELECT event_id, value FROM events WHERE event_id >= 100 AND event_id < 10000 AND (event_id - 100) % 4 = 0")
def window_stride(t):
    return W.stride_rows(W.lazy_window(t.events, "event_id", 100, 10_000), "event_id", 100, 4).select("event_id", "value")


@query("multi_gene_window", f"SELECT gene, CAST(sum(count) AS BIGINT) AS total FROM {POINTS} WHERE x >= 0 AND x < 1000 AND gene IN ('R', 'N') GROUP BY gene")
def multi_gene_window(t):
    return W.lazy_window(points(t), "x", 0, 1000).filter(F.col("gene").isin("R", "N")).groupBy("gene").agg(F.sum("count").cast("bigint").alias("total"))


@query(
    "polygon_filter",
    f"""SELECT x, y, gene FROM {POINTS} WHERE (
        (CASE WHEN (0.0 > y) <> (80.0 > y) AND x < (CAST(100 AS DOUBLE) - 1500) * (y - 80.0) / (0.0 - 80.0) + 1500 THEN 1 ELSE 0 END)
      + (CASE WHEN (80.0 > y) <> (40.0 > y) AND x < (CAST(1500 AS DOUBLE) - 900) * (y - 40.0) / (80.0 - 40.0) + 900 THEN 1 ELSE 0 END)
      + (CASE WHEN (40.0 > y) <> (0.0 > y) AND x < (CAST(900 AS DOUBLE) - 100) * (y - 0.0) / (40.0 - 0.0) + 100 THEN 1 ELSE 0 END)) % 2 = 1""",
)
def polygon_filter(t):
    return points(t).filter(W.in_polygon("x", "y", [(100, 0), (900, 40), (1500, 80)])).select("x", "y", "gene")


@query("value_range_predicate", "SELECT count(*) AS n, min(event_id) AS first, max(event_id) AS last, min(value) AS low, max(value) AS high FROM events WHERE event_id >= 500 AND event_id < 4000 AND value > 50")
def value_range_predicate(t):
    return W.describe_values(t.events, "event_id", 500, 4000, "value", ">", 50)


@query("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 120")
def limit_offset(t):
    return t.orders.select("o_orderkey").orderBy("o_orderkey").offset(120).limit(50)


@query(
    "raster",
    f"SELECT {px('y', 0, 1001, 32)} AS iy, {px('x', 0, 20001, 32)} AS ix, CAST(sum(count) AS BIGINT) AS total FROM {POINTS} WHERE x >= 0 AND x < 20001 AND y >= 0 AND y < 1001 AND gene = 'R' GROUP BY 1, 2",
)
def raster(t):
    return G.raster(points(t).filter("gene = 'R'"), EXTENT, 32)


@query("canvas_histogram", f"SELECT CAST(greatest(0, least(15, floor((price - 0.0) / 120000.0 * 16.0))) AS BIGINT) AS iy, CAST(greatest(0, least(31, floor((CAST(x AS DOUBLE) - 0.0) / 20000.0 * 32.0))) AS BIGINT) AS ix, count(*) AS n FROM {POINTS} GROUP BY 1, 2")
def canvas_histogram(t):
    return G.canvas(points(t), (0, 20_000, 0, 120_000), (16, 32), "x", "price")


@query(
    "canvas_summary",
    """WITH p AS (SELECT CASE WHEN event_type = 'error' THEN NULL WHEN event_id % 97 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE value END AS v, CAST(event_id AS DOUBLE) AS e FROM events),
       q AS (SELECT CASE WHEN v IS NULL OR isinf(v) OR isnan(v) THEN NULL ELSE greatest(0, least(7, floor(v / 400.0 * 8.0))) * 16 + greatest(0, least(15, floor(e / 100000.0 * 16.0))) END AS cell FROM p)
       SELECT count(cell) AS drawn, count(*) - count(cell) AS dropped, count(DISTINCT cell) AS cells_hit, count(DISTINCT cell) / 128.0::DOUBLE AS coverage FROM q""",
)
def canvas_summary(t):
    v = F.when(F.col("event_type") == "error", None).when(F.col("event_id") % 97 == 0, float("inf")).otherwise(F.col("value"))
    return G.canvas_summary(t.events.select(F.col("event_id").alias("e"), v.alias("v")), (0, 100_000, 0, 400), (8, 16), "e", "v")


DENSITY = f"SELECT {px('y', 0, 1001, 64)} AS gy, {px('x', 0, 20001, 64)} AS gx, CAST(sum(count) AS BIGINT) AS density, count(*) AS occupancy FROM {POINTS} GROUP BY 1, 2"


@query("density_index", DENSITY)
def density_index(t):
    return G.density_index(points(t), EXTENT, 64)


@query("rows_in_window", f"SELECT CAST(coalesce(sum(occupancy), 0) AS BIGINT) AS rows FROM ({DENSITY}) d WHERE gx BETWEEN 100 * 64 // 20001 AND 1499 * 64 // 20001 AND gy BETWEEN 10 * 64 // 1001 AND 89 * 64 // 1001")
def rows_in_window(t):
    return G.rows_in_window(G.density_index(points(t), EXTENT, 64), EXTENT, 64, (100, 1500, 10, 90))


@query("density_rebin", f"SELECT gy * 16 // 64 AS gy, gx * 16 // 64 AS gx, CAST(sum(density) AS BIGINT) AS density, CAST(sum(occupancy) AS BIGINT) AS occupancy FROM ({DENSITY}) d GROUP BY 1, 2")
def density_rebin(t):
    return G.rebin(G.density_index(points(t), EXTENT, 64), 64, 16)


@query("pool_2x", f"SELECT y // 2 AS y, x // 2 AS x, CAST(round_even(avg(count), 0) AS BIGINT) AS value FROM {POINTS} GROUP BY 1, 2")
def pool_2x(t):
    return G.pool(points(t), value="count")


@query("mip_projection", f"SELECT y, gene, max(count) AS value FROM {POINTS} GROUP BY 1, 2")
def mip_projection(t):
    return G.max_projection(points(t), ["y", "gene"], "count")


@query("aggregate_location", f"SELECT x, y, CAST(sum(count) AS BIGINT) AS total FROM {POINTS} GROUP BY 1, 2")
def aggregate_location(t):
    return G.aggregate_points(points(t), "x", "y", "count")


@query(
    "zorder_key",
    f"""WITH a AS (SELECT l_orderkey, l_linenumber, x // 8 AS a0, y // 8 AS b0 FROM {POINTS}),
        s1 AS (SELECT *, (a0 | (a0 << 16)) & 281470681808895 AS a1, (b0 | (b0 << 16)) & 281470681808895 AS b1 FROM a),
        s2 AS (SELECT *, (a1 | (a1 << 8)) & 71777214294589695 AS a2, (b1 | (b1 << 8)) & 71777214294589695 AS b2 FROM s1),
        s3 AS (SELECT *, (a2 | (a2 << 4)) & 1085102592571150095 AS a3, (b2 | (b2 << 4)) & 1085102592571150095 AS b3 FROM s2),
        s4 AS (SELECT *, (a3 | (a3 << 2)) & 3689348814741910323 AS a4, (b3 | (b3 << 2)) & 3689348814741910323 AS b4 FROM s3),
        s5 AS (SELECT *, (a4 | (a4 << 1)) & 6148914691236517205 AS a5, (b4 | (b4 << 1)) & 6148914691236517205 AS b5 FROM s4)
        SELECT l_orderkey, l_linenumber, a5 | (b5 << 1) AS z FROM s5""",
)
def zorder_key(t):
    return points(t).select("l_orderkey", "l_linenumber", G.morton(F.expr("x div 8"), F.expr("y div 8")).alias("z"))


@query("bin_pyramid", f"SELECT bin, gene, x - x % bin AS x, y - y % bin AS y, CAST(sum(count) AS BIGINT) AS count FROM {POINTS}, (VALUES (50), (100), (200)) b(bin) GROUP BY 1, 2, 3, 4")
def bin_pyramid(t):
    return G.bin_pyramid(points(t), [50, 100, 200])


OFFSETS = f"SELECT gene, CAST(coalesce(sum(n) OVER (ORDER BY gene ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_row, n FROM (SELECT l_partkey AS gene, count(*) AS n FROM lineitem GROUP BY 1) g"


@query("gene_offsets", OFFSETS)
def gene_offsets(t):
    return G.gene_offsets(t.lineitem, "l_partkey")


@query("gene_range_join", f"SELECT e.event_id AS row, o.gene FROM events e LEFT JOIN ({OFFSETS}) o ON e.event_id >= o.first_row AND e.event_id < o.first_row + o.n")
def gene_range_join(t):
    return G.gene_of_row(t.events.select(F.col("event_id").alias("row")), G.gene_offsets(t.lineitem, "l_partkey"))


@query("top_genes", "SELECT l_partkey AS gene, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total FROM lineitem GROUP BY 1 ORDER BY total DESC, gene LIMIT 20")
def top_genes(t):
    return G.top_genes(t.lineitem.select(F.col("l_partkey").alias("gene"), F.col("l_quantity").cast("bigint").alias("count")), 20)


@query(
    "weighted_centroid",
    f"""WITH g AS (SELECT * FROM (VALUES ('R'), ('A'), ('Q')) v(gene)),
        c AS (SELECT gene, CAST(sum(count) AS BIGINT) AS total, count(*) AS rows, sum(x * count) / sum(count) AS cx, sum(y * count) / sum(count) AS cy FROM {POINTS} GROUP BY 1)
        SELECT g.gene, coalesce(total, 0) AS total, coalesce(rows, 0) AS rows, round(cx, 6) AS cx, round(cy, 6) AS cy, rows IS NULL AS absent FROM g LEFT JOIN c ON g.gene = c.gene""",
)
def weighted_centroid(t):
    genes = t.spark.createDataFrame([("R",), ("A",), ("Q",)], "gene string")
    return G.centroids(points(t), genes).withColumn("cx", F.round("cx", 6)).withColumn("cy", F.round("cy", 6))


@query("hit_profile", "WITH e AS (SELECT min(doc_id) AS lo, greatest(max(doc_id), min(doc_id) + 1) AS hi FROM documents) SELECT least(31, ((doc_id - lo) * 32) // (hi - lo)) AS bucket, count(*) AS n FROM documents, e WHERE contains(text, 'the') GROUP BY 1")
def hit_profile(t):
    lo, hi = t.documents.agg(F.min("doc_id"), F.max("doc_id")).first()
    lo = lo or 0
    return G.hit_profile(t.documents.filter(F.col("text").contains("the")), lo, max(hi or 0, lo + 1), 32, "doc_id")


@query("point_extent", f"SELECT min(x) AS x0, max(x) + 1 AS x1, min(y) AS y0, max(y) + 1 AS y1, count(*) AS rows, count(DISTINCT gene) AS genes FROM {POINTS}")
def point_extent(t):
    return G.extent(points(t))


@query("pick_level", "SELECT bin, rows FROM (SELECT bin, count(*) AS rows FROM (SELECT DISTINCT bin, x - x % bin AS bx, y - y % bin AS by FROM (SELECT l_partkey AS x, l_suppkey AS y FROM lineitem) p, (VALUES (1), (50), (200), (1000)) b(bin)) d GROUP BY bin) c WHERE rows * 12 <= 40000 ORDER BY bin LIMIT 1")
def pick_level(t):
    """Level-of-detail choice: the finest level whose bins fit a byte budget at 12 bytes a bin."""
    from .cost import pick_level as choose

    levels = points(t).select("x", "y", F.explode(F.array(*[F.lit(b) for b in (1, 50, 200, 1000)])).alias("bin"))
    sizes = levels.select("bin", F.expr("x - x % bin").alias("bx"), F.expr("y - y % bin").alias("by")).distinct().groupBy("bin").agg(F.count(F.lit(1)).alias("rows"))
    return choose(sizes, 12, 40_000)
