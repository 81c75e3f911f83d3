"""Queries on sparse matrices: cell = l_orderkey, gene = l_partkey, value = l_quantity; ``part`` names the genes, ``orders`` the cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import matrix as M
from .registry import Tables, query

COO = "coo AS (SELECT l_orderkey AS cell, l_partkey AS gene, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2)"
PREFIXES = ("x", "p")


def matrix(t: Tables) -> DataFrame:
    return M.coo(t.lineitem, "l_orderkey", "l_partkey", "l_quantity")


def genes(t: Tables) -> DataFrame:
    """Brands stand for the mitochondrial and ribosomal prefixes."""
    return t.part.select(F.col("p_partkey").alias("gene"), F.col("p_brand").alias("name"))


QC = f"""{COO}, named AS (SELECT c.*, p_brand LIKE 'Brand#1%' AS m, p_brand LIKE 'Brand#2%' AS r FROM coo c LEFT JOIN part ON gene = p_partkey),
    per AS (SELECT cell, sum(value) AS total, count(*) AS n_genes, sum(CASE WHEN m THEN value END) AS mito, sum(CASE WHEN r THEN value END) AS ribo FROM named GROUP BY cell),
    qc AS (SELECT cell, total, n_genes, CASE WHEN total > 0 THEN 100.0::DOUBLE * coalesce(mito, 0) / total ELSE 0 END AS pct_mito, CASE WHEN total > 0 THEN 100.0::DOUBLE * coalesce(ribo, 0) / total ELSE 0 END AS pct_ribo FROM per)"""


def qc(t: Tables) -> DataFrame:
    return M.qc_cells(matrix(t), genes(t), ("Brand#1",), ("Brand#2",))


@query("qc_cells", f"WITH {QC} SELECT cell, total, n_genes, round(pct_mito, 6) AS pct_mito, round(pct_ribo, 6) AS pct_ribo FROM qc")
def qc_cells(t):
    return qc(t).withColumns({c: F.round(c, 6) for c in ("pct_mito", "pct_ribo")})


GENE_QC = f"""{COO}, tot AS (SELECT cell, sum(value) AS total FROM coo GROUP BY cell), n AS (SELECT gene, value, value * 10000.0::DOUBLE / total AS norm, ln(1 + value * 10000.0::DOUBLE / total) AS lg FROM coo JOIN tot USING (cell) WHERE total > 0),
    gqc AS (SELECT gene, count(*) AS n_cells, sum(value) AS total, sum(norm) AS s_norm, sum(norm * norm) AS ss_norm, sum(lg) AS s_log, sum(lg * lg) AS ss_log FROM n GROUP BY gene)"""


@query("qc_genes", f"WITH {GENE_QC} SELECT gene, n_cells, total, round(s_norm, 3) AS s_norm, round(s_log, 5) AS s_log, round(ss_log, 4) AS ss_log FROM gqc")
def qc_genes(t):
    return M.qc_genes(matrix(t)).select("gene", "n_cells", "total", F.round("s_norm", 3).alias("s_norm"), F.round("s_log", 5).alias("s_log"), F.round("ss_log", 4).alias("ss_log"))


@query("filter_cells", f"WITH {QC} SELECT cell, (total >= 60 AND n_genes >= 3 AND pct_mito <= 50.0 AND total <= 400) AS kept FROM qc")
def filter_cells(t):
    return M.filter_cells(qc(t), 60, 3, 50.0, 400).select("cell", "kept")


@query("filter_genes", f"WITH {COO} SELECT gene, count(*) >= 25 AS kept FROM coo GROUP BY gene")
def filter_genes(t):
    return M.filter_genes(matrix(t).groupBy("gene").agg(F.count(F.lit(1)).alias("n_cells")), 25).select("gene", "kept")


@query("normalize_log1p", f"WITH {COO}, tot AS (SELECT cell, sum(value) AS total FROM coo GROUP BY cell) SELECT cell, gene, round(ln(1 + value * 10000.0::DOUBLE / total), 8) AS logged FROM coo JOIN tot USING (cell) WHERE total > 0")
def normalize_log1p(t):
    return M.normalised(matrix(t)).select("cell", "gene", F.round("logged", 8).alias("logged"))


@query(
    "hvg_topn",
    f"""WITH {GENE_QC}, nc AS (SELECT count(DISTINCT cell) AS n FROM coo),
    st AS (SELECT gene, s_norm / n AS mean, (ss_norm / n - (s_norm / n) * (s_norm / n)) * (n / (n - 1.0::DOUBLE)) AS var FROM gqc, nc),
    d AS (SELECT gene, mean, ln(var / mean) AS dispersion, ln(1 + mean) AS lm FROM st WHERE mean > 0 AND var > 0),
    e AS (SELECT min(lm) AS lo, max(lm) AS hi FROM d),
    b AS (SELECT d.*, least(19, floor((lm - lo) / (hi - lo) * 20)) AS bin FROM d, e),
    z AS (SELECT gene, CASE WHEN count(*) OVER w = 1 THEN 0 ELSE (dispersion - avg(dispersion) OVER w) / CASE WHEN coalesce(stddev_samp(dispersion) OVER w, 0) = 0 THEN 1 ELSE stddev_samp(dispersion) OVER w END END AS z FROM b WINDOW w AS (PARTITION BY bin))
    SELECT gene, round(z, 5) AS z FROM z ORDER BY z DESC, gene LIMIT 200""",
)
def hvg_topn(t):
    m = matrix(t)
    return M.variable_genes(M.qc_genes(m), m.select("cell").distinct().count(), 200).select("gene", F.round("z", 5).alias("z"))


@query("per_cell_totals", "SELECT o_orderkey AS cell, coalesce(sum(l_quantity), 0) AS total FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def per_cell_totals(t):
    return M.totals(t.orders, matrix(t), "o_orderkey")


@query("modality_nnz", f"WITH {COO} SELECT p_type AS modality, count(*) AS nnz FROM coo JOIN part ON gene = p_partkey GROUP BY 1")
def modality_nnz(t):
    return matrix(t).join(t.part.select(F.col("p_partkey").alias("gene"), F.col("p_type").alias("modality")), "gene").groupBy("modality").agg(F.count(F.lit(1)).alias("nnz"))


@query("modality_split", "SELECT p_type AS modality, min(p_partkey) AS first, max(p_partkey) AS last, count(*) AS n, max(p_partkey) - min(p_partkey) + 1 = count(*) AS contiguous FROM part GROUP BY 1")
def modality_split(t):
    return M.modality_split(t.part, "p_partkey", "p_type")


@query("cell_range_block", f"WITH {COO} SELECT cell, gene, value FROM coo WHERE cell >= 100 AND cell < 300 AND gene IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def cell_range_block(t):
    chosen = t.part.filter("p_size > 25").select(F.col("p_partkey").alias("gene"))
    return matrix(t).filter("cell >= 100 and cell < 300").join(chosen, "gene", "left_semi").select("cell", "gene", "value")


@query(
    "cell_enrichment",
    f"""WITH {COO}, sel AS (SELECT DISTINCT o_orderkey AS cell FROM orders WHERE o_orderpriority LIKE '1%'), nn AS (SELECT count(*) AS n FROM orders), sh AS (SELECT (SELECT count(*) FROM sel) / (n * 1.0::DOUBLE) AS share FROM nn),
    per AS (SELECT gene, sum(value) AS everywhere, sum(CASE WHEN cell IN (SELECT cell FROM sel) THEN value ELSE 0 END) AS observed FROM coo GROUP BY gene)
    SELECT gene, observed, round(everywhere * share, 6) AS expected, round(log2((observed + 1) / (everywhere * share + 1)), 6) AS lfc FROM per, sh""",
)
def cell_enrichment(t):
    chosen = t.orders.filter("o_orderpriority like '1%'").select(F.col("o_orderkey").alias("cell"))
    return J.cell_enrichment(chosen, matrix(t), t.orders.count()).select("gene", "observed", F.round("expected", 6).alias("expected"), F.round("lfc", 6).alias("lfc"))


@query("cells_window_semi", f"WITH {COO} SELECT cell, gene, value FROM coo WHERE cell IN (SELECT o_orderkey FROM orders WHERE o_totalprice >= 20000 AND o_totalprice < 60000)")
def cells_window_semi(t):
    inside = t.orders.filter("o_totalprice >= 20000 and o_totalprice < 60000").select(F.col("o_orderkey").alias("cell"))
    return matrix(t).join(inside, "cell", "left_semi")


@query("panel_zero_fill", f"WITH {COO}, g AS (SELECT p_partkey AS gene FROM part WHERE p_partkey <= 20), c AS (SELECT o_orderkey AS cell FROM orders) SELECT c.cell, g.gene, coalesce(value, 0) AS value FROM c CROSS JOIN g LEFT JOIN coo ON coo.cell = c.cell AND coo.gene = g.gene")
def panel_zero_fill(t):
    return J.zero_filled(t.part.filter("p_partkey <= 20").select(F.col("p_partkey").alias("gene")), t.orders.select(F.col("o_orderkey").alias("cell")), matrix(t))


@query("lut_join", f"WITH {COO} SELECT cell + 1000000 AS cell, p_size AS axis, value FROM coo JOIN part ON gene = p_partkey WHERE p_size <= 10")
def lut_join(t):
    lut = t.part.filter("p_size <= 10").select(F.col("p_partkey").alias("gene"), F.col("p_size").alias("axis"))
    return matrix(t).join(lut, "gene").select((F.col("cell") + 1_000_000).alias("cell"), "axis", "value")


@query("axis_overview", f"WITH {COO}, tot AS (SELECT cell, sum(value) AS total FROM coo GROUP BY cell) SELECT cell // 500 AS bucket, count(*) AS n, round(avg(total), 6) AS mean, max(total) AS high FROM tot GROUP BY 1")
def axis_overview(t):
    per = matrix(t).groupBy("cell").agg(F.sum("value").alias("total"))
    return per.groupBy(F.expr("cell div 500").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("total"), 6).alias("mean"), F.max("total").alias("high"))


@query("embedding_catalog", "SELECT label, count(*) AS n_obs, len(any_value(embedding)) AS dim FROM embeddings GROUP BY label")
def embedding_catalog(t):
    return t.embeddings.groupBy("label").agg(F.count(F.lit(1)).alias("n_obs"), F.max(F.size("embedding")).cast("bigint").alias("dim"))


@query("embedding_cosine", "SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 0) AS DOUBLE[])), 6) AS score FROM embeddings")
def embedding_cosine(t):
    from ..operators.similarity import cosine

    one = t.embeddings.filter("vec_id = 0").select(F.col("embedding").alias("q"))
    return t.embeddings.crossJoin(F.broadcast(one)).select("vec_id", F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("score"))  # one query row


@query("pca")
def pca(t):
    """Scores of each cell on five components of the most variable genes."""
    from ..sources.shared import stored

    m = stored(matrix(t), "matrix")  # summed once, read by each of the passes
    n = m.select("cell").distinct().count()
    top = M.variable_genes(M.qc_genes(m), n, 50).select("gene")
    kept = stored(M.normalised(m).join(top, "gene"), "normalised")
    stats = kept.groupBy("gene").agg(F.sum("logged").alias("s"), F.sum(F.col("logged") * F.col("logged")).alias("ss")).orderBy("gene").collect()  # a row a chosen gene
    means = [r["s"] / n for r in stats]
    devs = [(max(0.0, r["ss"] / n - (r["s"] / n) ** 2) * n / max(1, n - 1)) ** 0.5 for r in stats]
    return M.pca(kept, [r["gene"] for r in stats], means, devs, n, 5)[2]
