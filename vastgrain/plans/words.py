"""Queries on text and identifiers: scalars over ``documents``, ``conversations``, ``pages``, and text search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import vocabulary as V
from ..operators import text as X
from .registry import Tables, query


def _literal(t: Tables, values: list[str]) -> DataFrame:
    return t.spark.createDataFrame([(v,) for v in values], "s string")


def _values(values: list[str]) -> str:
    return "(VALUES " + ", ".join("('" + v.replace("'", "''") + "')" for v in values) + ") v(s)"


SIZES = ["8GB", "1.5 GiB", "512", "64mb", "3 k", "x", "2TB", " 10 B"]


@query("size_parse", f"SELECT s, CASE WHEN regexp_matches(upper(trim(s)), '^[0-9]+(\\.[0-9]+)?\\s*[KMGT]?I?B?$') THEN CAST(floor(CAST(regexp_extract(s, '[0-9]+(\\.[0-9]+)?') AS DOUBLE) * pow(1024, CASE regexp_extract(upper(trim(s)), '^[0-9.]+\\s*([KMGT]?)', 1) WHEN 'K' THEN 1 WHEN 'M' THEN 2 WHEN 'G' THEN 3 WHEN 'T' THEN 4 ELSE 0 END)) AS BIGINT) END AS bytes FROM {_values(SIZES)}")
def size_parse(t):
    return _literal(t, SIZES).select("s", S.parse_size(F.col("s")).alias("bytes"))


@query("size_human", "SELECT doc_id, CASE WHEN b < 1024 THEN printf('%d B', b) WHEN b < 1048576 THEN printf('%.1f KB', b / 1024.0::DOUBLE) WHEN b < 1073741824 THEN printf('%.1f MB', b / 1048576.0::DOUBLE) ELSE printf('%.1f GB', b / 1073741824.0::DOUBLE) END AS size FROM (SELECT doc_id, n_chars * n_chars AS b FROM documents)")
def size_human(t):
    return t.documents.select("doc_id", S.human_size(F.col("n_chars") * F.col("n_chars")).alias("size"))


@query("revcomp", "SELECT doc_id, translate(reverse(regexp_replace(translate(text, 'atugcrykm', 'ATUGCRYKM'), '[^ATUGCRYKM]', 'N', 'g')), 'ATUGCRYKM', 'TAACGYRMK') AS rc FROM documents")
def revcomp(t):
    return t.documents.select("doc_id", S.reverse_complement(F.col("text")).alias("rc"))


IDS = ["ENSG00000141510.12", "ENSMUSG00000059552", "HGNC:11998", "hgnc:5", "7157", "CD8A", "CD45", "CDw210a", "P04637", "Q9Y6K9-2", "TP53", "B3GNT2", "A0A024R1R8", "", " EGFR ", "1234567890"]


@query("id_type", f"SELECT s, CASE WHEN regexp_matches(trim(s), '^ENS[A-Z]*G[0-9]{{11}}(\\.[0-9]+)?$') THEN 'ensembl' WHEN regexp_matches(trim(s), '^[hH][gG][nN][cC]:[0-9]+$') THEN 'hgnc' WHEN regexp_matches(trim(s), '^[0-9]{{1,9}}$') THEN 'entrez' WHEN regexp_matches(trim(s), '^[cC][dD][wW]?[0-9]{{1,3}}[a-zA-Z]?$') THEN 'cd' WHEN regexp_matches(trim(s), '^([OPQ][0-9][A-Z0-9]{{3}}[0-9]|[A-NR-Z][0-9]([A-Z][A-Z0-9]{{2}}[0-9]){{1,2}})(-[0-9]+)?$') THEN 'uniprot' ELSE 'symbol' END AS kind FROM {_values(IDS)}")
def id_type(t):
    return _literal(t, IDS).select("s", S.id_type(F.col("s")).alias("kind"))


LOCI = ["chr7:55,019,017-55,211,628", "7:55.0M-55.3M", "chr1:0-100", "chr1:0", "X:1k-2k", "nonsense", "chr2:500-100", "CHR9:12345"]


@query("locus_parse", "SELECT * FROM (VALUES ('chr7:55,019,017-55,211,628', '7', 55019016::BIGINT, 55211628::BIGINT), ('7:55.0M-55.3M', '7', 54999999, 55300000), ('chr1:0-100', '1', 0, 100), ('chr1:0', '1', 0, 1), ('X:1k-2k', 'X', 999, 2000), ('nonsense', NULL, NULL, NULL), ('chr2:500-100', NULL, NULL, NULL), ('CHR9:12345', '9', 12344, 12345)) v(s, chrom, start, \"end\")")
def locus_parse(t):
    return _literal(t, LOCI).select("s", S.parse_locus(F.col("s")).alias("l")).select("s", "l.chrom", "l.start", "l.end")


ACCS = ["see GSE12345_RAW.tar and gse12345", "SRR1448774_1.fastq.gz; PRJNA123456", "Zenodo record 1234567, 10.5281/zenodo.1234567", "https://zenodo.org/records/7654321 and https://example.com/data.zip", "XGSE999 phs000123.v1.p1 EGAD00001000123", "doi 10.1038/s41586-020-0001-1.", ""]


@query(
    "accessions",
    """SELECT * FROM (VALUES ('see GSE12345_RAW.tar and gse12345', 'GSE12345:geo_series'), ('SRR1448774_1.fastq.gz; PRJNA123456', 'SRR1448774:sra_run,PRJNA123456:bioproject'),
       ('Zenodo record 1234567, 10.5281/zenodo.1234567', '10.5281/zenodo.1234567:zenodo_doi'), ('https://zenodo.org/records/7654321 and https://example.com/data.zip', '10.5281/zenodo.7654321:zenodo_doi,https://example.com/data.zip:url'),
       ('XGSE999 phs000123.v1.p1 EGAD00001000123', 'EGAD00001000123:ega_dataset,phs000123.v1.p1:dbgap'), ('doi 10.1038/s41586-020-0001-1.', '10.1038/s41586-020-0001-1:doi'), ('', '')) v(s, found)""",
)
def accessions(t):
    return _literal(t, ACCS).select("s", F.array_join(F.transform(S.accessions(F.col("s")), lambda a: F.concat_ws(":", a["id"], a["kind"])), ",").alias("found"))


COUNTS = ["~1.7M cells", "58,302 profiled; 19,834 after QC", "44 datasets, 1.2M cells", "44 datasets", "300", "12k nuclei from 9 donors", "none"]


@query("first_count", "SELECT * FROM (VALUES ('~1.7M cells', 1700000::BIGINT), ('58,302 profiled; 19,834 after QC', 58302), ('44 datasets, 1.2M cells', 1200000), ('44 datasets', NULL), ('300', 300), ('12k nuclei from 9 donors', 12000), ('none', NULL)) v(s, n)")
def first_count(t):
    return _literal(t, COUNTS).select("s", S.first_count(F.col("s"), ("cells", "nuclei", "spots")).alias("n"))


GENE_CELLS = ["CD276; CD274; CD47", "IL2 and IL7", "CD3, CD4, and CD8", "MYC/MAX", "TP53 (p53)", "N/A", "KO; 12; 7157; all"]


@query("gene_tokens", "SELECT * FROM (VALUES ('CD276; CD274; CD47', 'CD276,CD274,CD47'), ('IL2 and IL7', 'IL2,IL7'), ('CD3, CD4, and CD8', 'CD3,CD4,CD8'), ('MYC/MAX', 'MYC,MAX'), ('TP53 (p53)', 'TP53,p53'), ('N/A', ''), ('KO; 12; 7157; all', '7157')) v(s, genes)")
def gene_tokens(t):
    return _literal(t, GENE_CELLS).select("s", F.array_join(S.gene_tokens(F.col("s")), ",").alias("genes"))


PROTOCOLS = ["scRNA-seq; CROP-seq; 10x 3' (CRISPRi knockdown)", "Perturb-CITE-seq of human PBMC, open on Zenodo", "Western blots, no assay", "MS vs control, dbGaP; mouse and human tissue", "WES and MRIs of GBM; publication upon request", "CRISPRa-style overexpression in K562 cell line"]


@query(
    "vocab_facets",
    """SELECT * FROM (VALUES ('scRNA-seq; CROP-seq; 10x 3'' (CRISPRi knockdown)', 'scRNA-seq,CROP-seq', 'CRISPRi', '', ''), ('Perturb-CITE-seq of human PBMC, open on Zenodo', 'Perturb-CITE-seq', '', 'open', 'blood'),
       ('Western blots, no assay', '', '', '', ''), ('MS vs control, dbGaP; mouse and human tissue', '', '', 'controlled', 'tissue'), ('WES and MRIs of GBM; publication upon request', 'WES,MRI', '', 'on request', ''),
       ('CRISPRa-style overexpression in K562 cell line', '', 'ORF overexpression', '', 'cell line')) v(s, assays, perturbation, access, context)""",
)
def vocab_facets(t):
    s = F.col("s")
    return _literal(t, PROTOCOLS).select("s", F.array_join(V.ASSAY.labels(s), ",").alias("assays"), V.perturbation(s).alias("perturbation"), V.access_class(s).alias("access"), V.context(s).alias("context"))


@query(
    "vocab_facets_more",
    """SELECT * FROM (VALUES ('scRNA-seq; CROP-seq; 10x 3'' (CRISPRi knockdown)', 'scRNA-seq', 'scRNA-seq; CROP-seq; 10x 3'' (CRISPRi knockdown)'), ('MS vs control, dbGaP; mouse and human tissue', '', 'multiple sclerosis'), ('WES and MRIs of GBM; publication upon request', 'WES', 'glioblastoma')) v(s, primary_assay, disease)""",
)
def vocab_facets_more(t):
    s = F.col("s")
    return _literal(t, [PROTOCOLS[0], PROTOCOLS[3], PROTOCOLS[4]]).select("s", V.primary_assay(s).alias("primary_assay"), V.disease(s).alias("disease"))


@query("text_normalise", "SELECT doc_id, md5(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS h FROM documents")
def text_normalise(t):
    return t.documents.select("doc_id", F.md5(V.normalise(F.col("text"))).alias("h"))


@query("classify_url", "SELECT page_id, CASE WHEN regexp_matches(url, '^https?://') THEN 'url' ELSE 'unknown' END AS kind, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages")
def classify_url(t):
    return t.pages.select("page_id", S.accession_kind(F.col("url")).alias("kind"), F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"))


@query("natural_sort", "SELECT source, CAST(row_number() OVER (ORDER BY CAST(regexp_extract(source, '[0-9]+') AS INT)) AS INT) AS place FROM (SELECT DISTINCT source FROM documents)")
def natural_sort(t):
    from pyspark.sql import Window

    return t.documents.select("source").distinct().select("source", F.row_number().over(Window.orderBy(S.natural_key(F.col("source")))).alias("place"))


@query("seq_buckets", "SELECT doc_id // 64 AS bucket, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS bases, min(length(text)) AS min_len, max(length(text)) AS max_len, round(sum(length(text) - length(translate(text, 'GCgc', ''))) / sum(length(text)), 9) AS gc, round(sum(length(text) - length(translate(text, 'Nn', ''))) / sum(length(text)), 9) AS n_frac FROM documents GROUP BY 1")
def seq_buckets(t):
    b = X.read_buckets(t.documents, 64, "doc_id", "text")
    return b.select("bucket", "n", "bases", F.col("min_len").cast("bigint").alias("min_len"), F.col("max_len").cast("bigint").alias("max_len"), F.round("gc", 9).alias("gc"), F.round("n_frac", 9).alias("n_frac"))


@query("seq_zoom", "WITH e AS (SELECT greatest(1, (max(doc_id // 16) + 1 + 15) // 16) AS size FROM documents) SELECT (doc_id // 16) // size AS grp, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS bases, round(sum(length(text) - length(translate(text, 'GCgc', ''))) / sum(length(text)), 9) AS gc FROM documents, e GROUP BY 1")
def seq_zoom(t):
    b = X.read_buckets(t.documents, 16, "doc_id", "text")
    top = t.documents.agg(F.max(F.expr("doc_id div 16"))).first()[0] or 0
    return X.zoom_buckets(b, 0, top + 1, 16).select("grp", "n", "bases", F.round("gc", 9).alias("gc"))


@query("pattern_hits", "SELECT doc_id, len(regexp_extract_all(upper(text), 'THAT|NTNN')) AS hits FROM documents")
def pattern_hits(t):
    return X.pattern_counts(t.documents.select("doc_id", F.col("text").alias("seq")), "that").select("doc_id", F.col("hits").cast("bigint").alias("hits"))


@query("pattern_offsets")
def pattern_offsets(t):
    return X.pattern_offsets(t.documents, ["that", "there", "gattaca"], id_col="doc_id", seq="text")


@query("trigram_candidates", "WITH b AS (SELECT conv_id // 8 AS block, lower(text) AS t FROM conversations) SELECT DISTINCT block FROM b GROUP BY block HAVING bool_or(contains(t, 'the')) AND bool_or(contains(t, 'her')) AND bool_or(contains(t, 'ere'))")
def trigram_candidates(t):
    lines = t.conversations.select(F.col("conv_id").alias("line"), "text")
    return X.trigram_candidates(X.trigram_index(lines, 8), "there")


@query("text_contains", "SELECT conv_id, turn FROM conversations WHERE contains(lower(text), 'there')")
def text_contains(t):
    """No index is stored for these tables, so the lines are scanned once."""
    return X.search_lines(t.conversations, "There").select("conv_id", "turn")


@query("keyword_find", "SELECT doc_id FROM documents WHERE contains(lower(source || ' ' || text), 'license')")
def keyword_find(t):
    return t.documents.filter(F.lower(F.concat_ws(" ", "source", "text")).contains("license")).select("doc_id")


@query("tree_summary", "SELECT CASE WHEN regexp_matches(url, '\\.[a-z]+(\\?|#|$)') THEN regexp_extract(url, '\\.([a-z]+)(\\?|#|$)', 1) ELSE '' END AS ext, count(*) AS files, CAST(sum(octet_length(encode(html))) AS BIGINT) AS bytes FROM pages GROUP BY 1")
def tree_summary(t):
    return t.pages.groupBy(F.regexp_extract("url", r"\.([a-z]+)(\?|#|$)", 1).alias("ext")).agg(F.count(F.lit(1)).alias("files"), F.sum(F.octet_length("html")).alias("bytes"))


@query("largest_members", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10")
def largest_members(t):
    return t.documents.orderBy(F.desc("n_chars"), "doc_id").select("doc_id", "n_chars").limit(10)


@query("oversized", "SELECT doc_id, n_chars FROM documents WHERE n_chars > 8 * 1024")
def oversized(t):
    from .cost import parse_size

    return t.documents.filter(F.col("n_chars") > parse_size("8KB")).select("doc_id", "n_chars")


@query("shared_passages", "SELECT DISTINCT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def shared_passages(t):
    """Planted strings: benchmark items that stand in documents whole."""
    return X.contained_items(t.benchmark, t.documents)
