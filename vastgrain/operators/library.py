"""Queries and reports over records of all kinds: filters, audits, checksums, evidence from names, dataset keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .folds import windows_overlap  # noqa: F401  (part of this interface)


def _one_of(c: Column, wanted) -> Column:
    return c.isin(*wanted) if isinstance(wanted, (list, tuple, set)) else c == wanted


def library_query(records: DataFrame, *, kind=None, intent=None, status=None, tag=None, gene=None, locus: tuple[str, int, int] | None = None, build: str | None = None, dataset=None, text: str | None = None, since=None, where: Column | None = None) -> DataFrame:
    """Records that meet every condition given, oldest first. Values may be tuples; ``gene`` overlaps; ``locus`` overlaps half-open on its build."""
    cond = F.lit(True)
    for name, wanted in (("kind", kind), ("intent", intent), ("status", status), ("dataset", dataset)):
        if wanted is not None:
            cond &= _one_of(F.col(name), wanted)
    if tag is not None:
        cond &= F.array_contains("tags", tag)
    if gene is not None:
        wanted = [gene] if isinstance(gene, str) else list(gene)
        cond &= F.arrays_overlap(F.transform("genes", F.upper), F.array(*[F.lit(g.upper()) for g in wanted]))
    if locus is not None:
        chrom, start, end = locus
        cond &= (F.col("chrom") == chrom) & (F.col("start") < end) & (F.col("end") > start)
    if build is not None:
        cond &= F.col("build") == build
    if text is not None:
        cond &= F.lower(F.concat_ws(" ", "name", "note")).contains(text.lower())
    if since is not None:
        cond &= F.col("created") >= since
    if where is not None:
        cond &= where
    return records.filter(F.coalesce(cond, F.lit(False))).orderBy("created", "id")


def audit(lines: DataFrame, kinds: Mapping[str, str], line: str = "line", value: str = "value") -> DataFrame:
    """Fields of JSON lines with another type than wanted: ``line, field, found``. ``kinds`` are Spark types as JSON knows them (string, bigint, double, boolean, array, struct)."""
    problems = []
    for name, wanted in kinds.items():
        raw = F.get_json_object(value, f"$.{name}")
        text = F.trim(F.regexp_extract(value, rf'"{name}"\s*:\s*("|\[|\{{|-?\d+(?:\.\d+)?|true|false|null)', 1))
        found = F.when(text == '"', "string").when(text == "[", "array").when(text == "{", "struct").when(text.isin("true", "false"), "boolean").when(text.rlike(r"^-?\d+$"), "bigint").when(text.rlike(r"^-?\d+\.\d+$"), "double")
        bad = raw.isNotNull() & (found != wanted) & ~((found == "bigint") & F.lit(wanted == "double"))
        problems.append(F.when(bad, F.struct(F.lit(name).alias("field"), found.alias("found"))))
    return lines.select(line, F.explode(F.array_compact(F.array(*problems))).alias("p")).select(line, "p.field", "p.found")


def checksums(files: DataFrame) -> DataFrame:
    """``path, sha256`` of a listing read with the binary reader."""
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def verify_checksums(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """``path, ok``: the file is there and its digest is the manifest's."""
    have = checksums(files).withColumnRenamed("sha256", "found")
    return manifest.join(have, "path", "left").select("path", F.coalesce(F.col("sha256") == F.col("found"), F.lit(False)).alias("ok"))


# What file names suggest: pattern, label, weight.
NAME_EVIDENCE = (
    (r"\.h5ad$", "scRNA-seq", 1.5), (r"\.gef$|\.gem(\.gz)?$", "Stereo-seq", 3.0), (r"_[tT][12]w?[._]|flair", "MRI", 2.0), (r"\.nii(\.gz)?$", "MRI", 2.5), (r"transcripts\.parquet$", "Xenium", 2.5),
    (r"tissue_positions", "Visium", 2.5), (r"fragments\.tsv", "scATAC-seq", 2.0), (r"\.f(ast)?q(\.gz)?$", "sequencing reads", 1.5), (r"\.ome\.tiff?$", "imaging", 1.5),
)


def name_evidence(files: DataFrame, path: str = "path") -> DataFrame:
    """Evidence rows ``target, label, weight, source`` out of file names."""
    hits = F.array_compact(F.array(*[F.when(F.col(path).rlike(p), F.struct(F.lit(label).alias("label"), F.lit(w).alias("weight"))) for p, label, w in NAME_EVIDENCE]))
    return files.select(F.col(path).alias("target"), F.explode(hits).alias("h")).select("target", "h.label", "h.weight", F.lit("name").alias("source"))


def confident(profile: DataFrame) -> DataFrame:
    """``target, label, p, confident``: the most likely label, sure above 0.6 with a lead over 0.25. ``profile`` has ``target, label, p``."""
    ranked = profile.groupBy("target").agg(F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("n"), "label"))).alias("r"))  # a row a label
    first, second = F.try_element_at("r", F.lit(1)), F.try_element_at("r", F.lit(2))
    p, q = -first["n"], F.coalesce(-second["n"], F.lit(0.0))
    return ranked.select("target", first["label"].alias("label"), p.alias("p"), ((p > 0.6) & (p - q > 0.25)).alias("confident"))


def sniff(files: DataFrame, n: int = 65_536) -> DataFrame:
    """``path, format, gzip`` from the first bytes of a binary listing."""
    head = F.substring(F.col("content"), 1, n)
    hexed = F.hex(F.substring(F.col("content"), 1, 8))
    first = F.decode(F.substring(F.col("content"), 1, 1), "ISO-8859-1")
    kind = (
        F.when(hexed.startswith("1F8B"), "gzip").when(hexed.startswith("50415231"), "parquet").when(hexed.startswith("894844460D0A1A0A"), "hdf5").when(hexed.startswith("4152524F5731"), "arrow").when(hexed.startswith("49492A00") | hexed.startswith("4D4D002A"), "tiff")
        .when(hexed.startswith("5C010000"), "nifti").when(first == "@", "fastq").when(first == ">", "fasta").when(first.isin("{", "["), "json").when(F.octet_length(head) == 0, "empty").otherwise("unknown")
    )
    return files.select("path", kind.alias("format"), hexed.startswith("1F8B").alias("gzip"))


def dataset_key(path: Column, size: Column) -> Column:
    """A short opaque key of a file: it changes when the path or the size does."""
    return F.substring(F.sha2(F.concat_ws("|", path, size.cast("string")), 256), 1, 16)


def vault_report(members: DataFrame) -> DataFrame:
    """``assay, n, bytes, unsettled`` of a vault; members without an assay are ``unprofiled``; unsettled are profiled ones nobody is confident of."""
    assay = F.coalesce(F.nullif(F.col("assay"), F.lit("")), F.lit("unprofiled"))
    return members.groupBy(assay.alias("assay")).agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.count_if((F.coalesce("assay", F.lit("")) != "") & ~F.coalesce("confident", F.lit(False))).alias("unsettled"))


def find_members(members: DataFrame, needle: str = "", exact: bool = False, assay: str = "", fmt: str = "", min_bytes: int = 0) -> DataFrame:
    """Vault members by text (a whole token with ``exact``), assay, format and size; the largest first."""
    import re

    cond = F.col("bytes") >= min_bytes
    low = F.lower("path")
    if needle:
        cond &= low.rlike(rf"(?<![a-z0-9]){re.escape(needle.lower())}(?![a-z0-9])") if exact else low.contains(needle.lower())
    if assay:
        cond &= F.col("assay") == assay
    if fmt:
        cond &= F.col("format") == fmt
    return members.filter(cond).orderBy(F.desc("bytes"), "path")


def cohort_report(scans: DataFrame) -> DataFrame:
    """Per subject: sessions, scans, and distinct sequences (suffixes of repeats aside), in order."""
    plain = F.regexp_replace("sequence", r"_\d+$", "")
    return scans.groupBy("subject").agg(F.count_distinct("session").alias("sessions"), F.count(F.lit(1)).alias("scans"), F.array_join(F.array_sort(F.collect_set(plain)), ",").alias("sequences"))


def paired_sessions(scans: DataFrame, sequence: str) -> DataFrame:
    """Consecutive sessions of a subject that both have a sequence: ``subject, before, after, path_before, path_after``."""
    from pyspark.sql import Window

    w = Window.partitionBy("subject").orderBy("session")
    own = scans.filter(F.col("sequence") == sequence)
    return own.select("subject", F.lag("session").over(w).alias("before"), F.col("session").alias("after"), F.lag("path").over(w).alias("path_before"), F.col("path").alias("path_after")).filter("before is not null")


def missing_facets(rows: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Rows completed to every facet, '' where unset: a column for each out of a map ``facets``."""
    return rows.select("key", *[F.coalesce(F.try_element_at("facets", F.lit(f)), F.lit("")).alias(f) for f in wanted])
