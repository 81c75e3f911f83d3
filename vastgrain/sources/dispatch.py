"""Open anything: the reader follows from the target's shape and extension. Recognise bundles and series by their file names."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import containers, http, images, readers

#: Extension to format; the longest that fits counts.
FORMATS = {
    ".parquet": "parquet", ".orc": "orc", ".json": "json", ".jsonl": "json", ".ndjson": "json", ".csv": "csv", ".tsv": "tsv", ".fa": "fastx", ".fasta": "fastx", ".fq": "fastx", ".fastq": "fastx",
    ".fa.gz": "fastx", ".fasta.gz": "fastx", ".fq.gz": "fastx", ".fastq.gz": "fastx", ".mtx": "mtx", ".mtx.gz": "mtx", ".gem": "gem", ".gem.gz": "gem", ".arrow": "arrow_ipc", ".feather": "arrow_ipc",
    ".ipc": "arrow_ipc", ".nii": "nifti", ".nii.gz": "nifti", ".txt": "text", ".log": "text", ".h5ad": "h5ad", ".h5": "tenx_h5", ".gef": "gef", ".tif": "tiff", ".tiff": "tiff", ".btf": "tiff", ".zarr": "zarr", ".dcm": "dicom",
}
#: Containers that nothing here reads; they are to be converted to the tables named.
UNSUPPORTED = {".xlsx": "CSV", ".xls": "CSV", ".rds": "MatrixMarket", ".loom": "h5ad"}
#: Formats of the Python data sources, and the module that registers them.
SOURCES = {"fastx": readers, "mtx": readers, "gem": readers, "arrow_ipc": readers, "nifti": readers, "h5ad": containers, "tenx_h5": containers, "gef": containers, "tiff": images, "zarr": images, "dicom": images}


def format_of(target: str) -> str:
    """The format of a path; ValueError for an extension nothing reads."""
    low = target.lower().rstrip("/")
    for ext in sorted(FORMATS, key=len, reverse=True):
        if low.endswith(ext):
            return FORMATS[ext]
    for ext, table in UNSUPPORTED.items():
        if low.endswith(ext):
            raise ValueError(f"{ext} is a container without a reader here; store it as {table}")
    raise ValueError(f"no reader for {target}")


def load(spark: SparkSession, target: str | Sequence[str], columns: Sequence[str] | None = None, **options) -> DataFrame:
    """A DataFrame of a path, a glob, a folder of Parquet files, a URL of a Parquet file, or a list of such of one format.

    Folders of DICOM slices and Zarr arrays are opened by their ending, or by ``format``."""
    paths = [target] if isinstance(target, str) else list(target)
    local = paths[0].removeprefix("file://")
    if "format" in options:
        kind = options.pop("format")
    elif os.path.isdir(local) and not local.lower().endswith(tuple(FORMATS)):
        kind = "parquet"
    else:
        kind = format_of(paths[0])
    if paths[0].startswith(("http://", "https://")) and kind == "parquet":
        return http.open_urls(spark, paths, columns, **options)
    if kind in SOURCES:
        SOURCES[kind].register(spark)
        frames = [spark.read.format(kind).options(**options).load(p) for p in paths]
        df = frames[0]
        for f in frames[1:]:
            df = df.unionByName(f)
    elif kind in ("csv", "tsv"):
        df = spark.read.options(**{"header": True, "sep": "\t" if kind == "tsv" else ",", **options}).csv(paths)
    else:
        df = spark.read.options(**options).format(kind).load(paths)
    return df.select(*columns) if columns else df


def is_hub_id(target: str, exists: bool) -> bool:
    """``org/name``: exactly one slash, and nothing on disk goes by it."""
    return not exists and "://" not in target and target.count("/") == 1 and all(target.split("/"))


def hub_url(repo: str, config: str, split: str, file: str, host: str = "https://huggingface.co") -> str:
    """Where a converted Parquet file of a hub dataset lies."""
    from urllib.parse import quote

    return f"{host}/datasets/{quote(repo, safe='/')}/resolve/refs%2Fconvert%2Fparquet/{quote(config)}/{quote(split)}/{quote(file)}"


# What files tell of a bundle, in the order tried: kind, endings that must all be there (any of each group).
BUNDLES = (
    ("xenium", (("transcripts.parquet", "cell_feature_matrix.h5"), ("experiment.xenium",))),
    ("visium-hd", (("scalefactors_json.json", "tissue_positions.csv", "tissue_positions_list.csv"), ("binned_outputs/",))),
    ("visium", (("scalefactors_json.json", "tissue_positions.csv", "tissue_positions_list.csv"),)),
    ("cosmx", (("_tx_file.csv", "_exprmat_file.csv", "_metadata_file.csv"),)),
    ("merfish", (("detected_transcripts.csv", "cell_by_gene.csv"),)),
    ("cellranger", (("filtered_feature_bc_matrix.h5", "raw_feature_bc_matrix.h5"),)),
    ("mtx-triple", (("matrix.mtx.gz", "matrix.mtx"),)),
    ("stomics", ((".gef",),)),
    ("imzml", ((".imzml",),)),
    ("multiplexed-imaging", ((".ome.tif", ".ome.tiff", ".qptiff"),)),
)


def sniff_bundles(files: DataFrame, folder: str = "folder", path: str = "path") -> DataFrame:
    """The kind of every folder of a listing, in one aggregate: ``folder, kind``."""
    low = F.lower(path)

    def some(ends: Iterable[str]):
        cond = F.lit(False)
        for e in ends:
            cond = cond | (low.contains(e) if e.endswith("/") else low.endswith(e))
        return F.bool_or(cond)

    kind = F.lit("directory")
    for name, groups in reversed(BUNDLES):
        cond = F.lit(True)
        for g in groups:
            cond = cond & some(g)
        kind = F.when(cond, name).otherwise(kind)
    return files.groupBy(folder).agg(kind.alias("kind"))


# Names of magnetic resonance sequences.
SEQUENCES = ("T1w", "T2w", "FLAIR", "DWI", "PD", "SWI", "MASK")


def guess_sequence(name: str) -> str:
    """The modality whose token ends last in a file name; '' without any."""
    low = name.lower()
    best, end = "", -1
    for label in SEQUENCES:
        stem = label.lower().rstrip("w")
        for m in re.finditer(rf"(?:^|[^a-z0-9])({stem}w?|{'lesion|seg|' if label == 'MASK' else ''}{stem})(?=$|[^a-z0-9])", low):
            if m.end() > end:
                best, end = label, m.end()
    return best


def cohort(files: DataFrame, layouts: Sequence[str] = (r"sub-([A-Za-z0-9]+)/ses-([A-Za-z0-9]+)/", r"([A-Za-z]+[0-9]+)[_/](T[0-9]+|ses[0-9]+)[_/]"), path: str = "path") -> DataFrame:
    """``subject, session, sequence, path`` of a listing: the first layout (two groups) that fits; repeated sequences get ``_2``, ``_3``."""
    from ..operators.joins import suffixed

    part = lambda g: F.coalesce(*[F.when(F.col(path).rlike(p), F.regexp_extract(path, p, g)) for p in layouts])
    name = F.lower(F.substring_index(path, "/", -1))
    seq = F.lit("")
    for label in SEQUENCES:
        seq = F.when(name.rlike(rf"(^|[^a-z0-9]){label.lower().rstrip('w')}w?($|[^a-z0-9])"), label).otherwise(seq)
    rows = files.select(part(1).alias("subject"), part(2).alias("session"), seq.alias("sequence"), path).filter("subject is not null and sequence != ''")
    keyed = suffixed(rows.withColumn("__k", F.concat_ws("\u0001", "subject", "session", "sequence")), "__k", path)
    return keyed.select("subject", "session", F.element_at(F.split("unique_key", "\u0001"), -1).alias("sequence"), path)


def scan_tree(spark: SparkSession, root: str) -> DataFrame:
    """All files of a tree: ``path, length, modified``. Contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))
