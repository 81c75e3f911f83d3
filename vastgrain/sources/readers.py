"""Python data sources for formats Spark has no reader for: FASTA/FASTQ, MatrixMarket, GEM, Arrow IPC, NIfTI.

Register them with :func:`register`; then ``spark.read.format("fastx").load(path)``. Each partition reads its own part of
a file and yields Arrow batches. These readers open paths with Python's file API, so the paths must be on a file system
that executors mount; tables in other stores are read with Spark's own formats.
"""

from __future__ import annotations

import glob
import gzip
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SPLIT_BYTES = 32 << 20
BATCH_ROWS = 4096


@dataclass
class Part(InputPartition):
    """A part of a file: bytes [begin, end), or a whole file."""

    path: str
    begin: int = 0
    end: int = -1


def local_files(path: str) -> list[str]:
    """Files of a path, folder or glob, in order."""
    path = path.removeprefix("file://")
    if os.path.isdir(path):
        return sorted(p for p in (os.path.join(path, n) for n in os.listdir(path)) if os.path.isfile(p) and not os.path.basename(p).startswith(("_", ".")))
    return sorted(glob.glob(path)) or [path]


def splits(path: str, split_bytes: int) -> list[Part]:
    """Plain files are cut into ranges; a gzip file is one part."""
    if path.endswith(".gz"):
        return [Part(path)]
    size = os.path.getsize(path)
    return [Part(path, a, min(size, a + split_bytes)) for a in range(0, max(1, size), split_bytes)]


def lines_of(part: Part) -> Iterator[tuple[int, bytes]]:
    """(offset, line without its end) of the lines that begin in a part."""
    if part.path.endswith(".gz"):
        with gzip.open(part.path, "rb") as f:
            at = 0
            for line in f:
                yield at, line.rstrip(b"\r\n")
                at += len(line)
        return
    with open(part.path, "rb") as f:
        at = part.begin
        if at:
            f.seek(at - 1)
            at += len(f.readline()) - 1
        while part.end < 0 or at < part.end:
            line = f.readline()
            if not line:
                return
            yield at, line.rstrip(b"\r\n")
            at += len(line)


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        if len(held) == BATCH_ROWS:
            yield out()
            held = []
    if held:
        yield out()


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.split_bytes = int(options.get("split_bytes", SPLIT_BYTES))

    def partitions(self):
        return [p for f in local_files(self.options["path"]) for p in splits(f, self.split_bytes)]


class FastxSource(DataSource):
    """``id, seq, length[, qual]`` of FASTA or FASTQ, plain (split at records) or gzip. ``qual`` is there where the first record has one."""

    @classmethod
    def name(cls):
        return "fastx"

    def _is_fastq(self) -> bool:
        path = local_files(self.options["path"])[0]
        with gzip.open(path, "rb") if path.endswith(".gz") else open(path, "rb") as f:
            return f.read(1) == b"@"

    def schema(self):
        return "id string, seq string, length int, qual string" if self._is_fastq() else "id string, seq string, length int"

    def reader(self, schema):
        return FastxReader(dict(self.options), "qual" in schema.fieldNames())


class FastxReader(_Reader):
    def __init__(self, options: dict, fastq: bool):
        super().__init__(options)
        self.fastq = fastq
        self.kind = pa.schema([("id", pa.string()), ("seq", pa.string()), ("length", pa.int32()), *([("qual", pa.string())] if fastq else [])])

    def read(self, part: Part):
        yield from _batches(self._fastq(part) if self.fastq else self._fasta(part), self.kind)

    @staticmethod
    def _text(b: bytes) -> str:
        return b.decode("utf-8", "replace")

    def _fastq(self, part: Part):
        """Records whose first line begins in the part. A line that starts with @ begins a record if the line after next starts with +."""
        rest = lines_of(Part(part.path, part.begin, -1))
        window: list[tuple[int, bytes]] = []
        for item in rest:
            window.append(item)
            if len(window) < 4:
                continue
            if not (window[0][1][:1] == b"@" and window[2][1][:1] == b"+" and len(window[1][1]) == len(window[3][1])):
                window.pop(0)
                continue
            if 0 <= part.end <= window[0][0]:
                return
            head, seq, qual = window[0][1][1:], window[1][1], window[3][1]
            yield self._text(head.split()[0] if head.split() else b""), self._text(seq), len(seq), self._text(qual)
            window = []

    def _fasta(self, part: Part):
        name, seq = None, []
        for at, line in lines_of(Part(part.path, part.begin, -1)):
            if line[:1] == b">":
                if name is not None:
                    yield name, self._text(b"".join(seq)), sum(map(len, seq))
                name, seq = None, []
                if 0 <= part.end <= at:
                    return
                name = self._text(line[1:].split()[0] if line[1:].split() else b"")
            elif name is not None:
                seq.append(line.strip())
        if name is not None:
            yield name, self._text(b"".join(seq)), sum(map(len, seq))


class MtxSource(DataSource):
    """``gene int, cell int, value double`` (0-based) of a MatrixMarket coordinate file, split at lines."""

    @classmethod
    def name(cls):
        return "mtx"

    def schema(self):
        return "gene int, cell int, value double"

    def reader(self, schema):
        return MtxReader(dict(self.options))


class MtxReader(_Reader):
    kind = pa.schema([("gene", pa.int32()), ("cell", pa.int32()), ("value", pa.float64())])

    def read(self, part: Part):
        sizes = _mtx_size_line(part.path)

        def rows():
            for at, line in lines_of(part):
                if not line or line[:1] == b"%" or at == sizes[0]:
                    continue
                parts = line.split()
                yield int(parts[0]) - 1, int(parts[1]) - 1, float(parts[2]) if len(parts) > 2 else 1.0

        yield from _batches(rows(), self.kind)


def _mtx_size_line(path: str) -> tuple[int, tuple[int, int, int]]:
    """Offset of the size line, and rows, columns, entries."""
    for at, line in lines_of(Part(path)):
        if line and line[:1] != b"%":
            r, c, n = line.split()[:3]
            return at, (int(r), int(c), int(n))
    raise ValueError(f"{path} has no size line")


def read_mtx_triple(spark: SparkSession, folder: str):
    """(matrix, barcodes, features) of a folder with one matrix.mtx[.gz] and its barcodes and features; names may share a prefix. Sizes must agree."""
    names = os.listdir(folder)

    def one(*stems: str) -> str:
        found = [n for n in names if any(n.removesuffix(".gz").endswith(s) for s in stems)]
        if len(found) != 1:
            raise ValueError(f"{folder}: {len(found)} files end in {' or '.join(stems)}")
        return os.path.join(folder, found[0])

    matrix, barcodes, genes = one("matrix.mtx"), one("barcodes.tsv"), one("features.tsv", "genes.tsv")
    lines = lambda p: [line.decode().split("\t") for _, line in lines_of(Part(p))]
    cells, rows = lines(barcodes), lines(genes)
    _, (n_genes, n_cells, _) = _mtx_size_line(matrix)
    if (len(rows), len(cells)) != (n_genes, n_cells):
        raise ValueError(f"the matrix is {n_genes} x {n_cells}, but there are {len(rows)} features and {len(cells)} barcodes")
    register(spark)
    return (
        spark.read.format("mtx").load(matrix),
        spark.createDataFrame([(i, c[0]) for i, c in enumerate(cells)], "cell int, barcode string"),
        spark.createDataFrame([(i, r[0], r[1] if len(r) > 1 else r[0], r[2] if len(r) > 2 else "Gene Expression") for i, r in enumerate(rows)], "gene int, id string, name string, feature_type string"),
    )


# Names that columns of a GEM table go by.
GEM_NAMES = {"gene": ("geneid", "gene", "genename", "gene_id"), "x": ("x",), "y": ("y",), "count": ("midcount", "midcounts", "umicount", "count", "mid_count"), "exon": ("exoncount", "exon")}


def gem_header(path: str) -> tuple[dict[str, str], dict[str, int], int]:
    """``#K=V`` values, the place of each known column, and the offset of the column row."""
    meta: dict[str, str] = {}
    for at, line in lines_of(Part(path)):
        text = line.decode("utf-8", "replace")
        if text.startswith("#"):
            k, _, v = text[1:].partition("=")
            meta[k.strip()] = v.strip()
            continue
        columns = [c.strip().lower() for c in text.split("\t")]
        places = {name: next((columns.index(a) for a in aliases if a in columns), -1) for name, aliases in GEM_NAMES.items()}
        if min(places[k] for k in ("gene", "x", "y", "count")) < 0:
            raise ValueError(f"{path}: columns {columns}")
        return meta, places, at
    raise ValueError(f"{path} is empty")


#: Raised when the index of a GEM table changes its form.
GEM_INDEX_VERSION = 1


def index_gem(spark: SparkSession, path: str, sidecar: str, grid: int | None = None, reuse: bool = True):
    """The density summary of a GEM table (``gy, gx, density, occupancy``) with its extent, kept beside it as Parquet: (summary, extent, grid).

    A sidecar is used again while it has this version, the file's size and time, and the wanted grid (any, if none is
    named); else it is built anew, with 512 unless told otherwise.
    """
    import json

    from pyspark.sql import functions as F

    from ..operators.grid import density_index

    local = local_files(path)[0]
    stamp = {"version": GEM_INDEX_VERSION, "size": os.path.getsize(local), "time": os.stat(local).st_mtime_ns}
    if reuse:
        try:
            held = json.loads(spark.read.text(f"{sidecar}/meta").first()["value"])
            if {k: held[k] for k in stamp} == stamp and grid in (None, held["grid"]):
                return spark.read.parquet(f"{sidecar}/summary"), tuple(held["extent"]), held["grid"]
        except Exception as e:  # no sidecar, or one that isn't readable: it is built
            if "PATH_NOT_FOUND" not in str(e) and not isinstance(e, (KeyError, ValueError, TypeError)):
                raise
    register(spark)
    points = spark.read.format("gem").load(path)
    bounds = points.agg(F.min("x"), F.max("x") + 1, F.min("y"), F.max("y") + 1).first()
    if bounds[0] is None:
        raise ValueError(f"{path} has no rows")
    size = grid or 512
    density_index(points, tuple(bounds), size).write.mode("overwrite").parquet(f"{sidecar}/summary")
    meta = json.dumps(stamp | {"grid": size, "extent": list(bounds)})
    spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{sidecar}/meta")
    return spark.read.parquet(f"{sidecar}/summary"), tuple(bounds), size


class GemSource(DataSource):
    """``gene, x, y, count, exon`` of a GEM table; the header's offsets are added; rows that don't parse are passed over. Option ``window`` (x0,x1,y0,y1; half-open) filters while parsing."""

    @classmethod
    def name(cls):
        return "gem"

    def schema(self):
        return "gene string, x int, y int, count long, exon long"

    def reader(self, schema):
        return GemReader(dict(self.options))


class GemReader(_Reader):
    kind = pa.schema([("gene", pa.string()), ("x", pa.int32()), ("y", pa.int32()), ("count", pa.int64()), ("exon", pa.int64())])

    def read(self, part: Part):
        meta, places, header = gem_header(part.path)
        dx, dy = int(meta.get("OffsetX", 0)), int(meta.get("OffsetY", 0))
        window = tuple(int(v) for v in self.options["window"].split(",")) if self.options.get("window") else None

        def rows():
            for at, line in lines_of(part):
                if at <= header or line[:1] == b"#":
                    continue
                cells = line.decode("utf-8", "replace").split("\t")
                try:
                    x, y = int(cells[places["x"]]) + dx, int(cells[places["y"]]) + dy
                    count = int(cells[places["count"]])
                    exon = int(cells[places["exon"]]) if places["exon"] >= 0 else None
                    gene = cells[places["gene"]]
                except (ValueError, IndexError):
                    continue
                if window is None or (window[0] <= x < window[1] and window[2] <= y < window[3]):
                    yield gene, x, y, count, exon

        yield from _batches(rows(), self.kind)


class ArrowSource(DataSource):
    """An Arrow IPC or Feather file, one partition a record batch, memory-mapped."""

    @classmethod
    def name(cls):
        return "arrow_ipc"

    def schema(self):
        from pyspark.sql.pandas.types import from_arrow_schema

        with pa.memory_map(local_files(self.options["path"])[0]) as f:
            return from_arrow_schema(pa.ipc.open_file(f).schema)

    def reader(self, schema):
        return ArrowReader(dict(self.options), schema.fieldNames())


class ArrowReader(_Reader):
    def __init__(self, options: dict, columns: list[str]):
        super().__init__(options)
        self.columns = columns

    def partitions(self):
        out = []
        for path in local_files(self.options["path"]):
            with pa.memory_map(path) as f:
                out += [Part(path, i, i + 1) for i in range(pa.ipc.open_file(f).num_record_batches)]
        return out

    def read(self, part: Part):
        with pa.memory_map(part.path) as f:
            batch = pa.ipc.open_file(f).get_batch(part.begin).select(self.columns)
        for i, column in enumerate(batch.columns):
            if pa.types.is_dictionary(column.type):
                batch = batch.set_column(i, batch.schema.field(i).name, column.dictionary_decode())
        yield batch


class NiftiSource(DataSource):
    """``z, y, x, value`` voxels of a NIfTI-1 volume, one partition a slab of ``slab`` planes; gzip is one partition."""

    @classmethod
    def name(cls):
        return "nifti"

    def schema(self):
        return "z int, y int, x int, value double"

    def reader(self, schema):
        return NiftiReader(dict(self.options))


# NIfTI-1 data types.
NIFTI_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}


@dataclass(frozen=True)
class NiftiHeader:
    """Sizes (x, y, z), element type, data offset, scaling."""

    shape: tuple[int, int, int]
    dtype: np.dtype
    offset: int
    slope: float
    intercept: float

    @classmethod
    def of(cls, path: str) -> NiftiHeader:
        with gzip.open(path, "rb") if path.endswith(".gz") else open(path, "rb") as f:
            raw = f.read(352)
        order = "<" if int.from_bytes(raw[:4], "little") == 348 else ">"
        if int.from_bytes(raw[:4], "little" if order == "<" else "big") != 348:
            raise ValueError(f"{path} is not NIfTI-1")
        dim = np.frombuffer(raw, order + "i2", 8, 40)
        code = int(np.frombuffer(raw, order + "i2", 1, 70)[0])
        offset, slope, intercept = (float(v) for v in np.frombuffer(raw, order + "f4", 3, 108))
        shape = tuple(int(dim[i]) if dim[0] >= i else 1 for i in (1, 2, 3))
        return cls(shape, np.dtype(order + NIFTI_TYPES[code]), int(offset), slope or 1.0, intercept if slope else 0.0)


class NiftiReader(_Reader):
    def partitions(self):
        out = []
        for path in local_files(self.options["path"]):
            planes = NiftiHeader.of(path).shape[2]
            step = planes if path.endswith(".gz") else int(self.options.get("slab", 16))
            out += [Part(path, z, min(planes, z + step)) for z in range(0, planes, step)]
        return out

    def read(self, part: Part):
        h = NiftiHeader.of(part.path)
        nx, ny, _ = h.shape
        plane = nx * ny
        with gzip.open(part.path, "rb") if part.path.endswith(".gz") else open(part.path, "rb") as f:
            f.seek(h.offset + part.begin * plane * h.dtype.itemsize)
            for z in range(part.begin, part.end):
                values = np.frombuffer(f.read(plane * h.dtype.itemsize), h.dtype).astype(float) * h.slope + h.intercept
                y, x = np.divmod(np.arange(plane, dtype=np.int32), nx)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(plane, z, np.int32)), pa.array(y.astype(np.int32)), pa.array(x.astype(np.int32)), pa.array(values)], ["z", "y", "x", "value"])


def register(spark: SparkSession) -> None:
    """Make all formats known to a session."""
    for source in (FastxSource, MtxSource, GemSource, ArrowSource, NiftiSource):
        spark.dataSource.register(source)
