"""Python data sources over HDF5 containers: annotated matrices (h5ad), Cell Ranger matrices, and binned expression (GEF).

Each partition opens the file itself and reads one block of rows: whole cells for matrices, whole genes for bins.
Blocks are cut from the row pointers, so a block holds about as many entries as the next one, however skewed the rows are.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.matrix import greedy_bounds
from .hdf5 import Dataset, Group, Hdf5, Unsupported, texts
from .readers import local_files

#: Entries of a block.
BLOCK_ENTRIES = 1 << 20


@dataclass
class Rows(InputPartition):
    path: str
    begin: int
    end: int


def _file(options: dict) -> str:
    return local_files(options["path"])[0]


def blocks(path: str, pointers: np.ndarray | None, rows: int, width: int, options: dict) -> list[Rows]:
    """Blocks of whole rows of at most ``block`` entries each; dense rows have ``width``."""
    most = int(options.get("block", BLOCK_ENTRIES))
    if pointers is None:
        step = max(1, most // max(1, width))
        bounds = [(a, min(rows, a + step)) for a in range(0, rows, step)]
    else:
        bounds = greedy_bounds(np.diff(pointers).tolist(), most)
    return [Rows(path, a, b) for a, b in bounds] or [Rows(path, 0, 0)]


def triples(cells: np.ndarray, genes: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int64)), pa.array(genes.astype(np.int64)), pa.array(values.astype(np.float64))], ["cell", "gene", "value"])


def matrix_of(file: Hdf5, layer: str) -> Group | Dataset:
    """X, ``raw`` or a layer by its name; CSC is refused, as its rows can't be cut without reading it whole."""
    path = {"X": "X", "raw": "raw/X"}.get(layer, f"layers/{layer}")
    node = file[path]
    if isinstance(node, Group):
        kind = node.attrs.get("encoding-type", node.attrs.get("h5sparse_format", "csr_matrix"))
        if str(kind).startswith("csc"):
            raise Unsupported(f"{path} is stored by columns; write it by rows first")
    return node


class _Blocks(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options


class H5adSource(DataSource):
    """``cell, gene, value`` of an annotated matrix. Options: ``layer`` (X, raw, or a layer's name), ``block`` entries a partition.
    Entries that are stored come out of a sparse matrix, all but zeros out of a dense one."""

    @classmethod
    def name(cls):
        return "h5ad"

    def schema(self):
        return "cell long, gene long, value double"

    def reader(self, schema):
        return H5adReader(dict(self.options))


class H5adReader(_Blocks):
    def partitions(self):
        path = _file(self.options)
        with Hdf5(path) as f:
            node = matrix_of(f, self.options.get("layer", "X"))
            if isinstance(node, Dataset):
                return blocks(path, None, node.shape[0], node.shape[1], self.options)
            pointers = node["indptr"].read()
            return blocks(path, pointers, len(pointers) - 1, 0, self.options)

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        with Hdf5(part.path) as f:
            node = matrix_of(f, self.options.get("layer", "X"))
            if isinstance(node, Dataset):
                dense = node.read(part.begin, part.end)
                cells, genes = np.nonzero(dense)
                yield triples(cells + part.begin, genes, dense[cells, genes])
                return
            yield _compressed(node, part, "indptr", "indices", "data")


def _compressed(node: Group, part: Rows, pointers: str, indices: str, data: str) -> pa.RecordBatch:
    """The entries of the rows of a block out of a compressed matrix."""
    ends = node[pointers].read(part.begin, part.end + 1).astype(np.int64)
    if len(ends) < 2:
        return triples(np.zeros(0), np.zeros(0), np.zeros(0))
    cells = np.repeat(np.arange(part.begin, part.end), np.diff(ends))
    return triples(cells, node[indices].read(ends[0], ends[-1]), node[data].read(ends[0], ends[-1]))


class TenxSource(DataSource):
    """``cell, gene, value`` of a Cell Ranger matrix, stored by cell, of either layout. Options: ``group`` (a genome, in the old one), ``block``."""

    @classmethod
    def name(cls):
        return "tenx_h5"

    def schema(self):
        return "cell long, gene long, value double"

    def reader(self, schema):
        return TenxReader(dict(self.options))


def tenx_group(file: Hdf5, group: str | None = None) -> Group:
    """``matrix``, the named group, or the only one that has a matrix's parts; several are refused."""
    if group or "matrix" in file:
        return file[group or "matrix"]
    found = [name for name in file.links if isinstance(file[name], Group) and {"indptr", "indices", "data"} <= set(file[name].links)]
    if len(found) != 1:
        raise ValueError(f"name one of the groups {sorted(found or file.links)}")
    return file[found[0]]


class TenxReader(_Blocks):
    def partitions(self):
        path = _file(self.options)
        with Hdf5(path) as f:
            pointers = tenx_group(f, self.options.get("group"))["indptr"].read()
            return blocks(path, pointers, len(pointers) - 1, 0, self.options)

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        with Hdf5(part.path) as f:
            yield _compressed(tenx_group(f, self.options.get("group")), part, "indptr", "indices", "data")


class GefSource(DataSource):
    """``gene, x, y, count`` of one level of a binned expression file. Options: ``bin`` (default 1), ``genes`` (a JSON list), ``block``, ``group``."""

    @classmethod
    def name(cls):
        return "gef"

    def schema(self):
        return "gene string, x int, y int, count long"

    def reader(self, schema):
        return GefReader(dict(self.options))


def gef_levels(path: str, group: str = "geneExp") -> list[int]:
    """The bin sizes a file has."""
    with Hdf5(path) as f:
        return sorted(int(name[3:]) for name in f[group].links if name.startswith("bin") and name[3:].isdigit())


def gef_genes(level: Group) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(names, first rows, numbers of rows) of a level; expression is stored gene after gene."""
    table = level["gene"].read()
    name = next(n for n in ("geneName", "gene", "geneID") if n in table.dtype.names)
    return texts(table[name]), table["offset"].astype(np.int64), table["count"].astype(np.int64)


def gef_extent(path: str, bin_size: int = 1, group: str = "geneExp") -> tuple[int, int, int, int]:
    """Half-open (x0, x1, y0, y1) of a level, from its attributes."""
    with Hdf5(path) as f:
        a = f[f"{group}/bin{bin_size}/expression"].attrs
        value = lambda name: int(np.ravel(a[name])[0])
        return value("minX"), value("maxX") + 1, value("minY"), value("maxY") + 1


class GefReader(_Blocks):
    def _level(self, file: Hdf5) -> Group:
        return file[f"{self.options.get('group', 'geneExp')}/bin{int(self.options.get('bin', 1))}"]

    def partitions(self):
        path = _file(self.options)
        with Hdf5(path) as f:
            counts = gef_genes(self._level(f))[2]
            return blocks(path, np.concatenate([[0], np.cumsum(counts)]), len(counts), 0, self.options)

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        wanted = set(json.loads(self.options["genes"])) if "genes" in self.options else None
        with Hdf5(part.path) as f:
            level = self._level(f)
            names, first, count = gef_genes(level)
            chosen = [k for k in range(part.begin, part.end) if wanted is None or names[k] in wanted]
            runs: list[list[int]] = []  # genes side by side are one read
            for k in chosen:
                if runs and runs[-1][-1] == k - 1 and first[k] == first[k - 1] + count[k - 1]:
                    runs[-1].append(k)
                else:
                    runs.append([k])
            for run in runs:
                rows = level["expression"].read(int(first[run[0]]), int(first[run[-1]] + count[run[-1]]))
                genes = np.repeat(np.array([names[k] for k in run], object), count[run])
                yield pa.RecordBatch.from_arrays([pa.array(genes, pa.string()), pa.array(rows["x"].astype(np.int32)), pa.array(rows["y"].astype(np.int32)), pa.array(rows["count"].astype(np.int64))], ["gene", "x", "y", "count"])


def index_key(group: Group) -> str:
    """The name of the column that holds row names."""
    told = group.attrs.get("_index")
    return told if told else next((n for n in ("_index", "index", "cell_id", "barcode") if n in group.links), "")


def read_column(group: Group, name: str, lo: int = 0, hi: int | None = None) -> pa.Array:
    """A column of ``obs`` or ``var``: plain, categorical (codes and categories; -1 is null), or nullable (values and mask)."""
    links = group.links
    if name not in links:
        raise KeyError(f"no column {name!r}; there are {sorted(n for n in links if not n.startswith('__'))}")
    node = group[name]
    if isinstance(node, Group):
        if "codes" in node.links:
            codes, labels = node["codes"].read(lo, hi).astype(np.int64), texts(node["categories"].read())
            return pa.array([labels[c] if 0 <= c < len(labels) else None for c in codes.tolist()], pa.string())
        values, mask = node["values"].read(lo, hi), node["mask"].read(lo, hi).astype(bool)
        return pa.array(values, mask=mask)
    values = node.read(lo, hi)
    old = group["__categories"] if "__categories" in links else None
    if old is not None and name in old.links:
        labels = texts(old[name].read())
        return pa.array([labels[c] if 0 <= c < len(labels) else None for c in values.astype(np.int64).tolist()], pa.string())
    if node.kind.labels and set(node.kind.labels.values()) == {"FALSE", "TRUE"}:
        return pa.array([node.kind.labels[v] == "TRUE" for v in values.tolist()])
    if node.kind.labels:
        return pa.array([node.kind.labels.get(v) for v in values.tolist()], pa.string())
    return pa.array(texts(values), pa.string()) if values.dtype.kind in "SO" else pa.array(values)


def read_frame(spark: SparkSession, path: str, group: str = "obs", columns: list[str] | None = None) -> DataFrame:
    """Row names and columns of ``obs`` or ``var`` (``row long, name string`` and the columns): an axis of the matrix, which is
    small next to it. A missing column is a KeyError that names those there are."""
    with Hdf5(local_files(path)[0]) as f:
        g = f[group]
        key = index_key(g)
        order = g.attrs.get("column-order")
        names = columns if columns is not None else [str(c) for c in (order.tolist() if order is not None else sorted(set(g.links) - {key})) if not str(c).startswith("__")]
        held = {"name": read_column(g, key)} | {n: read_column(g, n) for n in names}
    n = len(held["name"])
    return spark.createDataFrame(pa.table({"row": pa.array(np.arange(n, dtype=np.int64)), **held}))


def read_features(spark: SparkSession, path: str, group: str | None = None) -> DataFrame:
    """``gene long, id, name, feature_type`` of a Cell Ranger matrix; the old layout has genes only."""
    with Hdf5(local_files(path)[0]) as f:
        g = tenx_group(f, group)
        if "features" in g.links:
            ids, names, kinds = (texts(g[f"features/{n}"].read()) for n in ("id", "name", "feature_type"))
        else:
            ids, names = (texts(g[n].read()) for n in ("genes", "gene_names"))
            kinds = ["Gene Expression"] * len(ids)
    return spark.createDataFrame(pa.table({"gene": pa.array(np.arange(len(ids), dtype=np.int64)), "id": ids, "name": names, "feature_type": kinds}))


def read_barcodes(spark: SparkSession, path: str, group: str | None = None) -> DataFrame:
    with Hdf5(local_files(path)[0]) as f:
        names = texts(tenx_group(f, group)["barcodes"].read())
    return spark.createDataFrame(pa.table({"cell": pa.array(np.arange(len(names), dtype=np.int64)), "barcode": pa.array(names, pa.string())}))


class ObsmSource(DataSource):
    """``cell, barcode, embedding`` of ``obsm/<key>``, dense or compressed by rows. Options: ``key``, ``block``."""

    @classmethod
    def name(cls):
        return "obsm"

    def schema(self):
        return "cell long, barcode string, embedding array<double>"

    def reader(self, schema):
        return ObsmReader(dict(self.options))


class ObsmReader(_Blocks):
    def partitions(self):
        path = _file(self.options)
        with Hdf5(path) as f:
            node = f[f"obsm/{self.options['key']}"]
            rows, width = node.shape if isinstance(node, Dataset) else tuple(np.ravel(node.attrs["shape"]).tolist())
            return blocks(path, None, rows, width, self.options)

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        with Hdf5(part.path) as f:
            node, obs = f[f"obsm/{self.options['key']}"], f["obs"]
            if isinstance(node, Dataset):
                dense = node.read(part.begin, part.end).astype(np.float64)
            else:
                entries = _compressed(node, part, "indptr", "indices", "data")
                dense = np.zeros((part.end - part.begin, int(np.ravel(node.attrs["shape"])[1])))
                dense[entries.column(0).to_numpy() - part.begin, entries.column(1).to_numpy()] = entries.column(2).to_numpy()
            names = read_column(obs, index_key(obs), part.begin, part.end)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(part.begin, part.end)), names, pa.array(dense.tolist(), pa.list_(pa.float64()))], ["cell", "barcode", "embedding"])


def embedding_catalogue(path: str) -> list[tuple[str, int, int]]:
    """(key, rows, width) of all embeddings."""
    with Hdf5(local_files(path)[0]) as f:
        if "obsm" not in f:
            return []
        shapes = {k: f[f"obsm/{k}"] for k in f["obsm"].links}
        return [(k, *(n.shape if isinstance(n, Dataset) else np.ravel(n.attrs["shape"]).tolist())) for k, n in sorted(shapes.items())]


def register(spark: SparkSession) -> None:
    for source in (H5adSource, TenxSource, GefSource, ObsmSource):
        spark.dataSource.register(source)


def open_matrix(spark: SparkSession, path: str, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One face over h5ad, Cell Ranger and MatrixMarket files: (entries ``cell, gene, value``, cells ``cell, name``, genes ``gene, name``)."""
    register(spark)
    low = path.lower()
    if low.endswith(".h5ad"):
        axis = lambda group, n: read_frame(spark, path, group, []).withColumnRenamed("row", n)
        return spark.read.format("h5ad").options(**options).load(path), axis("obs", "cell"), axis("var" if options.get("layer") != "raw" else "raw/var", "gene")
    if low.endswith(".h5"):
        group = options.get("group")
        return spark.read.format("tenx_h5").options(**options).load(path), read_barcodes(spark, path, group).withColumnRenamed("barcode", "name"), read_features(spark, path, group).select("gene", "name")
    from .readers import read_mtx_triple

    entries, barcodes, features = read_mtx_triple(spark, path)
    return entries.select(F.col("cell").cast("long").alias("cell"), F.col("gene").cast("long").alias("gene"), "value"), barcodes.select("cell", F.col("barcode").alias("name")), features.select("gene", "name")
