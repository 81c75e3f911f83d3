import numpy as np
import pytest

from tests.hdf5_files import Data, save
from vastgrain.sources import containers as C
from vastgrain.sources.hdf5 import Hdf5, Unsupported, lzf_decompress, texts


def sparse(rng, rows, columns):
    dense = rng.integers(0, 9, (rows, columns)) * (rng.random((rows, columns)) < 0.2)
    dense[3] = rng.integers(1, 9, columns)  # a heavy row
    pointers = np.concatenate([[0], np.cumsum((dense != 0).sum(1))])
    return dense, {"data": Data(dense[dense != 0].astype("f4"), (50,), (2, 1)), "indices": Data(np.nonzero(dense)[1].astype("i4"), (64,)), "indptr": pointers.astype("i8")}


def of(df):
    return {(r.cell, r.gene): r.value for r in df.collect()}


def truth(dense):
    return {(int(i), int(j)): float(dense[i, j]) for i, j in zip(*np.nonzero(dense), strict=True)}


@pytest.fixture(scope="module")
def h5ad(tmp_path_factory):
    rng = np.random.default_rng(3)
    dense, x = sparse(rng, 40, 23)
    other = rng.normal(size=(40, 23)) * (rng.random((40, 23)) < 0.5)
    tree = {
        "X": {**x, "@encoding-type": "csr_matrix", "@shape": np.array([40, 23])},
        "layers": {"scaled": Data(other, (7, 5), (1,)), "wrong": {**x, "@encoding-type": "csc_matrix"}},
        "obsm": {"X_pca": np.arange(80.0).reshape(40, 2), "X_sparse": {**x, "@shape": np.array([40, 23])}},
        "obs": {"_index": [f"cell{i}" for i in range(40)], "n": np.arange(40) * 2, "ok": np.arange(40) % 2 == 0, "kind": {"codes": (np.arange(40) % 4 - 1).astype("i1"), "categories": ["a", "b", "ü"]}, "maybe": {"values": np.arange(40), "mask": np.arange(40) % 5 == 0}, "@_index": "_index", "@column-order": ["n", "ok", "kind", "maybe"]},
        "var": {"_index": [f"g{i}" for i in range(23)], "@_index": "_index"},
    }
    return save(tmp_path_factory.mktemp("h5") / "a.h5ad", tree), dense, other


def test_matrix_and_layers(spark, h5ad):
    path, dense, other = h5ad
    C.register(spark)
    df = spark.read.format("h5ad").option("block", 40).load(path)
    assert of(df) == truth(dense.astype("f4")) and df.rdd.getNumPartitions() > 4
    assert of(spark.read.format("h5ad").option("layer", "scaled").option("block", 100).load(path)) == truth(other)
    with Hdf5(path) as f, pytest.raises(Unsupported):
        C.matrix_of(f, "wrong")
    with Hdf5(path) as f, pytest.raises(KeyError, match="layers"):
        C.matrix_of(f, "nothing")


def test_rows_of_an_axis(spark, h5ad):
    path = h5ad[0]
    rows = C.read_frame(spark, path).orderBy("row").collect()
    assert [r.name for r in rows][:2] == ["cell0", "cell1"] and [r.kind for r in rows][:4] == [None, "a", "b", "ü"]
    assert [r.n for r in rows][:3] == [0, 2, 4] and [r.ok for r in rows][:2] == [True, False] and [r.maybe for r in rows][:3] == [None, 1, 2]
    assert C.read_frame(spark, path, columns=["kind"]).columns == ["row", "name", "kind"]
    with pytest.raises(KeyError, match="kind"):
        C.read_frame(spark, path, columns=["none"])


def test_embeddings(spark, h5ad):
    path, dense, _ = h5ad
    C.register(spark)
    assert C.embedding_catalogue(path) == [("X_pca", 40, 2), ("X_sparse", 40, 23)]
    rows = spark.read.format("obsm").option("key", "X_pca").option("block", 20).load(path).orderBy("cell").collect()
    assert [(r.cell, r.barcode, r.embedding) for r in rows] == [(i, f"cell{i}", [2.0 * i, 2.0 * i + 1]) for i in range(40)]
    rows = spark.read.format("obsm").option("key", "X_sparse").load(path).orderBy("cell").collect()
    assert np.array_equal([r.embedding for r in rows], dense)


def test_one_face_over_matrices(spark, h5ad, tmp_path):
    path, dense, _ = h5ad
    entries, cells, genes = C.open_matrix(spark, path)
    assert of(entries) == truth(dense) and cells.count() == 40 and genes.filter("gene = 5").first().name == "g5"
    rng = np.random.default_rng(4)
    dense, x = sparse(rng, 12, 9)
    new = save(tmp_path / "new.h5", {"matrix": {**x, "barcodes": np.array([f"b{i}" for i in range(12)], "S8"), "shape": np.array([9, 12]), "features": {"id": np.array([f"E{i}" for i in range(9)], "S8"), "name": np.array([f"n{i}" for i in range(9)], "S8"), "feature_type": np.array(["Gene Expression"] * 6 + ["Antibody Capture"] * 3, "S20")}}})
    entries, cells, genes = C.open_matrix(spark, new, block="20")
    assert of(entries) == truth(dense) and cells.orderBy("cell").first().name == "b0" and genes.count() == 9
    assert C.read_features(spark, new).filter("feature_type = 'Antibody Capture'").count() == 3
    old = {"genes": np.array([f"E{i}" for i in range(9)], "S8"), "gene_names": np.array([f"n{i}" for i in range(9)], "S8"), "barcodes": np.array([f"b{i}" for i in range(12)], "S8")}
    one = save(tmp_path / "old.h5", {"GRCh38": {**x, **old}})
    assert of(C.open_matrix(spark, one)[0]) == truth(dense) and C.read_features(spark, one).first().name == "n0"
    two = save(tmp_path / "two.h5", {"GRCh38": {**x, **old}, "mm10": {**x, **old}})
    with Hdf5(two) as f, pytest.raises(ValueError, match="mm10"):
        C.tenx_group(f)
    assert of(C.open_matrix(spark, two, group="mm10")[0]) == truth(dense)


def test_bins(spark, tmp_path):
    rng = np.random.default_rng(5)
    kind = np.dtype([("x", "<i4"), ("y", "<i4"), ("count", "<u1")])
    counts = [5, 1, 0, 300, 20]
    levels, rows = {}, {}
    for size in (1, 50):
        table = np.zeros(sum(counts), kind)
        table["x"], table["y"], table["count"] = rng.integers(0, 100, len(table)) * size, rng.integers(10, 90, len(table)) * size, rng.integers(1, 9, len(table))
        genes = np.zeros(5, np.dtype([("gene", "S16"), ("offset", "<u4"), ("count", "<u4")]))
        genes["gene"], genes["offset"], genes["count"] = [f"G{i}" for i in range(5)], np.cumsum([0, *counts[:-1]]), counts
        extent = {f"{m}{a.upper()}": np.array([getattr(table[a], m)()], "<i4") for a in "xy" for m in ("min", "max")}
        levels[f"bin{size}"] = {"expression": Data(table, (64,), (1,), extent), "gene": genes}
        rows[size] = sorted((f"G{g}", int(r["x"]), int(r["y"]), int(r["count"])) for g, r in zip(np.repeat(range(5), counts), table, strict=True))
    path = save(tmp_path / "s.gef", {"geneExp": levels})
    C.register(spark)
    assert C.gef_levels(path) == [1, 50]
    for size in (1, 50):
        df = spark.read.format("gef").option("bin", size).option("block", 25).load(path)
        assert sorted(map(tuple, df.collect())) == rows[size] and df.rdd.getNumPartitions() == 3
    few = spark.read.format("gef").option("genes", '["G1", "G4"]').load(path)
    assert sorted(map(tuple, few.collect())) == [r for r in rows[1] if r[0] in ("G1", "G4")]
    x0, x1, y0, y1 = C.gef_extent(path)
    assert (x0, x1) == (min(r[1] for r in rows[1]), max(r[1] for r in rows[1]) + 1) and y0 == min(r[2] for r in rows[1]) < y1


def test_parts_of_the_format(tmp_path):
    values = np.arange(24.0).reshape(6, 4)
    path = save(tmp_path / "x.h5", {"a": {"b": {"c": values, "@note": "deep"}}, "s": ["", "é", "long " * 50], "k": Data(np.arange(100), (9,), (2, 1), {"unit": np.array([1.5, 2.5])}), "none": np.zeros(0)})
    with Hdf5(path) as f:
        assert np.array_equal(f["a/b/c"].read(2, 5), values[2:5]) and f["a/b"].attrs["note"] == "deep" and f["none"].read().size == 0
        assert f["s"].read().tolist() == ["", "é", "long " * 50] and f["k"].read(17, 40).tolist() == list(range(17, 40)) and f["k"].attrs["unit"].tolist() == [1.5, 2.5]
        assert "a/x" not in f and "a/b" in f
    (tmp_path / "no.h5").write_bytes(b"nothing")
    with pytest.raises(ValueError):
        Hdf5(str(tmp_path / "no.h5"))
    assert lzf_decompress(b"\x02abc\x20\x02\x00d", 7) == b"abcabcd"
    assert texts(np.array([b"a\0", None, float("nan"), "x", "-"], object), missing=["-"]) == ["a", None, None, "x", None]
