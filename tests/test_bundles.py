import json

import numpy as np
import pytest

from tests.hdf5_files import save
from vastgrain.sources import bundles, dispatch, readers


def matrix(path, cells=6, genes=3):
    values = np.arange(1, cells * genes + 1, dtype="i4")
    tree = {"data": values, "indices": np.tile(np.arange(genes), cells), "indptr": np.arange(0, cells * genes + 1, genes), "shape": np.array([genes, cells]), "barcodes": np.array([f"b{i}" for i in range(cells)], "S4")}
    tree["features"] = {"id": np.array([f"E{i}" for i in range(genes)], "S4"), "name": np.array([f"g{i}" for i in range(genes)], "S4"), "feature_type": np.array(["Gene Expression"] * genes, "S20")}
    return save(path, {"matrix": tree})


ROWS = [(f"b{i}", i % 2, i, 2 * i, 10.5 * i, 100 - 7 * i) for i in range(6)]


def visium(folder, header=True, kind="csv"):
    (folder / "spatial").mkdir(parents=True)
    matrix(folder / "filtered_feature_bc_matrix.h5")
    (folder / "spatial/scalefactors_json.json").write_text(json.dumps({"tissue_hires_scalef": 0.17}))
    names = "barcode,in_tissue,array_row,array_col,pxl_row_in_fullres,pxl_col_in_fullres\n"
    if kind == "csv":
        (folder / ("spatial/tissue_positions.csv" if header else "spatial/tissue_positions_list.csv")).write_text((names if header else "") + "".join(",".join(map(str, r)) + "\n" for r in ROWS))


def test_visium(spark, tmp_path):
    for header in (True, False):
        folder = tmp_path / str(header)
        visium(folder, header)
        v = bundles.open_visium(spark, str(folder))
        assert sorted(tuple(r) for r in v.positions().collect()) == [(b, t, r, c, float(y), float(x)) for b, t, r, c, y, x in ROWS]
        assert v.scale() == {"tissue_hires_scalef": 0.17} and tuple(v.extent().first()) == (65, 101, 0, 53) and v.image() is None
        assert {r.name for r in v.cells_in((80, 95, 10, 25)).collect()} == {"b1", "b2"}
        entries, cells, genes = v.matrix()
        assert entries.count() == 18 and cells.count() == 6 and genes.count() == 3
    with pytest.raises(FileNotFoundError):
        bundles.open_visium(spark, str(tmp_path))


def test_binned_visium(spark, tmp_path):
    for um in (2, 8, 16):
        visium(tmp_path / f"binned_outputs/square_{um:03d}um", kind="none")
        folder = tmp_path / f"binned_outputs/square_{um:03d}um/spatial"
        spark.createDataFrame(ROWS[: um // 2], "barcode string, in_tissue int, array_row int, array_col int, pxl_row_in_fullres double, pxl_col_in_fullres int").write.parquet(str(folder / "tissue_positions.parquet"))
    v = bundles.open_visium(spark, str(tmp_path))
    assert v.bins == [2, 8, 16] and v.root.endswith("016um") and bundles.open_visium(spark, str(tmp_path), 7).positions().count() == 4


def test_xenium(spark, tmp_path):
    rows = [(f"c{i % 3}".encode(), b"gA" if i % 2 else b"gB", 1.5 * i, 2.0 * i, float(i)) for i in range(40)]
    spark.createDataFrame(rows, "cell_id binary, feature_name binary, x_location double, y_location double, qv double").write.parquet(str(tmp_path / "transcripts.parquet"))
    (tmp_path / "cells.csv").write_text("cell_id,x_centroid\nc0,1.5\nc1,2.5\n")
    matrix(tmp_path / "cell_feature_matrix.h5")
    x = bundles.open_xenium(spark, str(tmp_path))
    few = x.transcripts(20, ["gA"])
    assert {(r.gene, r.x, r.y) for r in few.collect()} == {("gA", 1.5 * i, 2.0 * i) for i in range(21, 40, 2)}
    assert "PushedFilters" in few._jdf.queryExecution().toString() and x.cells().count() == 2 and x.matrix()[0].count() == 18
    with pytest.raises(FileNotFoundError):
        x.boundaries()


def test_index_of_a_gem_table_is_used_again(spark, tmp_path):
    path, side = tmp_path / "a.gem", str(tmp_path / "a.index")
    path.write_text("#OffsetX=0\ngeneID\tx\ty\tMIDCount\n" + "".join(f"g{i % 3}\t{i}\t{i * 7 % 50}\t{1 + i % 4}\n" for i in range(50)))
    summary, extent, grid = readers.index_gem(spark, str(path), side, grid=8)
    assert extent == (0, 50, 0, 50) and grid == 8 and summary.agg({"occupancy": "sum"}).first()[0] == 50
    files = sorted(p.name for p in (tmp_path / "a.index/summary").glob("*.parquet"))
    again = readers.index_gem(spark, str(path), side)
    assert again[1:] == (extent, 8) and sorted(p.name for p in (tmp_path / "a.index/summary").glob("*.parquet")) == files
    assert readers.index_gem(spark, str(path), side, grid=4)[2] == 4
    path.write_text("geneID\tx\ty\tMIDCount\ng\t1\t2\t3\n")
    assert readers.index_gem(spark, str(path), side)[1] == (1, 2, 2, 3)
    path.write_text("geneID\tx\ty\tMIDCount\n")
    with pytest.raises(ValueError):
        readers.index_gem(spark, str(path), side)


def test_containers_are_opened_by_their_ending(spark, tmp_path):
    assert dispatch.load(spark, matrix(tmp_path / "m.h5"), ["gene", "value"]).count() == 18
    with pytest.raises(ValueError):
        dispatch.format_of("x.xlsx")
