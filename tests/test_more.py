import numpy as np
import pytest
from pyspark.sql import functions as F

from vastgrain.operators import imaging, library, prep


def test_camera_and_levels():
    c = imaging.Camera.fit((0, 100, 0, 50), 200, 200)
    assert c.scale == 2 and c.to_world(*c.to_pixel(12.5, 7)) == (12.5, 7)
    z = c.zoom(2, at=(30, 40))
    assert np.allclose(z.to_world(30, 40), c.to_world(30, 40))
    assert imaging.choose_level([100, 40, 10], 50, None) == 1 and imaging.choose_level([100, 40, 10], 50, 2) == 2 and imaging.choose_level([100, 30, 10], 50, 2) == 1 and imaging.choose_level([100, 60, 10], 50, 1) == 2
    steps = imaging.replay_session([("fit", ()), ("pan", (5, 0)), ("zoom", (2,)), ("pan", (900, 0))], (0, 100, 0, 100), 100, 100)
    assert [s[1] for s in steps] == [True, False, False, True]
    assert imaging.axis_codes(np.eye(3)) == "LPS" and imaging.axis_codes(-np.eye(3)[:, [1, 0, 2]]) == "ARI"
    assert imaging.tiles_touched((10, 65, 0, 64), 64) == 2
    with pytest.raises(ValueError):
        imaging.tile_windows(None, 10, 10, 8)


def test_prep_end_to_end(spark, tmp_path):
    rng = np.random.default_rng(2)
    dense = rng.poisson(1.0, (60, 30))
    rows = [(int(c), int(g), float(v)) for c, r in enumerate(dense) for g, v in enumerate(r) if v]
    m = spark.createDataFrame(rows, "cell long, gene long, value double")
    genes = spark.createDataFrame([(g, f"MT-{g}" if g < 3 else f"G{g}") for g in range(30)], "gene long, name string")
    s = prep.prep(m, genes, str(tmp_path / "p"), min_counts=20, n_top=10, n_comps=4)
    assert s["genes"] == 10 and s["kept"] == int((dense.sum(1) >= 20).sum()) and len(s["variances"]) == 4
    obs = {r.cell: r for r in spark.read.parquet(str(tmp_path / "p" / "obs")).collect()}
    assert all(abs(obs[c].pct_mito - 100 * dense[c, :3].sum() / dense[c].sum()) < 1e-9 for c in obs)
    assert spark.read.parquet(str(tmp_path / "p" / "pca")).filter(F.size("pcs") == 4).count() == s["kept"]
    prep.write_by_cell(m.unionByName(m), str(tmp_path / "csc"), 2)
    assert spark.read.parquet(str(tmp_path / "csc")).agg(F.sum("value")).first()[0] == 2 * dense.sum()


def test_tables(spark):
    genes = spark.createDataFrame([(0, "CD3D", ["ENSG00000167286"], ["T3D"])], "rec int, symbol string, ids array<string>, aliases array<string>")
    long = spark.createDataFrame([("t3d", 1), ("zz", 2)], "g string, v int")
    assert {r.g: r.gene_symbol for r in prep.harmonise_long(long, "g", genes).collect()} == {"t3d": "CD3D", "zz": "zz"}
    wide = spark.createDataFrame([(1, 2, 3)], "T3D int, CD3D int, other int")
    assert prep.harmonise_wide(wide, {"T3D": "CD3D", "CD3D": "CD3D"}).columns == ["CD3D", "CD3D__2", "other"]
    assert prep.is_wide(["A"] * 20, str.isupper) and not prep.is_wide(["A", "b"], str.isupper)


def test_audit_checksums_sniff(spark, tmp_path):
    lines = spark.createDataFrame([(1, '{"key": "a", "n": 3}'), (2, '{"key": 5, "n": "x"}')], "line int, value string")
    assert sorted(tuple(r) for r in library.audit(lines, {"key": "string", "n": "double"}).collect()) == [(2, "key", "bigint"), (2, "n", "string")]
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.bin").write_bytes(b"hello")
    (tmp_path / "f" / "b.fq").write_bytes(b"@r1\nACGT\n+\nIIII\n")
    files = spark.read.format("binaryFile").load(str(tmp_path / "f"))
    sums = {r.path: r.sha256 for r in library.checksums(files).collect()}
    manifest = spark.createDataFrame([(p, s if p.endswith("a.bin") else "0") for p, s in sums.items()] + [("gone", "0")], "path string, sha256 string")
    assert sorted(r.ok for r in library.verify_checksums(manifest, files).collect()) == [False, False, True]
    assert {r.path[-4:]: r.format for r in library.sniff(files).collect()} == {".bin": "unknown", "b.fq": "fastq"}
    p = spark.createDataFrame([("t", "a", 0.8), ("t", "b", 0.2), ("u", "a", 0.5), ("u", "b", 0.5)], "target string, label string, p double")
    assert {r.target: (r.label, r.confident) for r in library.confident(p).collect()} == {"t": ("a", True), "u": ("a", False)}
