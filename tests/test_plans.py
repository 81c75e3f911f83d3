import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from vastgrain.functions import scalars as S
from vastgrain.functions import vocabulary as V
from vastgrain.operators import folds, grid, joins, matrix, similarity, text, windows
from vastgrain.plans import cost, orchestrate
from vastgrain.plans.navigation import WindowedFrame


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "s string").select(f(F.col("s")).alias("r")).first()["r"]


def test_sizes_and_budget():
    assert [cost.parse_size(s) for s in ("8GB", "1.5 GiB", "512", 7)] == [8 << 30, 3 << 29, 512, 7]
    assert [cost.human(n) for n in (5, 1536, 3 << 40)] == ["5 B", "1.5 KB", "3.0 TB"]
    with pytest.raises(ValueError):
        cost.parse_size("-1")
    b = cost.Budget(100)
    b.acquire(60)
    assert not b.try_acquire(50)
    with pytest.raises(MemoryError):
        b.acquire(101)
    with pytest.raises(TimeoutError):
        b.acquire(50, timeout=0.05)
    threading.Timer(0.05, b.release, (60,)).start()
    b.acquire(50, timeout=2)
    assert (b.peak, b.used, b.grants, b.waits, b.denials) == (60, 50, 2, 2, 3)


def test_navigation(spark):
    v = WindowedFrame.over(spark.range(1000).withColumn("v", F.col("id") * 2), "id")
    assert v.extent == ((0, 1000),)
    assert v.select((-50, 20)).window == ((0, 20),) and v.select((2000, 3000)).window == ((999, 1000),)
    z = v.at_level(3).zoom_in(2)
    assert z.window == ((250, 750),) and z.level == 2 and z.load().count() == 125
    assert z.zoom_out(2).window == ((0, 1000),) and z.zoom_out(2).level == 3
    assert v.select((100, 200)).pan(-5).window == ((0, 100),)
    assert sum(len(c) for c in v.at_level(2).chunks()) == v.at_level(2).load().count() == 250
    assert v.auto_zoom(budget=64 * 100).units() <= 80
    assert v.overview("v", 10).count() == 10


def test_windows(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0)], "i int, v double")
    assert [r.i for r in windows.range_search(df, "v", 1, 3, ["i"]).collect()] == [1, 3]
    with pytest.raises(TypeError):
        windows.range_search(df.withColumn("t", F.lit("x")), "t", 0, 1)
    with pytest.raises(KeyError, match="there are i, v"):
        windows.lazy_window(df, "i", 0, 2, columns=["zz"])
    assert windows.polygon_area([(0, 0), (10, 0), (0, 10)]) == 50 and windows.overlap_share((0, 10, 0, 5), (5, 15, 0, 5)) == 0.5


def test_zorder_and_pruning(spark, tmp_path):
    pts = spark.range(4000).select((F.col("id") % 64).cast("int").alias("x"), (F.col("id") * 7 % 61).cast("int").alias("y"), F.lit(1).alias("count"))
    grid.write_z_ordered(pts, str(tmp_path / "z"), 4, files=4, rows_per_file=300)
    import glob

    foot = cost.footers(spark, sorted(glob.glob(str(tmp_path / "z" / "*.parquet"))))
    r = cost.prune_report(foot, "x", 0, 7).first()
    assert r["all_rows"] == 4000 and r["groups"] < r["all_groups"]
    assert spark.read.parquet(str(tmp_path / "z")).filter("x < 8").count() == pts.filter("x < 8").count()
    stats = {r["column"]: r for r in cost.column_stats(foot).collect()}
    assert (stats["x"]["low_number"], stats["x"]["high_number"], stats["x"]["num_values"]) == (0, 63, 4000)


def test_pool_repeats_edges(spark):
    img = spark.createDataFrame([(y, x, 10 * y + x) for y in range(3) for x in range(3)], "y int, x int, value int")
    assert sorted((r.y, r.x, r.value) for r in grid.pool(img).collect()) == [(0, 0, 6), (0, 1, 7), (1, 0, 20), (1, 1, 22)]


def test_pca_against_numpy(spark):
    rng = np.random.default_rng(1)
    dense = rng.poisson(0.7, (80, 12)).astype(float)
    rows = [(int(c), int(g), float(dense[c, g])) for c in range(80) for g in range(12) if dense[c, g]]
    m = spark.createDataFrame(rows, "cell long, gene long, logged double")
    mu, sd = dense.mean(0), dense.std(0, ddof=1)
    z = np.clip((dense - mu) / sd, -10, 10)
    cov = np.cov(z.T)
    values = np.sort(np.linalg.eigvalsh(cov))[::-1]
    components, var, scores = matrix.pca(m, list(range(12)), mu, sd, 80, 3)
    assert np.allclose(var, values[:3])
    got = {r.cell: r.pcs for r in scores.collect()}
    centred = z - z.mean(0)
    assert all(np.allclose(got[c], centred[c] @ components.T) for c in got)


def test_greedy_bounds():
    assert matrix.greedy_bounds([5, 5, 20, 1, 1], 10) == [(0, 2), (2, 3), (3, 5)]


def test_scalars(spark):
    l = one(spark, "chr7:55,019,017-55,211,628", S.parse_locus)
    assert tuple(l) == ("7", 55019016, 55211628)
    assert one(spark, "ATGCRYKMux", S.reverse_complement) == "NAKMRYGCAT"
    assert one(spark, "scan12_9", S.natural_key) < one(spark, "scan12_10", S.natural_key)
    assert one(spark, "hg19", S.genome_build) == "GRCh37"
    assert one(spark, "anything", lambda c: S.keyword_count(F.lit("MS vs mss, ms."), "ms")) == 2
    assert one(spark, "x", lambda c: S.sparkline(F.array(*[F.lit(float(v)) for v in (0, 1, 2, 7)]))) == "▁▂▃█"
    assert one(spark, "CRISPRi and perturb-cite-seq; RNA-seq (bulk)", lambda c: F.array_join(V.ASSAY.labels(c), ",")) == "Perturb-CITE-seq,bulk RNA-seq"
    assert one(spark, "publication of mss", V.access_class) == ""
    more = V.ASSAY.extended("TAP-seq", ["targeted perturb-seq"])
    assert one(spark, "targeted Perturb-seq", lambda c: F.array_join(more.labels(c), ",")) == "TAP-seq"


def test_folds(spark):
    rows = [
        (1, 1.0, "stream", "a", '{"bytes": 5}'), (2, 2.0, "record", "a", '{"target": "t", "facets": {"assay": "x"}}'), (3, 3.0, "stream", "a", '{"bytes": 7}'), (4, 4.0, "annotate", "a", '{"facets": {"tissue": "y"}, "confident": true}'),
        (5, 5.0, "local", "a", '{"path": "/p"}'), (6, 6.0, "local", "a", '{"path": "/p"}'), (7, 7.0, "open", "b", '{"target": "u"}'), (8, 8.0, "annotate", "c", '{"note": "early"}'), (9, 9.0, "open", "a", '{"target": "zz"}'),
    ]
    got = {r.key: r for r in folds.catalogue_fold(spark.createDataFrame(rows, "line long, ts double, event string, key string, payload string")).collect()}
    assert set(got) == {"a", "b"} and got["a"].facets == {"assay": "x", "tissue": "y"} and got["a"].bytes_streamed == 7 and got["a"].local_paths == ["/p"] and got["a"].confident and got["a"].target == "t" and got["a"].last_seen == 9.0
    lines = spark.createDataFrame([('{"op": "load", "dataset": "d"}',), ('{"op": "lo',), ('{"dataset": "d"}',)], "value string")
    assert folds.parse_log(lines, "op string, dataset string", ["op", "dataset"]).count() == 1
    assert folds.lru_victims([("a", 40, 1, False), ("b", 40, 2, True), ("c", 20, 3, False)], 50, 100) == ["a", "c"]
    assert folds.lru_victims([("a", 40, 1, True), ("b", 60, 2, False)], 70, 100) is None


def test_nms_and_tiles(spark):
    assert similarity.suppress([(0, 10, 0, 10, 0.9), (1, 11, 0, 10, 0.8), (20, 30, 0, 10, 0.7)], 5, 0.5) == [0, 2]
    pts = spark.createDataFrame([(x, y, "g1" if x < 50 else "g2", 3) for x in range(0, 100, 5) for y in range(0, 20, 5)], "x int, y int, gene string, count int")
    tiles = similarity.tile_profiles(pts, 20, 10)
    assert tiles.groupBy("tx", "ty").count().filter("tx = 0 and ty = 0").count() == 1
    scores = {(r.tx, r.ty): r.score for r in similarity.tile_similarity(tiles, 0, 0).collect()}
    assert abs(scores[(2, 0)] - 1) < 1e-9 and (8, 0) not in scores
    assert similarity.spread_indices(100, 4) == [0, 25, 50, 75] and similarity.spread_indices(100, 4, 7) == similarity.spread_indices(100, 4, 7)


def test_text_search(spark):
    lines = spark.createDataFrame([(i, t) for i, t in enumerate(["Alpha beta", "gamma", "BETAmax", "xx"] * 40)], "line long, text string")
    index = text.trigram_index(lines, 16)
    assert text.trigram_candidates(index, "be") is None
    assert text.search_lines(lines, "beta", index=index, block_lines=16).count() == 80
    assert text.search_lines(lines, "beta", ignore_case=False).count() == 40
    assert text.longest_literal(r"foo.*barbaz\d+") == "barbaz"
    reads = spark.createDataFrame([("r1", "ACGTTTACG"), ("r2", "CGTAAACGT"), ("r3", "TTTT")], "id string, seq string")
    hits = {(r.id, r.start, r.strand) for r in text.pattern_offsets(reads, ["ACG"]).collect()}
    assert hits == {("r1", 0, "+"), ("r1", 6, "+"), ("r2", 0, "-"), ("r2", 5, "+")}


def test_interval_overlap_is_exact(spark):
    rng = np.random.default_rng(2)
    a = [(i, int(c), int(s), int(s + w)) for i, (c, s, w) in enumerate(zip(rng.integers(0, 2, 60), rng.integers(0, 500, 60), rng.integers(1, 90, 60), strict=True))]
    frame = spark.createDataFrame(a, "id int, chrom int, start int, end int")
    want = {(i, j) for i, c, s, e in a for j, d, t, f in a if c == d and s < f and t < e}
    assert {tuple(r) for r in joins.interval_overlap(frame, frame, 37).collect()} == want


def test_describe_resolve_cover_build(spark, tmp_path):
    rows = [
        ("d1", "Screen", "GSE12345", "human", "scRNA-seq; CROP-seq", "12k cells", "CD3D; EGFR", "open"), ("d2", "Protein atlas", "https://example.org/x.zip", "mouse", "CITE-seq", "~1.7M cells", "", "controlled by a DAC"),
        ("d3", "Paper", None, "rat", "", "44 datasets", "N/A", ""),
    ]
    inv = spark.createDataFrame(rows, "`dataset_id` string, title string, accession string, species string, modalities string, n_cells string, genes_perturbed string, access string")
    p = {r.id: r for r in orchestrate.describe(inv).collect()}
    assert p["d1"].assay == "scRNA-seq" and p["d1"].organism == "Homo sapiens" and p["d1"].n_cells == 12000 and p["d1"].genes_perturbed == ["CD3D", "EGFR"] and [a.id for a in p["d1"].accessions] == ["GSE12345"]
    assert p["d2"].n_cells == 1_700_000 and p["d2"].access == "controlled" and p["d3"].n_cells is None
    files = spark.createDataFrame([("/data/GSE12345_RAW.tar",), ("/data/XGSE12345.tar",)], "path string")
    status = {r.piece: (r.status, r.lead) for r in orchestrate.resolve(orchestrate.describe(inv), files).collect()}
    assert status["d1"] == ("local", "/data/GSE12345_RAW.tar") and status["d2"][0] == "controlled" and status["d3"][0] == "unresolved"
    codes = {(r.gene, r.piece): r.codes for r in joins.coverage_codes(orchestrate.evidence(orchestrate.describe(inv))).collect()}
    assert codes == {("CD3D", "d1"): "X", ("EGFR", "d1"): "X"}

    def source(name, genes, n, bad=False):
        m = spark.createDataFrame([(c, g, float(c + g + 1)) for c in range(n) for g in range(len(genes))], "cell long, gene int, value double")
        if bad:
            m = m.withColumn("value", F.raise_error(F.lit("unreadable")).cast("double"))
        return orchestrate.Source(name, m, spark.createDataFrame(list(enumerate(genes)), "gene int, name string"), spark.createDataFrame([(c, f"b{c}") for c in range(n)], "cell long, barcode string"))

    built = orchestrate.build(spark, [source("p1", ["A", "B", "a"], 3), source("bad", ["A", "B"], 2, bad=True), source("p2", ["B", "C", "A"], 2)], str(tmp_path / "built"))
    assert built.pieces == ["p1", "p2"] and "unreadable" in built.holes["bad"]
    assert [r.id for r in built.read(spark, "var").orderBy("gene").collect()] == ["A", "B"]
    assert sorted((r.cell, r.gene, r.value) for r in built.read(spark, "X/p2").collect()) == [(3, 0, 3.0), (3, 1, 1.0), (4, 0, 4.0), (4, 1, 2.0)]
    assert built.read(spark, "obs").count() == 5
