"""Operators beyond the registered queries: panels, overviews, recorders, links, promotion, state, packed tables, display scales."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vastgrain import api
from vastgrain.functions import codec
from vastgrain.functions import scalars as S
from vastgrain.operators import grid as G
from vastgrain.operators import joins as J
from vastgrain.operators import text as X
from vastgrain.plans import cost, logbook, orchestrate, staging
from vastgrain.sources.sinks import Harvest

GENES = [(0, "CD3D", ["ENSG00000167286"], ["T3D"]), (1, "CD3E", ["ENSG00000198851"], []), (2, "EGFR", ["ENSG00000146648", "P00533"], ["ERBB"])]


def test_panel_table(spark):
    genes = spark.createDataFrame(GENES, "rec int, symbol string, ids array<string>, aliases array<string>")
    panel = spark.createDataFrame([("EGFR", 0), ("cd3", 1), ("nope", 2), ("T3D", 3), ("12", 4)], "query string, pos int")
    members = spark.createDataFrame([("CD3", "CD3D", 0), ("CD3", "CD3E", 1)], "name string, member string, at int")
    rows = [(r.query, r.id, r.symbol, r.known, len(r.ids)) for r in J.panel_table(panel, genes, members).collect()]
    assert rows == [("EGFR", "EGFR", "EGFR", True, 2), ("cd3", "CD3D", "CD3D", True, 1), ("cd3", "CD3E", "CD3E", True, 1), ("nope", "nope", "nope", False, 0), ("T3D", "CD3D", "CD3D", True, 1), ("12", "12", "", False, 0)]
    assert [r.known for r in J.panel_table(panel, genes).collect()] == [True, False, False, True, False]


def test_range_lookup(spark):
    rng = np.random.default_rng(1)
    edges = np.unique(rng.integers(0, 10_000, 300))
    ranges = [(int(a), int(b), i) for i, (a, b) in enumerate(zip(edges[:-1:2], edges[1::2], strict=False))]
    ranges.append((20_000, 90_000, 999))  # one long range
    rows = [(int(v),) for v in rng.integers(-50, 100_000, 2000)]
    got = J.range_lookup(spark.createDataFrame(rows, "v long"), spark.createDataFrame(ranges, "first long, end long, name int"), "v")
    want = sorted((v, next((n for a, b, n in ranges if a <= v < b), None)) for (v,) in rows)
    assert sorted(((r.v, r.name) for r in got.collect()), key=str) == sorted(want, key=str)
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()
    none = spark.createDataFrame([], "first long, end long, name int")
    assert J.range_lookup(spark.createDataFrame([(1,)], "v long"), none, "v").collect()[0].name is None


def test_upsert(spark):
    old, new = spark.createDataFrame([(1, "a", 1), (2, "b", None), (3, "c", 3)], "k int, x string, y int"), spark.createDataFrame([(2, "b", None), (3, "d", 3), (4, "e", 4)], "k int, x string, y int")
    assert sorted(tuple(r) for r in J.upsert(old, new, "k").collect()) == [(1, "a", 1, "kept"), (2, "b", None, "same"), (3, "d", 3, "updated"), (4, "e", 4, "new")]


def test_thumbnail_and_display(spark):
    points = spark.createDataFrame([("g", x, y, 1 + (x + y) % 3) for x in range(64) for y in range(64)], "gene string, x int, y int, count int")
    levels = G.bin_pyramid(points, [1, 4, 16])
    small = G.thumbnail(levels, [1, 4, 16], (0, 64, 0, 64), 4)
    assert small.count() == 16 and small.agg(F.sum("total")).first()[0] == points.agg(F.sum("count")).first()[0]
    assert G.thumbnail(levels, [1, 4, 16], (0, 64, 0, 64), 10).count() == 100
    image = spark.createDataFrame([(0, 0), (1, 1), (2, 10), (3, 100), (4, 100_000)], "i int, total int")
    shown = [r.level for r in G.log_scaled(image, low=0.0, high=1.0).orderBy("i").collect()]
    assert shown[:2] == [0.0, 0.0] and shown[-1] == 1.0 and shown == sorted(shown)
    assert G.nice_ticks(0, 10) == [0, 2, 4, 6, 8, 10] and G.nice_ticks(3, 3) == [3] and len(G.nice_ticks(-0.13, 0.99)) in (5, 6)


def test_overviews(spark, tmp_path):
    spark.range(1000).select("id", (F.col("id") * 0.5).alias("v"), F.lit("x").alias("s")).coalesce(1).write.option("parquet.block.size", 2000).parquet(str(tmp_path / "t"))
    files = api.open(spark, str(tmp_path / "t")).files()
    rows = cost.row_group_overview(cost.footers(spark, files), 0, 1000).collect()
    assert sum(r.rows for r in rows) == 1000 and all(r.bytes_per_row > 0 and set(r.spans) == {"id", "v"} for r in rows)
    assert cost.row_group_overview(cost.footers(spark, files), 5000, 6000).count() == 0
    matrix = spark.createDataFrame([(c, g) for c in range(0, 20, 2) for g in range(c + 1)], "cell int, gene int")
    got = [(r.bucket, r.cells, r.mean, r.most) for r in cost.entries_overview(matrix, 3, 20, 4).orderBy("bucket").collect()]
    per = {c: c + 1 for c in range(0, 20, 2)}
    assert got == [(b, len(cs), sum(per.get(c, 0) for c in cs) / len(cs), max(per.get(c, 0) for c in cs)) for b, cs in enumerate([range(3, 8), range(8, 13), range(13, 18), range(18, 20)])]
    c = cost.index_cost(1000, 100_000, 100, 300)
    assert (c.units, c.total) == (200, 200 * 116) and cost.index_cost(10, 100, 50).units == 0


def test_text_decode_and_narrowing(spark):
    df = spark.createDataFrame([(b"abc\0\0",), ("é".encode(),), (None,), (b"NA",)], "b binary")
    assert [r[0] for r in df.select(S.decode_text(F.col("b"), ("NA",))).collect()] == ["abc", "é", None, None]
    table = pa.table({"a": pa.array(["x", None], pa.large_string()), "b": pa.array([[b"1"], []], pa.large_list(pa.large_binary())), "c": pa.array(["u", "v"]).dictionary_encode().cast(pa.dictionary(pa.int32(), pa.large_string())), "d": [1, 2]})
    out = api.narrow(table)
    assert out.schema.types == [pa.string(), pa.list_(pa.binary()), pa.dictionary(pa.int32(), pa.string()), pa.int64()] and out.to_pylist() == table.to_pylist()
    assert api.resident_bytes({"a": np.zeros(10), "b": ["xy", b"z"]}) == 83 and api.resident_bytes(table) > 0 and api.resident_bytes(df) > 0 and api.resident_bytes(None) == 0


def test_batches_are_charged(spark, tmp_path):
    spark.range(1000).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("t"), "id")).alias("s"), F.array("id").alias("l")).repartition(3).write.parquet(str(tmp_path / "t"))
    d = api.open(spark, str(tmp_path / "t"), budget="1MB")
    rows = [r for b in d.batches(rows=100) for r in b.to_pylist()]
    assert sorted(r["id"] for r in rows) == list(range(1000)) and all(r["l"] == [r["id"]] and r["s"] == (f"t{r['id']}" if r["id"] % 3 else None) for r in rows)
    assert d.budget.used == 0 and 0 < d.budget.peak < 20_000 and d.budget.grants >= 10


def test_ambient_recorder(spark, tmp_path):
    j = logbook.Journal(spark, str(tmp_path / "j"))
    assert not logbook.note("load", "d")
    with logbook.recording(j, session="s1", note="outer"):
        assert logbook.note("load", "d", [0, 5], bytes=3)
        with logbook.recording(j, note="inner"):
            logbook.note("open", "e")
            with logbook.quiet():
                assert not logbook.note("open", "f")
    rows = {(r.op, r.dataset, r.session, r.note) for r in j.entries().collect()}
    assert rows == {("load", "d", "s1", "outer"), ("open", "e", "s1", "inner")}
    (tmp_path / "file").write_text("")
    with logbook.recording(logbook.Journal(spark, str(tmp_path / "file"))):
        assert not logbook.note("load", "d")


def test_workflow_and_links(spark, tmp_path):
    b = logbook.SelectionBook(spark, str(tmp_path / "b"))
    one, two, three = (b.add("rect", n, {}) for n in "xyz")
    b.review(one, by="me")
    b.confirm(one, note="sure")
    b.refute(two)
    b.link(one, two, "contains")
    b.link(two, three)
    b.link(one, two, "contains")
    b.delete(three)
    rows = {r.id: r for r in b.all().collect()}
    assert (rows[one].status, rows[one].note, rows[one].by) == ("confirmed", "sure", "me") and rows[two].status == "refuted"
    assert {tuple(r) for r in b.links().collect()} == {(one, two, "contains"), (two, one, "~contains")}
    assert [r.event for r in b.history(one).collect()] == ["add", "update", "update", "link", "link"]
    b.resolve(two)
    b.annotate(two, dataset="d")
    assert {r.id: r for r in b.all().collect()}[two].status == "resolved"


def test_promoted_extract(spark, tmp_path):
    s = staging.Staging(spark, str(tmp_path / "s"), "1MB")
    s.put("a b", lambda: spark.range(7), "src")
    h = Harvest(spark, str(tmp_path / "h"))
    assert h.names() == set() and h.add_staged(s, "a b", targets=["T"]) == "a-b"
    assert h.read("a-b").count() == 7 and h.for_target("T").first().source == "src" and h.names() == {"a-b"}
    with pytest.raises(ValueError):
        h.add_staged(s, "a b")
    h.add_staged(s, "a b", overwrite=True)
    with pytest.raises(KeyError):
        h.add_staged(s, "none")


def test_state_round_trip(spark, tmp_path):
    rows = [("d1", 'a "quoted", thing\nsecond line', "human", "scRNA-seq", "CD3D; EGFR", "12k cells", "GSE12345"), ("d2", "", "mouse", "WES", "", "", "")]
    raw = spark.createDataFrame(rows, "id string, title string, species string, modalities string, targets string, n_cells string, accession string")
    pieces = orchestrate.describe(raw)
    state = orchestrate.State(pieces, orchestrate.resolve(pieces), columns=orchestrate.map_columns(raw.columns))
    state.save(str(tmp_path / "s"))
    back = orchestrate.State.load(spark, str(tmp_path / "s"))
    assert back.columns == state.columns and back.genes is None
    assert sorted(map(str, back.pieces.collect())) == sorted(map(str, pieces.collect())) and sorted(back.resolutions.collect()) == sorted(state.resolutions.collect())
    state.to_csv(str(tmp_path / "csv"))
    again = orchestrate.read_pieces_csv(spark, str(tmp_path / "csv"), pieces)
    assert sorted(map(str, again.collect())) == sorted(map(str, pieces.collect()))


def test_packed_tables(spark, tmp_path):
    table = spark.range(10_000).select("id", (F.col("id") % 50).cast("int").alias("a"), (F.col("id") * 3).alias("b"))
    store = codec.PackedStore(spark, str(tmp_path / "p"), 200_000)
    assert store.put("t", table, "id", 1024) > 4 and store.views() == ["t"]
    assert spark.sql("select count(*), sum(a), sum(b), max(id) from t").first() == table.selectExpr("count(*)", "sum(a)", "sum(b)", "max(id)").first()
    assert store.report().first().packed == store.used
    with pytest.raises(MemoryError):
        store.put("u", spark.range(200_000).select("id", F.xxhash64("id").alias("h")), "id")
    with pytest.raises(TypeError):
        store.put("v", table.withColumn("s", F.lit("x")), "id")
    store.evict("t")
    assert store.used == 0 and not spark.catalog.tableExists("t")


def test_stored_index_and_engines(spark, tmp_path):
    lines = spark.createDataFrame([(i, f"line {i} {'needle' if i % 97 == 0 else 'hay'} é{i * 31}") for i in range(2000)], "line long, text string")
    X.store_index(X.trigram_index(lines, 16), str(tmp_path / "x"))
    index = X.stored_index(spark, str(tmp_path / "x"))
    assert X.search_lines(lines, "NEEDLE", index=index, block_lines=16).count() == 21 == X.search_lines(lines, "needle").count()
    assert X.search_lines(lines, r"needle\s+é\d+", index=index, block_lines=16, regex=True).count() == 21
    plan = X.trigram_candidates(index, "needle")._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "part" in plan
    assert [X.search_engine(*a) for a in (("abc", False, True), ("ab", False, True), ("abc", False, False), (r"a.c", True, True), (r"abcd.*", True, True))] == ["index", "scan", "scan", "scan", "index"]
    assert X.trigram_index(spark.createDataFrame([(0, "aé\nbc"), (1, "ab"), (2, None)], "line long, text string"), 1).count() == 3


def test_contained_items(spark):
    words = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(words[i * 7 : i * 7 + n])) for i, n in enumerate((1, 2, 3, 4, 8, 20))] + [(9, "w10 w11"), (10, "not there at all in any")]
    docs = [(0, "x" + " ".join(words) + "y"), (1, " ".join(words[:40])), (2, None), (3, ""), (4, "  ".join(words))]
    got = X.contained_items(spark.createDataFrame(items, "item_id int, text string"), spark.createDataFrame(docs, "doc_id int, text string"))
    assert sorted(tuple(r) for r in got.collect()) == sorted((i, d) for i, t in items for d, text in docs if text and t in text)
