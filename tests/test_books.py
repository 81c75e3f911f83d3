import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vastgrain.functions import codec, routes
from vastgrain.plans import logbook, staging
from vastgrain.plans.navigation import WindowedFrame


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-(2**63), 2**63 - 1), max_size=300))
def test_bitpack_round_trip(values):
    a = np.array(values, np.int64)
    assert (codec.decode_any(codec.encode_any(a)) == a).all()


def test_codec_choice_and_columns(spark):
    assert codec.encode_any(np.arange(1000)).ratio > 20 and codec.encode_any(np.array([0.5])).codec == "deflate"
    with pytest.raises(TypeError):
        codec.encode_any(np.array(["a"], object))
    df = spark.createDataFrame([("a", [5, 6, 7, -1]), ("b", []), ("c", None)], "n string, v array<bigint>")
    back = df.select("n", codec.unpack_column(codec.pack_column(F.col("v"))).alias("v")).collect()
    assert {r.n: r.v for r in back} == {"a": [5, 6, 7, -1], "b": [], "c": None}
    assert codec.ratio_report(df.filter("v is not null"), "n", "v").count() == 2


def test_catalogue(spark, tmp_path):
    c = logbook.Catalogue(spark, str(tmp_path / "c"))
    assert c.entries().count() == 0
    c.record("k1", "t1", {"assay": "x"})
    c.streamed("k1", 10)
    c.annotate("k1", {"tissue": "y"}, confident=True)
    c.opened("k2", "t2")
    c.local("k0", "/too/early")
    (tmp_path / "c" / "torn.jsonl").write_text('{"event": "rec')
    rows = {r.key: r for r in c.entries().collect()}
    assert set(rows) == {"k1", "k2"} and rows["k1"].bytes_streamed == 10 and rows["k1"].facets == {"assay": "x", "tissue": "y"}
    assert [r.key for r in c.unsettled().collect()] == ["k2"] and c.find("Y").count() == 1
    c.compact()
    assert c.entries().count() == 2 and c.tail(2).count() == 2
    with pytest.raises(KeyError):
        c.annotate("k1", {"colour": "red"})
    c.view("cat_events")
    assert spark.sql("select count(*) from cat_events").first()[0] == 5


def test_journal_and_book(spark, tmp_path):
    j = logbook.Journal(spark, str(tmp_path / "j"))
    j.record("load", "d", [0, 10, 0, 10], bytes=5, session="s", genes=["A"])
    j.record("open", "d", bytes=1, session="s")
    assert j.search(overlaps=[5, 6, 5, 6]).count() == 1 and j.search(genes=["A"]).count() == 1 and j.search(overlaps=[10, 12, 0, 1]).count() == 0
    t = j.trails().first()
    assert (t["n"], t["bytes"], t["ops"]) == (2, 6, "load:1,open:1")
    assert j.coverage("d", (0, 100, 0, 100), 10).count() == 1
    b = logbook.SelectionBook(spark, str(tmp_path / "b"))
    one, two, three = b.add("rect", "r1", {"x": 1}), b.add("rect", "r2", {}, intent="need-data"), b.add("locus", "l", {}, intent="double-check")
    b.update(one, status="described", note="n")
    b.delete(three)
    b.update("missing", note="x")
    rows = {r.id: r for r in b.all().collect()}
    assert set(rows) == {one, two} and rows[one].status == "described" and rows[one].note == "n" and rows[one].geometry == '{"x": 1}'
    assert [r.id for r in b.open_questions().collect()] == [two]


def test_staging_evicts_all_or_nothing(spark, tmp_path):
    s = staging.Staging(spark, str(tmp_path / "s"), 20_000)
    made = []

    def make(n):
        made.append(n)
        return spark.range(n).coalesce(1)

    s.put("a", lambda: make(10), "src", "w1", pin=True)
    s.put("a", lambda: make(10), "src", "w1")
    assert made == [10]
    s.put("b", lambda: make(20), "src")
    size = s.used
    with pytest.raises(staging.StagingFull):
        s.put("c", lambda: make(200_000), "src")
    assert set(s.index) == {"a", "b"} and s.used == size
    s.capacity = s.used + 10
    s.put("d", lambda: make(20), "src")
    assert set(s.index) == {"a", "d"} and set(staging.Staging(spark, str(tmp_path / "s"), 20_000).index) == {"a", "d"}


def test_workspace_and_isolation(spark):
    w = staging.Workspace("1MB")
    w.add("x", WindowedFrame.over(spark.range(100), "id"), "512KB")
    w.add("y", "not a view", 1000)
    w.select_fraction((0.25, 0.5))
    assert w.views["x"].window == ((25, 50),) and "y" in w.failed
    with pytest.raises(MemoryError):
        w.add("z", None, "1MB")
    w.drop("x")
    assert w.budget.used == 1000
    assert staging.run_isolated(lambda a: a + 1, 2, timeout=20) == 3
    with pytest.raises(RuntimeError, match="ZeroDivisionError"):
        staging.run_isolated(lambda: 1 // 0, timeout=20)


def test_routes(spark):
    rows = [
        ("A", "r1", "ena-http", "u1", 100, "free", "fastq", True), ("A", "r1", "aws-requester", "u2", 1 << 30, "aws-requester", "sra", True), ("A", "r2", "aws-requester", "u3", 0, "aws-requester", "sra", True),
        ("B", "r3", "gcp-requester", "u4", 1 << 30, "gcp-requester", "sra", False),
    ]
    df = spark.createDataFrame(rows, "accession string, run string, kind string, url string, bytes long, cost_class string, representation string, available boolean")
    assert {(r.url, r.place) for r in routes.rank_routes(df).collect()} >= {("u1", 1), ("u2", 2), ("u4", 1)}
    assert {r.accession: r.cost for r in routes.cheapest(df).collect()} == {"A": None, "B": 0.12}
    assert "CD3D" in routes.repository_queries(["CD3D"])["gds"]
    files = spark.createDataFrame([("a", 5), ("b", 3), ("c", 9)], "path string, size long")
    assert sorted(r.path for r in routes.capped_pick(files, 9).collect()) == ["a", "b"]
