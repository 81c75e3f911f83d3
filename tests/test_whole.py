"""Queries over whole tables: rows, characters and languages that narrower queries leave out count too."""

from pyspark.sql import functions as F

from vastgrain.catalogue import QUERIES

FOLDER = "/root/testdata/sf0.001"


def write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def got(spark, name, folder=FOLDER):
    return [tuple(r) for r in QUERIES[name](spark, str(folder)).collect()]


def test_revcomp_takes_all_characters(spark, tmp_path):
    write(spark, tmp_path, "documents", [(1, "A" * 100 + "C")], "doc_id long, text string")
    assert got(spark, "revcomp", tmp_path) == [(1, "G" + "T" * 100)]


def test_spread_sample_reaches_the_end_of_the_table(spark, tmp_path):
    for n in (1000, 20_000):
        folder = tmp_path / str(n)
        write(spark, folder, "events", [(i, float(i)) for i in range(n)], "event_id long, value double")
        assert sorted(i for i, _ in got(spark, "spread_sample", folder)) == [i * n // 40 for i in range(40)]


def test_no_record_is_left_out(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    lines = spark.read.parquet(f"{FOLDER}/lineitem.parquet")
    orders = spark.read.parquet(f"{FOLDER}/orders.parquet")
    assert {r[0] for r in got(spark, "upsert_merge")} >= {r.doc_id for r in docs.select("doc_id").collect()}
    assert len(got(spark, "one_per_run")) == lines.selectExpr("l_orderkey", "l_partkey % 50").distinct().count()
    assert len({r[0] for r in QUERIES["panel_zero_fill"](spark, FOLDER).select("cell").collect()}) == orders.count()
    write(spark, tmp_path, "documents", [(i, "the") for i in range(0, 6401, 100)], "doc_id long, text string")
    assert dict(got(spark, "hit_profile", tmp_path)) == {b: 2 + (b == 31) for b in range(32)}
    events = [(i, u, k) for i, (u, k) in enumerate((u, k) for u in (5, 70, 900) for k in ("click", "view"))]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string").withColumn("ts", F.lit("2024-01-01").cast("timestamp")).write.parquet(f"{tmp_path}/events.parquet")
    assert sorted(got(spark, "cohort_complete", tmp_path)) == [(5, 1), (70, 1), (900, 1)]


def test_no_language_is_left_out(spark, tmp_path):
    write(spark, tmp_path, "documents", [(1, "de", "that GC"), (5000, "en", "that")], "doc_id long, lang string, text string")
    for name in ("text_normalise", "pattern_hits"):
        assert {r[0] for r in got(spark, name, tmp_path)} == {1, 5000}
    assert sum(r.n for r in QUERIES["seq_buckets"](spark, str(tmp_path)).collect()) == 2
    assert sum(r.n for r in QUERIES["seq_zoom"](spark, str(tmp_path)).collect()) == 2
    assert {r[0] for r in got(spark, "pattern_offsets", tmp_path)} == {1, 5000}
