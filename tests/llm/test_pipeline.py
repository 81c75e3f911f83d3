import random
import re
import zlib

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import cases, test_neardup, test_quality


def test_stages_keep_the_columns_and_take_effect(spark, tmp_path):
    rows, labels = test_quality.documents()
    rows += [(1000, rows[1][1]), (1001, rows[2][1] + " once more"), (1002, rows[3][1] + ' token = "abcdef0123456789"')]
    docs = cases.simple(spark, tmp_path, rows)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(str(tmp_path / "labels.parquet"))
    counts = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        path = str(tmp_path / f"stage{k}")
        out.write.parquet(path)
        if k < 4:
            assert out.columns == docs.columns
        docs = spark.read.parquet(path)
        counts.append(docs.select("doc_id").distinct().count())
        if k == 3:
            assert not docs.filter("text like '%abcdef0123456789%'").count()
    assert counts[0] < len(rows) and counts[1] < counts[0] and counts[2] < counts[1] and counts[3] == counts[4] == counts[2]


def test_empty_tables(spark, tmp_path):
    cases.empty(spark, tmp_path)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_awkward_rows(spark, tmp_path):
    cases.table(spark, tmp_path)
    spark.createDataFrame([(1, 1, 0), (14, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_columns_of_any_name_stay(spark, tmp_path):
    """Columns that go by the names of internal keys come through all stages as they are."""
    rows, labels = test_quality.documents()
    rows += [(1000, rows[1][1]), (1001, rows[2][1] + " once more")]
    names = ["__row", "__score", "__group", "group_number", "draw", "kept", "root"]
    docs = cases.simple(spark, tmp_path, rows)
    for n in names:
        docs = docs.withColumn(n, docs.doc_id * 2)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(str(tmp_path / "labels.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        path = str(tmp_path / f"stage{k}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if k < 4:
            assert out.columns[-len(names) :] == names and docs.filter(" or ".join(f"{n} != doc_id * 2" for n in names)).isEmpty()
    assert docs.count() > 0


def plain(rows, labels, score):
    """All stages but the last, by their definitions."""
    order = sorted(rows)
    left = [(i, t) for i, t in order if score[i] >= 0.3]
    best = {}
    for i, t in left:
        key = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        best[key] = max(best.get(key, (-1, 0, "")), (len(t or ""), -i, t))
    left = sorted((-i, t) for _, i, t in best.values())
    root = test_neardup.classes_of(left)
    return {i for i, _ in left if root[i] == i}


def test_kept_documents_against_brute_force(spark, tmp_path):
    rows, labels = test_quality.documents()
    rows = [(i, t * (1 + i % 2)) for i, t in rows]
    rnd = random.Random(4)
    rows += [(500 + i, rows[5 * i + 1][1].replace(" ", "  ") if i % 2 else rows[5 * i + 1][1] + rnd.choice([" ta", " ren li", ""])) for i in range(40)]
    cases.simple(spark, tmp_path, rows)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(str(tmp_path / "labels.parquet"))
    learned = [i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 5]
    in_order = [r.i for r in spark.createDataFrame([(i,) for i in learned], "i long").orderBy(F.xxhash64(F.col("i").cast("string"))).collect()]
    want = plain(rows, labels, test_quality.plain_scores(rows, {i: y for i, y, _ in labels}, in_order))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in got.select("doc_id").distinct().collect()} == want and len(want) < len(rows) - 80
