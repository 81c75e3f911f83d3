import pyarrow as pa

from vastgrain.llm import common as C


def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([sum(batch.column(0).to_pylist())])], ["n", "total"])


def test_functions_of_batches_get_few_rows(spark):
    """Whole batches of texts took most of a worker's memory; every row still comes, once and in order."""
    n = 3 * C.TEXT_ROWS + 1
    table = spark.range(0, n, 1, 1)
    found = C.map_batches(table, lambda: counted, "n long, total long").collect()
    assert [r.n for r in found] == [C.TEXT_ROWS] * 3 + [1] and sum(r.total for r in found) == n * (n - 1) // 2
    assert C.map_batches(table.filter("id < 0"), lambda: counted, "n long, total long").agg({"n": "sum"}).first()[0] in (None, 0)


def test_tables_of_texts_are_made_in_small_batches(spark):
    """Spark itself hands over few rows at a time, and the session's setting is as before."""
    before, seen = spark.conf.get(C.BATCH_CONF), lambda batches: (counted(b) for b in batches)
    table = spark.range(0, 2 * C.TEXT_ROWS, 1, 1).mapInArrow(seen, "n long, total long")
    assert [r.n for r in C.materialize(table, "few", texts=True).collect()] == [C.TEXT_ROWS] * 2
    assert [r.n for r in C.materialize(table, "many").collect()] == [2 * C.TEXT_ROWS]
    assert spark.conf.get(C.BATCH_CONF) == before


def test_filter_leaves_the_values_that_are_among(spark):
    few = spark.range(0, 3000, 3).withColumnRenamed("id", "v")
    rows = spark.createDataFrame([(0, [3, 4, 6, 3]), (1, []), (2, [5]), (3, [2997, -1])], "i long, vs array<long>").coalesce(1)
    left = C.maybe_among(few, "v", 1000, each=True)
    got = {r.i: r.x for r in rows.select("i", left("vs").alias("x")).collect()}
    exact = {i: [v for v in x if v % 3 == 0 and v >= 0] for i, x in got.items()}
    assert exact == {0: [3, 6, 3], 1: [], 2: [], 3: [2997]} and sum(map(len, got.values())) <= 6
    none = rows.filter("i = 1").select(left("vs").alias("x")).collect()
    assert [r.x for r in none] == [[]] and rows.filter("i > 5").select(left("vs").alias("x")).count() == 0


def test_no_stage_runs_two_python_functions(spark):
    """The texts of mixed buckets pass one function on their way; two in one stage keep twice the workers."""
    from pyspark.sql import functions as F

    from vastgrain.llm import neardup as N

    asked = []
    texts = spark.range(40).select(F.col("id").alias("node"), F.lit(5).cast("long").alias("n_kmers"), F.array([F.col("id") % (k + 2) for k in range(3)]).alias("sample"))
    mixed = texts.select(F.explode(N._buckets(0, 3)).alias("bucket"), F.col("node").alias("root")).distinct()
    roots = spark.createDataFrame([(1, 0)], "node long, root long")

    def stored(df, name, *a, **b):
        asked.append((name, str(df._jdf.queryExecution().executedPlan())))
        return C.materialize(df, name, *a, **b)

    N.materialize, kept = stored, N.materialize
    try:
        rows = N.left_rows(texts, mixed, roots, 3, 40)
    finally:
        N.materialize = kept
    plan = dict(asked)["left-texts"]
    assert plan.count("ArrowEvalPython ") == 1
    want = {(r.bucket, r.node) for r in texts.select("node", F.explode(N._buckets(0, 3)).alias("bucket")).collect()}
    assert {(r.bucket, r.node) for r in rows.collect()} == want


def test_redacted_texts_leave_in_small_parts(spark):
    from vastgrain.llm import secrets

    rows = spark.range(0, 2 * C.TEXT_ROWS + 3, 1, 1).selectExpr("id", "if(id % 7 = 0, null, concat('x token = abcdef0123456789 ', id)) as text")
    got = {r.id: r.t for r in rows.select("id", secrets.redactor()("text").alias("t")).collect()}
    assert got == {i: None if i % 7 == 0 else f"x <assign> {i}" for i in range(2 * C.TEXT_ROWS + 3)}
    import pandas as pd

    parts = list(secrets.redactor().func(iter([pd.Series(["a"] * (C.TEXT_ROWS + 1))])))
    assert [len(p) for p in parts] == [C.TEXT_ROWS, 1]
