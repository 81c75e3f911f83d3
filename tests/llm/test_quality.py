import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from tests.llm import cases
from vastgrain.llm import quality as Q
from vastgrain.llm.queries import op6_quality


def documents():
    rnd = random.Random(9)
    vocabulary = [f"{a}{b}" for a in ("ta", "re", "on", "li", "sa") for b in ("n", "m", "st", "ve", "r")]
    rows, labels = [], []
    for i in range(400):
        good = i % 5 != 0
        words = [rnd.choice(vocabulary) for _ in range(rnd.randint(20, 80))]
        text = " ".join(words) + "." if good else rnd.choice([" | ".join(words), " ".join(w + rnd.choice(["%%%", "&&&"]) for w in words)])
        rows.append((i, text))
        labels.append((i, int(good), 0))
    return rows, labels


def test_held_out_accuracy_and_split(spark, tmp_path):
    rows, labels = documents()
    cases.simple(spark, tmp_path, rows)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(str(tmp_path / "labels.parquet"))
    truth = {i: y for i, y, _ in labels}
    got = op6_quality(spark, str(tmp_path)).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in got)
    out = [r for r in got if r.held_out]
    assert len(out) > 50 and np.mean([r.predicted == truth[r.doc_id] for r in out]) > 0.95


def test_awkward_rows(spark, tmp_path):
    docs = cases.table(spark, tmp_path)
    for labels in ([(1, 1, 0), (9, 0, 0), (None, 1, 0), (4, None, 0)], []):
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(str(tmp_path / "labels.parquet"))
        got = op6_quality(spark, str(tmp_path)).collect()
        assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert all(r.score == 0.5 for r in got)


def test_sparse_vector_is_the_plain_sum():
    f = Q.Features(64)
    at, x = f.vector("a b a b c ?!")
    assert at[0] == 0 and (np.diff(at) > 0).all() and abs((x[1:] ** 2).sum() - 1) < 1e-9
    assert f.vector("")[0].tolist() == [0]


def plain_vector(text, slots):
    """Slot to value, counted one token after another."""
    tokens, m = re.findall(r"\w+|[^\w\s]+", text), (1 << 64) - 1
    hashes = [zlib.crc32(t.encode()) for t in tokens]
    mixed = hashes + [(a * 31 + b + (1 << 33)) & m for a, b in zip(hashes, hashes[1:], strict=False)]
    count = Counter(((h * 0x9E3779B97F4A7C15 & m) >> 40) % (slots - 2) + 1 for h in mixed)
    twice = sum(a == b for a, b in zip(hashes, hashes[1:], strict=False))
    if twice:
        count[slots - 1] += twice
    norm = math.sqrt(sum(count.values()))
    return {0: 1.0} | {k: math.sqrt(n) / norm for k, n in count.items()}


def logistic(x):
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))


def plain_scores(rows, labels, in_order, slots=Q.SLOTS, alpha=2.0, beta=1.0, l1=0.005, l2=0.01, epochs=12):
    """The update as published, one coordinate after another."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(k):
        return 0.0 if abs(z[k]) <= l1 else -(z[k] - math.copysign(l1, z[k])) / ((beta + math.sqrt(n[k])) / alpha + l2)

    text = dict(rows)
    sample = [(plain_vector(text[i], slots), labels[i]) for i in in_order]
    for _ in range(epochs):
        for x, y in sample:
            w = {k: weight(k) for k in x}
            p = logistic(sum(w[k] * v for k, v in x.items()))
            for k, v in x.items():
                g = (p - y) * v
                sigma = (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / alpha
                z[k] += g - sigma * w[k]
                n[k] += g * g
    return {i: logistic(sum(weight(k) * v for k, v in plain_vector(t, slots).items())) for i, t in rows}


def test_scores_against_the_plain_update(spark, tmp_path):
    rows, labels = documents()
    rows = [*rows, (900, ""), (901, "ta ta ta ta"), (902, "Öl &&& 中文 " * 50)]
    cases.simple(spark, tmp_path, rows)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(str(tmp_path / "labels.parquet"))
    learned = [i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 5]
    ids = spark.createDataFrame([(i,) for i in learned], "i long")
    in_order = [r.i for r in ids.orderBy(F.xxhash64(F.col("i").cast("string"))).collect()]
    want = plain_scores(rows, {i: y for i, y, _ in labels}, in_order)
    got = {r.doc_id: r.score for r in op6_quality(spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in got) < 1e-4


def test_very_long_texts(spark, tmp_path):
    rows, labels = documents()
    text = " ".join(t for _, t in rows[:200]) * 30
    docs = cases.simple(spark, tmp_path, [*rows, (1000, text)])
    found = docs.select("doc_id", Q.score_column(np.full(Q.SLOTS, 0.25))("text").alias("s")).filter("doc_id = 1000").first().s
    assert len(text) > 1_000_000 and abs(found - logistic(0.25 * sum(plain_vector(text, Q.SLOTS).values()))) < 1e-6
