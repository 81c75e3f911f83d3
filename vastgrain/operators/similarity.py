"""Descriptions of selections, and windows that resemble them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def describe_range(df: DataFrame, key: str, lo, hi, columns: Sequence[str]) -> DataFrame:
    """Mean inside a half-open range, mean of all, and their difference in sample deviations (0 or none counts as 1): a row a column."""
    inside = (F.col(key) >= lo) & (F.col(key) < hi)
    flat = df.select(inside.alias("inside"), F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("inside", "x.name", "x.v")
    per = flat.groupBy("name").agg(F.avg(F.when(F.col("inside"), F.col("v"))).alias("mean_in"), F.avg("v").alias("mean_all"), F.stddev_samp("v").alias("sd"))
    dev = F.when(F.coalesce("sd", F.lit(0.0)) == 0, 1.0).otherwise(F.col("sd"))
    return per.select("name", "mean_in", "mean_all", ((F.col("mean_in") - F.col("mean_all")) / dev).alias("z"))


def hopping_features(df: DataFrame, ts: str, value: str, span: str, stride: str) -> DataFrame:
    """Mean, sample deviation, most and least of a value in hopping windows: ``start, n, mean, sd, high, low``."""
    w = F.window(ts, span, stride)
    return df.groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.max(value).alias("high"), F.min(value).alias("low")).select(F.col("w.start").alias("start"), "n", "mean", "sd", "high", "low")


def sliding_distance(series: DataFrame, at: str, value: str, query: Sequence[float]) -> DataFrame:
    """Likeness 1 / (1 + mean absolute distance) of each run of len(query) buckets to a query, both as z-scores.

    The window runs over buckets of an overview (bounded by its resolution), not over raw rows.
    """
    n = len(query)
    stats = series.agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"))
    z = series.crossJoin(F.broadcast(stats)).withColumn("z", (F.col(value) - F.col("m")) / F.when(F.coalesce("s", F.lit(0.0)) == 0, 1.0).otherwise(F.col("s")))
    run = Window.orderBy(at).rowsBetween(0, n - 1)
    q = F.array(*[F.lit(float(v)) for v in query])
    held = z.withColumn("vals", F.collect_list("z").over(run)).filter(F.size("vals") == n)
    d = F.aggregate(F.zip_with("vals", q, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, x: a + x) / n
    return held.select(at, (1 / (1 + d)).alias("score"))


def tile_profiles(points: DataFrame, tile: int, stride: int, x: str = "x", y: str = "y", gene: str = "gene", value: str = "count") -> DataFrame:
    """Gene sums of overlapping square tiles: ``tx, ty, gene, total``. A point is copied to the tiles that hold it ((tile / stride) squared)."""
    starts = lambda c: F.expr(f"sequence(greatest(0, ({c} - {tile}) div {stride} + if({c} >= {tile}, 1, 0)), {c} div {stride})")
    flat = points.select(x, y, gene, value, F.explode(starts(x)).alias("tx")).select("tx", y, gene, value, F.explode(starts(y)).alias("ty"))
    return flat.groupBy("tx", "ty", F.col(gene).alias("gene")).agg(F.sum(value).cast("long").alias("total"))


def tile_similarity(profiles: DataFrame, tx: int, ty: int) -> DataFrame:
    """Cosine of log1p counts per ten thousand between every tile and one: ``tx, ty, score``."""
    sums = profiles.groupBy("tx", "ty").agg(F.sum("total").alias("s"))
    v = profiles.join(sums, ["tx", "ty"]).filter("s > 0").select("tx", "ty", "gene", F.log1p(F.col("total") * 1e4 / F.col("s")).alias("v"))
    norms = v.groupBy("tx", "ty").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    query = v.filter((F.col("tx") == tx) & (F.col("ty") == ty)).select("gene", F.col("v").alias("q"))
    qn = query.agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("qn"))
    dots = v.join(query, "gene").groupBy("tx", "ty").agg(F.sum(F.col("v") * F.col("q")).alias("dot"))
    return dots.join(norms, ["tx", "ty"]).crossJoin(F.broadcast(qn)).select("tx", "ty", (F.col("dot") / (F.col("norm") * F.col("qn"))).alias("score"))


def suppress(boxes: Sequence[tuple[float, float, float, float, float]], k: int, overlap: float, taken: Sequence[tuple[float, float, float, float]] = ()) -> list[int]:
    """Greedy non-maximum suppression of (x0, x1, y0, y1, score): places of those kept, the best first.

    Meant for the few candidates a top-k query returns; it is sequential by nature.
    """
    from .windows import overlap_share

    kept: list[int] = []
    for i in sorted(range(len(boxes)), key=lambda i: (-boxes[i][4], i)):
        if len(kept) == k:
            break
        others = [*taken, *(boxes[j][:4] for j in kept)]
        if all(overlap_share(boxes[i][:4], o) <= overlap for o in others):
            kept.append(i)
    return kept


def similar_tiles(profiles: DataFrame, tx: int, ty: int, tile: int, stride: int, k: int, overlap: float = 0.2) -> DataFrame:
    """The k tiles most like one, overlapping neither it nor each other by much: ``rank, tx, ty, score``."""
    box = lambda a, b: (a * stride, a * stride + tile, b * stride, b * stride + tile)
    ranked = tile_similarity(profiles, tx, ty).orderBy(F.desc("score"), "tx", "ty")
    asked = max(20 * k, 60)
    while True:  # more of the best tiles, until enough of them are apart or none is left
        few = ranked.limit(asked).collect()
        kept = suppress([(*box(r["tx"], r["ty"]), r["score"]) for r in few], k, overlap, [box(tx, ty)])
        if len(kept) == k or len(few) < asked:
            break
        asked *= 4
    return profiles.sparkSession.createDataFrame([(n, few[i]["tx"], few[i]["ty"], float(few[i]["score"])) for n, i in enumerate(kept)], "rank int, tx int, ty int, score double")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def spread_indices(total: int, k: int, seed: int | None = None) -> list[int]:
    """k evenly spaced places out of ``total``; with a seed, jittered within each stride."""
    k = min(k, total)
    rng = np.random.default_rng(seed) if seed is not None else None
    out = []
    for i in range(k):
        lo, hi = i * total // k, (i + 1) * total // k
        out.append(int(rng.integers(lo, max(lo + 1, hi))) if rng is not None else lo)
    return out


def softmax_evidence(evidence: DataFrame, priors: dict[str, float]) -> DataFrame:
    """Log-odds of each label (prior plus the weights of its evidence), as probabilities that sum to 1 per target: ``target, label, p``."""
    spark = evidence.sparkSession
    labels = spark.createDataFrame(list(priors.items()), "label string, prior double")
    targets = evidence.select("target").distinct()
    sums = evidence.groupBy("target", "label").agg(F.sum("weight").alias("w"))
    odds = targets.crossJoin(labels).join(sums, ["target", "label"], "left").withColumn("e", F.exp(F.col("prior") + F.coalesce("w", F.lit(0.0))))  # a row a label
    return odds.withColumn("p", F.col("e") / F.sum("e").over(Window.partitionBy("target"))).select("target", "label", "p")
