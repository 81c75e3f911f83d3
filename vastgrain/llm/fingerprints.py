"""Document fingerprints from closed syncmers.

A k-mer of code points is an anchor when the smallest of its inner s-mers is the first or the last one. That
depends on the k-mer alone, so an edit far away changes no anchor. The fingerprint holds hashes of anchors in the order
of their positions, as fixed-width hexadecimal digits: all distinct anchors of a text of up to ``KEEP``; of a longer
one those whose hash is under a fixed share ``FRACTION`` of all hashes, and the ``KEEP`` smallest at least. So it grows with
the text, and which anchors it holds depends on the anchors alone.

Two fingerprints are matched by position: of the hashes that both would hold, the longest chain that stands in the same
order in both counts, and the likeness is its length over that of both together less the chain (a Jaccard index of
the anchors where their order agrees; exact for texts of up to ``KEEP`` anchors, else a sample of some sixteenth of them).

Cases: null counts as empty; a text shorter than a k-mer, or without any anchor, has one anchor, the hash of
the whole text; the empty text has the empty fingerprint, which is like itself (1) and unlike others (0).
Texts are taken whole; equal texts have equal fingerprints.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, text_of

K = 16
S = 5
#: Anchors a fingerprint holds at least, and the share of all hashes that it holds in any case.
KEEP = 128
FRACTION = 16
#: Code points hashed at a time, to bound memory on long texts.
SPAN = 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _gram(points: np.ndarray, n: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hash of each n-gram, or of those that start ``at``."""
    size = len(points) - n + 1
    total = np.zeros(size if at is None else len(at), np.uint64)
    for i in range(n):
        total = total * np.uint64(0x9E3779B97F4A7C15) + (points[i : i + size] if at is None else points[at + i])
    return _mix(total)


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each n entries in a row."""
    width = 1
    while 2 * width <= n:
        x = np.minimum(x[: len(x) - width], x[width:])
        width *= 2
    return x if width == n else np.minimum(x[: len(x) - (n - width)], x[n - width :])


def anchors(text: str, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Positions (code points) and 32-bit hashes of the closed syncmers of a text, in text order."""
    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    at, found = [], []
    for lo in range(0, max(1, len(points) - k + 1), SPAN):
        part = points[lo : lo + SPAN + k - 1]
        if len(part) < k:
            break
        inner = _gram(part, s)
        w = k - s + 1
        least = _least(inner, w)
        closed = np.nonzero((least == inner[: len(least)]) | (least == inner[w - 1 :]))[0]
        at.append(closed + lo)
        found.append(_gram(part, k, closed) >> np.uint64(32))
    if not at or not sum(map(len, at)):
        whole = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=4).digest()
        return np.zeros(1, np.int64), np.frombuffer(whole, "<u4").astype(np.uint64)
    return np.concatenate(at), np.concatenate(found)


def sketch(text: str, k: int = K, s: int = S, keep: int = KEEP) -> np.ndarray:
    """The hashes a fingerprint holds, each at the first place where its anchor stands, in text order."""
    found = anchors(text, k, s)[1]
    distinct, first = np.unique(found, return_index=True)
    n = max(keep, int(np.searchsorted(distinct, (1 << 32) // FRACTION)))
    return found[np.sort(first[:n])]


def to_text(hashes: np.ndarray) -> str:
    return hashes.astype(">u4").tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(np.uint64)


def _common_chain(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence of two sequences without repeats: the longest rising run of b's places in a's order."""
    _, at, places = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    in_order = places[np.argsort(at, kind="stable")]
    if (np.diff(in_order) > 0).all():
        return len(in_order)
    tails: list[int] = []
    for x in in_order.tolist():
        i = bisect_left(tails, x)
        tails[i : i + 1] = [x]
    return len(tails)


def likeness(a: np.ndarray, b: np.ndarray, keep: int = KEEP) -> float:
    """Likeness of two sketches by their anchors and the order of these, from 0 to 1."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    # A sketch of fewer hashes is whole; beyond the lesser of the largest ones, one of the two may lack some.
    reach = min(int(x.max()) if len(x) >= keep else 1 << 32 for x in (a, b))
    a, b = a[a <= reach], b[b <= reach]
    c = _common_chain(a, b)
    return c / (len(a) + len(b) - c)


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, s: int = S, keep: int = KEEP, with_anchors: bool = False) -> DataFrame:
    """``doc_id, n_chars long, fingerprint string`` and, on demand, ``anchors array<struct<pos:long,hash:long>>``."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(1).to_pylist()
            columns = [batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array([to_text(sketch(t, k, s, keep)) for t in texts], pa.string())]
            names = ["doc_id", "n_chars", "fingerprint"]
            if with_anchors:
                kind = pa.list_(pa.struct([("pos", pa.int64()), ("hash", pa.int64())]))
                found = [anchors(t, k, s) for t in texts]
                columns.append(pa.array([[{"pos": p, "hash": h} for p, h in zip(at.tolist(), hs.view(np.int64).tolist(), strict=True)] for at, hs in found], kind))
                names.append("anchors")
            return pa.RecordBatch.from_arrays(columns, names)

        return step

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_chars long, fingerprint string" + (", anchors array<struct<pos:bigint,hash:bigint>>" if with_anchors else "")
    return map_batches(docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")), make, schema)


def edited(text: str, following: str) -> str:
    """The text with its last half (rounded down) replaced by as many first code points of the next text, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, s: int = S, keep: int = KEEP, rows_per_range: int = 2048, max_ranges: int = 4096) -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness; neighbours by ascending doc_id.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``. The next of
    the last document is the first one. Ties of doc_id go by text, a null doc_id comes first; a single document
    is its own next.

    Texts cross the network once. Ids alone give the limits of ranges of about ``rows_per_range`` rows (more, where
    that would make over ``max_ranges``); each range is sorted (with spill) and read in order, and ends with a copy
    of the first document of the range after it. What the driver holds is one id a range.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).alias("doc_id"))
    kind = docs.schema[id_col].dataType.simpleString()
    rows, low, high = narrow.agg(F.count(F.lit(1)), F.min("doc_id"), F.max("doc_id")).first()
    n = max(1, min(max_ranges, -(-rows // rows_per_range)))
    cuts: list = []
    if n > 1 and high is not None and low != high:
        marks = narrow.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10_000).alias("q")).first()["q"]
        cuts = sorted({m for m in marks if m > low})

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(cuts), ids.to_numpy(), side="right"), dtype="int32")

    bucket = F.when(F.col("doc_id").isNull(), 0).otherwise(range_of(F.coalesce("doc_id", F.lit(low)))) if cuts else F.lit(0)
    base = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).withColumn("bucket", bucket)
    # The smallest id of each bucket that has rows: at most one a range.
    least = {r["bucket"]: r["id"] for r in narrow.withColumn("bucket", bucket).groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("v"), F.col("doc_id").alias("id"))).alias("m")).select("bucket", F.col("m.id").alias("id")).collect()}
    present = sorted(least)
    before = {b: present[i - 1] for i, b in enumerate(present)}  # the first bucket's copy ends the last bucket
    if not present:
        before = {0: 0}
        least = {0: None}
    table = spark.createDataFrame([(b, before[b], least[b]) for b in present] or [(0, 0, None)], f"bucket int, before int, least {kind}")
    firsts = base.join(F.broadcast(table), "bucket").filter(F.col("doc_id").eqNullSafe(F.col("least")))
    firsts = firsts.groupBy("bucket", "before", "doc_id").agg(F.min("text").alias("text"))
    rows_in_order = base.select("bucket", F.lit(0).alias("copy"), "doc_id", "text").unionByName(firsts.select(F.col("before").alias("bucket"), F.lit(1).alias("copy"), "doc_id", "text"))
    dealt = rows_in_order.repartition(max(1, len(present)), "bucket").sortWithinPartitions("bucket", "copy", F.asc_nulls_first("doc_id"), "text")

    def make():
        held: list = []  # bucket, id, text, sketch of the row before

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            out: list[tuple] = []
            for b, copy, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                own = sketch(text, k, s, keep)
                if held and held[0] == b:
                    _, prev_id, prev_text, prev = held
                    changed = edited(prev_text, text)
                    other = sketch(changed, k, s, keep)
                    digest = hashlib.sha256(changed.encode()).hexdigest()
                    out.append((prev_id, len(prev_text), digest, to_text(prev), to_text(other), likeness(prev, other, keep), likeness(prev, own, keep)))
                held[:] = [] if copy else [b, doc_id, text, own]
            kinds = [batch.schema.field(2).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            columns = zip(*out, strict=True) if out else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        return step

    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return map_batches(dealt, make, schema)
