"""Near-duplicate detection with order MinHash and banded alignment.

Texts are words (lower-cased runs of word characters). A text's k-mers are its windows of five words; each
carries the number of earlier occurrences of the same window, so repeats count. Order MinHash draws several
samples: in each, the few labelled k-mers with the smallest hashes, kept in the order of the text. Texts that
agree in a sample are candidates.

A candidate pair is a link when its k-mer sequences, aligned in a band, share enough: with c matched k-mers in the
longest common subsequence, c / (a + b - c) >= 0.8. That is the Jaccard index of the k-mers where their order
agrees, and at that level the alignment can't leave the band, whose width follows from the threshold. With samples
of ``ELL`` k-mers, a pair at the threshold agrees in one sample with probability about 0.8 ** ELL (a half), and is
missed by all ``SAMPLES`` with probability about 3e-8 (4.7e-6 for 4 against 5 k-mers, where it is 0.4).

Scale: texts with the same words collapse first, so copies meet as one. Then four steps, each on the classes the ones
before have made:

1. buckets of the first ``FIRST`` samples: each text meets the bucket's smallest and largest text;
2. buckets of all samples, reduced to one text of each class: it meets those of the bucket's smallest and largest class;
3. buckets that still hold several classes, a few times over: each text outside a bucket's largest class meets one text of
   that class, another each time, so that texts of a large group that have missed it so far come in one by one;
4. every bucket that holds several classes even then: all pairs of texts of different classes in it. Buckets of at most
   ``FEW`` texts are paired as they are; the texts of the others go through an exact prefix join over their rare k-mers. So
   each pair that shares a sample is in one class, or tested, or ruled out by its counts.

No larger bucket's texts are paired all with all; buckets are reduced before the exchange and joined back on a key that adaptive
execution splits. Links become classes by alternating star contraction on DataFrames. Nothing of the corpus reaches the
driver but a table of counts of fixed size and filters whose size is checked, with a plain join beyond it.

Cases: null counts as empty; texts without a word are all alike (one class); texts of fewer words than a k-mer
have one k-mer, all their words; repeated rows are copies; a null doc_id is smallest; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, forget, keyed_table, map_batches, materialize, maybe_among, release, small_batches, text_of

WORDS = 5
THRESHOLD = 0.8
ELL = 3
SAMPLES = 24
#: Samples that part the large groups of copies before the others are looked at.
FIRST = 4
#: Samples a pair has to share before its texts are fetched in the first two steps; the exact join at the end asks for one.
AGREE = 3
#: Slots of the table of k-mer counts by which the exact join orders k-mers (8 MB); sharing a slot costs time only.
SLOTS = 1 << 20
#: Times that texts outside the largest class of their bucket meet a text of it before the exact step.
TURNS = 2
#: Texts of a bucket whose pairs the exact step takes as they are, at most half as many a text.
FEW = 8
#: Symbols of one side taken at a time in the banded alignment.
STEP = 512
#: Cells of a text's table of labelled k-mers, by which pairs are ruled out before their texts are fetched; seven to a long.
CELLS = 252
#: K-mers of one text hashed at a time.
CHUNK = 1 << 15
#: Pairs that a k-mer may make in the exact join before what its texts hold is looked at in the join itself.
HEAVY = 64
#: Code points of one text cut into words at a time.
SPAN = 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class _Words:
    """Tables by which words are found and hashed without a loop: which code points stand in words, and powers of a base with their inverses."""

    BASE = 0x9E3779B97F4A7C15
    letters: np.ndarray | None = None
    powers = inverses = np.zeros(0, np.uint64)

    @classmethod
    def inside(cls, points: np.ndarray) -> np.ndarray:
        if cls.letters is None:
            cls.letters = np.fromiter((c.isalnum() or c == "_" for c in map(chr, range(0x110000))), bool, 0x110000)
        return cls.letters[points]

    @classmethod
    def tables(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.powers) < n:
            size = 1 << max(12, (n - 1).bit_length())
            run = lambda base: np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, base, np.uint64))])
            cls.powers, cls.inverses = run(cls.BASE), run(pow(cls.BASE, -1, 1 << 64))
        return cls.powers, cls.inverses


class Shingles:
    """K-mer hashes of texts."""

    def __init__(self, words: int = WORDS):
        self.words = words

    def tokens(self, text: str) -> np.ndarray:
        """A hash for each word (a run of letters, digits and underscores, in lower case), whatever stands around it.

        A word's hash is that of a polynomial of its code points, taken from the text's running sums.
        """
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
        edges = np.flatnonzero(np.diff(_Words.inside(points).view(np.int8), prepend=np.int8(0), append=np.int8(0)))
        starts, ends = edges[::2], edges[1::2]
        out, k = np.zeros(len(starts), np.uint64), 0
        while k < len(starts):
            lo = starts[k]
            stop = max(k + 1, int(np.searchsorted(ends, lo + SPAN, side="right")))  # whole words
            part = points[lo : ends[stop - 1]]
            powers, inverses = _Words.tables(len(part) + 1)
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(_mix(part + np.uint64(1)) * powers[: len(part)], out=sums[1:])
            a, b = starts[k:stop] - lo, ends[k:stop] - lo
            out[k:stop] = (sums[b] - sums[a]) * inverses[a] + (b - a).astype(np.uint64)
            k = stop
        return _mix(out)

    def of(self, tokens: np.ndarray) -> np.ndarray:
        """A hash for each k-mer, in text order."""
        n = max(len(tokens) - self.words + 1, min(1, len(tokens)))
        total = np.zeros(n, np.uint64)
        for i in range(min(self.words, len(tokens))):
            total = total * np.uint64(0x9E3779B97F4A7C15) + tokens[i : i + n]
        return _mix(total)


def labelled(kmers: np.ndarray) -> np.ndarray:
    """K-mers with the number of their earlier occurrences mixed in."""
    n = len(kmers)
    order = np.argsort(kmers, kind="stable")
    same = kmers[order]
    first = np.append(True, same[1:] != same[:-1]) if n else np.zeros(0, bool)
    if first.all():
        return kmers
    rank = np.arange(n) - np.maximum.accumulate(np.where(first, np.arange(n), 0))
    out = np.empty(n, np.uint64)
    out[order] = rank.astype(np.uint64)
    return _mix(kmers + out * np.uint64(0xD6E8FEB86659FD93))


def order_minhash(marks: np.ndarray, samples: int = SAMPLES, ell: int = ELL) -> np.ndarray:
    """One hash for each sample of a text's labelled k-mers: of the ``ell`` smallest (or all there are) in text order."""
    numbers = np.arange(1, samples + 1, dtype=np.uint64)
    seeds = (numbers * np.uint64(0x9E3779B97F4A7C15))[:, None]
    least, places = np.zeros((samples, 0), np.uint64), np.zeros((samples, 0), np.int64)
    every = np.arange(samples)
    for lo in range(0, len(marks), CHUNK):  # what is held doesn't grow with the text
        values = marks[None, lo : lo + CHUNK] ^ seeds
        values *= np.uint64(0xFF51AFD7ED558CCD)
        values ^= values >> np.uint64(32)
        values *= np.uint64(0xC4CEB9FE1A85EC53)
        values = np.concatenate([least, values], axis=1)
        behind = lo - least.shape[1]
        picked, found = [], []
        for _ in range(min(ell, values.shape[1])):
            at = values.argmin(axis=1)
            picked.append(values[every, at])
            found.append(np.where(at < least.shape[1], places[every, np.minimum(at, places.shape[1] - 1)], at + behind) if places.shape[1] else at + behind)
            values[every, at] = np.uint64(0xFFFFFFFFFFFFFFFF)
        least, places = np.stack(picked, axis=1), np.stack(found, axis=1)
    in_order = np.take_along_axis(least, np.argsort(places, axis=1), axis=1)
    out = numbers - np.uint64(1)
    for k in range(in_order.shape[1]):
        out = out * np.uint64(0x100000001B3) + in_order[:, k]
    return out


def cells(marks: np.ndarray) -> list[int] | None:
    """How many of a text's labelled k-mers fall into each of ``CELLS`` cells, a byte each and seven bytes to a long; None where a
    count is over 127 (a text of some 30,000 words)."""
    held = np.bincount(((marks >> np.uint64(32)) * np.uint64(CELLS) >> np.uint64(32)).astype(np.int64), minlength=CELLS)
    if held.max(initial=0) > 127:
        return None
    return np.pad(held.astype(np.uint8).reshape(-1, 7), ((0, 0), (0, 1))).view("<i8").ravel().tolist()


def common_length(a: list[int], b: list[int], band: int) -> int:
    """Length of the longest common subsequence in which positions differ by at most about ``band``.

    Bit-parallel: one integer holds a row of the alignment, a bit for each symbol of ``a``; ``b`` is taken ``STEP``
    symbols at a time, and only the bits within the band of these take part.
    """
    low = 0
    while low < len(a) and low < len(b) and a[low] == b[low]:
        low += 1
    x, y = len(a), len(b)
    while x > low and y > low and a[x - 1] == b[y - 1]:
        x, y = x - 1, y - 1
    same = low + len(a) - x
    a, b = a[low:x], b[low:y]
    if not a or not b:
        return same
    bits = 0
    places: dict[int, list[int]] = {}
    for i, s in enumerate(a):
        places.setdefault(s, []).append(i)
    row = (1 << len(a)) - 1  # zeros mark where the common length grows
    for lo in range(0, len(b), STEP):
        part = b[lo : lo + STEP]
        left, right = max(0, lo - band), min(len(a), lo + len(part) + band)
        if left >= right:
            continue
        full = (1 << (right - left)) - 1
        masks: dict[int, int] = {}
        v = (row >> left) & full
        for s in part:
            m = masks.get(s)
            if m is None:
                m = 0
                for i in places.get(s, ()):
                    if left <= i < right:
                        m |= 1 << (i - left)
                masks[s] = m
            u = v & m
            if u:
                v = ((v + u) | (v - u)) & full
        row = (row & ~(full << left)) | (v << left)
    bits = len(a) - row.bit_count()
    return same + bits


def similarity(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """Aligned share of two k-mer sequences, c / (a + b - c); 0 where the lengths alone keep it under the threshold."""
    x, y = len(a), len(b)
    if not x or not y:
        return float(x == y)
    if min(x, y) < threshold * max(x, y):
        return 0.0
    both = len(np.intersect1d(labelled(a), labelled(b)))  # no order of them can match more
    if both < threshold * (x + y - both):
        return 0.0
    # At the threshold at least 2t/(1+t) of all k-mers are matched, so at most the rest shifts the diagonal.
    band = int((x + y) * (1 - threshold) / (1 + threshold)) + 1
    c = common_length(a.tolist(), b.tolist(), band)
    return c / (x + y - c)


def only_among(rows: DataFrame, column: str, few: DataFrame, n: int) -> DataFrame:
    """The rows whose ``column`` is in ``few`` (``n`` rows, a column of that name); most others don't reach the exchange."""
    maybe = maybe_among(few, column, n)
    kept = rows if maybe is None else rows.filter(maybe(F.array(column)))
    return kept.join(few, column, "left_semi")


def none_among(rows: DataFrame, column: str, few: DataFrame, n: int) -> DataFrame:
    """The rows whose ``column`` is not in ``few`` (``n`` rows); only those that may be take part in an exchange."""
    maybe = maybe_among(few, column, n)
    if maybe is None:
        return rows.join(few, column, "left_anti")
    seen = maybe(F.array(column))
    return rows.filter(~seen).unionByName(rows.filter(seen).join(few, column, "left_anti"))


def sketches(docs: DataFrame, row_col: str, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, samples: int = SAMPLES, ell: int = ELL) -> DataFrame:
    """``row, doc_id, same binary (of all words in order), n_kmers long, sample array<long>, cells array<long>``."""

    def make():
        shingles = Shingles(words)

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            same, count, sample, held = [], [], [], []
            for text in batch.column(2).to_pylist():
                tokens = shingles.tokens(text)
                marks = labelled(shingles.of(tokens))
                same.append(xxhash.xxh128_digest(tokens.tobytes()))
                count.append(len(marks))
                sample.append(order_minhash(marks, samples, ell).view(np.int64).tolist())
                held.append(cells(marks))
            columns = [batch.column(0), batch.column(1), pa.array(same, pa.binary()), pa.array(count, pa.int64()), pa.array(sample, pa.list_(pa.int64())), pa.array(held, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "same", "n_kmers", "sample", "cells"])

        return step

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(row_col).alias("row"), F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")), make, f"row long, doc_id {kind}, same binary, n_kmers long, sample array<long>, cells array<long>")


def _fits(a: str, b: str, threshold: float):
    """Lengths alone leave the threshold within reach."""
    return F.least(a, b) >= threshold * F.greatest(a, b)


def _agree(a, b, least: int = AGREE):
    """At least ``least`` equal samples (in their short form)."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) >= least


def _alike(x: dict, y: dict, threshold: float):
    """What two texts hold in each cell leaves the threshold within reach (always, where that isn't known): no pair that reaches it fails.

    All bytes of a long are compared at once: a high bit set in each byte of p outlasts the subtraction where p >= q.
    """
    high, even = F.lit(0x0080808080808080), F.lit(0x00FF00FF00FF00FF)
    not_less = lambda p, q: F.shiftrightunsigned((p.bitwiseOR(high) - q).bitwiseAND(high), 7) * 255
    lesser = F.zip_with(x["cells"], y["cells"], lambda p, q: p.bitwiseXOR(p.bitwiseXOR(q).bitwiseAND(not_less(p, q))))
    lanes = F.aggregate(lesser, F.lit(0).cast("long"), lambda total, m: total + m.bitwiseAND(even) + F.shiftrightunsigned(m, 8).bitwiseAND(even))  # four sums of 16 bits
    common = F.aggregate(F.array(lanes), F.lit(0).cast("long"), lambda total, v: total + sum((F.shiftrightunsigned(v, k).bitwiseAND(F.lit(65535)) for k in (16, 32, 48)), v.bitwiseAND(F.lit(65535))))
    return F.coalesce(common * (1 + threshold) >= threshold * (x["n"] + y["n"]) - 1e-6, F.lit(True))


def _buckets(first: int, stop: int):
    """The buckets of a text by its samples from ``first`` to before ``stop``."""
    return F.expr(f"transform(sequence({first}, {stop - 1}), j -> xxhash64(j, sample[j]))")


def ruled_in(pairs: DataFrame, texts: DataFrame, n: int, least: int, threshold: float) -> DataFrame:
    """The pairs (``a, b``, written, ``n`` rows) whose lengths fit, that share ``least`` samples, and whose cells leave the threshold within reach."""
    names = {"n_kmers": "n", "sig": "sig", "cells": "cells"}
    ends = materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "ends", 2 * n)
    # Few next to the texts, most of which a filter keeps out of the exchange.
    few = only_among(texts, "node", ends, ends.count()).select("node", *names)
    side = lambda end: few.select(F.col("node").alias(end), *[F.col(c).alias(f"{name}_{end}") for c, name in names.items()])
    a, b = ({name: F.col(f"{name}_{end}") for name in names.values()} for end in "ab")
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(_fits("n_a", "n_b", threshold) & _agree(a["sig"], b["sig"], least) & _alike(a, b, threshold)).select(*pairs.columns)


def candidates(texts: DataFrame, rows: DataFrame, ends: DataFrame, n: int, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs a < b of texts of different classes that :func:`ruled_in` leaves: each of ``rows`` (``bucket, root, node``) against the smallest
    and the largest class of its bucket in ``ends`` (a written table, so that a hot bucket's join can be split)."""
    met = rows.join(ends, "bucket").select("root", "node", F.explode(F.array("low", "high")).alias("end")).filter(F.col("root") != F.col("end.root"))
    pairs = materialize(met.select(F.least("node", "end.node").alias("a"), F.greatest("node", "end.node").alias("b")).distinct(), "met", 2 * n)
    return ruled_in(pairs, texts, pairs.count(), AGREE, threshold)


def _mixed(rows: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(mixed, ends), written, of ``rows`` that name each class of a bucket once: those of buckets of several classes, and the smallest
    and the largest class of each, with a text of each.

    Most buckets hold one class, so no more than their counts go through an exchange.
    """
    several = materialize(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("classes")).filter("classes > 1").select("bucket"), "buckets", n)
    mixed = materialize(only_among(rows, "bucket", several, several.count()), "mixed-rows", n)
    end = F.struct("root", "node")
    ends = materialize(mixed.groupBy("bucket").agg(F.min(end).alias("low"), F.max(end).alias("high")), "ends", n)
    forget(several)
    return mixed, ends


def first_candidates(texts: DataFrame, n: int, first: int = FIRST, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs of texts that meet in the buckets of the ``first`` samples, where each text is a class of its own."""
    rows = texts.select(F.col("node").alias("root"), "node", F.explode(_buckets(0, first)).alias("bucket"))
    return candidates(texts, *_mixed(rows, n * first), n * first, threshold)


def with_roots(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` with ``root``, the class of their ``node``. Texts without a link are their own; most of them stay out of the exchange."""
    maybe = maybe_among(roots.select("node"), "node", roots.count())
    joined = lambda part: part.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    if maybe is None:
        return joined(rows)
    linked = maybe(F.array("node"))
    return rows.filter(~linked).withColumn("root", F.col("node")).unionByName(joined(rows.filter(linked)))


def class_rows(texts: DataFrame, roots: DataFrame, n: int, samples: int) -> tuple[DataFrame, DataFrame]:
    """(rows, ends): one text (``bucket, root, node``) of each class in each bucket of several classes, and the buckets' ends."""
    rooted = with_roots(texts.select("node", "sample"), roots).select("root", "node", F.explode(_buckets(0, samples)).alias("bucket"))
    # A class of very many texts is reduced to one row a bucket before the exchange.
    rows = materialize(rooted.groupBy("bucket", "root").agg(F.min("node").alias("node")), "class-rows", n * samples)
    mixed, ends = _mixed(rows, n * samples)
    forget(rows)
    return mixed, ends


def rerooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` whose ``root`` is that of earlier classes, with the ``root`` they have in ``roots``."""
    now = roots.select(F.col("node").alias("root"), F.col("root").alias("now"))
    return rows.join(now, "root", "left").withColumn("root", F.coalesce("now", "root")).drop("now")


def left_rows(texts: DataFrame, mixed: DataFrame, roots: DataFrame, samples: int, n: int) -> DataFrame | None:
    """All texts (``bucket, root, node, n_kmers``, written) of the buckets that hold several classes; None where there is no such bucket.

    ``mixed`` has the earlier classes of the buckets that held several, ``roots`` the classes since.
    """
    count = mixed.count()
    rows = rerooted(mixed.select("bucket", "root"), roots)
    buckets = materialize(rows.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("bucket"), "mixed", count)
    several = buckets.count()
    if not several:
        return None
    those = maybe_among(buckets, "bucket", several, each=True)
    own = texts.select("node", "n_kmers", _buckets(0, samples).alias("buckets"))
    if those is not None:  # one look at each text: two in a row would run in two workers at once
        own = own.withColumn("buckets", those(F.col("buckets")))
    # Outer, as Spark would else look a second time, for empty arrays; the join drops their nulls.
    own = own.select("node", "n_kmers", F.explode_outer("buckets").alias("bucket"))
    own = materialize(own.join(buckets, "bucket", "left_semi"), "left-texts", n * samples)
    rows = materialize(with_roots(own, roots).select("bucket", "root", "node", "n_kmers"), "left-rows", n * samples)
    forget(buckets, own)
    return rows


def tops(rows: DataFrame, turn: int, n: int) -> DataFrame:
    """``bucket, top, node, total`` of the buckets of ``rows`` that hold several classes, written: the largest class, a text of it
    (drawn anew each ``turn``) and the count of texts."""
    draw = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("draw"), "node")).alias("drawn")
    classes = rows.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("held"), draw)
    largest = F.max(F.struct("held", "root", "drawn.node")).alias("top")
    found = classes.groupBy("bucket").agg(largest, F.sum("held").alias("total"), F.count(F.lit(1)).alias("classes")).filter("classes > 1")
    return materialize(found.select("bucket", F.col("top.root").alias("top"), F.col("top.node").alias("node"), "total"), "tops", n)


def turns(rows: DataFrame, sketched: DataFrame, keyed: DataFrame, key: str, roots: DataFrame, tested: DataFrame, threshold: float, words: int) -> tuple[DataFrame, DataFrame]:
    """(roots, tested) after each text of ``rows`` has met, a few times, a text of the largest class of its bucket."""
    n = rows.count()
    for turn in range(TURNS):
        now = materialize(rerooted(rows, roots), "turn-rows", n)
        largest = tops(now, turn, n)
        met = now.withColumnRenamed("node", "x").join(largest, "bucket").filter(F.col("root") != F.col("top"))
        pairs = met.select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct()
        pairs = materialize(pairs.join(tested, ["a", "b"], "left_anti"), "met", n)
        new = materialize(ruled_in(pairs, sketched, pairs.count(), 1, threshold), "pairs", n)
        links = _verified(keyed, key, new, threshold, words)
        forget(now, largest, pairs)
        tested = tested.unionByName(new)
        if links.isEmpty():
            break
        roots = merged(roots, links)
    return roots, tested


def kmer_counts(texts: DataFrame, words: int = WORDS) -> np.ndarray:
    """How many of ``texts`` hold a labelled k-mer of each of ``SLOTS`` slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, total = Shingles(words), np.zeros(SLOTS, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                np.add.at(total, (labelled(shingles.of(shingles.tokens(text))) % np.uint64(SLOTS)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        for lo in range(0, len(at), CHUNK):
            yield pa.RecordBatch.from_arrays([pa.array(at[lo : lo + CHUNK]), pa.array(total[at[lo : lo + CHUNK]])], ["slot", "n"])
        del shingles, total, at
        release()

    with small_batches(texts.sparkSession):
        found = texts.select("text").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # bounded by SLOTS
    counts = np.zeros(SLOTS, np.int64)
    counts[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    return counts


def left_candidates(texts: DataFrame, sketched: DataFrame, threshold: float = THRESHOLD, words: int = WORDS) -> DataFrame:
    """All pairs a < b of different classes whose k-mer counts leave the threshold within reach and that share a sample:
    ``a, b, ra, rb``. ``texts`` has ``node, root, text``, ``sketched`` what is known of all texts (``node, n_kmers, sig, cells``).

    A prefix join: with every text's k-mers in one order, rarest first, a pair that reaches the threshold has its first common
    k-mer so early in both that enough are left after it. A k-mer that very many texts share comes last, so it
    brings together only those that have hardly anything else. For each k-mer, texts outside its largest class meet all
    texts, and the texts of that class never meet each other. Where a k-mer would still make many pairs, what its texts hold in
    their cells rules pairs out in the join itself, and afterwards everywhere.
    """
    rarity = texts.sparkSession.sparkContext.broadcast(kmer_counts(texts, words))

    def make():
        shingles = Shingles(words)

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            sizes, kmers, places, picked = [], [], [], []

            def flush() -> pa.RecordBatch:
                of = pa.array(np.repeat(picked, [len(x) for x in kmers]))
                columns = [batch.column(0).take(of), batch.column(1).take(of), pa.array(np.repeat(sizes, [len(x) for x in kmers])), pa.array(np.concatenate(kmers)), pa.array(np.concatenate(places))]
                for held in (sizes, kmers, places, picked):
                    held.clear()
                return pa.RecordBatch.from_arrays(columns, ["node", "root", "n", "kmer", "place"])

            for i in range(batch.num_rows):
                marks = labelled(shingles.of(shingles.tokens(batch.column(2)[i].as_py())))
                n, count = len(marks), rarity.value[(marks % np.uint64(SLOTS)).astype(np.int64)]
                order = np.lexsort((marks, count))[: n - int(np.ceil(threshold * n - 1e-6)) + 1]
                at = np.flatnonzero(count[order] > 1)  # the others stand in this text only
                sizes.append(n)
                picked.append(i)
                kmers.append(marks[order[at]].view(np.int64))
                places.append(at)
                if sum(map(len, kmers[-1000:])) > 50_000:
                    yield flush()
            if picked:
                yield flush()

        return step

    prefixes = map_batches(texts.select("node", "root", "text"), make, "node long, root long, n long, kmer long, place long")
    prefixes = materialize(prefixes, "prefixes", texts=True)
    by_class = prefixes.groupBy("kmer", "root").agg(F.count(F.lit(1)).alias("held"))
    shared = by_class.groupBy("kmer").agg(F.max(F.struct("held", "root")).alias("top"), F.sum("held").alias("total"), F.count(F.lit(1)).alias("classes")).filter("classes > 1")
    heavy = F.col("total") * (F.col("total") - F.col("top.held")) > HEAVY
    shared = materialize(shared.select("kmer", F.col("top.root").alias("top"), heavy.alias("heavy")), "shared-kmers")
    met = materialize(prefixes.join(shared, "kmer"), "met-prefixes")
    known = only_among(sketched.select("node", "sig", "cells"), "node", texts.select("node"), texts.count())
    unknown = [F.lit(None).cast(sketched.schema[c].dataType).alias(c) for c in ("sig", "cells")]
    rows = met.filter("not heavy").select("*", *unknown).unionByName(met.filter("heavy").join(known, "node"))
    rows = materialize(rows, "shared-prefixes")  # a plain table, so that a hot k-mer's join can be split
    forget(prefixes, shared, met)
    names = ("node", "root", "n", "place", "sig", "cells")
    sides = {end: rows.select(F.col("kmer").alias(f"kmer_{end}"), "top" if end == "x" else F.lit(0).alias("none"), *[F.col(c).alias(f"{c}_{end}") for c in names]) for end in "xy"}
    x, y = ({c: F.col(f"{c}_{end}") for c in names} for end in "xy")
    reach = F.least(x["n"] - x["place"], y["n"] - y["place"]) * (1 + threshold) >= threshold * (x["n"] + y["n"]) - 1e-6
    # Two texts outside the largest class would meet twice but for the order of their names.
    once = (y["root"] == F.col("top")) | (x["node"] < y["node"])
    others = sides["x"].filter("root_x != top")
    agree = x["sig"].isNull() | _agree(x["sig"], y["sig"], 1)
    met = others.join(sides["y"], (F.col("kmer_x") == F.col("kmer_y")) & (x["root"] != y["root"]) & once & reach & agree & _alike(x, y, threshold))
    first = x["node"] < y["node"]
    pick = lambda c: [F.when(first, x[c]).otherwise(y[c]), F.when(first, y[c]).otherwise(x[c])]
    (a, b), (ra, rb) = pick("node"), pick("root")
    pairs = materialize(met.select(a.alias("a"), b.alias("b"), ra.alias("ra"), rb.alias("rb")).distinct(), "left-pairs")
    forget(rows)
    left = materialize(ruled_in(pairs, sketched, pairs.count(), 1, threshold), "ruled-in")
    forget(pairs)
    return left


def few_candidates(rows: DataFrame, sketched: DataFrame, n: int, threshold: float = THRESHOLD) -> DataFrame:
    """The same as :func:`left_candidates` for texts (``bucket, root, node, n_kmers``) of buckets of at most ``FEW``, taken as they are."""
    side = lambda end: rows.select("bucket", *[F.col(c).alias(f"{c}_{end}") for c in ("node", "root", "n_kmers")])
    both = side("a").join(side("b"), "bucket").filter(F.expr("node_a < node_b and root_a != root_b") & _fits("n_kmers_a", "n_kmers_b", threshold))
    pairs = materialize(both.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), F.col("root_a").alias("ra"), F.col("root_b").alias("rb")).distinct(), "few-pairs", FEW * n)
    left = materialize(ruled_in(pairs, sketched, pairs.count(), 1, threshold), "ruled-in", FEW * n)
    forget(pairs)
    return left


def left_links(rows: DataFrame, sketched: DataFrame, keyed: DataFrame, key: str, roots: DataFrame, tested: DataFrame, threshold: float, words: int) -> DataFrame:
    """The classes (``node, root``) after all pairs of different classes in one bucket of ``rows`` that may reach the threshold have been
    tested, unless their texts are in one class by then."""
    n = rows.count()
    now = materialize(rerooted(rows, roots), "now-rows", n)
    buckets = tops(now, TURNS, n)
    pairs = few_candidates(now.join(buckets.filter(F.col("total") <= FEW).select("bucket"), "bucket", "left_semi"), sketched, n, threshold)
    nodes = materialize(now.join(buckets.filter(F.col("total") > FEW).select("bucket"), "bucket", "left_semi").select("node", "root").distinct(), "mixed-nodes", n)
    if not nodes.isEmpty():
        needed = keyed.select(F.col(key).alias("node"), text_of("text").alias("text"))
        needed = materialize(only_among(needed, "node", nodes.select("node"), nodes.count()).join(nodes, "node"), "left-texts")
        pairs = pairs.unionByName(left_candidates(needed, sketched, threshold, words)).distinct()
        forget(needed)
    left = materialize(pairs.join(tested, ["a", "b"], "left_anti"), "left-pairs")
    forget(now, buckets, nodes)
    # One pair of each two classes goes first, which saves most of the others where classes are large.
    likely = F.min(F.struct(F.xxhash64("a", "b").alias("draw"), "a", "b")).alias("p")
    one = materialize(left.groupBy(F.least("ra", "rb").alias("r1"), F.greatest("ra", "rb").alias("r2")).agg(likely).select("p.a", "p.b"), "one-pairs", left.count())
    for rest in (False, True):
        pairs = one
        if rest:
            root_of = lambda c, name: roots.select(F.col("node").alias(c), F.col("root").alias(name))
            pairs = left.select("a", "b").join(one, ["a", "b"], "left_anti").join(root_of("a", "ra"), "a", "left").join(root_of("b", "rb"), "b", "left")
            pairs = materialize(pairs.filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b"), "rest-pairs", left.count())
        if pairs.isEmpty():
            continue
        roots = merged(roots, _verified(keyed, key, pairs, threshold, words))
    forget(left, one)
    return roots


def verify(pairs: DataFrame, texts: DataFrame, threshold: float = THRESHOLD, words: int = WORDS) -> DataFrame:
    """The pairs (``a``, ``b``) whose texts align; ``texts`` has ``node, text``. Adds ``similarity``."""
    first = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    second = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    both = pairs.join(first, "b").join(second, "a").select("a", "b", "text_a", "text_b")

    def make():
        shingles = Shingles(words)
        held: list = [None, None]

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = []
            ids, texts_a, texts_b = batch.column(0).to_pylist(), batch.column(2), batch.column(3)
            for k, a in enumerate(ids):
                if held[0] != a:
                    held[:] = [a, shingles.of(shingles.tokens(texts_a[k].as_py()))]
                found.append(similarity(held[1], shingles.of(shingles.tokens(texts_b[k].as_py())), threshold))
            scores = pa.array(found, pa.float64())
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), scores], ["a", "b", "similarity"]).filter(pa.array([s >= threshold for s in found], pa.bool_()))

        return step

    return map_batches(both, make, "a long, b long, similarity double")


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (``a`` != ``b``): ``node, root``, where the root is the smallest node.

    Alternating large-star and small-star steps until only stars are left. Each step reduces before its exchange and writes
    what it has reduced, so that the join at the centre of a large star can be split.
    """
    n = links.count()
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges", n)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low", 2 * n)
        large = materialize(both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large", 2 * n)
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least", 2 * n)
        small = large.join(least, "u")
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u != v").distinct()
        edges, old = materialize(small, "edges", 2 * n), edges
        forget(old, low, large, least)
        # Done when every node has one root and no root has one of its own.
        marks = edges.select(F.col("u").alias("x"), F.lit(1).alias("is_u"), F.lit(0).alias("is_v")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("is_u"), F.lit(1).alias("is_v")))
        if marks.groupBy("x").agg(F.sum("is_u").alias("us"), F.max("is_v").alias("as_v")).filter("us > 1 or (us > 0 and as_v > 0)").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The classes (``node, root``) of ``roots`` after new links."""
    if links.isEmpty():
        return roots
    return components(links.select("a", "b").unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))


def _verified(keyed: DataFrame, key: str, pairs: DataFrame, threshold: float, words: int) -> DataFrame:
    """The links among ``pairs``, written."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias(key)).distinct()
    ends = materialize(ends, "ends", 2 * pairs.count())
    needed = only_among(keyed.select(key, text_of("text").alias("text")), key, ends, ends.count())
    texts = materialize(needed.withColumnRenamed(key, "node"), "texts")
    links = materialize(verify(pairs, texts, threshold, words), "links", texts=True)
    forget(ends, texts)
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, words: int = WORDS, samples: int = SAMPLES, ell: int = ELL, row_col: str | None = None) -> DataFrame:
    """One row per input row: ``doc_id, class_id, group_size, kept``, after the row key, if given.

    ``class_id`` is the smallest doc_id of the class, whose first row stays (``kept``); ``group_size`` counts the rows of the
    class. Texts are read again by their row key, so without ``row_col`` they are first written with one; a ``row_col`` of
    your own has to be stored, not computed.
    """
    key = row_col or ROW
    source = docs if row_col else keyed_table(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    keyed = source.select(F.col(key).cast("long").alias(key), F.col(id_col if row_col else "doc_id").alias("doc_id"), F.col(text_col if row_col else "text").alias("text"))
    rows = materialize(sketches(keyed, key, "doc_id", "text", words, samples, ell), "sketches", texts=True)
    # Texts with the same words are one node, named by their smallest row.
    n = rows.count()
    nodes = materialize(rows.groupBy("same").agg(F.min("row").alias("node")), "same", n)
    of_row = materialize(rows.select("row", "doc_id", "same").join(nodes, "same").select("row", "doc_id", "node"), "nodes")
    short = F.transform("sample", lambda x: (x % 128).cast("tinyint")).alias("sig")
    wanted = rows.filter("n_kmers > 0").select(F.col("row").alias("node"), "n_kmers", "sample", short, "cells")
    copies = materialize(of_row.filter("row != node").select(F.col("row").alias("node")), "copies", n)
    texts = materialize(none_among(wanted, "node", copies, copies.count()), "distinct")
    # Step 1: classes of the large groups.
    tested = materialize(first_candidates(texts, n, min(FIRST, samples), threshold), "pairs", 2 * FIRST * n)
    roots = components(_verified(keyed, key, tested, threshold, words))
    # Step 2: one text of each class in each bucket.
    mixed, ends = class_rows(texts, roots, n, samples)
    more = candidates(texts, mixed, ends, n * samples, threshold).join(tested, ["a", "b"], "left_anti")
    more = materialize(more, "pairs", 2 * samples * n)
    roots = merged(roots, _verified(keyed, key, more, threshold, words))
    left = left_rows(texts, mixed, roots, samples, n)
    if left is not None:
        # Step 3: texts outside the largest class of a bucket.
        roots, done = turns(left, texts, keyed, key, roots, tested.unionByName(more), threshold, words)
        # Step 4: all that is left in buckets of several classes.
        roots = left_links(left, texts, keyed, key, roots, done, threshold, words)
    whole = materialize(of_row.join(roots, "node", "left").select("row", "doc_id", F.coalesce("root", "node").alias("root")), "classes", n)
    best = F.struct(F.col("doc_id").isNotNull().alias("x"), F.col("doc_id").alias("doc_id"), F.col("row").alias("row"))
    classes = whole.groupBy("root").agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")
    classes = materialize(classes, "groups", n)
    forget(rows, nodes, of_row, copies, texts, mixed, ends, tested, more, *([left] if left is not None else []), *([] if row_col else [source]))
    joined = whole.join(classes, "root", "left")
    alone = F.col("best").isNull()
    return joined.select(
        *([F.col("row").alias(row_col)] if row_col else []), "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("class_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (alone | (F.col("best.row") == F.col("row"))).alias("kept"),
    )
