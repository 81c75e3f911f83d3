import random
import re
from collections import defaultdict
from itertools import combinations

import numpy as np
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm import cases
from vastgrain.llm import neardup as N


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@given(st.lists(st.integers(0, 6), max_size=40), st.lists(st.integers(0, 6), max_size=40))
def test_common_length_is_exact_with_a_wide_band(a, b):
    assert N.common_length(a, b, 100) == lcs(a, b)


def test_band_over_several_steps(monkeypatch):
    monkeypatch.setattr(N, "STEP", 7)
    rnd = random.Random(4)
    for _ in range(60):
        a = [rnd.randint(0, 30) for _ in range(120)]
        b = [x for x in a if rnd.random() > 0.08]
        for _ in range(5):
            b.insert(rnd.randrange(len(b)), 99)
        c = lcs(a, b)
        want = c / (len(a) + len(b) - c)
        got = N.similarity(np.array(a, np.uint64), np.array(b, np.uint64))
        assert got == want if want >= 0.8 else got < 0.8


def corpus(seed=2):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(40):
        base = [rnd.choice(words) for _ in range(rnd.randint(30, 300))]
        for _ in range(rnd.randint(1, 6)):
            t = list(base)
            for _ in range(rnd.randint(0, 4)):
                t[rnd.randrange(len(t))] = rnd.choice(words)
            texts.append(" ".join(t))
    passage = " ".join(rnd.choice(words) for _ in range(60))
    texts += [passage + " " + " ".join(rnd.choice(words) for _ in range(25)) for _ in range(40)]
    return list(enumerate(texts))


def classes_of(pairs):
    shingles = N.Shingles()
    kmers = {i: shingles.of(shingles.tokens(t)) for i, t in pairs}
    root = {i: i for i, _ in pairs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(root, 2):
        if N.similarity(kmers[i], kmers[j]) >= 0.8:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {i: find(i) for i in root}


def test_classes_against_brute_force(spark, tmp_path):
    pairs = corpus()
    rows = N.near_duplicates(cases.simple(spark, tmp_path, pairs)).collect()
    assert {r.doc_id: r.class_id for r in rows} == classes_of(pairs)
    by = defaultdict(list)
    for r in rows:
        by[r.class_id].append(r)
    assert all([r.doc_id for r in rs if r.kept] == [c] and {r.group_size for r in rs} == {len(rs)} for c, rs in by.items())


def test_words_are_hashed_alike_wherever_they_stand(monkeypatch):
    rnd, seen, word = random.Random(1), {}, re.compile(r"\w+")
    for span in (1 << 20, 5, 1):
        monkeypatch.setattr(N, "SPAN", span)
        for _ in range(500):
            text = "".join(rnd.choice("abcABZ019_ .,-éÉß中İſ😀\n\t'ǅ٣½²") for _ in range(rnd.randint(0, 40)))
            words, hashes = word.findall(text.lower()), N.Shingles().tokens(text).tolist()
            assert len(words) == len(hashes) and all(seen.setdefault(w, h) == h for w, h in zip(words, hashes, strict=True))
    assert len(set(seen.values())) == len(seen)


def test_samples_in_chunks(monkeypatch):
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 4, 17, 500):
        marks = rng.integers(0, 2**63, n).astype(np.uint64)
        whole = N.order_minhash(marks)
        for chunk in (2, 3, 7):
            monkeypatch.setattr(N, "CHUNK", chunk)
            assert (N.order_minhash(marks) == whole).all()


def test_cells_bound_what_texts_share(spark):
    """The bound is the sum of lesser counts, so it is never under what two texts share; unknown cells rule nothing out."""
    rng = np.random.default_rng(2)
    rows, want = [], []
    for _ in range(60):
        a = rng.integers(0, 2**64, rng.integers(1, 400), dtype=np.uint64)
        b = np.concatenate([a[: rng.integers(0, len(a) + 1)], rng.integers(0, 2**64, rng.integers(0, 60), dtype=np.uint64)])
        count = lambda x: np.bincount(((x >> np.uint64(32)) * np.uint64(N.CELLS) >> np.uint64(32)).astype(int), minlength=N.CELLS)
        bound = int(np.minimum(count(a), count(b)).sum())
        assert bound >= len(np.intersect1d(a, b))
        rows.append((N.cells(a), N.cells(b), len(a), len(b)))
        want.append(bound * 1.8 >= 0.8 * (len(a) + len(b)) - 1e-6)
    rows.append((None, N.cells(a), 1, 1000))
    df = spark.createDataFrame(rows, "p array<long>, q array<long>, n long, m long").coalesce(1)
    got = [r[0] for r in df.select(N._alike({"cells": F.col("p"), "n": F.col("n")}, {"cells": F.col("q"), "n": F.col("m")}, 0.8)).collect()]
    assert got == [*want, True] and 0 < sum(want) < 60 and N.cells(np.zeros(128, np.uint64)) is None


def test_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 200), (200, 300), (150, 300)]
    got = {r.node: r.root for r in N.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 31)}, 150: 100, 200: 100, 300: 100}


def test_awkward_rows(spark, tmp_path):
    rows = N.near_duplicates(cases.table(spark, tmp_path)).collect()
    assert len(rows) == len(cases.rows())
    by = defaultdict(set)
    for r in rows:
        by[r.class_id].add(r.doc_id)
    assert by[1] == {1, 2} and by[3] == {3, 4, 5} and by[7] == {7, 8} and by[6] == {6}
    assert N.near_duplicates(cases.empty(spark, tmp_path)).count() == 0


def test_pairs_hidden_in_crowded_buckets(spark, tmp_path):
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(5000)]
    passage = " ".join(rnd.choice(words) for _ in range(45))
    texts = []
    for _ in range(60):
        own = [rnd.choice(words) for _ in range(18)]
        texts += [passage + " " + " ".join(own), passage + " " + " ".join([*own[:-1], rnd.choice(words)])]
    rnd.shuffle(texts)
    pairs = list(enumerate(texts))
    got = {r.doc_id: r.class_id for r in N.near_duplicates(cases.simple(spark, tmp_path, pairs)).collect()}
    assert got == classes_of(pairs)


def test_pairs_in_the_middle_of_a_bucket_without_other_links(spark, tmp_path):
    rnd = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(91))
    own = lambda i, n: [f"o{i}x{j}" for j in range(n)]
    texts = [passage + " " + " ".join(own(i, 13)) for i in range(900)]
    twins = [[passage + " " + " ".join(own(f"t{i}", 3) + own(f"t{i}e{e}", 10)) for e in range(2)] for i in range(30)]
    texts += [t for pair in twins for t in pair]
    rnd.shuffle(texts)
    at = {t: i for i, t in enumerate(texts)}
    want = {i: i for i in range(len(texts))} | {max(at[a], at[b]): min(at[a], at[b]) for a, b in twins}
    got = {r.doc_id: r.class_id for r in N.near_duplicates(cases.simple(spark, tmp_path, list(enumerate(texts)))).collect()}
    assert got == want


def test_pairs_with_two_equal_samples(spark, tmp_path):
    """4 against 5 k-mers, similarity 0.8; these pairs agree in two samples only."""
    pairs = [(2 * i + e, " ".join(f"s{i}x{j}" for j in range(8 + e))) for i in (4807, 5614, 13879, 17726, 18624, 19033) for e in range(2)]
    got = {r.doc_id: r.class_id for r in N.near_duplicates(cases.simple(spark, tmp_path, pairs)).collect()}
    assert got == {i: i - i % 2 for i, _ in pairs}


def crowd(n=500, seed=5):
    """Near copies of one text, each with a few words of its own, so that many miss the class they belong to in the first steps."""
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(3000)}" for _ in range(110)]
    texts = []
    for i in range(n):
        t = list(base)
        for _ in range(rnd.choice([1, 1, 1, 2, 2])):
            t[rnd.randrange(len(t))] = f"x{rnd.randrange(10**6)}"
        texts.append(" ".join(t))
    return list(enumerate(texts))


def test_small_buckets_are_paired_without_the_join_of_kmers(spark, tmp_path, monkeypatch):
    def never(*_):
        raise AssertionError("texts went through the join of k-mers")

    monkeypatch.setattr(N, "left_candidates", never)
    pairs = corpus(7)[:120]
    got = {r.doc_id: r.class_id for r in N.near_duplicates(cases.simple(spark, tmp_path, pairs)).collect()}
    assert got == classes_of(pairs)


def test_every_way_through_the_last_steps(spark, tmp_path, monkeypatch):
    pairs = crowd(120) + [(i + 1000, t) for i, t in corpus(7)[:40]]
    want = classes_of(pairs)
    for few, turns in ((0, 0), (8, 2), (10**6, 0)):
        monkeypatch.setattr(N, "FEW", few)
        monkeypatch.setattr(N, "TURNS", turns)
        assert {r.doc_id: r.class_id for r in N.near_duplicates(cases.simple(spark, tmp_path, pairs)).collect()} == want
