import hashlib
import random

import numpy as np

from tests.llm import cases
from vastgrain.llm import fingerprints as P


def test_anchors_are_closed_syncmers():
    rnd = random.Random(1)
    text = "".join(rnd.choice("abcdé ") for _ in range(400))
    at, _ = P.anchors(text, 12, 4)
    points = np.array([ord(c) for c in text], np.uint64) + np.uint64(1)
    inner = P._gram(points, 4)
    want = [i for i in range(len(text) - 11) if min(inner[i : i + 9]) in (inner[i], inner[i + 8])]
    assert at.tolist() == want


def test_spans_don_t_matter(monkeypatch):
    text = "the quick brown fox " * 60 + "jumps"
    whole = P.anchors(text)
    monkeypatch.setattr(P, "SPAN", 50)
    parts = P.anchors(text)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def mixed(x):
    m = (1 << 64) - 1
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & m
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & m
    return x ^ (x >> 31)


def gram(text, at, n):
    total = 0
    for c in text[at : at + n]:
        total = (total * 0x9E3779B97F4A7C15 + ord(c) + 1) & ((1 << 64) - 1)
    return mixed(total)


def plain_sketch(text, k=16, s=5, keep=128):
    """By the definition, one k-mer after another."""
    found = []
    for i in range(len(text) - k + 1):
        inner = [gram(text, i + j, s) for j in range(k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            found.append(gram(text, i, k) >> 32)
    if text and not found:
        found = [int.from_bytes(hashlib.blake2b(text.encode(), digest_size=4).digest(), "little")]
    distinct = sorted(set(found))
    held = set(distinct[: max(keep, sum(h < 2**28 for h in distinct))])
    return [h for h in dict.fromkeys(found) if h in held]


def plain_likeness(a, b, keep=128):
    if not a or not b:
        return float(a == b)
    reach = min(max(x) if len(x) >= keep else 1 << 32 for x in (a, b))
    a, b = [h for h in a if h <= reach], [h for h in b if h <= reach]
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1] / (len(a) + len(b) - row[-1])


def test_likeness():
    a, b = P.sketch(cases.PROSE), P.sketch(cases.PROSE.replace("mill", "barn"))
    assert P.likeness(a, a) == 1 and 0.5 < P.likeness(a, b) < 1 and P.likeness(a, P.sketch("")) == 0 and P.likeness(P.sketch(""), P.sketch("")) == 1
    assert (P.from_text(P.to_text(a)) == a).all()


def words(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))


def test_sketches_grow_and_moved_blocks_count():
    rnd = random.Random(5)
    one, two = words(rnd, 4000), words(rnd, 4000)
    text, moved = one + " " + two, two + " " + one
    a, b = P.sketch(text), P.sketch(moved)
    assert len(a) > 300 and a.tolist() == plain_sketch(text) and len(P.sketch(one[:600])) < 128
    assert abs(P.likeness(a, b) - 1 / 3) < 0.06 and P.likeness(a, P.sketch(text[:-300])) > 0.98


def test_likeness_against_the_plain_form():
    rnd = random.Random(6)
    for n in (3, 40, 200, 600):
        text = words(rnd, n)
        parts = text.split(" ")
        rnd.shuffle(parts)
        for other in (text, " ".join(parts), text[: len(text) // 2] + words(rnd, n // 2 + 1), text[100:] + text[:100]):
            x, y = P.sketch(text), P.sketch(other)
            assert (x.tolist(), y.tolist()) == (plain_sketch(text), plain_sketch(other))
            assert P.likeness(x, y) == plain_likeness(x.tolist(), y.tolist())


def hexadecimal(hashes):
    return "".join(f"{h:08x}" for h in hashes)


def check(rows, got, key=lambda i: (i is not None, i or 0)):
    order = sorted(rows, key=lambda r: (*key(r[0]), r[1] or ""))
    want = []
    for k, (i, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        own, other, after = plain_sketch(text), plain_sketch(changed), plain_sketch(following)
        want.append((i, len(text), hashlib.sha256(changed.encode()).hexdigest(), hexadecimal(own), hexadecimal(other), plain_likeness(own, other), plain_likeness(own, after)))
    assert sorted(want, key=str) == sorted([tuple(r) for r in got], key=str)


def test_neighbours(spark, tmp_path):
    rows = [(r[0], r[1]) for r in cases.rows()]
    docs = cases.table(spark, tmp_path)
    for n in (2048, 3, 1):
        check(rows, P.compare_neighbours(docs, rows_per_range=n).collect())
    assert P.compare_neighbours(cases.empty(spark, tmp_path)).count() == 0
    one = cases.simple(spark, tmp_path, [(4, "only one")])
    check([(4, "only one")], P.compare_neighbours(one).collect())


def test_neighbours_across_parts_of_a_batch(spark, monkeypatch):
    """A batch is worked on in parts; each document still meets its next one, wherever a part ends."""
    from vastgrain.llm import common

    docs = spark.createDataFrame([(i, f"text number {i * i} of a few " * (1 + i % 5)) for i in range(23)], "doc_id long, text string").coalesce(1)
    whole = sorted(map(tuple, P.compare_neighbours(docs).collect()))
    monkeypatch.setattr(common, "TEXT_ROWS", 2)
    assert sorted(map(tuple, P.compare_neighbours(docs).collect())) == whole and len(whole) == 23
