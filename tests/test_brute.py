"""Queries that SQL can't express, against plain loops."""

import math
import random
from collections import Counter, defaultdict

from vastgrain.catalogue import QUERIES
from vastgrain.operators import similarity as Y
from vastgrain.streaming.leases import Device, Policy, replay

FOLDER = "/root/testdata/sf0.001"


def plain_offsets(text, patterns):
    """Leftmost first, the longest at a place, no overlap, either strand."""
    comp = str.maketrans("ATUGCRYKMN", "TAACGYRMKN")
    wanted = {}
    for p in patterns:
        wanted.setdefault(p.upper(), (p, "+"))
        wanted.setdefault(p.upper()[::-1].translate(comp), (p, "-"))
    text, at, out = text.upper(), 0, []
    while at < len(text):
        fits = [w for w in wanted if text.startswith(w, at)]
        if fits:
            best = max(fits, key=len)
            out.append((*wanted[best], at))
            at += len(best)
        else:
            at += 1
    return out


def test_pattern_offsets(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    want = {(d.doc_id, *hit) for d in docs for hit in plain_offsets(d.text or "", ["that", "there", "gattaca"])}
    got = {tuple(r) for r in QUERIES["pattern_offsets"](spark, FOLDER).select("id", "pattern", "strand", "start").collect()}
    assert got == want and len(want) > 100


def test_similar_tiles(spark):
    from vastgrain.operators.windows import overlap_share

    rnd = random.Random(3)
    points = [(rnd.randrange(400), rnd.randrange(400), f"g{rnd.randrange(6)}", rnd.randint(1, 5)) for _ in range(3000)]
    tile, stride = 80, 40
    sums = defaultdict(Counter)
    for x, y, g, n in points:
        for tx in range(400 // stride):
            for ty in range(400 // stride):
                if tx * stride <= x < tx * stride + tile and ty * stride <= y < ty * stride + tile:
                    sums[tx, ty][g] += n
    vectors = {t: {g: math.log1p(n * 1e4 / sum(c.values())) for g, n in c.items()} for t, c in sums.items()}
    norm = {t: math.sqrt(sum(v * v for v in c.values())) for t, c in vectors.items()}
    query = vectors[2, 3]
    score = {t: sum(v * query.get(g, 0) for g, v in c.items()) / norm[t] / norm[2, 3] for t, c in vectors.items()}
    box = lambda t: (t[0] * stride, t[0] * stride + tile, t[1] * stride, t[1] * stride + tile)
    for k in (3, 12, 60):  # more than there are apart
        kept = []
        for t in sorted(score, key=lambda t: (-round(score[t], 9), t)):
            if len(kept) < k and all(overlap_share(box(t), box(o)) <= 0.2 for o in [(2, 3), *kept]):
                kept.append(t)
        df = spark.createDataFrame(points, "x int, y int, gene string, count int")
        got = [(r.tx, r.ty) for r in Y.similar_tiles(Y.tile_profiles(df, tile, stride), 2, 3, tile, stride, k).orderBy("rank").collect()]
        assert got == kept


def test_reservations(spark):
    rnd = random.Random(5)
    events = [(d, float(rnd.randint(0, 500)), line, rnd.choice(["reserve", "reserve", "touch", "renew", "release"]), f"h{rnd.randrange(8)}", rnd.randint(1, 60)) for line, d in enumerate(rnd.choices("abc", k=600))]
    policy, want = Policy(ttl=60, idle=20, max_share=0.5), []
    for name in "abc":
        device = Device(100, policy)
        for _, t, _, op, holder, amount in sorted((e for e in events if e[0] == name), key=lambda e: (e[1], e[2])):
            want += [(name, t, *x) for x in device.step(t, op, holder, amount)]
            assert 0 <= device.free <= 100
    df = spark.createDataFrame(events, "device string, t double, line long, op string, holder string, amount long")
    assert sorted(tuple(r) for r in replay(df, 100, policy).collect()) == sorted(want) and len(want) > 200
