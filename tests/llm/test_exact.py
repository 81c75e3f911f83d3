import hashlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tests.llm import cases
from vastgrain.llm import exact


def norm(text):
    return "".join(c for c in text or "" if c not in exact.BLANKS)


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append((-len(t or ""), i is None, i or 0, i))
    out = []
    for t, members in groups.items():
        members.sort()
        for k, m in enumerate(members):
            out.append((m[3], members[0][3], len(members), k == 0, hashlib.sha256(t.encode()).hexdigest()))
    return Counter(out)


def result(df):
    return Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect())


def test_awkward_rows(spark, tmp_path):
    docs = cases.table(spark, tmp_path)
    assert result(exact.exact_dedup(docs)) == brute([(r[0], r[1]) for r in cases.rows()])
    assert exact.exact_dedup(cases.empty(spark, tmp_path)).count() == 0


def test_many_levels_and_colliding_digests(spark, tmp_path):
    base = "abcdefghijklmnopqrstuvwxyzäöü" * 9
    pairs = [(i, base[: 1 + i % 60] + ("x" if i % 7 == 0 else "") + base[:200] + " " * (i % 3)) for i in range(240)]
    weak = (lambda b: F.substring(F.unhex(F.md5(b)), 1, 1), lambda b: F.substring(F.unhex(F.md5(b)), 1, 2), *exact.DIGESTS)
    docs = cases.simple(spark, tmp_path, pairs)
    assert result(exact.exact_dedup(docs, block_bytes=16, digests=weak)) == brute(pairs)


def test_all_copies(spark, tmp_path):
    pairs = [(i, "same text") for i in range(500)]
    assert result(exact.exact_dedup(cases.simple(spark, tmp_path, pairs))) == brute(pairs)
