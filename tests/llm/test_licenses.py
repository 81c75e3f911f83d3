import math
import random
import re

import pytest

from tests.llm import cases
from vastgrain.llm import licenses as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def length(template):
    half = L.BLOCK_WORDS // 2
    while half < len(template.split()):
        half *= 2
    return half


def rivals(t, r):
    return len(t & r) >= math.ceil(0.8 * min(len(t), len(r)) - 1e-9)


def own_share(t, r, block):
    return len((t - r) & block) / len(t - r) if t - r else 0.0


def meets(t, label, block):
    if len(t & block) < math.ceil(0.8 * len(t) - 1e-9):
        return False
    others = [set(r.split()) for r, other in L.TEMPLATES if other != label]
    return all(len((t - r) & block) >= math.ceil(0.8 * len(t - r) - 1e-9) for r in others if rivals(t, r))


def brute(text):
    words = WORD.findall(lower(text))
    places, labels = [], set()
    for phrase, label in L.PHRASES:
        p = phrase.split()
        found = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        places += found
        if found:
            labels.add(label)
    base = set(labels)
    best = 0.0
    for half in sorted({length(t) for t, _ in L.TEMPLATES}):
        for at in range(0, len(words), half):
            block = set(words[at : at + 2 * half])
            met = [(set(t.split()), label) for t, label in L.TEMPLATES if length(t) == half and meets(set(t.split()), label, block)]
            for t, label in met:
                if all(label == other or not rivals(t, r) or own_share(r, t, block) <= own_share(t, r, block) for r, other in met):
                    labels.add(label)
                    best = max(best, len(t & block) / len(t))
    score = 1.0 if places else best
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score)


def result(df):
    return sorted([(r.doc_id, (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score)) for r in df.collect()], key=str)


def test_awkward_rows(spark, tmp_path):
    docs = cases.table(spark, tmp_path)
    assert result(L.license_scan(docs)) == sorted([(r[0], brute(r[1])) for r in cases.rows()], key=str)
    assert L.license_scan(cases.empty(spark, tmp_path)).count() == 0


def test_templates_and_phrases_against_brute_force(spark, tmp_path):
    rnd = random.Random(1)
    pool = [w for s, _ in L.TEMPLATES for w in s.split()] + ["zebra", "Öl", "x1"]
    pairs = []
    for i in range(300):
        words = [rnd.choice(pool) for _ in range(rnd.randint(0, 150))]
        statement = rnd.choice(L.TEMPLATES)[0].split()
        for _ in range(rnd.randint(0, 3)):
            if statement:
                statement.pop(rnd.randrange(len(statement)))
        at = rnd.randint(0, len(words))
        words[at:at] = statement if i % 3 else []
        words[at:at] = rnd.choice(["cc by cc by", "MIT License", "apache license", "", "gnu general public"]).split()
        pairs.append((i, rnd.choice([" ", ", ", "\n", "--"]).join(words)))
    assert result(L.license_scan(cases.simple(spark, tmp_path, pairs))) == sorted([(i, brute(t)) for i, t in pairs], key=str)


def labels_of(spark, tmp_path, texts, **more):
    return {r.doc_id: r.labels for r in L.license_scan(cases.simple(spark, tmp_path, list(enumerate(texts))), **more).collect()}


def test_siblings_are_told_apart(spark, tmp_path):
    notice = {label: [t for t, x in L.TEMPLATES if x == label] for label in ("gpl", "lgpl", "agpl", "mit", "bsd", "isc", "zlib", "apache")}
    texts = ["Licensed under CC BY 4.0", "Licensed under CC BY-NC 4.0.", "licensed under CC BY-NC-SA 4.0", notice["gpl"][1], notice["lgpl"][-1], notice["agpl"][0], notice["mit"][-1], notice["isc"][0], notice["bsd"][-1], notice["zlib"][0], "Released under the MIT License"]
    texts += [f"{PROSE} {notice['lgpl'][-1]} {PROSE}", f"{notice['gpl'][2]} {PROSE * 9} {notice['apache'][1]}"]
    got = labels_of(spark, tmp_path, texts)
    assert [got[i] for i in range(len(texts))] == ["cc-by", "cc-by,cc-by-nc", "cc-by,cc-by-nc-sa", "gpl", "lgpl", "agpl", "mit", "isc", "bsd", "zlib", "mit", "lgpl", "apache,gpl"]


PROSE = "the quick brown fox jumps over the lazy dog while seven wizards box with two odd quail and nobody in the village minds them at all " * 3


def test_long_templates(spark, tmp_path):
    """A template of 160 distinct words, begun at any place of a long text."""
    words = [f"t{i}" for i in range(160)]
    template = ((" ".join(words), "own"),)
    filler = [f"f{i}" for i in range(20_000)]
    texts = [" ".join(filler[:at] + [w for i, w in enumerate(words) if i % 6 != off] + filler[at:]) for at, off in ((0, 0), (1, 1), (79, 2), (139, 3), (161, 4), (319, 5), (12_345, 2), (20_000, 3))]
    texts.append(" ".join(filler[:99] + [w for i, w in enumerate(words) if i % 4] + filler[99:]))
    got = labels_of(spark, tmp_path, texts, templates=template)
    assert [got[i] for i in range(9)] == ["own"] * 8 + [""]
    with pytest.raises(ValueError):
        L.license_scan(cases.empty(spark, tmp_path), templates=((" ", "none"),))
