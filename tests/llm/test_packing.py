import random
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from tests.llm import cases
from vastgrain.llm import packing as P
from vastgrain.llm.queries import tokenizer_file


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))


def test_ids_are_the_library_s():
    coder, lib = P.ByteBpe(open(tokenizer_file("byte_bpe_50k.json"), encoding="utf-8").read()), library()
    rnd = random.Random(7)
    pool = ["the", " the", "  ", "\n", "\n\n ", "'s", "'ll", "é", "中文", "😀", "123", "...", "<|endoftext|>", "<|endoftext", "\t", " ", " ", "a", "_", "\0", "ſ", "İ"]
    for _ in range(3000):
        text = "".join(rnd.choice(pool) for _ in range(rnd.randint(0, 12)))
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids, text


def test_first_fit_decreasing_against_brute_force():
    rnd = random.Random(3)
    for _ in range(50):
        lengths = np.array([rnd.randint(1, 64) for _ in range(rnd.randint(1, 80))])
        bins, offsets = P.first_fit_decreasing(lengths, 64)
        rooms = []
        want = {}
        for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
            b = next((b for b, r in enumerate(rooms) if r >= lengths[k]), len(rooms))
            if b == len(rooms):
                rooms.append(64)
            want[k] = (b, 64 - rooms[b])
            rooms[b] -= lengths[k]
        assert {k: (int(bins[k]), int(offsets[k])) for k in want} == want


def test_packed_pieces(spark, tmp_path):
    docs = cases.table(spark, tmp_path)
    lib = library()
    cut = P.cut_documents(docs, tokenizer_file("byte_bpe_50k.json"), capacity=64)
    packed = P.pack(cut.select("doc_id", "draw", "start", "length", F.crc32("ids").alias("c"), "doc_tokens"), capacity=64, group_docs=5).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in packed:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    for i, text, *_ in cases.rows():
        if i == 2:
            continue  # twice there
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.c == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert len(by_doc[2]) % 2 == 0
    assert P.pack(P.cut_documents(cases.empty(spark, tmp_path), tokenizer_file("byte_bpe_50k.json"))).count() == 0


def test_assembled_sequences(spark, tmp_path):
    docs = cases.simple(spark, tmp_path, [(i, cases.PROSE * (1 + i % 3)) for i in range(20)])
    cut = P.cut_documents(docs, tokenizer_file("byte_bpe_50k.json"), capacity=128)
    whole = P.assemble(P.pack(cut, capacity=128), capacity=128).collect()
    assert sum(r.filled for r in whole) == cut.agg(F.sum("length")).first()[0]
    assert all(len(r.ids) == 4 * P.padded_length(r.filled, 128) for r in whole)


def test_groups_are_of_whole_documents_at_random(spark, tmp_path):
    """Copies of one document spread over the groups, a document's pieces stay together, and each group is first-fit decreasing."""
    docs = cases.simple(spark, tmp_path, [(i % 3, cases.PROSE * (i % 4)) for i in range(300)])
    cut = P.cut_documents(docs, tokenizer_file("byte_bpe_50k.json"), capacity=64).select("doc_id", "draw", F.col("draw").alias("document"), "start", "length")
    rows = P.pack(cut, capacity=64, group_docs=30).collect()
    group = {r.document: set() for r in rows}
    groups = defaultdict(list)
    for r in rows:
        assert (r.length == 64) == (r.sequence_id % 2 == 0)
        if r.length < 64:
            group[r.document].add(r.sequence_id >> 33)
            groups[r.sequence_id >> 33].append(r)
    assert len(group) == 300 and all(len(g) <= 1 for g in group.values()) and len(groups) == 10
    assert {r.doc_id for r in groups[0]} == {0, 1, 2} and max(map(len, groups.values())) < 60
    for members in groups.values():
        order = sorted(members, key=lambda r: (-r.length, r.sequence_id, r.offset))
        bins, _ = P.first_fit_decreasing(np.array([r.length for r in order]), 64)
        assert len(set(bins.tolist())) == len({r.sequence_id for r in members})


def test_names_that_clash_are_refused(spark, tmp_path):
    import pytest

    cut = P.cut_documents(cases.table(spark, tmp_path), tokenizer_file("byte_bpe_50k.json"))
    with pytest.raises(ValueError):
        P.pack(cut.withColumn("Offset", F.lit(1)))
