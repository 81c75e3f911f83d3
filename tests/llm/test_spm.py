import hashlib
import random

import numpy as np
import sentencepiece

from tests.llm import cases
from vastgrain.llm import spm
from vastgrain.llm.queries import tokenizer_file

POOL = ["a", "b", "e", "t", "h", "the", "ing", " ", "  ", "\n", "\t", "▁", "é", "ﬁ", "中", "😀", "\0", "<s>", "1", "00", ".", "...", "====", "the "]


def setup():
    path = tokenizer_file("piece_bpe_32k.model")
    return sentencepiece.SentencePieceProcessor(model_file=path), spm.Model(spm.model_bytes(path)), path


def test_encoding_counts_and_decoding_are_the_library_s():
    lib, model, _ = setup()
    coder, counter = spm.Encoder(model), spm.PrefixCounter(model)
    rnd = random.Random(3)
    for k in range(4000):
        text = "".join(rnd.choice(POOL) for _ in range(rnd.randint(0, 25)))
        want = lib.encode(text, add_bos=True, add_eos=True)
        assert coder.encode(text, True, True).tolist() == want
        assert model.decode(want) == lib.decode(want)
        if k % 20 == 0:
            counts = [len(lib.encode(text[:i])) for i in range(len(text) + 1)]
            assert counter.counts(text).tolist() == counts
            budget = rnd.randint(0, 10)
            assert counter.measure(text, budget) == (counts[-1], max(i for i, c in enumerate(counts) if c <= budget))


def test_torn_bytes_decode_like_the_library():
    lib, model, _ = setup()
    byte = model.byte_id
    for ids in ([1, byte[0xC3], 100, 2], [byte[0xE2], byte[0x82]], [byte[65]], [400, byte[0xC3], byte[0xA9], byte[0xFF]], [0, 5000], []):
        assert model.decode(ids) == lib.decode(ids)


def test_documents(spark, tmp_path):
    lib, _, path = setup()
    docs = cases.table(spark, tmp_path)
    want = sorted(((r[0] or -1, *digests(lib, r[1] or "")) for r in cases.rows()), key=str)
    coded = spm.encode_documents(docs, path).collect()
    got = sorted(((r.id or -1, len(r.ids) // 4, hashlib.sha256(r.ids).hexdigest(), r.decoded) for r in coded), key=str)
    assert got == want
    counted = spm.count_documents(docs, path, 10, keep_prefixes=True).collect()
    texts = {r[0]: r[1] or "" for r in cases.rows()}
    for r in counted:
        text = texts[r.id]
        assert r.n_bytes == len(text.encode()) and r.n_tokens == len(lib.encode(text))
        assert spm.tokens_of_prefix(r.prefix_counts, len(text) // 2) == len(lib.encode(text[: len(text) // 2]))
        assert spm.tokens_of_prefix(r.prefix_counts, r.budget_chars) <= 10
    empty = cases.empty(spark, tmp_path)
    assert spm.encode_documents(empty, path).count() == 0 and spm.count_documents(empty, path, 10).count() == 0


def digests(lib, text):
    ids = lib.encode(text, add_bos=True, add_eos=True)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), lib.decode(ids)
