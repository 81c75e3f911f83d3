"""Packing token sequences: first-fit decreasing with a tournament tree, in randomised groups of documents.

Each document is tokenised and closed by an end id, then cut at multiples of the sequence length; a full piece
is a sequence by itself and stays where it is, and only the rest of a document (less than one sequence) has to be
fitted. Every document draws a random number that sends it to one of the groups of about ``GROUP_DOCS`` documents, so
copies and common keys gather nowhere. Every group is packed on its own: pieces by falling length, each into the first
open sequence that has room. A tournament tree over the free room of the sequences finds that one in logarithmic time.

The pieces are stored before they are dealt, so a lost executor changes neither the draw nor the groups. A task packs
several groups, one after the other.

Cases: null text counts as empty, which is one piece holding the end id alone; repeated rows are packed each;
an empty table gives an empty result; a null doc_id is kept as null; other columns of the documents are ignored, also
ones with the names used here. Long texts are tokenised whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, materialize, release, text_of

CAPACITY = 2048
#: Documents in a group.
GROUP_DOCS = 4096
#: Fixed value: how the public byte-level vocabulary splits text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Characters outside the blocks whose classes (letter, number, white space) have been stable since early Unicode.
CHANGED = re.compile("[^\x00-\u0220\u0222-\u0233\u0250-\u02ad\u0391-\u03a1\u03a3-\u03c9\u0400-\u0481\u0490-\u04c4\u05d0-\u05ea\u0621-\u063a\u0641-\u064a\u2000-\u200a\u2010-\u2027\u2030-\u2046\u20a0-\u20ac\u2190-\u21ea\u2200-\u22f1\u2500-\u2595\u3000-\u3003\u3041-\u3094\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3\uff01-\uff5e]")


def _byte_of_sign() -> dict[str, int]:
    """The byte each sign of a byte-level vocabulary stands for: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Ids as the tokenizers library gives them for a byte-level BPE file.

    The vocabulary of such a file is also a table of ranks, which a faster public library takes; its results are the
    same wherever both split text alike. They do for characters whose class hasn't changed since early Unicode; texts
    with any other character go through the tokenizers library itself. Strings of added tokens are set apart first.
    """

    def __init__(self, spec: str):
        import tiktoken
        from tokenizers import Tokenizer

        parsed = json.loads(spec)
        pre, model = parsed["pre_tokenizer"], parsed["model"]
        if pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or parsed["normalizer"]:
            raise ValueError("not a plain byte-level BPE file")
        self.library = Tokenizer.from_str(spec)
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in parsed["added_tokens"]):
            raise ValueError("an added token takes in its surroundings")
        self.added = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        self.apart = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        byte = _byte_of_sign()
        ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in self.added}
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if merged != list(range(256, 256 + len(merged))):
            raise ValueError("ids don't follow the order of merges")
        self.fast = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def _plain(self, text: str) -> bytes:
        if CHANGED.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not self.added or not any(a in text for a in self.added):
            return self._plain(text)
        return b"".join(np.array([self.added[part]], "<u4").tobytes() if k % 2 else self._plain(part) for k, part in enumerate(self.apart.split(text)))


_LOADED: dict[str, ByteBpe] = {}


def cut_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise whole texts and cut them: ``doc_id, start long, length long, doc_tokens long, ids binary``."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    last = np.array([end_id], "<u4").tobytes()

    def make():
        if spec not in _LOADED:
            _LOADED[spec] = ByteBpe(spec)
        coder = _LOADED[spec]

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            row, start, length, total, ids = [], [], [], [], []
            for k, text in enumerate(batch.column(2).to_pylist()):
                data = coder.encode(text) + last
                n = len(data) // 4
                for at in range(0, n, capacity):
                    row.append(k)
                    start.append(at)
                    length.append(min(capacity, n - at))
                    total.append(n)
                    ids.append(data[4 * at : 4 * (at + capacity)])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).take(pa.array(row, pa.int64())) for i in (0, 1)), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(total, pa.int64()), pa.array(ids, pa.binary())],
                ["doc_id", "draw", "start", "length", "doc_tokens", "ids"],
            )

        return step

    kind = docs.schema[id_col].dataType.simpleString()
    draw = F.xxhash64(F.monotonically_increasing_id())  # a number for each row, whatever it holds
    return map_batches(docs.select(F.col(id_col).alias("doc_id"), draw.alias("draw"), text_of(text_col).alias("text")), make, f"doc_id {kind}, draw long, start long, length long, doc_tokens long, ids binary")


class Tournament:
    """The free room of up to ``n`` bins, all empty at first; finds the first bin with room for an item."""

    def __init__(self, n: int, capacity: int):
        self.size = 1 << max(0, (n - 1).bit_length())
        self.tree = [capacity] * (2 * self.size)

    def place(self, length: int) -> tuple[int, int]:
        """Put an item into the first bin that has room; returns the bin and the room it had."""
        tree, k = self.tree, 1
        while k < self.size:
            k *= 2
            if tree[k] < length:
                k += 1
        room = tree[k]
        found = k - self.size
        tree[k] = room - length
        while k > 1:
            k //= 2
            left, right = tree[2 * k], tree[2 * k + 1]
            best = left if left >= right else right
            if tree[k] == best:
                break
            tree[k] = best
        return found, room


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item. Longer items come first; among equal ones, the earlier."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree = Tournament(max(1, len(lengths)), capacity)
    for k in np.argsort(-lengths, kind="stable"):
        length = int(lengths[k])
        bins[k], room = tree.place(length)
        offsets[k] = capacity - room
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_docs: int = GROUP_DOCS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` (both long) to ``pieces`` (with ``draw, start, length``) and drop ``draw``.

    Lengths are from 1 to ``capacity``. Other columns travel along, so drop bulky ones first; none may be called
    ``sequence_id``, ``offset`` or ``group_number``.
    """
    clash = {"sequence_id", "offset", "group_number"} & {c.lower() for c in pieces.columns}
    if clash:
        raise ValueError(f"pieces have columns {sorted(clash)}")
    stored = materialize(pieces, "pieces", texts=True)
    groups = max(1, -(-stored.filter("start = 0").count() // group_docs))
    schema = T.StructType([*stored.schema.fields, T.StructField("group_number", T.LongType()), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def packed(frame: pd.DataFrame) -> pd.DataFrame:
        # Rows arrive in any order; ties of length are put in an order of their contents, so a task that runs again packs alike.
        frame = frame.iloc[np.argsort(pd.util.hash_pandas_object(frame, index=False).to_numpy(), kind="stable")]
        bins, offsets = first_fit_decreasing(frame["length"].to_numpy(), capacity)
        return frame.assign(sequence_id=((frame["group_number"].to_numpy() << 32) + bins << 1) + 1, offset=offsets)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # the group that may go on in the next batch
        for batch in batches:
            for number, part in batch.groupby("group_number", sort=False):
                if held and held[0]["group_number"].iloc[0] != number:
                    yield packed(pd.concat(held, ignore_index=True))
                    held = []
                held.append(part)
        if held:
            yield packed(pd.concat(held, ignore_index=True))
        held = []
        release()

    rest = stored.filter(F.col("length") < capacity).withColumn("group_number", F.pmod("draw", F.lit(groups)))
    fitted = rest.repartition("group_number").sortWithinPartitions("group_number").mapInPandas(run, schema).drop("group_number")
    full = stored.filter(F.col("length") == capacity).withColumn("sequence_id", F.monotonically_increasing_id() * 2).withColumn("offset", F.lit(0).cast("long"))
    return fitted.unionByName(full).drop("draw")


def padded_length(filled: int, capacity: int = CAPACITY) -> int:
    """Length of a sequence as stored: a power of two stays as it is, anything else is padded to ``capacity``."""
    return filled if filled & (filled - 1) == 0 else capacity


def assemble(packed: DataFrame, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """Whole sequences from packed pieces that still carry ``ids``: ``sequence_id, filled long, ids binary`` (padded).

    A sequence holds at most ``capacity`` pieces, so its group is bounded.
    """
    pad = np.array([pad_id], "<u4").tobytes()
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "length", "ids"))).alias("parts"))
    filled = parts.select("sequence_id", F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("filled"), F.col("parts.ids").alias("all"))
    whole = F.expr(f"case when filled & (filled - 1) = 0 then filled else {capacity}L end")
    joined = F.aggregate("all", F.lit(b""), lambda a, x: F.concat(a, x))
    padding = F.expr(f"cast(unhex(repeat('{pad.hex()}', cast(__w - filled as int))) as binary)")
    return filled.withColumn("__w", whole).select("sequence_id", "filled", F.concat(joined, padding).alias("ids"))
