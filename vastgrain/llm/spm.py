"""SentencePiece BPE: exact encoding by backtracking, decoding, and token counts at every prefix.

A merge-type (BPE) encoding is the only sequence of pieces in which every piece re-encodes to itself
and every two neighbours, merged again on their own, come out as the same two pieces. Both operators
here rest on that fact:

* :class:`Encoder` takes Aho-Corasick longest matches from left to right, checks each new piece against
  its left neighbour by re-merging the two, falls back to the next shorter match, and steps back over
  earlier pieces when none fits. A bitfield keeps the positions already known to fail, so that no
  position is tried twice.
* :class:`PrefixCounter` is a dynamic programme over prefixes: the last piece of each prefix's encoding
  is the one match ending there that is compatible with the last piece of the prefix before it. It keeps
  the token count of every prefix, so truncation and budget questions need no new encoding.

Where no piece holds two neighbouring characters in a row, merges can't cross between them; a text is cut there
(before space marks, around line breaks, before most punctuation, as the model's pieces tell) and encoded run by
run. Runs repeat, so results are memoised (bounded).

Cases: null counts as empty; the empty text has no tokens (with begin and end: two); control strings such
as ``<s>`` in a text are ordinary text; characters without a piece become byte pieces.
"""

from __future__ import annotations

import hashlib
import re
import sys
from array import array
from collections.abc import Iterable

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, map_batches, text_of

#: SentencePiece's space mark.
MARK = "▁"
#: Runs longer than this are encoded without memoising them.
MEMO_CHARS = 48
MEMO_RUNS = 250_000
MEMO_PAIRS = 200_000


class Model:
    """Tables of a BPE model with byte fallback and identity normalisation, as the public library reads it."""

    def __init__(self, proto: bytes):
        lib = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.lib = lib
        self.begin, self.end, self.unknown = lib.bos_id(), lib.eos_id(), lib.unk_id()
        self.pieces: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.byte_id: dict[int, int] = {}
        self.text: list[str] = [lib.id_to_piece(i) for i in range(lib.get_piece_size())]
        for i, piece in enumerate(self.text):
            if lib.is_byte(i):
                self.byte_id[int(piece[3:-1], 16)] = i
            elif not (lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i)):
                self.pieces[piece] = i
                self.score[piece] = lib.get_score(i)
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.pieces):
            raise ValueError("a piece crosses a space mark; this model can't be cut at spaces")
        if len(self.byte_id) != 256:
            raise ValueError("the model has no byte fallback")
        probe = "a  éﬁ b\n"
        if lib.encode(probe) != lib.encode_as_ids(probe) or lib.decode(lib.encode(probe)) != probe:
            raise ValueError("the model normalises its input")
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        #: What each id decodes to.
        self.raw = [bytes([self.byte_of[i]]) if i in self.byte_of else p.replace(MARK, " ").encode() for i, p in enumerate(self.text)]
        self.raw[self.unknown] = " \u2047 ".encode()
        inside = {c for p in self.pieces if len(p) > 1 for c in p}
        self.alone = "".join(c for c in "\n\t\r" if c not in inside)
        self.runs = self._runs()
        #: Pieces that merging can produce: those that re-encode to themselves.
        self.whole = {p: i for p, i in self.pieces.items() if len(p) == 1 or self.merge(p) == [p]}
        self.longest = max(map(len, self.whole))
        self.pair = Memo(self._pair, MEMO_PAIRS)

    def _runs(self) -> re.Pattern:
        """Cuts a marked text where no piece can reach across: before a run of marks, around characters that only stand alone, and
        before marks of punctuation that no piece has after the character in front of them."""
        before: dict[str, set[str]] = {}
        for p in self.pieces:
            for a, b in zip(p, p[1:], strict=False):
                before.setdefault(b, set()).add(a)
        points = {c for c in map(chr, range(33, 127)) if not c.isalnum()}
        few = 16  # a mark with more characters in front of it than this isn't cut off
        while drop := {c for c in points if len(before.get(c, set()) - points - {MARK}) > few}:
            points -= drop
        joins = set().union(*(before.get(c, set()) for c in points)) - points - {MARK}
        stop, apart, join = MARK + re.escape(self.alone), re.escape("".join(sorted(points))), re.escape("".join(sorted(joins)))
        word = f"[^{stop}{apart}]+" + (f"(?:(?<=[{join}])[{apart}][^{stop}]*)?" if joins and points else "")
        parts = [f"{MARK}*{word}", f"{MARK}*[{apart}][^{stop}]*" if apart else "", f"{MARK}+", f"[{re.escape(self.alone)}]+" if self.alone else ""]
        return re.compile("|".join(filter(None, parts)))

    def merge(self, text: str) -> list[str]:
        """Plain merging: join the neighbours whose union has the best score, leftmost first, until none is left."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _pair(self, key: tuple[str, str]) -> bool:
        return self.merge(key[0] + key[1]) == [key[0], key[1]]

    def fallback(self, char: str) -> list[int]:
        """Ids of a character that no piece covers."""
        return [self.byte_id[b] for b in char.encode()]

    def marked(self, text: str) -> str:
        """The normalised text: a mark for each space, and one in front."""
        return MARK + text.replace(" ", MARK) if text else ""

    def decode(self, ids: Iterable[int]) -> str:
        """The library's decode: pieces joined, marks back to spaces, one leading space less, bytes as UTF-8."""
        ids = [i for i in ids if i not in (self.begin, self.end)]
        try:
            out = b"".join(map(self.raw.__getitem__, ids)).decode()
        except UnicodeDecodeError:
            return self._decode_torn(ids)
        return out[1:] if ids and self.text[ids[0]][0] == MARK else out

    def _decode_torn(self, ids: list[int]) -> str:
        """As :meth:`decode`, where byte pieces aren't valid UTF-8: a replacement character for each stray byte."""
        out: list[str] = []
        torn = bytearray()

        def flush() -> None:
            at = 0
            while at < len(torn):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(torn[at : at + n].decode())
                        at += n
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("\ufffd")
                    at += 1
            torn.clear()

        for k, i in enumerate(ids):
            if i in self.byte_of:
                torn.append(self.byte_of[i])
                continue
            flush()
            piece = self.raw[i].decode()
            out.append(piece[1:] if k == 0 and self.text[i][0] == MARK else piece)
        flush()
        return "".join(out)


class Encoder:
    """Exact encoding of one run by backtracking over Aho-Corasick longest matches."""

    def __init__(self, model: Model):
        self.model = model
        self.matches = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for piece in model.whole:
            self.matches.add_word(piece)
        self.matches.make_automaton()
        self.memo = Memo(self._bytes, MEMO_RUNS)

    def pieces(self, run: str) -> list[str]:
        """The pieces of a run; a character without a piece stands for itself."""
        n, pair, whole = len(run), self.model.pair, self.model.whole
        reach, longest = self.matches.longest_prefix, self.model.longest
        failed = bytearray(n // 8 + 1)  # a bit for each position from which no compatible way on exists
        out: list[str] = []
        left: list[int] = []  # for each piece taken, the next shorter length to try in its place
        at, size = 0, -1
        while at < n:
            if size < 0:
                size = max(1, reach(run[at : at + longest]))
            last = out[-1] if out else None
            while size:
                piece = run[at : at + size]
                size -= 1
                if size and piece not in whole:  # a single character is taken as it is
                    continue
                to = at + size + 1
                if failed[to >> 3] >> (to & 7) & 1:
                    continue
                if last is None or pair[last, piece]:
                    out.append(piece)
                    left.append(size)
                    at, size = to, -1
                    break
            else:
                if not out:
                    raise ValueError("no encoding found")
                failed[at >> 3] |= 1 << (at & 7)
                at -= len(out.pop())
                size = left.pop()
        return out

    def ids(self, run: str) -> list[int]:
        whole, out = self.model.whole, []
        for p in self.pieces(run):
            i = whole.get(p)
            if i is None:
                out += self.model.fallback(p)
            else:
                out.append(i)
        return out

    def _bytes(self, run: str) -> bytes:
        ids = array("I", self.ids(run))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def encode(self, text: str, begin: bool = False, end: bool = False) -> np.ndarray:
        """Ids of a whole text as unsigned 32-bit integers."""
        memo, plain = self.memo, self._bytes
        parts = [memo[r] if len(r) <= MEMO_CHARS else plain(r) for r in self.model.runs.findall(self.model.marked(text))]
        first = np.array([self.model.begin], "<u4").tobytes() if begin else b""
        last = np.array([self.model.end], "<u4").tobytes() if end else b""
        return np.frombuffer(first + b"".join(parts) + last, "<u4")


class PrefixCounter:
    """Token counts of every prefix of a text by dynamic programming over prefixes."""

    def __init__(self, model: Model):
        self.model = model
        self.matches = ahocorasick.Automaton()
        for piece in model.whole:
            self.matches.add_word(piece, piece)
        self.matches.make_automaton()
        self.memo = Memo(self._run, MEMO_RUNS)

    def _run(self, run: str) -> tuple[int, tuple[int, ...]]:
        """Token count of the run, and of each of its prefixes."""
        n, pair = len(run), self.model.pair
        ending: list[list[str]] = [[] for _ in range(n + 1)]
        for at, piece in self.matches.iter(run):
            ending[at + 1].append(piece)
        last: list[str] = [""] * (n + 1)
        count = [0] * (n + 1)
        for to in range(1, n + 1):
            for piece in ending[to] or (run[to - 1],):
                at = to - len(piece)
                if not at or pair[last[at], piece]:
                    last[to] = piece
                    count[to] = count[at] + (1 if ending[to] else len(piece.encode()))
                    break
            else:
                raise ValueError("no encoding found")
        return count[n], tuple(count[1:])

    def _of(self, run: str) -> tuple[int, tuple[int, ...]]:
        return self.memo[run] if len(run) <= MEMO_CHARS else self._run(run)

    def runs(self, text: str) -> list[tuple[int, tuple[int, ...]]]:
        memo, plain = self.memo, self._run
        return [memo[r] if len(r) <= MEMO_CHARS else plain(r) for r in self.model.runs.findall(self.model.marked(text))]

    def counts(self, text: str) -> np.ndarray:
        """``counts(text)[i]`` is the token count of ``text[:i]``, for i from 0 to len(text)."""
        if not text:
            return np.zeros(1, np.int64)
        parts, base = [], 0
        for total, inner in self.runs(text):
            parts.append(np.array(inner, np.int64) + base)
            base += total
        out = np.concatenate(parts)  # its first entry is the mark in front: the empty prefix, which has no tokens
        out[0] = 0
        return out

    def measure(self, text: str, budget: int) -> tuple[int, int]:
        """The token count, and the characters of the longest prefix of at most ``budget`` tokens."""
        runs = self.runs(text)
        total = sum(r[0] for r in runs)
        if total <= budget:
            return total, len(text)
        best, base, at = 0, 0, -1  # at: characters before the run; the mark in front is none
        for n, inner in runs:
            if base > budget:
                break
            for i in range(len(inner), 0, -1):
                if base + inner[i - 1] <= budget:
                    best = max(best, at + i)
                    break
            base, at = base + n, at + len(inner)
        return total, best


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


_LOADED: dict[tuple[type, bytes], object] = {}


def _loaded(kind: type, proto: bytes):
    """One encoder or counter per worker process and model; its memo serves later tasks as well."""
    key = (kind, hashlib.sha256(proto).digest())
    if key not in _LOADED:
        _LOADED[key] = kind(Model(proto))
    return _LOADED[key]


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts with begin and end ids, and decode them again.

    Returns ``id, ids binary (little-endian unsigned 32-bit), decoded string``, one row for each input row.
    The model file (bounded, read on the driver) travels with the task.
    """
    proto = model_bytes(model_path)

    def make():
        coder = _loaded(Encoder, proto)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            coded = [coder.encode(text, begin=True, end=True) for text in batch.column(1).to_pylist()]
            texts = [coder.model.decode(ids.tolist()) for ids in coded]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([ids.tobytes() for ids in coded], pa.binary()), pa.array(texts, pa.string())], ["id", "ids", "decoded"])

        return step

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")), make, f"id {kind}, ids binary, decoded string")


def decode_documents(encoded: DataFrame, model_path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """Decode stored ids (little-endian unsigned 32-bit binary; null: none). Returns ``id, decoded string``."""
    proto = model_bytes(model_path)

    def make():
        model = _loaded(Encoder, proto).model

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [model.decode(np.frombuffer(ids or b"", "<u4").tolist()) for ids in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "decoded"])

        return step

    kind = encoded.schema[id_col].dataType.simpleString()
    return map_batches(encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")), make, f"id {kind}, decoded string")


def count_documents(docs: DataFrame, model_path: str, budget: int, id_col: str = "doc_id", text_col: str = "text", keep_prefixes: bool = False) -> DataFrame:
    """Token counts of whole texts by prefix dynamic programming.

    Returns ``id, n_bytes long, n_tokens long, budget_chars long`` (the longest prefix of at most ``budget``
    tokens, in code points) and, with ``keep_prefixes``, ``prefix_counts binary``: little-endian signed 32-bit
    counts of every prefix, from the empty one to the whole text; :func:`tokens_of_prefix` reads it.
    """
    proto = model_bytes(model_path)

    def make():
        counter = _loaded(PrefixCounter, proto)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(1).to_pylist()
            found = [counter.measure(text, budget) for text in texts]
            columns = [
                batch.column(0),
                pa.array([len(t.encode()) for t in texts], pa.int64()),
                pa.array([n for n, _ in found], pa.int64()),
                pa.array([fit for _, fit in found], pa.int64()),
            ]
            names = ["id", "n_bytes", "n_tokens", "budget_chars"]
            if keep_prefixes:
                columns.append(pa.array([counter.counts(t).astype("<i4").tobytes() for t in texts], pa.binary()))
                names.append("prefix_counts")
            return pa.RecordBatch.from_arrays(columns, names)

        return step

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_bytes long, n_tokens long, budget_chars long" + (", prefix_counts binary" if keep_prefixes else "")
    return map_batches(docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")), make, schema)


def tokens_of_prefix(prefix_counts: bytes, chars: int) -> int:
    """The token count of the first ``chars`` characters, from a stored ``prefix_counts``."""
    return int(np.frombuffer(prefix_counts, "<i4")[chars])
