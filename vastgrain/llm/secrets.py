"""Secret scans with one combined deterministic automaton.

Rules are byte-level regular expressions (classes, groups, alternatives, ``? * + {m,n}``). They are parsed into
one nondeterministic automaton that may begin a match anywhere, turned into a deterministic one by subset
construction, minimised by partition refinement, and laid out as a transition array over byte classes. One pass
over a batch of texts finds every place where some rule's match ends. Many stretches of text advance in step
(one array look-up for all of them at each byte); a stretch that doesn't start its text is run from a guess and,
where the guess was wrong, run again until both runs agree, so the states are those of a plain pass.

Starts are found backwards from an end, with an automaton of the reversed rule. Matches are leftmost, as long as
possible and, per kind, don't overlap; then those shorter than the kind's least length are dropped. (The pattern
of ``hex`` already asks for eight digits: a match is a whole run of digits, so that changes no result and spares
a stop at almost every word.)

Cases: null counts as empty; positions are code points; repeated rows are scanned each; texts are scanned whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXT_ROWS, map_batches, release, text_of


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``least`` is the least length of a match, or of its value if the match ``assigns`` one."""

    kind: str
    pattern: str
    least: int = 1
    assigns: bool = False


#: The base kinds, as listed.
BASE = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 6, assigns=True),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{8,}", 24),
)
#: Formats of keys that providers publish, besides the base kinds.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30),
    Rule("pem", r"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----", 27),
)
RULES = BASE + MORE
LANE = 512


# ---- regular expressions to nondeterministic automata


class _Parser:
    """Parses a pattern to a tree of ('set', bytes) | ('cat', parts) | ('alt', parts) | ('rep', part, least, most)."""

    def __init__(self, pattern: str):
        self.p, self.i = pattern, 0

    def parse(self):
        tree = self.alternatives()
        if self.i != len(self.p):
            raise ValueError(f"unexpected {self.p[self.i]!r} in {self.p!r}")
        return tree

    def alternatives(self):
        parts = [self.sequence()]
        while self.i < len(self.p) and self.p[self.i] == "|":
            self.i += 1
            parts.append(self.sequence())
        return ("alt", parts) if len(parts) > 1 else parts[0]

    def sequence(self):
        parts = []
        while self.i < len(self.p) and self.p[self.i] not in "|)":
            parts.append(self.repeated())
        return ("cat", parts)

    def repeated(self):
        part = self.atom()
        while self.i < len(self.p) and self.p[self.i] in "?*+{":
            c = self.p[self.i]
            self.i += 1
            if c == "{":
                stop = self.p.index("}", self.i)
                low, comma, high = self.p[self.i : stop].partition(",")
                self.i = stop + 1
                least, most = int(low), (int(high) if high else None) if comma else int(low)
            else:
                least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            part = ("rep", part, least, most)
        return part

    def char(self) -> int:
        c = self.p[self.i]
        self.i += 1
        if c != "\\":
            return ord(c)
        c = self.p[self.i]
        self.i += 1
        if c == "x":
            self.i += 2
            return int(self.p[self.i - 2 : self.i], 16)
        return ord(c)

    def atom(self):
        c = self.p[self.i]
        if c == "(":
            self.i += 1
            tree = self.alternatives()
            self.i += 1
            return tree
        if c == "[":
            self.i += 1
            members: set[int] = set()
            while self.p[self.i] != "]":
                low = self.char()
                if self.p[self.i] == "-" and self.p[self.i + 1] != "]":
                    self.i += 1
                    members.update(range(low, self.char() + 1))
                else:
                    members.add(low)
            self.i += 1
            return ("set", frozenset(members))
        return ("set", frozenset([self.char()]))


def _reversed(tree):
    kind = tree[0]
    if kind == "set":
        return tree
    if kind == "rep":
        return ("rep", _reversed(tree[1]), *tree[2:])
    parts = [_reversed(t) for t in tree[1]]
    return (kind, parts[::-1] if kind == "cat" else parts)


@dataclass
class _Nfa:
    """States with empty moves and moves on byte sets."""

    empty: list[list[int]] = field(default_factory=list)
    moves: list[list[tuple[frozenset[int], int]]] = field(default_factory=list)
    final: dict[int, int] = field(default_factory=dict)

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def build(self, tree, at: int) -> int:
        """Add ``tree`` after state ``at``; returns the state it ends in."""
        kind = tree[0]
        if kind == "set":
            to = self.state()
            self.moves[at].append((tree[1], to))
            return to
        if kind == "cat":
            for part in tree[1]:
                at = self.build(part, at)
            return at
        if kind == "alt":
            to = self.state()
            for part in tree[1]:
                begin = self.state()
                self.empty[at].append(begin)
                self.empty[self.build(part, begin)].append(to)
            return to
        _, part, least, most = tree
        for _ in range(least):
            at = self.build(part, at)
        if most is None:
            begin = self.state()
            self.empty[at].append(begin)
            self.empty[self.build(part, begin)].append(begin)
            return begin
        out = self.state()
        self.empty[at].append(out)
        for _ in range(most - least):
            at = self.build(part, at)
            self.empty[at].append(out)
        return out

    def closure(self, states) -> frozenset[int]:
        held, stack = set(states), list(states)
        while stack:
            for to in self.empty[stack.pop()]:
                if to not in held:
                    held.add(to)
                    stack.append(to)
        return frozenset(held)


@dataclass(frozen=True)
class Automaton:
    """A minimal deterministic automaton: ``table[state, byte class]``, ``accepts[state]`` (a bit for each rule); state 0 is the start."""

    table: np.ndarray
    classes: np.ndarray
    accepts: np.ndarray


def compile_rules(patterns: list[str], anywhere: bool = True, backwards: bool = False) -> Automaton:
    """Subset construction and minimisation of all patterns together. ``anywhere``: a match may begin at any byte."""
    nfa = _Nfa()
    start = nfa.state()
    for bit, pattern in enumerate(patterns):
        tree = _Parser(pattern).parse()
        begin = nfa.state()
        nfa.empty[start].append(begin)
        nfa.final[nfa.build(_reversed(tree) if backwards else tree, begin)] = 1 << bit
    # Bytes that every move treats alike form a class.
    sets = list(dict.fromkeys(s for moves in nfa.moves for s, _ in moves))
    signature = {b: tuple(b in s for s in sets) for b in range(256)}
    number = {sig: i for i, sig in enumerate(dict.fromkeys(signature.values()))}
    classes = np.array([number[signature[b]] for b in range(256)], np.uint8)
    member = [next(b for b in range(256) if classes[b] == c) for c in range(len(number))]
    first = nfa.closure([start])
    ids, todo, table = {first: 0}, [first], []
    for states in todo:
        row = []
        for b in member:
            to = {t for s in states for chars, t in nfa.moves[s] if b in chars}
            if anywhere:
                to.add(start)
            nxt = nfa.closure(to)
            if nxt not in ids:
                ids[nxt] = len(ids)
                todo.append(nxt)
            row.append(ids[nxt])
        table.append(row)
    raw = np.array(table, np.int64)
    accepts = np.array([sum({nfa.final[s] for s in states if s in nfa.final}) for states in todo], np.int64)
    # Partition refinement: states are alike while they accept alike and move to alike states.
    _, group = np.unique(accepts, return_inverse=True)
    while True:
        _, finer = np.unique(np.column_stack([group, group[raw]]), axis=0, return_inverse=True)
        finer = finer.reshape(-1)
        if finer.max() == group.max():
            break
        group = finer
    order = np.full(group.max() + 1, -1)
    n = 0
    for g in group:  # numbered by first appearance, so the start is 0
        if order[g] < 0:
            order[g] = n
            n += 1
    group = order[group]
    small, acc = np.zeros((n, raw.shape[1]), np.int32), np.zeros(n, np.int64)
    small[group], acc[group] = group[raw], accepts
    return Automaton(small, classes, acc)


class Scanner:
    """Finds all rules' matches in batches of texts."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.forward = compile_rules([r.pattern for r in rules])
        self.backward = [compile_rules([r.pattern], anywhere=False, backwards=True) for r in rules]
        width = self.forward.table.shape[1]
        self.flat = (self.forward.table * width).astype(np.int32).reshape(-1)  # from state * width to the next one's
        self.width = width
        self.accepts = self.forward.accepts

    def states(self, data: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """The automaton's state after each byte; it starts anew at each of ``begins`` (sorted, the first is 0)."""
        n = len(data)
        cls = self.forward.classes[data]
        limits = np.append(begins, n)
        starts = np.concatenate([np.arange(a, b, LANE) for a, b in zip(limits[:-1], limits[1:], strict=True) if b > a] or [np.zeros(0, np.int64)])
        ends = np.append(starts[1:], n)
        out = np.zeros(n, np.int32)
        lanes = np.argsort(starts - ends, kind="stable")  # longest first
        at, size = starts[lanes], (ends - starts)[lanes]
        state = np.zeros(len(lanes), np.int32)
        live = len(lanes)
        for step in range(int(size[0]) if len(size) else 0):
            while live and size[live - 1] <= step:
                live -= 1
            state = self.flat[state[:live] + cls[at[:live] + step]]
            out[at[:live] + step] = state
        # A lane inside a text guessed the start state; where the true one differs, run on until both agree.
        fresh = np.zeros(n + 1, bool)
        fresh[begins] = True
        for lane in np.nonzero(~fresh[starts])[0]:
            begin, end = int(starts[lane]), int(ends[lane])
            now = int(out[begin - 1])
            if now == 0:
                continue
            for i in range(begin, end):
                now = int(self.flat[now + int(cls[i])])
                if now == out[i]:
                    break
                out[i] = now
        return out // self.width

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """For each text its matches (start, end, rule), in bytes of its UTF-8, by start and then by rule."""
        encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
        limits = np.concatenate([[0], np.cumsum([len(e) for e in encoded])]).astype(np.int64)
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        joined = b"".join(encoded)
        if not joined:
            return found
        data = np.frombuffer(joined, np.uint8)
        begins = np.unique(limits[:-1][np.diff(limits) > 0])
        accepted = self.accepts[self.states(data, begins)]
        last = np.zeros(len(data), bool)
        last[limits[1:][limits[1:] > 0] - 1] = True
        for k, rule in enumerate(self.rules):
            bit = (accepted >> k) & 1 == 1
            # The match that ends here is as long as it can be if the next byte doesn't carry it on.
            stops = np.nonzero(bit & (last | ~np.append(bit[1:], False)))[0] + 1
            if not len(stops):
                continue
            owner = np.searchsorted(limits, stops - 1, side="right") - 1
            floor = 0
            before = -1
            for stop, text in zip(stops.tolist(), owner.tolist(), strict=True):
                base = int(limits[text])
                if text != before:
                    before, floor = text, base
                start = self._start(k, joined, floor, stop)
                if start is None:
                    continue
                floor = stop
                if self._length(k, joined, start, stop) >= rule.least:
                    found[text].append((start - base, stop - base, k))
        for spans in found:
            spans.sort(key=lambda s: (s[0], s[2]))
        return found

    def _start(self, k: int, joined: bytes, floor: int, stop: int) -> int | None:
        """The leftmost start, not before ``floor``, of a match that ends at ``stop``."""
        back, state, best = self.backward[k], 0, None
        table, classes, accepts = back.table, back.classes, back.accepts
        dead = self._dead(k)
        for i in range(stop - 1, floor - 1, -1):
            state = int(table[state, classes[joined[i]]])
            if accepts[state]:
                best = i
            if state == dead:
                break
        return best

    def _dead(self, k: int) -> int:
        table, accepts = self.backward[k].table, self.backward[k].accepts
        return next((s for s in range(len(table)) if not accepts[s] and (table[s] == s).all()), -1)

    def _length(self, k: int, joined: bytes, start: int, stop: int) -> int:
        """Length of an assignment's value, or of the whole match."""
        return stop - start - (self._value_at(joined[start:stop]) if self.rules[k].assigns else 0)

    @staticmethod
    def _value_at(match: bytes) -> int:
        """Where an assignment's value begins: after the first ``:`` or ``=``, spaces and a quote."""
        at = min(i for i in (match.find(b":"), match.find(b"=")) if i >= 0) + 1
        while match[at : at + 1] == b" ":
            at += 1
        return at + (match[at : at + 1] in (b'"', b"'"))


def _points(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Byte spans as code point spans."""
    if not spans or text.isascii():
        return spans
    lead = (np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8) & 0xC0) != 0x80
    before = np.concatenate([[0], np.cumsum(lead)])
    return [(int(before[a]), int(before[b]), k) for a, b, k in spans]


def find_spans(texts: list[str], scanner: Scanner) -> list[list[tuple[str, int, int]]]:
    """For each text its spans (kind, start, end) in code points, by start and then as kinds are listed."""
    return [[(scanner.rules[k].kind, a, b) for a, b, k in _points(t, s)] for t, s in zip(texts, scanner.scan(texts), strict=True)]


def _portions(texts: list[str], most: int = 4 << 20) -> Iterator[list[str]]:
    """Texts in order, a few MB at a time."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


_LOADED: dict[tuple[Rule, ...], Scanner] = {}


def _loaded(rules: tuple[Rule, ...]) -> Scanner:
    if rules not in _LOADED:
        _LOADED[rules] = Scanner(rules)
    return _LOADED[rules]


def scan_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans array<struct<kind:string,start:long,end:long>>`` of every row; positions are code points, ends exclusive."""

    scanner = _loaded(rules)  # compiled on the driver, a table of bounded size

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found: list = []
            for part in _portions(batch.column(1).to_pylist()):
                found += [[{"kind": k, "start": a, "end": b} for k, a, b in spans] for spans in find_spans(part, scanner)]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["doc_id", "spans"])

        return step

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")), make, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each stretch that spans cover replaced by the name of its first kind in angle brackets."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redactor(rules: tuple[Rule, ...] = RULES):
    """A function of a text column: the text without its secrets (null stays null)."""

    scanner = _loaded(rules)

    @F.pandas_udf("string")
    def clean(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in parts:
            for lo in range(0, max(1, len(batch)), TEXT_ROWS):
                texts, out = batch.iloc[lo : lo + TEXT_ROWS], []
                for part in _portions(["" if t is None else t for t in texts]):
                    out += [redact(t, s) for t, s in zip(part, find_spans(part, scanner), strict=True)]
                yield pd.Series([None if t is None else o for t, o in zip(texts, out, strict=True)], dtype="object")
        batch = texts = out = part = None
        release()

    return clean
