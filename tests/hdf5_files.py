"""Writes small HDF5 files for tests, byte by byte after the public format: version 0 superblock, symbol-table groups, version 1 headers."""

from __future__ import annotations

import struct
import zlib

import numpy as np

NONE = 0xFFFFFFFFFFFFFFFF


def pad(data: bytes) -> bytes:
    return data + bytes(-len(data) % 8)


def type_message(dtype, vlen=False, labels=None) -> bytes:
    if vlen:
        return struct.pack("<B3BI", 0x19, 1, 0, 0, 16) + type_message(np.dtype("S1"))
    if labels:
        base = type_message(np.dtype(dtype))
        names = b"".join(pad(n.encode() + b"\0") for n in labels.values())
        return struct.pack("<B3BI", 0x18, len(labels), 0, 0, np.dtype(dtype).itemsize) + base + names + np.array(list(labels), dtype).tobytes()
    dtype = np.dtype(dtype)
    size = dtype.itemsize
    if dtype.names:
        body = b""
        for n in dtype.names:
            kind, at = dtype.fields[n][:2]
            body += pad(n.encode() + b"\0") + struct.pack("<IB3x4x4x16x", at, 0) + type_message(kind)
        return struct.pack("<BH1xI", 0x16, len(dtype.names), size) + body
    if dtype.kind in "iu":
        return struct.pack("<B3BIHH", 0x10, 8 if dtype.kind == "i" else 0, 0, 0, size, 0, 8 * size)
    if dtype.kind == "f":
        e, m = (8, 23) if size == 4 else (11, 52)
        return struct.pack("<B3BIHHBBBBI", 0x11, 0x20, 8 * size - 1, 0, size, 0, 8 * size, m, e, 0, m, (1 << e - 1) - 1)
    if dtype.kind == "S":
        return struct.pack("<B3BI", 0x13, 0, 0, 0, size)
    raise TypeError(dtype)


def space_message(shape) -> bytes:
    return struct.pack("<BBB5x", 1, len(shape), 0) + b"".join(struct.pack("<Q", n) for n in shape)


class Writer:
    """``tree`` maps names to arrays, lists of str (strings of variable length), dicts (groups; ``@name`` is an attribute) or ``Data``."""

    def __init__(self):
        self.out = bytearray(96)

    def put(self, data: bytes) -> int:
        self.out += bytes(-len(self.out) % 8)
        at = len(self.out)
        self.out += data
        return at

    def strings(self, values) -> bytes:
        """References into one global heap collection."""
        objects, refs = b"", []
        for k, v in enumerate(values):
            raw = v.encode()
            objects += struct.pack("<HH4xQ", k + 1, 1, len(raw)) + pad(raw)
            refs.append((len(raw), k + 1))
        size = 16 + len(objects) + 16
        at = self.put(b"GCOL" + struct.pack("<B3xQ", 1, size) + objects + bytes(16))
        return b"".join(struct.pack("<IQI", n, at, k) for n, k in refs)

    def raw(self, value) -> tuple[bytes, bytes, tuple]:
        """(bytes, type message, shape)."""
        if isinstance(value, str):
            return self.strings([value]), type_message(None, vlen=True), ()
        if isinstance(value, list):
            return self.strings(value), type_message(None, vlen=True), (len(value),)
        value = np.asarray(value)
        if value.dtype == bool:
            return value.astype("i1").tobytes(), type_message("i1", labels={0: "FALSE", 1: "TRUE"}), value.shape
        return value.tobytes(), type_message(value.dtype), value.shape

    def header(self, messages) -> int:
        body = b"".join(struct.pack("<HHB3x", n, len(pad(d)), 0) + pad(d) for n, d in messages)
        half = len(messages) // 2 if len(messages) > 3 else 0
        if half:  # the later messages stand in a continuation block
            first = b"".join(struct.pack("<HHB3x", n, len(pad(d)), 0) + pad(d) for n, d in messages[:half])
            rest = body[len(first) :]
            at = self.put(rest)
            body = first + struct.pack("<HHB3xQQ", 0x10, 16, 0, at, len(rest))
        return self.put(struct.pack("<BxHII4x", 1, len(messages) + bool(half), 1, len(body)) + body)

    def attributes(self, named) -> list:
        out = []
        for name, value in named.items():
            data, kind, shape = self.raw(value)
            space = space_message(shape)
            out.append((0x0C, struct.pack("<BxHHH", 1, len(name) + 1, len(kind), len(space)) + pad(name.encode() + b"\0") + pad(kind) + pad(space) + data))
        return out

    def dataset(self, value) -> int:
        chunks, filters, attrs = None, (), {}
        if isinstance(value, Data):
            chunks, filters, attrs, value = value.chunks, value.filters, value.attrs, value.values
        data, kind, shape = self.raw(value)
        messages = [(0x01, space_message(shape)), (0x03, kind)]
        if chunks is None:
            at = self.put(data) if data else NONE
            messages.append((0x08, struct.pack("<BBQQ", 3, 1, at, len(data))))
        else:
            messages += self.chunked(np.asarray(value), chunks, filters)
        return self.header(messages + self.attributes(attrs))

    def chunked(self, values, chunks, filters) -> list:
        size, rank = values.dtype.itemsize, values.ndim
        entries = []
        for place in np.ndindex(*[-(-s // c) for s, c in zip(values.shape, chunks, strict=True)]):
            low = [p * c for p, c in zip(place, chunks, strict=True)]
            block = np.zeros(chunks, values.dtype)
            part = values[tuple(slice(a, a + c) for a, c in zip(low, chunks, strict=True))]
            block[tuple(slice(0, n) for n in part.shape)] = part
            raw = block.tobytes()
            for f in filters:
                raw = np.frombuffer(raw, np.uint8).reshape(-1, size).T.tobytes() if f == 2 else zlib.compress(raw)
            entries.append((low, len(raw), self.put(raw)))
        key = lambda low, n: struct.pack("<II", n, 0) + b"".join(struct.pack("<Q", x) for x in (*low, 0))
        leaves = []
        for k in range(0, len(entries), 4):  # two levels
            part = entries[k : k + 4]
            body = b"".join(key(low, n) + struct.pack("<Q", at) for low, n, at in part) + key([s + c for s, c in zip(values.shape, chunks, strict=True)], 0)
            leaves.append((part[0][0], self.put(b"TREE" + struct.pack("<BBHQQ", 1, 0, len(part), NONE, NONE) + body)))
        body = b"".join(key(low, 0) + struct.pack("<Q", at) for low, at in leaves) + key(values.shape, 0)
        root = self.put(b"TREE" + struct.pack("<BBHQQ", 1, 1, len(leaves), NONE, NONE) + body)
        layout = struct.pack("<BBBQ", 3, 2, rank + 1, root) + b"".join(struct.pack("<I", c) for c in (*chunks, size))
        pipeline = struct.pack("<BB6x", 1, len(filters))
        for f in filters:
            values_of = [size] if f == 2 else [4]
            pipeline += struct.pack("<HHHH", f, 8, 1, 1) + (b"shuffle\0" if f == 2 else b"deflate\0") + struct.pack("<I4x", values_of[0])
        return [*([(0x0B, pipeline)] if filters else []), (0x08, layout)]

    def group(self, tree) -> tuple[int, int, int]:
        """(header, tree, heap)."""
        names = sorted(n for n in tree if not n.startswith("@"))
        places, heap = {}, bytearray(8)
        for n in names:
            places[n] = len(heap)
            heap += pad(n.encode() + b"\0")
        addresses = {n: self.group(tree[n])[0] if isinstance(tree[n], dict) else self.dataset(tree[n]) for n in names}
        segment = self.put(bytes(heap))
        heap_at = self.put(b"HEAP" + struct.pack("<B3xQQQ", 0, len(heap), NONE, segment))
        nodes = []
        for k in range(0, len(names), 3):
            part = names[k : k + 3]
            nodes.append(self.put(b"SNOD" + struct.pack("<BxH", 1, len(part)) + b"".join(struct.pack("<QQI4x16x", places[n], addresses[n], 0) for n in part)))
        body = struct.pack("<Q", 0) + b"".join(struct.pack("<QQ", at, places[names[min(len(names) - 1, 3 * k + 2)]]) for k, at in enumerate(nodes))
        tree_at = self.put(b"TREE" + struct.pack("<BBHQQ", 0, 0, len(nodes), NONE, NONE) + body)
        header = self.header([(0x11, struct.pack("<QQ", tree_at, heap_at)), *self.attributes({n[1:]: v for n, v in tree.items() if n.startswith("@")})])
        return header, tree_at, heap_at

    def save(self, path, tree) -> str:
        header, tree_at, heap_at = self.group(tree)
        head = b"\x89HDF\r\n\x1a\n" + struct.pack("<BBBxBBBxHHI", 0, 0, 0, 0, 8, 8, 4, 16, 0)
        head += struct.pack("<QQQQ", 0, NONE, len(self.out), NONE) + struct.pack("<QQI4xQQ", 0, header, 1, tree_at, heap_at)
        self.out[: len(head)] = head
        with open(path, "wb") as f:
            f.write(self.out)
        return str(path)


class Data:
    """A data set in chunks, with filters (2 shuffle, 1 deflate) and attributes."""

    def __init__(self, values, chunks=None, filters=(), attrs=None):
        self.values, self.chunks, self.filters, self.attrs = values, chunks, filters, attrs or {}


def save(path, tree) -> str:
    return Writer().save(path, tree)
