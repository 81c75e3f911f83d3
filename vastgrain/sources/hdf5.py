"""A reader of HDF5 containers, as far as expression matrices and spatial tables need it, written from the public file format.

Groups by symbol tables or compact links; fixed, float, enumerated, string (fixed and variable) and compound types;
compact, contiguous and chunked data (version 1 trees; single-chunk and implicit indexes of version 4); the deflate, shuffle,
checksum and LZF filters. Anything else is refused by name. A read touches only the chunks that hold the wanted rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from typing import BinaryIO

import numpy as np

SIGNATURE = b"\x89HDF\r\n\x1a\n"
NONE = 0xFFFFFFFFFFFFFFFF


class Unsupported(ValueError):
    """A feature of the format that isn't read here."""


def _u(data: bytes, at: int, n: int) -> int:
    return int.from_bytes(data[at : at + n], "little")


def _padded(n: int) -> int:
    return -(-n // 8) * 8


def lzf_decompress(data: bytes, size: int) -> bytes:
    """Literal runs and back references."""
    out, at = bytearray(), 0
    while at < len(data):
        control = data[at]
        at += 1
        if control < 32:
            out += data[at : at + control + 1]
            at += control + 1
            continue
        length = control >> 5
        if length == 7:
            length += data[at]
            at += 1
        begin = len(out) - ((control & 31) << 8) - data[at] - 1
        at += 1
        for k in range(length + 2):  # may overlap itself
            out.append(out[begin + k])
    if len(out) != size:
        raise ValueError("LZF data of another length")
    return bytes(out)


@dataclass
class Kind:
    """An element type: a numpy dtype, or strings of variable length (``vlen``)."""

    dtype: np.dtype
    size: int
    vlen: bool = False
    labels: dict[int, str] = field(default_factory=dict)


def _kind(data: bytes, at: int = 0) -> tuple[Kind, int]:
    """(type, end of its description)."""
    version, number = data[at] >> 4, data[at] & 15
    bits, size, body = _u(data, at + 1, 3), _u(data, at + 4, 4), at + 8
    order = ">" if bits & 1 else "<"
    if number == 0:
        return Kind(np.dtype(f"{order}{'i' if bits & 8 else 'u'}{size}"), size), body + 4
    if number == 1:
        return Kind(np.dtype(f"{order}f{size}"), size), body + 12
    if number == 3:
        return Kind(np.dtype(f"S{size}"), size), body
    if number == 6:
        names, kinds, offsets = [], [], []
        for _ in range(bits & 0xFFFF):
            end = data.index(b"\0", body)
            names.append(data[body:end].decode())
            body = end + 1 if version >= 3 else body + _padded(end + 1 - body)
            width = 4 if version < 3 else max(1, (size.bit_length() + 7) // 8)
            offsets.append(_u(data, body, width))
            body += width
            if version == 1:
                body += 28
            kind, body = _kind(data, body)
            kinds.append(kind)
        return Kind(np.dtype({"names": names, "formats": [k.dtype for k in kinds], "offsets": offsets, "itemsize": size}), size), body
    if number == 8:
        base, body = _kind(data, body)
        names = []
        for _ in range(bits & 0xFFFF):
            end = data.index(b"\0", body)
            names.append(data[body:end].decode())
            body = end + 1 if version >= 3 else body + _padded(end + 1 - body)
        values = np.frombuffer(data, base.dtype, len(names), body)
        return Kind(base.dtype, size, labels=dict(zip(values.tolist(), names, strict=True))), body + len(names) * base.size
    if number == 9:
        base, body = _kind(data, body)
        if bits & 15 != 1 and base.dtype.kind not in "SuiO":
            raise Unsupported("sequences of variable length")
        return Kind(np.dtype(f"V{size}"), size, vlen=True), body
    raise Unsupported(f"type class {number}")


def _shape(data: bytes) -> tuple[int, ...]:
    version, rank = data[0], data[1]
    at = 8 if version == 1 else 4
    return tuple(_u(data, at + 8 * k, 8) for k in range(rank))


class Node:
    """A group or a data set."""

    def __init__(self, file: Hdf5, address: int):
        self.file, self.messages = file, list(file._messages(address))

    def _of(self, number: int) -> list[bytes]:
        return [data for n, data in self.messages if n == number]

    @property
    def attrs(self) -> dict:
        out = {}
        for data in self._of(0x0C):
            version = data[0]
            sizes = [_u(data, 2 + 2 * k, 2) for k in range(3)]
            at, parts = 8 if version < 3 else 9, []
            for n in sizes:
                parts.append(data[at : at + n])
                at += _padded(n) if version == 1 else n
            kind, shape = _kind(parts[1])[0], _shape(parts[2])
            values = self.file._values(data[at : at + kind.size * int(np.prod(shape))], kind)
            name = parts[0].split(b"\0")[0].decode()
            out[name] = values.reshape(shape) if shape else (values[0] if len(values) else None)
        return out


class Group(Node):
    @property
    def links(self) -> dict[str, int]:
        out: dict[str, int] = {}
        for data in self._of(0x11):
            heap = self.file._heap(_u(data, 8, 8))
            for name, address in self.file._symbols(_u(data, 0, 8), heap):
                out[name] = address
        for data in self._of(0x06):
            flags, at = data[1], 2
            soft = False
            if flags & 8:
                soft, at = data[at] != 0, at + 1
            at += 8 if flags & 4 else 0
            at += 1 if flags & 16 else 0
            width = 1 << (flags & 3)
            n = _u(data, at, width)
            name = data[at + width : at + width + n].decode()
            if not soft:
                out[name] = _u(data, at + width + n, 8)
        for data in self._of(0x02):
            if _u(data, 2 + (8 if data[1] & 1 else 0), 8) != NONE:
                raise Unsupported("groups with dense links")
        return out

    def __contains__(self, path: str) -> bool:
        try:
            self[path]
        except KeyError:
            return False
        return True

    def __getitem__(self, path: str) -> Group | Dataset:
        node: Group | Dataset = self
        for name in filter(None, path.split("/")):
            links = node.links if isinstance(node, Group) else {}
            if name not in links:
                raise KeyError(f"{path}: no {name!r} among {sorted(links)}")
            node = self.file._node(links[name])
        return node


class Dataset(Node):
    def __init__(self, file: Hdf5, address: int):
        super().__init__(file, address)
        self.kind = _kind(self._of(0x03)[0])[0]
        self.shape = _shape(self._of(0x01)[0])
        self.layout = self._of(0x08)[0]
        self.filters = self._filters()

    def _filters(self) -> list[tuple[int, list[int]]]:
        out = []
        for data in self._of(0x0B):
            version, n = data[0], data[1]
            at = 8 if version == 1 else 2
            for _ in range(n):
                number = _u(data, at, 2)
                named = version == 1 or number >= 256
                length = _u(data, at + 2, 2) if named else 0
                at += 4 if named else 2
                count = _u(data, at + 2, 2)
                at += 4 + (_padded(length) if version == 1 else length)
                out.append((number, [_u(data, at + 4 * k, 4) for k in range(count)]))
                at += 4 * count + (4 if version == 1 and count % 2 else 0)
        return out

    def _unfiltered(self, data: bytes, mask: int, size: int) -> bytes:
        for k in reversed(range(len(self.filters))):
            number, values = self.filters[k]
            if mask >> k & 1:
                continue
            if number == 1:
                data = zlib.decompress(data)
            elif number == 2:
                width = values[0] if values else self.kind.size
                whole = len(data) // width * width
                data = np.frombuffer(data[:whole], np.uint8).reshape(width, -1).T.tobytes() + data[whole:]
            elif number == 3:
                data = data[:-4]
            elif number == 32000:
                data = lzf_decompress(data, size) if len(data) < size else data
            else:
                raise Unsupported(f"filter {number}")
        return data

    def _chunks(self) -> tuple[tuple[int, ...], Iterator[tuple[tuple[int, ...], int, int, int]]]:
        """(chunk shape, (offsets, address, stored bytes, mask) of each chunk)."""
        d, rank = self.layout, len(self.shape)
        if d[0] == 3:
            dims = tuple(_u(d, 11 + 4 * k, 4) for k in range(rank))
            return dims, self.file._chunk_tree(_u(d, 3, 8), rank)
        if d[0] != 4:
            raise Unsupported(f"layout version {d[0]}")
        flags, n, width = d[2], d[3], d[4]
        dims = tuple(_u(d, 5 + width * k, width) for k in range(n - 1))
        at = 5 + width * n
        index, at = d[at], at + 1
        size = self.kind.size * int(np.prod(dims))
        if index == 1:
            stored, mask = (size, 0) if not flags & 2 else (_u(d, at, 8), _u(d, at + 8, 4))
            return dims, iter([((0,) * rank, _u(d, at + (12 if flags & 2 else 0), 8), stored, mask)])
        if index == 2:
            grid = [range(0, s, c) for s, c in zip(self.shape, dims, strict=True)]
            places = np.stack(np.meshgrid(*grid, indexing="ij"), -1).reshape(-1, rank).tolist()
            base = _u(d, at, 8)
            return dims, ((tuple(p), base + size * k, size, 0) for k, p in enumerate(places))
        raise Unsupported(f"chunk index {index}")

    def read(self, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Rows [lo, hi) along the first axis; the whole of a scalar."""
        if not self.shape:
            return self.file._values(self._flat(0, 1), self.kind)[0]
        hi = self.shape[0] if hi is None else min(hi, self.shape[0])
        lo = min(lo, hi)
        row = int(np.prod(self.shape[1:], dtype=np.int64))
        if self.layout[1 if self.layout[0] >= 3 else 2] != 2:
            raw = self._flat(lo * row, (hi - lo) * row)
            return self.file._values(raw, self.kind).reshape((hi - lo, *self.shape[1:]))
        dims, chunks = self._chunks()
        out = np.zeros((hi - lo, *self.shape[1:]), object if self.kind.vlen else self.kind.dtype)
        for offsets, address, stored, mask in chunks:
            if offsets[0] >= hi or offsets[0] + dims[0] <= lo:
                continue
            raw = self._unfiltered(self.file._at(address, stored), mask, self.kind.size * int(np.prod(dims)))
            part = self.file._values(raw, self.kind).reshape(dims)
            begin, end = max(lo, offsets[0]), min(hi, offsets[0] + dims[0])
            inner = tuple(slice(o, min(o + c, s)) for o, c, s in zip(offsets[1:], dims[1:], self.shape[1:], strict=True))
            cut = tuple(slice(0, s.stop - s.start) for s in inner)
            out[(slice(begin - lo, end - lo), *inner)] = part[(slice(begin - offsets[0], end - offsets[0]), *cut)]
        return out

    def _flat(self, first: int, n: int) -> bytes:
        d, size = self.layout, self.kind.size
        if d[0] < 3:
            raise Unsupported(f"layout version {d[0]}")
        if d[1] == 0:
            return d[4 + first * size : 4 + (first + n) * size]
        address = _u(d, 2, 8)
        return bytes(n * size) if address == NONE else self.file._at(address + first * size, n * size)


class Hdf5(Group):
    """An open file: its root group. ``source`` is a path or any object that reads and seeks."""

    def __init__(self, source: str | BinaryIO):
        self.handle = open(source, "rb") if isinstance(source, str) else source
        self.base = next((at for at in (0, 512, 1024, 2048) if self._raw(at, 8) == SIGNATURE), -1)
        if self.base < 0:
            raise ValueError("not an HDF5 file")
        head = self._raw(self.base, 128)
        version = head[8]
        width = head[13:15] if version < 2 else head[9:11]
        if bytes(width) != b"\x08\x08":
            raise Unsupported(f"offsets of {tuple(width)} bytes")
        self.collections: dict[int, dict[int, bytes]] = {}
        if version < 2:
            address = _u(head, (24 if version == 0 else 28) + 4 * 8 + 8, 8)
        else:
            address = _u(head, 12 + 3 * 8, 8)
        super().__init__(self, address)

    def __enter__(self) -> Hdf5:
        return self

    def __exit__(self, *_) -> None:
        self.handle.close()

    def _raw(self, at: int, n: int) -> bytes:
        self.handle.seek(at)
        return self.handle.read(n)

    def _at(self, address: int, n: int) -> bytes:
        data = self._raw(self.base + address, n)
        if len(data) != n:
            raise ValueError("the file ends too early")
        return data

    def _node(self, address: int) -> Group | Dataset:
        return Dataset(self, address) if any(n == 0x08 for n, _ in self._messages(address)) else Group(self, address)

    def _messages(self, address: int) -> Iterator[tuple[int, bytes]]:
        start = self._raw(self.base + address, 16)
        if start[:4] == b"OHDR":
            flags = start[5]
            at = address + 6 + (16 if flags & 0x20 else 0) + (4 if flags & 0x10 else 0)
            width = 1 << (flags & 3)
            blocks = [(at + width, _u(self._at(at, width), 0, width))]
            head = 4 + (2 if flags & 4 else 0)
            while blocks:
                begin, n = blocks.pop(0)
                data, k = self._at(begin, n), 0
                while k + head <= n:
                    number, size = data[k], _u(data, k + 1, 2)
                    body = data[k + head : k + head + size]
                    if number == 0x10:
                        blocks.append((_u(body, 0, 8) + 4, _u(body, 8, 8) - 8))  # between its signature and checksum
                    else:
                        yield number, body
                    k += head + size
            return
        if start[0] != 1:
            raise Unsupported(f"object header version {start[0]}")
        blocks = [(address + 16, _u(start, 8, 4))]
        while blocks:
            begin, n = blocks.pop(0)
            data, k = self._at(begin, n), 0
            while k + 8 <= n:
                number, size = _u(data, k, 2), _u(data, k + 2, 2)
                body = data[k + 8 : k + 8 + size]
                if number == 0x10:
                    blocks.append((_u(body, 0, 8), _u(body, 8, 8)))
                elif number:
                    yield number, body
                k += 8 + size

    def _heap(self, address: int) -> bytes:
        head = self._at(address, 32)
        return self._at(_u(head, 24, 8), _u(head, 8, 8))

    def _symbols(self, address: int, heap: bytes) -> Iterator[tuple[str, int]]:
        head = self._at(address, 24)
        if head[:4] == b"SNOD":
            n = _u(head, 6, 2)
            data = self._at(address + 8, 40 * n)
            for k in range(n):
                name = _u(data, 40 * k, 8)
                yield heap[name : heap.index(b"\0", name)].decode(), _u(data, 40 * k + 8, 8)
            return
        n = _u(head, 6, 2)
        data = self._at(address + 24, 16 * n + 8)
        for k in range(n):
            yield from self._symbols(_u(data, 16 * k + 8, 8), heap)

    def _chunk_tree(self, address: int, rank: int) -> Iterator[tuple[tuple[int, ...], int, int, int]]:
        if address == NONE:
            return
        head = self._at(address, 24)
        level, n, width = head[5], _u(head, 6, 2), 8 + 8 * (rank + 1)
        data = self._at(address + 24, n * (width + 8))
        for k in range(n):
            at = k * (width + 8)
            child = _u(data, at + width, 8)
            if level:
                yield from self._chunk_tree(child, rank)
            else:
                yield tuple(_u(data, at + 8 + 8 * i, 8) for i in range(rank)), child, _u(data, at, 4), _u(data, at + 4, 4)

    def _object(self, address: int, index: int) -> bytes:
        if address not in self.collections:
            size = _u(self._at(address, 16), 8, 8)
            data, at, held = self._at(address, size), 16, {}
            while at + 16 <= size:
                number, length = _u(data, at, 2), _u(data, at + 8, 8)
                if not number:
                    break
                held[number] = data[at + 16 : at + 16 + length]
                at += 16 + _padded(length)
            self.collections[address] = held
        return self.collections[address].get(index, b"")

    def _values(self, raw: bytes, kind: Kind) -> np.ndarray:
        if not kind.vlen:
            return np.frombuffer(raw, kind.dtype)
        out = np.empty(len(raw) // 16, object)
        for k in range(len(out)):
            n, address, index = struct.unpack_from("<IQI", raw, 16 * k)
            out[k] = self._object(address, index)[:n].decode("utf-8", "replace") if n else ""
        return out


def texts(values: np.ndarray, missing: Sequence[str] = ()) -> list[str | None]:
    """Strings out of bytes or objects; nulls stay null, and so do the names in ``missing``."""
    out: list[str | None] = []
    for v in values.tolist():
        if isinstance(v, bytes):
            v = v.split(b"\0")[0].decode("utf-8", "replace")
        text = None if v is None or v != v else str(v)
        out.append(None if text in missing else text)
    return out
