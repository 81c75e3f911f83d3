"""Python data sources for images and volumes: tiled or striped TIFF, Zarr arrays, and DICOM series.

A partition reads one window's worth of tiles, chunks or slices and yields ``(channel, y, x, value)`` or ``(z, y, x, value)`` rows.
Tiles outside the asked window are neither read nor decoded. Written from the public formats; compressions without
a decoder here are refused by name.
"""

from __future__ import annotations

import glob
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .readers import local_files

# TIFF field types (bytes, struct code) and tags.
TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 7: (1, "B"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d"), 13: (4, "I"), 16: (8, "Q"), 17: (8, "q"), 18: (8, "Q")}
WIDTH, LENGTH, BITS, COMPRESSION, DESCRIPTION, STRIP_AT, SAMPLES, STRIP_ROWS, STRIP_BYTES, PLANAR = 256, 257, 258, 259, 270, 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_AT, TILE_BYTES, SUB_IFDS, FORMAT = 317, 322, 323, 324, 325, 330, 339


class Refused(ValueError):
    """An encoding that isn't read here."""


def packbits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + n + 2]
            at += n + 2
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


def lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first; 256 clears the table, 257 ends."""
    out: list[bytes] = []
    table = [bytes([k]) for k in range(256)] + [b"", b""]
    width, held, bits, before = 9, 0, 0, b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            del table[258:]
            width, before = 9, b""
            continue
        entry = table[code] if code < len(table) else before + before[:1]
        out.append(entry)
        if before:
            table.append(before + entry[:1])
        before = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)


def _zstd(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj().decompress(data)


DECODERS = {1: bytes, 5: lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: packbits, 50000: _zstd}


@dataclass
class Page:
    """One image of a file: its sizes, element type, and where its tiles (or strips) lie."""

    width: int
    length: int
    samples: int
    planar: bool
    dtype: np.dtype
    compression: int
    predictor: int
    tile: tuple[int, int]
    at: list[int]
    sizes: list[int]
    description: str
    subs: list[int]

    @property
    def across(self) -> int:
        return -(-self.width // self.tile[1])

    @property
    def down(self) -> int:
        return -(-self.length // self.tile[0])


def _ifd(data, at: int, order: str, big: bool) -> tuple[dict[int, tuple], int]:
    """(values by tag, place of the next directory)."""
    read = lambda pos, n: (data.seek(pos), data.read(n))[1]
    head, entry, word = (8, 20, "Q") if big else (2, 12, "I")
    n = struct.unpack(order + ("Q" if big else "H"), read(at, head))[0]
    raw = read(at + head, n * entry + (8 if big else 4))
    tags = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HH" + word, raw, k * entry)
        size, code = TYPES.get(kind, (1, "B"))
        inline = entry - (12 if big else 8)
        body = raw[k * entry + entry - inline : (k + 1) * entry]
        if size * count > inline:
            body = read(struct.unpack(order + word, body)[0], size * count)
        body = body[: size * count]
        tags[tag] = (body,) if code == "s" else struct.unpack(order + code * count, body)
    return tags, struct.unpack_from(order + word, raw, n * entry)[0]


def _page(tags: dict[int, tuple], order: str) -> Page:
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, length = one(WIDTH, 0), one(LENGTH, 0)
    bits, kind = one(BITS, 8), one(FORMAT, 1)
    if bits not in (8, 16, 32, 64):
        raise Refused(f"{bits} bits a sample")
    dtype = np.dtype(f"{order}{ {1: 'u', 2: 'i', 3: 'f'}.get(kind, 'u') }{bits // 8}")
    if TILE_AT in tags:
        tile, at, sizes = (one(TILE_LENGTH, 0), one(TILE_WIDTH, 0)), tags[TILE_AT], tags[TILE_BYTES]
    else:
        tile, at, sizes = (min(one(STRIP_ROWS, length), length), width), tags[STRIP_AT], tags[STRIP_BYTES]
    text = one(DESCRIPTION, b"").split(b"\0")[0].decode("utf-8", "replace")
    return Page(width, length, one(SAMPLES, 1), one(PLANAR, 1) == 2, dtype, one(COMPRESSION, 1), one(PREDICTOR, 1), tile, list(at), list(sizes), text, list(tags.get(SUB_IFDS, ())))


def pages(path: str) -> list[Page]:
    """The images of a TIFF or BigTIFF file, in order; only directories are read."""
    with open(path, "rb") as f:
        order, big, at = _start(f.read(16), path)
        out = []
        while at:
            tags, at = _ifd(f, at, order, big)
            out.append(_page(tags, order))
        return out


def _start(head: bytes, path: str) -> tuple[str, bool, int]:
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    version = struct.unpack(order + "H", head[2:4])[0] if order else 0
    if version not in (42, 43):
        raise ValueError(f"{path} is not TIFF")
    return order, version == 43, struct.unpack_from(order + "Q", head, 8)[0] if version == 43 else struct.unpack_from(order + "I", head, 4)[0]


def level_pages(path: str, page: Page) -> list[Page]:
    """A page and its reduced forms, the finest first."""
    with open(path, "rb") as f:
        order, big, _ = _start(f.read(16), path)
        return [page, *(_page(_ifd(f, at, order, big)[0], order) for at in page.subs)]


def decode_tile(f, page: Page, number: int) -> np.ndarray:
    """One tile as (rows, columns, samples); a strip at the end may have fewer rows, and a tile of no bytes is zeros."""
    decoder = DECODERS.get(page.compression)
    if decoder is None:
        raise Refused(f"compression {page.compression}")
    samples = 1 if page.planar else page.samples
    rows, columns = page.tile
    if not page.sizes[number]:
        return np.zeros((rows, columns, samples), page.dtype)
    f.seek(page.at[number])
    data = decoder(f.read(page.sizes[number]))
    row = columns * samples * page.dtype.itemsize
    tile = np.frombuffer(data[: len(data) // row * row], page.dtype).reshape(-1, columns, samples)
    if page.predictor == 2:
        tile = np.cumsum(tile, axis=1, dtype=page.dtype)
    elif page.predictor == 3:
        planes = np.cumsum(np.frombuffer(data, np.uint8).reshape(-1, row), axis=1, dtype=np.uint8)
        planes = planes.reshape(len(planes), page.dtype.itemsize, columns * samples)
        tile = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(page.dtype.newbyteorder(">")).reshape(-1, columns, samples)
    return tile[:rows]


@dataclass
class Tiles(InputPartition):
    path: str
    page: int
    level: int
    plane: int
    numbers: list[int]


class TiffSource(DataSource):
    """``channel, y, x, value`` of a tiled or striped TIFF. Options: ``page`` (default all, each a channel), ``level``, ``channel``,
    ``window`` (a JSON list y0, y1, x0, x1), ``tiles`` a partition (default 16)."""

    @classmethod
    def name(cls):
        return "tiff"

    def schema(self):
        return "channel int, y int, x int, value double"

    def reader(self, schema):
        return TiffReader(dict(self.options))


class TiffReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.window = json.loads(options["window"]) if "window" in options else None
        self.channel = int(options["channel"]) if "channel" in options else None

    def _pages(self, path: str) -> list[tuple[int, Page]]:
        level = int(self.options.get("level", 0))
        wanted = int(self.options["page"]) if "page" in self.options else None
        found = pages(path)
        if wanted is None:  # pages of other sizes are reduced forms or labels
            chosen = [k for k, p in enumerate(found) if (p.width, p.length) == (found[0].width, found[0].length)]
        else:
            chosen = [wanted]
        return [(k, level_pages(path, found[k])[level]) for k in chosen]

    def partitions(self):
        out, step = [], int(self.options.get("tiles", 16))
        path = local_files(self.options["path"])[0]
        channel = 0
        for k, page in self._pages(path):
            for s in range(page.samples if page.planar else 1):
                covered = range(channel, channel + (1 if page.planar else page.samples))
                if self.channel is None or self.channel in covered:
                    numbers = [n for n in range(page.across * page.down) if self._touches(page, n)]
                    out += [Tiles(path, k, channel, s, numbers[i : i + step]) for i in range(0, len(numbers), step)]
                channel += len(covered)
        return out or [Tiles(path, 0, 0, 0, [])]

    def _touches(self, page: Page, number: int) -> bool:
        if self.window is None:
            return True
        y0, y1, x0, x1 = self.window
        y, x = number // page.across * page.tile[0], number % page.across * page.tile[1]
        return y < y1 and y + page.tile[0] > y0 and x < x1 and x + page.tile[1] > x0

    def read(self, part: Tiles) -> Iterator[pa.RecordBatch]:
        if not part.numbers:
            return
        page = dict(self._pages(part.path))[part.page]
        y0, y1, x0, x1 = self.window or (0, page.length, 0, page.width)
        y0, y1, x0, x1 = max(0, y0), min(y1, page.length), max(0, x0), min(x1, page.width)
        with open(part.path, "rb") as f:
            for number in part.numbers:
                tile = decode_tile(f, page, number + part.plane * page.across * page.down)
                top, left = number // page.across * page.tile[0], number % page.across * page.tile[1]
                ys, xs = slice(max(y0, top) - top, min(y1, top + tile.shape[0]) - top), slice(max(x0, left) - left, min(x1, left + tile.shape[1]) - left)
                if ys.start >= ys.stop or xs.start >= xs.stop:
                    continue
                for s in range(tile.shape[2]):
                    if self.channel is not None and part.level + s != self.channel:
                        continue
                    values = tile[ys, xs, s]
                    y, x = np.meshgrid(np.arange(top + ys.start, top + ys.stop), np.arange(left + xs.start, left + xs.stop), indexing="ij")
                    yield pixels(part.level + s, y, x, values, "channel")


def pixels(first: int, y: np.ndarray, x: np.ndarray, values: np.ndarray, name: str) -> pa.RecordBatch:
    flat = values.ravel()
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(flat), first, np.int32)), pa.array(y.ravel().astype(np.int32)), pa.array(x.ravel().astype(np.int32)), pa.array(flat.astype(np.float64))], [name, "y", "x", "value"])


def axes_of(description: str, shape: tuple[int, ...]) -> str:
    """Axis names: those an OME description gives, else guessed: the last two are y and x, a last one of 3 or 4 is samples."""
    told = re.search(r'DimensionOrder="([XYZCT]{5})"', description)
    if told:
        return told[1][::-1].lower()[-len(shape) :]
    if len(shape) >= 3 and shape[-1] in (3, 4) and min(shape[-3:-1]) > 4:
        return "zct"[: max(0, len(shape) - 3)] + "yxs"
    return "tcz"[-(len(shape) - 2) :] * (len(shape) > 2) + "yx"


# ---- Zarr ----------------------------------------------------------------


@dataclass
class ZarrMeta:
    """Shape, chunk shape, element type, compressor, fill and the file name of a chunk, of a version 2 or 3 array."""

    shape: list[int]
    chunks: list[int]
    dtype: np.dtype
    codec: str
    fill: float
    order: str
    prefix: str
    separator: str


def zarr_meta(path: str) -> ZarrMeta:
    if os.path.exists(f"{path}/.zarray"):
        with open(f"{path}/.zarray") as f:
            m = json.load(f)
        if m.get("filters"):
            raise Refused("filters of a Zarr array")
        codec = (m.get("compressor") or {"id": "raw"})["id"]
        return ZarrMeta(m["shape"], m["chunks"], np.dtype(m["dtype"]), codec, m.get("fill_value") or 0, m.get("order", "C"), "", m.get("dimension_separator", "."))
    with open(f"{path}/zarr.json") as f:
        m = json.load(f)
    order, codec = "<", "raw"
    for c in m["codecs"]:
        if c["name"] == "bytes":
            order = ">" if c.get("configuration", {}).get("endian") == "big" else "<"
        elif c["name"] in ("gzip", "zstd"):
            codec = c["name"]
        elif c["name"] != "crc32c":
            raise Refused(f"codec {c['name']}")
    keys = m.get("chunk_key_encoding", {"name": "default"})
    default = keys["name"] == "default"
    separator = keys.get("configuration", {}).get("separator", "/" if default else ".")
    kind = {"bool": "u1"}.get(m["data_type"], {"u": "u", "i": "i", "f": "f"}[m["data_type"][0]] + str(int(re.sub(r"\D", "", m["data_type"]) or 8) // 8))
    return ZarrMeta(m["shape"], m["chunk_grid"]["configuration"]["chunk_shape"], np.dtype(order + kind), codec, m.get("fill_value") or 0, "C", f"c{separator}" if default else "", separator)


def zarr_chunk(path: str, meta: ZarrMeta, place: tuple[int, ...]) -> np.ndarray:
    """One chunk; one that isn't stored holds the fill value."""
    name = f"{path}/{meta.prefix}{meta.separator.join(map(str, place))}"
    if not os.path.exists(name):
        return np.full(meta.chunks, meta.fill, meta.dtype)
    with open(name, "rb") as f:
        data = f.read()
    if meta.codec in ("zlib", "gzip"):
        data = zlib.decompress(data, 47)
    elif meta.codec == "zstd":
        data = _zstd(data)
    elif meta.codec != "raw":
        raise Refused(f"compressor {meta.codec}")
    n = int(np.prod(meta.chunks))
    return np.frombuffer(data[: n * meta.dtype.itemsize], meta.dtype).reshape(meta.chunks, order=meta.order)


@dataclass
class Chunks(InputPartition):
    places: list[tuple[int, ...]]


class ZarrSource(DataSource):
    """``z, y, x, value`` of a Zarr array of two dimensions or more (leading ones run together into z). Options: ``window``
    (a JSON list of low, high for each dimension), ``chunks`` a partition (default 8), ``fill`` (false leaves out fill values)."""

    @classmethod
    def name(cls):
        return "zarr"

    def schema(self):
        return "z int, y int, x int, value double"

    def reader(self, schema):
        return ZarrReader(dict(self.options))


class ZarrReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].removeprefix("file://").rstrip("/")
        self.meta = zarr_meta(self.path)
        if len(self.meta.shape) < 2:
            raise Refused("a Zarr array of one dimension")
        flat = json.loads(options["window"]) if "window" in options else [b for s in self.meta.shape for b in (0, s)]
        self.window = [(max(0, flat[2 * k]), min(s, flat[2 * k + 1])) for k, s in enumerate(self.meta.shape)]
        self.step, self.fill = int(options.get("chunks", 8)), options.get("fill", "true") != "false"

    def partitions(self):
        spans = [range(lo // c, -(-hi // c)) for (lo, hi), c in zip(self.window, self.meta.chunks, strict=True)]
        places = [tuple(s[i] for s, i in zip(spans, at, strict=True)) for at in np.ndindex(*map(len, spans))]
        return [Chunks(places[i : i + self.step]) for i in range(0, len(places), self.step)] or [Chunks([])]

    def read(self, part: Chunks) -> Iterator[pa.RecordBatch]:
        for place in part.places:
            low = [p * c for p, c in zip(place, self.meta.chunks, strict=True)]
            begin = [max(lo, a) for (lo, _), a in zip(self.window, low, strict=True)]
            end = [min(hi, a + c) for (_, hi), a, c in zip(self.window, low, self.meta.chunks, strict=True)]
            part_of = zarr_chunk(self.path, self.meta, place)[tuple(slice(b - a, e - a) for a, b, e in zip(low, begin, end, strict=True))]
            grids = np.meshgrid(*[np.arange(b, e) for b, e in zip(begin, end, strict=True)], indexing="ij")
            z = np.zeros(part_of.shape, np.int64)
            for grid, size in zip(grids[:-2], self.meta.shape[:-2], strict=True):
                z = z * size + grid
            keep = np.ones(part_of.shape, bool) if self.fill else part_of != self.meta.fill
            yield pa.RecordBatch.from_arrays([pa.array(z[keep].astype(np.int32)), pa.array(grids[-2][keep].astype(np.int32)), pa.array(grids[-1][keep].astype(np.int32)), pa.array(part_of[keep].astype(np.float64))], ["z", "y", "x", "value"])


# ---- DICOM ---------------------------------------------------------------

# Value representations with a length of four bytes, and transfer syntaxes without compression.
LONG = {b"OB", b"OW", b"OF", b"OD", b"OL", b"SQ", b"UN", b"UT", b"UC", b"UR"}
IMPLICIT, EXPLICIT, BIG = "1.2.840.10008.1.2", "1.2.840.10008.1.2.1", "1.2.840.10008.1.2.2"
SERIES, INSTANCE, POSITION, ORIENTATION, ROWS, COLUMNS, DEPTH, SIGNED, INTERCEPT, SLOPE, SPACING, PIXELS, SYNTAX = (
    (0x20, 0x0E), (0x20, 0x13), (0x20, 0x32), (0x20, 0x37), (0x28, 0x10), (0x28, 0x11), (0x28, 0x100), (0x28, 0x103), (0x28, 0x1052), (0x28, 0x1053), (0x28, 0x30), (0x7FE0, 0x10), (2, 0x10),
)


def dicom_elements(data: bytes, pixels_too: bool = False) -> dict[tuple[int, int], bytes]:
    """Elements by (group, element) up to the pixels; sequences are passed over."""
    if data[128:132] != b"DICM":
        raise ValueError("not a DICOM file")
    out: dict[tuple[int, int], bytes] = {}
    at, syntax = 132, EXPLICIT
    while at + 8 <= len(data):
        meta = data[at : at + 2] == b"\x02\x00"
        if not meta and SYNTAX in out:
            syntax = out[SYNTAX].rstrip(b"\0 ").decode()
            if syntax not in (IMPLICIT, EXPLICIT, BIG):
                raise Refused(f"transfer syntax {syntax}")
        order = ">" if syntax == BIG and not meta else "<"
        tag = struct.unpack_from(order + "HH", data, at)
        if syntax == IMPLICIT and not meta:
            length, at = struct.unpack_from("<I", data, at + 4)[0], at + 8
        elif data[at + 4 : at + 6] in LONG:
            length, at = struct.unpack_from(order + "I", data, at + 8)[0], at + 12
        else:
            length, at = struct.unpack_from(order + "H", data, at + 6)[0], at + 8
        if tag == PIXELS and not pixels_too:
            out[tag] = b""
            return out
        if length == 0xFFFFFFFF:
            end = data.find(struct.pack(order + "HHI", 0xFFFE, 0xE0DD, 0), at)
            if end < 0:
                raise ValueError("a sequence without an end")
            at = end + 8
            continue
        out[tag] = data[at : at + length]
        at += length
    return out


@dataclass
class Slice(InputPartition):
    path: str
    z: int


@dataclass(frozen=True)
class DicomHeader:
    """What orders and scales a slice."""

    series: str
    number: int
    position: float | None
    rows: int
    columns: int
    dtype: str
    slope: float
    intercept: float

    @classmethod
    def of(cls, e: dict[tuple[int, int], bytes]) -> DicomHeader:
        text = lambda tag: e.get(tag, b"").rstrip(b"\0 ").decode("latin-1")
        order = ">" if text(SYNTAX) == BIG else "<"
        short = lambda tag, default=0: struct.unpack(order + "H", e[tag][:2])[0] if e.get(tag) else default
        numbers = lambda tag: [float(v) for v in text(tag).split("\\") if v.strip()]
        at, way = numbers(POSITION), numbers(ORIENTATION)
        # The place along the normal of the slice.
        position = float(np.dot(np.cross(way[:3], way[3:6]), at)) if len(at) == 3 and len(way) == 6 else None
        kind = f"{order}{'i' if short(SIGNED) else 'u'}{short(DEPTH, 16) // 8}"
        return cls(text(SERIES), int(float(text(INSTANCE) or 0)), position, short(ROWS), short(COLUMNS), kind, (numbers(SLOPE) or [1.0])[0], (numbers(INTERCEPT) or [0.0])[0])


def series_slices(folder: str, series: str | None = None) -> list[tuple[str, DicomHeader]]:
    """The slices of a series (the only one, unless named) by their place along the normal, or by number where a place is missing. Pixels aren't read."""
    found = []
    for path in sorted(p for p in glob.glob(f"{folder}/**", recursive=True) if os.path.isfile(p)):
        with open(path, "rb") as f:
            head = f.read(132)
            if head[128:] != b"DICM":
                continue
            found.append((path, DicomHeader.of(dicom_elements(head + f.read()))))
    names = sorted({h.series for _, h in found})
    if series is None and len(names) > 1:
        raise ValueError(f"{folder} has the series {names}; name one")
    chosen = [(p, h) for p, h in found if series in (None, h.series)]
    placed = all(h.position is not None for _, h in chosen)
    return sorted(chosen, key=lambda x: (x[1].position if placed else x[1].number, x[0]))


class DicomSource(DataSource):
    """``z, y, x, value`` of a series in a folder, a slice a partition, scaled by slope and intercept. Option: ``series``."""

    @classmethod
    def name(cls):
        return "dicom"

    def schema(self):
        return "z int, y int, x int, value double"

    def reader(self, schema):
        return DicomReader(dict(self.options))


class DicomReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.series = options["path"].removeprefix("file://"), options.get("series")

    def partitions(self):
        return [Slice(p, z) for z, (p, _) in enumerate(series_slices(self.folder, self.series))] or [Slice("", 0)]

    def read(self, part: Slice) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        with open(part.path, "rb") as f:
            elements = dicom_elements(f.read(), pixels_too=True)
        h = DicomHeader.of(elements)
        n = h.rows * h.columns
        values = np.frombuffer(elements[PIXELS], h.dtype, n).reshape(h.rows, h.columns) * h.slope + h.intercept
        y, x = np.meshgrid(np.arange(h.rows), np.arange(h.columns), indexing="ij")
        yield pixels(part.z, y, x, values, "z")


def register(spark: SparkSession) -> None:
    for source in (TiffSource, ZarrSource, DicomSource):
        spark.dataSource.register(source)
