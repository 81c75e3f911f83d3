import gzip
import json
import struct
import zlib

import numpy as np
import pytest

from vastgrain.sources import dispatch, images

CODES = {np.dtype("u1"): 1, np.dtype("u2"): 1, np.dtype("i2"): 2, np.dtype("f4"): 3, np.dtype("u4"): 1, np.dtype("f8"): 3}


def packbits(data):
    out = bytearray()
    for k in range(0, len(data), 100):
        part = data[k : k + 100]
        if len(part) > 2 and len(set(part)) == 1:
            out += bytes([257 - len(part), part[0]])
        else:
            out += bytes([len(part) - 1]) + part
    return bytes(out) + b"\x80"


def lzw(data):
    """Greedy codes, written bit by bit."""
    table, width, bits = {bytes([k]): k for k in range(256)}, 9, format(256, "09b")
    held, size = b"", 258
    for byte in data:
        longer = held + bytes([byte])
        if longer in table:
            held = longer
            continue
        bits += format(table[held], f"0{width}b")
        table[longer] = size
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        if size == 4095:
            bits += format(256, f"0{width}b")
            table, width, size = {bytes([k]): k for k in range(256)}, 9, 258
        held = bytes([byte])
    if held:
        bits += format(table[held], f"0{width}b")
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    bits += format(257, f"0{width}b")
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


PACK = {1: bytes, 5: lzw, 8: zlib.compress, 32773: packbits}


def write_tiff(path, planes, order="<", big=False, tile=None, compression=1, predictor=1, rows=5, description="", samples_last=False, reduced=None):
    """Pages of 2-D planes (or of y, x, samples) with tiles or strips."""
    word, count = ("Q", "Q") if big else ("I", "H")
    out = bytearray((b"II" if order == "<" else b"MM") + (struct.pack(order + "HHHQ", 43, 8, 0, 0) if big else struct.pack(order + "HI", 42, 0)))
    link = 8 if big else 4

    def coded(block):
        block = np.ascontiguousarray(block).astype(block.dtype.newbyteorder(order))
        if predictor == 2:
            block = np.concatenate([block[:, :1], np.diff(block, axis=1)], axis=1).astype(block.dtype)
        elif predictor == 3:
            flat = block.astype(block.dtype.newbyteorder(">")).reshape(len(block), -1)
            planes_of = flat.view(np.uint8).reshape(len(block), -1, block.dtype.itemsize).transpose(0, 2, 1).reshape(len(block), -1)
            block = np.concatenate([planes_of[:, :1], np.diff(planes_of, axis=1)], axis=1).astype(np.uint8)
        return PACK[compression](block.tobytes())

    def directory(a, next_link, subs=()):
        h, w, samples = (*a.shape, 1)[:3]
        dtype = a.dtype
        at, sizes = [], []
        if tile:
            for y in range(0, h, tile[0]):
                for x in range(0, w, tile[1]):
                    block = np.zeros((*tile, samples), dtype)
                    part = a.reshape(h, w, samples)[y : y + tile[0], x : x + tile[1]]
                    block[: part.shape[0], : part.shape[1]] = part
                    data = coded(block)
                    at.append(len(out))
                    sizes.append(len(data))
                    out.extend(data)
        else:
            for y in range(0, h, rows):
                data = coded(a.reshape(h, w, samples)[y : y + rows])
                at.append(len(out))
                sizes.append(len(data))
                out.extend(data)
        tags = [(256, 4, [w]), (257, 4, [h]), (258, 3, [8 * dtype.itemsize] * samples), (259, 3, [compression]), (262, 3, [1]), (270, 2, description.encode() + b"\0")]
        tags += [(277, 3, [samples]), (284, 3, [1]), (317, 3, [predictor]), (339, 3, [CODES[dtype.newbyteorder("=")]])]
        kind = 16 if big else 4
        tags += [(322, 4, [tile[1]]), (323, 4, [tile[0]]), (324, kind, at), (325, kind, sizes)] if tile else [(273, kind, at), (278, 4, [rows]), (279, kind, sizes)]
        if subs:
            tags.append((330, kind, list(subs)))
        entries = []
        for tag, kind_of, values in sorted(tags):
            raw = values if isinstance(values, bytes) else b"".join(struct.pack(order + {3: "H", 4: "I", 16: "Q"}[kind_of], v) for v in values)
            n = len(values)
            if len(raw) > link:
                out.extend(bytes(-len(out) % 8))
                place = len(out)
                out.extend(raw)
                raw = struct.pack(order + word, place)
            entries.append(struct.pack(order + "HH" + word, tag, kind_of, n) + raw.ljust(link, b"\0"))
        out.extend(bytes(-len(out) % 8))
        start = len(out)
        out.extend(struct.pack(order + count, len(entries)) + b"".join(entries))
        nxt = len(out)
        out.extend(struct.pack(order + word, 0))
        if next_link is not None:
            out[next_link : next_link + link] = struct.pack(order + word, start)
        return start, nxt

    where = 8 if big else 4
    for a in planes:
        subs = [directory(r, None)[0] for r in (reduced or [])]
        _, where = directory(a, where, subs)
    path.write_bytes(out)
    return str(path)


def pixels(df, name="channel"):
    return {(r[name], r.y, r.x): r.value for r in df.collect()}


def truth(planes):
    return {(c, y, x): float(a[y, x]) for c, a in enumerate(planes) for y, x in np.ndindex(a.shape)}


@pytest.mark.parametrize("order,big,tile,compression,predictor,dtype", [
    ("<", False, None, 1, 1, "u1"), (">", False, (16, 16), 8, 1, "u2"), ("<", True, (16, 32), 5, 2, "u2"), ("<", False, None, 32773, 1, "u1"), (">", True, (16, 16), 8, 3, "f4"), ("<", False, (16, 16), 5, 2, "u1"), ("<", False, None, 8, 3, "f8"),
])
def test_encodings(spark, tmp_path, order, big, tile, compression, predictor, dtype):
    rng = np.random.default_rng(3)
    planes = [(rng.integers(0, 200, (37, 41)) // 20 * (k + 1)).astype(dtype) for k in range(2)]
    path = write_tiff(tmp_path / "a.tif", planes, order, big, tile, compression, predictor)
    df = dispatch.load(spark, path, tiles=2)
    assert pixels(df) == truth(planes)


def test_window_reads_only_its_tiles(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(4)
    planes = [rng.integers(0, 60000, (100, 90)).astype("u2") for _ in range(3)]
    path = write_tiff(tmp_path / "a.tif", planes, tile=(16, 16))
    images.register(spark)
    df = spark.read.format("tiff").option("window", "[20, 40, 30, 50]").option("channel", 1).option("tiles", 1).load(path)
    assert df.rdd.getNumPartitions() == 2 * 3
    assert pixels(df) == {(1, y, x): float(planes[1][y, x]) for y in range(20, 40) for x in range(30, 50)}


def test_samples_levels_and_axes(spark, tmp_path):
    rng = np.random.default_rng(5)
    color = rng.integers(0, 255, (20, 30, 3)).astype("u1")
    path = write_tiff(tmp_path / "rgb.tif", [color], tile=(16, 16), compression=8, predictor=2)
    assert pixels(dispatch.load(spark, path)) == {(c, y, x): float(color[y, x, c]) for c in range(3) for y in range(20) for x in range(30)}
    assert set(c for c, _, _ in pixels(spark.read.format("tiff").option("channel", 2).load(path))) == {2}
    full, half = rng.integers(0, 9, (40, 40)).astype("u1"), rng.integers(0, 9, (20, 20)).astype("u1")
    path = write_tiff(tmp_path / "p.tif", [full], tile=(16, 16), reduced=[half], description='<Pixels DimensionOrder="XYCZT"/>')
    assert pixels(spark.read.format("tiff").option("level", 1).load(path)) == truth([half]) and pixels(spark.read.format("tiff").load(path)) == truth([full])
    page = images.pages(path)[0]
    assert images.axes_of(page.description, (1, 1, 2, 40, 40)) == "tzcyx" and images.axes_of("", (40, 40, 3)) == "yxs" and images.axes_of("", (5, 40, 40)) == "zyx" and images.axes_of("", (40, 40)) == "yx"
    (tmp_path / "x.tif").write_bytes(b"nothing at all")
    with pytest.raises(ValueError):
        images.pages(str(tmp_path / "x.tif"))


def test_zarr(spark, tmp_path):
    import zstandard

    rng = np.random.default_rng(6)
    a = rng.integers(0, 50, (3, 20, 17)).astype("<u2")
    for version, codec in ((2, "zlib"), (2, None), (2, "zstd"), (3, "gzip"), (3, "zstd"), (3, None)):
        folder = tmp_path / f"{version}{codec}.zarr"
        folder.mkdir()
        chunks = (2, 8, 8)
        if version == 2:
            meta = {"zarr_format": 2, "shape": a.shape, "chunks": chunks, "dtype": "<u2", "compressor": codec and {"id": codec}, "fill_value": 7, "order": "C", "filters": None}
            (folder / ".zarray").write_text(json.dumps(meta))
        else:
            codecs = [{"name": "bytes", "configuration": {"endian": "little"}}, *([{"name": codec}] if codec else [])]
            meta = {"zarr_format": 3, "shape": a.shape, "data_type": "uint16", "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": chunks}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "fill_value": 7, "codecs": codecs}
            (folder / "zarr.json").write_text(json.dumps(meta))
        want = {(z, y, x): float(a[z, y, x]) for z, y, x in np.ndindex(a.shape)}
        for place in np.ndindex(2, 3, 3):
            low = [p * c for p, c in zip(place, chunks, strict=True)]
            block = np.zeros(chunks, "<u2")
            part = a[tuple(slice(b, b + c) for b, c in zip(low, chunks, strict=True))]
            block[tuple(slice(0, n) for n in part.shape)] = part
            if place == (0, 1, 1):  # not stored
                want |= {k: 7.0 for k in want if k[0] < 2 and 8 <= k[1] < 16 and 8 <= k[2] < 16}
                continue
            raw = block.tobytes()
            raw = zlib.compress(raw) if codec == "zlib" else gzip.compress(raw) if codec == "gzip" else zstandard.compress(raw) if codec == "zstd" else raw
            file = folder / (".".join(map(str, place)) if version == 2 else "c/" + "/".join(map(str, place)))
            file.parent.mkdir(parents=True, exist_ok=True)
            file.write_bytes(raw)
        assert pixels(dispatch.load(spark, str(folder)), "z") == want
    few = spark.read.format("zarr").option("window", "[1, 2, 3, 9, 10, 17]").load(str(folder))
    assert pixels(few, "z") == {k: v for k, v in want.items() if k[0] == 1 and 3 <= k[1] < 9 and 10 <= k[2] < 17}
    assert few.rdd.getNumPartitions() == 1 and pixels(spark.read.format("zarr").option("fill", "false").load(str(folder)), "z") == {k: v for k, v in want.items() if v != 7}


def dicom(path, elements, pixels_of, syntax=images.EXPLICIT):
    """Elements of strings and numbers, in the named transfer syntax."""

    def element(tag, vr, value, explicit=True):
        value += b" " * (len(value) % 2)
        head = struct.pack("<HH", *tag)
        if not explicit:
            return head + struct.pack("<I", len(value)) + value
        return head + vr + (struct.pack("<HI", 0, len(value)) if vr in images.LONG else struct.pack("<H", len(value))) + value

    body = b""
    for tag, (vr, value) in sorted({**elements, images.PIXELS: (b"OW", pixels_of.tobytes())}.items()):
        raw = value if isinstance(value, bytes) else struct.pack("<H", value) if isinstance(value, int) else value.encode()
        body += element(tag, vr, raw, syntax == images.EXPLICIT)
    sequence = struct.pack("<HH", 8, 0x1140) + b"SQ\0\0\xff\xff\xff\xff" + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0) if syntax == images.EXPLICIT else b""
    path.write_bytes(bytes(128) + b"DICM" + element(images.SYNTAX, b"UI", syntax.encode()) + sequence + body)


def test_dicom_series(spark, tmp_path):
    rng = np.random.default_rng(7)
    planes = [rng.integers(-500, 500, (6, 5)).astype("<i2") for _ in range(4)]
    folder = tmp_path / "s"
    folder.mkdir()
    for k, name in zip((2, 0, 3, 1), "abcd", strict=True):
        head = {images.SERIES: (b"UI", "1.2"), images.INSTANCE: (b"IS", str(9 - k)), images.POSITION: (b"DS", f"0\\0\\{k * 2.5}"), images.ORIENTATION: (b"DS", "1\\0\\0\\0\\1\\0"), images.ROWS: (b"US", 6), images.COLUMNS: (b"US", 5), images.DEPTH: (b"US", 16), images.SIGNED: (b"US", 1), images.SLOPE: (b"DS", "2"), images.INTERCEPT: (b"DS", "-10.5")}
        dicom(folder / f"{name}.dcm", head, planes[k], images.EXPLICIT if k % 2 else images.IMPLICIT)
    (folder / "notes.txt").write_text("no image")
    df = dispatch.load(spark, str(folder), format="dicom")
    assert df.rdd.getNumPartitions() == 4
    assert pixels(df, "z") == {(z, y, x): float(v) * 2 - 10.5 for z, a in enumerate(planes) for (y, x), v in np.ndenumerate(a)}
    other = {images.SERIES: (b"UI", "1.3"), images.INSTANCE: (b"IS", "1"), images.ROWS: (b"US", 6), images.COLUMNS: (b"US", 5), images.DEPTH: (b"US", 16), images.SIGNED: (b"US", 0)}
    dicom(folder / "z.dcm", other, planes[0].astype("<u2"))
    with pytest.raises(ValueError, match="1.3"):
        images.series_slices(str(folder))
    assert pixels(spark.read.format("dicom").option("series", "1.3").load(str(folder)), "z")[(0, 0, 0)] == float(planes[0].astype("<u2")[0, 0])
    with pytest.raises(images.Refused):
        images.dicom_elements(bytes(128) + b"DICM" + struct.pack("<HH2sH", 2, 16, b"UI", 22) + b"1.2.840.10008.1.2.4.50" + bytes(20))
