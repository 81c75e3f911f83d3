"""Lossless array codecs: blockwise bit packing of integers, general bytes, sparse rows; a registry with conformance cases; pandas UDFs over them.

A block of 128 values is stored as offsets from its least value, or as zigzag deltas from its first, whichever needs fewer bits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 128


@dataclass(frozen=True)
class Encoded:
    """Packed bytes and what is needed to restore the array."""

    codec: str
    dtype: str
    shape: tuple[int, ...]
    data: bytes

    @property
    def raw_bytes(self) -> int:
        return int(np.prod(self.shape, dtype=np.int64)) * np.dtype(self.dtype).itemsize

    @property
    def ratio(self) -> float:
        return self.raw_bytes / max(1, len(self.data))


def _pack(values: np.ndarray, width: int) -> bytes:
    """Unsigned 64-bit values at ``width`` bits each, lowest bit first."""
    if not width:
        return b""
    bits = (values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).reshape(-1), bitorder="little").tobytes()


def _unpack(data: bytes, width: int, n: int) -> np.ndarray:
    if not width:
        return np.zeros(n, np.uint64)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: n * width].reshape(n, width).astype(np.uint64)
    return (bits << np.arange(width, dtype=np.uint64)).sum(1, dtype=np.uint64)


def _width(values: np.ndarray) -> int:
    return int(values.max()).bit_length() if len(values) else 0


class Bitpack:
    """Integers (and floats that hold integers) in blocks of 128. Wrap-around arithmetic makes every 64-bit value safe."""

    name = "bitpack"

    def accepts(self, a: np.ndarray) -> bool:
        if a.dtype.kind in "iub":
            return True
        if a.dtype.kind != "f" or not np.isfinite(a).all():
            return False
        return bool((a == np.rint(a)).all() and (np.abs(a) < 2**53).all() and not (np.signbit(a) & (a == 0)).any())

    def encode(self, a: np.ndarray) -> Encoded:
        v = a.reshape(-1).astype(np.int64).view(np.uint64) if a.dtype.kind != "u" else a.reshape(-1).astype(np.uint64)
        out = bytearray()
        for lo in range(0, len(v), BLOCK):
            b = v[lo : lo + BLOCK]
            signed = b.view(np.int64)
            low = np.uint64(int(signed.min()) & 0xFFFFFFFFFFFFFFFF)
            frame = b - low
            d = np.diff(signed)
            zig = ((d << 1) ^ (d >> 63)).view(np.uint64)
            wf, wd = _width(frame), _width(zig)
            if wd < wf:
                out += bytes([128 + wd]) + int(b[0]).to_bytes(8, "little") + _pack(zig, wd)
            else:
                out += bytes([wf]) + int(low).to_bytes(8, "little") + _pack(frame, wf)
        return Encoded(self.name, a.dtype.str, a.shape, bytes(out))

    def decode(self, e: Encoded) -> np.ndarray:
        n = int(np.prod(e.shape, dtype=np.int64))
        v = np.empty(n, np.uint64)
        at = 0
        for lo in range(0, n, BLOCK):
            k = min(BLOCK, n - lo)
            head, base = e.data[at], np.uint64(int.from_bytes(e.data[at + 1 : at + 9], "little"))
            at += 9
            width, delta = (head - 128, True) if head >= 128 else (head, False)
            m = k - 1 if delta else k
            size = (m * width + 7) // 8
            q = _unpack(e.data[at : at + size], width, m)
            at += size
            if delta:
                step = (q >> np.uint64(1)) ^ (np.uint64(0) - (q & np.uint64(1)))
                v[lo] = base
                v[lo + 1 : lo + k] = base + np.cumsum(step, dtype=np.uint64)
            else:
                v[lo : lo + k] = q + base
        dtype = np.dtype(e.dtype)
        return (v if dtype.kind == "u" else v.view(np.int64)).astype(dtype).reshape(e.shape)


class Deflate:
    """Any array, as compressed bytes."""

    name = "deflate"

    def accepts(self, a: np.ndarray) -> bool:
        return a.dtype.kind in "iubfSV"

    def encode(self, a: np.ndarray) -> Encoded:
        return Encoded(self.name, a.dtype.str, a.shape, zlib.compress(np.ascontiguousarray(a).tobytes(), 6))

    def decode(self, e: Encoded) -> np.ndarray:
        return np.frombuffer(zlib.decompress(e.data), e.dtype).reshape(e.shape).copy()


REGISTRY: dict[str, object] = {}


def register_codec(codec) -> None:
    """Add a codec after it has passed the conformance cases."""
    check_codec(codec)
    REGISTRY[codec.name] = codec


def conformance_cases(seed: int = 0) -> Iterator[np.ndarray]:
    rng = np.random.default_rng(seed)
    yield np.zeros(0, np.int32)
    yield np.array([np.iinfo(np.int64).min, np.iinfo(np.int64).max, 0, -1])
    yield np.array([0, np.iinfo(np.uint64).max], np.uint64)
    for n in (1, 127, 128, 129, 1000):
        yield rng.integers(0, 40, n).astype(np.uint16)
        yield np.sort(rng.integers(-(10**9), 10**9, n))
        yield rng.integers(-3, 3, (n, 2)).astype(np.int8)
        yield rng.poisson(1.0, n).astype(np.float32)
        yield rng.normal(size=n)


def check_codec(codec) -> None:
    """Every accepted case comes back bit for bit."""
    for a in conformance_cases():
        if codec.accepts(a):
            b = codec.decode(codec.encode(a))
            if b.dtype != a.dtype or b.shape != a.shape or b.tobytes() != a.tobytes():
                raise ValueError(f"{codec.name} fails on {a.dtype} {a.shape}")


def encode_any(a: np.ndarray) -> Encoded:
    """Bit packing where it fits, else bytes."""
    for codec in (REGISTRY["bitpack"], REGISTRY["deflate"]):
        if codec.accepts(a):
            return codec.encode(a)
    raise TypeError(f"no codec for {a.dtype}")


def decode_any(e: Encoded) -> np.ndarray:
    return REGISTRY[e.codec].decode(e)


register_codec(Bitpack())
register_codec(Deflate())


def pack_column(column):
    """A pandas UDF's result over array<bigint>: packed binary (bit packing)."""
    codec = REGISTRY["bitpack"]

    @F.pandas_udf("binary")
    def packed(parts: pd.Series) -> pd.Series:
        return parts.map(lambda a: None if a is None else len(a).to_bytes(4, "little") + codec.encode(np.asarray(a, np.int64)).data)

    return packed(column)


def unpack_column(column):
    """The inverse of :func:`pack_column`: array<bigint>."""
    codec = REGISTRY["bitpack"]

    @F.pandas_udf("array<bigint>")
    def unpacked(parts: pd.Series) -> pd.Series:
        return parts.map(lambda d: None if d is None else codec.decode(Encoded("bitpack", "<i8", (int.from_bytes(d[:4], "little"),), bytes(d[4:]))))

    return unpacked(column)


def ratio_report(arrays: DataFrame, name: str, values: str) -> DataFrame:
    """Raw and packed bytes and their ratio for named integer arrays."""
    sized = arrays.select(name, (F.size(values) * 8).cast("long").alias("raw"), F.octet_length(pack_column(F.col(values))).cast("long").alias("packed"))
    return sized.groupBy(name).agg(F.sum("raw").alias("raw"), F.sum("packed").alias("packed"), (F.sum("raw") / F.sum("packed")).alias("ratio"))



class PackedStore:
    """Named tables whose integer columns are held packed, as temporary views of stored Parquet under a byte budget.

    A table is packed in blocks of ``block`` rows by order; :meth:`get` unpacks it lazily. What is put over the budget is refused,
    and nothing is evicted that isn't asked for.
    """

    def __init__(self, spark: SparkSession, path: str, budget: int):
        self.spark, self.path, self.budget = spark, path.rstrip("/"), budget
        self.held: dict[str, tuple[int, int, list[str]]] = {}

    @property
    def used(self) -> int:
        return sum(packed for _, packed, _ in self.held.values())

    def put(self, name: str, table: DataFrame, order: str, block: int = 4096) -> float:
        """Pack integer columns of a table by blocks of ``order div block``; the ratio of raw to packed bytes."""
        columns = [f.name for f in table.schema if f.name != order and f.dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")]
        if not columns or set(table.columns) != {order, *columns}:
            raise TypeError(f"only integer columns can be packed, ordered by one of them: {table.dtypes}")
        rows = F.array_sort(F.collect_list(F.struct(order, *columns)))
        blocks = table.groupBy(F.expr(f"{order} div {block}").alias("block")).agg(rows.alias("r"))  # at most ``block`` values of the order a block
        packed = blocks.select("block", *[pack_column(F.col("r")[c].cast("array<bigint>")).alias(c) for c in (order, *columns)])
        packed.write.mode("overwrite").parquet(f"{self.path}/{name}")
        stored = self.spark.read.parquet(f"{self.path}/{name}")
        sizes = stored.agg(F.sum(sum((F.octet_length(c) for c in (order, *columns)), F.lit(0))).alias("packed")).first()
        raw, size = table.count() * 8 * (1 + len(columns)), int(sizes["packed"] or 0)
        if self.used - (self.held[name][1] if name in self.held else 0) + size > self.budget:
            self.evict(name)
            raise MemoryError(f"{size} packed bytes of {name}; {self.budget - self.used} are free")
        self.held[name] = (raw, size, [order, *columns])
        return raw / max(1, size)

    def get(self, name: str) -> DataFrame:
        """The table, unpacked as it is read."""
        columns = self.held[name][2]
        arrays = self.spark.read.parquet(f"{self.path}/{name}").select(*[unpack_column(F.col(c)).alias(c) for c in columns])
        return arrays.select(F.explode(F.arrays_zip(*columns)).alias("r")).select("r.*")

    def views(self, names: Sequence[str] | None = None) -> list[str]:
        """A SQL view of each table, by its name."""
        out = list(self.held if names is None else names)
        for name in out:
            self.get(name).createOrReplaceTempView(name)
        return out

    def evict(self, name: str) -> None:
        """Delete a table and its view."""
        context = self.spark.sparkContext
        folder = context._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
        self.held.pop(name, None)
        self.spark.catalog.dropTempView(name)

    def report(self) -> DataFrame:
        """``name, raw, packed, ratio`` of what is held."""
        rows = [(n, raw, packed, raw / max(1, packed)) for n, (raw, packed, _) in self.held.items()]
        return self.spark.createDataFrame(rows, "name string, raw long, packed long, ratio double")
