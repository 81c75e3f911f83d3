"""Parquet files over HTTP by ranges, and listings of remote trees.

:class:`RangedFile` reads a remote file through a bounded cache of blocks and counts what it transfers.
``spark.read.format("http_parquet")`` reads remote Parquet files: the driver fetches the footers, each row group that can hold
what is asked for becomes a partition, and a task fetches the chunks of the wanted columns only. A file is named by
its URL alone, so a lost task reads again.
"""

from __future__ import annotations

import io
import json
import re
import time
import urllib.error
import urllib.request
from collections import OrderedDict
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from html.parser import HTMLParser
from urllib.parse import unquote, urljoin, urlsplit

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a block, of the cache, and of the first read of a footer.
BLOCK = 1 << 20
CACHE = 64 << 20
FOOTER = 64 << 10
TRIES = 3


class RangeRefused(OSError):
    """The server answered with something else than the range it was asked for."""


def _get(url: str, headers: dict[str, str], timeout: float) -> tuple[int, dict[str, str], bytes]:
    with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout) as answer:
        return answer.status, {k.lower(): v for k, v in answer.headers.items()}, answer.read()


class RangedFile(io.RawIOBase):
    """A remote file that can be read and sought. Its size comes with the first answer; a short answer is asked for again."""

    def __init__(self, url: str, size: int | None = None, token: str | None = None, block: int = BLOCK, cache: int = CACHE, timeout: float = 60.0):
        self.url, self.token, self.block, self.timeout = url, token, block, timeout
        self.limit = max(1, cache // block)
        self.blocks: OrderedDict[int, bytes] = OrderedDict()
        self.bytes_fetched = self.fetches = 0
        self.at = 0
        self.tail = b""
        self.length = size
        if size is None:
            self.tail = self._fetch(f"bytes=-{FOOTER}", None)

    def _headers(self, wanted: str) -> dict[str, str]:
        return {"Range": wanted} | ({"Authorization": f"Bearer {self.token}"} if self.token else {})

    def _fetch(self, wanted: str, begin: int | None, count: int = 0) -> bytes:
        for left in reversed(range(TRIES)):
            try:
                status, headers, data = _get(self.url, self._headers(wanted), self.timeout)
            except urllib.error.HTTPError as e:
                if e.code < 500 or not left:
                    raise
                time.sleep(0.2)
                continue
            except (urllib.error.URLError, TimeoutError, ConnectionError):
                if not left:
                    raise
                time.sleep(0.2)
                continue
            self.fetches += 1
            self.bytes_fetched += len(data)
            told = re.fullmatch(r"bytes (\d+)-(\d+)/(\d+)", headers.get("content-range", ""))
            if status != 206 or not told:
                raise RangeRefused(f"{self.url}: no range in the answer")
            first, last, size = map(int, told.groups())
            if begin is not None and first != begin:
                raise RangeRefused(f"{self.url}: asked for {begin}, got {first}")
            if self.length is None:
                self.length = size
            if len(data) == last - first + 1 and (begin is None or len(data) == count):
                return data
            if not left:
                raise RangeRefused(f"{self.url}: {len(data)} bytes of {last - first + 1}")
        raise AssertionError

    def _block(self, k: int) -> bytes:
        held = self.blocks.get(k)
        if held is None:
            begin, end = k * self.block, min(self.length, (k + 1) * self.block)
            held = self._fetch(f"bytes={begin}-{end - 1}", begin, end - begin)
            self.blocks[k] = held
            while len(self.blocks) > self.limit:
                self.blocks.popitem(last=False)
        else:
            self.blocks.move_to_end(k)
        return held

    def ranges(self, wanted: Sequence[tuple[int, int]], gap: int = 64 << 10) -> None:
        """Fetch spans (begin, end) ahead, those less than ``gap`` apart as one, into whole blocks of the cache."""
        spans: list[list[int]] = []
        for begin, end in sorted(wanted):
            if spans and begin - spans[-1][1] < gap:
                spans[-1][1] = max(spans[-1][1], end)
            else:
                spans.append([begin, end])
        for begin, end in spans:
            first, last = begin // self.block, -(-end // self.block)
            if last - first > self.limit or all(k in self.blocks for k in range(first, last)):
                continue
            lo, hi = first * self.block, min(self.length, last * self.block)
            data = self._fetch(f"bytes={lo}-{hi - 1}", lo, hi - lo)
            for k in range(first, last):
                self.blocks[k] = data[(k - first) * self.block : (k - first + 1) * self.block]

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = 0) -> int:
        self.at = max(0, offset + (0, self.at, self.length)[whence])
        return self.at

    def read(self, size: int = -1) -> bytes:
        end = self.length if size is None or size < 0 else min(self.length, self.at + size)
        if self.at >= end:
            return b""
        if self.at >= self.length - len(self.tail):
            out = self.tail[self.at - self.length + len(self.tail) :][: end - self.at]
        else:
            first, last = self.at // self.block, -(-end // self.block)
            out = b"".join(self._block(k) for k in range(first, last))[self.at - first * self.block :][: end - self.at]
        self.at += len(out)
        return out

    def readinto(self, buffer) -> int:
        data = self.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)

    def stats(self) -> dict[str, int]:
        return {"bytes": self.bytes_fetched, "fetches": self.fetches, "size": self.length}


def footers(urls: Sequence[str], token: str | None = None, workers: int = 16) -> list[tuple[pq.FileMetaData, dict[str, int]]]:
    """Footer and transfer of each file, fetched at the same time; a footer of up to 64 KB is one request."""

    def one(url: str):
        file = RangedFile(url, token=token)
        return pq.ParquetFile(file).metadata, file.stats()

    with ThreadPoolExecutor(min(workers, max(1, len(urls)))) as pool:
        return list(pool.map(one, urls))


@dataclass
class RowGroup(InputPartition):
    url: str
    group: int
    size: int


class HttpParquetSource(DataSource):
    """Options: ``path`` (a URL, or a JSON list of them), ``token``, ``columns`` (JSON list), and ``where``: a JSON list ``[column, low, high]``
    that passes row groups over by their statistics and keeps rows in the closed range; either bound may be null."""

    @classmethod
    def name(cls):
        return "http_parquet"

    def _urls(self) -> list[str]:
        path = self.options["path"]
        return json.loads(path) if path.startswith("[") else [path]

    def schema(self):
        from pyspark.sql.pandas.types import from_arrow_schema
        from pyspark.sql.types import StructType

        file = RangedFile(self._urls()[0], token=self.options.get("token"))
        whole = from_arrow_schema(pq.ParquetFile(file).schema_arrow)
        columns = json.loads(self.options["columns"]) if "columns" in self.options else whole.fieldNames()
        return StructType([whole[c] for c in columns])

    def reader(self, schema):
        return HttpParquetReader(self._urls(), dict(self.options), schema.fieldNames())


class HttpParquetReader(DataSourceReader):
    def __init__(self, urls: list[str], options: dict, columns: list[str]):
        self.urls, self.token, self.columns = urls, options.get("token"), columns
        self.where = json.loads(options["where"]) if "where" in options else None

    def _may_hold(self, footer: pq.FileMetaData, group: int) -> bool:
        if self.where is None:
            return True
        name, low, high = self.where
        for c in range(footer.num_columns):
            column = footer.row_group(group).column(c)
            if column.path_in_schema == name and column.statistics is not None and column.statistics.has_min_max:
                return (low is None or column.statistics.max >= low) and (high is None or column.statistics.min <= high)
        return True

    def partitions(self):
        return [RowGroup(url, g, stats["size"]) for url, (footer, stats) in zip(self.urls, footers(self.urls, self.token), strict=True) for g in range(footer.num_row_groups) if self._may_hold(footer, g)]

    def read(self, part: RowGroup) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        remote = RangedFile(part.url, token=self.token)
        file = pq.ParquetFile(remote)
        names = list(dict.fromkeys([*self.columns, *([self.where[0]] if self.where else [])]))
        group = file.metadata.row_group(part.group)
        spans = []
        for c in range(group.num_columns):
            column = group.column(c)
            if column.path_in_schema.split(".")[0] in names:
                begin = column.dictionary_page_offset or column.data_page_offset
                spans.append((begin, begin + column.total_compressed_size))
        remote.ranges(spans)
        for batch in file.iter_batches(row_groups=[part.group], columns=names):
            if self.where:
                name, low, high = self.where
                keep = pc.is_valid(batch.column(name))
                for bound, test in ((low, pc.greater_equal), (high, pc.less_equal)):
                    if bound is not None:
                        keep = pc.and_kleene(keep, test(batch.column(name), bound))
                batch = batch.filter(keep)
            yield batch.select(self.columns)


def open_urls(spark: SparkSession, urls: Sequence[str], columns: Sequence[str] | None = None, where: tuple | None = None, token: str | None = None) -> DataFrame:
    """Remote Parquet files of one schema as a DataFrame; ``where`` is (column, low, high)."""
    spark.dataSource.register(HttpParquetSource)
    reader = spark.read.format("http_parquet")
    for key, value in (("columns", columns), ("where", where)):
        if value is not None:
            reader = reader.option(key, json.dumps(list(value)))
    if token:
        reader = reader.option("token", token)
    return reader.load(json.dumps(list(urls)))


class _Links(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found: list[str] = []

    def handle_starttag(self, tag, attrs):
        self.found += [value for name, value in attrs if tag == "a" and name == "href" and value]


def list_tree(spark: SparkSession, url: str, max_depth: int = 6, max_files: int = 200_000, include: str | None = None, sizes: bool = True, timeout: float = 30.0) -> DataFrame:
    """``path, url, size`` of the files below an index page, level by level; ``include`` is a glob over paths.

    A folder's links that leave it are ignored. More than ``max_files`` files are an error, not a cut.
    """
    from fnmatch import fnmatch

    root = url if url.endswith("/") else url + "/"
    level, rows, seen = [root], [], {root}
    for _ in range(max_depth + 1):
        below = []
        for folder in level:
            page = _Links()
            page.feed(_get(folder, {}, timeout)[2].decode("utf-8", "replace"))
            for link in page.found:
                target = urljoin(folder, link.split("#")[0].split("?")[0])
                if not target.startswith(folder) or target in seen:
                    continue
                seen.add(target)
                if target.endswith("/"):
                    below.append(target)
                else:
                    path = unquote(urlsplit(target).path[len(urlsplit(root).path) :])
                    if include is None or fnmatch(path, include):
                        rows.append((path, target))
                        if len(rows) > max_files:
                            raise ValueError(f"more than {max_files} files below {url}")
        level = below
    table = spark.createDataFrame(rows, "path string, url string")
    return _with_sizes(table, timeout) if sizes else table.selectExpr("*", "cast(null as long) as size")


def _with_sizes(files: DataFrame, timeout: float) -> DataFrame:
    """Add ``size`` by a HEAD request a file, made by the tasks; null where the server doesn't tell."""

    def run(frames):
        for f in frames:
            sizes = []
            for u in f["url"]:
                try:
                    with urllib.request.urlopen(urllib.request.Request(u, method="HEAD"), timeout=timeout) as answer:
                        told = answer.headers.get("Content-Length")
                except OSError:
                    told = None
                sizes.append(int(told) if told else None)
            yield f.assign(size=sizes).astype({"size": "Int64"})

    return files.repartition(8).mapInPandas(run, "path string, url string, size long")
