"""A bounded cache of extracted regions, and several views under one budget."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators.folds import lru_victims
from ..sources.shared import Store
from .cost import Budget, parse_size


@dataclass
class Staged:
    """One cached extract."""

    key: str
    source: str
    signature: str
    bytes: int
    accessed: float
    pinned: bool = False


class StagingFull(RuntimeError):
    """No room even after evicting all that isn't pinned; nothing was evicted."""


class Staging:
    """Extracts as Parquet folders in any store Spark writes to, up to a capacity; the least recently used ones that aren't pinned make
    room, all needed or none. The index is one small text beside them."""

    INDEX = "index.json"

    def __init__(self, spark: SparkSession, path: str, capacity: str | int = "50GB"):
        self.spark, self.capacity = spark, parse_size(capacity)
        self.store = Store(spark, path)
        self.index: dict[str, Staged] = {}
        if self.store.exists(self.INDEX):
            self.index = {k: Staged(**v) for k, v in json.loads(self.store.read(self.INDEX)).items() if self.store.exists(k)}

    def _save(self) -> None:
        self.store.write(self.INDEX, json.dumps({k: asdict(v) for k, v in self.index.items()}))

    @property
    def used(self) -> int:
        return sum(s.bytes for s in self.index.values())

    def put(self, key: str, make: Callable[[], DataFrame], source: str = "", signature: str = "", pin: bool = False) -> DataFrame:
        """The cached extract if source and signature are the same; else make, write and admit it."""
        have = self.index.get(key)
        if have and (have.source, have.signature) == (source, signature):
            return self.read(key)
        part = f".{key}.part"
        make().write.mode("overwrite").parquet(self.store.of(part))
        size = self.store.size(part)
        others = [(s.key, s.bytes, s.accessed, s.pinned) for s in self.index.values() if s.key != key]
        victims = lru_victims(others, size, self.capacity)
        if victims is None:
            self.store.delete(part)
            raise StagingFull(f"{size} bytes don't fit {self.capacity}")
        for v in [*victims, *([key] if have else [])]:
            self.evict(v)
        self.store.move(part, key)
        self.index[key] = Staged(key, source, signature, size, time.time(), pin)
        self._save()
        return self.read(key)

    def read(self, key: str) -> DataFrame:
        self.index[key].accessed = time.time()
        self._save()
        return self.spark.read.parquet(self.store.of(key))

    def pin(self, key: str, pinned: bool = True) -> None:
        self.index[key].pinned = pinned
        self._save()

    def evict(self, key: str) -> None:
        self.index.pop(key)
        self.store.delete(key)
        self._save()

    def report(self) -> DataFrame:
        return self.spark.createDataFrame([(s.key, s.source, s.bytes, s.accessed, s.pinned) for s in self.index.values()], "key string, source string, bytes long, accessed double, pinned boolean")


class Workspace:
    """Named views that share one byte budget; a failure in one is kept apart from the others."""

    def __init__(self, budget: str | int = "4GB"):
        self.budget = Budget(parse_size(budget))
        self.views: dict[str, object] = {}
        self.reserved: dict[str, int] = {}
        self.failed: dict[str, str] = {}

    def add(self, name: str, view, reserve: str | int) -> None:
        n = parse_size(reserve)
        if not self.budget.try_acquire(n):
            raise MemoryError(f"{n} bytes for {name}; {self.budget.available} are free")
        self.views[name], self.reserved[name] = view, n

    def drop(self, name: str) -> None:
        del self.views[name]
        self.budget.release(self.reserved.pop(name))

    def broadcast(self, f: Callable, only=None) -> dict[str, object]:
        """``f(view)`` on each; what fails is noted and left out."""
        out = {}
        for name, view in self.views.items():
            if only is None or name in only:
                try:
                    out[name] = f(view)
                except Exception as e:
                    self.failed[name] = f"{type(e).__name__}: {e}"
        return out

    def select(self, *bounds, only=None) -> None:
        self.views |= self.broadcast(lambda v: v.select(*bounds), only)

    def select_fraction(self, *bounds, only=None) -> None:
        self.views |= self.broadcast(lambda v: v.select_fraction(*bounds), only)


_CHILD = """
import pickle, sys
memory, payload = pickle.load(sys.stdin.buffer)
if memory:
    import resource
    resource.setrlimit(resource.RLIMIT_AS, (memory, memory))
try:
    f, args = pickle.loads(payload)
    out = (True, f(*args))
except BaseException as e:
    out = (False, f"{type(e).__name__}: {e}")
sys.stdout.buffer.write(b"\\0result" + pickle.dumps(out))
"""


def run_isolated(f: Callable, *args, timeout: float = 300, memory: str | int | None = None):
    """``f(*args)`` in a fresh interpreter of its own, with a time limit and a memory limit; its exception is raised here."""
    import pickle
    import subprocess
    import sys

    from pyspark import cloudpickle

    sent = pickle.dumps((parse_size(memory) if memory is not None else 0, cloudpickle.dumps((f, args))))
    try:
        done = subprocess.run([sys.executable, "-c", _CHILD], input=sent, capture_output=True, timeout=timeout)
    except subprocess.TimeoutExpired:
        raise TimeoutError(f"no result within {timeout} s") from None
    _, found, result = done.stdout.partition(b"\0result")
    if not found:
        raise MemoryError(f"the process died: {done.stderr.decode(errors='replace')[-300:]}")
    ok, value = pickle.loads(result)
    if not ok:
        raise RuntimeError(value)
    return value
