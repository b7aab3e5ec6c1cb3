"""Small shared state: a log of generations, and what is kept in one: the active build, id ranges, job locks.

A generation is one small file that is never changed: it is written whole under a name of its own and
then put to its number, which fails if another caller was first. So whoever takes a state
from generation g to g + 1 has read g, and there is one of them. Old generations go when
they are far behind, the oldest first; a caller so late that what it read is gone has lost.

Paths are local, or of any store that Spark reaches (`hdfs:`, `viewfs:`, `file:`), for which a session is given.
"""

from __future__ import annotations

import json
import os
import re
import time
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

KEPT_GENERATIONS = 64


class _Local:
    """Files that this machine reaches itself; linking to a name that is there fails."""

    def __init__(self, root: str) -> None:
        self.root = Path(root)
        self.root.mkdir(parents=True, exist_ok=True)

    def names(self) -> list[str]:
        return os.listdir(self.root)

    def exists(self, name: str) -> bool:
        return (self.root / name).exists()

    def read(self, name: str) -> str:
        return (self.root / name).read_text()

    def put(self, name: str, body: str) -> bool:
        own = self.root / f".{uuid.uuid4().hex}"
        own.write_text(body)
        try:
            os.link(own, self.root / name)
            return True
        except FileExistsError:
            return False
        finally:
            own.unlink()

    def delete(self, name: str) -> None:
        (self.root / name).unlink(missing_ok=True)


class _Store:
    """Files of a store that Spark reaches; a rename to a name that is there fails, in one step, as on HDFS."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.gateway = spark.sparkContext._gateway
        self.hadoop = self.gateway.jvm.org.apache.hadoop.fs
        self.root = self.hadoop.Path(root)
        conf = spark._jsc.hadoopConfiguration()
        self.fs = self.root.getFileSystem(conf)
        self.context = self.hadoop.FileContext.getFileContext(self.fs.getUri(), conf)
        self.fs.mkdirs(self.root)

    def _at(self, name: str) -> object:
        return self.hadoop.Path(self.root, name)

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.root)]

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._at(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        except Exception as e:
            raise FileNotFoundError(name) from e
        finally:
            stream.close()

    def put(self, name: str, body: str) -> bool:
        own, kind = self._at(f".{uuid.uuid4().hex}"), getattr(self.hadoop, "Options$Rename")
        stream = self.fs.create(own, False)
        stream.write(bytearray(body.encode()))
        stream.close()
        mode = self.gateway.new_array(kind, 1)
        mode[0] = kind.NONE
        try:
            self.context.rename(own, self._at(name), mode)
            return True
        except Exception as e:  # what the store throws comes wrapped
            self.fs.delete(own, False)
            if "FileAlreadyExistsException" not in str(e):
                raise
            return False

    def delete(self, name: str) -> None:
        self.fs.delete(self._at(name), False)


def shared(root: str, spark: SparkSession | None = None) -> _Local | _Store:
    """The files below a folder. A path of Spark's that stands for a local one is used as such."""
    if spark is None or not re.match(r"[A-Za-z][\w+.-]*:", root):
        return _Local(root)
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    real = fs.resolvePath(path).toUri()
    return _Local(real.getPath()) if real.getScheme() == "file" else _Store(spark, root)


class Generations:
    """A value that changes by compare-and-set: put() succeeds for one caller of those that read the same top()."""

    def __init__(self, files: _Local | _Store, name: str) -> None:
        self.files, self.name = files, name

    def _numbers(self) -> list[int]:
        return sorted(int(m[1]) for n in self.files.names() if (m := re.fullmatch(rf"{re.escape(self.name)}-(\d+)", n)))

    def _file(self, number: int) -> str:
        return f"{self.name}-{number:012d}"

    def top(self) -> tuple[int, dict]:
        """(generation, value) of the latest; (0, {}) before the first."""
        while True:
            numbers = self._numbers()
            if not numbers:
                return 0, {}
            try:
                return numbers[-1], json.loads(self.files.read(self._file(numbers[-1])))
            except FileNotFoundError:  # fell far behind between the two steps
                continue

    def put(self, read: int, value: dict) -> bool:
        """Make value the generation after `read`, unless another caller has."""
        if not self.files.put(self._file(read + 1), json.dumps(value)):
            return False
        numbers = self._numbers()
        if read and read not in numbers or numbers[-1] > read + KEPT_GENERATIONS:  # numbers this old were used and cleared
            self.files.delete(self._file(read + 1))
            return False
        for old in numbers:
            if old > read + 1 - KEPT_GENERATIONS:
                break
            self.files.delete(self._file(old))
        return True


class VersionedTable:
    """Builds of a table below a folder: written beside the active one, checked, then made active in one step."""

    def __init__(self, root: str, spark: SparkSession | None = None) -> None:
        self.root, self.files = root.rstrip("/"), shared(root, spark)
        self.pointer = Generations(self.files, "current")

    def active(self) -> str | None:
        return self.pointer.top()[1].get("build")

    def completed(self, build: str) -> bool:
        return self.files.exists(f"build={build}/_SUCCESS")

    def path(self, build: str) -> str:
        return f"{self.root}/build={build}"

    def write(self, df: DataFrame, build: str) -> str:
        """Write (or write again) a build; equal builds replace each other."""
        df.write.mode("overwrite").parquet(self.path(build))
        return self.path(build)

    def activate(self, build: str, *checks: Callable[[], str | None]) -> None:
        """Make a written build active unless a check names a reason against it, or another became active while they ran."""
        if not self.completed(build):
            raise ValueError("build must be completed before activation")
        seen, _ = self.pointer.top()
        for check in checks:
            if reason := check():
                raise ValueError(reason)
        if not self.pointer.put(seen, {"build": build}):
            raise ValueError("another build was activated meanwhile")

    def read(self, spark: SparkSession) -> DataFrame | None:
        build = self.active()
        return spark.read.parquet(self.path(build)) if build else None


def _parted(path: str) -> tuple[str, str]:
    root, _, name = path.rstrip("/").rpartition("/")
    return root or ".", name


class IdAllocator:
    """Ids that are handed out once; a reservation that is not used stays spent."""

    def __init__(self, path: str, first: int = 0, spark: SparkSession | None = None) -> None:
        root, name = _parted(path)
        self.log, self.first = Generations(shared(root, spark), name), first

    def reserve(self, count: int) -> int:
        """The first of `count` ids; two callers never get equal ids."""
        while True:
            seen, value = self.log.top()
            start = value.get("next", self.first)
            if self.log.put(seen, {"next": start + count}):
                return start


class JobLock:
    """One holder at a time; a lock whose time is over may be taken, only its owner renews or frees it."""

    def __init__(self, path: str, spark: SparkSession | None = None) -> None:
        root, name = _parted(path)
        self.log = Generations(shared(root, spark), name)

    def acquire(self, owner: str, ttl_s: float, now: float | None = None) -> bool:
        now = time.time() if now is None else now
        seen, held = self.log.top()
        if held.get("owner") is not None and held["expires"] >= now:
            return False
        return self.log.put(seen, {"owner": owner, "expires": now + ttl_s})

    def _change(self, owner: str, value: dict) -> bool:
        seen, held = self.log.top()
        return held.get("owner") == owner and self.log.put(seen, value)

    def renew(self, owner: str, ttl_s: float, now: float | None = None) -> bool:
        """False, too, where another took the lock while this was asked."""
        return self._change(owner, {"owner": owner, "expires": (time.time() if now is None else now) + ttl_s})

    def release(self, owner: str) -> bool:
        return self._change(owner, {"owner": None, "expires": 0})
