"""Plain files beside Parquet: 32-bit pairs, numpy arrays, JSON, digests, and fetching dumps.

Pairs and arrays are Spark data sources that read byte ranges, so a large file is many tasks.
"""

from __future__ import annotations

import hashlib
import json
import os
import threading
import urllib.error
import urllib.request
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

RANGE = 64 << 20
#: Files of a dump that the chain reads.
DUMP_FILES = ("page", "redirect", "linktarget", "pagelinks", "categorylinks", "category", "pages-articles")


def _local(path: str) -> str:
    return path.removeprefix("file://")


class Span(InputPartition):
    def __init__(self, path: str, first: int, count: int, offset: int):
        super().__init__((path, first, count, offset))
        self.path, self.first, self.count, self.offset = path, first, count, offset


class ArrayReader(DataSourceReader):
    """Rows first .. first + count of a file of equal records, as Arrow batches."""

    def __init__(self, path: str, record: int, offset: int, rows: int, columns):
        self.path, self.record, self.offset, self.rows, self.columns = path, record, offset, rows, columns

    def partitions(self) -> list[Span]:
        per = max(1, RANGE // self.record)
        return [Span(self.path, lo, min(per, self.rows - lo), self.offset) for lo in range(0, self.rows, per)] or [Span(self.path, 0, 0, self.offset)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        with open(partition.path, "rb") as f:
            f.seek(partition.offset + partition.first * self.record)
            done = 0
            while done < partition.count:
                n = min(1 << 18, partition.count - done)
                yield self.columns(f.read(n * self.record), partition.first + done)
                done += n


class Pairs(DataSource):
    """format("int32pairs"): (src, dst) from little-endian 32-bit pairs in one file; writes a folder of such files."""

    @classmethod
    def name(cls) -> str:
        return "int32pairs"

    def schema(self) -> str:
        return "src int, dst int"

    def reader(self, schema) -> DataSourceReader:
        path = _local(self.options["path"])

        def columns(data: bytes, _: int) -> pa.RecordBatch:
            p = np.frombuffer(data, "<i4").reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(p[:, 0].copy()), pa.array(p[:, 1].copy())], ["src", "dst"])

        return ArrayReader(path, 8, 0, os.path.getsize(path) // 8, columns)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return PairWriter(_local(self.options["path"]))


class Written(WriterCommitMessage):
    def __init__(self, file: str):
        self.file = file


class PairWriter(DataSourceWriter):
    """Each task writes a file under a name of its own; only those of committed tasks are given their final names."""

    def __init__(self, path: str):
        self.path = path

    def write(self, rows: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        os.makedirs(self.path, exist_ok=True)
        task = TaskContext.get()
        out = Written(f".part-{task.partitionId():05d}-{task.taskAttemptId()}")
        with open(f"{self.path}/{out.file}", "wb") as f:
            held: list[tuple[int, int]] = []
            for r in rows:
                held.append((r[0], r[1]))
                if len(held) == 1 << 16:
                    f.write(np.array(held, "<i4").tobytes())
                    held.clear()
            f.write(np.array(held, "<i4").tobytes())
        return out

    def commit(self, messages: list[Written | None]) -> None:
        for m in filter(None, messages):
            os.replace(f"{self.path}/{m.file}", f"{self.path}/{m.file[1:].rsplit('-', 1)[0]}.bin")

    def abort(self, messages: list[Written | None]) -> None:
        for m in filter(None, messages):
            if os.path.exists(f"{self.path}/{m.file}"):
                os.remove(f"{self.path}/{m.file}")


class Npy(DataSource):
    """format("npy"): (idx, value) from a one-dimensional array of numbers in a .npy file, or in an .npz file under option key."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def _header(self) -> tuple[str, np.dtype, int, int]:
        path, key = _local(self.options["path"]), self.options.get("key")
        if key:  # a member of an archive is stored as a whole; unpacked beside it once, then read by ranges
            plain = f"{path}.{key}.npy"
            if not os.path.exists(plain) or os.path.getmtime(plain) < os.path.getmtime(path):
                with np.load(path) as z:
                    np.save(f"{plain}.tmp.npy", z[key])
                os.replace(f"{plain}.tmp.npy", plain)
            path = plain
        with open(path, "rb") as f:
            version = np.lib.format.read_magic(f)
            shape, _, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
            return path, dtype, int(np.prod(shape)), f.tell()

    def schema(self) -> str:
        _, dtype, _, _ = self._header()
        kind = {"i": "int" if dtype.itemsize <= 4 else "long", "u": "int" if dtype.itemsize <= 2 else "long", "f": "float" if dtype.itemsize == 4 else "double", "b": "boolean"}[dtype.kind]
        return f"idx long, value {kind}"

    def reader(self, schema) -> DataSourceReader:
        path, dtype, rows, offset = self._header()
        kind = {"int": pa.int32(), "long": pa.int64(), "float": pa.float32(), "double": pa.float64(), "boolean": pa.bool_()}[self.schema().split()[-1]]

        def columns(data: bytes, first: int) -> pa.RecordBatch:
            values = np.frombuffer(data, dtype)
            return pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(values))), pa.array(values.astype(kind.to_pandas_dtype()))], ["idx", "value"])

        return ArrayReader(path, dtype.itemsize, offset, rows, columns)


def register(spark: SparkSession) -> SparkSession:
    for source in (Pairs, Npy):
        spark.dataSource.register(source)
    return spark


def save_npy(values: DataFrame, path: str) -> int:
    """Writes (idx, value), idx from 0 without gaps, as one .npy file; for interchange of figures that fit on the driver's disk.

    Parts come to the driver one by one in order of idx and are appended.
    """
    (value,) = [f for f in values.schema.fields if f.name == "value"]
    dtype = np.dtype({"int": "<i4", "bigint": "<i8", "float": "<f4", "double": "<f8", "boolean": "?"}[value.dataType.simpleString()])
    n = values.count()
    with open(_local(path), "wb") as f:
        np.lib.format.write_array_header_1_0(f, {"descr": np.lib.format.dtype_to_descr(dtype), "fortran_order": False, "shape": (n,)})
        held = []
        for r in values.orderBy("idx").select("value").toLocalIterator():
            held.append(r.value)
            if len(held) == 1 << 18:
                f.write(np.array(held, dtype).tobytes())
                held.clear()
        f.write(np.array(held, dtype).tobytes())
    return n


def read_json(path: str, default=None):
    """A small JSON file as UTF-8, or as cp932 where it is not; default where there is none."""
    try:
        with open(_local(path), "rb") as f:
            data = f.read()
    except FileNotFoundError:
        return default
    try:
        return json.loads(data.decode("utf-8-sig"))
    except UnicodeDecodeError:
        return json.loads(data.decode("cp932"))


def write_json(path: str, value) -> None:
    """UTF-8, indented; what JSON has no type for is written as text."""
    os.makedirs(os.path.dirname(_local(path)) or ".", exist_ok=True)
    with open(_local(path), "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=2, default=str)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256): the first 16 hex digits of the digest of each file; each file is one row, so for files that fit in a task."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.left(F.sha2("content", 256), F.lit(16)).alias("sha256"))


def sha256_of(path: str, limit: int | None = None) -> str:
    """First 16 hex digits of the digest of a file, or of its first limit bytes, read in blocks."""
    digest, left = hashlib.sha256(), limit
    with open(_local(path), "rb") as f:
        while block := f.read(1 << 20 if left is None else min(1 << 20, left)):
            digest.update(block)
            left = None if left is None else left - len(block)
    return digest.hexdigest()[:16]


def download(url: str, dest: str, agent: str = "linkloom") -> int:
    """Fetches a file, going on behind what is there already; bytes there at the end. 416 means nothing is missing."""
    have = os.path.getsize(dest) if os.path.exists(dest) else 0
    request = urllib.request.Request(url, headers={"User-Agent": agent, **({"Range": f"bytes={have}-"} if have else {})})
    try:
        with urllib.request.urlopen(request, timeout=60) as answer, open(dest, "ab" if answer.status == 206 else "wb") as f:
            while block := answer.read(1 << 20):
                f.write(block)
    except urllib.error.HTTPError as e:
        if e.code != 416:
            raise
    return os.path.getsize(dest)


def download_all(urls: Iterable[str], folder: str, workers: int = 3) -> dict[str, str]:
    """Fetches all, up to workers at a time, each tried twice; what went wrong, by URL."""
    os.makedirs(folder, exist_ok=True)
    gate, wrong = threading.Semaphore(workers), {}

    def fetch(url: str) -> None:
        with gate:
            for attempt in (1, 2):
                try:
                    download(url, f"{folder}/{url.rsplit('/', 1)[-1]}")
                    return
                except OSError as e:
                    if attempt == 2:
                        wrong[url] = str(e)

    threads = [threading.Thread(target=fetch, args=(u,), daemon=True) for u in urls]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    return wrong
