"""Sequence arrays: fixed-width files of features, flags and keys, from which windows of sessions are read as views.

A sample of L sessions repeats each row L times if it is stored. Here each row is stored once, in the order of code and
session, in files of plain arrays: `part-NNNNN.x.f32` (rows by columns), `.m.u8` (1 where a value is null) and `.k.u64`
(place of the code in `.codes.json`, session). `index.json` lists the parts. A Python data source plans ranges of rows
over the parts; whoever reads a range maps it (a local file) or reads it, with the L - 1 rows before it, and its samples
are views of that.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Rows of a range, and values in a batch of samples.
RANGE, VALUES = 1 << 16, 1 << 20
KINDS = {"x.f32": "<f4", "m.u8": "u1", "k.u64": "<u8"}


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    if not urlparse(uri).scheme:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri.replace("file:///", "file:/", 1).replace("file:/", "file:///", 1))


def _json(uri: str, name: str) -> object:
    fs, path = _fs(uri)
    with fs.open_input_stream(f"{path}/{name}") as f:
        return json.loads(f.read())


def write(df: DataFrame, folder: str, columns: list[str], parts: int, code: str = "ts_code", order: str = "day_index") -> int:
    """Write the columns of df, as single precision, in `parts` parts by code; returns the rows.

    Nulls and NaN become 0 with a flag. Rows without code or session are left out; a session may come twice, and then
    no sample spans it. Each file is written under a name of the attempt and moved, and the index last, so a folder with
    an index is whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, path = _fs(folder)
        fs.create_dir(path, recursive=True)
        name, attempt = f"part-{task.partitionId():05d}", task.taskAttemptId()
        codes: dict[str, int] = {}
        n, out = 0, {k: fs.open_output_stream(f"{path}/.{name}.{k}.{attempt}", compression=None) for k in KINDS}
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in columns]) if batch.num_rows else np.zeros((0, len(columns)))
            missing = np.isnan(x)
            at = np.array([codes.setdefault(c, len(codes)) for c in batch.column(code).to_pylist()], np.uint64)
            for k, a in (("x.f32", np.where(missing, 0, x)), ("m.u8", missing), ("k.u64", np.column_stack([at, batch.column(order).to_numpy().astype(np.uint64)]) if batch.num_rows else np.zeros((0, 2)))):
                out[k].write(a.astype(KINDS[k]).tobytes())
            n += batch.num_rows
        for k, f in out.items():
            f.close()
            fs.move(f"{path}/.{name}.{k}.{attempt}", f"{path}/{name}.{k}")
        with fs.open_output_stream(f"{path}/.{name}.codes.{attempt}", compression=None) as f:
            f.write(json.dumps(list(codes)).encode())
        fs.move(f"{path}/.{name}.codes.{attempt}", f"{path}/{name}.codes.json")
        yield pa.RecordBatch.from_pydict({"part": pa.array([task.partitionId()], pa.int64()), "n": pa.array([n], pa.int64())})

    rows = df.where(F.col(code).isNotNull() & F.col(order).isNotNull()).select(F.col(code).cast("string").alias(code), F.col(order).cast("bigint").alias(order), *(F.col(c).cast("double").alias(c) for c in columns))
    written = rows.repartition(parts, code).sortWithinPartitions(code, order).mapInArrow(run, "part bigint, n bigint").collect()
    sizes = {x["part"]: x["n"] for x in written if x["n"]}
    fs, path = _fs(folder)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/.index", compression=None) as f:
        f.write(json.dumps({"columns": columns, "parts": sizes}).encode())
    fs.move(f"{path}/.index", f"{path}/index.json")
    return sum(sizes.values())


class _Range(InputPartition):
    def __init__(self, part: int, first: int, end: int):
        self.part, self.first, self.end = part, first, end


class _Reader(DataSourceReader):
    def __init__(self, folder: str, length: int):
        self.folder, self.length = folder, length
        self.index = _json(folder, "index.json")

    def partitions(self) -> list[InputPartition]:
        return [_Range(int(p), i, min(i + RANGE, n)) for p, n in self.index["parts"].items() for i in range(0, n, RANGE)]

    def _rows(self, part: int, kind: str, width: int, first: int, end: int) -> np.ndarray:
        fs, path = _fs(self.folder)
        dtype = np.dtype(KINDS[kind])
        if isinstance(fs, pafs.LocalFileSystem):
            return np.memmap(f"{path}/part-{part:05d}.{kind}", dtype, "r", first * width * dtype.itemsize, (end - first, width))
        with fs.open_input_file(f"{path}/part-{part:05d}.{kind}") as f:
            f.seek(first * width * dtype.itemsize)
            return np.frombuffer(f.read((end - first) * width * dtype.itemsize), dtype).reshape(-1, width)

    def read(self, partition: _Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no rows, no ranges
            return
        width, before = len(self.index["columns"]), max(0, partition.first - self.length + 1)
        keys = self._rows(partition.part, "k.u64", 2, before, partition.end).astype(np.int64)
        n = len(keys) - self.length + 1
        if n <= 0:
            return
        codes = _json(self.folder, f"part-{partition.part:05d}.codes.json")
        last, first = keys[self.length - 1 :], keys[:n]
        good = np.flatnonzero((last[:, 0] == first[:, 0]) & (last[:, 1] - first[:, 1] == self.length - 1))
        views = [np.lib.stride_tricks.sliding_window_view(self._rows(partition.part, k, width, before, partition.end), self.length, axis=0) for k in ("x.f32", "m.u8")]
        step = max(1, VALUES // (self.length * width))
        for i in range(0, len(good), step):
            at = good[i : i + step]
            x, m = (np.ascontiguousarray(v[at].transpose(0, 2, 1)).reshape(len(at), -1) for v in views)
            size = pa.array(np.arange(len(at) + 1) * x.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array([codes[c] for c in last[at, 0]], pa.string()), pa.array(last[at, 1], pa.int64()), pa.ListArray.from_arrays(size, pa.array(x.ravel(), pa.float32())), pa.ListArray.from_arrays(size, pa.array(m.ravel().astype(np.int8), pa.int8()))],
                ["ts_code", "day_index", "x", "missing"],
            )


class SequenceArrays(DataSource):
    """Format "sequence_arrays", options folder and length: ts_code, day_index of the last session, x and missing by session, oldest first, and column."""

    @classmethod
    def name(cls) -> str:
        return "sequence_arrays"

    def schema(self) -> str:
        return "ts_code string, day_index bigint, x array<float>, missing array<tinyint>"

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(self.options["folder"], int(self.options["length"]))


def samples(spark: SparkSession, folder: str, length: int) -> DataFrame:
    """All samples of `length` consecutive sessions of one code."""
    spark.dataSource.register(SequenceArrays)
    return spark.read.format("sequence_arrays").option("folder", folder).option("length", length).load()
