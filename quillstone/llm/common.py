"""Helpers that the operators of this subpackage share: the shared folder, lineage cuts, connected components."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import chain
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillstone import session

#: Documents in one batch for Python, and its bytes (a batch ends with the row that reaches them).
BATCH, BATCH_BYTES = 2048, 4 << 20
#: Rows in one group of a table that Python writes (a group ends with the batch that reaches them or BATCH_BYTES).
GROUP = 1 << 16
#: Keys that hold at least one in so many rows are hot: there are at most so many of them, which bounds their broadcast.
HOT = 1000


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where that is unset and the master is local (tests on one machine), a temporary folder is set as checkpoint
    folder. On a cluster without that setting there is no folder that all can read, which is an error.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quillstone-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, and make batches for Python smaller than the default, which fits short rows; these hold whole documents."""
    session.ship(spark)
    for name, most in (("maxRecordsPerBatch", BATCH), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}").rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", most)


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh, not yet made path under the shared folder; clean() deletes it."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut, written in the shared folder, so that a lost executor costs no rerun of what led to them.

    A table that is read back has the size of its files. A checkpoint would keep the estimate of the plan it came
    from, and in a loop of joins these estimates multiply until planning itself takes minutes.
    """
    spark, path = df.sparkSession, new_folder(df.sparkSession, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] = iter, schema: StructType | None = None) -> DataFrame:
    """cut() by Python: what f, if given, makes of the batches of df's partitions, in columns of the schema.

    For each file that Spark writes to a local file system without native code, the JVM starts processes (chmod), each
    of which counts as large as the JVM until it runs its program. Here it starts none.
    """
    spark, folder = df.sparkSession, new_folder(df.sparkSession, "kept")
    fs, path = open_fs(folder)
    fs.create_dir(path, recursive=True)  # without rows it stays empty

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        yield pa.RecordBatch.from_pydict({"n": pa.array([write_table(folder, f"part-{task.partitionId():05d}.parquet", f(batches), str(task.taskAttemptId()))], pa.int64())})

    df.mapInArrow(run, "n bigint").collect()
    return spark.read.schema(schema or df.schema).parquet(folder)


_made: list[str] = []


def clean(spark: SparkSession) -> None:
    """Delete what was written under new_folder(), by cut() or as files; DataFrames that came of it can't be read any more."""
    for path in _made:
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
    _made.clear()


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """A pyarrow file system and the path in it for a URI or plain path; works on executors too."""
    scheme = urlparse(uri).scheme
    if not scheme:
        return pafs.LocalFileSystem(), uri
    if scheme in ("s3a", "s3n"):  # names of one store for Hadoop, which pyarrow knows by its own
        uri = "s3" + uri[3:]
    return pafs.FileSystem.from_uri(uri.replace("file:///", "file:/", 1).replace("file:/", "file:///", 1))


def write_file(folder: str, name: str, chunks: Iterator[bytes], attempt: str) -> int:
    """Write a file in the folder under a name of this attempt, then move it to its place, so that readers see whole files only.

    A task that runs again writes the same bytes to the same name. Returns the bytes written.
    """
    fs, path = open_fs(folder)
    fs.create_dir(path, recursive=True)
    temporary, n = f"{path}/.{name}.{attempt}", 0
    with fs.open_output_stream(temporary, compression=None) as f:
        for x in chunks:
            f.write(x)
            n += len(x)
    fs.move(temporary, f"{path}/{name}")
    return n


def write_table(folder: str, name: str, batches: Iterator[pa.RecordBatch], attempt: str) -> int:
    """write_file() of a Parquet file; none for no rows. Returns the rows written."""
    import pyarrow.parquet as pq  # only workers that write tables load it

    def groups() -> Iterator[pa.Table]:
        some: list[pa.RecordBatch] = []
        for batch in batches:
            some += [batch] if batch.num_rows else []
            if sum(x.num_rows for x in some) >= GROUP or sum(x.nbytes for x in some) >= BATCH_BYTES:
                yield pa.Table.from_batches(some)
                some = []
        if some:
            yield pa.Table.from_batches(some)

    parts = groups()
    first = next(parts, None)
    if first is None:
        return 0
    fs, path = open_fs(folder)
    temporary, n = f"{path}/.{name}.{attempt}", 0
    with fs.open_output_stream(temporary, compression=None) as f, pq.ParquetWriter(f, first.schema, compression="zstd") as w:
        for table in chain([first], parts):
            w.write_table(table)
            n += table.num_rows
    fs.move(temporary, f"{path}/{name}")
    return n


def open_file(folder: str, name: str) -> pa.NativeFile:
    """A file that is read from any place in it."""
    fs, path = open_fs(folder)
    return fs.open_input_file(f"{path}/{name}")


def open_stream(folder: str, name: str, buffer: int = 1 << 20) -> pa.NativeFile:
    """A file that is read from its beginning on, a buffer at a time."""
    fs, path = open_fs(folder)
    return fs.open_input_stream(f"{path}/{name}", compression=None, buffer_size=buffer)


def read_file(folder: str, name: str) -> bytes:
    with open_stream(folder, name) as f:
        return f.read()


def drawn(df: DataFrame, id_: str, text: str, rows: int, chars: int) -> list[Row]:
    """A bounded sample of distinct rows with whole texts: those of smallest hash, up to `rows` of them and `chars` characters in all.

    Rows without id or text take no part, and neither does a row whose text alone goes beyond what is left of the
    characters. What is drawn depends on the rows only, not on how they are partitioned.
    """
    keyed = df.where(F.col(id_).isNotNull() & F.col(text).isNotNull()).withColumn("_k", F.xxhash64(id_, text))
    chosen, left = [], chars
    for x in keyed.select("_k", F.length(text).alias("_n")).distinct().orderBy("_k", "_n").limit(rows).collect():
        if x["_n"] <= left:
            left -= x["_n"]
            chosen.append(x["_k"])
    some = keyed.where(F.col("_k").isin(chosen)).dropDuplicates(["_k"]) if chosen else None
    return sorted(some.drop("_k").collect(), key=lambda x: (x[id_], x[text])) if some else []


def join_spread(big: DataFrame, small: DataFrame, on: list[str], count: str, total: int, row: list[str], how: str = "inner") -> DataFrame:
    """big joined (inner or left) with small, which has one row a key and in column `count` how many of big's `total` rows have the key.

    A hot key's rows are split by a hash of the columns `row` of big, and small's row for it is repeated, so that no task
    gets much more than one in HOT rows of a key. The broadcast that tells big's rows has at most HOT rows.
    """
    parts = F.ceil(F.col(count) * HOT / F.lit(max(total, 1))).cast("int")
    hot = small.where(F.col(count) * HOT >= total).select(*on, parts.alias("_parts"))
    left = big.join(F.broadcast(hot), on, "left").withColumn("_part", F.pmod(F.xxhash64(*row), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    right = small.withColumn("_part", F.explode(F.sequence(F.lit(0), F.when(F.col(count) * HOT >= total, parts).otherwise(1) - 1)))
    return left.join(right, [*on, "_part"], how).drop("_part")


def add_arrays(parts: DataFrame, column: str, order: str, ways: int = 32) -> np.ndarray | None:
    """The sum of an array column of equal lengths, in doubles; None of no rows.

    The rows, one or a few a task, are dealt to `ways` tasks that add them up, and the driver adds one array of each.
    Rows are added in the order of a column, so that the sum doesn't depend on which task ends first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column(column):
                a = x.values.to_numpy(zero_copy_only=False).astype(float)
                total = a if total is None else total + a
        if total is not None:
            yield pa.RecordBatch.from_pydict({"way": pa.array([TaskContext.get().partitionId()]), "v": pa.array([total], pa.list_(pa.float64()))})

    dealt = parts.select(column, order).repartition(ways, order).sortWithinPartitions(order)
    sums = sorted(dealt.mapInArrow(run, "way bigint, v array<double>").collect(), key=lambda x: x["way"])
    return np.sum([x["v"] for x in sums], axis=0) if sums else None


def give_back(tokenizer: bool = True) -> None:
    """Give the system the memory that a worker still holds of earlier tasks: its tokenizers, if so told, and what allocators keep.

    Workers are used again for other stages, and what they hold counts for their executor. For the beginning of tasks.
    """
    if tokenizer and (module := sys.modules.get(f"{__package__}.tokens")):
        module.encoder.cache_clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # other C libraries than glibc
        pass


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]], schema: str) -> DataFrame:
    """mapInArrow with state of the task: make() runs once in each task and returns the function for its batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            yield from f(batch)

    return df.mapInArrow(run, schema)


def apart(column: str) -> Column:
    """The same whole number, but not the same column to the planner.

    A join with an aggregate by the same key would take over the aggregate's partitioning, and a hot key of the other
    side then can't be split. This way both sides get exchanges of their own, which adaptive execution splits.
    """
    return F.col(column).bitwiseXOR(F.lit(0).cast("bigint"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that an edge names; component is the smallest node that it reaches.

    Alternating large-star and small-star steps: each needs one shuffle of at most as many rows as there are edges,
    their number grows with the logarithm of the longest path, and nothing is collected. A node with very many
    neighbours is no single row or group: its smallest neighbour is an aggregate, joined back to its edges.
    """
    e = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    last = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(apart("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(apart("u").alias("w"), "m")
        small = large.join(low, F.col("u") == F.col("w")).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
        e = cut(small.where("u <> v").distinct())
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if tuple(state) == last or not state["n"]:
            break
        last = tuple(state)
    return e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
