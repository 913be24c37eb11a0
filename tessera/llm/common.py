"""Helpers the training-data operators share: the shared folder, written tables, components."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of other characters than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, as the session names it.

    A session that names none gets a temporary one if it runs in this process; on a cluster that is an error, since
    every machine would write to a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


_MADE: list[list[str]] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own under the shared folder."""
    path = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    if _MADE:
        _MADE[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Folders that operators make within it are deleted at its end, so write their results elsewhere before.

    Operators return DataFrames that read such folders; outside of it they stay until the shared folder is cleared.
    """
    _MADE.append([])
    try:
        yield
    finally:
        for path in _MADE.pop():
            remove(spark, path)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written to the shared folder and read again: its lineage ends there."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file systems, so that any store works."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def file_system(path: str):
    """pyarrow's file system and the path in it; works on executors too."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path if not path.startswith("file:/") or path.startswith("file:///") else "file://" + path[5:])


def write_file(path: str, suffix: str, parts: list[bytes]) -> str:
    """Write one file under a name that no other attempt at the task uses; the name, for the rows that tell of the file.

    Only the rows of the attempt that Spark commits are read, so files of lost or repeated attempts are never met.
    """
    path = f"{path}-{uuid.uuid4().hex}{suffix}"
    system, at = file_system(path)
    system.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(at, compression=None) as out:
        for part in parts:
            out.write(part)
    return path


def find(parent: dict, x):
    """Root of x in a union-find forest kept as a dict, halving paths."""
    while parent.setdefault(x, x) != x:
        parent[x] = x = parent.setdefault(parent[x], parent[x])
    return x


def union(parent: dict, a, b) -> None:
    """Join two trees; the smaller root stays, so that a root is its tree's least member."""
    a, b = find(parent, a), find(parent, b)
    if a != b:
        parent[max(a, b)] = min(a, b)


#: More edges than that are joined by sorting: files of edges are many times smaller than what a broadcast holds.
BROADCAST_EDGES = 100_000


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(u long, v long)`` as (id, component), component its least id.

    Alternating large-star and small-star steps: every round is two aggregations and two joins
    over the edges, no neighbour list is gathered, and rounds grow with the log of a component's
    size. Each round is written to the shared folder, which cuts the lineage.
    """
    spark = edges.sparkSession
    path = new_folder(spark, "edges")
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges.write.parquet(path)
    before = None
    while True:
        now = spark.read.schema("u long, v long").parquet(path)
        sign = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if sign[0] == 0 or sign == before:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
        way = "merge" if sign[0] > BROADCAST_EDGES else None
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        upper = both.where("v > u")
        large = (upper.hint(way) if way else upper).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.hint(way) if way else large).join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lower).distinct()
        after = new_folder(spark, "edges")
        small.write.parquet(after)
        remove(spark, path)
        before, path = sign, after


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that only so many texts are Python objects at once.

    What Arrow keeps of batches before is given back to the system, as workers share a machine's memory."""
    pool = pa.default_memory_pool()
    for batch in batches:
        pool.release_unused()
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    pool.release_unused()


def trim() -> None:
    """Give memory that nothing uses back to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


_HELD: dict[str, object] = {}


def held(name: str, make):
    """What a worker keeps between tasks: one thing at a time, so that operators' caches don't add up."""
    if name not in _HELD:
        _HELD.clear()
        trim()
        _HELD[name] = make()
    return _HELD[name]


#: Longer keys are made anew each time, so that entries stay small.
LONG_KEY = 64


class Cache(dict):
    """A dict of two generations: at most twice ``most`` entries, the lately used ones stay."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most, {}

    def __missing__(self, key):
        if key in self.old:
            value = self.old[key]
        else:
            value = self.make(key)
            if len(key) > LONG_KEY:
                return value
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value

    def make(self, key):
        raise KeyError(key)
