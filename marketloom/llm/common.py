"""What the operators share: tables, the cluster's shared folder and word splitting.

Conventions of all operators here, unless one says otherwise: only the columns
that an operator names are read, so further columns, whatever their names, do
no harm; a null text counts as empty; a null id stays null in the result; rows
that repeat are separate rows; an empty table gives an empty result.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes that the word pattern ``[^\x20\x09-\x0D]+`` leaves out. ``bytes.split()`` splits at exactly these.
BLANKS = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where that is unset, a local session gets one of its own; a cluster has none, which is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="marketloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back, so that a lost executor costs no recomputation."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that no later plan reads."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(df.scratch)
        path.getFileSystem(conf).delete(path, True)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch] | pa.RecordBatch], schema) -> DataFrame:
    """``mapInArrow`` with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                yield from [out] if isinstance(out, pa.RecordBatch) else out

    return df.mapInArrow(run, schema)


class BoundedCache(dict):
    """A memo that starts anew when full; it bounds memory and never changes a result."""

    def __init__(self, make: Callable, limit: int = 1_000_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value


class HalvedCache(BoundedCache):
    """A memo of two halves: when the newer one is full it becomes the older, from which keys in use are taken over, so that filling it up forgets rare keys only."""

    def __init__(self, make: Callable, limit: int):
        super().__init__(make, limit)
        self.older: dict = {}

    def __missing__(self, key):
        if 2 * len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


@lru_cache(maxsize=1)
def word_digests() -> BoundedCache:
    """64-bit digests of words, one memo for all operators of a worker."""
    import xxhash

    return BoundedCache(lambda word: xxhash.xxh3_64_digest(word), 250_000)
