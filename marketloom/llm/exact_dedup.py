"""Exact deduplication against immutable snapshots, screened by binary-fuse filters.

A snapshot is a table of digest groups that never changes, with one static
filter for each bucket of digests. An incoming batch is first grouped by its own
digests (so a text that fills a third of the batch is one row from there on),
each distinct digest is screened by its bucket's filter, the positives join the
exact bucket and are checked byte for byte, and the rest are new.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, materialize, table

DIGESTS = "doc_id long, digest binary, n_bytes long"
FILTERS = "bucket int, seed long, segment int, segments int, body binary"


def digests(docs: DataFrame) -> DataFrame:
    """SHA-256 of each text after lower-casing A-Z only; null counts as empty."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lowered = [(t or "").encode().lower() for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), pa.array([hashlib.sha256(t).digest() for t in lowered], pa.binary()), pa.array([len(t) for t in lowered], pa.int64())],
            ["doc_id", "digest", "n_bytes"],
        )

    return arrow_map(docs.select("doc_id", "text"), run, DIGESTS)


# --- the filter ---------------------------------------------------------------------------------


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys ^ np.uint64(seed)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _slots(h: np.ndarray, segment: int, segments: int) -> np.ndarray:
    first = ((h >> np.uint64(32)) * np.uint64(segments * segment)) >> np.uint64(32)
    mask = np.uint64(segment - 1)
    return np.stack([first, (first + np.uint64(segment)) ^ ((h >> np.uint64(18)) & mask), (first + np.uint64(2 * segment)) ^ (h & mask)]).astype(np.int64)


def build_filter(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """A 3-wise binary-fuse filter with 8-bit fingerprints over distinct uint64 keys: (seed, segment, segments, body)."""
    n = len(keys)
    segment = 1 << max(2, min(18, int(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25))))
    factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
    segments = max(1, -(-int(n * factor) // segment) - 2)
    for seed in range(1, 200):
        h = _mix(keys, seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        at, size = _slots(h, segment, segments), (segments + 2) * segment
        count = np.bincount(at.ravel(), minlength=size)
        owner = np.zeros(size, np.int64)  # XOR of the keys' numbers; of a slot with one key, its number
        for row in at:
            np.bitwise_xor.at(owner, row, np.arange(n))
        order: list[tuple[np.ndarray, np.ndarray]] = []
        ready, left = np.flatnonzero(count == 1), n
        while len(ready):
            mine, first = np.unique(owner[ready], return_index=True)
            order.append((mine, ready[first]))
            left -= len(mine)
            gone = at[:, mine]
            np.subtract.at(count, gone.ravel(), 1)
            for row in gone:
                np.bitwise_xor.at(owner, row, mine)
            touched = np.unique(gone.ravel())
            ready = touched[count[touched] == 1]
        if left == 0:
            body, prints = np.zeros(size, np.uint8), (h & np.uint64(255)).astype(np.uint8)
            for mine, slot in reversed(order):
                body[slot] = 0
                body[slot] = prints[mine] ^ body[at[0, mine]] ^ body[at[1, mine]] ^ body[at[2, mine]]
            return seed, segment, segments, body.tobytes()
        segments += 1
    raise ValueError("no seed gives a peelable filter; are the keys distinct?")


def in_filter(keys: np.ndarray, seed: int, segment: int, segments: int, body: bytes) -> np.ndarray:
    h, b = _mix(keys, seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1), np.frombuffer(body, np.uint8)
    at = _slots(h, segment, segments)
    return (b[at[0]] ^ b[at[1]] ^ b[at[2]]) == (h & np.uint64(255)).astype(np.uint8)


def _keys(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(d)[8:16] for d in column), np.uint64)


def _bucket(n: int):
    return F.pmod(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), F.lit(n)).cast("int")


def grouped(found: DataFrame) -> DataFrame:
    """A row for each distinct digest: the largest id, the rows, and a representative for byte checks."""
    return found.groupBy("digest", "n_bytes").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("rows"))


def snapshot_filters(groups: DataFrame, buckets: int) -> DataFrame:
    """One filter for each bucket of a snapshot's distinct digests; a bucket's size is bounded by the bucket count."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        seed, segment, segments, body = build_filter(np.unique(_keys(rows["digest"])))
        return pd.DataFrame({"bucket": [key[0]], "seed": [seed], "segment": [segment], "segments": [segments], "body": [body]})

    return groups.select(_bucket(buckets).alias("bucket"), "digest").groupBy("bucket").applyInPandas(run, FILTERS)


def screen(incoming: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """The incoming groups with ``maybe``: whether the snapshot's filter lets the digest pass. It never misses one."""

    def run(rows: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return rows.assign(maybe=False).drop(columns="bucket")
        hit = np.zeros(len(rows), bool)
        for f in filters.itertuples():
            hit |= in_filter(_keys(rows["digest"]), f.seed, f.segment, f.segments, f.body)
        return rows.assign(maybe=hit).drop(columns="bucket")

    left = incoming.withColumn("bucket", _bucket(buckets)).groupBy("bucket")
    return left.cogroup(filters.groupBy("bucket")).applyInPandas(run, "digest binary, n_bytes long, keep_id long, rows long, maybe boolean")


def exact_dedup(incoming: DataFrame, snapshot: DataFrame, per_bucket: int = 100_000) -> DataFrame:
    """Every row of both tables: doc_id, keep_id (largest id of the equal texts), group_size, kept, text_sha256.

    Null and empty texts are equal to one another. Rows that share the largest
    id of a group are all ``kept``. Empty tables on either side are fine.
    """
    new_rows, old_rows = materialize(digests(incoming), "incoming"), materialize(digests(snapshot), "snapshot")
    old, new = materialize(grouped(old_rows), "old-groups"), grouped(new_rows)
    # by the larger side: a first snapshot has no digests, and its batch may have all
    buckets = max(1, -(-max(old.count(), new_rows.count()) // per_bucket))
    screened = materialize(screen(new, snapshot_filters(old, buckets), buckets), "screened")
    hits = screened.where("maybe").select("digest", "n_bytes", F.col("keep_id").alias("new_id"), F.col("rows").alias("new_rows"))
    pairs = materialize(hits.join(old.select("digest", "n_bytes", F.col("keep_id").alias("old_id"), F.col("rows").alias("old_rows")), ["digest", "n_bytes"]), "pairs")
    ids = pairs.select("digest", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("new_id").alias("doc_id")), F.struct(F.lit(1).alias("side"), F.col("old_id").alias("doc_id")))).alias("x")).select("digest", "x.side", "x.doc_id")
    lower = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = incoming.select("doc_id", "text", F.lit(0).alias("side")).unionByName(snapshot.select("doc_id", "text", F.lit(1).alias("side")))
    # a merge join, so that the plan is one at every size
    checked = ids.hint("merge").join(texts, ["doc_id", "side"]).select("digest", "side", lower.alias("body")).where(F.sha2("body", 256) == F.lower(F.hex("digest")))
    equal = checked.groupBy("digest").agg((F.min("body") == F.max("body")).alias("equal"), (F.min("side") != F.max("side")).alias("both")).where("equal AND both")
    if pairs.where("new_id IS NOT NULL AND old_id IS NOT NULL").join(equal, "digest", "left_anti").limit(1).count():
        raise ValueError("two texts of one SHA-256 digest differ")
    # a digest that the filter keeps out, or that the bucket doesn't have, stays with its own side's group
    met = pairs.select("digest", "n_bytes", F.greatest("new_id", "old_id").alias("met_id"), (F.col("new_rows") + F.col("old_rows")).alias("met_rows"))
    told = lambda groups: groups.join(met, ["digest", "n_bytes"], "left").select("digest", "n_bytes", F.coalesce("met_id", "keep_id").alias("keep_id"), F.coalesce("met_rows", "rows").alias("group_size"))
    joined = new_rows.join(told(screened), ["digest", "n_bytes"]).unionByName(old_rows.join(told(old), ["digest", "n_bytes"]))
    return joined.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(True)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def split_by_age(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(incoming, snapshot): the upper and the lower half of the id range; ids grow as documents arrive. Null ids are incoming."""
    lo, hi = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    if lo is None:
        return docs, docs.limit(0)
    old = F.coalesce(F.col("doc_id") <= F.lit((lo + hi) // 2), F.lit(False))
    return docs.where(~old), docs.where(old)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``: the upper half of the ids comes in, the lower half is the snapshot."""
    incoming, snapshot = split_by_age(table(spark, sf_dir, "documents"))
    return exact_dedup(incoming, snapshot)


OP8_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents)
WINDOW w AS (PARTITION BY body)
"""
