"""Substring deduplication by hashing units of lines with their neighbours.

A text is cut into units: clauses, which end with a mark (``.!?,;:``) or a line.
Each is normalised (A-Z lower-cased, words parted by one space). A unit alone may
be as short as a heading, so it is hashed together with the units after it, as
many as make ``min_words`` words; a run may go on over the ends of sentences,
lines and paragraphs. Digests are grouped over the whole corpus; of equal runs the
earliest stays, by doc_id, then place, and the units of all others are removed. So
a removed unit always stands in an earlier place, and its earliest one stays.
Places in the original text are returned for what goes and what stays.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, discard, materialize, table

#: Words that a run has at least; the passages to be found have over 50, and their ends stand inside clauses.
MIN_WORDS = 25
UNIT = re.compile(r"[^.!?,;:\n]*[.!?,;:\n]+|[^.!?,;:\n]+")
#: Runs that a task holds at once, to send the earliest of equal ones only.
HELD = 300_000
RUNS = "high long, low long, doc_id long, mark long, start long, end long, gone boolean"


def runs(text: str, min_words: int = MIN_WORDS) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, digest) of the run that begins at each unit with a word; places are code points, the end is exclusive. The last units, with fewer words after them, begin none."""
    starts, ends, bodies, counts, at = [], [], [], [], 0
    for unit in UNIT.findall(text):
        if words := unit.encode().lower().split():
            starts.append(at)
            ends.append(at + len(unit))
            bodies.append(b" ".join(words))
            counts.append(len(words))
        at += len(unit)
    held = last = 0
    for first in range(len(starts)):
        while held < min_words and last < len(starts):
            held += counts[last]
            last += 1
        if held < min_words:
            return
        yield starts[first], ends[last - 1], hashlib.blake2b(b" ".join(bodies[first:last]), digest_size=16).digest()
        held -= counts[first]


def run_table(docs: DataFrame, min_words: int = MIN_WORDS, most: int = HELD) -> DataFrame:
    """A row for each run that is new to its task, and with ``gone`` one for each that stands earlier in the same task.

    So a run that fills a third of the rows has one row a task to be ranked.
    """

    def batch_of(rows: list[tuple], digests: list[bytes], gone: bool) -> pa.RecordBatch:
        halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        columns = [pa.array(halves[:, 0]), pa.array(halves[:, 1]), *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True)), pa.array([gone] * len(rows))]
        return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in RUNS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[bytes, tuple] = {}

        def gone(held: list[tuple], digests: list[bytes]) -> Iterator[pa.RecordBatch]:
            if held:
                yield batch_of(held, digests, True)

        for batch in batches:
            held, digests = [], []
            for doc_id, mark, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for start, end, digest in runs(text, min_words):
                    place = (doc_id, mark, start, end)
                    before = first.setdefault(digest, place)
                    if before != place:
                        first[digest] = min(before, place)
                        held.append(max(before, place))
                        digests.append(digest)
                if len(first) >= most:
                    yield batch_of(list(first.values()), list(first), False)
                    first.clear()
            yield from gone(held, digests)
        if first:
            yield batch_of(list(first.values()), list(first), False)

    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    return texts.mapInArrow(run, RUNS)


def removed_runs(docs: DataFrame, min_words: int = MIN_WORDS, most: int = HELD) -> DataFrame:
    """doc_id, mark (hash of the text) and ``spans``, the places of all runs that go, which may overlap."""
    found = materialize(run_table(docs, min_words, most), "runs")
    # a digest has at most a row for each HELD runs of a task here
    rank = F.dense_rank().over(Window.partitionBy("high", "low").orderBy("doc_id", "mark", "start"))
    later = found.where("NOT gone").withColumn("rank", rank).where("rank > 1").unionByName(found.where("gone"), allowMissingColumns=True)
    spans = materialize(later.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "spans")
    discard(found)
    return spans


def merged(spans: list, length: int) -> tuple[list[list[int]], list[list[int]]]:
    """(removed, kept) places in order; what overlaps or touches is one."""
    out: list[list[int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans or []):
        if out and start <= out[-1][1]:
            out[-1][1] = max(end, out[-1][1])
        else:
            out.append([start, end])
    kept, at = [], 0
    for start, end in [*out, [length, length]]:
        if start > at:
            kept.append([at, start])
        at = end
    return out, kept


def substring_dedup(docs: DataFrame, min_words: int = MIN_WORDS, most: int = HELD) -> DataFrame:
    """A row for each row: doc_id, text without its repeated runs, and the [start, end) places of the original that stay and that go.

    Rows without an id or a text have no rank, so they stay as they are and take
    nothing from others; a null text stays null. Rows that repeat with one id and
    text are one document; those that differ in text are ranked by a hash of it.
    A text of fewer words than a run, empty ones among them, stays. An empty
    table gives no rows; columns other than doc_id and text are not read.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, places = [], ([], [])
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            removed, kept = merged(spans, len(text or ""))
            texts.append(text if not removed else "".join(text[a:b] for a, b in kept))
            for column, found in zip(places, (kept, removed), strict=True):
                column.append(found)
        kind = pa.list_(pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(texts, pa.string()), *(pa.array(p, kind) for p in places)], ["doc_id", "text", "kept_spans", "removed_spans"])

    spans = removed_runs(docs, min_words, most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark"))
    # rows without an id match nothing and aren't dealt to one task
    joined = rows.where("doc_id IS NOT NULL").hint("merge").join(spans, ["doc_id", "mark"], "left").select("doc_id", "text", "spans")
    alone = rows.where("doc_id IS NULL").select("doc_id", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))
    return arrow_map(joined.unionByName(alone), run, "doc_id long, text string, kept_spans array<array<bigint>>, removed_spans array<array<bigint>>")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` without repeated runs; places as start:end, comma-joined."""
    show = lambda c: F.array_join(F.transform(c, lambda x: F.array_join(x.cast("array<string>"), ":")), ",")
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", show("kept_spans").alias("kept_spans"), show("removed_spans").alias("removed_spans"))


OP3_SQL = r"""
WITH cut AS (SELECT doc_id, text, regexp_extract_all(text, '[^.!?,;:\n]*[.!?,;:\n]+|[^.!?,;:\n]+') AS units FROM documents),
unit AS (SELECT doc_id, unnest(units) AS u, generate_subscripts(units, 1) AS k FROM cut),
placed AS (SELECT *, CAST(sum(length(u)) OVER (PARTITION BY doc_id ORDER BY k) AS BIGINT) AS stop,
                  regexp_extract_all(translate(u, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM unit),
wordy AS (SELECT doc_id, k, len(w) AS n, array_to_string(w, ' ') AS body, sum(len(w)) OVER d AS c, row_number() OVER d AS i FROM placed WHERE len(w) > 0 WINDOW d AS (PARTITION BY doc_id ORDER BY k)),
listed AS (SELECT doc_id, list(body ORDER BY i) AS bodies FROM wordy GROUP BY doc_id),
begun AS (SELECT doc_id, k, i, c - n + 25 AS need FROM wordy),
ended AS (SELECT a.doc_id, a.k AS first, b.k AS last, a.i AS i, b.i AS j FROM begun a ASOF JOIN wordy b ON a.doc_id = b.doc_id AND a.need <= b.c),
run AS (SELECT doc_id, first, last, array_to_string(bodies[i:j], ' ') AS body FROM ended JOIN listed USING (doc_id)),
later AS (SELECT doc_id, first, last FROM (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, first) AS rank FROM run) WHERE rank > 1),
told AS (SELECT doc_id, k, u, stop, EXISTS (SELECT 1 FROM later WHERE later.doc_id = placed.doc_id AND placed.k BETWEEN later.first AND later.last) AS gone FROM placed),
island AS (SELECT *, k - row_number() OVER (PARTITION BY doc_id, gone ORDER BY k) AS g FROM told),
span AS (SELECT doc_id, gone, min(stop - length(u)) AS a, max(stop) AS b FROM island GROUP BY doc_id, gone, g),
shown AS (SELECT doc_id, string_agg(a || ':' || b, ',' ORDER BY a) FILTER (NOT gone) AS kept_spans, string_agg(a || ':' || b, ',' ORDER BY a) FILTER (gone) AS removed_spans FROM span GROUP BY doc_id),
body AS (SELECT doc_id, string_agg(u, '' ORDER BY k) FILTER (NOT gone) AS body FROM told GROUP BY doc_id)
SELECT documents.doc_id, CASE WHEN text IS NULL THEN NULL ELSE coalesce(body, '') END AS text, coalesce(kept_spans, '') AS kept_spans, coalesce(removed_spans, '') AS removed_spans
FROM documents LEFT JOIN shown USING (doc_id) LEFT JOIN body USING (doc_id)
"""
