"""Best-fit packing by exact-complement hashing.

Lengths are at most the sequence length, so the whole corpus is summed up by one
count for each length. On these counts the plan is made: hash tables of single,
pair and triple sums give combinations that fill a gap exactly, which are taken
as often as the counts allow; what is left is placed best fit, largest first.
The plan's size depends on the sequence length alone, never on the documents,
so it may be broadcast; documents find their place by their rank in their length.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import defaultdict
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BoundedCache, arrow_map, materialize, table

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Words(dict):
    """Ids of words as packed little-endian 32-bit integers; a word never spans ASCII white space, which the tokenizer drops.

    Plain Latin words are lower-cased and split here as the file says, and only
    new pieces go to the library's model; all others, and those that hold the name
    of a special token, go through the library whole, which gives that token's id.
    """

    def __init__(self, body: str, limit: int = 440_000):
        import regex
        from tokenizers import Tokenizer

        super().__init__()
        self.limit, self.older, self.whole = limit, {}, Tokenizer.from_str(body)
        # the library finds these in a text before it splits or lower-cases anything
        names = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.sign, self.special = os.path.commonprefix(names), re.compile("|".join(map(re.escape, names)) or r"(?!)").search
        self.model = self.whole.model
        config = json.loads(body)
        steps = config["pre_tokenizer"]["pretokenizers"]
        lowers = [x["type"] for x in config["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"]
        simple = lowers and [x["type"] for x in steps] == ["Split", "ByteLevel"] and steps[0]["invert"] and steps[0]["behavior"] == "Removed"
        self.plain = re.compile("[!-~\xa1-\u017f]+").fullmatch if simple else lambda word: None  # stable under NFC
        self.find = regex.compile(steps[0]["pattern"]["Regex"]).findall if simple else None
        self.shown = byte_letters()
        self.pieces = BoundedCache(self.piece, limit // 2)

    def piece(self, piece: str) -> bytes:
        return np.array([t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.shown))], "<u4").tobytes()

    def __missing__(self, word: bytes) -> bytes:
        """A word met lately is taken over from the older half of the memo, so that filling it up forgets rare words only."""
        if 2 * len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        if (ids := self.older.get(word)) is not None:
            self[word] = ids
            return ids
        text = word.decode()
        if self.plain(text) and (self.sign not in text or not self.special(text)):
            ids = b"".join(map(self.pieces.__getitem__, self.find(text.lower())))
        else:
            ids = np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        self[word] = ids
        return ids


def byte_letters() -> dict[int, int]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: b if b in own else 256 + sum(x not in own for x in range(b)) for b in range(256)}


_WORDS: dict[int, Words] = {}


def words_of(body: bytes) -> Words:
    key = zlib.crc32(body)
    if key not in _WORDS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _WORDS[key] = Words(body.decode())
    return _WORDS[key]


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, size: int) -> DataFrame:
    """A row for each piece of each document: its ids and a closing id 0, cut only if longer than ``size``. Null texts are one id 0."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(open(tokenizer_path, "rb").read())  # a vocabulary file: under 2 MB

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = words_of(vocabulary.value)
        out: list[tuple] = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            packed = b"".join(map(known.__getitem__, (text or "").encode().split())) + b"\0\0\0\0"
            for piece, at in enumerate(range(0, len(packed), 4 * size)):
                body = packed[at : at + 4 * size]
                out.append((doc_id, piece, at // 4, len(body) // 4, zlib.crc32(body)))
        columns = zip(*out, strict=True)
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return arrow_map(docs.select("doc_id", "text"), run, PIECES)


# --- the plan ------------------------------------------------------------------------------------


class Segment(NamedTuple):
    """The pieces of one length with ranks from ``rank`` on, ``count`` of them, go to sequences from ``sequence`` on, each at ``offset``."""

    length: int
    rank: int
    count: int
    sequence: int
    offset: int


def plan(counts: dict[int, int], size: int) -> tuple[list[Segment], int]:
    """Segments that place every piece, and how many sequences they make: the best of plans whose sums have up to three, two or one lengths."""
    return min((_plan(counts, size, most) for most in (3, 2, 1)), key=lambda p: p[1])


def _plan(counts: dict[int, int], size: int, most_terms: int) -> tuple[list[Segment], int]:
    """One plan, with sums of at most ``most_terms`` lengths.

    Largest length first: a piece opens sequences whose gap is looked up among
    the sums of one, two and three shorter lengths, with as many copies at once
    as the counts allow. A length whose gap has no exact sum waits for the
    residual phase, which places lengths best fit, largest first, into open gaps.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    used: dict[int, int] = defaultdict(int)
    out: list[Segment] = []
    total = 0

    def place(lengths: list[int], times: int) -> None:
        nonlocal total
        offset = 0
        for n in lengths:
            out.append(Segment(n, used[n], times, total, offset))
            used[n] += times
            left[n] -= times
            offset += n
        total += times

    if left.get(size):
        place([size], left[size])

    def times(combination: tuple[int, ...]) -> int:
        return min((left[n] // combination.count(n) for n in combination), default=0)

    lengths = sorted((n for n in left if n < size), reverse=True)
    open_ = np.zeros(size + 1, bool)  # the single lengths that are left
    open_[lengths] = True
    sums = np.zeros(2 * size + 1, bool)  # the sums of two of them; one that no longer holds is struck out when met
    for n in lengths:
        sums[n : n + size + 1] |= open_

    def pair_for(total_: int, most: int) -> tuple[int, int] | None:
        """The pair with that sum whose larger length, at most ``most``, is largest."""
        for a in range(min(most, total_ - 1), (total_ + 1) // 2 - 1, -1):
            fits = open_[a : (total_ + 1) // 2 - 1 : -1] & open_[total_ - a : total_ // 2 + 1]
            if not fits.any():
                return None
            a -= int(fits.argmax())
            if 2 * a != total_ or left[a] > 1:
                return a, total_ - a
        return None

    def exact(first: int) -> tuple[int, ...] | None:
        gap = size - first
        if open_[gap] and (gap != first or left[first] > 1):
            return first, gap
        if most_terms > 1 and sums[gap] and (pair := pair_for(gap, gap)):
            return first, *pair
        for a in gap - 1 - np.flatnonzero(open_[gap - 1 : 0 : -1] & sums[1:gap]) if most_terms > 2 and gap > 1 else ():
            a = int(a)
            if pair := pair_for(gap - a, a):
                if times(found := (first, a, *pair)):
                    return found
            elif not pair_for(gap - a, size):
                sums[gap - a] = False
        return None

    for first in lengths:
        while left[first] and (found := exact(first)) and (n := times(found)):
            place(list(found), n)
            for n in found:
                open_[n] = left[n] > 0

    # residuals: best fit on groups of open sequences with one gap, largest lengths first
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> [(first sequence, how many)]
    some = np.zeros(size + 1, bool)
    for n in sorted((n for n in left if left[n]), reverse=True):
        while left[n]:
            gap = n + int(some[n:].argmax())
            if not some[gap]:
                fit = min(size // n, left[n])
                bins, rest = divmod(left[n], fit)
                for many, how_often in ((fit, bins), (rest, 1)):
                    if many:
                        gaps[size - many * n].append((total, how_often))
                        some[size - many * n] = True
                        place([n] * many, how_often)
                continue
            start, bins = gaps[gap].pop()
            here = min(bins, left[n])
            out.append(Segment(n, used[n], here, start, size - gap))
            used[n] += here
            left[n] -= here
            if here < bins:
                gaps[gap].append((start + here, bins - here))
            some[gap] = bool(gaps[gap])
            gaps[gap - n].append((start, here))
            some[gap - n] = True
    return out, total


def pack(pieces: DataFrame, size: int, buckets: int | None = None) -> DataFrame:
    """The pieces with sequence_id and offset. Pieces of one length are ranked in hash buckets, so that no length is sorted in one task."""
    spark = pieces.sparkSession
    buckets = buckets or max(1, -(-pieces.count() // 50_000))
    # the checksum deals rows without an id too
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    sums = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = materialize(sums.withColumn("before", before), "length-sums")
    counts = {r["length"]: r["n"] for r in sums.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``size`` rows
    segments, _ = plan(counts, size)
    by_length: dict[int, np.ndarray] = {}
    for s in segments:
        by_length.setdefault(s.length, []).append((s.rank, s.sequence, s.offset))
    by_length = {n: np.array(sorted(x)) for n, x in by_length.items()}
    places = spark.sparkContext.broadcast(by_length)
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = dealt.withColumn("r", F.row_number().over(order) - 1).join(sums.drop("n"), ["length", "bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("r") + F.col("before")).alias("rank"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
        sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
        for n in np.unique(length):
            mine, at = length == n, places.value[int(n)]
            k = np.searchsorted(at[:, 0], rank[mine], side="right") - 1
            sequence[mine], offset[mine] = at[k, 1] + rank[mine] - at[k, 0], at[k, 2]
        return pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return arrow_map(ranked, run, PIECES + ", sequence_id long, offset long")


def best_fit_packing(docs: DataFrame, tokenizer_path: str, size: int = 2048) -> DataFrame:
    """Every document's pieces with their sequence and place. Equal rows get places of their own; an empty table gives no rows."""
    return pack(materialize(tokenized_pieces(docs, tokenizer_path, size), "pieces"), size)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the pieces of all ``documents`` in sequences of 2048 ids."""
    import public_tokenizers

    return best_fit_packing(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
