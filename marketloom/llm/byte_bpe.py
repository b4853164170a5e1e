"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The queue has one bucket for each merge rank, holding positions of a linked list
of symbols, and a bitmap of two levels of 256-bit words over the non-empty
buckets. Find-first-set on the levels gives the lowest rank in a fixed number of
steps, whatever the length of the pre-token; entries whose pair has changed since
they were pushed are skipped. A pre-token of n bytes takes O(n log n) steps.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import HalvedCache, arrow_map, table

#: White space in which a space is no sure beginning of a pre-token.
TANGLED = re.compile(r"\s \s|  ").search
#: One bit each; a vocabulary of 2**20 ranks has no more words of 256 bits.
BIT = [1 << k for k in range(4096)]


def parse_ranks(body: bytes) -> dict[bytes, int]:
    """The ranks of a file with a base64 token and its rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, body.splitlines()) if token}


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token; an empty one has none. A byte without a rank raises KeyError.

    The queue: ``buckets`` holds a heap of positions for each rank, ``low`` a
    word of 256 bits for each 256 ranks, ``top`` a bit for each such word. Of
    equal ranks, the leftmost pair merges first.
    """
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n, get = len(piece), ranks.get
    after, before = list(range(1, n + 1)), list(range(-1, n))
    pair = [get(piece[i : i + 2], -1) for i in range(n - 1)]  # the rank that a symbol makes with its successor; -1: none
    pair += [-1, -1]
    buckets: dict[int, list[int]] = {}
    low: dict[int, int] = {}
    top = 0
    for i, rank in enumerate(pair):
        if rank >= 0:
            if rank in buckets:
                buckets[rank].append(i)
            else:
                buckets[rank] = [i]
                g = rank >> 8
                if g in low:
                    low[g] |= BIT[rank & 255]
                else:
                    low[g] = BIT[rank & 255]
                    top |= BIT[g]
    while top:
        g = (top & -top).bit_length() - 1
        word = low[g]
        rest = word & (word - 1)
        rank = g << 8 | (word ^ rest).bit_length() - 1
        bucket = buckets[rank]
        if len(bucket) > 1:
            i = heappop(bucket)
        else:
            i = bucket[0]
            del buckets[rank]
            if rest:
                low[g] = rest
            else:
                del low[g]
                top &= top - 1
        if pair[i] != rank:
            continue  # stale: the pair was merged or has grown since
        gone = after[i]
        pair[gone] = -1
        after[i] = end = after[gone]
        if end < n:
            before[end] = i
            pair[i] = rank = get(piece[i : after[end]], -1)
            if rank >= 0:
                if rank in buckets:
                    heappush(buckets[rank], i)
                else:
                    buckets[rank] = [i]
                    g = rank >> 8
                    if g in low:
                        low[g] |= BIT[rank & 255]
                    else:
                        low[g] = BIT[rank & 255]
                        top |= BIT[g]
        else:
            pair[i] = -1
        last = before[i]
        if last >= 0:
            pair[last] = rank = get(piece[last:end], -1)
            if rank >= 0:
                if rank in buckets:
                    heappush(buckets[rank], last)
                else:
                    buckets[rank] = [last]
                    g = rank >> 8
                    if g in low:
                        low[g] |= BIT[rank & 255]
                    else:
                        low[g] = BIT[rank & 255]
                        top |= BIT[g]
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


def pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Codec:
    """Encodes and decodes texts; ``pattern`` splits a text into pre-tokens, which are merged separately."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, limit: int = 800_000):
        import regex

        self.find = regex.compile(pattern).findall
        self.tokens: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.pieces = HalvedCache(lambda piece: pack_ids(encode_piece(piece.encode(), ranks)), limit)
        self.spaced = HalvedCache(lambda word: self.split_encode(" " + word), limit // 2)

    def split_encode(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.find(text)))

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers.

        Under the patterns in use (a token takes one leading space), a pre-token
        begins at every space that doesn't stand between white space, so text is cut there first and words are remembered.
        """
        if TANGLED(text):
            return self.split_encode(text)
        first, *words = text.split(" ")
        return self.split_encode(first) + b"".join(map(self.spaced.__getitem__, words))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(body: bytes, pattern: str) -> Codec:
    """One codec for each vocabulary and worker process."""
    key = hashlib.sha256(body).hexdigest(), pattern
    if key not in _CODECS:
        _CODECS[key] = Codec(parse_ranks(body), pattern)
    return _CODECS[key]


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array of int) of every whole text; null counts as empty and has no ids."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(open(ranks_path, "rb").read())  # a vocabulary file: under 1 MB

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(vocabulary.value, pattern)
        packed = [c.encode(t or "") for t in batch.column(1).to_pylist()]
        ends = np.cumsum([0, *(len(p) // 4 for p in packed)]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), "<u4").astype(np.int32)))
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), ids], ["doc_id", "ids"])

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, body (binary): the bytes that the ids stand for; null ids give empty bytes."""
    vocabulary = encoded.sparkSession.sparkContext.broadcast(open(ranks_path, "rb").read())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(vocabulary.value, pattern)
        bodies = [c.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(bodies, pa.binary())], ["doc_id", "body"])

    return arrow_map(encoded.select("doc_id", "ids"), run, "doc_id long, body binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of the ids and of what they decode to, without moving the ids."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(open(ranks_path, "rb").read())

    def rows(texts: Iterator[str | None], c: Codec) -> Iterator[tuple[int, str, str]]:
        for text in texts:
            packed = c.encode(text or "")
            yield len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(c.decode(packed)).hexdigest()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, ids, decoded = zip(*rows(batch.column(1).to_pylist(), codec(vocabulary.value, pattern)), strict=True)
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
