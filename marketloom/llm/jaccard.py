"""Exact Jaccard self-join of documents' word n-grams in the metric space of sets.

Unrelated documents are all at Jaccard distance 1 of each other, where windows of
document pivots would replicate everything everywhere. So the corpus is parted
first, without loss: the hash range of shingles is cut into so many parts that two
linked sets, which differ in a bounded number of shingles, agree on a whole part.
The digest of a part with enough shingles is a signature, and sets that share
signatures hang together in regions; chance hardly makes two sets agree on a part.

Inside every region, of whatever size, distances are telling and pivots take over:
members go to the Voronoi cell of the nearest pivot and, as the triangle inequality
demands, to the cells within the window of twice the radius, unless all members are
known to hang together. Cells are joined recursively. A region whose sets fit in a
task is joined there; a larger one is split by the same step over many tasks first.

Distances below the radius are found on whole sets, so the links are exact; a
shingle stands for its words by 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, arrow_map, discard, materialize, table

#: Bytes of the sets that one task joins; pivots of a larger region in a round (at most 62); members of a cell that are compared one by one.
LEAF_BYTES, PIVOTS, FEW = 32 << 20, 24, 8
#: Signatures that one task groups, that a writing task holds at once, and groups at least.
BLOCK, HELD, LEAST_BLOCKS = 2_000_000, 2_000_000, 32
#: Sets of a batch that hold a shingle for it to be sent last; bits of the map of such shingles, 16 MB to every task.
FREQUENT, COMMON_BITS = 4, 27
#: Bytes of texts whose sets are made together.
CHUNK = 1 << 20
#: Bytes of a word that are hashed eight by eight; longer words are hashed one by one.
LONG = 64
#: Whether a byte belongs to a word.
LETTERS = ~np.isin(np.arange(256), list(BLANKS))
MEMBERS = "region string, rep long, n long, known boolean, tokens binary"


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(64 bits for each word of each text, A-Z lower-cased; the number of each text's words)."""
    import xxhash

    body = b" ".join([t or b"" for t in texts]).lower() + b" " * 8
    letter = LETTERS[np.frombuffer(body, np.uint8)]
    turn = np.flatnonzero(letter[1:] != letter[:-1]) + 1
    begin, end = (turn[1::2], turn[2::2]) if letter[0] else (turn[::2], turn[1::2])
    if letter[0]:
        begin, end = np.concatenate(([0], begin)), turn[::2]
    size = end - begin
    eight = np.ndarray(len(body) - 7, "<u8", body, strides=(1,))  # the eight bytes from each place on
    h = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    rest = np.arange(len(h))
    for k in range(0, LONG, 8):
        rest = rest[size[rest] > k]
        if not len(rest):
            break
        bits = np.uint64(8) * np.minimum(size[rest] - k, 8).astype(np.uint64)
        x = (h[rest] ^ eight[begin[rest] + k] & np.uint64((1 << 64) - 1) >> (np.uint64(64) - bits)) * np.uint64(0xD6E8FEB86659FD93)
        h[rest] = x ^ x >> np.uint64(32)
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(body[begin[i] : end[i]])
    place = np.cumsum([len(t or b"") + 1 for t in texts])
    return h, np.diff(np.searchsorted(begin, place), prepend=0)


def shingle_sets(texts: list[bytes | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, sizes): the sorted distinct shingles of each whole text, A-Z lower-cased, one set after the other; with fewer words all of them make one; without words there are none."""
    w, count = word_hashes(texts)
    end, total = np.cumsum(count), len(w)
    if not total:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    h, begins = np.zeros(total, np.uint64), np.ones(total, bool)  # a shingle begins at each word but a text's last width - 1

    def hashed(at: np.ndarray | slice, k: int) -> None:
        x = np.full(len(range(total)[at]) if isinstance(at, slice) else len(at), np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        for i in range(k):
            x ^= w[i : total - k + 1 + i] if isinstance(at, slice) else w[at + i]
            x *= np.uint64(0xD6E8FEB86659FD93)
            x ^= x >> np.uint64(32)
        h[at] = x

    if total >= width:
        hashed(slice(0, total - width + 1), width)
    for k in range(1, width):
        begins[(end - k)[count >= k]] = False
    for k in range(1, width):
        short = (end - count)[count == k]
        begins[short] = True
        hashed(short, k)
    h, size = h[begins], np.where(count >= width, count - width + 1, np.minimum(count, 1))
    end = np.cumsum(size)
    for a, b in zip((end - size).tolist(), end.tolist(), strict=True):
        h[a:b].sort()
    new = np.concatenate(([True], h[1:] != h[:-1]))
    new[(end - size)[size > 0]] = True
    return h[new], np.diff(np.concatenate(([0], np.cumsum(new)))[end], prepend=0)


def in_chunks(column: pa.Array) -> Iterator[list[bytes | None]]:
    """A column of texts in lists of CHUNK bytes or little more, which numpy handles at once."""
    held, n = [], 0
    for text in column.cast(pa.binary()).to_pylist():
        held.append(text)
        n += len(text or b"")
        if n >= CHUNK or len(held) >= CHUNK >> 6:
            yield held
            held, n = [], 0
    if held:
        yield held


def sets_of(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The set of each text of a column."""
    for texts in in_chunks(column):
        flat, sizes = shingle_sets(texts, width)
        yield from np.split(flat, np.cumsum(sizes)[:-1])


def set_key(tokens: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(tokens.tobytes())


def short_key(key: bytes) -> int:
    """64 bits of a set's key; sets that share them share regions, which costs time but no link."""
    return int.from_bytes(key[:8], "little", signed=True)


# --- signatures -----------------------------------------------------------------------------------


class Tag:
    """How sets of two neighbouring size classes are parted: linked ones differ in at most ``differ`` shingles.

    Class j holds sizes low..high with 100 * low >= percent * high, so linked sets
    are of one class or of neighbours; tag j serves pairs of class j and of j - 1
    with j. Of ``parts`` parts, linked sets agree on ``spare`` + 1 and more. A part
    is rich from ``rich`` shingles on: two where a set's parts have enough of them.
    """

    def __init__(self, number: int, below: int, low: int, high: int, percent: int):
        self.number, self.low, self.high = number, low, high
        self.differ = max(below * (100 - percent) // percent, 2 * high * (100 - percent) // (100 + percent))
        self.rich = 2 if low >= 4 * (self.differ * 9 // 8 + 2) else 1
        self.spare = self.differ // (8 if self.rich == 2 else 4) + 1
        self.parts = self.differ + 1 + self.spare


class Tags:
    def __init__(self, percent: int):
        self.percent, self.tags, self.highs = percent, [], []

    def of(self, n: int) -> tuple[Tag, Tag]:
        """The two tags of a set of n shingles."""
        while len(self.highs) < 2 or self.highs[-2] < n:
            low = self.highs[-1] + 1 if self.highs else 1
            self.tags.append(Tag(len(self.tags), self.highs[-1] if self.highs else 0, low, low * 100 // self.percent, self.percent))
            self.highs.append(self.tags[-1].high)
        at = int(np.searchsorted(self.highs, n))
        return self.tags[at], self.tags[at + 1]

    def table(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The number of each size's first tag (the second is the next one), and ``differ``, ``parts`` and ``rich`` of all tags."""
        self.of(int(sizes.max()))
        return np.searchsorted(self.highs, sizes), *(np.array([getattr(t, x) for t in self.tags], np.int64) for x in ("differ", "parts", "rich"))


@lru_cache(maxsize=8)
def tags_of(percent: int) -> Tags:
    return Tags(percent)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def signatures(tokens: np.ndarray, percent: int, common: np.ndarray | None = None) -> np.ndarray:
    """The signatures of one set; ``common`` shingles come last."""
    return set_signatures(tokens, np.array([len(tokens)]), percent, None if common is None else np.isin(tokens, common))[0]


def set_signatures(flat: np.ndarray, sizes: np.ndarray, percent: int, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(digests of which two different linked sets share at least one, the number of each one's set); the sets lie one after the other.

    Under each of its tags a set sends its rich parts. Linked sets agree on
    parts - differ of them, so on ``sure`` rich ones, if that many less the poor
    parts of one of the two are left. Sets with more poor parts than are to spare
    also send the first shingles in hash order, of which two linked sets share one.

    Parts of ``common`` shingles (a flag of each shingle) would hang together
    whatever quotes them, and parts of few others what chance alone makes meet.
    Let an order of all parts begin with those of most other shingles: then a set
    needn't send its last sure - 1, since the first of the shared ones isn't among
    them, for either set.
    """
    if not len(flat):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out, owners = [], []
    start, end, high = np.cumsum(sizes) - sizes, np.cumsum(sizes), flat >> np.uint64(32)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mixed(flat))))
    others = np.concatenate(([0], np.cumsum(np.ones(len(flat), bool) if common is None else ~common)))
    first, differs, all_parts, riches = tags_of(percent).table(sizes)
    for number in (first, first + 1):
        differ, parts, base = differs[number], all_parts[number], np.cumsum(all_parts[number]) - all_parts[number]
        live, name = (differ > 0) & (sizes > 0), number.astype(np.uint64) << np.uint64(40)  # else only equal sets link
        cell = (high * np.repeat(parts.astype(np.uint64), sizes)) >> np.uint64(32)  # as ordered as the tokens
        new = np.concatenate(([True], cell[1:] != cell[:-1]))
        new[start[sizes > 0]] = True
        begin = np.flatnonzero(new)
        finish, owner = np.append(begin[1:], len(flat)), np.searchsorted(end, begin, "right")
        rich = (finish - begin >= riches[number][owner]) & live[owner]
        begin, finish, owner = begin[rich], finish[rich], owner[rich]
        signs = (sums[finish] - sums[begin]) ^ _mixed(cell[begin] + name[owner])
        sure = np.bincount(owner, minlength=len(sizes)) - differ
        may = np.flatnonzero(sure[owner] > 1)
        few = np.minimum(others[finish[may]] - others[begin[may]], 255).astype(np.uint64)
        by = np.lexsort((few << np.uint64(56) | signs[may] >> np.uint64(8), owner[may]))
        may, of = may[by], owner[may]
        last = may[np.arange(len(of)) - np.searchsorted(of, of) < sure[of] - 1]
        signs, owner = np.delete(signs, last), np.delete(owner, last)
        out.append(signs)
        owners.append(owner)
        if len(poor := np.flatnonzero(live & (sure < 1))):
            take = sizes[poor] - (percent * sizes[poor] + 99) // 100 + 1
            at = np.arange(take.sum()) + np.repeat(start[poor] - np.cumsum(take) + take, take)
            out.append(flat[at] ^ np.repeat(_mixed(name[poor] + np.uint64(1 << 39)), take))
            owners.append(np.repeat(poor, take))
    return _mixed(np.concatenate(out)), np.concatenate(owners)


def hanging(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number that each of 0..n-1 hangs together with, by the edges a-b."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new


def together(signs: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(label of each owner, the distinct signatures in order, one owner of each): owners that share the upper 44 bits of a signature hang together; there are at most a million owners."""
    packed = np.sort(signs & ~np.uint64((1 << 20) - 1) | owner.astype(np.uint64))
    signs, owner = packed & ~np.uint64((1 << 20) - 1), (packed & np.uint64((1 << 20) - 1)).astype(np.int64)
    same = np.flatnonzero(signs[1:] == signs[:-1])
    label = hanging(n, *spanning(owner[same], owner[same + 1]))
    start = np.flatnonzero(np.concatenate(([True], signs[1:] != signs[:-1])))
    return label, signs[start], label[owner[start]]


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct edges of a-b, both under 2**32."""
    edges = np.unique(a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64))
    return (edges >> np.uint64(32)).astype(np.int64), (edges & np.uint64((1 << 32) - 1)).astype(np.int64)


def set_table(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, key (a digest of the set) and short (64 bits of it) of every row; and in one row of a batch ``often``, shingles of FREQUENT and more of its sets."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = list(sets_of(batch.column(1), width))
        keys = [set_key(s) for s in sets]
        held = np.sort(np.concatenate(list(dict(zip(keys, sets, strict=True)).values())))
        often = np.unique(held[FREQUENT - 1 :][held[FREQUENT - 1 :] == held[: max(0, len(held) - FREQUENT + 1)]]).tobytes()
        columns = [batch.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(map(short_key, keys), pa.int64()), pa.array([often] + [None] * (len(sets) - 1), pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "key", "short", "often"])

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, n_shingles long, key binary, short long, often binary")


def common_shingles(sets: DataFrame) -> np.ndarray:
    """The shingles that a batch has often, as a map of 2**COMMON_BITS bits by their upper bits. They decide what is sent last, so they change time, not links; nor does it matter that some share a bit."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for often in batch.column(0).to_pylist():
            places = np.frombuffer(often, np.uint64) >> np.uint64(64 - COMMON_BITS)
            yield pa.RecordBatch.from_arrays([pa.array((places >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (places & np.uint64(63))).view(np.int64))], ["word", "bits"])

    found = arrow_map(sets.where("often IS NOT NULL").select("often"), run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << COMMON_BITS - 6, np.uint64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def in_map(bits: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Whether each shingle's bit is set."""
    places = flat >> np.uint64(64 - COMMON_BITS)
    return bits[places >> np.uint64(6)] >> (places & np.uint64(63)) & np.uint64(1) != 0


BLOCKS = "block long, signs binary, owner binary, names binary, pairs binary"


def dealt(sets: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], blocks: int) -> Iterator[pa.RecordBatch]:
    """The signatures of (names, signatures, the number of each one's name), dealt by hash range: block, signs (40 bits, low four bytes first, then the fifth ones), owner, names, and pairs of names that hang together already.

    A task sends a signature once, however many of its sets have it; those hang
    together, which ``pairs`` say. With 40 bits (20 to 59), chance makes about one
    signature in a hundred thousand coincide with another, which costs time but no link. So a group
    of near copies that fills a third of the rows is one entry a task.
    """

    def flush(named: np.ndarray, signs: np.ndarray, owner: np.ndarray) -> Iterator[pa.RecordBatch]:
        label, signs, owner = together(signs, owner, len(named))
        rows = []
        block = ((signs >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
        ends = np.searchsorted(block, np.arange(blocks + 1, dtype=np.uint64))
        moved = np.flatnonzero(label != np.arange(len(label)))
        to = named[label[moved]] % blocks
        moved = moved[np.argsort(to, kind="stable")]
        bounds = np.searchsorted(np.sort(to), np.arange(blocks + 1))
        for b in range(blocks):
            mine = moved[bounds[b] : bounds[b + 1]]
            pairs = np.stack([named[label[mine]], named[mine]], 1)
            if ends[b] < ends[b + 1] or len(pairs):
                present, index = np.unique(owner[ends[b] : ends[b + 1]], return_inverse=True)
                here = signs[ends[b] : ends[b + 1]] >> np.uint64(20)
                rows.append((b, here.astype(np.uint32).tobytes() + (here >> np.uint64(32)).astype(np.uint8).tobytes(), index.astype(np.uint16 if len(present) < 65536 else np.uint32).tobytes(), named[present].tobytes(), pairs.tobytes()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["block", "signs", "owner", "names", "pairs"])

    parts, held, n = [], 0, 0
    for names, signs, owner in sets:
        parts.append((names, signs, owner + n))
        held, n = held + len(signs), n + len(names)
        if held >= HELD or n >= HELD // 4:
            yield from flush(*map(np.concatenate, zip(*parts, strict=True)))
            parts, held, n = [], 0, 0
    if held:
        yield from flush(*map(np.concatenate, zip(*parts, strict=True)))


def signature_blocks(docs: DataFrame, width: int, percent: int, blocks: int, common: np.ndarray) -> DataFrame:
    """The signatures of the documents' sets under their short keys; of the sets that a task has met lately, each once."""
    last = docs.sparkSession.sparkContext.broadcast(common)  # 2**COMMON_BITS bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sets() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            seen: set[int] = set()
            for batch in batches:
                ids = iter(batch.column(0).to_pylist())
                for texts in in_chunks(batch.column(1)):
                    flat, sizes = shingle_sets(texts, width)
                    end, new = np.cumsum(sizes).tolist(), np.zeros(len(sizes), bool)
                    names = np.zeros(len(sizes), np.int64)
                    for k, (n, doc_id) in enumerate(zip(sizes.tolist(), ids)):  # noqa: B905  the ids of all chunks
                        if n and doc_id is not None and (name := short_key(set_key(flat[end[k] - n : end[k]]))) not in seen:
                            if len(seen) >= HELD // 8:
                                seen.clear()
                            seen.add(name)
                            names[k], new[k] = name, True
                    flat, sizes = flat[np.repeat(new, sizes)], sizes[new]
                    yield names[new], *set_signatures(flat, sizes, percent, in_map(last.value, flat))

        yield from dealt(sets(), blocks)

    return docs.select("doc_id", "text").mapInArrow(run, BLOCKS)


def _bound(parts: pd.DataFrame) -> pd.DataFrame:
    """Edges that span the sets which hang together by a block's signatures and pairs."""
    names, pairs = [np.frombuffer(x, np.int64) for x in parts["names"]], np.frombuffer(b"".join(parts["pairs"]), np.int64)
    known = np.unique(np.concatenate([*names, pairs]))
    signs, owner = [], []
    for p, k in zip(parts.itertuples(), names, strict=True):
        count = len(p.signs) // 5
        signs.append(np.frombuffer(p.signs, np.uint32, count) | np.frombuffer(p.signs, np.uint8, offset=4 * count).astype(np.uint64) << np.uint64(32))
        owner.append(np.searchsorted(known, k)[np.frombuffer(p.owner, np.uint16 if len(k) < 65536 else np.uint32)])
    s, owner, index = np.concatenate(signs), np.concatenate(owner), np.searchsorted(known, pairs)
    order = np.argsort(s, kind="stable")
    s, owner = s[order], owner[order]
    same = s[1:] == s[:-1]
    a, b = np.concatenate([owner[:-1][same], index[::2]]), np.concatenate([owner[1:][same], index[1::2]])
    label = hanging(len(known), a, b)
    moved = np.flatnonzero(label != np.arange(len(label)))
    return pd.DataFrame({"a": known[label[moved]], "b": known[moved]})


#: Edges that one task contracts.
EDGES = 4_000_000


def forest(edges: DataFrame) -> DataFrame:
    """a, b: fewer edges that hang the same numbers together; a task reduces all its edges to a spanning forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.stack([b.column(i).to_numpy() for i in (0, 1)]) for b in batches if b.num_rows]
        if held:
            known, index = np.unique(np.concatenate(held, axis=1), return_inverse=True)
            label = hanging(len(known), *index.reshape(2, -1))
            moved = np.flatnonzero(label != np.arange(len(label)))
            yield pa.RecordBatch.from_arrays([pa.array(known[label[moved]]), pa.array(known[moved])], ["a", "b"])

    tasks, edges = -(-edges.count() // EDGES), edges.select("a", "b")
    return (edges.coalesce(1) if tasks < 2 else edges.repartition(tasks, "a")).mapInArrow(run, "a long, b long")


def block_count(total: int, percent: int) -> int:
    """A set of n shingles has about 2.2 * n * (100 - percent) / 85 signatures."""
    return max(LEAST_BLOCKS, -(-total * 22 * (100 - percent) // 850 // BLOCK))


def hung(signed: DataFrame, blocks: int) -> DataFrame:
    """a, b: edges that hang together the names that share signatures."""
    found = materialize(signed.repartition(blocks, "block").groupBy("block").applyInPandas(_bound, "a long, b long"), "found")
    edges = materialize(forest(found), "edges")
    discard(found)
    return edges


def regions(docs: DataFrame, groups: DataFrame, total: int, width: int, percent: int, common: np.ndarray) -> DataFrame:
    """id, component: the sets that hang together by signatures, those with company only."""
    blocks = block_count(total, percent)
    edges = hung(signature_blocks(docs, width, percent, blocks, common), blocks)
    # sets that share 64 bits of their key are taken as hanging together
    twins = groups.groupBy("short").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a != b").select("a", "b")
    one = groups.groupBy("short").agg(F.min("rep").alias("rep"))
    named = edges.join(one.select(F.col("short").alias("a"), F.col("rep").alias("x")), "a").join(one.select(F.col("short").alias("b"), F.col("rep").alias("y")), "b")
    both = materialize(named.select(F.col("x").alias("a"), F.col("y").alias("b")).where("a != b").unionByName(twins), "rep-edges")
    out = components(both)
    discard(edges, both)
    return out


def region_sizes(members: DataFrame, leaf: int) -> DataFrame:
    """region, bytes, unknown (members not known to hang together): the regions whose sets don't fit in a task."""
    of = members.groupBy("region").agg(F.sum(8 * F.col("n")).alias("bytes"), F.count_if(~F.col("known")).alias("unknown"))
    return materialize(of.where(F.col("bytes") > leaf), "large")


def parted_again(members: DataFrame, percent: int, leaf: int) -> DataFrame:
    """The members, with large regions parted by signatures of fresh hashes, as long as these part them.

    What chance or a common passage hangs together under one hash falls apart
    under another; linked sets hang together under all, so no link is lost.
    Members that are left alone go.
    """
    round_, last = 0, None
    while True:
        sizes = region_sizes(members, leaf)
        total = sizes.agg(F.sum("bytes")).first()[0] or 0
        if not total or (last is not None and total > 0.8 * last):
            return members
        round_, last = round_ + 1, total
        large = members.join(sizes.select("region"), "region", "left_semi")
        blocks, seed = block_count(total // 8, percent), np.uint64(round_ * 0xD1B54A32D192ED03 & (1 << 64) - 1)

        def run(batches: Iterator[pa.RecordBatch], blocks: int = blocks, seed: np.uint64 = seed) -> Iterator[pa.RecordBatch]:
            def sets() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
                for batch in batches:
                    for rep, mark, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                        own = np.sort(_mixed(np.frombuffer(tokens, np.uint64) ^ seed))
                        signs = _mixed(signatures(own, percent) ^ np.uint64(mark & (1 << 64) - 1))
                        yield np.array([rep]), signs, np.zeros(len(signs), np.int64)

            yield from dealt(sets(), blocks)

        edges = hung(large.select("rep", F.xxhash64("region"), "tokens").mapInArrow(run, BLOCKS), blocks)
        found = components(edges)
        named = large.join(found, large.rep == found.id).select(F.concat_ws("+", "region", "component").alias("region"), "rep", "n", "known", "tokens")
        members = materialize(members.join(sizes.select("region"), "region", "left_anti").unionByName(named), "members")
        discard(edges)


# --- pivots inside regions ----------------------------------------------------------------------


class Sets:
    """Sets side by side, to find the distances of one to all."""

    def __init__(self, tokens: list[bytes]):
        arrays = [np.frombuffer(t, np.uint64) for t in tokens]
        self.sizes = np.array([len(a) for a in arrays], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)[:-1]))
        self.vocabulary, self.flat = np.unique(np.concatenate(arrays), return_inverse=True)

    def shared(self, tokens: np.ndarray) -> np.ndarray:
        """The size of each set's intersection with the given one."""
        marks = np.zeros(len(self.vocabulary), np.int64)
        at = np.searchsorted(self.vocabulary, tokens)
        at = np.minimum(at, len(self.vocabulary) - 1)
        marks[at[self.vocabulary[at] == tokens]] = 1
        return np.add.reduceat(marks[self.flat], self.starts)

    def of(self, i: int) -> np.ndarray:
        return self.vocabulary[self.flat[self.starts[i] : self.starts[i] + self.sizes[i]]]

    def some(self, members: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """How many marked shingles each of the members has."""
        flat = np.concatenate([self.flat[self.starts[i] : self.starts[i] + self.sizes[i]] for i in members])
        sizes = self.sizes[members]
        return np.add.reduceat(marks[flat], np.concatenate(([0], np.cumsum(sizes)[:-1])))


class RegionJoin:
    """The links that span the components of one region in memory; ``known`` members hang together already.

    Sizes of intersections are whole numbers, so the radius is exact; windows are
    a little wide for the rounding of distances.
    """

    def __init__(self, reps: np.ndarray, known: np.ndarray, tokens: list[bytes], percent: int):
        self.reps, self.percent, self.radius = reps, percent, (100 - percent) / 100
        self.sets, self.parent, self.links, self.cells, self.fresh = Sets(tokens), list(range(len(reps))), [], 0, 0
        self.marks = np.zeros(len(self.sets.vocabulary), np.int64)
        first = np.flatnonzero(known)
        for i in first[1:]:
            self.link(int(first[0]), int(i), False)

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def link(self, i: int, j: int, told: bool = True) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.parent[b] = a
            if told:
                self.links.append((int(self.reps[i]), int(self.reps[j])))

    def ball(self, pivot: int, members: np.ndarray) -> np.ndarray:
        """Link a pivot with the members within the radius; the distances of all members."""
        at = self.sets.starts[pivot]
        own = self.sets.flat[at : at + self.sets.sizes[pivot]]
        self.marks[own] = 1
        both = self.sets.some(members, self.marks)
        self.marks[own] = 0
        union = self.sets.sizes[members] + self.sets.sizes[pivot] - both
        for j in members[100 * both >= self.percent * union].tolist():
            self.link(pivot, j)
        return 1 - both / union

    def run(self) -> list[tuple[int, int]]:
        todo = [np.arange(len(self.reps))]
        while todo:
            members = todo.pop()
            roots = np.array([self.root(i) for i in members.tolist()])
            if (roots == roots[0]).all():
                continue  # no link here joins what isn't joined
            if len(members) <= FEW:
                self.compare(members, roots)
                continue
            pivots = self.choose(members, roots)
            d = np.stack([self.ball(p, members) for p in pivots], 1)
            roots = np.array([self.root(i) for i in members.tolist()])
            if (roots == roots[0]).all():
                continue
            home = d.argmin(1)
            near = d[np.arange(len(members)), home]
            cells = []
            for p in range(len(pivots)):
                cell = home == p
                if not cell.any():
                    continue
                # a linked pair of two cells meets in the first: d(y, p) <= d(y, home) + 2r and <= the cell's extent + r
                window = (home > p) & (d[:, p] <= np.minimum(near + 2 * self.radius, near[cell].max() + self.radius) + 1e-9)
                rest = members[(cell | window) & ~np.isin(members, pivots)]  # pivots have met all
                if len(rest) > 1:
                    cells.append(rest)
            self.cells += len(cells)
            if not any(len(c) > 0.9 * len(members) for c in cells):
                todo += cells
                continue
            # no pivot parts these; fresh signatures may, without loss
            rest = members[~np.isin(members, pivots)]
            self.fresh += 1
            parted = self.parted(rest)
            if len(parted) == 1:
                self.compare(rest, np.array([self.root(i) for i in rest.tolist()]))
            else:
                todo += [x for x in parted if len(x) > 1]
        return self.links

    def parted(self, members: np.ndarray) -> list[np.ndarray]:
        """The members that hang together by signatures under a hash of their own."""
        seed = np.uint64(self.fresh * 0xD1B54A32D192ED03 & (1 << 64) - 1)
        own = [np.sort(_mixed(self.sets.of(i) ^ seed)) for i in members.tolist()]
        signs, owner = set_signatures(np.concatenate(own), np.array(list(map(len, own))), self.percent)
        if not len(signs):
            return [members[i : i + 1] for i in range(len(members))]
        label, _, _ = together(signs, owner, len(members))
        return [members[label == x] for x in np.unique(label)]

    def choose(self, members: np.ndarray, roots: np.ndarray) -> np.ndarray:
        """Pivots: of different components as far as there are, by size, about the square root of the members."""
        count = min(PIVOTS, max(2, int(len(members) ** 0.5)))
        order = members[np.lexsort((self.reps[members], -self.sets.sizes[members]))]
        _, first = np.unique([self.root(i) for i in order.tolist()], return_index=True)
        leading = np.sort(first)[:count]
        others = np.setdiff1d(np.linspace(0, len(order) - 1, count).astype(int), leading)
        return order[np.concatenate([leading, others])[:count]]

    def compare(self, members: np.ndarray, roots: np.ndarray) -> None:
        """Each member not of the component that holds most becomes a pivot of the others; of two of different components one is such a member.

        Members are told by what they lack of a centre or have beside it. Of these
        differences, with a list of members each, x and y share s(x, y), and their
        intersection is |centre| - lacking(x) - lacking(y) + s(x, y). So a pivot's
        distances cost as many steps as its differences occur, not all shingles.
        """
        values, counts = np.unique(roots, return_counts=True)
        main = values[counts.argmax()]
        others = np.flatnonzero(roots != main)
        if not len(others):
            return
        if len(members) <= FEW:
            for i in members[others].tolist():
                left = np.array([j for j in members.tolist() if self.root(j) != self.root(i)])
                if len(left):
                    self.ball(i, left)
            return
        sizes = self.sets.sizes[members]
        flat = np.concatenate([self.sets.flat[self.sets.starts[i] : self.sets.starts[i] + self.sets.sizes[i]] for i in members.tolist()])
        owner = np.repeat(np.arange(len(members)), sizes)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        begin = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
        count = np.diff(np.append(begin, len(flat)))
        centre = 2 * count > len(members)  # the shingles that most members have
        everyone = np.arange(len(members))
        lists = [np.setdiff1d(everyone, owner[a : a + n], assume_unique=True) for a, n in zip(begin[centre], count[centre], strict=True)]
        lacking = np.bincount(np.concatenate(lists or [everyone[:0]]), minlength=len(members))
        beside = ~centre & (count > 1)  # what one alone has is shared with no other
        lists += [owner[a : a + n] for a, n in zip(begin[beside], count[beside], strict=True)]
        held, who = np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate(lists or [everyone[:0]])
        mine, first = held[np.argsort(who, kind="stable")], np.concatenate(([0], np.cumsum(np.bincount(who, minlength=len(members)))))
        whole = int(centre.sum())
        for k in others.tolist():
            own = mine[first[k] : first[k + 1]]
            same = np.bincount(np.concatenate([lists[t] for t in own]), minlength=len(members)) if len(own) else np.zeros(len(members), np.int64)
            both = whole - lacking[k] - lacking + same
            for j in np.flatnonzero(100 * both >= self.percent * (sizes + sizes[k] - both)).tolist():
                self.link(int(members[k]), int(members[j]))


def leaf_links(reps: np.ndarray, known: np.ndarray, tokens: list[bytes], percent: int) -> list[tuple[int, int]]:
    """Links that span the components of a region that fits in memory, by recursive Voronoi cells; ``known`` members hang together already."""
    return RegionJoin(reps, known, tokens, percent).run()


def join_leaves(members: DataFrame, percent: int) -> DataFrame:
    """Links of all regions; a task goes through its regions one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, []

        def done() -> list[tuple[int, int]]:
            unique = {r: (k, t) for r, k, t in held}
            if len(unique) < 2:
                return []
            return leaf_links(np.array(list(unique)), np.array([k for k, _ in unique.values()]), [t for _, t in unique.values()], percent)

        for batch in batches:
            out: list[tuple[int, int]] = []
            for region, rep, known, tokens in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if region != name:
                    out += done()
                    name, held = region, []
                held.append((rep, known, tokens))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])
        if out := done():
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

    return members.select("region", "rep", "known", "tokens").repartition("region").sortWithinPartitions("region", "rep").mapInArrow(run, "a long, b long")


def voronoi(members: DataFrame, sizes: DataFrame, percent: int, leaf: int, round_: int) -> tuple[DataFrame, DataFrame]:
    """(links, members of the cells) of large regions. The members of a region are salted, its pivots copied to each salt.

    Pivots are members not known to hang together with the region's largest
    component; a pivot meets all members, so it is settled and leaves the region.
    Other unknown members go to all cells in their window, known ones to the cell
    of their own pivot. Cells without an unknown member are done.
    """
    draw = F.xxhash64("rep", F.lit(round_))
    sized = members.join(sizes, "region").withColumn("salts", F.ceil(F.col("bytes") / leaf).cast("int"))
    # at most as many as fit in a task beside the members it holds
    drawn = sized.where(~F.col("known") & (F.pmod(draw, F.col("unknown")) < PIVOTS)).select("region", "salts", "rep", "tokens", draw.alias("draw"))
    first = sized.where(~F.col("known")).groupBy("region").agg(F.first("salts").alias("salts"), F.min(F.struct(draw.alias("draw"), "rep", "tokens")).alias("first"))
    some = drawn.groupBy("region").agg(F.slice(F.sort_array(F.collect_list(F.struct("draw", "rep", "tokens"))), 1, 62).alias("pivots"))  # PIVOTS on average
    bundle = first.join(some, "region", "left").select("region", "salts", F.coalesce("pivots", F.array("first")).alias("pivots"))
    copies = materialize(bundle, "pivots").select("region", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "pivots")
    salted = sized.withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("salts")).cast("int")).select("region", "salt", "rep", "n", "known", "tokens")
    radius = (100 - percent) / 100

    def run(key: tuple, rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame(columns=["region", "rep", "n", "known", "tokens", "settled", "home", "windows", "balls", "linked"])
        held = list(pivots["pivots"].iloc[0]) if len(pivots) else []
        out = rows[["region", "rep", "n", "known", "tokens"]].copy()
        if not held:
            return out.assign(settled=False, home=0, windows=0, balls=0, linked=[[] for _ in range(len(out))])
        sets = Sets(list(rows["tokens"]))
        close, d = [], []
        for p in held:
            tokens = np.frombuffer(p["tokens"], np.uint64)
            both = sets.shared(tokens)
            union = sets.sizes + len(tokens) - both
            close.append(100 * both >= percent * union)
            d.append(1 - both / union)
        close, d = np.array(close).T, np.array(d).T
        home = d.argmin(1)
        bits = 1 << np.arange(len(held), dtype=np.int64)
        window = d <= d.min(1)[:, None] + 2 * radius + 1e-9
        ids = np.array([p["rep"] for p in held])
        return out.assign(settled=np.isin(rows["rep"], ids), home=home, windows=(window * bits).sum(1), balls=(close * bits).sum(1), linked=[ids[c].tolist() for c in close])

    measured = materialize(salted.groupBy("region", "salt").cogroup(copies.groupBy("region", "salt")).applyInPandas(run, MEMBERS + ", settled boolean, home int, windows long, balls long, linked array<bigint>"), "measured")
    links = measured.select(F.col("rep").alias("a"), F.explode("linked").alias("b")).where("a != b")

    def merge(key: tuple, masks: pd.DataFrame) -> pd.DataFrame:
        """The pivots of the component that holds most members: balls that share a member, or known members, are one."""
        groups: list[list[int]] = []
        for mask, known, n in zip(masks["balls"], masks["known"], masks["n"], strict=True):
            mask = int(mask) | (1 << 62 if known else 0)
            joined = [g for g in groups if g[0] & mask]
            groups = [g for g in groups if not g[0] & mask]
            for g in joined:
                mask |= g[0]
                n += g[1]
            groups.append([mask, int(n)])
        return pd.DataFrame({"region": [key[0]], "main": [max(groups, key=lambda g: (bool(g[0] >> 62), g[1]))[0]]})

    # a row for each set of balls that some member is in, at most
    masks = measured.where("balls != 0 OR known").groupBy("region", "balls", "known").agg(F.count("*").alias("n"))
    main = masks.groupBy("region").applyInPandas(merge, "region string, main long")
    told = measured.where("NOT settled").join(main, "region", "left").withColumn("known", F.col("known") | (F.coalesce(F.col("balls").bitwiseAND(F.col("main")), F.lit(0)) != 0))
    cells = F.when(F.col("known"), F.array(F.col("home"))).otherwise(F.array_union(F.array("home"), F.filter(F.sequence(F.lit(0), F.lit(61)), lambda i: F.getbit("windows", i) == 1)))
    spread = materialize(told.select("region", "rep", "n", "known", "tokens", F.explode(cells).alias("cell")).select(F.concat_ws(".", "region", "cell").alias("region"), "rep", "n", "known", "tokens"), "cells")
    open_ = spread.groupBy("region").agg(F.count_if(~F.col("known")).alias("unknown"), F.count("*").alias("all")).where("unknown > 0 AND all > 1").select("region")
    return links, materialize(spread.join(open_, "region", "left_semi"), "open-cells")


def region_links(members: DataFrame, percent: int, leaf: int = LEAF_BYTES) -> DataFrame:
    """Links that span the components of all regions' exact joins. Regions over ``leaf`` bytes are split, round by round, until none is left."""
    members = parted_again(members, percent, leaf)
    found, round_ = [], 0
    while True:
        sizes = region_sizes(members, leaf)
        found.append(join_leaves(members.join(sizes.select("region"), "region", "left_anti"), percent))
        if sizes.isEmpty():
            break
        links, members = voronoi(members.join(sizes.select("region"), "region", "left_semi"), sizes, percent, leaf, round_)
        found.append(links)
        round_ += 1
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return materialize(out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")


# --- components ---------------------------------------------------------------------------------


def components(links: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) of every id in a link; minimum labels with pointer jumping, until nothing changes."""
    edges = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    table_ = labels = materialize(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("component")), "labels")
    while True:
        near = edges.join(labels, edges.b == labels.id).groupBy("a").agg(F.min("component").alias("near"))
        best = labels.join(near, labels.id == near.a).select("id", "component", F.least("component", "near").alias("best"))
        up = labels.select(F.col("id").alias("best"), F.col("component").alias("above"))
        moved = materialize(best.join(up, "best", "left").select("id", "component", F.least("best", F.coalesce("above", "best")).alias("next")), "labels")
        discard(table_)
        table_, labels = moved, moved.select("id", F.col("next").alias("component"))
        if moved.where("next != component").isEmpty():
            discard(edges)
            return labels


def ngram_jaccard_join(docs: DataFrame, width: int = 5, percent: int = 80, leaf: int = LEAF_BYTES) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: the smallest id that links lead to, where 100 * intersection >= percent * union.

    Equal sets link at once. Texts without words, nulls among them, link with
    nothing, nor do rows without an id, whose component is null. Rows that
    repeat with one id are one document for links. An empty table gives no rows;
    columns other than doc_id and text are not read.
    """
    sets = materialize(set_table(docs, width), "sets")
    groups = materialize(sets.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("key", "short").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n")), "groups")
    total = groups.agg(F.sum("n")).first()[0] or 0
    clusters = regions(docs, groups, total, width, percent, common_shingles(sets))
    wanted = clusters.join(groups, clusters.id == groups.rep).select(F.col("rep").alias("doc_id"), "key", "n", F.col("component").cast("string").alias("region"))

    def tokens(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for rep, key, n, region, s in zip(*(batch.column(i).to_pylist() for i in range(4)), sets_of(batch.column(4), width), strict=True):
            if set_key(s) == key:
                rows.append((region, rep, n, False, s.tobytes()))
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["region", "rep", "n", "known", "tokens"])

    texts = wanted.hint("merge").join(docs.select("doc_id", "text"), "doc_id").select("doc_id", "key", "n", "region", "text")
    members = materialize(arrow_map(texts, tokens, MEMBERS).dropDuplicates(["region", "rep"]), "members")
    links = region_links(members, percent, leaf)
    classes = components(links)
    discard(members, links)
    by_key = groups.join(classes, groups.rep == classes.id, "left").select("key", F.coalesce("component", "rep").alias("component"))
    joined = sets.hint("merge").join(by_key, "key", "left")
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    return joined.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's join of ``documents``: sets of four words, 85 % and more."""
    return ngram_jaccard_join(table(spark, sf_dir, "documents"), width=4, percent=85)


#: Self-join by shingles, then reachability by the smallest id of a component. Shingles are joined by a sign that no word holds.
OP1_SQL = r"""
WITH RECURSIVE base AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingle AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                 ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s FROM base),
sized AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n, s FROM shingle),
flat AS (SELECT doc_id, n, unnest(s) AS t FROM sized),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.t = b.t AND a.doc_id != b.doc_id AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS id, doc_id AS least FROM documents UNION SELECT pairs.b, reach.least FROM reach JOIN pairs ON pairs.a = reach.id AND reach.least < pairs.b)
SELECT doc_id, n AS n_shingles, coalesce((SELECT min(least) FROM reach WHERE id = doc_id), doc_id) AS component_id FROM sized
"""
