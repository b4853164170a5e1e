"""Toxicity by compression distance to two zstandard dictionaries.

The library's trainer makes one dictionary of windows of ordinary texts and one of
windows of toxic texts, drawn among those that hold what toxic texts say more
often. The toxic dictionary stands beside the ordinary one, so that what both
explain costs the same. A window, a few neighbouring words, is compressed with
either; the difference of the lengths says how much closer it is to the toxic
text. A document's windows are summed up by counts above several thresholds, which
a logistic curve, calibrated on the labels, turns into a score of 0 to 1.

Training looks at a bounded sample of labelled documents that aren't held out. All
its texts are cut and compressed where they are; the driver gets a bounded number
of distinct windows for the dictionaries, and figures for the curve. The dictionaries
see ordinary windows of one half of it only, so that the curve meets others too.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BoundedCache, arrow_map, table

#: zstandard doesn't search the last bytes of a block; the carrier, which the dictionaries hold, stands there.
CARRIER = bytes(range(0x80, 0xB0))
STRIP = b".,;:!?#*$%&|<>\"'()[]{}"
#: Words of a window; bytes of the n-grams by which toxic windows are drawn.
WINDOW, GRAM = 2, 6
#: Labelled documents that train, at most: those with the smallest hash of their id. Distinct windows of them that the dictionaries see, by class.
SAMPLE, TOXIC_WINDOWS, ORDINARY_WINDOWS = 4000, 60_000, 100_000
#: Bytes of the ordinary dictionary and of what the toxic one has beside it, and of the trainer's segments; toxic windows that are drawn.
ORDINARY_BYTES, TOXIC_BYTES, SEGMENT, CORE, DRAWN = 65_536, 6_144, 32, 8, 8_000
#: Differences of lengths, in bytes, from which windows are counted.
THRESHOLDS = (2, 3, 4, 5, 6, 7, 9)
#: Parts of the sample, and those whose ordinary documents the dictionaries see.
FOLDS, DICTIONARY_PARTS = 2, {0}
#: How much an n-gram must speak for toxic text.
LEAST = 20.0
LEVEL = 9
FIGURES = 2 * len(THRESHOLDS) + 4
SCORES = "doc_id long, held_out boolean, score double, predicted int"


class Model(NamedTuple):
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]


def windows(text: str | None) -> list[bytes]:
    """The windows of a whole text, one after the other: words lower-cased, without marks at their ends. Null has none."""
    words = [w for x in (text or "").lower().encode().split() if (w := x.strip(STRIP))]
    return [b" " + b" ".join(words[i : i + WINDOW]) + b" " for i in range(0, len(words), WINDOW)]


class Distance:
    """The difference of a window's lengths, ordinary less toxic."""

    def __init__(self, model: Model):
        import zstandard as z

        def compressor(body: bytes):
            p = z.ZstdCompressionParameters.from_level(LEVEL, format=z.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)
            return z.ZstdCompressor(dict_data=z.ZstdCompressionDict(body + CARRIER, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=p)

        ordinary, toxic = compressor(model.ordinary).compress, compressor(model.ordinary + model.toxic).compress
        self.of = BoundedCache(lambda window: len(ordinary(window + CARRIER)) - len(toxic(window + CARRIER)), 200_000)

    def figures(self, text: str | None) -> list[float]:
        """The largest difference and the sum of the three largest, the count and the share of windows from each threshold on, how many windows there are, and one for the bias."""
        d = np.fromiter(map(self.of.__getitem__, windows(text)), float)
        if not len(d):
            return [0.0] * (FIGURES - 1) + [1.0]
        top = np.sort(d)[::-1]
        above = len(d) - np.searchsorted(top[::-1], THRESHOLDS)
        return [max(0.0, top[0]) / 10, max(0.0, top[:3].sum()) / 30, *(np.log1p(above) / 2).tolist(), *(4 * above / (len(d) + 8)).tolist(), math.log1p(len(d)) / 5, 1.0]

    def score(self, text: str | None, weights: tuple[float, ...]) -> float:
        s = sum(a * b for a, b in zip(self.figures(text), weights, strict=True))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, s))))


_DISTANCES: dict[int, Distance] = {}


def distance_of(model: Model) -> Distance:
    key = zlib.crc32(repr(model[:2]).encode())
    if key not in _DISTANCES:
        _DISTANCES.clear()
        _DISTANCES[key] = Distance(model)
    return _DISTANCES[key]


def telling(toxic: list[bytes], ordinary: list[bytes], most: int) -> list[bytes]:
    """The toxic windows with the n-grams that speak most for toxic text: by count times the log of how much more frequent they are there."""

    def grams(held: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        body, owner = np.frombuffer(b"".join(held) + bytes(GRAM), np.uint8), np.repeat(np.arange(len(held)), [len(w) for w in held])
        h = np.zeros(len(owner), np.uint64)
        for i in range(GRAM):
            h = h * np.uint64(0x9E3779B97F4A7C15) ^ body[i : i + len(owner)]
        return h, owner

    mine, owner = grams(toxic)
    theirs, _ = grams(ordinary)
    known, index, n = np.unique(mine, return_inverse=True, return_counts=True)
    other, m = np.unique(theirs, return_counts=True)
    at = np.minimum(np.searchsorted(other, known), len(other) - 1)
    also = np.where(other[at] == known, m[at], 0)
    speaks = np.where(n >= 5, n * (np.log(n / len(mine)) - np.log((also + 1) / len(theirs))), 0.0)
    best = np.zeros(len(toxic))
    np.maximum.at(best, owner, speaks[index])
    return [toxic[i] for i in np.argsort(-best, kind="stable")[:most] if best[i] >= LEAST]


def trained_content(held: list[bytes], size: int, **more: int) -> bytes:
    """The content of a dictionary that the library trains on the windows; of too few of them, the windows themselves."""
    import zstandard as z

    try:
        return z.train_dictionary(size + 300, held, **more).as_bytes()[-size:]
    except z.ZstdError:
        return b"".join(held)[-size:]


def dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> Model:
    """Both dictionaries of distinct windows in a fixed order; with a class missing, nothing tells them apart."""
    base = trained_content(ordinary, ORDINARY_BYTES) if ordinary else b""
    if not toxic or not ordinary:
        return Model(base, b"", ())
    return Model(base, trained_content(telling(toxic, ordinary, DRAWN), TOXIC_BYTES, k=SEGMENT, d=CORE), ())


def curve(figures: np.ndarray, labels: np.ndarray, rounds: int = 25, decay: float = 0.3) -> tuple[float, ...]:
    """Logistic regression by Newton steps. Without labels of both classes every score is low."""
    if not 0 < labels.sum() < len(labels):
        return (0.0,) * (FIGURES - 1) + (-4.0,)
    beta = np.zeros(FIGURES)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(figures @ beta, -30, 30)))
        hessian = (figures * (p * (1 - p))[:, None]).T @ figures + decay * np.eye(FIGURES)
        beta += np.linalg.solve(hessian, figures.T @ (labels - p) - decay * beta)
    return tuple(beta.tolist())


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on labelled documents that aren't held out, at most ``sample`` of them; labels that are null don't count."""
    marked = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out()).select("doc_id", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample)
    fold = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(FOLDS)).cast("int")
    rows = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id").select("doc_id", (F.col("toxic") == 1).alias("toxic"), fold.alias("fold"), "text")  # at most ``sample`` rows

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for toxic, fold, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held = windows(text)
            if held:
                yield pa.RecordBatch.from_arrays([pa.array([toxic] * len(held)), pa.array([fold] * len(held), pa.int32()), pa.array(held, pa.binary())], ["toxic", "fold", "window"])

    found = arrow_map(rows.select("toxic", "fold", "text"), cut, "toxic boolean, fold int, window binary").groupBy("toxic", "window").agg(F.min("fold").alias("fold"))
    drawn = {toxic: [(r["fold"], bytes(r["window"])) for r in found.where(F.col("toxic") == toxic).orderBy(F.xxhash64("window"), "window").limit(most).collect()] for toxic, most in ((True, TOXIC_WINDOWS), (False, ORDINARY_WINDOWS))}
    of = lambda folds: dictionaries(*([w for k, w in drawn[toxic] if toxic or k in folds] for toxic in (True, False)))
    model = of(DICTIONARY_PARTS)

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        d = distance_of(model)
        figures = [d.figures(t) for t in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(figures, pa.list_(pa.float64()))], ["doc_id", "toxic", "figures"])

    measured = arrow_map(rows.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic", "text"), measure, "doc_id long, toxic boolean, figures array<double>")
    held = sorted((r["doc_id"], r["toxic"], r["figures"]) for r in measured.collect())
    return model._replace(weights=curve(np.array([f for _, _, f in held]).reshape(-1, FIGURES), np.array([float(y) for _, y, _ in held])))


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row and its whole text; only the text is an input of the score.

    A null text scores as an empty one; a null id stays null and isn't held out;
    rows that repeat score alike; an empty table gives no rows.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        d = distance_of(model)
        s = [d.score(t, model.weights) for t in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(s, pa.float64()), pa.array([int(v >= threshold) for v in s], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return arrow_map(docs.select("doc_id", held_out().alias("held_out"), "text"), run, SCORES)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents``, by a model of the labels that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
