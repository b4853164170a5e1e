"""Quality rules: base counts, and line labelling by a linear-chain conditional random field.

Each line of a document is content or boilerplate. Viterbi decoding gives the
best sequence of labels, and a document stays if the words of its content lines
make up enough of all its words. The field is trained here on a bounded sample of
labelled documents. Labels are of documents, so the labels of lines are partly
hidden: lines of a plain sign (notices, links, menus, symbols, shouting, repeats)
are boilerplate anywhere, the other lines of a good document are content, and
those of a bad document are left open, with odds against content. The likelihood
is of what is told: forward-backward over the labellings that agree with it, less
forward-backward over all.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, arrow_map, table, word_digests

#: Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, REPEAT_PERCENT = 50, 50
#: Share of words in content lines from which a document stays.
CONTENT_SHARE = 0.5
#: At most so many labelled documents train the field: those with the smallest hash of their id.
SAMPLE = 1500
FEATURES = 14
#: Log-odds against content for the open lines of bad documents.
ODDS = 1.0
#: Fixed words of notices and links.
NOTICE = re.compile(rb"licen[sc]e|all rights reserved|copyright|https?://|www\.|cookie|terms of (?:use|service)|privacy policy")
BASE = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_words long, kept boolean"


def n_repeat_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words found twice or more in the text, the first included."""
    if len(words) < 4:
        return 0
    w = np.frombuffer(b"".join(map(word_digests().__getitem__, words)), "<u8")
    h = (w[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ ((w[1:-1] << np.uint64(21) | w[1:-1] >> np.uint64(43)) * np.uint64(0xC2B2AE3D27D4EB4F)) ^ ((w[2:] << np.uint64(42) | w[2:] >> np.uint64(22)) * np.uint64(0x165667B19E3779F9))
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    covered = np.zeros(len(w), bool)
    for k in range(3):
        covered[k : len(h) + k] |= twice
    return int(covered.sum())


def line_features(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
    """For each line that has a word: its features and its words; and how many such lines repeat an earlier one."""
    seen: set[bytes] = set()
    rows, counts, dups = [], [], 0
    for line in lines:
        words = line.split()
        n = len(words)
        if not n:
            continue
        dup = line in seen
        dups += dup
        seen.add(line)
        symbols = len(line) - len(line.translate(None, SYMBOLS))
        caps = len(line) - len(line.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ!"))
        digits = len(line) - len(line.translate(None, b"0123456789"))
        pipes = line.count(b"|")
        monotone = n >= 6 and 2 * len(set(words)) <= n
        notice = n <= 40 and NOTICE.search(line.lower()) is not None
        rows.append((1.0, dup, n <= 2, n <= 5, n >= 15, symbols > 0.2 * n, symbols > 0.6 * n, pipes > 0.3 * n, caps > 0.5 * len(line), digits > 0.3 * len(line), line.rstrip()[-1:] in b".!?", min(math.log1p(n), 6) / 6, monotone, notice))
        counts.append(n)
    return np.array(rows, np.float32).reshape(-1, FEATURES), np.array(counts, np.int64), dups


def told(features: np.ndarray, good: int) -> np.ndarray:
    """What a labelled document tells of its lines: log-weights (boilerplate, content) that are added to their scores.

    A line that repeats an earlier one, is full of symbols or pipes, shouts, says
    one thing over and over or is a notice is boilerplate; other lines of a good
    document are content, and of a bad one open.
    """
    plain = features[:, [1, 6, 7, 8, 12, 13]].any(1)
    out = np.zeros((len(features), 2))
    out[plain, 1] = SHUT
    if good:
        out[~plain, 0] = SHUT
    else:
        out[~plain, 1] = -ODDS
    return out


#: The log-weight of a label that is ruled out.
SHUT = -40.0


class Field:
    """State scores are features x weights (labels: 0 boilerplate, 1 content); ``moves`` scores neighbouring labels."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves

    def viterbi(self, features: np.ndarray) -> np.ndarray:
        """The best label of each line; of equal scores, content."""
        if not len(features):
            return np.zeros(0, np.int64)
        (m00, m01), (m10, m11) = self.moves.tolist()
        back = []
        scores = (features @ self.weights).tolist()
        a, b = scores[0]
        for s0, s1 in scores[1:]:
            from0, from1 = int(b + m10 >= a + m00), int(b + m11 >= a + m01)
            back.append((from0, from1))
            a, b = s0 + (b + m10 if from0 else a + m00), s1 + (b + m11 if from1 else a + m01)
        out = [int(b >= a)]
        for choice in reversed(back):
            out.append(choice[out[-1]])
        return np.array(out[::-1])

    @classmethod
    def train(cls, documents: list[tuple[np.ndarray, int]], rounds: int = 200, rate: float = 2.0, decay: float = 3e-4) -> Field:
        """Gradient ascent with momentum on the mean log-likelihood of what (features, label of the document) tell, over blocks of documents of similar length."""
        field = cls(np.zeros((FEATURES, 2)), np.zeros((2, 2)))
        documents = sorted((d for d in documents if len(d[0])), key=lambda d: -len(d[0]))
        if not documents:
            field.weights[0] = (-1.0, 1.0)
            return field
        lengths = np.array([len(x) for x, _ in documents])
        labels = np.array([y for _, y in documents])
        share = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels != 1).sum())) / lengths
        blocks, begin = [], 0
        while begin < len(documents):
            # lengths within a factor of two, so that padding at most doubles the lines
            end = begin + int((2 * lengths[begin:] >= lengths[begin]).sum())
            x, c = np.zeros((int(lengths[begin]), end - begin, FEATURES), np.float32), np.zeros((int(lengths[begin]), end - begin, 2))
            for k, (f, y) in enumerate(documents[begin:end]):
                x[: len(f), k], c[: len(f), k] = f, told(f, y == 1)
            blocks.append((x, lengths[begin:end], c, share[begin:end]))
            begin = end
        speed = [np.zeros_like(field.weights), np.zeros_like(field.moves)]
        for _ in range(rounds):
            parts = [field.gradient(*block) for block in blocks]
            gw, gm = sum(g for g, _ in parts) - decay * field.weights, sum(g for _, g in parts) - decay * field.moves
            speed = [0.8 * speed[0] + rate * gw, 0.8 * speed[1] + rate * gm]
            field.weights, field.moves = field.weights + speed[0], field.moves + speed[1]
        return field

    def gradient(self, x: np.ndarray, lengths: np.ndarray, known: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What a block of padded documents, longest first, adds to the gradients of weights and moves: expected counts as told, less those of the field alone."""
        s = x @ self.weights
        gw, gm = np.zeros_like(self.weights), np.zeros_like(self.moves)
        for scores, sign in ((s + known, 1.0), (s, -1.0)):
            single, pairs = self.expected(scores, lengths)
            gw = gw + sign * np.einsum("tdf,tdy->fy", x, single * share[:, None], optimize=True)
            gm = gm + sign * np.einsum("tdyz,d->yz", pairs, share)
        return gw, gm

    def expected(self, s: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The probability of each label of each line, and of each pair of neighbouring labels, by forward-backward; 0 beyond a document's end."""
        total = len(s)
        alive = [int((lengths > t).sum()) for t in range(total)]
        alpha, beta = np.zeros_like(s), np.zeros_like(s)
        alpha[0] = s[0]
        for t in range(1, total):
            n = alive[t]
            alpha[t, :n] = s[t, :n] + np.logaddexp(alpha[t - 1, :n, :1] + self.moves[0], alpha[t - 1, :n, 1:] + self.moves[1])
        for t in range(total - 2, -1, -1):
            n = alive[t + 1]
            nxt = s[t + 1, :n] + beta[t + 1, :n]
            beta[t, :n] = np.stack([np.logaddexp(nxt[:, 0] + self.moves[i, 0], nxt[:, 1] + self.moves[i, 1]) for i in (0, 1)], 1)
        log_z = np.logaddexp(*(alpha[0] + beta[0]).T)
        single, pairs = np.zeros_like(s), np.zeros((total, s.shape[1], 2, 2))
        for t in range(total):
            n = alive[t]
            single[t, :n] = np.exp(alpha[t, :n] + beta[t, :n] - log_z[:n, None])
            if t + 1 < total and (m := alive[t + 1]):
                pairs[t, :m] = np.exp(alpha[t, :m, :, None] + self.moves + (s[t + 1, :m] + beta[t + 1, :m])[:, None, :] - log_z[:m, None, None])
        return single, pairs


def judge(text: str | None, field: Field) -> tuple[int, int, int, int, int, bool, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_words, kept of a whole text; null counts as empty."""
    text = text or ""
    body = text.encode()
    words = body.split()
    features, counts, dups = line_features(body.split(b"\n"))
    repeats = n_repeat_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeats > REPEAT_PERCENT * len(words)
    content = int(counts[field.viterbi(features) == 1].sum()) if len(counts) else 0
    chars = len(text) - (len(body) - len(body.translate(None, BLANKS)))
    return len(words), chars, len(body) - len(body.translate(None, SYMBOLS)), dups, repeats, failed, content, not failed and content >= CONTENT_SHARE * len(words)


def train_field(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field:
    """Fit on the ``sample`` labelled documents with the smallest hash of their id, on all their lines; without labels every line is content.

    Lines become features where the documents are; the driver gets figures only.
    """
    marked = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    if marked.isEmpty():
        return Field.train([])
    rows = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id").select("doc_id", "quality", "text")  # at most ``sample`` rows

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        figures = [line_features((t or "").encode().split(b"\n"))[0].tobytes() for t in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.int64()), pa.array(figures, pa.binary())], ["doc_id", "quality", "figures"])

    found = sorted((r["doc_id"], r["quality"], bytes(r["figures"])) for r in arrow_map(rows, run, "doc_id long, quality long, figures binary").collect())
    return Field.train([(np.frombuffer(f, np.float32).reshape(-1, FEATURES), int(quality)) for _, quality, f in found])


def score(docs: DataFrame, field: Field) -> DataFrame:
    """The counts and the verdict of every row; rows that repeat are judged alike. A null text counts as empty, a null id stays null; an empty table gives no rows."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, chars, symbols, dups, repeats, failed, content, kept = zip(*(judge(t, field) for t in batch.column(1).to_pylist()), strict=True)
        long = lambda x: pa.array(x, pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), long(n), long(chars), long(symbols), long(dups), long(repeats), pa.array(failed), long(content), pa.array(kept)], re.findall(r"(\w+) (?:long|boolean)", BASE))

    return arrow_map(docs.select("doc_id", "text"), run, BASE)


def keep_good(docs: DataFrame, field: Field) -> DataFrame:
    """The rows of ``docs`` whose text is kept, all columns as they are."""
    at = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([judge(t, field)[-1] for t in batch.column(at).to_pylist()], pa.bool_()))

    return arrow_map(docs, run, docs.schema)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of all ``documents``, by a field trained on the sample of ``labels``."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, train_field(docs, table(spark, sf_dir, "labels")))


def base_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op10 that need no field."""
    return op10_quality_rules(spark, sf_dir).drop("content_words", "kept")


BASE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM g),
c AS (SELECT doc_id, count(DISTINCT k) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM h WHERE n > 1) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
       CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
       coalesce(n_repeat_words, 0) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * len(w) AS base_failed
FROM w JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)
"""
