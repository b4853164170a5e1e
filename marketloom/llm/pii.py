"""Personal data: base patterns, and a semi-Markov conditional random field for what they miss.

The field scores whole spans: a candidate segment has one kind, and its features
are of the whole segment (its digit groups, separators, check digits, what stands
beside it); neighbouring segments score by their kinds. Dynamic programming over a
stretch of text chooses boundaries and kinds of all segments jointly; a segment
has a bounded number of tokens, so a stretch of n tokens takes O(n) steps. The
weights maximise the likelihood of lines made from a fixed seed: the same dynamic
programme, with sums for maxima, gives the partition function and the expected
counts. Spans of the base patterns always stay; the field adds those of its
segments that touch none of them.
"""

from __future__ import annotations

import hashlib
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_map, table

#: Fixed values of the contract: the kinds in order, and their patterns.
KINDS = ("email", "ip", "card", "phone")
EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT, LETTER, SIGN, OTHER = re.compile(r"[^0-9]+"), re.compile(r"[A-Za-z]"), re.compile(r"[0-9A-Za-z]+"), re.compile(r"[^0-9A-Fa-f:]")
#: Tokens in a segment, at most.
LONGEST = 24
COLUMNS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The base matches by kind, then start: leftmost and non-overlapping within a kind, failing ones dropped. Linear in the text."""
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in EMAIL_LOCAL:
            start -= 1
        if start < at and (m := EMAIL_DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            done = m.end()
        else:
            done = at + 1  # no match has this sign in it, and none spans it
        at = text.find("@", max(done, at + 1))
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = DIGIT.sub("", m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(DIGIT.sub("", m.group())) <= 15]
    return out


# --- the field -----------------------------------------------------------------------------------

TOKEN = re.compile(r"[A-Za-z0-9]+|[^\sA-Za-z0-9]|\s+")
#: Where a segment may stand: digits with what joins them, as far as they go, or words about an address sign, spelt out or not, up to the end of a word.
NUMBERS = re.compile(r"[+(]?[0-9][0-9A-Fa-f() .:+-]{6,}")
ADDRESS = re.compile(r"[A-Za-z0-9._%+-]{1,64}\s{0,2}(?:@|\(at\)|\[at\]|\{at\})(?=([^\n]{3,80}[A-Za-z0-9.-]*))")
HINTS = {"phone": "phone", "tel": "phone", "call": "phone", "mobile": "phone", "fax": "phone", "card": "card", "visa": "card", "amex": "card", "credit": "card", "email": "email", "mail": "email", "contact": "email", "ip": "ip", "host": "ip", "server": "ip"}


def features(text: str, start: int, end: int) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """(kinds it can be, features) of the whole segment."""
    s = text[start:end]
    if not (s[0].isalnum() or s[0] in "+(:") or not s[-1].isalnum():
        return (), ()
    digits = DIGIT.sub("", s)
    signs = "at" if re.search(r"@|\(at\)|\[at\]|\{at\}", s) else ""
    plain = not signs and not LETTER.search(s)
    kinds = ("email",) if signs else ("ip",) if s.count(":") == 7 and not OTHER.search(s) else ()
    if plain:
        kinds += ("ip",) * (s.count(".") == 3) + ("card",) * (13 <= len(digits) <= 19) + ("phone",) * (7 <= len(digits) <= 15)
    if not kinds:
        return (), ()
    shape = re.sub(r"[0-9]+", lambda m: f"9{len(m.group())}", s)
    shape = re.sub(r"[A-Za-z]+", "a", shape)[:40]
    left, right = text[start - 1 : start], text[end : end + 1]
    hint = next((HINTS[w] for w in reversed(re.findall(r"[a-z]+", text[max(0, start - 24) : start].lower())) if w in HINTS), "none")
    return kinds, (
        "bias", f"signs={''.join(sorted(set(SIGN.sub('', s))))[:12]}", f"digits={len(digits)}", f"shape={shape}" if not signs else f"at={re.sub(r'[A-Za-z0-9-]+', 'w', s)[:24]}", f"luhn={luhn(digits)}/{len(digits)}" if len(digits) >= 13 else "luhn=-",
        f"left={'edge' if not left or left.isspace() or left in '(,;:' else left if not left.isalnum() else 'a'}", f"right={'edge' if not right or right.isspace() or right in ').,;:!?' else 'a'}",
        f"hint={hint}", f"letters={any(c.isalpha() for c in s) and not signs}", f"blank={bool(re.search(r'[ ]{2}|[^ ] [^ ]+ [^ ]+ [^ ]', s))}",
    )


#: What a segment is: a token outside all entities, or a kind.
LABELS = ("out", *KINDS)


class SemiMarkov:
    """``weights`` by (kind, feature) of a segment; ``moves`` by the numbers of neighbouring labels. A token outside scores 0 but for its moves."""

    def __init__(self, weights: dict[tuple[str, str], float], moves: list[list[float]] | None = None):
        self.weights, self.features = weights, features
        self.moves = moves or [[0.0] * len(LABELS) for _ in LABELS]

    def decode(self, text: str) -> list[Span]:
        """The best segmentation of a stretch, by the highest score that ends at each token with each label. Of equal scores, the one found first, with fewer segments."""
        ends = [0, *(m.end() for m in TOKEN.finditer(text))]
        low = float("-inf")
        columns = list(zip(*self.moves, strict=True))
        best = [[0.0, *[low] * len(KINDS)]]
        back: list[list[tuple[int, int]]] = [[(0, 0)] * len(LABELS)]
        into: list[list[tuple[float, int]]] = []  # the best way to enter a label after each token
        for j in range(1, len(ends)):
            into.append([max(((s + m, -k) for k, (s, m) in enumerate(zip(best[j - 1], column, strict=True))), default=(low, 0)) for column in columns])
            row, way = [into[j - 1][0][0], *[low] * len(KINDS)], [(j - 1, -into[j - 1][0][1])] * len(LABELS)
            for i in range(max(0, j - LONGEST), j):
                for kind, score in self.scores(text, ends[i], ends[j]):
                    y = LABELS.index(kind)
                    if into[i][y][0] + score > row[y] + 1e-9:
                        row[y], way[y] = into[i][y][0] + score, (i, -into[i][y][1])
            best.append(row)
            back.append(way)
        out, j = [], len(ends) - 1
        y = max(range(len(LABELS)), key=lambda y: (best[j][y], -y))
        while j:
            i, before = back[j][y]
            if y:
                out.append((LABELS[y], ends[i], ends[j]))
            j, y = i, before
        return out[::-1]

    def scores(self, text: str, start: int, end: int) -> list[tuple[str, float]]:
        kinds, found = self.features(text, start, end)
        return [(kind, sum(self.weights.get((kind, f), 0.0) for f in found)) for kind in kinds]

    @classmethod
    def train(cls, lines: list[tuple[str, list[Span]]], rounds: int = 14, batch: int = 25, rate: float = 0.5, decay: float = 1e-3) -> SemiMarkov:
        """Gradient ascent on the log-likelihood of the true segmentations, with a step for each weight that shrinks as its gradients add up."""
        names: dict[tuple[str, str], int] = {}
        charts = [Chart(text, truth, names) for text, truth in lines]
        w, moves = np.zeros(len(names)), np.zeros((len(LABELS), len(LABELS)))
        sums_w, sums_m = np.full(len(names), 1e-2), np.full(moves.shape, 1e-2)
        for _ in range(rounds):
            for at in range(0, len(charts), batch):
                gw, gm = -decay * w, -decay * moves
                for chart in charts[at : at + batch]:
                    chart.add_gradient(w, moves, gw, gm)
                sums_w += gw * gw
                sums_m += gm * gm
                w = w + rate * gw / np.sqrt(sums_w)
                moves = moves + rate * gm / np.sqrt(sums_m)
        return cls({name: float(w[k]) for name, k in names.items()}, moves.tolist())


class Chart:
    """The candidate segments of a line, with the numbers of their features, and which of them are true."""

    def __init__(self, text: str, truth: list[Span], names: dict[tuple[str, str], int]):
        ends = [0, *(m.end() for m in TOKEN.finditer(text))]
        self.tokens, true = len(ends) - 1, {(a, b, kind) for kind, a, b in truth}
        self.at: list[list[tuple[int, int, int]]] = [[] for _ in ends]  # by first token: (end, label, number)
        numbers, mine, sure = [], [], []
        for i in range(self.tokens):
            for j in range(i + 1, min(self.tokens, i + LONGEST) + 1):
                kinds, found = features(text, ends[i], ends[j])
                for kind in kinds:
                    self.at[i].append((j, LABELS.index(kind), len(sure)))
                    numbers += [names.setdefault((kind, f), len(names)) for f in found]
                    mine += [len(sure)] * len(found)
                    sure.append((ends[i], ends[j], kind) in true)
        self.numbers, self.mine, self.sure = np.array(numbers, np.int64), np.array(mine, np.int64), np.array(sure, float)
        # the true labels in order, to count moves
        label, self.path, i = {(i, j): y for i in range(self.tokens) for j, y, k in self.at[i] if sure[k]}, [0], 0
        while i < self.tokens:
            j, y = next(((j, y) for (a, j), y in label.items() if a == i), (i + 1, 0))
            self.path.append(y)
            i = j

    def posteriors(self, w: np.ndarray, moves: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """(partition function, probability of each candidate, expected moves), by sums over all segmentations."""
        n, e = self.tokens, np.exp(np.bincount(self.mine, w[self.numbers], len(self.sure))).tolist() if len(self.sure) else []
        m = np.exp(moves)
        alpha, entered, beta, going = np.zeros((n + 1, len(LABELS))), np.zeros((n + 1, len(LABELS))), np.zeros((n + 1, len(LABELS))), np.zeros((n + 1, len(LABELS)))
        alpha[0, 0] = 1.0
        for i in range(n):
            entered[i] = v = alpha[i] @ m
            alpha[i + 1, 0] += v[0]
            for j, y, k in self.at[i]:
                alpha[j, y] += v[y] * e[k]
        z = alpha[n].sum()
        beta[n] = 1.0
        share = np.zeros(len(self.sure))
        for i in range(n - 1, -1, -1):
            going[i, 0] = beta[i + 1, 0]
            for j, y, k in self.at[i]:
                x = e[k] * beta[j, y]
                going[i, y] += x
                share[k] = entered[i, y] * x / z
            beta[i] = m @ going[i]
        return z, share, np.einsum("ia,ab,ib->ab", alpha, m, going) / z

    def add_gradient(self, w: np.ndarray, moves: np.ndarray, gw: np.ndarray, gm: np.ndarray) -> None:
        """Add the true counts of features and moves less the expected ones."""
        _, share, steps = self.posteriors(w, moves)
        if len(self.sure):
            np.add.at(gw, self.numbers, (self.sure - share)[self.mine])
        np.add.at(gm, (self.path[:-1], self.path[1:]), 1.0)
        gm -= steps


def training_lines(n: int = 600, seed: int = 7) -> list[tuple[str, list[Span]]]:
    """Lines with a few segments or look-alikes (dates, prices, versions, keys, numbers of orders) each, from a fixed seed."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    name = lambda: "".join(r.choice("abcdefghiklmnoprstu") for _ in range(r.randint(3, 8)))

    def card(k: int) -> str:
        body = r.choice("3456") + d(k - 2)
        return next(body + c for c in "0123456789" if luhn(body + c))

    def sour(k: int) -> str:
        x = card(k)
        return x[:-1] + str((int(x[-1]) + r.randint(1, 9)) % 10)

    def true() -> tuple[str, str]:
        kind = r.choice(KINDS)
        if kind == "phone":
            a, b, c = r.choice("23456789") + d(2), d(3), d(4)
            return kind, r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"1-{a}-{b}-{c}", f"+1 ({a}) {b}-{c}", f"+{d(2)} {d(3)} {d(4)} {d(3)}"])
        if kind == "card":
            x = card(r.choice((15, 16, 16)))
            return kind, r.choice([x, " ".join((x[:4], x[4:8], x[8:12], x[12:])) if len(x) == 16 else f"{x[:4]} {x[4:10]} {x[10:]}", "-".join((x[:4], x[4:8], x[8:12], x[12:])) if len(x) == 16 else f"{x[:4]}-{x[4:10]}-{x[10:]}"])
        if kind == "ip":
            return kind, r.choice([".".join(str(r.randint(1, 255)) for _ in range(4)), ":".join(f"{r.randint(4096, 65535):x}" for _ in range(8))])
        return kind, r.choice(["{0}@{1}.com", "{0}.{2}@{1}.org", "{0} (at) {1}.com", "{0}[at]{1}.net", "{0} @ {1}.com", "{0}.{2} [at] {1}.org"]).format(name(), name(), name())

    def false() -> str:
        return r.choice([
            f"20{d(2)}-0{r.randint(1, 9)}-1{d(1)}", f"1{d(1)}:3{d(1)}:4{d(1)}", f"20{d(2)}-0{r.randint(1, 9)}-1{d(1)} 1{d(1)}:3{d(1)}:00", d(r.choice((7, 8, 9, 10, 11, 12, 13, 17, 20))), f"{d(1)},{d(3)},{d(3)}.{d(2)}",
            sour(16), sour(16), " ".join((d(4), d(4), d(4), d(3))), f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", f"{d(1)}.{d(2)}.{d(1)}-{d(4)}", f"password={d(9)}ac0e{d(1)}f", f"AKIA{name().upper()}{d(3)}", f"{d(4)}-{d(4)}", f"{d(3)}-{d(2)}", f"{d(5)}.{d(6)}", f"{d(4)} {d(4)} {d(2)}", f"a{d(8)}b{d(4)}",
        ])

    out = []
    for _ in range(n):
        line, spans = name(), []
        for _ in range(r.randint(1, 3)):
            line += r.choice([" ", " ", ", ", ": ", " (", ". "])
            if r.random() < 0.55:
                kind, s = true()
                if r.random() < 0.3:
                    line += next(w for w in sorted(HINTS, key=lambda _: r.random()) if HINTS[w] == kind) + r.choice([" ", ": "])
                spans.append((kind, len(line), len(line) + len(s)))
                line += s
            else:
                line += false()
            line += " " + name()
        out.append((line, spans))
    return out


@lru_cache(maxsize=1)
def trained() -> SemiMarkov:
    return SemiMarkov.train(training_lines())


def stretches(text: str) -> list[tuple[int, int]]:
    """Where segments may stand, in order; what overlaps or touches is one stretch, so that no segment lies across a bound."""
    found = sorted([m.span() for m in NUMBERS.finditer(text)] + [(m.start(), m.end(1)) for m in ADDRESS.finditer(text)])
    out: list[tuple[int, int]] = []
    for start, end in found:
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def added_spans(text: str, base: list[Span], field: SemiMarkov) -> list[Span]:
    """The field's spans that touch no base span. A stretch is decoded whole, in time linear in it."""
    out: list[Span] = []
    for first, last in stretches(text):
        # with the words before it for the features
        shift = max(0, first - 24)
        for kind, a, b in field.decode(text[shift : last + 2]):
            if a + shift >= first and not any(x < b + shift and a + shift < y for _, x, y in base):
                out.append((kind, a + shift, b + shift))
    return out


def find(text: str | None, field: SemiMarkov) -> tuple[list[Span], list[Span]]:
    """(base, all) spans of a whole text; places are code points, ends exclusive. Null counts as empty."""
    text = text or ""
    if not text or not re.search(r"[0-9@]|[(\[{]at[)\]}]", text):
        return [], []
    base = base_spans(text)
    both = base + added_spans(text, base, field)
    return base, sorted(both, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def masked(text: str, spans: list[Span]) -> str:
    """Each span replaced by its kind in angle brackets; overlapping spans make one, named after the first."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def detect(docs: DataFrame, field: SemiMarkov | None = None) -> DataFrame:
    """The base counts, a digest of the base spans and all spans of every row.

    Null texts count as empty and have no spans; a null id stays null; rows that
    repeat are judged alike; an empty table gives no rows.
    """
    field = field or trained()
    weights, moves = field.weights, field.moves
    show = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        field, rows = SemiMarkov(weights, moves), []
        for text in batch.column(1).to_pylist():
            base, spans = find(text, field)
            rows.append((*(sum(s[0] == k for s in base) for k in KINDS), hashlib.sha256(show(base).encode()).hexdigest(), show(spans)))
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c) for c in zip(*rows, strict=True))], [x.split()[0] for x in COLUMNS.split(", ")])

    return arrow_map(docs.select("doc_id", "text"), run, COLUMNS)


def redact(docs: DataFrame, field: SemiMarkov | None = None) -> DataFrame:
    """``docs`` with the spans of each text masked, and ``n_chars``, where there is one, counted anew; null texts stay null."""
    field = field or trained()
    weights, moves, at = field.weights, field.moves, docs.columns.index("text")
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        field = SemiMarkov(weights, moves)
        texts = [t and masked(t, find(t, field)[1]) for t in batch.column(at).to_pylist()]
        columns = list(batch.columns)
        columns[at] = pa.array(texts, batch.schema.field(at).type)
        if chars is not None:
            columns[chars] = pa.array([None if t is None else len(t) for t in texts], batch.schema.field(chars).type)
        return pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return arrow_map(docs, run, docs.schema)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans and the field's spans of all ``documents``."""
    return detect(table(spark, sf_dir, "documents"))


def base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op4 that need no field and no places."""
    return op4_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


BASE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS email, regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS ip,
             list_transform(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS card,
             list_transform(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS phone FROM d),
f AS (SELECT doc_id, email, list_filter(ip, lambda x: len(list_filter(string_split(x, '.'), lambda p: length(ltrim(p, '0')) > 3 OR CAST(right(p, 4) AS INT) > 255)) = 0) AS ip,
             list_filter(card, lambda x: length(x) BETWEEN 16 AND 19) AS card, list_filter(phone, lambda x: length(x) BETWEEN 8 AND 15) AS phone FROM m),
c AS (SELECT *, list_filter(card, lambda x: list_sum(list_transform(range(1, length(x) + 1), lambda i: CASE WHEN (length(x) - i) % 2 = 0 THEN CAST(x[i] AS INT)
             WHEN CAST(x[i] AS INT) > 4 THEN 2 * CAST(x[i] AS INT) - 9 ELSE 2 * CAST(x[i] AS INT) END)) % 10 = 0) AS valid FROM f)
SELECT doc_id, CAST(len(email) AS BIGINT) AS n_email, CAST(len(ip) AS BIGINT) AS n_ip, CAST(len(valid) AS BIGINT) AS n_card, CAST(len(phone) AS BIGINT) AS n_phone FROM c
"""
