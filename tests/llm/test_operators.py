"""The corpus operators against brute force, libraries and round trips, with nulls, empty texts, ties and clashing columns."""

import base64
import hashlib
import itertools
import random
import re

import numpy as np
import public_tokenizers as tokenizers
import pytest
import tiktoken
import tokenizers as tokenizer_library
from pyspark.sql import functions as F

from marketloom.llm import byte_bpe, chat, exact_dedup, jaccard, packing, pii, quality, substring_dedup, toxicity, warc

DOCS = "doc_id long, text string, rank long, n long, key string, bucket string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "k", None) for i, t in rows], DOCS)


def brute_components(rows, width, percent):
    sets, parent = {}, {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
        parent[i] = i

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize("leaf", [jaccard.LEAF_BYTES, 4_000])  # bytes; the small one splits regions over tasks
def test_jaccard_join(spark, leaf):
    rnd = random.Random(1)
    words = [f"w{k}" for k in range(900)]
    rows = [(10_000, None), (10_001, ""), (10_002, "one two"), (10_003, "One two"), (10_004, " \n ")]
    for _ in range(10):
        base = [rnd.choice(words) for _ in range(rnd.randint(3, 120))]
        for _ in range(rnd.choice([1, 2, 5, 50])):
            text = list(base)
            for _ in range(rnd.randint(0, 5)):
                text[rnd.randrange(len(text))] = rnd.choice(words)
            rows.append((len(rows), " ".join(text)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.ngram_jaccard_join(docs_of(spark, rows), 4, 85, leaf).collect()}
    assert got == brute_components(rows, 4, 85)


def components_of(n, links):
    label = list(range(n))
    for a, b in links:
        label = [label[a] if x == label[b] else x for x in label]
    return {frozenset(i for i in range(n) if label[i] == x) for x in label}


@pytest.mark.parametrize("percent", [80, 85])
def test_linked_sets_share_a_signature(percent):
    rnd, met = random.Random(8), 0
    for _ in range(2500):
        case_share = rnd.choice([0, 0.1, 0.5, 1])
        x = {rnd.getrandbits(64) for _ in range(rnd.choice([1, 2, 3, 5, 8, 13, 30, 60, 150, 400, 1500]))}
        y = set(x)
        for _ in range(rnd.randint(0, max(1, len(x) * (100 - percent) // percent))):
            if len(y) > 1 and rnd.random() < 0.6:
                y.discard(next(iter(y)))
            if rnd.random() < 0.6:
                y.add(rnd.getrandbits(64))
        if x != y and 100 * len(x & y) >= percent * len(x | y):
            common = np.array(sorted(t for t in x | y if rnd.random() < case_share), np.uint64)
            a, b = (jaccard.signatures(np.array(sorted(s), np.uint64), percent, common) for s in (x, y))
            assert len(np.intersect1d(a, b))
            met += 1
    assert met > 1000


def test_chance_hangs_few_sets_together():
    rng = np.random.default_rng(4)
    pool, top = rng.integers(1, (1 << 64) - 1, 833, np.uint64), (1 << 64) - 1  # a shingle of it is in 24 sets, too few to be known as common
    sets = [np.unique(np.concatenate([rng.choice(pool, 10, replace=False), rng.integers(1, top, 290, np.uint64)])) for _ in range(2000)]
    signs = [jaccard.signatures(s, 80) for s in sets]
    label, _, _ = jaccard.together(np.concatenate(signs), np.repeat(np.arange(len(sets)), list(map(len, signs))), len(sets))
    assert np.bincount(label).max() < 200  # 1,082 when all parts were sent


def test_every_frequent_shingle_counts_as_common(spark):
    tokens = np.unique(np.random.default_rng(5).integers(1, (1 << 64) - 1, 250_000, np.uint64))
    parts = spark.createDataFrame([(bytearray(x.tobytes()),) for x in np.array_split(tokens, 3)] + [(None,)], "often binary")
    bits = jaccard.common_shingles(parts)
    assert jaccard.in_map(bits, tokens).all() and bits.nbytes == 16 << 20
    assert jaccard.in_map(bits, np.random.default_rng(6).integers(1, (1 << 64) - 1, 10_000, np.uint64)).mean() < 0.05


def test_sets_made_together_equal_sets_made_alone():
    rnd, ends = random.Random(12), " \t\n\x0b\x0c\r"
    texts = [None, b"", b" ", b"one", b" A\nb ", b"y" * 3000, b"a " * 90, "é\xa0x \x1c \x85".encode()]
    texts += ["".join(rnd.choice(("ab", "Ab", "é", "long" * rnd.randint(1, 12), rnd.choice(ends))) for _ in range(rnd.randint(0, 400))).encode() for _ in range(300)]
    flat, sizes = jaccard.shingle_sets(texts, 4)
    for t, s in zip(texts, np.split(flat, np.cumsum(sizes)[:-1]), strict=True):
        w = (t or b"").lower().split()
        assert len(s) == len({tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else ())
        assert (jaccard.shingle_sets([b" ".join(w)], 4)[0] == s).all()
    signs, owner = jaccard.set_signatures(flat, sizes, 85)
    for k, s in enumerate(np.split(flat, np.cumsum(sizes)[:-1])):
        assert sorted(signs[owner == k].tolist()) == sorted(jaccard.signatures(s, 85).tolist())


def test_regions_are_joined_by_voronoi_cells():
    rnd, cells = random.Random(9), 0
    for _ in range(150):
        base, pool = list(range(rnd.randint(20, 60))), set()
        for _ in range(rnd.randint(2, 60)):
            b = rnd.choice([base, base[:-6] + [200 + i for i in range(6)], base[:-12] + [300 + i for i in range(12)]])
            pool.add(frozenset(x if rnd.random() < 0.94 else rnd.randrange(400, 440) for x in b))
        sets = list(pool)
        near = [(a, b) for b in range(len(sets)) for a in range(b) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
        region = jaccard.RegionJoin(np.arange(len(sets)), np.zeros(len(sets), bool), [np.array(sorted(s), np.uint64).tobytes() for s in sets], 85)
        assert components_of(len(sets), region.run()) == components_of(len(sets), near)
        cells += region.cells
    assert cells > 100


def test_leaf_links_bridge_known_members():
    rnd = random.Random(6)
    for case in range(400):
        if case:
            base, sets = list(range(rnd.randint(20, 40))), []
            for _ in range(rnd.randint(3, 12)):
                sets.append({x if rnd.random() < 0.9 else rnd.randrange(100, 120) for x in rnd.choice([base, base, base[:-4] + [200, 201, 202, 203]])})
        else:  # known 0 is linked to 1 alone, which is linked to all
            m = set(range(100))
            sets = [m - set(range(14)), m, *(m | {200 + 20 * k + j for j in range(8)} for k in range(3))]
        near = [(a, b) for b in range(len(sets)) for a in range(b) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
        group = max(components_of(len(sets), near), key=len) if case else {0}
        known = [i in group and (not case or rnd.random() < 0.4) for i in range(len(sets))]
        tied = [(min(i for i, k in enumerate(known) if k), i) for i, k in enumerate(known) if k]
        got = jaccard.leaf_links(np.arange(len(sets)), np.array(known), [np.array(sorted(s), np.uint64).tobytes() for s in sets], 85)
        assert set(got) <= set(near) | {(b, a) for a, b in near}
        assert components_of(len(sets), got + tied) == components_of(len(sets), near + tied)


def test_jaccard_join_of_nothing(spark):
    assert jaccard.ngram_jaccard_join(docs_of(spark, []), 4, 85).count() == 0


def test_bpe_equals_the_library():
    ranks = byte_bpe.parse_ranks(open(tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read())
    library = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    mine, rnd = byte_bpe.Codec(ranks, tokenizers.PATTERN), random.Random(2)
    texts = ["", "ab" * 20_000, "a" * 5_000, "  \n \n a  b", *("".join(rnd.choice("aaabeé \n日 !😀x1٣\t's") for _ in range(rnd.randint(0, 80))) for _ in range(400))]
    for t in texts:
        packed = mine.encode(t)
        assert np.frombuffer(packed, "<u4").tolist() == library.encode_ordinary(t)
        assert mine.decode(packed) == t.encode()


def test_bpe_memo_keeps_frequent_pieces(monkeypatch):
    ranks = {bytes([b]): b for b in range(256)}
    encoded, encode = [], byte_bpe.encode_piece
    monkeypatch.setattr(byte_bpe, "encode_piece", lambda piece, r: encoded.append(piece) or encode(piece, r))
    codec = byte_bpe.Codec(ranks, tokenizers.PATTERN, 20)
    for k in range(200):
        assert codec.decode(codec.encode(f"often rare{'x' * k}")) == f"often rare{'x' * k}".encode()
    assert encoded.count(b"often") == 1 and len(codec.pieces) + len(codec.pieces.older) <= 20


def test_bpe_over_a_table(spark):
    ranks = byte_bpe.parse_ranks(open(tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read())
    library = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [(1, None), (2, ""), (None, "Null's id"), (3, "same  text\n"), (3, "same  text\n"), (4, "é日 x" * 30_000 + "a" * 50_000)]
    path = tokenizers.path("byte_bpe_50k.tiktoken")
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = byte_bpe.round_trip(docs_of(spark, rows), path, tokenizers.PATTERN).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == sorted(want)
    encoded = byte_bpe.encode(docs_of(spark, rows), path, tokenizers.PATTERN)
    assert sorted((str(r["doc_id"]), r["ids"]) for r in encoded.collect()) == sorted((str(i), library.encode_ordinary(t or "")) for i, t in rows)
    decoded = byte_bpe.decode(encoded.withColumn("key", F.lit("k")), path, tokenizers.PATTERN)
    assert sorted((str(r["doc_id"]), bytes(r["body"])) for r in decoded.collect()) == sorted((str(i), (t or "").encode()) for i, t in rows)
    assert byte_bpe.round_trip(docs_of(spark, []), path, tokenizers.PATTERN).count() == 0


def best_fit_decreasing(lengths, size):
    gaps = []
    for n in sorted(lengths, reverse=True):
        k = min((k for k in range(len(gaps)) if gaps[k] >= n), key=lambda k: gaps[k], default=None)
        if k is None:
            gaps.append(size - n)
        else:
            gaps[k] -= n
    return len(gaps)


def test_word_ids_and_packing(spark):
    path = tokenizers.path("word_bpe_49k.json")
    words, rnd, library = packing.words_of(open(path, "rb").read()), random.Random(4), tokenizer_library.Tokenizer.from_file(path)
    signs = [*"aAbeé \n日 !😀x1\t'ś\x1cΣİ<|>", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>"]
    for _ in range(600):
        t = "".join(rnd.choice(signs) for _ in range(rnd.randint(0, 40)))
        assert np.frombuffer(b"".join(map(words.__getitem__, t.encode().split())), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t
    rows = [(i, " ".join(["word"] * rnd.randint(0, 60))) for i in range(300)] + [(300, None), (300, None), (301, "x " * 150)]
    out = packing.best_fit_packing(docs_of(spark, rows), tokenizers.path("word_bpe_49k.json"), size=64).collect()
    used = {}
    for r in out:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert sorted((r["piece"], r["start"], r["length"]) for r in out if r["doc_id"] == 301) == [(0, 0, 64), (1, 64, 64), (2, 128, 23)]
    assert len(used) <= best_fit_decreasing([r["length"] for r in out], 64)


def test_packing_plan_places_every_piece():
    counts = {n: random.Random(n).randint(0, 50) for n in range(1, 65)}
    segments, total = packing.plan(counts, 64)
    assert {n: c for n, c in counts.items() if c} == {n: sum(s.count for s in segments if s.length == n) for n in {s.length for s in segments}}
    assert total >= -(-sum(n * c for n, c in counts.items()) // 64)


def test_exact_dedup_and_filters(spark):
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 20_000).astype(np.uint64))
    built = exact_dedup.build_filter(keys)
    assert exact_dedup.in_filter(keys, *built).all()
    assert exact_dedup.in_filter(np.random.default_rng(2).integers(0, 1 << 63, 20_000).astype(np.uint64), *built).mean() < 0.01
    texts = [None, "", "A b", "a B", "Éa", "éa", "x", "x", "X", "y"]
    rows = list(enumerate(texts)) + [(9, "y")]
    got = exact_dedup.exact_dedup(*exact_dedup.split_by_age(docs_of(spark, rows))).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").encode().lower(), []).append(i)
    want = sorted((i, max(m), len(m), i == max(m), hashlib.sha256(k).hexdigest()) for k, m in groups.items() for i in m)
    assert sorted(map(tuple, got)) == want
    assert exact_dedup.exact_dedup(*exact_dedup.split_by_age(docs_of(spark, []))).count() == 0


def test_exact_dedup_rests_on_its_filter(spark, monkeypatch):
    docs = docs_of(spark, [(0, "x"), (1, "y"), (2, "X"), (3, "z"), (None, "y"), (None, "w")])
    groups = lambda: {(r["doc_id"], r["text_sha256"][:4]): (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(*exact_dedup.split_by_age(docs)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()[:4]
    assert groups() == {(0, sha("x")): (2, 2), (2, sha("x")): (2, 2), (1, sha("y")): (1, 2), (None, sha("y")): (1, 2), (3, sha("z")): (3, 1), (None, sha("w")): (None, 1)}
    screen = exact_dedup.screen
    monkeypatch.setattr(exact_dedup, "screen", lambda *given: screen(*given).withColumn("maybe", F.lit(False)))
    assert groups()[2, sha("x")] == (2, 1) and groups()[0, sha("x")] == (0, 1)


def test_base_spans_and_field():
    rnd, brute_email, brute_ip = random.Random(5), re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    for _ in range(5000):
        t = "".join(rnd.choice("ab1290.@@.--+ ()\n:é") for _ in range(rnd.randint(0, 40)))
        want = [("email", *m.span()) for m in brute_email.finditer(t)] + [("ip", *m.span()) for m in brute_ip.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
        assert [s for s in pii.base_spans(t) if s[0] in ("email", "ip")] == want
    field, lines = pii.trained(), pii.training_lines(200, seed=99)
    assert sum(field.decode(t) == truth for t, truth in lines) > 0.8 * len(lines)
    assert pii.find("call (389) 555-5010 now", field) == ([], [("phone", 5, 19)])
    assert pii.masked("a b@c.de f", [("email", 2, 8)]) == "a <email> f" and pii.find(None, field) == ([], [])


def test_field_finds_entities_at_every_offset():
    field, number = pii.trained(), "(389) 555-5010"
    crowd = " ".join([number] * 100)
    assert pii.find(crowd, field)[1] == [("phone", 15 * k, 15 * k + 14) for k in range(100)]
    for k in range(230):
        for before in ("write to ab@cd.com " + ("word " * 50)[:k] + " ", "x 7" + "." * (k + 20) + " "):
            text = before + number + " now"
            assert ("phone", len(before), len(before) + len(number)) in pii.find(text, field)[1]
        text = "write to ab@cd.com " + ("word " * 50)[:k] + " jane (at) mail.com now"
        assert ("email", text.index("jane"), len(text) - 4) in pii.find(text, field)[1]


def test_field_sums_over_all_segmentations():
    rnd, names = np.random.default_rng(3), {}
    text = "x 389-555-5010 4111111111111111 y@z.com"
    truth = [("phone", 2, 14), ("card", 15, 31), ("email", 32, 39)]
    chart = pii.Chart(text, truth, names)
    w, moves = rnd.normal(size=len(names)), rnd.normal(size=(5, 5))
    ends = [0, *(m.end() for m in pii.TOKEN.finditer(text))]
    score = lambda k: w[chart.numbers[chart.mine == k]].sum()

    def every(i):  # (segments, labels) from token i on
        if i == chart.tokens:
            yield (), ()
            return
        for segments, labels in every(i + 1):
            yield segments, (0, *labels)
        for j, y, k in chart.at[i]:
            for segments, labels in every(j):
                yield (k, *segments), (y, *labels)

    found = list(every(0))
    points = [sum(score(k) for k in segments) + sum(moves[a, b] for a, b in zip((0, *labels), labels)) for segments, labels in found]
    p = np.exp(points)
    z, share, steps = chart.posteriors(w, moves)
    assert len(found) > 20 and np.isclose(z, p.sum())
    assert np.allclose(share, [p[[k in segments for segments, _ in found]].sum() / z for k in range(len(share))])
    assert np.isclose(steps[0, 0], sum(q * sum((a, b) == (0, 0) for a, b in zip((0, *labels), labels)) for q, (_, labels) in zip(p, found)) / z)
    field = pii.SemiMarkov({name: w[k] for name, k in names.items()}, moves.tolist())
    spans = field.decode(text)
    best = found[int(np.argmax(points))][0]
    named = {k: (pii.LABELS[y], ends[i], ends[j]) for i in range(chart.tokens) for j, y, k in chart.at[i]}
    assert spans == [named[k] for k in best]


def test_detection_of_odd_rows(spark):
    crowd = "a@b.co; 4111 1111 1111 1111; +1 389 555 5010; 10.0.0.1; " * 2000
    out = pii.detect(docs_of(spark, [(1, None), (2, ""), (None, "a@b.co"), (3, crowd), (3, crowd)])).collect()
    got = sorted((str(r["doc_id"]), r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in out)
    assert got == [("1", 0, 0, 0, 0), ("2", 0, 0, 0, 0), ("3", 2000, 2000, 2000, 2000), ("3", 2000, 2000, 2000, 2000), ("None", 1, 0, 0, 0)]
    empty = hashlib.sha256(b"").hexdigest()
    assert {r["doc_id"]: (r["base_sha256"], r["spans"]) for r in out}[1] == (empty, "")
    assert {r["doc_id"]: r["base_sha256"] for r in out}[None] == hashlib.sha256(b"email:0:6").hexdigest()
    assert pii.detect(docs_of(spark, [])).count() == 0


def test_base_cards_and_phones_equal_the_patterns():
    rnd = random.Random(15)
    for _ in range(4000):
        t = "".join(rnd.choice("0123456789  -+(). \né4111") for _ in range(rnd.randint(0, 70)))
        digits = lambda m: re.sub("[^0-9]", "", m.group())
        cards = [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
        phones = [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m)) <= 15]
        assert [s for s in pii.base_spans(t) if s[0] in ("card", "phone")] == cards + phones


def test_redaction_keeps_columns(spark):
    out = pii.redact(docs_of(spark, [(1, "at x.y@z.com"), (2, None), (None, "")])).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["text"], r["key"]) for r in out] == [(None, "", "k"), (1, "at <email>", "k"), (2, None, "k")]


def brute_dedup(rows, min_words):
    """Every run of units compared with every earlier one, by its words."""
    found, gone = [], {}
    for i, t in sorted({r for r in rows if r[0] is not None and r[1] is not None}):
        units = [(m.start(), m.end(), m.group().encode().lower().split()) for m in re.finditer(r"[^.!?,;:\n]*[.!?,;:\n]+|[^.!?,;:\n]+", t)]
        units = [u for u in units if u[2]]
        for a in range(len(units)):
            words = []
            for b in range(a, len(units)):
                words = words + units[b][2]
                if len(words) >= min_words:
                    if any(words == w for w in found):
                        gone.setdefault(i, set()).update(range(units[a][0], units[b][1]))
                    found.append(words)
                    break
    return {(i, t): (t if not gone.get(i) or t is None else "".join(c for k, c in enumerate(t) if k not in gone[i])) for i, t in rows}


@pytest.mark.parametrize("held", [substring_dedup.HELD, 3])
def test_substring_dedup(spark, held):
    rnd = random.Random(12)
    passage = "".join(rnd.choice(["one two, ", "Three four five. ", "six\n", "é seven; eight: ", "nine\n\nten! "]) for _ in range(12))
    rows = [(None, passage), (50, None), (51, ""), (52, " \n.."), (53, "short line"), (54, "short line"), (None, None)]
    for i in range(25):
        own = "".join(f"w{rnd.randrange(10**6)}{rnd.choice([' ', ', ', '. ', chr(10)])}" for _ in range(rnd.randint(0, 30)))
        rows.append((i, own + rnd.choice(["", passage, passage.upper(), passage[9:], passage.replace(" ", "  ")]) + own[: rnd.randint(0, 20)] + rnd.choice(["", passage])))
    rows += [rows[-1], rows[-2]]
    out = substring_dedup.substring_dedup(docs_of(spark, rows), 8, held).collect()
    want = brute_dedup(rows, 8)
    assert sorted((str(i), str(t)) for i, t in ((r["doc_id"], r["text"]) for r in out)) == sorted((str(i), str(want[i, t])) for i, t in rows)
    texts = dict(rows)
    for r in out:
        if r["doc_id"] is not None and r["text"] is not None:
            assert "".join(texts[r["doc_id"]][a:b] for a, b in r["kept_spans"]) == r["text"]
            assert sorted(r["kept_spans"] + r["removed_spans"]) == r["kept_spans"] + r["removed_spans"] or len(r["removed_spans"]) > 0
            assert sum(b - a for a, b in r["kept_spans"] + r["removed_spans"]) == len(texts[r["doc_id"]])
    assert substring_dedup.substring_dedup(docs_of(spark, [])).count() == 0


def test_chat(spark):
    rows = [(1, 0, "user", "Hello there\nsecond"), (1, 1, "bot", "> hello  THERE\nhi"), (1, 2, "user", ">> Hello there\n> hi\nthanks"), (1, 3, "user", "> never said\nx"), (2, 0, None, None), (None, 0, "u", "> a")]
    out = chat.chat_format(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {(r["conv_id"], r["turn"]): (r["body"], r["n_quoted"], r["reply_to"], r["thread"], r["depth"]) for r in out.collect()}
    assert got[1, 0] == ("Hello there\nsecond", 0, None, 0, 0)
    assert got[1, 1] == ("hi", 1, 0, 0, 1) and got[1, 2] == ("thanks", 2, 1, 0, 2) and got[1, 3] == ("x", 1, None, 3, 0)
    assert got[2, 0] == ("", 0, None, 0, 0)
    order = [(r["turn"], r["position"]) for r in out.where("conv_id = 1").orderBy("position").collect()]
    assert order == [(0, 0), (1, 1), (2, 2), (3, 3)] and {r["position"] for r in out.where("conv_id IS NULL").collect()} == {None}
    assert chat.render(out).where("conv_id = 1 AND position = 0").first()["chat"] == "<|user|>\nHello there\nsecond"
    assert chat.chat_format(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_passages(spark):
    first, again = "It began here.\nCommon line\nand it went on\n\nanother paragraph", "Common line"
    rows = [(1, 0, "u", first), (1, 1, "u", again), (1, 2, "b", "> It began here.\n> Common line\n> and it went on\nyes"), (1, 3, "b", "> Common line\nno"), (1, 4, "b", "> it  BEGAN here. common\n> line and it went on\nwrapped"),
            (1, 5, "b", "> another paragraph\nwell"), (1, 6, "b", "> and it began\n> here\nnot said"), (1, 7, "b", ">> It began here.\n>> Common line\n>> and it went on\n> yes\nnested")]
    out = chat.chat_format(spark.createDataFrame([(*r, "x", 0) for r in rows], "conv_id long, turn long, role string, text string, hash string, passage int"))
    assert {r["turn"]: r["reply_to"] for r in out.collect()} == {0: None, 1: None, 2: 0, 3: 1, 4: 0, 5: 0, 6: None, 7: 2}


def test_chat_positions_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 4)
    rnd = random.Random(5)
    rows = [(c, t, rnd.choice(["a", "b"]), rnd.choice([None, t, rnd.randrange(t + 1)])) for c in (1, 2) for t in range(50) for _ in range(rnd.choice([1, 1, 2]))]
    rows = [(c, t, role, str(k), t if thread is None else thread) for k, (c, t, role, thread) in enumerate(rows)]
    got = chat.places(spark.createDataFrame(rows, "conv_id long, turn long, role string, body string, thread long")).collect()
    for c in (1, 2):
        mine = sorted((r["thread"], r["turn"], r["role"], r["body"], r["position"]) for r in got if r["conv_id"] == c)
        assert [r[-1] for r in mine] == list(range(len(mine)))


def test_chat_origins_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 4)
    rnd = random.Random(3)
    rows = []
    for conv in (1, 2):
        for turn in range(40):
            lines = [">" * rnd.choice([0, 0, 0, 1, 1, 2]) + " " + rnd.choice(["common", f"rare {rnd.randrange(25)}", ""]) for _ in range(rnd.randint(1, 5))]
            rows.append((conv, turn, "user", "\n".join(lines)))
    rows.append((1, 7, "bot", "common\n> rare 3"))

    def units(text):  # (level, passage) of runs, paragraphs and lines
        found = set()
        for level, run in itertools.groupby(text.split("\n"), key=lambda x: x.count(">")):
            body = "\n".join(x.lstrip("> ") for x in run)
            found |= {(level, " ".join(p.split())) for p in [body, *re.split(r"\n[ \t]*\n", body), *body.split("\n")] if p.split()}
        return found

    parts = [(c, t, *u) for c, t, _, text in rows for u in units(text)]
    expected = {}
    for c, t, level, body in parts:
        origins = [u for d, u, own, said in parts if d == c and u < t and own == 0 and said == body]
        if level and origins:
            expected[c, t] = max(expected.get((c, t), (-9, 0, 0)), (-level, len(body), max(origins)))
    got = {(r["conv_id"], r["turn"]): r["reply_to"] for r in chat.links(chat.parse(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert len(got) > 20 and got == {k: v[2] for k, v in expected.items()}


def test_warc_round_trip(spark, tmp_path):
    long = "é<p>日本</p>\r\n\r\nWARC/1.1\r\n" * 6000
    rows = [(1, "http://a/ b", "x"), (2, "http://b", "x"), (3, None, None), (4, "u\r\nv", long), (5, "http://c", "")]
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w"), segment_bytes=10_000, chunk_bytes=700)
    got = {r["page_id"]: r for r in warc.reassemble(warc.read_records(spark, str(tmp_path / "w"))).collect()}
    assert bytes(got[4]["payload"]) == long.encode() and got[4]["record_type"] == "response"
    assert (got[1]["record_type"], got[1]["refers_to"], got[3]["refers_to"], got[5]["record_type"]) == ("revisit", 2, 5, "response")
    assert got[1]["payload_digest"] == base64.b32encode(hashlib.sha1(b"x").digest()).decode() and got[1]["payload_bytes"] == 1
    torn = warc.read_records(spark, str(tmp_path / "w")).where("segment IS NULL OR segment != 2")
    with pytest.raises(Exception, match="segments are missing"):
        warc.reassemble(torn).collect()


def test_warc_of_odd_rows(spark, tmp_path):
    rows = [(None, "u", "x"), (None, "u", "x"), (1, None, "x"), (1, None, "x"), (2, "u", "y"), (2, "u", "z"), (3, "u", "x")]
    pages = spark.createDataFrame([(*r, "k", 0) for r in rows], "page_id long, url string, html string, payload_sha1 string, keep long")
    warc.write_warc(pages, str(tmp_path / "w"))
    got = warc.reassemble(warc.read_records(spark, str(tmp_path / "w"))).collect()
    assert sorted((str(r["page_id"]), r["record_type"], str(r["refers_to"])) for r in got) == [("1", "revisit", "3"), ("1", "revisit", "3"), ("2", "response", "None"), ("2", "response", "None"), ("3", "response", "None"), ("None", "response", "None"), ("None", "response", "None")]
    warc.write_warc(pages.limit(0), str(tmp_path / "e"))
    assert warc.reassemble(warc.read_records(spark, str(tmp_path / "e"))).count() == 0


def test_quality_counts_and_decoding():
    text = "a b c\n\na b c\nx #| a b c"
    n, chars, symbols, dups, repeats, failed, _, kept = quality.judge(text, quality.Field.train([]))
    assert (n, chars, symbols, dups, repeats, failed, kept) == (11, 12, 2, 1, 9, True, False)
    assert quality.judge(None, quality.Field.train([]))[:2] == (0, 0)
    rnd = np.random.default_rng(1)
    field = quality.Field(rnd.normal(size=(quality.FEATURES, 2)), rnd.normal(size=(2, 2)))
    for _ in range(20):
        x = rnd.normal(size=(7, quality.FEATURES))
        s = x @ field.weights
        score = lambda y: sum(s[t, y[t]] for t in range(7)) + sum(field.moves[y[t], y[t + 1]] for t in range(6))  # noqa: B023, E731
        best = max((tuple(k >> t & 1 for t in range(7)) for k in range(128)), key=score)
        assert tuple(field.viterbi(x)) == best


def test_quality_trains_on_all_lines(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality.Field, "train", classmethod(lambda cls, documents: seen.extend(documents)))
    rows = [(1, "a b\n" * 2500 + "\n".join(f"word {k}" for k in range(700))), (2, "c d")]
    quality.train_field(docs_of(spark, rows), spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"))
    assert [(len(x), y) for x, y in seen] == [(3200, 1), (1, 0)]


def test_quality_expectations_equal_all_labellings():
    rnd = np.random.default_rng(4)
    field = quality.Field(rnd.normal(size=(quality.FEATURES, 2)), rnd.normal(size=(2, 2)))
    lengths = np.array([5, 3])
    s = rnd.normal(size=(5, 2, 2))
    single, pairs = field.expected(s, lengths)
    for d, n in enumerate(lengths):
        every = [tuple(k >> t & 1 for t in range(n)) for k in range(2**n)]
        p = np.exp([sum(s[t, d, y[t]] for t in range(n)) + sum(field.moves[y[t], y[t + 1]] for t in range(n - 1)) for y in every])
        p /= p.sum()
        for t in range(5):
            assert np.allclose(single[t, d], [sum(q for q, y in zip(p, every) if t < n and y[t] == v) for v in (0, 1)])
            assert np.allclose(pairs[t, d], [[sum(q for q, y in zip(p, every) if t + 1 < n and (y[t], y[t + 1]) == (v, w)) for w in (0, 1)] for v in (0, 1)])


def test_quality_labels_lines_of_one_document_differently():
    prose = lambda k: f"It was a plain day number {k} and the people went on with what they had begun before. They said so."
    good = ["\n".join([prose(k) for k in range(i, i + 12)] + ["All rights reserved."]) for i in range(40)]
    bad = ["\n".join(["Home | News | About | Contact | Help"] * 6 + [f"BUY!! NOW!! NUMBER!! {i}!!"] * 6) for i in range(40)]
    lines = lambda t: quality.line_features(t.encode().split(b"\n"))[0]
    field = quality.Field.train([(lines(t), 1) for t in good] + [(lines(t), 0) for t in bad])
    mixed = "\n".join([*(prose(k) for k in range(100, 108)), *["Home | News | About | Contact | Help"] * 5])
    assert field.viterbi(lines(mixed)).tolist() == [1] * 8 + [0] * 5
    *_, failed, content, kept = quality.judge(mixed, field)  # the sentences repeat, so the base rules fail it
    assert (failed, content, kept) == (True, 8 * len(prose(100).split()), False) and not quality.judge(bad[0], field)[-1]
    rnd = random.Random(2)
    words = lambda n: " ".join("".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    menus = lambda n: [f"{words(1)} | {words(1)} | {words(1)} | {words(1)} | {words(1)}" for _ in range(n)]
    for prose_lines, kept in ((12, True), (3, False)):
        text = "\n".join([*(words(18) + "." for _ in range(prose_lines)), *menus(20)])
        *_, failed, _, verdict = quality.judge(text, field)
        assert (failed, verdict) == (False, kept) and field.viterbi(lines(text)).tolist() == [1] * prose_lines + [0] * 20


def test_quality_of_odd_rows(spark):
    docs = docs_of(spark, [(1, None), (None, "a b"), (2, ""), (2, ""), (3, "word " * 200_000)])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality.score(docs, quality.train_field(docs, labels)).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["base_failed"], r["kept"]) for r in out) == [("1", 0, True, False), ("2", 0, True, False), ("2", 0, True, False), ("3", 200_000, True, False), ("None", 2, True, False)]
    assert quality.score(docs_of(spark, []), quality.Field.train([])).count() == 0


def test_toxicity_learns_by_compression_and_odd_rows(spark):
    rnd = random.Random(21)
    plain = lambda: " ".join("".join(rnd.choice(["ra", "mi", "to", "ne", "lu"]) for _ in range(rnd.randint(1, 4))) for _ in range(60))
    foul = lambda: " ".join(w + rnd.choice(["", "", "", "", " you wretched gobshite,"]) for w in plain().split())
    rows = [(i, foul() if i % 3 == 0 else plain()) for i in range(400)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i, _ in rows] + [(7, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    docs = docs_of(spark, rows + [(None, None), (401, ""), (402, foul() * 200), (402, foul() * 200)])
    model = toxicity.train(docs, labels)
    assert b"gobshite" in model.toxic and b"gobshite" not in model.ordinary
    out = {(r["doc_id"], r["held_out"]): (r["score"], r["predicted"]) for r in toxicity.score(docs, model).collect()}
    unseen = [i for (i, held), _ in out.items() if held and i is not None and i < 400]
    assert len(unseen) > 60 and all(out[i, True][1] == int(i % 3 == 0) for i in unseen)
    assert out[None, False][0] == toxicity.distance_of(model).score("", model.weights) < 0.3
    assert toxicity.score(docs_of(spark, []), model).count() == 0
    assert toxicity.train(docs, labels.limit(0)).toxic == b""


def test_trained_models_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id").where("held_out").select("score", "toxic").collect()
    s, y = np.array([r["score"] for r in scored]), np.array([r["toxic"] for r in scored])
    assert (s[y == 1][:, None] > s[y == 0][None, :]).mean() > 0.75
    kept = quality.score(docs, quality.train_field(docs, labels)).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("kept")).collect()
    share = {r["quality"]: r["kept"] for r in kept}
    assert share[1] > 0.85 and share[0] < 0.15
