"""The corpus pipeline against brute force, with rows without an id."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from marketloom.llm import packing, pii, quality

tokenizers = pytest.importorskip("public_tokenizers")


def test_rows_without_an_id_stay(spark, tmp_path):
    rnd = random.Random(8)
    fresh = lambda: [f"w{rnd.randrange(5000)}" for _ in range(60)] + ["call", f"(389) 555-{rnd.randrange(1000, 9999)}"]
    texts = [fresh() for _ in range(12)]
    texts += [texts[0], texts[0], texts[1], [*texts[2], "more"], [*texts[3], "more"], ["too", "short"], ["Word"] * 80]
    rows = [(None if k % 3 == 0 else k, " ".join(t)) for k, t in enumerate(texts)] + [(None, " ".join(texts[4])), (None, None), (90, None)]
    spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    field = quality.Field.train([])
    left = [(i, t) for i, t in rows if quality.judge(t, field)[-1]]
    left = [(i, t) for i, t in left if i is None or i == max(j for j, u in left if j is not None and u.lower() == t.lower())]
    grams = lambda t: {tuple(t.lower().split()[k : k + 5]) for k in range(len(t.split()) - 4)}
    near = lambda a, b: 100 * len(grams(a) & grams(b)) >= 80 * len(grams(a) | grams(b))
    left = [(i, t) for i, t in left if i is None or i == min(j for j, u in left if j is not None and near(t, u))]
    words = packing.words_of(open(tokenizers.path("word_bpe_49k.json"), "rb").read())
    expected = Counter((i, len(words.whole.encode(pii.masked(t, pii.find(t, pii.trained())[1]), add_special_tokens=False).ids) + 1) for i, t in left)

    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sum(r["doc_id"] is None for r in found) == 7
    assert Counter((r["doc_id"], r["length"]) for r in found) == expected
