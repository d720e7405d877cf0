"""The pipeline against a plain version of its stages on a small corpus."""

from __future__ import annotations

import random
from collections import Counter

import pytest

import corpus_pipeline
from recfold.llm import tokens
from recfold.llm.queries import tokenizer_path
from tests.llm.test_llm_small import plain_best_fit, plain_kept

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8)))
    words = lambda n: [word() for _ in range(n)]
    texts = {i: words(rng.randint(60, 400)) for i in range(40)}
    passage, leak = words(70), words(40)
    for i in (3, 9, 15):
        texts[i][20:20] = passage
    texts[5][10:10] = leak
    near = list(texts[7])
    near[len(near) // 2] = "other"
    texts |= {100: near, 101: list(texts[8]), 102: list(texts[8]), 103: ["##"] * 60, 104: words(4), 105: [w for w in words(20) for _ in range(2)]}
    return {i: " ".join(w) for i, w in texts.items()} | {106: None}, " ".join(leak)


def plain_pipeline(texts, leak):
    """The documents that stay, with their texts, stage by stage."""
    good = plain_kept([(t, "en", "s") for t in texts.values()])
    kept = {i: t for (i, t), k in zip(texts.items(), good, strict=True) if k}
    shingles = {i: {tuple(w[k : k + 5]) for w in [t.split()] for k in range(len(w) - 4)} for i, t in kept.items()}
    for i in sorted(kept):
        if any(j < i and j in kept and len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j]) for j in list(kept)):
            del kept[i]
    count = Counter(t[k : k + 200] for t in kept.values() for k in range(len(t) - 199))
    for i, t in kept.items():
        gone = {p for k in range(len(t) - 199) if count[t[k : k + 200]] > 1 for p in range(k, k + 200)}
        kept[i] = "".join(c for p, c in enumerate(t) if p not in gone)
    return {i: t for i, t in kept.items() if t.strip() and leak not in t}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    texts, leak = corpus()
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, leak)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages_and_run(spark, folder):
    want = plain_pipeline(*corpus())
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r.doc_id: r.text for r in docs.collect()} == want
    packed = corpus_pipeline.run(spark, folder).collect()
    ids = tokens.WordEncoder(tokenizer_path("byte_bpe_50k.json")).whole(list(want.values()))
    lengths = [x for n in (len(i) + 1 for i in ids) for x in ([1024] * (n // 1024) + [n % 1024] * (n % 1024 > 0))]
    assert Counter(r.length for r in packed) == Counter(lengths) and {r.doc_id for r in packed} == set(want)
    assert len({r.sequence_id for r in packed}) == plain_best_fit(lengths, 1024)[0]


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "x " * 20)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
