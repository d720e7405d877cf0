"""Near copies just above and below the pipeline's similarity: none lost, none taken for alike."""

from __future__ import annotations

import random

from recfold.llm import simhash


def pairs(many):
    """(similarity, text, text): copies with spread words substituted, shingles of five words compared."""
    rng, made = random.Random(31), []
    while len(made) < many:
        n = rng.randint(60, 600)
        words = [f"w{rng.getrandbits(40)}" for _ in range(n)]
        other = list(words)
        for at in range(rng.randint(0, 20), n, rng.randint(36, 95)):
            other[at] = "other"
        a, b = ({tuple(w[k : k + 5]) for k in range(n - 4)} for w in (words, other))
        share = len(a & b) / len(a | b)
        if 0.7 <= share <= 0.9:
            made.append((share, " ".join(words), " ".join(other)))
    return made


def test_pairs_are_linked_from_the_similarity_on(spark):
    made = pairs(900)
    rows = [(2 * i + k, x[1 + k]) for i, x in enumerate(made) for k in (0, 1)]
    kept = {r.doc_id for r in simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(2 * i in kept for i in range(len(made)))
    assert sum(0.8 <= x[0] < 0.85 for x in made) > 100 and sum(0.75 < x[0] < 0.8 for x in made) > 100
    assert [x[0] for i, x in enumerate(made) if (2 * i + 1 in kept) != (x[0] < 0.8)] == []


def test_large_groups_are_compared_exactly(spark, monkeypatch):
    monkeypatch.setattr(simhash, "COMPARED", 16)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for _ in range(60):
        copy = list(base)
        for at in rng.sample(range(5, 195, 10), rng.randint(1, 4)):
            copy[at] = f"x{rng.random()}"
        texts.append(" ".join(copy))
    sets = [{tuple(w[k : k + 5]) for w in [t.split()] for k in range(len(w) - 4)} for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(i):
                if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    kept = simhash.drop_near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root))
