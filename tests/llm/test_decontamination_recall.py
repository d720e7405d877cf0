"""Overlaps that the verifier accepts are found, whatever words are substituted."""

from __future__ import annotations

import random

from recfold.llm import decontaminate


def accepted(keeps):
    """Whether a pattern of agreeing (1) and substituted (0) words is an overlap that counts."""
    return keeps[0] == keeps[-1] == "1" and "0000" not in keeps and keeps.count("1") >= 13 and keeps.count("1") >= 0.7 * len(keeps)


def overlaps(many):
    """Accepted patterns of 13 to 30 words, at random, and those with every fourth word substituted."""
    rng = random.Random(17)
    found = [("1110" * n)[:n] for n in (17, 19, 21, 31, 41, 81)] + ["11" + "011" * 6, "1110111011101111", "1" * 13]
    while len(found) < many:
        n = rng.randint(13, 30)
        gone = set(rng.sample(range(n), rng.randint(0, int(0.3 * n))))
        if accepted(keeps := "".join("0" if i in gone else "1" for i in range(n))):
            found.append(keeps)
    return found


def contaminated(spark, cases):
    """Of cases of (item, text), which texts are found to hold their item."""
    docs = spark.createDataFrame([(i, text) for i, (_, text) in enumerate(cases)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(cases)], "item_id long, text string")
    return {r.doc_id for r in decontaminate.contaminations(docs, benchmark).filter("doc_id = item_id").collect()}


def substituted(keeps, rng):
    """An item, and a text that holds it but for the words that ``keeps`` has not."""
    word = lambda: f"w{rng.getrandbits(40)}"
    item = [word() for _ in keeps]
    text = [word() for _ in range(4)] + [w if k == "1" else word() for w, k in zip(item, keeps, strict=True)] + [word() for _ in range(4)]
    return " ".join(item), " ".join(text)


def test_every_accepted_overlap_is_found(spark):
    patterns, rng = overlaps(1200), random.Random(18)
    assert all(map(accepted, patterns))
    found = contaminated(spark, [substituted(p, rng) for p in patterns])
    assert [p for i, p in enumerate(patterns) if i not in found] == []


def test_no_accepted_overlap_avoids_the_masks():
    """The most agreeing words that a stretch of each length can have without a seed, by its last words."""
    masks = [int(m, 2) for m in decontaminate.MASKS]
    wide = (1 << max(map(len, decontaminate.MASKS))) - 1
    most = {1: 1}
    for length in range(2, 200):
        longer = {}
        for last, agree in most.items():
            for same in (0, 1):
                now = (last << 1 | same) & wide
                if (length < 4 or now & 15) and not any(now & m == m for m in masks):
                    longer[now] = max(longer.get(now, 0), agree + same)
        most = longer
        best = max((agree for last, agree in most.items() if last & 1), default=0)
        assert best < 13 or best < 0.7 * length


def test_short_items_are_found(spark):
    rng, cases = random.Random(19), []
    while len(cases) < 600:
        n = rng.randint(8, 17)
        least = -(-7 * n // 10)
        gone = set(rng.sample(range(n), rng.randint(0, n - least)))
        keeps = "".join("0" if i in gone else "1" for i in range(n))
        of = keeps.strip("0")
        if "0000" not in of and 10 * of.count("1") >= 7 * len(of):
            cases.append(substituted(keeps, rng))
    cases += [substituted("1" * n, rng) for n in (5, 6, 7) for _ in range(20)]
    chinese = lambda n: "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(n))
    for n in (6, 12, 30):
        item = chinese(n)
        cases.append((item[:5] + "，" + item[5:] + "？", chinese(20) + item + "。" + chinese(20)))
    found = contaminated(spark, cases)
    assert [c for i, c in enumerate(cases) if i not in found] == []


def test_too_little_of_a_short_item_is_not_found(spark):
    rng = random.Random(20)
    assert contaminated(spark, [substituted(p, rng) for p in ("11011", "1111110", "11100111000000", "101101101101")]) == set()
