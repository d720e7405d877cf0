"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations alone.

A text becomes lower-case words of letters and digits, each a 64-bit hash; in scripts written without
spaces, each character is a word. A mask is a fixed pattern
over ``span`` neighbouring words that ignores some of them; the hash of the words it keeps is a spaced
seed, which a substituted word at an ignored place does not change. The masks follow from what is
accepted below: found by enumeration, every accepted overlap has a seed of one of them. Seeds of every place of every text are joined to
those of the benchmark. A hit fixes how text and item lie against each other; there, the item's words
are compared with the text's one by one, and an overlap counts when words agree in a stretch without
more than ``max_gap`` substitutions in a row that has at least ``least_words`` agreeing words, or
``least_share`` of the item's if that is fewer, and at least ``least_share`` of its words agreeing.
An overlap is the best stretch from its first agreeing word on, or from where agreeing words last fell
behind that share, so chance agreements around a verbatim passage don't hide it.

Only seeds, fixed-size rows of hash, item and place, meet the texts. Up to ``broadcast_seeds`` of them
are sent to every task: texts never move then, seeds are made, joined and verified where a text is, and
only hits leave. With more, the texts' seeds are shuffled to the benchmark's instead, whose join splits
hot seeds, and hits fetch their words from the texts by row; the texts are read twice, however large the
benchmark is. Items' words meet hits alone, broadcast up to ``broadcast_words`` in all, shuffled beyond.

Items of which fewer than ``least_words`` must agree have masks of their own. Those with fewer than
``least_masked`` words are held by their whole word sequence, which is hashed as one seed of that
length. With fewer than ``least_short`` words an item says little inside a text; it is found in texts
that consist of its words and nothing else. Items without any word match nothing.

Of overlaps that count, the masks miss none, whatever words are substituted: tests go through all of them.

Nulls: a null text or item has no words; a null doc_id or item_id is kept, and rows with equal doc_id are
one document, those with equal item_id one item. Very long texts and items are compared whole. Of ties
the greater span is given. Repeated rows change nothing. Empty tables give no rows. Further columns are
ignored by ``contaminations`` and kept by ``decontaminate``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, only, written

#: Places kept (1) and ignored (0) among neighbouring words. No stretch of 13 agreeing words or more with a share of 0.7
#: and gaps of 3 at most avoids both.
MASKS = ("10111", "11001001")
#: The same for stretches of 6 agreeing words or more.
SHORT_MASKS = ("10111", "1100101", "1111", "11011", "11101")
#: Characters that are words of their own.
UNSPACED = r"([\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}])"
#: At about 100 bytes a seed and 8 a word in an executor's memory.
BROADCAST_SEEDS, BROADCAST_WORDS = 250_000, 1_000_000


def word_hashes(text: Column) -> Column:
    """The hashes of a text's words, in order."""
    apart = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), UNSPACED, " $1 ")
    words = F.split(F.trim(F.regexp_replace(apart, r"[^\p{L}\p{N}]+", " ")), " ")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def _seed(words: Column, at: Column, mask: str) -> Column:
    kept = [i for i, x in enumerate(mask) if x == "1"]
    return F.xxhash64(F.lit(mask), *(F.get(words, at + i) for i in kept))


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once a row: later filters can't be moved below a generator."""
    return df.withColumn(name, F.explode(F.array(value)))


def seeds(rows: DataFrame, masks: tuple[str, ...], whole: int = 0) -> DataFrame:
    """``rows`` (with words) once for each place and mask: at, seed. Rows of fewer than ``whole`` words have one seed of all."""
    many, least = F.size("words"), min(map(len, masks), default=1 << 30)
    rows = rows.withColumn("at", F.explode(F.when(many >= least, F.sequence(F.lit(0), many - least)).when((many > 0) & (many < whole), F.array(F.lit(0)))))
    found = [F.when(F.col("at") + len(m) <= many, _seed(F.col("words"), F.col("at"), m)) for m in masks]
    if whole:
        found.append(F.when((many < whole) & (F.col("at") == 0), F.xxhash64(F.lit("whole"), F.col("words"))))
    return rows.withColumn("seed", F.explode(F.array(*found))).filter("seed is not null")


def agreement(ours: Column, theirs: Column, max_gap: int, least_share: float) -> Column:
    """(most, of): agreeing words of the best stretch that has ``least_share`` of them, and the words it spans.

    A fold over the item's places holds two stretches that end here, as agreeing words and words
    spanned: one from the first agreeing word on, and one that begins anew where its share fell below
    ``least_share``. A run of more than max_gap substitutions ends both.
    """
    same = F.zip_with(ours, theirs, lambda a, b: F.coalesce(a == b, F.lit(False)))
    zero = F.struct(*(F.lit(0).alias(c) for c in ("agree", "spans", "late", "late_spans", "gap", "best", "best_spans")))

    def step(s: Column, x: Column) -> Column:
        fresh = ~x & (s.gap >= max_gap)
        agree = F.when(x, s.agree + 1).when(fresh, 0).otherwise(s.agree)
        spans = F.when(fresh, 0).when(x | (s.agree > 0), s.spans + 1).otherwise(0)
        behind = fresh | ~x & (s.late < least_share * (s.late_spans + 1))
        late = F.when(x, s.late + 1).when(behind, 0).otherwise(s.late)
        late_spans = F.when(behind, 0).when(x | (s.late > 0), s.late_spans + 1).otherwise(0)
        gap = F.when(x | fresh | (s.agree == 0), 0).otherwise(s.gap + 1)
        first = x & (agree >= least_share * spans) & (agree > s.best)
        second = x & (late >= least_share * late_spans) & (late > s.best)
        best = F.when(first, agree).when(second, late).otherwise(s.best)
        best_spans = F.when(first, spans).when(second, late_spans).otherwise(s.best_spans)
        return F.struct(*(c.cast("int").alias(n) for c, n in ((agree, "agree"), (spans, "spans"), (late, "late"), (late_spans, "late_spans"), (gap, "gap"), (best, "best"), (best_spans, "best_spans"))))

    return F.aggregate(same, zero, step, lambda s: F.struct(s.best.alias("most"), s.best_spans.alias("of")))


def contaminations(
    docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, max_gap: int = 3, least_words: int = 13, least_share: float = 0.7, least_short: int = 5, broadcast_seeds: int = BROADCAST_SEEDS,
    short_masks: tuple[str, ...] = SHORT_MASKS, least_masked: int = 8, broadcast_words: int = BROADCAST_WORDS,
) -> DataFrame:
    """(doc_id, item_id, n_words, span_words): documents that hold an item, by the best overlap of each pair."""
    n = F.col("n")
    needed = F.when(n < least_masked, n).otherwise(F.least(F.lit(least_words), F.ceil(least_share * n - 1e-9)))
    items = _once(only(benchmark, "item_id", "text"), "words", word_hashes(F.col("text")))
    items = written(items.select(F.monotonically_increasing_id().alias("key"), "item_id", "words", F.size("words").alias("n")).filter("n > 0"), "benchmark-items")
    below = sorted(r[0] for r in items.filter(needed < least_words).select("n").distinct().collect())  # few values
    lengths = [x for x in below if least_short <= x < least_masked]
    whole = least_short if any(x < least_short for x in below) else 0
    short = [("1" * x,) for x in lengths]
    held = seeds(items.filter(needed >= least_words), masks).union(seeds(items.filter((needed < least_words) & (n >= least_masked)), short_masks))
    for length, mask in zip(lengths, short, strict=True):
        held = held.union(seeds(items.filter(n == length), mask))
    if whole:
        held = held.union(seeds(items.filter(n < least_short), (), whole))
    if any(x >= least_masked for x in below):
        masks = tuple(dict.fromkeys((*masks, *short_masks)))
    masks = tuple(dict.fromkeys((*masks, *(m for of in short for m in of))))
    held = written(held.select("seed", F.col("at").alias("item_at"), "key", "n").distinct(), "benchmark-seeds")
    first = (F.col("at") - F.col("item_at")).alias("first")
    if held.count() <= broadcast_seeds:
        ours = _once(only(docs, "doc_id", "text"), "words", word_hashes(F.col("text"))).select("doc_id", "words")
        hits = seeds(ours, masks, whole).join(F.broadcast(held), "seed").select("doc_id", "words", "key", "n", first)
    else:
        ours = _once(numbered(only(docs, "doc_id", "text"), "row"), "words", word_hashes(F.col("text"))).select("doc_id", "row", "words")
        met = seeds(ours.select("row", "words"), masks, whole).select("row", "at", "seed").join(held.hint("merge"), "seed")
        hits = ours.join(met.select("row", "key", "n", first).distinct(), "row").drop("row")
    # the part of the text that lies against the item, with nulls where it does not reach
    before = F.array_repeat(F.lit(None).cast("long"), F.greatest(-F.col("first"), F.lit(0)))
    reach = F.slice("words", F.greatest(F.col("first"), F.lit(0)) + 1, F.col("n") + F.least(F.col("first"), F.lit(0)))
    hits = hits.select("doc_id", "key", F.concat(before, reach).alias("ours"))
    few = (items.agg(F.sum("n")).first()[0] or 0) <= broadcast_words
    against = items.select("key", "item_id", "n", F.col("words").alias("theirs"))
    met = hits.join(F.broadcast(against) if few else against.hint("merge"), "key")
    overlaps = _once(met, "a", agreement(F.col("ours"), F.col("theirs"), max_gap, least_share)).filter(F.col("a.most") >= needed)
    best = overlaps.groupBy("doc_id", "item_id").agg(F.max("a").alias("a"))
    return best.select("doc_id", "item_id", F.col("a.most").cast("long").alias("n_words"), F.col("a.of").cast("long").alias("span_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no item, as they are. Rows with a null doc_id are judged together."""
    found = contaminations(docs, benchmark, **options).select(F.col("doc_id").alias("hit_doc")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["hit_doc"]), "left_anti")
