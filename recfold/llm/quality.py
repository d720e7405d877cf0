"""Quality rules whose cutoffs follow the data: quantile sketches per language and source.

Each text gets counts and, from them, four whole-number ratios. A sketch is a count per bucket of a
ratio; buckets have a sixteenth of their value as width, so a quantile read from a sketch is off by at
most that, and sketches merge by adding counts, in any order, to the same sketch. Counts are added up
where the rows are before anything moves, so a source with a third of all rows costs no more than
another. The cutoffs are then joined to the texts and filter them.

Quartiles of a language and source are shrunk toward those of its language, and these toward those of
all rows: a group of fewer than ``weight`` rows is taken as if the rest of them had the wider group's, so a
small group borrows from a larger one and a large group speaks for itself. A cutoff lies SPREAD upper
spreads (median to upper quartile) beyond the median. Junk within a source widens its upper spread
alone; this counts for no more than the greater of its lower spread and the usual upper spread, the
median of all groups'. So a source in which up to half of the rows are junk does not let them pass, as
long as most sources are not such. The mean word length has a lower cutoff as well, and both lie half
the median away at least. There is no fixed level: what is usual in a source passes there, and a text
goes for a rate far from its own source's. FEW single symbols, lines or words say nothing of a rate and
are not counted.

Nulls: a null text has no words and fails; a null language or source is a group of its own. Very long
texts are counted whole. Repeated rows are judged alike, each counted in the sketches; ties in a sketch
share its bucket. An empty table gives no rows. Further columns, whatever their names, are ignored by
``quality`` and kept by ``quality_filter``.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_name, map_batches, only, slices, written

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_echo_words")
RATIOS = ("symbols", "word_length", "lines", "echoes")
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Spreads allowed beyond the median.
SPREAD = 8
#: Symbols, repeated lines and words equal to the one before that are not counted against a text.
FEW = 3
#: Rows below which a group borrows from the wider one.
WEIGHT = 200


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of five that the text has twice or more, the first included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))
    size = len(known)
    if size == len(words):
        return 0
    if size < 6_000:  # five ids fit in 63 bits
        key = ids[: n + 4]
        key = (((key[:n] * size + key[1 : n + 1]) * size + key[2 : n + 2]) * size + key[3 : n + 3]) * size + key[4 : n + 4]
    else:  # ranks of pairs, of pairs of pairs, and of those with the fifth word
        _, pair = np.unique(ids[:-1] * size + ids[1:], return_inverse=True)
        _, four = np.unique(pair[:-2] * len(words) + pair[2:], return_inverse=True)
        key = four[:n] * size + ids[4 : n + 4]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def text_counts(text: str | None) -> tuple[int, ...]:
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.encode().split()  # of bytes: the six white spaces of ASCII alone
    lines = [x for x in text.split("\n") if x.encode().split()] if "\n" in text else []
    return (
        len(words),
        len(text) - sum(map(text.count, " \t\n\r\x0b\x0c")),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        sum(map(eq, words, words[1:])),
    )


def with_counts(docs: DataFrame, name: str) -> DataFrame:
    """All columns of ``docs`` and a struct of COUNTS under a name that ``docs`` must not have."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = np.array([text_counts(t) for t in batch.column("text").to_pylist()], dtype=np.int64).reshape(-1, len(COUNTS))
            yield batch.append_column(name, pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(len(COUNTS))], names=list(COUNTS)))

    return map_batches(docs, run, schema)


def _div(a: Column, b: Column) -> Column:
    """Whole-number division of what is not negative."""
    return ((a - a % b) / b).cast("long")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def ratios() -> dict[str, Column]:
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "symbols": _div(F.col("n_symbols") * 1_000_000, chars),
        "word_length": _div(F.col("word_chars") * 1_000, words),
        "lines": _div(F.col("n_dup_lines") * 1_000_000, words),
        "echoes": _div(F.col("n_echo_words") * 1_000_000, words),
    }


def bucket(value: Column) -> Column:
    """The bucket of a whole number from 0: itself below 16, else its power of two and the next four bits."""
    power = (F.length(F.bin(value)) - 1).cast("int")
    fine = F.call_function("shiftright", value, F.greatest(power - 4, F.lit(0)))
    return F.when(value < 16, value).otherwise(16 * (power - 4) + fine).cast("int")


def bucket_floor(b: Column) -> Column:
    """The least value of a bucket."""
    step = F.greatest(_div(b, F.lit(16)).cast("int") - 1, F.lit(0))
    return F.when(b < 16, b.cast("long")).otherwise(F.call_function("shiftleft", (b % 16 + 16).cast("long"), step))


def sketches(counted: DataFrame) -> DataFrame:
    """(lang, source, ratio, bucket, n): the sketches of texts that pass the base rules."""
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("ratio"), bucket(v).alias("bucket")) for k, v in ratios().items()))).alias("x")
    rows = counted.filter(~base_failed()).select("lang", "source", pairs)
    return rows.groupBy("lang", "source", "x.ratio", "x.bucket").agg(F.count("*").alias("n"))


def _quartiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """One row per group of ``by``: its rows and the three quartiles of each ratio."""
    from pyspark.sql import Window

    merged = sketch.groupBy(*by, "ratio", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*by, "ratio")
    cum = merged.withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("total", F.sum("n").over(w))
    at = [F.min(F.when(4 * F.col("upto") >= k * F.col("total"), F.col("bucket"))).alias(f"b{k}") for k in (1, 2, 3)]
    q = cum.groupBy(*by, "ratio").agg(F.max("total").alias("rows"), *at)
    value = F.struct(*(bucket_floor(F.col(f"b{k}")).alias(f"q{k}") for k in (1, 2, 3)))
    of = lambda r: F.max(F.when(F.col("ratio") == r, value)).alias(r)
    return q.groupBy(*by).agg(F.max("rows").alias("rows"), *map(of, RATIOS))


def cutoffs(sketch: DataFrame, weight: int = WEIGHT) -> DataFrame:
    """One row per language and source: the greatest symbols, lines and echoes, the least and greatest word_length.

    ``sketch`` is read several times, so it should be a written table.
    """
    own, names = _quartiles(sketch, ["lang", "source"]), ("rows", *RATIOS)
    lang = _quartiles(sketch, ["lang"]).select(F.col("lang").alias("of_lang"), *(F.col(x).alias(f"of_{x}") for x in names))
    every = _quartiles(sketch, []).first()  # twelve numbers, nulls where there are no rows
    joined = own.join(lang, own.lang.eqNullSafe(lang.of_lang))

    def shrunk(rows: Column, mine: Column, wider: Column) -> Column:
        return F.struct(*(_div(rows * mine[q] + F.greatest(weight - rows, F.lit(0)) * wider[q], F.greatest(rows, F.lit(weight))).alias(q) for q in ("q1", "q2", "q3")))

    for r in RATIOS:
        wide = F.struct(*(F.lit(every[r][q] if every[r] else 0).cast("long").alias(q) for q in ("q1", "q2", "q3")))
        joined = joined.withColumn(f"all_{r}", wide).withColumn(f"of_{r}", shrunk(F.col("of_rows"), F.col(f"of_{r}"), F.col(f"all_{r}")))
        joined = joined.withColumn(r, shrunk(F.col("rows"), F.col(r), F.col(f"of_{r}")))

    levels = written(joined.select("lang", "source", *RATIOS), "levels")
    usual = levels.agg(*(F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {r}.q3 - {r}.q2)").alias(r) for r in RATIOS)).first()

    def beyond(r: str) -> Column:
        return SPREAD * F.least(F.col(r)["q3"] - F.col(r)["q2"], F.greatest(F.col(r)["q2"] - F.col(r)["q1"], F.lit(int(usual[r] or 0))))

    middle = F.col("word_length")["q2"]
    half = _div(middle, F.lit(2))  # a mean of few words is far from its source's by chance
    upper = lambda r: F.col(r)["q2"] + beyond(r)
    return levels.select(
        F.col("lang").alias("cut_lang"), F.col("source").alias("cut_source"), upper("symbols").alias("most_symbols"), (middle + F.greatest(beyond("word_length"), half)).alias("most_length"),
        (middle - F.greatest(SPREAD * (middle - F.col("word_length")["q1"]), half)).alias("least_length"), upper("lines").alias("most_lines"), upper("echoes").alias("most_echoes"),
    )


def judged(counted: DataFrame, cuts: DataFrame) -> DataFrame:
    """All columns of ``counted`` (lang, source, COUNTS and others without clash), base_failed and kept."""

    def rate(n: str, most: str, of: str) -> Column:
        return F.greatest(F.col(n) - FEW, F.lit(0)) * 1_000_000 <= F.col(most) * F.greatest(F.col(of), F.lit(1))

    length = ratios()["word_length"]
    good = rate("n_symbols", "most_symbols", "word_chars") & rate("n_dup_lines", "most_lines", "n_words") & rate("n_echo_words", "most_echoes", "n_words") & (length <= F.col("most_length")) & (length >= F.col("least_length"))
    rows = counted.join(cuts, counted["lang"].eqNullSafe(cuts["cut_lang"]) & counted["source"].eqNullSafe(cuts["cut_source"]), "left")
    return rows.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & F.coalesce(good, F.lit(False))).drop(*cuts.columns)


def quality(docs: DataFrame, weight: int = WEIGHT) -> DataFrame:
    """doc_id, the counts, base_failed and kept of each row of ``docs``."""
    counted = with_counts(only(docs, "doc_id", "lang", "source", "text"), "counts").select("doc_id", "lang", "source", "counts.*")
    counted = written(counted, "quality-counts")
    cuts = cutoffs(written(sketches(counted), "sketches"), weight)
    return judged(counted, cuts).select("doc_id", *COUNTS[:5], "base_failed", "kept", COUNTS[5])


def quality_filter(docs: DataFrame, weight: int = WEIGHT) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns. Counts are made twice rather than texts written twice."""
    name = fresh_name(docs, "quality_counts")
    first = with_counts(only(docs, "lang", "source", "text"), name).select("lang", "source", f"{name}.*")
    cuts = written(cutoffs(written(sketches(first), "sketches"), weight), "cutoffs")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    counted = with_counts(docs, name).select(row, "lang", "source", f"{name}.*")
    return judged(counted, cuts).filter("kept").select("row.*")
