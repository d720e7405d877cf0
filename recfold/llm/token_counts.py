"""Token counts of whole texts for a SentencePiece BPE model with the whole-token shortcut.

The model writes a space as a mark that begins a piece and never stands inside one, so no merge
crosses the border before a space and a text's count is the sum over its words. Offline, before any
text is read, every vocabulary string that can stand for a word is put through the library: those that
come back as their own single id are proven and count one from then on. The proven strings, a part of
the vocabulary, are sent to the workers. Other words are merged by the library, once each. Texts in which marks could meet (double, leading or trailing spaces, or the mark
character itself) go to the library whole.

Nulls: a null text is empty and counts zero; a null doc_id is kept. A very long text is counted whole.
Repeated rows are counted once each. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import map_batches, only, slices

SPACE_MARK = "▁"
_UNSAFE = f"  |^ | $|{SPACE_MARK}"
CACHE_WORDS = 500_000


def whole_tokens(model) -> set[str]:
    """The words that the model encodes alone as one token, proven one by one."""
    n = model.get_piece_size()
    words = [(i, p[1:]) for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) and (p := model.id_to_piece(i))[:1] == SPACE_MARK and SPACE_MARK not in p[1:] and len(p) > 1]
    return {w for (i, w), ids in zip(words, model.encode([w for _, w in words], num_threads=1), strict=True) if ids == [i]}


@lru_cache(maxsize=2)
def proven(path: str) -> frozenset[str]:
    """The whole tokens of a model, proven once a driver."""
    import sentencepiece

    return frozenset(whole_tokens(sentencepiece.SentencePieceProcessor(model_file=path)))


class TokenCounter:
    def __init__(self, path: str, whole: frozenset[str], cache_words: int = CACHE_WORDS):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.whole = whole
        self.merged: dict[str, int] = {}
        self.cache_words = cache_words

    def _library(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)]

    def words(self, unique: list[str]) -> np.ndarray:
        whole, merged = self.whole, self.merged
        rest = [w for w in unique if w not in whole and w not in merged]
        if len(merged) + len(rest) > self.cache_words:
            merged.clear()
            rest = [w for w in unique if w not in whole]
        merged.update(zip(rest, self._library(rest), strict=True))
        return np.fromiter((1 if w in whole else merged[w] for w in unique), dtype=np.int64, count=len(unique))

    def count(self, texts: pa.Array) -> np.ndarray:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        unsafe = pc.match_substring_regex(texts, _UNSAFE).to_numpy(zero_copy_only=False)
        out = np.zeros(len(texts), dtype=np.int64)
        safe = np.flatnonzero(~unsafe & (pc.binary_length(texts).to_numpy() > 0))
        if len(safe):
            split = pc.split_pattern(texts.take(pa.array(safe)), " ")
            coded = split.values.dictionary_encode()
            sums = np.concatenate(([0], np.cumsum(self.words(coded.dictionary.to_pylist())[coded.indices.to_numpy()])))
            out[safe] = np.diff(sums[split.offsets.to_numpy()])
        odd = np.flatnonzero(unsafe)
        if len(odd):
            out[odd] = self._library(texts.take(pa.array(odd)).to_pylist())
        return out


_COUNTERS: dict[str, TokenCounter] = {}


def token_counts(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row. No shuffle."""
    whole = docs.sparkSession.sparkContext.broadcast(proven(model))  # of the vocabulary's size

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _COUNTERS:  # one a worker
            _COUNTERS[model] = TokenCounter(model, whole.value)
        of = _COUNTERS[model]
        for batch in slices(batches):
            text = batch.column("text")
            n = of.count(text)
            n_bytes = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), n_bytes, pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_batches(only(docs, "doc_id", "text"), count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
