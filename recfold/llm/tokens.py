"""Token ids for whole texts as the ``tokenizers`` library gives them, each distinct word encoded once a slice.

A byte-level BPE never merges across the words its pattern cuts. Where no two white spaces stand
together, the pattern cuts before every space and around every line feed, and between a letter or
digit and the sentence marks after it. So texts are split there, the distinct stems and marks of a
slice are encoded once, and the texts' ids are put together from those by array operations.

Stems that are surely one piece for the pattern need the vocabulary's merges alone. These are applied
to all stems of equal length at once: in each step, every stem merges its neighbours of least rank,
the leftmost first, until none of its neighbours merge, which is what the library does one by one.
Stems that are not surely one piece, long ones, and texts with white spaces side by side go to the
library whole, as does everything where the vocabulary file is no plain byte-level BPE.

Nulls are empty texts; an empty text has no ids. A very long text is a slice of its own.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import gathered

_SPACE = r"[\s\p{Z}\x0b\x1c-\x1f\x85]"
_MARKS = ".,;:!?"
#: What is surely one piece for the pattern: letters, digits or marks, with a space before them or none.
_ONE_PIECE = r"^ ?([A-Za-zÀ-ÖØ-öø-ɏ]+|[0-9]+|[.,;:!?]+)$"
#: Bytes of a stem that is merged here; longer ones are the library's.
MOST_BYTES = 32
_NEVER = np.int32(np.iinfo(np.int32).max)


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Merges:
    """The merges of a byte-level BPE, applied to many words of equal length at a time."""

    def __init__(self, model: dict):
        vocab, symbols = model["vocab"], byte_symbols()
        self.of_byte = np.array([vocab[symbols[b]] for b in range(256)], np.int32)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.result = np.array([vocab[a + b] for a, b in pairs], np.int32)  # by rank
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.uint64)
        self.bits = max(8, 3 + len(keys).bit_length())  # an eighth full at most
        self.keys, self.ranks = np.full(1 << self.bits, ~np.uint64(0)), np.full(1 << self.bits, _NEVER)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot[left]] == ~np.uint64(0)
            _, first = np.unique(slot[left[free]], return_index=True)  # one key a slot and round
            got = left[free][first]
            self.keys[slot[got]], self.ranks[slot[got]] = keys[got], got
            left = np.setdiff1d(left, got, assume_unique=True)
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank at which neighbours merge, _NEVER for those that don't."""
        keys = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.ranks[slot], _NEVER)
        left = np.flatnonzero((found != keys).ravel() & (found != ~np.uint64(0)).ravel())
        keys, slot, flat = keys.ravel(), slot.ravel(), out.ravel()
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[left]]
            hit = found == keys[left]
            flat[left[hit]] = self.ranks[slot[left[hit]]]
            left = left[~hit & (found != ~np.uint64(0))]
        return flat.reshape(out.shape)

    def apply(self, words: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """The ids of words of equal length (a row of bytes each): pairs of row numbers and as many rows of ids."""
        ids, rows, out = self.of_byte[words], np.arange(len(words)), []
        ranks = self.rank(ids[:, :-1], ids[:, 1:])
        while ids.shape[1] > 1:
            at = ranks.argmin(axis=1)
            least = ranks[np.arange(len(at)), at]
            done = least == _NEVER
            if done.any():
                out.append((rows[done], ids[done]))
                go = ~done
                ids, rows, ranks, at, least = ids[go], rows[go], ranks[go], at[go], least[go]
                if not len(rows):
                    return out
            n, many = ids.shape
            row, column = np.arange(n), np.arange(many - 1)
            ids = np.where(column <= at[:, None], ids[:, :-1], ids[:, 1:])
            ids[row, at] = self.result[least]
            if many == 2:
                break
            ranks = np.where(column[:-1] < at[:, None], ranks[:, :-1], ranks[:, 1:])
            before, after = np.flatnonzero(at > 0), np.flatnonzero(at < many - 2)
            ranks[before, at[before] - 1] = self.rank(ids[before, at[before] - 1], ids[before, at[before]])
            ranks[after, at[after]] = self.rank(ids[after, at[after]], ids[after, at[after] + 1])
        out.append((rows, ids))
        return out


def _merges(path: str) -> Merges | None:
    """The merges of a vocabulary file, if it is a plain byte-level BPE."""
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    model, before = whole["model"], whole.get("pre_tokenizer") or {}
    odd = any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    plain = model.get("type", "BPE") == "BPE" and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and not whole.get("normalizer")
    return Merges(model) if plain and not odd else None


class WordEncoder:
    """Ids of many texts at a time. Special strings inside texts are handled as the library does by default."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = _merges(path)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        """The library's ids of each text."""
        return [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, unique: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A pool of ids, and where in it each string has its own: first place and number."""
        n_bytes = pc.binary_length(unique).to_numpy(zero_copy_only=False)
        one = pc.match_substring_regex(unique, _ONE_PIECE).to_numpy(zero_copy_only=False) & (n_bytes <= MOST_BYTES)
        rest, found = np.flatnonzero(~one), []
        odd = self.whole(unique.take(pa.array(rest)).to_pylist())
        offsets, data = np.frombuffer(unique.buffers()[1], np.int64)[unique.offset : unique.offset + len(unique) + 1], np.frombuffer(unique.buffers()[2] or b"", np.uint8)
        plain = np.flatnonzero(one)
        plain = plain[np.argsort(n_bytes[plain], kind="stable")]
        for group in np.split(plain, np.flatnonzero(np.diff(n_bytes[plain])) + 1) if len(plain) else []:
            rows = data[offsets[group][:, None] + np.arange(n_bytes[group[0]])]
            found += [(group[at], ids) for at, ids in self.merges.apply(rows)]
        size, first = np.zeros(len(unique), np.int64), np.zeros(len(unique), np.int64)
        size[rest] = np.fromiter(map(len, odd), np.int64, len(odd))
        first[rest] = np.cumsum(size[rest]) - size[rest]
        parts, end = [*odd], int(size[rest].sum())
        for at, ids in found:
            size[at], first[at] = ids.shape[1], end + np.arange(len(ids)) * ids.shape[1]
            parts.append(ids.ravel().view(np.uint32))
            end += ids.size
        return np.concatenate([*parts, np.zeros(0, np.uint32)]), first, size

    def _split(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and offsets of texts without white spaces side by side."""
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        starts = split.offsets.to_numpy()
        coded = split.values.dictionary_encode()
        codes, unique = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        heads, nth = np.unique(codes[starts[:-1]], return_inverse=True)  # the first of a text has no space before it
        codes[starts[:-1]] = len(unique) + nth
        fed = pc.starts_with(unique, "\n").to_numpy(zero_copy_only=False)
        bodies = pc.replace_substring_regex(unique, "^\n", "")
        spaced = pc.if_else(pa.array(fed), bodies, pc.binary_join_element_wise(pa.scalar("", pa.large_string()), bodies, pa.scalar(" ", pa.large_string())))
        bodies = pa.concat_arrays([spaced, unique.take(pa.array(heads))])
        fed = np.concatenate((fed, np.zeros(len(heads), bool)))
        stems = pc.utf8_rtrim(bodies, characters=_MARKS)
        apart = pc.match_substring_regex(stems, r"[\p{L}\p{N}]$")
        stems = pc.if_else(apart, stems, bodies)
        marks = pc.if_else(apart, pc.replace_substring_regex(bodies, rf"^.*[^{_MARKS}]", ""), "")
        stem, mark = stems.dictionary_encode(), marks.cast(pa.large_string()).dictionary_encode()
        pool, first, size = self.words(pa.concat_arrays([stem.dictionary, mark.dictionary, pa.array(["\n", ""], pa.large_string())]))
        parts = np.stack([  # of each distinct word: a line feed or nothing, its stem, its marks
            len(first) - 1 - fed, stem.indices.to_numpy(), len(stem.dictionary) + mark.indices.to_numpy().astype(np.int64)], axis=1).ravel()
        word_size = size[parts].reshape(-1, 3).sum(axis=1)
        words = gathered(pool, first[parts], size[parts])
        word_first = np.cumsum(word_size) - word_size
        total = np.concatenate(([0], np.cumsum(word_size[codes])))
        return gathered(words, word_first[codes], word_size[codes]), total[starts]

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        unsafe = pc.match_substring_regex(texts, f"{_SPACE}{{2}}").to_numpy(zero_copy_only=False)
        lengths = np.zeros(len(texts), dtype=np.int64)
        parts = []
        if len(safe := np.flatnonzero(~unsafe)):
            parts.append((safe, *self._split(texts.take(pa.array(safe)))))
        if len(odd := np.flatnonzero(unsafe)):
            got = self.whole(texts.take(pa.array(odd)).to_pylist())
            parts.append((odd, np.concatenate(got), np.concatenate(([0], np.cumsum([len(x) for x in got])))))
        for rows, _, bounds in parts:
            lengths[rows] = np.diff(bounds)
        offsets = np.concatenate(([0], np.cumsum(lengths)))
        if len(parts) == 1:
            return parts[0][1], offsets
        first, base = np.zeros(len(texts), np.int64), 0
        for rows, ids, bounds in parts:
            first[rows], base = base + bounds[:-1], base + len(ids)
        return gathered(np.concatenate([ids for _, ids, _ in parts] or [np.zeros(0, np.uint32)]), first, lengths), offsets

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the offsets of each text in them. A null is an empty text."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if self.merges is None:
            got = self.whole(texts.to_pylist())
            return np.concatenate([*got, np.zeros(0, np.uint32)]), np.concatenate(([0], np.cumsum([len(x) for x in got], dtype=np.int64)))
        return self._slice(texts)


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder per worker and vocabulary."""
    return WordEncoder(path)


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same texts with ``end_id`` after each."""
    return np.insert(ids, offsets[1:], end_id), offsets + np.arange(len(offsets))
