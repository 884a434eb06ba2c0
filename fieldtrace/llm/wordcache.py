"""A word-level front for tokenizers whose tokens never reach across white space.

Such a tokenizer's ids of a text are the ids of its white-space-separated words, one after the other. Words repeat, so
their ids are kept in a bounded cache and only words not in it reach the library. Texts for which the rule might not
hold (added tokens, characters on whose class the two regular-expression engines differ) go to the library whole.

Words are looked up a block of texts at a time, as arrays: a word of at most 16 bytes is known by its size and its first
and last eight bytes, which tell it exactly. The cache is a hash table in numpy of about 45 bytes a word.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from typing import ClassVar

import numpy as np

from .common import mix64, text_blocks

#: Words kept by a Python worker.
CACHE_WORDS = 1_000_000
#: Words of one call to the library.
CALL_WORDS = 20_000
#: Separators of str.split() that are no Unicode white space; texts with one go to the library whole.
_DOUBT = re.compile("[\x1c-\x1f]")
#: Unicode white space of more than one byte.
_WIDE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Words of Latin letters, perhaps with one run of marks behind: one pre-token, or two.
_SIMPLE = re.compile("[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+[.,;:!?]*")
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_LOW = np.array([(1 << (8 * min(k, 8))) - 1 for k in range(17)], dtype=np.uint64)


class WordTable:
    """Hash table with open addressing from words of at most 16 bytes to numbers, looked up and filled as arrays."""

    def __init__(self) -> None:
        self.slots = np.full(1 << 12, -1, dtype=np.int32)
        self.head, self.tail, self.size = (np.empty(1 << 11, dtype=t) for t in (np.uint64, np.uint64, np.uint8))
        self.number = np.empty(1 << 11, dtype=np.int32)
        self.used = 0

    @staticmethod
    def key(head: np.ndarray, tail: np.ndarray, size: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64(head ^ mix64(tail + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))

    def find(self, key: np.ndarray, head: np.ndarray, tail: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Number of each word, -1 for one that is not in the table."""
        mask = len(self.slots) - 1
        out, left = np.full(len(key), -1, dtype=np.int64), np.arange(len(key))
        at = (key & np.uint64(mask)).astype(np.int64)
        while len(left):
            entry = self.slots[at]
            there = entry >= 0
            left, at, entry = left[there], at[there], entry[there]
            same = (self.head[entry] == head[left]) & (self.tail[entry] == tail[left]) & (self.size[entry] == size[left])
            out[left[same]] = self.number[entry[same]]
            left, at = left[~same], (at[~same] + 1) & mask
        return out

    def add(self, key: np.ndarray, head: np.ndarray, tail: np.ndarray, size: np.ndarray, number: np.ndarray) -> None:
        """Put in different words that are not in the table."""
        end = self.used + len(key)
        if end > len(self.head):
            room = max(end, 2 * len(self.head))
            for name in ("head", "tail", "size", "number"):
                old = getattr(self, name)
                new = np.empty(room, dtype=old.dtype)
                new[: self.used] = old[: self.used]
                setattr(self, name, new)
        entry = np.arange(self.used, end, dtype=np.int32)
        self.head[entry], self.tail[entry], self.size[entry], self.number[entry] = head, tail, size, number
        self.used = end
        if 2 * end > len(self.slots):
            self.slots = np.full(1 << (4 * end - 1).bit_length(), -1, dtype=np.int32)
            entry = np.arange(end, dtype=np.int32)
            key = self.key(self.head[:end], self.tail[:end], self.size[:end])
        mask = len(self.slots) - 1
        at = (key & np.uint64(mask)).astype(np.int64)
        while len(entry):
            free = self.slots[at] < 0
            self.slots[at[free]] = entry[free]
            lost = self.slots[at] != entry  # the slot was taken, now or before
            entry, at = entry[lost], (at[lost] + 1) & mask


class WordNumbers:
    """Numbers of words by their places in bytes; ``_learn`` gives those of words not met before."""

    def clear(self) -> None:
        """Forget all words."""
        self.table, self.long = WordTable(), {}

    def _learn(self, words: list[str]) -> np.ndarray:
        """Numbers of new words."""
        raise NotImplementedError

    def _numbers(self, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Number of the word at each place of ``raw``, which eight bytes follow."""
        size = ends - starts
        eight = np.ndarray((len(raw) - 7,), dtype="<u8", buffer=raw, strides=(1,))
        head = eight[starts] & _LOW[np.minimum(size, 16)]
        tail = np.where(size > 8, eight[np.maximum(ends - 8, 0)], np.uint64(0))
        key = WordTable.key(head, tail, size)
        _, where, which = np.unique(key, return_index=True, return_inverse=True)
        # words of more than 16 bytes, and ones whose keys chance to agree, are known by their bytes
        own = where[which]
        odd = (size > 16) | (head[own] != head) | (tail[own] != tail) | (size[own] != size)
        numbers = np.full(len(where), -1, dtype=np.int64)
        short = np.flatnonzero(size[where] <= 16)
        at = where[short]
        numbers[short] = self.table.find(key[at], head[at], tail[at], size[at])
        new = short[numbers[short] < 0]
        if len(new):
            at = where[new]
            numbers[new] = self._learn([raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            self.table.add(key[at], head[at], tail[at], size[at], numbers[new])
        out = numbers[which]
        odd = np.flatnonzero(odd)
        if len(odd):
            words = [raw[a:b] for a, b in zip(starts[odd].tolist(), ends[odd].tolist(), strict=True)]
            fresh = list(set(words) - self.long.keys())
            if fresh:
                self.long.update(zip(fresh, self._learn([w.decode("utf-8", "surrogatepass") for w in fresh]).tolist(), strict=True))
            out[odd] = [self.long[w] for w in words]
        return out


class WordEncoder(WordNumbers):
    """Encoder for a tokenizers file with lower-casing, white-space-dropping pre-tokenization."""

    _by_path: ClassVar[dict[str, WordEncoder]] = {}

    def __init__(self, path: str, cache_words: int = CACHE_WORDS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        suffix = spec["model"].get("end_of_word_suffix")
        vocab = spec["model"]["vocab"]
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)  # tokens that end a pre-token
        if suffix:
            self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self.cache_words = cache_words
        self.clear()

    @classmethod
    def shared(cls, path: str, cache_words: int = CACHE_WORDS) -> WordEncoder:
        """The worker's encoder of a file; tasks that a worker runs one after the other share its cache."""
        if path not in cls._by_path:
            cls._by_path[path] = cls(path)
        cls._by_path[path].cache_words = cache_words
        return cls._by_path[path]

    def clear(self) -> None:
        """Forget all words."""
        super().clear()
        self.words = self.filled = 0
        self.first, self.count = np.empty(1 << 11, dtype=np.int64), np.empty(1 << 11, dtype=np.int32)  # by number, into ids
        self.ids = np.empty(1 << 13, dtype=np.uint32)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _library(self, words: list[str]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """(places in ``words``, their ids one after the other, number of ids of each) until every word was met.

        Simple words are encoded many at a time, as one text that is cut after each word's last pre-token.
        """
        simple = [i for i, w in enumerate(words) if _SIMPLE.fullmatch(w)] if self.ends.any() else []
        left = sorted(set(range(len(words))).difference(simple))
        for i in range(0, len(simple), CALL_WORDS // 10):
            part = simple[i : i + CALL_WORDS // 10]
            ids = np.array(self.library.encode_batch_fast([" ".join([words[k] for k in part])], add_special_tokens=False)[0].ids, dtype=np.uint32)
            after = np.flatnonzero(self.ends[ids]) + 1
            tokens = np.cumsum([1 if words[k].isalpha() else 2 for k in part])
            if len(after) == tokens[-1]:
                yield part, ids, np.diff(after[tokens - 1], prepend=0)
            else:
                left += part
        for i in range(0, len(left), CALL_WORDS):
            part = left[i : i + CALL_WORDS]
            got = [e.ids for e in self.library.encode_batch_fast([words[k] for k in part], add_special_tokens=False)]
            yield part, np.array([x for ids in got for x in ids], dtype=np.uint32), np.fromiter(map(len, got), np.int64, len(got))

    def _learn(self, words: list[str]) -> np.ndarray:
        """Numbers of new words."""
        numbers = np.empty(len(words), dtype=np.int64)
        for part, ids, count in self._library(words):
            end, filled = self.words + len(part), self.filled + len(ids)
            for name, need in (("first", end), ("count", end), ("ids", filled)):
                old = getattr(self, name)
                if need > len(old):
                    new = np.empty(max(need, len(old) * 3 // 2), dtype=old.dtype)
                    new[: len(old)] = old
                    setattr(self, name, new)
            numbers[part] = np.arange(self.words, end)
            self.first[self.words : end] = self.filled + np.cumsum(count) - count
            self.count[self.words : end] = count
            self.ids[self.filled : filled] = ids
            self.words, self.filled = end, filled
        return numbers

    def _block(self, texts: list[str | None]) -> list[np.ndarray]:
        whole: dict[int, np.ndarray] = {}
        raw = []
        for i, text in enumerate(texts):
            text = text or ""
            if _DOUBT.search(text) or any(a in text for a in self.added):
                whole[i], text = self._whole(text), ""
            elif not text.isascii() and _WIDE.search(text):
                text = _WIDE.sub(" ", text)
            raw.append(text.encode("utf-8", "surrogatepass"))
        base = np.zeros(len(raw) + 1, dtype=np.int64)
        np.cumsum([len(x) + 1 for x in raw], out=base[1:])
        joined = b"\n".join([*raw, b"\n" * 8])
        white = _WHITE[np.frombuffer(joined, dtype=np.uint8)]
        edges = np.flatnonzero(np.concatenate([[not white[0]], white[1:] != white[:-1]]))
        starts, ends = edges[0::2], edges[1::2]
        if self.words > self.cache_words:
            self.clear()
        number = self._numbers(joined, starts, ends) if len(starts) else np.empty(0, dtype=np.int64)
        n = self.count[number].astype(np.int64)
        stop = np.cumsum(n)
        ids = self.ids[np.repeat(self.first[number] - (stop - n), n) + np.arange(stop[-1] if len(stop) else 0)]
        bounds = np.concatenate([[0], stop])[np.searchsorted(starts, base)]
        return [whole[i] if i in whole else ids[bounds[i] : bounds[i + 1]] for i in range(len(texts))]

    def encode_arrays(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text (null: the empty one) as unsigned 32-bit integers, perhaps views of an array of many texts."""
        for a, b in text_blocks(texts):
            yield from self._block(texts[a:b])

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return [ids.astype("<u4").tobytes() for ids in self.encode_arrays(texts)]
