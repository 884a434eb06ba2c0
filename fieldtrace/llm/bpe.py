"""Byte-pair encoding by backtracking, and decoding by an offset table.

The encoder gives exactly the merges of the vocabulary in time linear in the text. An Aho-Corasick automaton finds the
longest token that begins at each byte. Going left to right, a token is taken if the pair it forms with the token before
it is compatible, that is, if byte-pair merging of the two tokens' joint bytes gives these two tokens again; else the next
shorter token is tried, and when none is left the last token is taken back and its end is barred. Pair compatibility is
kept in a table that fills as pairs occur. Texts are first cut as the tokenizer's own regular expression does, so each
piece is encoded once and kept in a bounded cache.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from typing import ClassVar

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, slices

#: The pre-tokenization pattern of the byte-level vocabulary (a fixed value).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Unicode white space as a class, for an engine whose \s has four control characters more.
_WS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Coarser pieces whose ends are ends of PIECES' pieces too: a run of other characters with the blank before it, or white space.
_COARSE = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
CACHE_PIECES = 800_000
CACHE_PAIRS = 2_000_000


def byte_symbols() -> dict[str, int]:
    """Printable symbol of a byte-level vocabulary -> byte: printable bytes stand for themselves, the rest follow from 256 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


class BacktrackingBpe:
    """Encoder and decoder of a byte-level BPE vocabulary file of the tokenizers library."""

    _by_path: ClassVar[dict[str, BacktrackingBpe]] = {}

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, symbols = spec["model"], byte_symbols()
        to_bytes = lambda token: bytes(symbols[c] for c in token)
        self.bytes_of: dict[int, bytes] = {i: to_bytes(t) for t, i in model["vocab"].items() if all(c in symbols for c in t)}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        for content, i in self.added.items():
            self.bytes_of[i] = content.encode()
        vocab = {b: i for i, b in self.bytes_of.items() if i not in set(self.added.values())}
        self.rank: dict[int, int] = {}  # token -> place in the merge order; single bytes come before every merge
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for r, m in enumerate(model["merges"]):
            left, right = m if isinstance(m, list) else m.split(" ")
            a, b = vocab[to_bytes(left)], vocab[to_bytes(right)]
            t = vocab[to_bytes(left) + to_bytes(right)]
            self.merged[a, b] = t
            if t not in self.rank:
                self.rank[t], self.parts[t] = r + 256, (a, b)
        for n, i in enumerate(sorted(i for b, i in vocab.items() if len(b) == 1)):
            self.rank[i] = n
        usable = {b: i for b, i in vocab.items() if i in self.rank}
        self.shorter = {i: next((usable[b[:k]] for k in range(len(b) - 1, 0, -1) if b[:k] in usable), -1) for b, i in usable.items()}
        self.length = {i: len(b) for b, i in usable.items()}
        self.automaton = ahocorasick.Automaton()  # over reversed tokens: what ends in the reversed text begins in the text
        for b, i in usable.items():
            self.automaton.add_word(b[::-1].decode("latin-1"), (len(b), i))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.cache: dict[str, bytes] = {}
        size = max(self.bytes_of) + 1
        self.blob = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(size)), dtype=np.uint8)
        self.offsets = np.zeros(size + 1, dtype=np.int64)
        np.cumsum([len(self.bytes_of.get(i, b"")) for i in range(size)], out=self.offsets[1:])
        self.fine = regex.compile(PIECES, regex.V0)
        self.special = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None

    @classmethod
    def shared(cls, path: str) -> BacktrackingBpe:
        if path not in cls._by_path:
            cls._by_path[path] = cls(path)
        return cls._by_path[path]

    def _compatible(self, a: int, b: int) -> bool:
        """Whether merging the joint bytes of two tokens leaves just these two.

        Undo merges around the seam, the later one first. The seam would have been closed if at some stage the two
        neighbours merge earlier than the merge that would next use one of them up.
        """
        rank, parts, merged = self.rank, self.parts, self.merged
        limit = 1 << 60
        while True:
            joint = merged.get((a, b))
            if joint is not None and rank[joint] < limit:
                return False
            left, right = rank[a], rank[b]
            if left > right:
                if a not in parts:
                    return True
                limit, a = left, parts[a][1]
            else:
                if b not in parts:
                    if a not in parts:
                        return True
                    limit, a = left, parts[a][1]
                    continue
                limit, b = right + 1, parts[b][0]

    def compatible(self, a: int, b: int) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = self._compatible(a, b)
        return known

    def encode_piece(self, data: bytes) -> list[int]:
        """Exact merges of one piece's bytes."""
        n = len(data)
        longest = [-1] * n
        size = [0] * n
        for end, (length, token) in self.automaton.iter(data[::-1].decode("latin-1")):
            at = n - 1 - end
            if length > size[at]:
                size[at], longest[at] = length, token
        if n and size[0] == n:
            return [longest[0]]  # the whole piece is a token; merging builds every usable token from its bytes
        out: list[int] = []
        barred = bytearray(n + 1)
        at, token = 0, longest[0] if n else -1
        length, shorter, pairs = self.length, self.shorter, self.pairs
        while at < n:
            last = out[-1] if out else -1
            while token >= 0:
                end = at + length[token]
                if not barred[end]:
                    if last < 0:
                        break
                    fit = pairs.get((last, token))
                    if fit if fit is not None else self.compatible(last, token):
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            else:
                barred[at] = 1
                token = out.pop()
                at -= length[token]
        return out

    def _coarse(self, piece: str) -> bytes:
        ids: list[int] = []
        for p in self.fine.findall(piece):
            ids += self.encode_piece(p.encode("utf-8"))
        return np.array(ids, dtype="<u4").tobytes()

    def _plain(self, text: str) -> bytes:
        cache, out = self.cache, []
        for p in _COARSE.findall(text):
            ids = cache.get(p)
            if ids is None:
                if len(cache) >= CACHE_PIECES:
                    cache.clear()
                ids = cache[p] = self._coarse(p)
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers. Added tokens inside the text are found first, as the library does."""
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [self._plain(text[at : m.start()]), np.array([self.added[m[0]]], dtype="<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids, special ones included: one gather from the joint bytes of all tokens."""
        begin = self.offsets[ids]
        size = self.offsets[ids.astype(np.int64) + 1] - begin
        ends = np.cumsum(size)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - (ends - size), size)
        return self.blob[at].tobytes().decode("utf-8", "replace")


def encode_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """``doc_id, ids array<int>`` of whole texts (null: empty), one row per input row, whatever the other columns are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = BacktrackingBpe.shared(tokenizer_path)
        for batch in slices(batches):
            ids = [np.frombuffer(bpe.encode(t or ""), dtype="<u4").astype(np.int32) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return map_arrow(_two(docs), run, "doc_id long, ids array<int>")


def decode_documents(ids: DataFrame, tokenizer_path: str) -> DataFrame:
    """``doc_id, text`` of rows ``doc_id, ids`` (null ids: the empty text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = BacktrackingBpe.shared(tokenizer_path)
        for batch in slices(batches):
            texts = [bpe.decode(np.array(x or [], dtype=np.uint32)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return map_arrow(ids.select(F.col("doc_id").cast("long").alias("doc_id"), "ids"), run, "doc_id long, text string")


def round_trip(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Encode and decode whole texts in one pass -> ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    Null texts count as empty (no id, the digest of nothing). Null ids and repeated rows are kept. An empty table gives
    an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = BacktrackingBpe.shared(tokenizer_path)
        for batch in slices(batches):
            n, ids_sha, text_sha = [], [], []
            for t in batch.column(1).to_pylist():
                raw = bpe.encode(t or "")
                n.append(len(raw) // 4)
                ids_sha.append(hashlib.sha256(raw).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(np.frombuffer(raw, dtype="<u4")).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return map_arrow(_two(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _two(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
