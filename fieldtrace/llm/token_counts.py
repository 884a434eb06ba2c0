"""Token counts through a digest cache.

The cache is a Parquet table of (content digest, count), partitioned by tokenizer digest, that grows by appending. A run joins the
digests of its texts to the stored counts, encodes one text for each digest that is missing, appends the new counts, and
joins again. The tokenizer digest is that of the vocabulary file's bytes, so a new version never meets old counts.

A text's count is the sum over chunks that no token reaches across, where the vocabulary file makes sure of such places; a
worker keeps the counts of chunks, so only chunks that it has not met reach the library. Other texts go to it whole.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, map_arrow, slices, text_blocks, write_shared
from .wordcache import WordNumbers

CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"
#: Characters handed to the library in one call.
CALL_CHARS = 1 << 20
#: Copies from which on a text's count is broadcast to its rows; more where such texts would pass BROADCAST_ROWS.
HOT_COPIES = 1000
#: Chunks whose counts a Python worker keeps for a tokenizer (about 55 bytes each).
CACHE_CHUNKS = 2_000_000
#: Bytes of chunks of over 16 bytes that it keeps.
LONG_BYTES = 16 << 20
#: The space mark of sentencepiece's pieces (a fixed value).
MARK = "▁"
_LOADED: dict[str, Callable[[list[str]], list[int]]] = {}
#: White space, in engines that differ on it too, before white space at which a text is cut.
_DOUBT = "[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff][ \t\n\r]"


def tokenizer_digest(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(1 << 20):
            h.update(part)
    return h.hexdigest()


def read_cache(spark: SparkSession, path: str, tokenizer: str) -> DataFrame:
    """Stored counts of one tokenizer version, one row per digest; no table yet: none."""
    try:
        stored = spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "digest binary, n_tokens long")
    return stored.where(F.col("tokenizer") == tokenizer).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


class ChunkCounter(WordNumbers):
    """Token counts of texts as sums over chunks: a run of the characters in ``white`` and what follows it up to the next run.

    No token may reach across the start of such a run, and ``alone`` gives the counts of chunks as parts of a text, which begins
    with ``prefix``. Texts in which ``odd`` is found may break the rule and go to ``whole``, the library.
    """

    def __init__(self, white: str, odd: str, prefix: str, whole: Callable[[list[str]], list[int]], alone: Callable[[list[str]], list[int]]) -> None:
        self.white = np.zeros(256, dtype=bool)
        self.white[list(white.encode())] = True
        self.odd, self.prefix, self.whole, self.alone = re.compile(odd), prefix, whole, alone
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.words = self.long_bytes = 0
        self.count = np.empty(1 << 11, dtype=np.int64)  # by number

    def _learn(self, words: list[str]) -> np.ndarray:
        end = self.words + len(words)
        if end > len(self.count):
            self.count = np.concatenate([self.count[: self.words], np.empty(end, dtype=np.int64)])
        self.count[self.words : end] = self.alone(words)
        numbers = np.arange(self.words, end)
        self.words = end
        return numbers

    def _block(self, texts: list[str]) -> list[int]:
        odd = [i for i, t in enumerate(texts) if self.odd.search(t)]
        inside = np.array([t != "" for t in texts])
        inside[odd] = False
        raw = [(self.prefix + t).encode() if k else b"" for t, k in zip(texts, inside.tolist(), strict=True)]
        base = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
        out = np.zeros(len(texts), dtype=np.int64)
        if base[-1]:
            if self.words > CACHE_CHUNKS:
                self.clear()
            known = len(self.long)
            joined = b"".join([*raw, b"\n" * 8])
            white = self.white[np.frombuffer(joined, dtype=np.uint8)[: base[-1]]]
            begins = np.zeros(len(white), dtype=bool)
            begins[1:] = white[1:] & ~white[:-1]
            begins[base[:-1][inside]] = True
            starts = np.flatnonzero(begins)
            numbers = self._numbers(joined, starts, np.append(starts[1:], base[-1]))
            out = np.diff(np.concatenate([[0], np.cumsum(self.count[numbers])])[np.searchsorted(starts, base)])
            if len(self.long) > known:
                self.long_bytes += sum(map(len, list(self.long)[known:]))
                if self.long_bytes > LONG_BYTES:
                    self.long, self.long_bytes = {}, 0
        if odd:
            out[odd] = self.whole([texts[i] for i in odd])
        return out.tolist()

    def __call__(self, texts: list[str]) -> list[int]:
        return [n for a, b in text_blocks(texts) for n in self._block(texts[a:b])]


def _by_tokenizers(path: str) -> Callable[[list[str]], list[int]]:
    """Counter of a file of the tokenizers library; by chunks where it splits at white space as byte-level vocabularies do."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    whole = lambda texts: [len(x.ids) for x in t.encode_batch_fast(texts, add_special_tokens=False)]
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    split, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
    rule = split.get("type") == "ByteLevel" and not split.get("add_prefix_space", True) and split.get("use_regex", True)
    if not rule or spec.get("normalizer") or spec["model"].get("dropout"):
        return whole
    # its pieces end before a run of white space; within a run they depend on what follows
    return ChunkCounter(" \t\n\r", "|".join([_DOUBT, *(re.escape(x["content"]) for x in added)]), "", whole, whole)


def _by_sentencepiece(path: str) -> Callable[[list[str]], list[int]]:
    """Counter of a sentencepiece model; by chunks where it merges pairs and no piece holds a space behind another character."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    whole = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    try:
        from sentencepiece import sentencepiece_model_pb2
    except ImportError:  # it needs protobuf
        return whole
    with open(path, "rb") as f:
        spec = sentencepiece_model_pb2.ModelProto.FromString(f.read())
    kinds, form = sentencepiece_model_pb2.ModelProto.SentencePiece, spec.normalizer_spec
    plain = [p.piece for p in spec.pieces if p.type != kinds.BYTE]
    inner = {c for p in plain for before, c in zip(p, p[1:], strict=False) if not (c == MARK == before)}
    white = "".join(c for c in " \t\n\r" if (MARK if c == " " else c) not in inner)
    as_it_is = form.add_dummy_prefix and form.escape_whitespaces and not (form.remove_extra_whitespaces or form.precompiled_charsmap or spec.trainer_spec.treat_whitespace_as_suffix)
    merges = spec.trainer_spec.model_type == sentencepiece_model_pb2.TrainerSpec.BPE and not any(p.type == kinds.USER_DEFINED for p in spec.pieces)
    if not (as_it_is and merges and " " in white and any(p.piece == MARK and p.type == kinds.NORMAL for p in spec.pieces)):
        return whole

    def alone(chunks: list[str]) -> list[int]:
        # the library puts a space before: a chunk's own, or one that no piece joins to what follows
        own = [c.startswith(" ") for c in chunks]
        return [1 if c == " " else n - (not k) for c, k, n in zip(chunks, own, whole([c[k:] for c, k in zip(chunks, own, strict=True)]), strict=True)]

    return ChunkCounter(white, MARK, " ", whole, alone)


def _counter(path: str) -> Callable[[list[str]], list[int]]:
    """Function from texts to token counts by the library that reads the file."""
    if path not in _LOADED:
        _LOADED[path] = (_by_sentencepiece if path.endswith(".model") else _by_tokenizers)(path)
    return _LOADED[path]


def _encode(rows: DataFrame, path: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, seen = _counter(path), set()
        for batch in slices(batches):
            digests = batch.column(0).to_pylist()
            # rows that repeat an id and its text meet in one task; one of them is encoded
            fresh = [d not in seen and not seen.add(d) for d in digests]
            batch = batch.filter(pa.array(fresh, pa.bool_()))
            texts, counts, at = batch.column(1).to_pylist(), [], 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= CALL_CHARS):
                    size += len(texts[end])
                    end += 1
                counts += count(texts[at:end])
                at = end
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    return map_arrow(rows, run, "digest binary, n_tokens long")


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, limit: int = 4096) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit``, one row per input row, through the cache at ``cache_path``.

    Content is normalised by taking null as the empty text; nothing else is changed, as any other change could alter a
    count. Null ids and repeated rows are kept. Other columns are ignored. An empty table gives an empty result and
    adds no row to the cache.
    """
    spark, version = docs.sparkSession, tokenizer_digest(tokenizer_path)
    content = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), content.alias("text"))
    texts = texts.withColumn("digest", F.unhex(F.sha2("text", 256))).withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63))))
    digests = texts.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest", "key")
    distinct = write_shared(digests.groupBy("digest").agg(F.min("key").alias("key"), F.count("*").alias("n")), "distinct-texts")
    # one row stands for each missing digest; texts move once, to meet that short list
    missing = distinct.join(read_cache(spark, cache_path, version), "digest", "left_anti").select("key", "digest")
    chosen = texts.select("key", "digest", "text").join(missing.hint("shuffle_hash"), ["key", "digest"], "left_semi").select("digest", "text")
    fresh = _encode(chosen, tokenizer_path).select("digest", F.lit(version).alias("tokenizer"), "n_tokens")
    fresh.write.mode("append").partitionBy("tokenizer").parquet(cache_path)
    counts = read_cache(spark, cache_path, version)
    # texts of many copies are few, however large the table: their counts are broadcast, the other rows shuffled
    rows = distinct.agg(F.sum("n").alias("n")).first()["n"] or 0
    hot = distinct.where(F.col("n") > max(HOT_COPIES, rows // BROADCAST_ROWS)).select("digest")
    if hot.isEmpty():
        named = digests.join(counts, "digest")
    else:
        warm = digests.join(F.broadcast(counts.join(F.broadcast(hot), "digest", "left_semi")), "digest")
        named = warm.unionByName(digests.join(F.broadcast(hot), "digest", "left_anti").join(counts, "digest"))
    return named.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
