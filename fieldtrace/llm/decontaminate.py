"""Benchmark decontamination by suffix arrays of the training texts.

Each task cuts its documents into shards of a few megabytes and sorts all word suffixes of a shard. Every suffix of every
benchmark item is then looked up by binary search, one word deeper at a time, for as long as some suffix of the shard goes on
alike. So a search gives the longest verbatim match with its place, and the range of the array at a window's depth gives all
places of that window. Benchmarks are handed to the tasks in blocks of a bounded size: one block as a rule; with more, documents
pass the blocks one after the other and carry what was found before.

Words are runs of a-z (A-Z lower-cased), 0-9 and characters beyond ASCII. A window is ``words`` consecutive words of an item;
an item of fewer words, but not none, is one window. A word of a document inside any occurrence of a window is hit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLOCK_BYTES, map_arrow, mix64, slices, text_blocks, unused, word_hashes, write_shared

#: Words of a window.
WINDOW = 10
#: Bytes of benchmark text in a block (as hashes of words about 1.5 times as much in a task); an item is never split.
BENCHMARK_BYTES = 32 << 20
#: Characters that are no part of a word once A-Z are lower-cased.
NO_WORD = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
_OUTSIDE = np.zeros(256, dtype=bool)
_OUTSIDE[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
#: Where a long text may be cut: characters outside all words, before lower-casing.
_SEAM = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def item_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all texts' words, and where each text's words begin (one more entry at the end).

    Texts are hashed a block at a time; one longer than a block is cut between words, so work arrays stay bounded.
    """
    hashes, counts = [np.empty(0, dtype=np.uint64)], [np.zeros(1, dtype=np.int64)]
    for a, b in text_blocks(texts):
        if b - a == 1 and len(texts[a] or "") > 2 * BLOCK_BYTES:
            text, at, n = texts[a], 0, 0
            while at < len(text):
                stop = _SEAM.search(text, at + BLOCK_BYTES)
                end = stop.end() if stop else len(text)
                h, _ = word_hashes([text[at:end]], True, _OUTSIDE)
                hashes.append(h)
                at, n = end, n + len(h)
            counts.append(np.array([n]))
        else:
            h, first = word_hashes(texts[a:b], True, _OUTSIDE)
            hashes.append(h)
            counts.append(np.diff(first))
    return np.concatenate(hashes), np.cumsum(np.concatenate(counts))


def suffix_array(text: np.ndarray, size: int) -> np.ndarray:
    """Places of ``text`` in the order of their suffixes. Numbers are below ``size``; 0 separates documents and ends the text.

    A suffix counts up to its separator, and of suffixes equal so far any may come first. Several numbers are sorted as one key;
    then suffixes still tied are sorted by the ranks of what follows, which doubles the depth each time.
    """
    n, bits = len(text), max(1, int(size - 1).bit_length())
    depth = max(1, min(62 // bits, 16))
    padded = np.concatenate([text, np.zeros(depth, dtype=np.int64)])
    key = text.astype(np.int64)
    for j in range(1, depth):
        key = (key << bits) | padded[j : j + n]
    ends = np.flatnonzero(text == 0)
    left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)  # words before the separator
    order = np.argsort(key)
    sorted_key, closed = key[order], left[order] < depth
    first = np.ones(n, dtype=bool)  # begins a group of suffixes that are equal so far
    first[1:] = (sorted_key[1:] != sorted_key[:-1]) | closed[1:] | closed[:-1]
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    while True:
        tied = np.flatnonzero(~(first & np.append(first[1:], True)))
        if not len(tied):
            return order
        place = order[tied]
        key = rank[place] * n + rank[place + depth]
        by = np.argsort(key)
        order[tied], key = place[by], key[by]
        depth *= 2
        closed = left[order[tied]] < depth
        fresh = np.ones(len(tied), dtype=bool)
        fresh[1:] = (key[1:] != key[:-1]) | closed[1:] | closed[:-1]
        first[tied] |= fresh
        rank[order[tied]] = np.maximum.accumulate(np.where(first[tied], tied, 0))


class Shard:
    """Documents' words as numbers (0 after each document) with their suffix array."""

    def __init__(self, hashes: np.ndarray, first: np.ndarray, vocabulary: np.ndarray) -> None:
        codes, _ = pd.factorize(np.concatenate([hashes, vocabulary]))
        self.of_vocabulary = codes[len(hashes) :].astype(np.int64) + 1
        sizes = np.diff(first)
        self.start = first[:-1] + np.arange(len(sizes))  # of each document
        self.text = np.zeros(len(hashes) + len(sizes), dtype=np.int64)
        self.text[np.arange(len(hashes)) + np.repeat(np.arange(len(sizes)), sizes)] = codes[: len(hashes)] + 1
        size = int(codes.max(initial=-1)) + 2
        self.order = suffix_array(self.text, size) if len(self.text) else np.empty(0, dtype=np.int64)
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(self.text, minlength=size + 1))])

    def _bound(self, low: np.ndarray, high: np.ndarray, depth: int, word: np.ndarray, over: bool) -> np.ndarray:
        """First place of each range whose word at ``depth`` is not under (with ``over``: is over) the wanted one."""
        low, high = low.copy(), high.copy()
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) >> 1
            there = self.text[self.order[middle] + depth]
            before = there <= word[open_] if over else there < word[open_]
            low[open_] = np.where(before, middle + 1, low[open_])
            high[open_] = np.where(before, high[open_], middle)
            open_ = open_[low[open_] < high[open_]]
        return low

    def search(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of every suffix of the block: the range of the array that goes on alike to its window's depth (empty without a
        match), the words of its longest match, and the range that goes on alike so far."""
        words, count = self.of_vocabulary[block.code], len(block.code)
        low, high = self.begin[words], self.begin[words + 1]
        at_window, at_longest = np.zeros((2, count), dtype=np.int64), np.zeros((2, count), dtype=np.int64)
        longest = np.zeros(count, dtype=np.int64)
        now, depth = np.flatnonzero(low < high), 1
        low, high = low[now], high[now]
        while len(now):
            longest[now], at_longest[0, now], at_longest[1, now] = depth, low, high
            at = block.depth[now] == depth
            at_window[0, now[at]], at_window[1, now[at]] = low[at], high[at]
            more = block.left[now] > depth
            now, low, high = now[more], low[more], high[more]
            word = words[now + depth]
            low, high = self._bound(low, high, depth, word, False), self._bound(low, high, depth, word, True)
            alive = low < high
            now, low, high = now[alive], low[alive], high[alive]
            depth += 1
        return *at_window, longest, *at_longest

    def places(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All places in ranges of the array: number of the range, document, and word of the document."""
        size = high - low
        which = np.repeat(np.arange(len(size)), size)
        at = self.order[np.arange(len(which)) + np.repeat(low - (np.cumsum(size) - size), size)]
        doc = np.searchsorted(self.start, at, "right") - 1
        return which, doc, at - self.start[doc]


class Block:
    """Items of a benchmark: the words of all their suffixes, and of every different window the items that hold it."""

    def __init__(self, rows: list[tuple[str | None, str | None]], words: int) -> None:
        self.ids = [i for i, _ in rows]
        hashes, first = item_words([t for _, t in rows])
        self.vocabulary, self.code = np.unique(hashes, return_inverse=True)
        sizes = np.diff(first)
        self.item = np.repeat(np.arange(len(sizes)), sizes)
        self.start = np.arange(len(hashes)) - np.repeat(first[:-1], sizes)
        self.left = np.repeat(first[1:], sizes) - np.arange(len(hashes))
        whole = (self.start == 0) & (self.left < words)
        #: Words of the window that begins with a suffix; 0 where none does.
        self.depth = np.where(self.left >= words, words, np.where(whole, self.left, 0))
        # different windows are told apart by a hash of their words; one suffix stands for each
        with np.errstate(over="ignore"):
            padded = np.concatenate([hashes, np.zeros(words, dtype=np.uint64)])
            key = mix64(self.depth.astype(np.uint64))
            for j in range(words):
                key = mix64(key + np.where(j < self.depth, padded[j : j + len(hashes)], np.uint64(0)))
        has = np.flatnonzero(self.depth)
        _, chosen, of = np.unique(key[has], return_index=True, return_inverse=True)
        self.window = np.full(len(hashes), -1, dtype=np.int64)
        self.window[has[chosen]] = np.arange(len(chosen))
        pairs = np.unique(np.stack([of, self.item[has]], axis=1), axis=0) if len(has) else np.empty((0, 2), dtype=np.int64)
        self.items = pairs[:, 1]
        self.items_from = np.searchsorted(pairs[:, 0], np.arange(len(chosen) + 1))


def benchmark_blocks(benchmark: DataFrame, words: int, block_bytes: int) -> Iterator[Block]:
    """The benchmark in blocks of about ``block_bytes``; only one is on the driver at a time. No item: one empty block."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 if total <= block_bytes else 2 * total // block_bytes + 1
    for k in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        yield Block([(r["item_id"], r["text"]) for r in part.collect()], words)


def _distinct(texts: list[str | None]) -> tuple[list[str | None], np.ndarray]:
    """Different texts, and which of them each text is: copies in a shard are searched once."""
    seen: dict[str | None, int] = {}
    of = np.array([seen.setdefault(t or None, len(seen)) for t in texts], dtype=np.int64)
    return list(seen), of


def _union(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Ranges joined where they overlap or touch, as rows (start, end), ascending."""
    if not len(start):
        return np.empty((0, 2), dtype=np.int64)
    by = np.argsort(start, kind="stable")
    start, end = start[by], np.maximum.accumulate(end[by])
    first = np.append(True, start[1:] > end[:-1])
    return np.stack([start[first], end[np.append(first[1:], True)]], axis=1)


def _hits(texts: list[str | None], block: Block) -> tuple[list[np.ndarray], list[set[str]], np.ndarray]:
    """Of each text: ranges of hit words, ids of the items whose windows occur, and the number of words."""
    hashes, first = item_words(texts)
    shard = Shard(hashes, first, block.vocabulary)
    low, high, *_ = shard.search(block)
    hit = np.flatnonzero((block.window >= 0) & (low < high))
    which, doc, place = shard.places(low[hit], high[hit])
    by = np.argsort(doc, kind="stable")
    suffix, place = hit[which[by]], place[by]
    edges = np.searchsorted(doc[by], np.arange(len(texts) + 1))
    spans, items = [], []
    for d in range(len(texts)):
        s, p = suffix[edges[d] : edges[d + 1]], place[edges[d] : edges[d + 1]]
        spans.append(_union(p, p + block.depth[s]))
        held = [block.items[block.items_from[w] : block.items_from[w + 1]] for w in np.unique(block.window[s])]
        items.append({block.ids[i] for i in np.unique(np.concatenate(held))} - {None} if held else set())
    return spans, items, np.diff(first)


def _pass(docs: DataFrame, columns: list[str], block: Block) -> DataFrame:
    """Add what the block's windows hit in each document to the four ``columns`` (see ``mark``), which the first pass makes."""
    spans, items, n_hit, n_words = columns
    shared = docs.sparkSession.sparkContext.broadcast(block)
    fields = [f for f in docs.schema if f.name not in columns]
    schema = T.StructType([*fields, T.StructField(spans, T.BinaryType()), T.StructField(items, T.ArrayType(T.StringType())),
                           T.StructField(n_hit, T.LongType()), T.StructField(n_words, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            column = dict(zip(batch.schema.names, batch.columns, strict=True))
            texts, of = _distinct(column["text"].cast(pa.string()).to_pylist())
            found, held, words = _hits(texts, shared.value)
            if spans in column:
                before = [np.frombuffer(x, dtype=np.int64).reshape(-1, 2) for x in column[spans].to_pylist()]
                ranges = [_union(*np.concatenate([x, found[d]]).T) for x, d in zip(before, of, strict=True)]
                ids = [sorted(held[d].union(x)) for x, d in zip(column[items].to_pylist(), of, strict=True)]
            else:
                ranges, ids = [found[d] for d in of], [sorted(held[d]) for d in of]
            made = [
                pa.array([x.tobytes() for x in ranges], pa.binary()), pa.array(ids, pa.list_(pa.string())),
                pa.array([int((x[:, 1] - x[:, 0]).sum()) for x in ranges], pa.int64()), pa.array(words[of], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays([*(column[f.name] for f in fields), *made], names=schema.names)

    return map_arrow(docs, run, schema)


def mark(docs: DataFrame, benchmark: DataFrame, words: int = WINDOW, block_bytes: int = BENCHMARK_BYTES) -> tuple[DataFrame, list[str]]:
    """``docs`` with four columns more, whose names follow: ranges of hit words (binary, pairs of 64-bit integers), ids of the
    items found (ascending, null left out), numbers of hit words and of words."""
    columns = [unused(docs.columns, x) for x in ("hit_ranges", "items", "n_hit", "n_words")]
    marked = None
    for block in benchmark_blocks(benchmark, words, block_bytes):
        # a table between two passes, so that a task holds one block at a time
        marked = _pass(docs if marked is None else write_shared(marked, "marked"), columns, block)
    return marked, columns


def contamination(docs: DataFrame, benchmark: DataFrame, words: int = WINDOW, block_bytes: int = BENCHMARK_BYTES) -> DataFrame:
    """One row for each document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``.

    ``items_sha256`` is the digest of the item ids, sorted as strings and joined by commas (of nothing without an item). A null
    text has no words; a null item id hits words but is no item; an item id that repeats counts once. Null doc_ids and
    repeated rows are kept. Other columns are ignored. Empty tables give no row, or rows without a hit.
    """
    two = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows, (_, items, n_hit, n_words) = mark(two, benchmark, words, block_bytes)
    return rows.select(
        "doc_id", F.col(n_words).alias("n_words"), F.col(n_hit).alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.col(n_hit) > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, words: int = WINDOW, block_bytes: int = BENCHMARK_BYTES) -> DataFrame:
    """``docs`` without the documents that hold a window of the benchmark; all columns stay, whatever their names."""
    names = docs.columns
    plain = docs.toDF(*("text" if c == "text" else f"column_{i}" for i, c in enumerate(names)))  # a name may hold a dot
    rows, (_, _, n_hit, _) = mark(plain, benchmark, words, block_bytes)
    return rows.where(F.col(n_hit) == 0).select(*plain.columns).toDF(*names)


def longest_matches(docs: DataFrame, benchmark: DataFrame, least: int = WINDOW, block_bytes: int = BENCHMARK_BYTES) -> DataFrame:
    """Each item's longest verbatim match of at least ``least`` words: ``item_id, item_start, n_words, doc_id, doc_start``.

    Starts are counted in words from 0. Of matches equally long the smallest doc_id (null last), doc_start and item_start are
    named. Rows of one item_id (also null) count as one item; items without such a match have no row.
    """
    two = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for block in benchmark_blocks(benchmark, WINDOW, block_bytes):
        part = _best_places(two, block, least)
        out = part if out is None else out.unionByName(part)
    order = F.struct(-F.col("n_words"), F.col("doc_id").isNull(), "doc_id", "doc_start", "item_start")
    best = out.groupBy("item_id").agg(F.min_by(F.struct("item_start", "n_words", "doc_id", "doc_start"), order).alias("b"))
    return best.select("item_id", "b.*")


def _best_places(docs: DataFrame, block: Block, least: int) -> DataFrame:
    """Each item's best place in each shard."""
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        for batch in slices(batches):
            ids = np.array([1 << 63 if i is None else i for i in batch.column(0).to_pylist()], dtype=object)
            hashes, first = item_words(batch.column(1).to_pylist())
            shard = Shard(hashes, first, b.vocabulary)
            _, _, longest, low, high = shard.search(b)
            top = np.zeros(len(b.ids), dtype=np.int64)
            np.maximum.at(top, b.item, longest)
            at = np.flatnonzero((longest >= least) & (longest == top[b.item]))
            which, doc, place = shard.places(low[at], high[at])
            rows: dict[int, tuple] = {}
            for s, d, p in zip(at[which].tolist(), doc.tolist(), place.tolist(), strict=True):
                new = (ids[d], p, int(b.start[s]), int(longest[s]))
                item = int(b.item[s])
                rows[item] = min(rows.get(item, new), new)
            yield pa.RecordBatch.from_pylist(
                [{"item_id": b.ids[i], "item_start": s, "n_words": n, "doc_id": None if d == 1 << 63 else d, "doc_start": p} for i, (d, p, s, n) in rows.items()],
                schema=pa.schema([("item_id", pa.string()), ("item_start", pa.int64()), ("n_words", pa.int64()), ("doc_id", pa.int64()), ("doc_start", pa.int64())]),
            )

    return map_arrow(docs, run, "item_id string, item_start long, n_words long, doc_id long, doc_start long")


def oracle(words: int = WINDOW) -> str:
    """``contamination`` in DuckDB: word lists, their runs of each window's length, and an equi-join on the runs."""
    split = f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^{NO_WORD}]+')"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {split} AS w FROM documents),
  b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {split} AS w FROM benchmark),
  win AS (SELECT item_id, least(len(w), {words}) AS k, unnest([array_to_string(w[i:i + least(len(w), {words}) - 1], ' ') for i in range(1, len(w) - least(len(w), {words}) + 2)]) AS g FROM b WHERE len(w) > 0),
  lens AS (SELECT DISTINCT k FROM win),
  runs AS (SELECT r, k, unnest(range(1, len(w) - k + 2)) AS p, unnest([array_to_string(w[i:i + k - 1], ' ') for i in range(1, len(w) - k + 2)]) AS g FROM d, lens WHERE len(w) >= k),
  hit AS (SELECT DISTINCT r, item_id, runs.k, p FROM runs JOIN win ON runs.k = win.k AND runs.g = win.g),
  words AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS x FROM hit) GROUP BY r),
  items AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT r, item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
  FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)"""
