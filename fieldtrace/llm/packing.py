"""Packing of token sequences into fixed windows by the online sum-of-squares rule.

A document's ids (its tokens and a closing id) are cut into whole windows and a remainder. A remainder goes to the fill
level that minimises the sum over levels of squared counts of partially filled windows; the counts are an array indexed
by level. A level is LEVEL ids wide, and a piece takes whole levels: the finer the levels, the more windows must be open before
pieces find fitting ones, the coarser, the more padding (under LEVEL ids for each piece of a window). Packing runs inside the task that reads the text, so texts and closed windows are never shuffled. Windows still
open when a task ends are carried on: their pieces meet in a few tasks, where the same rule packs them. Only what is open
after that is emptied into full windows by cutting, which leaves one short window for each of these few tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, slices, write_shared
from .wordcache import CACHE_WORDS, WordEncoder

WINDOW = 2048
#: Id that closes every document.
CLOSING_ID = 1
#: Ids of a fill level. 8: about 0.35 % padding, and a third of the open windows that single ids as levels need.
LEVEL = 8
#: Open windows that a task holds in memory. A reading task that has more carries them on; a task of the second pass empties them
#: by cutting. No window is closed unfilled for it.
HELD_WINDOWS = 8192
#: Carried pieces that one task of the second pass takes.
CARRIED_PIECES = 8192


class SumOfSquaresPacker:
    """Online packer. ``add`` takes one document's ids (or a piece of them) and yields closed windows; ``carry`` and ``finish`` yield the rest.

    A window is a list of pieces ``(doc, start, ids, doc_tokens)``, laid out in order from offset 0.
    """

    def __init__(self, window: int = WINDOW, level: int = 1) -> None:
        self.window, self.level, self.levels = window, level, window // level
        self.clear()

    def clear(self) -> None:
        self.counts = np.zeros(self.levels + 1, dtype=np.int64)  # the level array: open windows at each fill level
        self.open: list[list[list]] = [[] for _ in range(self.levels + 1)]
        self.opened = 0

    def choose(self, size: int) -> int:
        """Level to place a piece of ``size`` levels at (0: a new window), by the least change of the sum of squares; ties: the fullest."""
        top = self.levels - size
        now, after = self.counts[1 : top + 1], self.counts[1 + size : self.levels + 1]
        change = 2 * (after - now) + 2  # level h loses one, level h + size gains one
        change[now == 0] = np.iinfo(np.int64).max
        if top > 0:
            if self.counts[top]:
                change[top - 1] = 1 - 2 * self.counts[top]  # the window becomes full and leaves the array
            best = int(top - 1 - np.argmin(change[::-1]))
            fresh = 2 * self.counts[size] + 1
            if change[best] <= fresh:
                return best + 1
        return 0

    def add(self, doc: object, ids: np.ndarray, start: int = 0, total: int | None = None) -> Iterator[list]:
        total, at, end = len(ids) if total is None else total, 0, len(ids)
        while end - at >= self.window:
            yield [(doc, start + at, ids[at : at + self.window], total)]
            at += self.window
        if at == end:
            return
        size = -(-(end - at) // self.level)
        level = self.choose(size)
        bin_ = self.open[level].pop() if level else []
        if level:
            self.counts[level] -= 1
        else:
            self.opened += 1
        bin_.append((doc, start + at, ids[at:].copy(), total))  # not a view, which would hold a block's ids
        if level + size == self.levels:
            self.opened -= 1
            yield bin_
            return
        self.open[level + size].append(bin_)
        self.counts[level + size] += 1

    def carry(self) -> Iterator[list]:
        """The open windows as they are, fullest first."""
        bins = [b for level in range(self.levels, 0, -1) for b in self.open[level]]
        self.clear()
        yield from bins

    def finish(self) -> Iterator[list]:
        """Empty the open windows: keep the fullest and fill each from the emptiest, cutting freely."""
        bins = list(self.carry())
        low, spare = len(bins) - 1, []
        for i, bin_ in enumerate(bins):
            if i > low and not spare:
                break
            room = self.window - sum(len(p[2]) for p in bin_) if i <= low else self.window
            out = list(bin_) if i <= low else []
            while room and (spare or low > i):
                if not spare:
                    spare = list(bins[low])
                    low -= 1
                doc, start, ids, total = spare.pop(0)
                if len(ids) > room:
                    spare.insert(0, (doc, start + room, ids[room:], total))
                    ids = ids[:room]
                out.append((doc, start, ids, total))
                room -= len(ids)
            if out:
                yield out
        if spare:
            yield spare


def _rows(windows: Iterator[list], at: list[int], ids_of: bool, opened: bool) -> Iterator[tuple]:
    for pieces in windows:
        offset = 0
        for doc, start, ids, total in pieces:
            yield doc, start, len(ids), zlib.crc32(ids.tobytes()), total, at[0], offset, ids.astype(np.int32) if ids_of else None, opened
            offset += len(ids)
        at[0] += 1


_COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>, open boolean"
_TYPES = [*[pa.int64()] * 7, pa.list_(pa.int32()), pa.bool_()]
_NAMES = [c.split()[0] for c in _COLUMNS.split(", ")]


def _tables(rows: Iterator[tuple], size: int = 1000) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for row in rows:
        out.append(row)
        if len(out) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)], names=_NAMES)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)], names=_NAMES)


def pack_documents(
    docs: DataFrame, tokenizer_path: str, window: int = WINDOW, closing_id: int = CLOSING_ID, with_ids: bool = True, cache_words: int = CACHE_WORDS,
    held_windows: int = HELD_WINDOWS, carried_pieces: int = CARRIED_PIECES, level: int = LEVEL,
) -> DataFrame:
    """Pack whole texts -> one row per piece.

    -> ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, by_rule`` and, with ``with_ids``, ``ids array<int>``.
    A ``window`` is a multiple of ``level``. ``by_rule`` is false in windows that were emptied by cutting at the end. Null and empty texts hold only the closing id. Rows
    repeating an id are packed each on its own; a null id is kept. Every id lies in one piece; pieces fill a sequence from
    offset 0 without gaps. Sequence ids are unique (task number times 2**33 plus a counter, the second pass from 2**62 on).
    Other columns are ignored. An empty table gives no piece. ``cache_words`` bounds a worker's memory of words,
    ``held_windows`` its open windows; neither changes what a document's ids are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = WordEncoder.shared(tokenizer_path, cache_words)
        packer, at = SumOfSquaresPacker(window, level), [TaskContext.get().partitionId() << 33]
        closing = np.array([closing_id], dtype=np.uint32)

        def rows() -> Iterator[tuple]:
            for batch in slices(batches):
                for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode_arrays(batch.column(1).to_pylist()), strict=True):
                    yield from _rows(packer.add(doc, np.concatenate([ids, closing])), at, with_ids, False)
                    if packer.opened > held_windows:
                        yield from _rows(packer.carry(), at, True, True)
            yield from _rows(packer.carry(), at, True, True)

        yield from _tables(rows())

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer, at = SumOfSquaresPacker(window, level), [(1 << 62) + (TaskContext.get().partitionId() << 33)]

        def rows() -> Iterator[tuple]:
            for batch in slices(batches):
                lists = batch.column(batch.schema.get_field_index("ids"))
                for i, (doc, start, total) in enumerate(zip(*(batch.column(_NAMES.index(c)).to_pylist() for c in ("doc_id", "start", "doc_tokens")), strict=True)):
                    ids = lists[i].values.to_numpy(zero_copy_only=False).astype(np.uint32)
                    yield from _rows(packer.add(doc, ids, start, total), at, with_ids, False)
                    if packer.opened > held_windows:
                        yield from _rows(packer.finish(), at, with_ids, True)
            yield from _rows(packer.finish(), at, with_ids, True)

        yield from _tables(rows())

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    packed = write_shared(map_arrow(texts, run, _COLUMNS), "packed")
    carried = packed.where("open")
    parts = -(-carried.count() // carried_pieces)
    done = packed.where("not open")
    if parts:
        # whole open windows are dealt by their unique ids, so no document or hot row gathers in one task
        carried = carried.repartition(parts, F.xxhash64("sequence_id")).sortWithinPartitions("sequence_id", "offset")
        done = done.unionByName(map_arrow(carried, again, _COLUMNS))
    names = [c for c in _NAMES if c not in ("open", "ids")]
    return done.select(*names, (~F.col("open")).alias("by_rule"), *["ids"] * with_ids)
