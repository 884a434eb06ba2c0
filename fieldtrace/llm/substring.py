"""Substring dedup by sliding sentence spans.

A text is cut into sentences, and a sentence of more than PIECE words into pieces at places that the words around them
choose (winnowing), so that a passage is cut alike wherever it stands. From every piece a span of several consecutive pieces
runs forward, and another backward, just long enough to hold MIN_WORDS words; each is hashed. A hash found more than once
keeps its first place (by id, text, position); pieces covered by any other place are removed.

Of the places of a hash that one task finds, only the first can be the first of all; the others are repeats for sure, and do not
travel under the hash. So a passage of any number of copies brings a few rows from each task to the task of its hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _powers, map_arrow, mix64, slices, text_blocks, unused

#: Sentences (or pieces of them) and words that a span holds at least.
MIN_SENTENCES, MIN_WORDS = 2, 26
#: Words that a piece of a sentence holds at most. A repeated passage of MIN_WORDS + 3 * PIECE words or more holds a span
#: wherever it begins and ends, and at most PIECE words at either of its ends escape. A power of two.
PIECE = 8
#: Spans that a task holds before it hands them on.
HELD_SPANS = 200_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_MARK, _CLOSER = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_MARK[list(b".!?")] = True
_CLOSER[[*b"\"')]", 0xBB, 0x9D]] = True


class Pieces:
    """Words and pieces of a block of texts, as arrays over the texts' UTF-8 bytes.

    ``sums`` are prefix sums of the words' hashes (two kinds), ``first`` the first word of each piece and one more entry,
    ``of`` the first piece of each text and one more, ``stop`` where each piece ends in its text's bytes. A sentence ends at
    a line end, at marks followed by white space, and at CJK marks. Ends inside a word (3.14) do not count. A CJK character is
    a word of its own. Stretches without a word join the piece before; pieces cover the text without gaps.
    """

    def __init__(self, texts: list[str | None]) -> None:
        self.raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
        base = np.zeros(len(self.raw) + 1, dtype=np.int64)
        np.cumsum(np.fromiter(map(len, self.raw), dtype=np.int64, count=len(self.raw)) + 1, out=base[1:])
        buf = np.frombuffer(b"\n".join([*self.raw, b""]), dtype=np.uint8)
        white = _WHITE[buf]
        turn = np.empty(len(buf), dtype=bool)
        turn[:1] = True
        np.not_equal(white[1:], white[:-1], out=turn[1:])
        big = np.flatnonzero(buf >= 0xE3)
        big = big[(buf[big] <= 0xE9) | ((buf[big] == 0xEF) & (buf[np.minimum(big + 1, len(buf) - 1)] == 0xBC) & np.isin(buf[np.minimum(big + 2, len(buf) - 1)], (0x81, 0x9F)))]
        turn[big] = turn[big + 3] = True  # CJK characters are of three bytes, and a line end follows the last
        edges = np.flatnonzero(turn)
        solid = ~white[edges]
        self.starts = starts = edges[solid]
        self.ends = ends = np.append(edges, len(buf))[1:][solid]
        n = len(starts)
        up, down = _powers(len(buf) + 1)
        words = np.searchsorted(starts, base)  # first word of each text
        with np.errstate(over="ignore"):
            total = np.zeros(len(buf) + 1, dtype=np.uint64)
            np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=total[1:])
            h = mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            self.down, self.sums = down, []
            for k in (h, mix64(h + _ODD)):
                total = np.zeros(n + 1, dtype=np.uint64)
                np.cumsum(k * up[:n], out=total[1:])
                self.sums.append(total)
        # the last line end in the gap after a word, or -1
        lines = np.append(-1, np.flatnonzero(buf == 10))
        after = np.append(starts[1:], len(buf))
        line = lines[np.searchsorted(lines, after) - 1]
        line[line < ends] = -1
        over = (line >= 0) | self._marked(buf, white)
        over[words[1:][words[1:] > 0] - 1] = True
        cuts = self._winnow(h, over)
        self.first = np.append(np.flatnonzero(cuts), n)
        self.of = np.searchsorted(self.first[:-1], words)
        last = self.first[1:] - 1
        stop = np.where(line[last] >= 0, line[last] + 1, ends[last])
        text = np.repeat(np.arange(len(self.raw)), np.diff(self.of))
        self.stop = stop - base[text]
        full = np.flatnonzero(np.diff(self.of))
        self.stop[self.of[full + 1] - 1] = (base[1:] - base[:-1] - 1)[full]

    def _marked(self, buf: np.ndarray, white: np.ndarray) -> np.ndarray:
        """Whether a word ends a sentence by its marks."""
        starts, at = self.starts, self.ends - 1
        look = np.flatnonzero(_CLOSER[buf[at]])
        while len(look):
            b = at[look]
            long = np.where(buf[b] == 0xBB, 2, np.where(buf[b] == 0x9D, 3, 1))
            ok = (long == 1) | ((long == 2) & (buf[b - 1] == 0xC2)) | ((long == 3) & (buf[b - 1] == 0x80) & (buf[b - 2] == 0xE2))
            ok &= b - long >= starts[look]
            look, b = look[ok], b[ok] - long[ok]
            at[look] = b
            look = look[_CLOSER[buf[b]]]
        e = np.minimum(self.ends, len(buf) - 1)
        western = _MARK[buf[at]] & white[e]
        three = np.flatnonzero(self.ends - starts == 3)
        s = starts[three]
        a, b, c = buf[s], buf[s + 1], buf[s + 2]
        western[three] |= ((a == 0xE3) & (b == 0x80) & (c == 0x82)) | ((a == 0xEF) & (b == 0xBC) & ((c == 0x81) | (c == 0x9F)))
        return western

    @staticmethod
    def _winnow(h: np.ndarray, over: np.ndarray) -> np.ndarray:
        """Whether a piece begins at a word: after a sentence's end, and at the least hash of two neighbours in any PIECE places of a sentence."""
        n = len(h)
        cuts = np.zeros(n, dtype=bool)
        if n:
            cuts[0] = True
            cuts[1:] = over[:-1]
        if n > PIECE:
            sentence = np.cumsum(cuts)
            with np.errstate(over="ignore"):
                key = mix64(h[:-1] * _ODD + h[1:])  # key i: the place between words i and i + 1
            key |= np.uint64(1)
            low = np.where(sentence[: n - PIECE] == sentence[PIECE:], _slide(key, np.minimum), np.uint64(0))
            pad = np.zeros(PIECE - 1, dtype=np.uint64)
            cuts[1:] |= _slide(np.concatenate([pad, low, pad]), np.maximum) == key
        return cuts

    def hashes(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """64 and 32 bits of hash of the words from piece ``first`` to piece ``last``."""
        a, b = self.first[first], self.first[last + 1]
        with np.errstate(over="ignore"):
            size = (b - a).astype(np.uint64) * _ODD
            h, g = (mix64((s[b] - s[a]) * self.down[a] + size) for s in self.sums)
        return h.view(np.int64), (g >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _slide(x: np.ndarray, least: np.ufunc) -> np.ndarray:
    """Least (or greatest) of every PIECE neighbours."""
    step = 1
    while step < PIECE:
        x = least(x[:-step], x[step:])
        step *= 2
    return x


def sentences(text: str) -> list[tuple[int, int, str, int]]:
    """``(begin, end, normalised words, count)`` of the pieces of one text, in order; begin and end cover the text without gaps."""
    p = Pieces([text])
    raw, out, begin, at = p.raw[0], [], 0, 0
    for i, stop in enumerate(p.stop.tolist()):
        end = at + len(raw[begin:stop].decode("utf-8", "surrogatepass"))
        a, b = int(p.first[i]), int(p.first[i + 1])
        words = [raw[x:y].decode("utf-8", "surrogatepass") for x, y in zip(p.starts[a:b], p.ends[a:b], strict=True)]
        out.append((at, end, " ".join(words), b - a))
        begin, at = stop, end
    return out


def _spans(first: np.ndarray, of: np.ndarray, min_sentences: int, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last piece of every forward and backward span, each once; ``first`` and ``of`` as in Pieces."""
    n = len(first) - 1
    i = np.arange(n)
    text = np.repeat(np.arange(len(of) - 1), np.diff(of))
    last = np.maximum(np.searchsorted(first, first[:-1] + min_words) - 1, i + min_sentences - 1)
    back = np.minimum(np.searchsorted(first, first[1:] - min_words, side="right") - 1, i - min_sentences + 1)
    forth, return_ = last < of[1:][text], back >= of[:-1][text]
    key = np.unique(np.concatenate([i[forth] * n + last[forth], back[return_] * n + i[return_]]))
    return key // max(n, 1), key % max(n, 1)


def spans(parts: list[tuple[int, int, str, int]], min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> list[tuple[int, int]]:
    """``(first, last)`` sentence of every forward and backward span, each once."""
    total = np.concatenate([[0], np.cumsum([p[3] for p in parts], dtype=np.int64)]).astype(np.int64)
    first, last = _spans(total, np.array([0, len(parts)]), min_sentences, min_words)
    return list(zip(first.tolist(), last.tolist(), strict=True))


#: A place is one long, ordered by text and position: 32 bits of the text's key, 25 of the first piece's number, 7 of the pieces after it.
FIRST_BITS, MORE_BITS = 25, 7


def _combine(doc: np.ndarray, place: np.ndarray, h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places to hand on, and which of them are repeats for sure: all but the first of a hash. A place met twice counts once."""
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    many = np.zeros(len(h), dtype=bool)
    many[order[1:][same]] = many[order[:-1][same]] = True
    kept, sure = ~many, np.zeros(len(h), dtype=bool)
    rows = np.flatnonzero(many)
    rows = rows[np.lexsort([x[rows] for x in (place, doc, g, h)])]
    if len(rows):
        new, other = np.ones(len(rows), dtype=bool), np.ones(len(rows), dtype=bool)
        new[1:] = (h[rows][1:] != h[rows][:-1]) | (g[rows][1:] != g[rows][:-1])
        other[1:] = (doc[rows][1:] != doc[rows][:-1]) | (place[rows][1:] != place[rows][:-1])
        kept[rows] = new | other
        sure[rows] = ~new
    kept = np.flatnonzero(kept)
    return kept, sure[kept]


def _span_rows(docs: DataFrame, min_sentences: int, min_words: int) -> DataFrame:
    if not max(min_sentences, min_words) < 1 << MORE_BITS:
        raise ValueError(f"spans of up to {(1 << MORE_BITS) - 1} sentences or words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def hand_on() -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            held.clear()
            kept, sure = _combine(*columns)
            doc, place, h, g = (c[kept] for c in columns)
            with np.errstate(over="ignore"):  # a sure repeat goes anywhere: it needs no company
                away = mix64(place.view(np.uint64) + doc.view(np.uint64) * _ODD).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(place), pa.array(np.where(sure, away, h)), pa.array(g, mask=sure)], names=["doc_id", "place", "h", "g"])

        for batch in slices(batches):
            docs, keys, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            for a, b in text_blocks(texts):
                p = Pieces(texts[a:b])
                if len(p.of) > 1 and np.diff(p.of).max() >= 1 << FIRST_BITS:
                    raise ValueError(f"a text of {1 << FIRST_BITS} pieces or more")
                first, last = _spans(p.first, p.of, min_sentences, min_words)
                text = np.searchsorted(p.of, first, side="right") - 1
                place = (keys[a:b][text].astype(np.int64) << 32) | ((first - p.of[text]) << MORE_BITS) | (last - first)
                held.append([docs[a:b][text], place, *p.hashes(first, last)])
                if sum(len(c[0]) for c in held) >= HELD_SPANS:
                    yield hand_on()
        if held:
            yield hand_on()

    return map_arrow(docs, run, "doc_id long, place long, h long, g int")


def _text_key(text: Column) -> Column:
    """32 bits that tell the texts of one id apart."""
    return F.shiftright(F.xxhash64(text), 32).cast("int")


def repeated_spans(docs: DataFrame, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, place`` of every repeated span's places but the first."""
    text = F.col("text").cast("string")
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), _text_key(text).alias("key"))
    places = Window.partitionBy("h", "g").orderBy("doc_id", "place")
    # rows repeating an id and its text stand at the same place, which rank counts once; g is null in repeats for sure
    return _span_rows(rows, min_sentences, min_words).withColumn("n", F.rank().over(places)).where("n > 1 or g is null").select("doc_id", "place")


def remove_repeats(docs: DataFrame, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> DataFrame:
    """Rows of ``docs``, all columns kept, with the pieces of sentences under repeated spans taken out of ``text``.

    Adds ``n_sentences`` (pieces), ``n_removed`` (pieces taken out) and ``removed_words``. Null texts stay null with zeros; texts of
    one piece cannot hold a span; a text can become empty. Rows with a null id take no part and stay as they are. Rows
    repeating an id and its text are one document: only a repeat at another position is removed, in all of them alike. Rows
    of one id with different texts are documents of their own. Columns of ``docs`` that clash with the added ones are
    replaced, others may have any names. An empty table gives an empty result. A text of 2**25 pieces (over 600 MB) is refused.
    """
    added = ["n_sentences", "n_removed", "removed_words"]
    docs = docs.drop(*added)
    names = docs.columns
    doc, key, covers = (unused(names, x) for x in ("doc", "key", "covers"))
    ranges = repeated_spans(docs, min_sentences, min_words).groupBy(F.col("doc_id").alias(doc), F.shiftright("place", 32).cast("int").alias(key)).agg(F.collect_set(F.col("place").bitwiseAND(F.lit((1 << 32) - 1))).alias(covers))
    same = (F.col("doc_id").cast("long") == F.col(doc)) & (_text_key(F.col("text").cast("string")) == F.col(key))
    joined = docs.join(ranges, same, "left").drop(doc, key)
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, covers = batch.column(at).to_pylist(), batch.column(batch.num_columns - 1)
            sizes, gone, words = [], [], []
            for a, b in text_blocks(texts):
                p = Pieces(texts[a:b])
                sizes.append(np.diff(p.of))
                for i in range(a, b):
                    gone.append(0), words.append(0)
                    if covers[i].is_valid:
                        own = slice(*p.of[i - a : i - a + 2])
                        ranges = covers[i].values.to_numpy()
                        first = ranges >> MORE_BITS
                        depth = np.zeros(own.stop - own.start + 1, dtype=np.int64)
                        np.add.at(depth, first, 1)
                        np.add.at(depth, first + (ranges & ((1 << MORE_BITS) - 1)) + 1, -1)
                        drop = np.cumsum(depth)[:-1] > 0
                        stop = p.stop[own].tolist()
                        gone[-1], words[-1] = int(drop.sum()), int(np.diff(p.first[own.start : own.stop + 1])[drop].sum())
                        texts[i] = b"".join(p.raw[i - a][x:y] for x, y, d in zip([0, *stop[:-1]], stop, drop.tolist(), strict=True) if not d).decode("utf-8", "surrogatepass")
            columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(batch.num_columns - 1)]
            columns += [pa.array(np.concatenate([*sizes, np.empty(0, np.int64)]).astype(np.int64)), pa.array(gone, pa.int64()), pa.array(words, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *added])

    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in docs.schema), *(T.StructField(name, T.LongType()) for name in added)])
    return map_arrow(joined, run, schema)
