"""Cross-tokenizer alignment: which tokens of two tokenizers lie over the same bytes, and how often over a corpus.

Texts are cut into chunks at places where both tokenizers are sure to end a token (before white space, see ``PairEncoder``), so a
chunk's tokens are the same in every text. A task codes its texts by chunk, block by block, and tokenises each different chunk
of a block once. DuckDB holds both tokenizers' tokens of an Arrow batch's new chunks as interval tables on one line of bytes: ASOF
joins find the overlaps, a window sum over common starts numbers the groups, a range join deals links to chunks; at the end
of a block a grouped sum gives its pair counts. Those partial counts are merged by Spark. The corpus-wide counts then come
back to the block of each pair, where a document's sums are sums over its chunks.

Blocks are the unit of all that is held in memory. A pair of tokens has one row in each block, however often it occurs, so
frequent pairs are no hot keys. Nothing that grows with the corpus is collected or broadcast: the broadcast table of best counts
has one row for each id of the second vocabulary.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from typing import ClassVar

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _WS, byte_symbols
from .common import map_arrow, slices, write_shared

#: A block ends with so many characters of text, different chunks, or characters in them.
BLOCK_CHARS, BLOCK_CHUNKS, BLOCK_CHUNK_CHARS = 24 << 20, 300_000, 10 << 20
#: Chunks of one text handed to the libraries.
CALL_CHUNKS = 2_000
#: Tokens of the first tokenizer that DuckDB gets at once: a longer line is cut where both tokenizers begin a token.
PIECE_TOKENS = 1 << 20
#: Documents handed on at once.
HANDED_DOCS = 1_000
#: The space mark of the second tokenizer's pieces (a fixed value).
MARK = "▁"
_STORED = "kind int, block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes binary, sizes binary, at int, a int, b int, n long"
_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_DOC, _CHUNKS, _PAIR = 0, 1, 2


class PairEncoder:
    """Both tokenizers, the bytes of their tokens, and the places where a text may be cut for both.

    The first is a byte-level BPE of the tokenizers library whose pre-tokens never go over the start of a run of white space; it
    reads a space and the text. The second is a sentencepiece model that adds that space itself. A white-space character is safe
    if no piece of the second holds it behind another character. A text is cut before a safe one that follows no white space.
    """

    _loaded: ClassVar[dict[tuple[str, str], PairEncoder]] = {}

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        symbols = byte_symbols()
        names = {i: bytes(symbols[c] for c in t) for t, i in spec["model"]["vocab"].items() if all(c in symbols for c in t)}
        self.bytes_a = [names.get(i, b"") for i in range(max(names) + 1)]
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        plain = [p for i, p in enumerate(pieces) if not self.b.is_byte(i)]
        inner = {c for p in plain for before, c in zip(p, p[1:], strict=False) if not (c == MARK == before)}
        self.space_id = pieces.index(MARK)
        safe = [c for c in _WS if (MARK if c == " " else c) not in inner]
        unsafe = "".join(c for c in _WS if c not in safe)
        go_on = f"(?:[{unsafe}][{_WS}]*)?" if unsafe else ""
        # without a safe space the joint chunk is the whole text
        self.chunk = re.compile(f"[{_WS}]*(?:[^{_WS}]+{go_on})+|[{_WS}]+" if " " in safe else r"(?s:.+)")
        self.inside = re.compile(f"[{''.join(safe)}].*[^{_WS}]", re.DOTALL)
        self.length_a = np.array([len(x) for x in self.bytes_a], dtype=np.int64)
        self.length_b = np.array([len(x) for x in self.bytes_b], dtype=np.int64)
        self.blob_a, self.blob_b = (np.frombuffer(b"".join(x), dtype=np.uint8) for x in (self.bytes_a, self.bytes_b))

    @classmethod
    def shared(cls, path_a: str, path_b: str) -> PairEncoder:
        key = path_a, path_b
        if key not in cls._loaded:
            cls._loaded[key] = cls(*key)
        return cls._loaded[key]

    def whole(self, text: str) -> tuple[list[int], list[int]] | None:
        """Ids of a space and the text; None if the second tokenizer's bytes (or the first's) differ from it."""
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text, num_threads=1)
        want = (" " + text).encode()
        if b"".join(self.bytes_a[i] for i in a) != want or b"".join(self.bytes_b[i] for i in b) != want:
            return None
        return a, b

    def _alone(self, chunk: str) -> tuple[list[int], list[int]] | None:
        """Ids of one chunk: of a text that it begins, or of one that it does not begin (then without the added space)."""
        if chunk.startswith(" "):
            return self.whole(chunk[1:])
        a, b = self.a.encode(chunk, add_special_tokens=False).ids, self.b.encode(chunk, num_threads=1)
        want = chunk.encode()
        if b[:1] != [self.space_id] or b"".join(self.bytes_a[i] for i in a) != want or b"".join(self.bytes_b[i] for i in b[1:]) != want:
            return None
        return a, b[1:]

    def encode_chunks(self, chunks: list[str]) -> Tokens:
        """Tokens of each chunk by both tokenizers; a chunk is ``odd`` where a text that holds it must be encoded whole.

        Chunks that may stand inside a text are joined to long texts, behind a chunk that is dropped again; a chunk's tokens
        are those between its first and last byte.
        """
        out = Tokens(len(chunks))
        inside = np.array([self.inside.fullmatch(c) is not None and MARK not in c for c in chunks], dtype=bool)
        many, alone = np.flatnonzero(inside), np.flatnonzero(~inside).tolist()
        parts = [many[at : at + CALL_CHUNKS] for at in range(0, len(many), CALL_CHUNKS)]
        texts = [" a" + "".join([chunks[i] for i in part.tolist()]) for part in parts]
        all_a = self.a.encode_batch_fast(texts, add_special_tokens=False) if texts else []
        all_b = self.b.encode([t[1:] for t in texts], num_threads=1) if texts else []
        for part, text, a, b in zip(parts, texts, all_a, all_b, strict=True):
            ids = np.array(a.ids, dtype=np.int64), np.array(b, dtype=np.int64)
            want = text.encode()
            edge = np.cumsum([2, *(len(c) if c.isascii() else len(c.encode()) for c in (chunks[i] for i in part.tolist()))])
            at = _starts(self.length_a[ids[0]]), _starts(self.length_b[ids[1]])
            cut = [np.searchsorted(x, edge) for x in at]
            # a token over a cut, or other bytes: not by these tokenizers' rules
            if self.spell_a(ids[0]) == want == self.spell_b(ids[1]) and all(np.array_equal(x[c], edge) for x, c in zip(at, cut, strict=True)):
                out.put(part, ids[0][cut[0][0] :], np.diff(cut[0]), ids[1][cut[1][0] :], np.diff(cut[1]))
            else:
                alone += part.tolist()
        for i in alone:
            got = None if MARK in chunks[i] else self._alone(chunks[i])
            if got:
                out.put(np.array([i]), np.array(got[0]), np.array([len(got[0])]), np.array(got[1]), np.array([len(got[1])]))
            else:
                out.odd[i] = True
        return out

    def spell_a(self, ids: np.ndarray) -> bytes:
        return _spell(ids, self.blob_a, self.length_a)

    def spell_b(self, ids: np.ndarray) -> bytes:
        return _spell(ids, self.blob_b, self.length_b)


class Tokens:
    """Ids of chunks by both tokenizers, as parts that are put in order at the end."""

    def __init__(self, chunks: int) -> None:
        self.n_a, self.n_b = np.zeros(chunks, dtype=np.int64), np.zeros(chunks, dtype=np.int64)
        self.odd = np.zeros(chunks, dtype=bool)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def put(self, chunks: np.ndarray, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> None:
        self.n_a[chunks], self.n_b[chunks] = n_a, n_b
        self.parts.append((chunks, a, b))

    def flat(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids in the order of chunks."""
        out = []
        for n, which in ((self.n_a, 1), (self.n_b, 2)):
            begin, ids = _starts(n)[:-1], np.empty(int(n.sum()), dtype=np.int64)
            for part in self.parts:
                sizes = n[part[0]]
                ids[np.arange(len(part[which])) + np.repeat(begin[part[0]] - _starts(sizes)[:-1], sizes)] = part[which]
            out.append(ids)
        return out[0], out[1]

    def extend(self, other: Tokens) -> None:
        held = len(self.n_a)
        self.n_a, self.n_b, self.odd = (np.concatenate([x, y]) for x, y in ((self.n_a, other.n_a), (self.n_b, other.n_b), (self.odd, other.odd)))
        self.parts += [(chunks + held, a, b) for chunks, a, b in other.parts]

    def append(self, a: list[int], b: list[int]) -> None:
        other = Tokens(1)
        other.put(np.zeros(1, dtype=np.int64), np.array(a), np.array([len(a)]), np.array(b), np.array([len(b)]))
        self.extend(other)


def _spell(ids: np.ndarray, blob: np.ndarray, lengths: np.ndarray) -> bytes:
    """Bytes of the ids, by one gather from the joint bytes of all tokens."""
    begin, size = _starts(lengths)[ids], lengths[ids]
    ends = np.cumsum(size)
    return blob[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - (ends - size), size)].tobytes()


def _starts(lengths: np.ndarray) -> np.ndarray:
    """Where tokens of these lengths begin, one after the other, and where the last ends."""
    return np.concatenate([[0], np.cumsum(lengths)])


#: Each pair of overlapping tokens once: the second's token in which a token of the first begins, and the first's token in which
#: a token of the second begins later than the first's does.
_LINKS = """CREATE TEMP TABLE links AS
  SELECT a.lo AS lo, a.id AS a, b.id AS b FROM a ASOF JOIN b ON a.lo >= b.lo
  UNION ALL SELECT b.lo AS lo, a.id AS a, b.id AS b FROM b ASOF JOIN a ON b.lo > a.lo WHERE a.hi > b.lo"""
#: Links by chunk: chunks are ranges of the line, and ``lo`` lies in one of them.
_DEALT = "SELECT chunk, a, b FROM links ASOF JOIN chunks ON links.lo >= chunks.lo WHERE links.lo < chunks.hi ORDER BY chunk"
_PAIRS = "SELECT pair, CAST(sum(n) AS BIGINT) AS n FROM rows GROUP BY pair ORDER BY pair"
#: A group begins where both tokenizers begin a token; groups are numbered along the line.
_GROUPS = "SELECT lo, sum(1) OVER (ORDER BY lo ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT a.lo FROM a JOIN b ON a.lo = b.lo) ORDER BY lo"


def _connect() -> duckdb.DuckDBPyConnection:
    return duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})


def _pieces(at_a: np.ndarray, at_b: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of the line of about PIECE_TOKENS tokens, cut where both tokenizers begin a token; one range at least."""
    whole = int(at_a[-1])
    if len(at_a) <= PIECE_TOKENS:
        return [(0, whole)]
    common = np.intersect1d(at_a[:-1], at_b[:-1], assume_unique=True)
    cuts = common[np.minimum(np.searchsorted(common, at_a[PIECE_TOKENS:-1:PIECE_TOKENS]), len(common) - 1)]
    edges = np.unique(np.concatenate([[0], cuts, [whole]])).tolist()
    return list(zip(edges, edges[1:], strict=False))


def _piece(rows: dict[str, pa.Table], low: int, high: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links (chunk, a, b), in the order of chunks, and groups (begin, number from 1 on) of the tokens from ``low`` to ``high``."""
    with _connect() as db:
        for name, table in rows.items():
            lo, hi = table["lo"].to_numpy(), table["hi"].to_numpy()
            part = slice(int(np.searchsorted(hi, low, "right")), int(np.searchsorted(lo, high)))
            db.register(f"{name}_rows", table.slice(part.start, part.stop - part.start))
            db.execute(f"CREATE TEMP TABLE {name} AS SELECT * FROM {name}_rows")
        db.execute(_LINKS)
        return _columns(db, _DEALT, "chunk", "a", "b"), _columns(db, _GROUPS, "lo", "g")


class Alignment:
    """Groups and links of chunks."""

    def __init__(self, tokens: Tokens, encoder: PairEncoder) -> None:
        self.n_a, self.n_b, count = tokens.n_a, tokens.n_b, len(tokens.n_a)
        a, b = tokens.flat()
        at_a, at_b = _starts(encoder.length_a[a]), _starts(encoder.length_b[b])
        edge = at_a[_starts(self.n_a)]
        rows = {"a": pa.table({"id": a, "lo": at_a[:-1], "hi": at_a[1:]}), "b": pa.table({"id": b, "lo": at_b[:-1], "hi": at_b[1:]})}
        rows["chunks"] = pa.table({"chunk": np.arange(count), "lo": edge[:-1], "hi": edge[1:]}).filter(pa.array(self.n_a > 0))
        links, groups, groups_before = [], [], 0
        for low, high in _pieces(at_a, at_b):
            found, (begin, number) = _piece(rows, low, high)
            links.append(found)
            groups.append((begin, number + groups_before))
            groups_before += len(begin)
        chunk, link_a, link_b = (np.concatenate(x) for x in zip(*links, strict=True))
        begin, number = (np.concatenate(x) for x in zip(*groups, strict=True))
        group_a, group_b = (number[np.searchsorted(begin, at[:-1], "right") - 1] for at in (at_a, at_b))
        self.n_links = np.bincount(chunk, minlength=count)
        #: The pair of every link, in the order of chunks.
        self.link = (link_a << 32) | link_b
        # groups do not go over chunks' ends, so a chunk's are those up to its last token less those before
        self.n_groups = np.diff(np.concatenate([[0], group_a])[_starts(self.n_a)])
        self.groups = self._texts(a, b, group_a, group_b)

    def _texts(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> list[bytes]:
        """Of each chunk its groups as ``a1,a2|b1;``."""
        i, j = np.arange(len(a)), np.arange(len(b))
        place_a = i + np.searchsorted(group_b, group_a)  # behind the second's tokens of earlier groups
        place_b = j + np.searchsorted(group_a, group_b, "right")
        ids, marks = np.empty(len(a) + len(b), dtype=np.int64), np.empty(len(a) + len(b), dtype=np.int8)
        ids[place_a], ids[place_b] = a, b
        marks[place_a] = np.append(group_a[1:] != group_a[:-1], True)[: len(a)]
        marks[place_b] = 2 * np.append(group_b[1:] != group_b[:-1], True)[: len(b)]
        joined = pc.binary_join_element_wise(pa.array(ids).cast(pa.large_string()), pa.array([",", "|", ";"], pa.large_string()).take(pa.array(marks)), pa.scalar("", pa.large_string()))
        blob = joined.buffers()[2].to_pybytes() if len(ids) else b""
        ends = np.frombuffer(joined.buffers()[1], dtype=np.int64)[_starts(self.n_a + self.n_b)].tolist() if len(ids) else [0] * (len(self.n_a) + 1)
        return [blob[x:y] for x, y in zip(ends, ends[1:], strict=False)]


def _columns(db: duckdb.DuckDBPyConnection, sql: str, *names: str) -> list[np.ndarray]:
    got = db.execute(sql).fetchnumpy()
    return [np.asarray(got[n], dtype=np.int64) for n in names]


class _Numbers(dict):
    """Running numbers of chunks; ``fresh`` lists those not seen before."""

    def __init__(self) -> None:
        self.fresh: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self.fresh.append(chunk)
        self[chunk] = n = len(self)
        return n


class _Block:
    """Texts coded by chunk until a block is full."""

    def __init__(self, encoder: PairEncoder, block_chars: int) -> None:
        self.encoder, self.block_chars, self.ids, self.codes = encoder, block_chars, [], []
        self.known, self.odd = _Numbers(), np.empty(0, dtype=bool)
        self.aligned: list[Alignment] = []
        self.chars = self.chunk_chars = 0

    def full(self) -> bool:
        return self.chars >= self.block_chars or len(self.known) >= BLOCK_CHUNKS or self.chunk_chars >= BLOCK_CHUNK_CHARS

    def add(self, ids: list[int | None], texts: list[str | None]) -> None:
        number, split = self.known.__getitem__, self.encoder.chunk.findall
        coded = [np.array(list(map(number, split(" " + t))) if t else [], dtype=np.int32) for t in texts]
        fresh, self.known.fresh = self.known.fresh, []
        tokens = self.encoder.encode_chunks(fresh)
        self.chunk_chars += sum(map(len, fresh))
        self.odd = np.concatenate([self.odd, tokens.odd])
        if self.odd.any():
            for i, t in enumerate(texts):
                if self.odd[coded[i]].any():  # the text as one chunk of its own, or without tokens
                    got, number = self.encoder.whole(t), len(self.known)
                    coded[i] = np.array([number] if got else [], dtype=np.int32)
                    if got:
                        self.known[number] = number
                        tokens.append(*got)
                        self.odd = np.append(self.odd, False)
                        self.chunk_chars += len(t)
        self.aligned.append(Alignment(tokens, self.encoder))
        self.ids += ids
        self.codes += coded
        self.chars += sum(map(len, filter(None, texts)))

    def rows(self, number: int) -> Iterator[pa.RecordBatch]:
        n_a, n_b, n_groups, n_links, link = (np.concatenate([getattr(x, name) for x in self.aligned]) for name in ("n_a", "n_b", "n_groups", "n_links", "link"))
        groups = [g for x in self.aligned for g in x.groups]
        self.aligned = []
        uses = np.bincount(np.concatenate(self.codes), minlength=len(self.known))
        with _connect() as db:
            db.register("rows", pa.table({"pair": link, "n": np.repeat(uses, n_links)}))
            pair, count = _columns(db, _PAIRS, "pair", "n")
        n = len(self.ids)
        sums = [_per_text(x, self.codes) for x in (n_a, n_b, n_groups, n_links)]
        digests = [hashlib.sha256(b"".join([groups[c] for c in codes.tolist()])[:-1]).hexdigest() if len(codes) else "" for codes in self.codes]
        for at in range(0, n, HANDED_DOCS):
            own = slice(at, min(n, at + HANDED_DOCS))
            k = own.stop - at
            yield _batch(k, kind=[_DOC] * k, block=[number] * k, doc_id=self.ids[own], n_a=sums[0][own], n_b=sums[1][own], n_groups=sums[2][own],
                         n_links=sums[3][own], groups_sha256=digests[own], codes=[_planes(c) for c in self.codes[own]])
        place = np.searchsorted(pair, link).astype("<i4")  # of every link among the block's pairs
        yield _batch(1, kind=[_CHUNKS], block=[number], codes=[place.tobytes()], sizes=[n_links.astype("<i4").tobytes()])
        yield _batch(len(pair), kind=np.full(len(pair), _PAIR), block=np.full(len(pair), number), at=np.arange(len(pair)), a=pair >> 32, b=pair & 0xFFFFFFFF, n=count)


def _planes(codes: np.ndarray) -> bytes:
    """The low and then the high halves of 32-bit numbers: the high ones are mostly zeros, which compress well."""
    return (codes & 0xFFFF).astype("<u2").tobytes() + (codes >> 16).astype("<u2").tobytes()


def _codes(planes: bytes) -> np.ndarray:
    halves = np.frombuffer(planes, dtype="<u2").astype(np.int64).reshape(2, -1)
    return halves[0] | (halves[1] << 16)


def _per_text(of_chunk: np.ndarray, codes: list[np.ndarray]) -> np.ndarray:
    return np.array([of_chunk[c].sum() for c in codes], dtype=np.int64)


def _batch(rows: int, **given) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    fields = [f.split() for f in _STORED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(given[n], kinds[k]) if n in given else pa.nulls(rows, kinds[k]) for n, k in fields], names=[n for n, _ in fields])


def aligned_blocks(docs: DataFrame, path_a: str, path_b: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows of three kinds for each block: its documents, the links of its chunks, its pairs with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PairEncoder.shared(path_a, path_b)
        number, block = TaskContext.get().partitionId() << 32, _Block(encoder, block_chars)
        for batch in slices(batches):
            block.add(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            if block.full():
                yield from block.rows(number)
                number, block = number + 1, _Block(encoder, block_chars)
        if block.ids:
            yield from block.rows(number)

    two = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(two, run, _STORED)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """``a, b, n_links, best``: how many links of the corpus join two ids, and whether no id of ``a`` has more with that ``b``."""
    counts = write_shared(blocks.where(F.col("kind") == _PAIR).groupBy("a", "b").agg(F.sum("n").alias("n_links")), "pair-counts")
    most = counts.groupBy("b").agg(F.max("n_links").alias("most"))  # a row for each id of a vocabulary at most
    return counts.join(F.broadcast(most), "b").select("a", "b", "n_links", (F.col("n_links") == F.col("most")).alias("best"))


def align_documents(docs: DataFrame, path_a: str, path_b: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``, one row for each input row.

    Texts that are null, empty, or not given back byte for byte by both tokenizers have no tokens: zeros and an empty digest.
    Null ids and repeated rows are kept. Other columns are ignored. An empty table gives an empty result.
    """
    blocks = write_shared(aligned_blocks(docs, path_a, path_b, block_chars), "aligned")
    pairs = blocks.where(F.col("kind") == _PAIR).select("block", "at", "a", "b")
    back = pairs.join(pair_counts(blocks), ["a", "b"]).select(F.col("block").alias("of_block"), "at", "n_links", "best")
    rest = blocks.where(F.col("kind") != _PAIR).select("block", "kind", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "sizes")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        counts, best = np.zeros(right.num_rows, dtype=np.int64), np.zeros(right.num_rows, dtype=np.int64)
        at = right["at"].to_numpy()
        counts[at], best[at] = right["n_links"].to_numpy(), right["best"].to_numpy()
        meta = left.filter(pc.equal(left["kind"], _CHUNKS))
        link = np.frombuffer(meta["codes"][0].as_py(), dtype="<i4")
        edge = _starts(np.frombuffer(meta["sizes"][0].as_py(), dtype="<i4"))
        of_chunk = [np.diff(_starts(x[link])[edge]) for x in (best, counts)]
        texts = left.filter(pc.equal(left["kind"], _DOC))
        codes = [_codes(c) for c in texts["codes"].to_pylist()]
        made = {"n_best": pa.array(_per_text(of_chunk[0], codes)), "count_sum": pa.array(_per_text(of_chunk[1], codes))}
        return pa.table({n: made[n] if n in made else texts[n] for n in (f.split()[0] for f in _RESULT.split(", "))})

    return rest.groupBy("block").cogroup(back.groupBy("of_block")).applyInArrow(run, _RESULT)
