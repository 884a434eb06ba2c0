"""Decontamination, clustering and alignment against brute force, with their edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from conftest import SMALL, same_rows
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldtrace.llm import alignment, bpe, clustering, decontaminate

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string"
BENCH = "item_id long, text string"


def text_of(rng: random.Random, words: int, vocabulary: int = 4) -> str:
    marks = [" ", "  ", "\n", ", ", "-", ".\n", "\t"]
    return "".join(rng.choice(["the", "Fox", "a1", "naïve", "漢字", "B"][:vocabulary]) + rng.choice(marks) for _ in range(words))


# ---- decontamination
def words_of(text: str | None) -> list[str]:
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute_contamination(docs: list[tuple], bench: list[tuple], size: int = 10) -> list[tuple]:
    out = []
    for doc_id, text in docs:
        w, hit, items = words_of(text), set(), set()
        for item, t in bench:
            b = words_of(t)
            k = min(size, len(b))
            for s in range(len(b) - k + 1) if b else ():
                for p in range(len(w) - k + 1):
                    if w[p : p + k] == b[s : s + k]:
                        hit |= set(range(p, p + k))
                        items.add(item)
        ids = sorted(str(i) for i in items - {None})
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def random_case(seed: int) -> tuple[list[tuple], list[tuple]]:
    rng = random.Random(seed)
    docs = [(i, text_of(rng, rng.randint(0, 60), rng.choice([2, 4, 6]))) for i in range(30)]
    bench = [(i, text_of(rng, rng.choice([0, 1, 3, 9, 10, 11, 25]), rng.choice([1, 2, 4, 6]))) for i in range(14)]
    cut = lambda t: t[rng.randint(0, 5) :]
    docs += [(100 + i, text_of(rng, 8) + cut(rng.choice(bench)[1]) + text_of(rng, 5)) for i in range(15)]
    return docs + [docs[3], (None, docs[5][1]), (7, None), (8, "")], [*bench, (3, docs[2][1]), (None, docs[4][1][:90]), (50, None), (2, bench[2][1])]


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])  # one block, and several, one after the other
def test_contamination_equals_brute_force(spark, block_bytes):
    for seed in range(2):
        docs, bench = random_case(seed)
        got = decontaminate.contamination(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(bench, BENCH), block_bytes=block_bytes)
        assert sorted((tuple(r) for r in got.collect()), key=str) == brute_contamination(docs, bench)


def test_contamination_equals_sql(spark, duck):
    docs, bench = (spark.read.parquet(f"{SMALL}/{n}.parquet") for n in ("documents", "benchmark"))
    same_rows(decontaminate.contamination(docs, bench), duck.sql(decontaminate.oracle()))


def test_suffix_array_orders_all_suffixes():
    rng = np.random.default_rng(5)
    for _ in range(200):
        size = int(rng.integers(1, 5))
        text = np.append(rng.integers(0, size + 1, int(rng.integers(0, 80))), 0).astype(np.int64)
        if rng.random() < 0.3:
            text = np.append(np.tile(text[:-1], 5), 0)
        order = decontaminate.suffix_array(text, size + 1)

        def suffix(i, text=text):
            return text[i : i + int(np.flatnonzero(text[i:] == 0)[0])].tolist()

        keys = [suffix(i) for i in order]
        assert sorted(order) == list(range(len(text))) and all(a <= b for a, b in zip(keys, keys[1:], strict=False))


def test_longest_matches_equal_brute_force(spark):
    docs, bench = random_case(9)
    got = decontaminate.longest_matches(spark.createDataFrame(docs, DOCS).repartition(2), spark.createDataFrame(bench, BENCH), least=3, block_bytes=400)
    want = {}
    for item, t in bench:
        b = words_of(t)
        for doc_id, text in docs:
            w = words_of(text)
            for s in range(len(b)):
                for p in range(len(w)):
                    n = 0
                    while s + n < len(b) and p + n < len(w) and b[s + n] == w[p + n]:
                        n += 1
                    key = (-n, doc_id is None, doc_id or 0, p, s)
                    name = None if item is None else str(item)
                    if n >= 3 and (name not in want or key < want[name]):
                        want[name] = key
    assert {r.item_id: (-r.n_words, r.doc_id is None, r.doc_id or 0, r.doc_start, r.item_start) for r in got.collect()} == want


def test_decontaminate_keeps_clean_rows_with_all_columns(spark):
    docs, bench = random_case(4)
    df = spark.createDataFrame(docs, DOCS).withColumn("n_hit", F.lit("x")).withColumn("items", F.array(F.lit(1))).withColumn("a.b", F.lit(None).cast("map<string,int>"))
    kept = decontaminate.decontaminate(df, spark.createDataFrame(bench, BENCH))
    assert kept.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(d for d, r in zip(docs, [brute_contamination([d], bench)[0] for d in docs], strict=True) if not r[-1])


def test_contamination_edges(spark):
    none, empty = spark.createDataFrame([], DOCS), spark.createDataFrame([], BENCH)
    rows = spark.createDataFrame([(1, "word " * 200_000), (None, None)], DOCS)
    assert decontaminate.contamination(none, spark.createDataFrame([(1, "a b")], BENCH)).count() == 0
    assert decontaminate.longest_matches(rows, empty).count() == 0 and decontaminate.longest_matches(none, empty).count() == 0
    got = {r.doc_id: r for r in decontaminate.contamination(rows, empty).collect()}
    assert got[1].n_words == 200_000 and not got[1].contaminated and got[None].items_sha256 == hashlib.sha256(b"").hexdigest()
    got = {r.doc_id: r for r in decontaminate.contamination(rows, spark.createDataFrame([(5, "Word " * 12)], BENCH)).collect()}
    assert got[1].n_hit == 200_000 and got[1].n_items == 1 and got[None].n_hit == 0
    long = "x" * 3_000_000 + " " + "ab cd " * 400_000  # a text of several blocks, cut between words
    h, first = decontaminate.item_words([long, "ab"])
    assert first.tolist() == [0, 800_001, 800_002] and h[1] == h[-1] and len(set(h.tolist())) == 3


# ---- clustering
def brute_clusters(rows: list[tuple], k: int, rounds: int, n: int) -> dict:
    kept = [(i, [math.floor(256 * x) if abs(x) < 1e300 else int(x) * 256 for x in v]) for i, v in rows if v is not None and len(v) == n and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), j) for j, (i, _) in enumerate(kept) if i is not None)[:k]
    centroids = [kept[j][1] for _, j in seeds]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        at = assign()
        for j in range(len(centroids)):
            own = [v for (_, v), (_, a) in zip(kept, at, strict=True) if a == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    at = assign()
    own = Counter()
    for d, j in at:
        own[j] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    long = lambda x: x if x < 1 << 63 else None
    return Counter((i, j, long(d), long(own[j]), long(sum(own.values())), sha[j]) for (i, _), (d, j) in zip(kept, at, strict=True))


@pytest.mark.parametrize("scale", [1.0, 3e4, 1e9, 1e25])  # float64, guarded beyond it, 64-bit integers, larger integers
def test_clusters_equal_brute_force(spark, scale):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=5) * scale).tolist()) for i in range(120)]
    rows += [(500 + i, [0.0] * 5) for i in range(20)] + [(3, rows[3][1]), (None, rows[9][1]), (900, None), (901, []), (902, [1.0] * 4), (903, [1.0, None, 2.0, 3.0, 4.0]), (904, [math.inf] * 5), (905, [math.nan, 1.0, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit("clash")).repartition(3)
    got = clustering.cluster_vectors(df, k=7, rounds=3, components=5)
    assert Counter(tuple(r) for r in got.collect()) == brute_clusters(rows, 7, 3, 5)


def test_nearest_is_exact_on_both_sides_of_the_guard():
    rng = np.random.default_rng(1)
    for size in (1 << 10, 1 << 22, 1 << 24, 1 << 28, 1 << 40, 1 << 61):
        x, c = rng.integers(-size, size, (50, 64)), rng.integers(-size, size, (9, 64))
        c[5] = c[2]  # ties go to the smaller number
        number, distance = clustering.nearest(x, c)
        for row, j, d in zip(x.tolist(), number.tolist(), distance.tolist(), strict=True):
            assert (d, j) == min((sum((a - b) ** 2 for a, b in zip(row, y, strict=True)), i) for i, y in enumerate(c.tolist()))


def test_clusters_equal_sql(spark, duck):
    same_rows(clustering.cluster_vectors(spark.read.parquet(f"{SMALL}/embeddings.parquet")), duck.sql(clustering.oracle()))


def test_clusters_edges(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert clustering.cluster_vectors(none).count() == 0
    nameless = spark.createDataFrame([(None, [1.0] * 64)], "vec_id long, embedding array<float>")
    assert clustering.cluster_vectors(nameless).count() == 0
    one = clustering.cluster_vectors(spark.createDataFrame([(4, [0.5] * 64), (4, [0.5] * 64)], "vec_id long, embedding array<float>")).collect()
    assert [(r.cluster, r.distance, r.inertia) for r in one] == [(0, 0, 0)] * 2


# ---- alignment
def brute_alignment(rows: list[tuple]) -> Counter:
    one, two = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    one.encode_special_tokens = True
    symbols = bpe.byte_symbols()
    spell = {i: bytes(symbols[c] for c in t) for t, i in one.get_vocab(False).items() if all(c in symbols for c in t)}

    def piece(i):
        p = two.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if two.is_byte(i) else p.replace("▁", " ").encode()

    counts, texts = Counter(), []
    for doc_id, text in rows:
        a, b = (one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)) if text else ([], [])
        bytes_a, bytes_b = [spell[i] for i in a], [piece(i) for i in b]
        if not text or b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            texts.append((doc_id, None))
            continue
        end_a, end_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        links = [(a[i], b[j]) for i in range(len(a)) for j in range(len(b)) if max(end_a[i] - len(bytes_a[i]), end_b[j] - len(bytes_b[j])) < min(end_a[i], end_b[j])]
        groups, i, j = [], 0, 0
        for e in sorted(set(end_a) & set(end_b)):
            i2, j2 = end_a.index(e) + 1, end_b.index(e) + 1
            groups.append(",".join(map(str, a[i:i2])) + "|" + ",".join(map(str, b[j:j2])))
            i, j = i2, j2
        counts.update(links)
        texts.append((doc_id, (len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest())))
    top = Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    return Counter((i, 0, 0, 0, 0, 0, 0, "") if x is None else (i, *x[:3], len(x[3]), sum(counts[q] == top[q[1]] for q in x[3]), sum(counts[q] for q in x[3]), x[4]) for i, x in texts)


def odd_texts() -> list[tuple]:
    rng = random.Random(3)
    parts = ["a", "B", "é", "é", " ", "  ", "\n", "\t", "\r", "\r\n", "'s", "<|endoftext|>", "<s>", "漢", "🙂", "1", "２", "%", ".", "\x1c", "\x85", "\xa0", " ", "İ", "\x00", "‍", "foo();", "　", ";"]
    out = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))) for i in range(400)]
    out += [(1000 + i, t) for i, t in enumerate([None, "", " ", "\n", "  ", "a▁b", "▁", " x\r\n\r\ny ", "no" * 300, "same words here", "same words here"])]
    return [*out, (None, "nameless"), (5, out[5][1])]


def test_a_line_in_pieces_is_aligned_like_a_whole_one(monkeypatch):
    encoder = alignment.PairEncoder.shared(A, B)
    rng = random.Random(6)
    chunks = [" " + "".join(rng.choice("aeiourstnl漢é.,") for _ in range(rng.randint(1, 40))) for _ in range(300)] + [" " + "z1" * 4000]
    tokens = encoder.encode_chunks(chunks)
    whole = alignment.Alignment(tokens, encoder)
    for size in (1, 50, 3000):
        monkeypatch.setattr(alignment, "PIECE_TOKENS", size)
        if size == 1:
            chunks_ = chunks[:20]
            few, cut = alignment.Alignment(encoder.encode_chunks(chunks_), encoder), 20
        else:
            few, cut = alignment.Alignment(tokens, encoder), len(chunks)
        assert few.groups == whole.groups[:cut] and few.n_groups.tolist() == whole.n_groups[:cut].tolist() and few.n_links.tolist() == whole.n_links[:cut].tolist()
        ends = np.cumsum(np.concatenate([[0], few.n_links]))
        assert all(sorted(few.link[x:y]) == sorted(whole.link[x:y]) for x, y in zip(ends, ends[1:], strict=False))


@pytest.mark.parametrize("block_chars", [alignment.BLOCK_CHARS, 300])  # one block for each task, and many
def test_alignment_equals_brute_force(spark, block_chars):
    rows = odd_texts()
    df = spark.createDataFrame(rows, DOCS).withColumn("block", F.lit("clash")).withColumn("kind", F.lit(None).cast("int")).repartition(3)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, 20)
    try:
        assert Counter(tuple(r) for r in alignment.align_documents(df, A, B, block_chars).collect()) == brute_alignment(rows)
    finally:
        spark.conf.set(name, before)


def test_alignment_of_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("length(text) < 3000")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert Counter(tuple(r) for r in alignment.align_documents(docs, A, B).collect()) == brute_alignment(rows)


def test_alignment_edges(spark):
    assert alignment.align_documents(spark.createDataFrame([], DOCS), A, B).count() == 0
    got = {r.doc_id: r for r in alignment.align_documents(spark.createDataFrame([(1, None), (2, "word " * 100_000)], DOCS), A, B).collect()}
    assert tuple(got[1])[1:] == (0, 0, 0, 0, 0, 0, "") and got[2].n_a == 100_001
    assert got[2].n_links >= got[2].n_a and got[2].n_links == got[2].n_a + got[2].n_b - got[2].n_groups


# ---- rows without a key
def test_rows_without_a_key_are_dealt_out_and_kept(spark):
    from fieldtrace.llm import ngram_join
    from fieldtrace.llm.common import left_by

    rows = [(None, f"text number {i} of many words here") for i in range(300)] + [(1, "one two three four five six"), (2, "one two three four five six"), (3, None), (None, None), (1, "one two three four five six")]
    df = spark.createDataFrame(rows, DOCS).withColumn("a.b", F.lit(1)).withColumn("salt", F.lit("mine"))
    kept = ngram_join.keep_first(df)
    assert kept.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(r for r in rows if r[0] != 2)
    few = spark.createDataFrame([(1,)], "k long")
    many = spark.range(1000).select(F.lit(None).cast("long").alias("k"), F.col("id").cast("string").alias("t"))
    spread = left_by(many, few.hint("shuffle_hash"), "k", "t", "left_anti").groupBy(F.spark_partition_id()).count().collect()
    assert len(spread) > 1 and sum(r["count"] for r in spread) == 1000
