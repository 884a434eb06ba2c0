"""Training-data operators on planted cases: brute force over small tables, hot keys, repeated ids, clashing names."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldtrace.llm import fingerprints, html, ngram_join, packing, quality, queries, rules, substring, token_counts, toxicity, wordcache
from fieldtrace.llm.common import shingle_sets

DOCS = "doc_id long, text string"


def _prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice("abcdefghij") + str(rng.randrange(400)) for _ in range(n))


# ---- packing
def test_word_table_keeps_every_word():
    rng = np.random.default_rng(1)
    head, tail = rng.integers(0, 50, 4000).astype(np.uint64), rng.integers(0, 9, 4000).astype(np.uint64)
    size = rng.integers(1, 17, 4000)
    _, one = np.unique(np.stack([head, tail, size.astype(np.uint64)]), axis=1, return_index=True)
    table, known = wordcache.WordTable(), {}
    for part in np.array_split(one, 7):
        key = table.key(head[part], tail[part], size[part])
        assert (table.find(key, head[part], tail[part], size[part]) == -1).all()
        table.add(key, head[part], tail[part], size[part], part)
        known.update((int(i), int(i)) for i in part)
        at = np.array(sorted(known))
        assert (table.find(table.key(head[at], tail[at], size[at]), head[at], tail[at], size[at]) == at).all()


def test_open_windows_are_carried_to_a_second_pass(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, _prose(rng, rng.randint(1, 900))) for i in range(1500)], DOCS).repartition(8)
    path, lib = P.path("word_bpe_49k.json"), Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = {r.doc_id: [*lib.encode(r.text, add_special_tokens=False).ids, 1] for r in docs.collect()}
    for held in (packing.HELD_WINDOWS, 16):  # 16: tasks carry windows on before they end
        rows = packing.pack_documents(docs, path, held_windows=held, carried_pieces=4096).collect()
        made, windows = defaultdict(list), defaultdict(list)
        for r in rows:
            made[r.doc_id].append((r.start, r.ids))
            windows[r.sequence_id].append((r.offset, r.length, r.by_rule))
        assert {k: [i for _, ids in sorted(v) for i in ids] for k, v in made.items()} == want
        for pieces in windows.values():
            at = 0
            for offset, length, _ in sorted(pieces):
                assert offset == at
                at += length
            assert at <= 2048
        if held == packing.HELD_WINDOWS:
            by_rule = [p[0][2] for p in windows.values() if len(p) > 1]
            assert np.mean(by_rule) > 0.5  # of a few windows; the share grows with the input
            assert sum(len(v) for v in want.values()) / 2048 / len(windows) > 0.99


# ---- substring dedup
def _removed(rows: list[tuple[int, str | None]]) -> dict[tuple[int, str | None], set[int]]:
    """Pieces to remove by brute force: all spans of all texts, in order; all places of a run of words but the first."""
    places = defaultdict(set)
    for i, text in set(rows):
        if i is None or text is None:
            continue
        parts = substring.sentences(text)
        for a, b in substring.spans(parts):
            places[" ".join(p[2] for p in parts[a : b + 1])].add((i, text, a, b))
    out = defaultdict(set)
    for found in places.values():
        # of one id's texts the first is that of the least key, which the test does not know: see the caller
        for i, text, a, b in sorted(found)[1:]:
            out[i, text] |= set(range(a, b + 1))
    return out


def _passages(seed: int) -> list[tuple[int, str]]:
    rng = random.Random(seed)
    shared = [_prose(rng, rng.randint(40, 90)) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = [_prose(rng, rng.randint(3, 30)) + rng.choice([".", "", "!"]) for _ in range(rng.randint(1, 6))]
        for s in rng.sample(shared, rng.randint(0, 2)):
            parts.insert(rng.randint(0, len(parts)), s)
        rows.append((i, " ".join(parts)))
    return rows


@pytest.mark.parametrize("held", [substring.HELD_SPANS, 50])
def test_substring_dedup_is_brute_force(spark, monkeypatch, held):
    monkeypatch.setattr(substring, "HELD_SPANS", held)
    rows = _passages(held)
    rows += [(i + 100, rows[i][1]) for i in range(5)] + [rows[3], (None, rows[4][1]), (200, None), (201, ""), (202, "word " * 5000)]
    want = _removed(rows)
    got = substring.remove_repeats(spark.createDataFrame(rows, DOCS).repartition(5)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t for i, t in rows if i == r.doc_id)
        gone = want[r.doc_id, text] if r.doc_id is not None else set()
        assert r.n_removed == len(gone), r.doc_id
        if text is not None:
            assert r.text == "".join(text[a:b] for k, (a, b, _, _) in enumerate(substring.sentences(text)) if k not in gone)


def test_substring_dedup_takes_an_ids_texts_apart(spark):
    rng = random.Random(4)
    shared, own = _prose(rng, 80), _prose(rng, 80)
    rows = [(1, shared), (2, _prose(rng, 30) + ". " + shared), (2, own)]
    got = substring.remove_repeats(spark.createDataFrame(rows, DOCS).withColumns({n: F.lit(7) for n in ("doc", "key", "covers", "h", "n", "_doc", "_ranges")})).collect()
    assert Counter(r.text for r in got)[own] == 1 and {r.doc for r in got} == {7} and {r._ranges for r in got} == {7}
    assert sum(r.n_removed > 0 for r in got) == 1


# ---- joins
def test_repeated_ids_and_clashing_names(spark):
    rng = random.Random(5)
    a, b, c = (_prose(rng, 60) for _ in range(3))
    rows = [(2, a), (2, b), (5, b), (5, b), (7, c), (9, c + " more"), (None, a), (11, None)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({n: F.lit(1) for n in ("gone", "_gone", "z", "n", "component_id", "digest")})
    got = ngram_join.jaccard_components(docs, 4, 85).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.n_shingles): r.component_id for r in got}
    assert by[7, 57] == by[9, 58] == 7 and by[11, 0] == 11
    kept = ngram_join.keep_first(docs, 4, 85).collect()
    assert {r.doc_id for r in kept} >= {2, 7, None, 11} and 9 not in {r.doc_id for r in kept}
    assert {r.gone for r in kept} == {1}


def test_large_meetings_lose_no_link(spark, monkeypatch):
    """A chain whose ends are unlike, and a family around a text that is not its smallest: parts of three."""
    monkeypatch.setattr(ngram_join.meeting_links, "__defaults__", (3,))
    rng = random.Random(6)
    base = _prose(rng, 120).split()
    rows = []
    for i in range(40):
        w = list(base)
        for k in range(3 * i, 3 * i + 3):
            w[(k * 7) % 120] = f"new{i}{k}"
        rows.append((i, " ".join(w)))
        base = w if i % 2 else base
    sets = {i: {tuple(t.split()[k : k + 4]) for k in range(len(t.split()) - 3)} for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in range(i):
            o = len(sets[i] & sets[j])
            if 100 * o >= 80 * (len(sets[i]) + len(sets[j]) - o) and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(spark.createDataFrame(rows, DOCS), 4, 80).collect()}
    assert got == {i: find(i) for i in sets}


def test_bands_find_nine_in_ten_links(spark):
    rng = random.Random(8)
    rows = []
    for b in range(30):
        base = _prose(rng, 150).split()
        for _ in range(6):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(150)] = f"x{rng.random()}"
            rows.append((len(rows), " ".join(w)))
    sets = list(shingle_sets([t for _, t in rows], 5, lower=True))
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (o := len(np.intersect1d(sets[i], sets[j]))) >= 0.8 * (len(sets[i]) + len(sets[j]) - o)]
    got = {r.doc_id: r.class_id for r in fingerprints.near_duplicate_classes(spark.createDataFrame(rows, DOCS)).collect()}
    assert np.mean([got[i] == got[j] for i, j in links]) >= 0.9
    alone = [(i, j) for i in range(len(rows)) for j in range(i) if i // 6 != j // 6]
    assert not any(got[i] == got[j] for i, j in alone)


def test_likeness_is_that_of_the_fingerprints(spark):
    rng = random.Random(9)
    docs = spark.createDataFrame([(i, _prose(rng, rng.randint(0, 60))) for i in range(40)], DOCS)
    rows = sorted(fingerprints.fingerprint_documents(docs).collect())
    cells = lambda f: [f[k : k + 4] for k in range(0, len(f), 4)]
    for r, nxt in zip(rows, [*rows[1:], rows[0]], strict=True):
        assert r.near_next == np.mean([x == y for x, y in zip(cells(r.fingerprint), cells(nxt.fingerprint), strict=True)])
        assert r.near_edited == np.mean([x == y for x, y in zip(cells(r.fingerprint), cells(r.edited_fingerprint), strict=True)])


# ---- rules
def test_rules_certify_at_the_exact_bound(spark):
    """k of n good texts are turned away; the greatest k whose binomial tail is within the level certifies, the next does not."""
    rule = rules.Rule("r", "top", "base", 1, True, (10,))
    n, risk, delta = 400, 0.05, 0.05
    tail = lambda k: sum(math.comb(n, i) * risk**i * (1 - risk) ** (n - i) for i in range(k + 1))
    level = delta / 3  # two strata and the pool
    most = max(k for k in range(n) if tail(k) <= level)
    for k, certified in ((most, True), (most + 1, False)):
        rows = [("=a", 20 if i < k else 5, 1) for i in range(n)] + [("=b", 20 if i % 2 else 5, 1) for i in range(60)]
        got = {r.stratum: r.r for r in rules.certified_cutoffs(spark.createDataFrame(rows, "stratum string, top long, base long"), (rule,), risk, delta).collect()}
        assert (got["=a"] == 10) == certified and got["=b"] is None and got[rules.POOL] is None


def test_rules_fall_back_to_the_pool_and_keep_null_apart(spark):
    good = "one two three four five six seven eight nine ten"
    text = lambda i: " ".join(f"{w}{i}x{k}" for k in range(6) for w in good.split())
    rows = [(i, text(i), ["en", None, ""][i % 3]) for i in range(330)] + [(1000, " # ".join(text(0).split()), "xx"), (1001, text(1), "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(330)], "doc_id long, quality long")
    got = {r.doc_id: r for r in rules.apply_rules(docs, labels).collect()}
    assert got[1000].reason == "symbols" and not got[1000].kept and got[1001].kept
    assert all(got[i].kept for i in range(330))
    names = {r.stratum for r in rules.certified_cutoffs(rules.base_statistics(docs.withColumn("stratum", F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))), "stratum")).collect()}
    assert names == {"=en", "", "=", "=xx", rules.POOL}


# ---- token counts
def test_cache_holds_tokenizers_side_by_side(spark, tmp_path):
    rng = random.Random(10)
    docs = spark.createDataFrame([(i, _prose(rng, 20)) for i in range(30)] + [(50, "copy"), (51, "copy")], DOCS)
    one, two, cache = P.path("piece_bpe_32k.model"), P.path("byte_bpe_50k.json"), str(tmp_path / "cache")
    first = token_counts.count_tokens(docs.where("doc_id < 20"), one, cache).collect()
    other = token_counts.count_tokens(docs, two, cache).collect()
    stored = spark.read.parquet(cache).groupBy("tokenizer").count().collect()
    assert sorted(r["count"] for r in stored) == [20, 31]
    again = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, one, cache).collect()}
    assert all(again[r.doc_id] == r.n_tokens for r in first) and len(again) == 32
    assert spark.read.parquet(cache).count() == 62
    lib = Tokenizer.from_file(two)
    assert {r.doc_id: r.n_tokens for r in other} == {r.doc_id: len(lib.encode(r.text, add_special_tokens=False).ids) for r in docs.collect()}
    assert token_counts.count_tokens(docs.limit(0), one, cache).count() == 0 and spark.read.parquet(cache).count() == 62


def test_counts_of_hot_texts_are_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_counts, "HOT_COPIES", 3)
    docs = spark.createDataFrame([(i, "the same text") for i in range(20)] + [(100 + i, f"text {i}") for i in range(5)] + [(None, None)], DOCS)
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, P.path("piece_bpe_32k.model"), str(tmp_path / "c")).collect()}
    assert len(got) == 26 and len({got[i] for i in range(20)}) == 1 and got[None] == 0


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_counts_are_sums_over_chunks_that_reach_the_library_once(name, monkeypatch):
    monkeypatch.setattr(token_counts, "_LOADED", {})
    counter = token_counts._counter(P.path(name))
    if name.endswith(".model"):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=P.path(name))
        want = lambda texts: [len(lib.encode(t)) for t in texts]
    else:
        lib = Tokenizer.from_file(P.path(name))
        want = lambda texts: [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]
    rng = random.Random(12)
    marks = [*" " * 10, *"\n\t\r\x0b\x0c\x1c\x85\xa0\u180e\u2003\u3000\u200b\ufeff\0é▁", "  ", "\r\n", "'s", "<|endoftext|>", "<s>", "<0x0A>", "中文", "😀", "12", "--", "a", "the", "The", ";", "e\u0301"]
    odd = ["", " ", "  ", "\n", " \n", "a ", "a  ", " a", "\ta", "x" * 40, "é" * 300 + " b"] + ["".join(rng.choices(marks, k=rng.randrange(30))) for _ in range(4000)]
    assert counter(odd) == want(odd)
    # a full table forgets, and goes on counting
    monkeypatch.setattr(token_counts, "CACHE_CHUNKS", 50)
    monkeypatch.setattr(token_counts, "LONG_BYTES", 100)
    assert [n for at in range(0, len(odd), 500) for n in counter(odd[at : at + 500])] == want(odd)
    monkeypatch.undo()
    prose = [_prose(rng, 300) for _ in range(50)]
    counter.clear()
    met, alone = [], counter.alone
    monkeypatch.setattr(counter, "alone", lambda chunks: met.extend(chunks) or alone(chunks))
    assert counter(prose) == want(prose) and counter(prose) == want(prose)
    assert len(met) == len(set(met)) < sum(len(t.split()) for t in prose) / 3


# ---- classifiers
def test_a_labelled_id_counts_once(spark):
    rng = random.Random(11)
    rows = [(i, _prose(rng, 80) if i % 2 else "# | # " * 20) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality long")
    once = quality.fit_quality(spark.createDataFrame(rows, DOCS), labels, trees=5)
    many = quality.fit_quality(spark.createDataFrame(rows + [rows[0]] * 200, DOCS), labels, trees=5)
    assert np.array_equal(once.value, many.value) and np.array_equal(once.threshold, many.threshold)


def test_ordinal_gradient_is_that_of_the_loss():
    """One step of the fit from known weights moves against a numerical gradient."""
    rng = np.random.default_rng(3)
    n, size = 40, 4
    owner, feature = np.repeat(np.arange(n), 2), rng.integers(0, size, 2 * n)
    value, grade = rng.random(2 * n), rng.integers(0, 4, n)

    def loss(w, cuts):
        z = np.bincount(owner, w[feature] * value, n)
        above = np.concatenate([np.ones((n, 1)), 1 / (1 + np.exp(-(z[:, None] - cuts[None, :]))), np.zeros((n, 1))], axis=1)
        return -np.log(above[np.arange(n), grade] - above[np.arange(n), grade + 1]).mean()

    w, cuts = toxicity.fit_ordinal(owner, feature, value, grade, size, steps=4000, rate=0.02, l2=0.0)
    best = loss(w, cuts)
    for i in range(size):
        for d in (-1e-3, 1e-3):
            moved = w.copy()
            moved[i] += d
            assert loss(moved, cuts) >= best - 1e-7
    for k in range(3):
        for d in (-1e-3, 1e-3):
            moved = cuts.copy()
            moved[k] += d
            assert loss(w, moved) >= best - 1e-7


# ---- pages
def _plain_host(n: int, seed: int = 5) -> list[tuple[str, str]]:
    """Pages of unmarked divs: a menu, a notice, the text, reader comments, a footer. -> html, main text."""
    rng, out = random.Random(seed), []
    for i in range(n):
        paras = [_prose(rng, rng.randint(20, 40)) for _ in range(rng.randint(3, 6))]
        comments = "".join(f"<div><b>{_prose(rng, 1)}</b><p>{_prose(rng, 4)}</p></div>" for _ in range(rng.randint(0, 2)))
        body = f"<h1>Title {i}</h1><div>{''.join(f'<p>{p}</p>' for p in paras)}</div>"
        page = f"<html><body><div>Home News Contact</div><div>We use small files. Accept.</div><div>{body}</div><div><p>Popular today</p>{comments}</div><div>All rights kept.</div></body></html>"
        out.append((page, "\n\n".join([f"Title {i}", *paras])))
    return out


def test_the_wrapper_decides_on_pages_of_plain_blocks():
    pages = _plain_host(12)
    empty = html._wrap(html.Node("page"))
    assert not any(html.extract(p, empty) == want for p, want in pages)
    for seed in range(4):  # in any order
        order = [p for p, _ in pages]
        random.Random(seed).shuffle(order)
        wrapper = html.infer(order)
        assert all(html.extract(p, wrapper) == want for p, want in pages)


def test_page_texts_do_not_hang_on_partitions_or_the_join(spark, monkeypatch):
    pages = _plain_host(12)
    rows = [(i, f"http://plain.example/{i}", p) for i, (p, _) in enumerate(pages)] + [(50, "http://long.example/", "<div>" + "<p>x y</p><ul><li>z</li></ul>" * 3000 + "</div>"), (51, None, None)]
    rows.append(rows[0])
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    seen = []
    for parts, limit in ((1, html.BROADCAST_BYTES), (6, html.BROADCAST_BYTES), (3, 0)):
        monkeypatch.setattr(html, "BROADCAST_BYTES", limit)
        got = html.extract_pages(docs.repartition(parts)).collect()
        assert len(got) == len(rows)
        seen.append({r.page_id: r.text for r in got})
    assert seen[0] == seen[1] == seen[2]
    assert all(seen[0][i] == want for i, (_, want) in enumerate(pages))


def test_long_lists_align_by_halves(monkeypatch):
    rng = np.random.default_rng(4)
    for _ in range(30):
        x, y = rng.integers(0, 4, rng.integers(0, 40)), rng.integers(0, 4, rng.integers(0, 40))
        whole = html._common(x, y)
        with monkeypatch.context() as m:
            m.setattr(html, "LCS_CELLS", 8)
            halves = html._common(x, y)
        assert len(whole) == len(halves)
        for pairs in (whole, halves):
            assert all(x[i] == y[j] for i, j in pairs) and all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:], strict=False))


def test_headings_that_repeat_inside_an_article_stay():
    pages = [f"<article><h1>Title {i}</h1><h2>Summary</h2><p>Body {i} of it.</p></article>" for i in range(8)]
    wrapper = html.infer(pages)
    assert html.extract(pages[3], wrapper) == "Title 3\n\nSummary\n\nBody 3 of it."


# ---- queries beside the numbered ones
def test_extra_queries_run(spark):
    from conftest import SMALL

    n = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    for name in ("token_counts_from_cache", "near_duplicate_classes"):
        assert queries.QUERIES[name](spark, SMALL).count() == n


# ---- the pipeline
def test_the_pipeline_is_its_stages_by_brute_force(spark):
    import corpus_pipeline
    from conftest import SMALL

    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    trees = quality.fit_quality(docs, labels)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows = [x for x, s in zip(rows, trees.scores(quality.text_statistics([t for _, t in rows])), strict=True) if s >= 0.5]
    model = toxicity.fit_toxicity(spark.createDataFrame(rows, DOCS), labels)
    make = toxicity.Featurizer(model.kept)
    rows = [x for x, p in zip(rows, model.probabilities([make.counts(t)[0] for _, t in rows]), strict=True) if p[0] < 0.5]
    sets = {i: set(s.tolist()) for (i, _), s in zip(rows, shingle_sets([t for _, t in rows], 5, lower=True), strict=True)}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            o = len(sets[i] & sets[j])
            if j < i and sets[i] and 100 * o >= 80 * (len(sets[i]) + len(sets[j]) - o) and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    rows = [(i, t) for i, t in rows if find(i) == i]
    gone = _removed(rows)
    lib, want = Tokenizer.from_file(P.path("word_bpe_49k.json")), {}
    for i, t in rows:
        kept = "".join(t[a:b] for k, (a, b, _, _) in enumerate(substring.sentences(t)) if k not in gone[i, t])
        want[i] = [*lib.encode(kept, add_special_tokens=False).ids, 1]
    made = defaultdict(list)
    for r in corpus_pipeline.run(spark, SMALL).collect():
        made[r.doc_id].append((r.start, r.ids))
    assert {k: [x for _, ids in sorted(v) for x in ids] for k, v in made.items()} == want


def test_pipeline_stages_take_odd_rows(spark):
    import corpus_pipeline
    from conftest import SMALL

    rng = random.Random(12)
    rows = [(1, None), (2, ""), (None, _prose(rng, 40)), (3, _prose(rng, 60)), (3, None), (4, "x " * 4000)] + [(10 + i, _prose(rng, 50)) for i in range(6)]
    rows += [rows[6], (99, rows[6][1])]
    docs = spark.createDataFrame(rows, DOCS).withColumns({n: F.lit(1) for n in ("lang", "source", "y", "gone", "doc", "key", "covers", "score")}).withColumn("n_chars", F.lit(None).cast("long"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SMALL).count() == 0
        assert stage(spark, docs, SMALL).count() > 0
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, SMALL).collect()
    assert sum(r.doc_id == 99 for r in kept) == 0 and sum(r.doc_id is None for r in kept) == 1 and sum(r.doc_id == 10 for r in kept) == 2


def test_shared_tables_can_be_deleted(spark):
    import os

    from fieldtrace.llm import common

    table = common.write_shared(spark.range(3), "numbers")
    folder = common._own_folder(spark)
    assert table.count() == 3 and os.listdir(folder.removeprefix("file:"))
    assert common.clean_shared(spark) and not os.path.exists(folder.removeprefix("file:"))
