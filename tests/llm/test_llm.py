"""Training-data operators against brute force, exact round trips, held-out accuracy, and their edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from conftest import SMALL
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldtrace.llm import bpe, fingerprints, html, ngram_join, packing, quality, queries, rules, substring, token_counts, toxicity
from fieldtrace.llm.common import shingle_sets
from fieldtrace.llm.components import connected_components
from fieldtrace.llm.wordcache import WordEncoder

DOCS = "doc_id long, text string"
LONG = "word " * 30_000
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "nameless text here"), (5, LONG), (6, "naïve café 漢字 🙂 <|endoftext|> x")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SMALL}/labels.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, repeats, a very long text, and columns whose names clash with those the operators make."""
    return spark.createDataFrame(ODD, DOCS).withColumn("n", F.lit("x")).withColumn("score", F.lit(None).cast("string")).withColumn("lang", F.lit(None).cast("string")).withColumn("slot", F.lit(1))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS + ", lang string")


# ---- packing
def test_packing_round_trip(docs):
    path = P.path("word_bpe_49k.json")
    rows = packing.pack_documents(docs, path).collect()
    lib = Tokenizer.from_file(path)
    made, used = {}, {}
    for r in rows:
        ids = np.array(r.ids, dtype="<u4")
        assert len(ids) == r.length and zlib.crc32(ids.tobytes()) == r.ids_crc32
        made.setdefault(r.doc_id, []).append((r.start, r.ids))
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for d in docs.collect():
        got = [i for _, ids in sorted(made[d.doc_id]) for i in ids]
        assert got == [*lib.encode(d.text or "", add_special_tokens=False).ids, 1]
    for pieces in used.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(r.length for r in rows) / 2048 / len(used) > 0.9


def test_sum_of_squares_choice_is_the_least_change():
    rng = random.Random(1)
    p = packing.SumOfSquaresPacker(window=16)
    for i in range(400):
        size = rng.randint(1, 15)
        counts = p.counts.copy()

        def after(level, size=size, counts=counts):
            c = counts.copy()
            if level:
                c[level] -= 1
            if level + size < 16:
                c[level + size] += 1
            return int((c[1:16] ** 2).sum())

        options = [0] + [h for h in range(1, 16 - size + 1) if counts[h]]
        assert after(p.choose(size)) == min(map(after, options))
        list(p.add(i, np.arange(size)))


def test_packing_edges(odd, none):
    path = P.path("word_bpe_49k.json")
    rows = packing.pack_documents(odd, path, with_ids=False).collect()
    assert sum(r.length for r in rows if r.doc_id == 1) == 1 and sum(r.length for r in rows if r.doc_id == 4) == 4
    assert sum(r.length for r in rows if r.doc_id == 5) == 30_001
    assert packing.pack_documents(none, path).count() == 0


# ---- encoders
def _fuzz(n=600):
    rng = random.Random(7)
    alphabet = ["a", "B", "é", "é", " ", "  ", "\n", "\t", "'s", "'LL", "<|endoftext|>", "<|startoftext|>", "漢", "🙂", "1", "２", "%", ".", "\x1c", "\x85", "\xa0", " ", "İ", "Σ", "ß", "\x00", "‍", "ǅ"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(n)] + ["", "a" * 3000, "xyz" * 999, " " * 500, "0123456789" * 200]


def test_backtracking_gives_the_library_ids_and_text(docs):
    path = P.path("byte_bpe_50k.json")
    ours, lib = bpe.BacktrackingBpe(path), Tokenizer.from_file(path)
    texts = _fuzz() + [r.text for r in docs.collect()]
    for text, want in zip(texts, lib.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = np.frombuffer(ours.encode(text), dtype="<u4")
        assert ids.tolist() == want.ids, text[:80]
        assert ours.decode(ids) == lib.decode(want.ids, skip_special_tokens=False)


def test_word_cache_gives_the_library_ids(docs):
    path = P.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    texts = _fuzz() + [r.text for r in docs.collect()]
    for cache in (50, 10**6):  # a cache that overflows, and one that does not
        encoder = WordEncoder(path, cache)
        got = [x for i in range(0, len(texts), 40) for x in encoder.encode_batch(texts[i : i + 40])]
        for text, raw, want in zip(texts, got, lib.encode_batch(texts, add_special_tokens=False), strict=True):
            assert np.frombuffer(raw, dtype="<u4").tolist() == want.ids, text[:80]


def test_round_trip_edges(odd, none):
    path = P.path("byte_bpe_50k.json")
    rows = bpe.round_trip(odd, path).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(ODD) and by[1].n_tokens == 0 and by[1].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert all(by[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest() for i, t in ODD)
    assert bpe.round_trip(none, path).count() == 0
    back = bpe.decode_documents(bpe.encode_documents(odd, path), path).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == sorted((i or 0, t or "") for i, t in ODD)


def test_token_counts_use_and_fill_the_cache(odd, none, tmp_path):
    import sentencepiece

    path, cache = P.path("piece_bpe_32k.model"), str(tmp_path / "cache")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = token_counts.count_tokens(odd, path, cache).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows) == sorted((i or 0, len(sp.encode(t or ""))) for i, t in ODD)
    assert {r.doc_id: r.n_bytes for r in rows}[6] == len(ODD[-1][1].encode()) and {r.doc_id: r.over_limit for r in rows}[5]
    stored = odd.sparkSession.read.parquet(cache)
    assert stored.count() == len({t or "" for _, t in ODD})
    token_counts.count_tokens(odd, path, cache).collect()
    assert odd.sparkSession.read.parquet(cache).count() == stored.count()  # nothing is encoded twice
    assert token_counts.count_tokens(none, path, str(tmp_path / "other")).count() == 0


# ---- similarity
def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def _set(text, n):
    w = _words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def test_shingle_hashes_are_as_distinct_as_shingles(docs):
    texts = [r.text for r in docs.collect()] + [t for _, t in ODD]
    for n in (4, 5):
        assert [len(s) for s in shingle_sets(texts, n, lower=True)] == [len(_set(t, n)) for t in texts]


def _family(seed=3):
    """Near copies around a few bases, copies, and a passage that most texts share."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(25)]
    rows = []
    for b in range(6):
        base = [f"b{b}w{i}" for i in range(rng.randint(60, 160))]
        for _ in range(25):
            w = list(base)
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = f"x{rng.random()}"
            if rng.random() < 0.5:
                w += passage
            rows.append((len(rows), " ".join(w)))
    return rows + [(len(rows) + i, rows[i * 7][1]) for i in range(10)]


def test_jaccard_components_are_exact(spark, monkeypatch):
    rows = _family()
    sets = {i: _set(t, 4) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in range(i):
            o = len(sets[i] & sets[j])
            if sets[i] and 100 * o >= 85 * (len(sets[i]) + len(sets[j]) - o) and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    for part in (512, 4):  # one part for each meeting, and many bands and parts
        monkeypatch.setattr(ngram_join.meeting_links, "__defaults__", (part,))
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(spark.createDataFrame(rows, DOCS), 4, 85).collect()}
        assert got == {i: (len(s), find(i)) for i, s in sets.items()}


def test_jaccard_edges(odd, none):
    rows = ngram_join.jaccard_components(odd, 4, 85).collect()
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in rows}
    assert len(rows) == len(ODD)
    assert got == {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (None, 1, None), (5, 1, 5), (6, 3, 6)}
    assert ngram_join.jaccard_components(none).count() == 0
    assert ngram_join.keep_first(odd).count() == len(ODD)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(5, 5), (None, 1), (100, 101)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}


def test_fingerprints_against_brute_force(docs):
    rows = {r.doc_id: r for r in fingerprints.fingerprint_documents(docs).collect()}
    texts = sorted((r.doc_id, r.text or "") for r in docs.collect())
    assert len(rows) == len(texts)
    seen = {}
    for k, (i, t) in enumerate(texts):
        nxt = texts[(k + 1) % len(texts)][1]
        cut = len(t) // 4
        new = t[: len(t) - cut] + nxt[:cut]
        assert rows[i].edited_sha256 == hashlib.sha256(new.encode()).hexdigest() and rows[i].n_chars == len(t)
        a, b, c = (_set(x, 5) for x in (t, new, nxt))
        j = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        assert abs(rows[i].near_edited - j(a, b)) < 0.2 and abs(rows[i].near_next - j(a, c)) < 0.2
        assert seen.setdefault(t, rows[i].fingerprint) == rows[i].fingerprint


def test_fingerprint_edges(odd, none, spark):
    assert fingerprints.fingerprint_documents(odd).count() == len(ODD)
    assert fingerprints.fingerprint_documents(none).count() == 0
    r = fingerprints.fingerprint_documents(spark.createDataFrame([(9, "abcd efgh")], DOCS)).collect()
    assert len(r) == 1 and r[0].near_next == 1.0  # a single row follows itself
    got = {r.doc_id: r.class_id for r in fingerprints.near_duplicate_classes(spark.createDataFrame(_family()[:30], DOCS)).collect()}
    sets = {i: _set(t, 5) for i, t in _family()[:30]}
    assert all(got[i] == got[j] for i in sets for j in sets if sets[i] == sets[j])


def test_near_duplicate_classes_at_the_threshold(spark, monkeypatch):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(404)]
    rows = []
    for i in range(100):  # near copies of one text, at about Jaccard 0.8 with each other
        w = list(base)
        for at in rng.sample(range(5, 400), 5):
            w[at] = f"x{i}.{at}"
        rows.append((i, " ".join(w)))
    rows += [(200, rows[7][1]), (201, rows[7][1])]
    sets = {i: _set(t, 5) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if j < i and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    want = {i: find(i) for i in sets}
    for part in (512, 16):
        monkeypatch.setattr(ngram_join.meeting_links, "__defaults__", (part,))
        got = {r.doc_id: r.class_id for r in fingerprints.near_duplicate_classes(spark.createDataFrame(rows, DOCS)).collect()}
        assert got == want, (len(set(got.values())), len(set(want.values())))


# ---- models
def test_quality_on_held_out_labels(docs, labels, odd, none):
    model = quality.fit_quality(docs, labels)
    rows = quality.score_quality(docs, model).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.9 * len(rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in quality.score_quality(docs, model).collect())
    edge = quality.score_quality(odd, model).collect()
    assert len(edge) == len(ODD) and all(0 <= r.score <= 1 for r in edge)
    assert quality.score_quality(none, model).count() == 0
    empty = quality.fit_quality(none, labels.limit(0))
    assert quality.score_quality(odd, empty).first().score == 0.5


def test_flat_trees_walk_like_nested_ones():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    model = quality.fit_trees(x, y, trees=30)
    total = np.full(len(x), model.bias)
    for f, t, v in zip(model.feature, model.threshold, model.value, strict=True):
        for r in range(len(x)):
            at = 0
            while at < len(f):
                at = 2 * at + (1 if x[r, f[at]] <= t[at] else 2)
            total[r] += v[at - len(f)]
    np.testing.assert_allclose(model.scores(x), 1 / (1 + np.exp(-total)))
    assert ((model.scores(x) >= 0.5) == y).mean() > 0.95


def test_toxicity_finds_insults_and_leaves_the_rest(spark, odd, none):
    rng = random.Random(5)
    rows, marks = [], []
    for i in range(400):
        w = [rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(rng.randint(20, 80))]
        toxic = i % 4 == 0
        for _ in range(rng.randint(2, 8) if toxic else 0):
            w[rng.randrange(len(w))] = rng.choice(["idiot", "moron!", "Scum"])
        rows.append((i, " ".join(w) + f" own{i}"))
        marks.append((i, int(toxic)))
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame(marks, "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    assert (np.diff(model.cuts) > 0).all()
    got = toxicity.score_toxicity(docs, model).withColumnRenamed("toxic", "found").join(labels, "doc_id").where(quality.held_out()).collect()
    assert sum(r.found == r.toxic for r in got) >= 0.95 * len(got) and all(0 <= r.severity <= 3 for r in got)
    assert toxicity.score_toxicity(odd, model).count() == len(ODD) and toxicity.score_toxicity(none, model).count() == 0
    assert not toxicity.score_toxicity(odd, toxicity.fit_toxicity(none, labels.limit(0))).first().toxic


def test_ordinal_gradient_lowers_the_loss_and_orders_the_grades():
    rng = np.random.default_rng(2)
    grade = rng.integers(0, 4, 300)
    w, cuts = toxicity.fit_ordinal(np.arange(300), np.zeros(300, np.int64), grade + rng.normal(0, 0.3, 300), grade, 1)
    assert w[0] > 0 and (np.diff(cuts) > 0).all()


# ---- rules
def test_rules_against_sql(spark, duck):
    from conftest import same_rows

    same_rows(queries.op6_quality_rules(spark, SMALL), duck.sql(rules.oracle()))
    same_rows(queries.op4_ngram_jaccard_join(spark, SMALL), duck.sql(queries.ORACLE_SQL["op4_ngram_jaccard_join"]))


def test_rule_statistics_against_counting(odd, none, spark, labels):
    texts = [(i, t) for i, t in ODD if i is not None] + [(20, "a b c a b c d\nx\n\nx\ny"), (21, "a a a a"), (22, "#1 $2 ok\n ok")]
    df = spark.createDataFrame(texts, DOCS)
    got = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rules.base_statistics(df).collect()}
    want = set()
    for i, t in texts:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        twice = {g for g in set(grams) if len(w) < 2000 and grams.count(g) > 1 or len(w) >= 2000}
        cover = {k + d for k, g in enumerate(grams) if g in twice for d in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want.add((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover)))
    assert got == want
    assert rules.apply_rules(odd, labels).count() == len(ODD) and rules.apply_rules(none, labels).count() == 0


def test_binomial_tail(spark):
    from math import comb

    rows = [(k, n) for n in (1, 10, 700) for k in (0, 1, 5) if k <= n]
    df = spark.createDataFrame(rows, "k long, n long").withColumn("p", rules.binomial_tail(F.col("k"), F.col("n"), 0.01))
    for r in df.collect():
        assert r.p == pytest.approx(sum(comb(r.n, i) * 0.01**i * 0.99 ** (r.n - i) for i in range(r.k + 1)))


# ---- substring dedup
def test_repeated_passage_goes_from_all_but_the_first(spark):
    passage = "The old mill stood by the river for years. Nobody knew who had built it there. Its wheel still turned in spring, slowly and loudly. Children played near it in the long evenings of June. Then one winter it was gone."
    own = [f"Text {i} begins with words of its own {i}. It goes on in its own way {i * 7}." for i in range(4)]
    rows = [(i, f"{own[i]} {passage} And so ends number {i}.") for i in range(4)] + [(9, "A clean text. With nothing to share."), (10, None)]
    got = {r.doc_id: r for r in substring.remove_repeats(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[0].text == rows[0][1] and got[9].text == rows[4][1] and got[10].text is None
    for i in (1, 2, 3):
        assert "mill" not in got[i].text and "winter" not in got[i].text and own[i] in got[i].text and f"number {i}" in got[i].text


def test_spans_are_minimal_runs():
    parts = [(0, 0, "", n) for n in (12, 12, 12, 5, 30, 1)]
    assert substring.spans(parts, min_words=20) == [(0, 1), (1, 2), (1, 3), (2, 4), (3, 4), (4, 5)]
    assert substring.spans([(0, 0, "", 90)]) == []
    text = "One two. Three 3.14 four!  Five\nsix\n\n" + "w " * 90
    assert "".join(text[a:b] for a, b, *_ in substring.sentences(text)) == text
    assert [n for *_, n in substring.sentences(text)][:4] == [2, 3, 1, 1]


def test_passages_planted_in_mid_sentence_go(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    marks = lambda: rng.choice(["", "", "", "", "", ",", ".", '."', "?"])
    rows, passages = [], []
    for k in range(60):
        sparse = k % 2  # every other passage and its hosts have no sentence end at all
        text = lambda n, sparse=sparse: [word() + ("" if sparse else marks()) for _ in range(n)]
        passage = [f"{w[:5]}q{k}{w[5:]}" for w in text(51 + k % 30)]
        passages.append(passage)
        for at in (0, 1000):
            rows.append((at + k, " ".join([*text(rng.randint(3, 90)), *passage, *text(rng.randint(3, 90))])))
    got = {r.doc_id: r for r in substring.remove_repeats(spark.createDataFrame(rows, DOCS)).collect()}
    for k, passage in enumerate(passages):
        before = dict(rows)[1000 + k].split()
        left = got[1000 + k].text.split()
        assert got[k].text == dict(rows)[k] and got[k].n_removed == 0
        assert sum(f"q{k}" in w for w in left) <= 2 * substring.PIECE  # what escapes at the two ends
        assert [w for w in left if f"q{k}" not in w] == [w for w in before if f"q{k}" not in w]
        assert got[1000 + k].removed_words == len(before) - len(left)


def test_pieces_of_odd_texts():
    cjk = "天地玄黄。宇宙洪荒！日月盈昃？end."
    assert [w for *_, w, _ in substring.sentences(cjk)] == ["天 地 玄 黄 。", "宇 宙 洪 荒 ！", "日 月 盈 昃 ？", "end."]
    assert [w for *_, w, _ in substring.sentences('Say "no." (Or yes!) »So.» then” ok.” z')] == ['Say "no."', "(Or yes!)", "»So.»", "then” ok.”", "z"]
    for text in [*_fuzz(), cjk * 9, "\n \n a.\n\n b \n", LONG]:
        p = substring.sentences(text)
        assert "".join(text[a:b] for a, b, *_ in p) == (text if p else "") and all(1 <= n <= substring.PIECE for *_, n in p if "。" not in text)


def test_substring_edges(odd, none):
    rows = substring.remove_repeats(odd).collect()
    assert len(rows) == len(ODD) and {r.doc_id: r.text for r in rows}[4] == "one"
    assert set(rows[0].asDict()) == {*odd.columns, "n_sentences", "n_removed", "removed_words"}
    assert substring.remove_repeats(none).count() == 0


# ---- pages
PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li></ul></nav>
<div class="ad">Buy {i}!</div><article><h1>Title {i}</h1><p><b>First &amp; foremost {i}.<br><p>Second&nbsp;  block
 {i}</p><aside>side {i}</aside><form><p>mail?</p></form></article><div class="comments"><p>reader {i}</p></div><footer>&copy; us</footer>"""


def test_main_text_of_pages(spark):
    rows = [(i, f"http://h{i % 2}.example.com/{i}", PAGE.format(i=i)) for i in range(8)] + [(90, None, None), (91, "http://h0.example.com/", ""), (92, "http://[", "<p>loose")]
    got = {r.page_id: r for r in html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))).collect()}
    for i in range(8):
        assert got[i].text == f"Title {i}\n\nFirst & foremost {i}.\n\nSecond block {i}" and got[i].n_chars == len(got[i].text)
    assert got[90].text == got[91].text == "" and got[92].text == "loose"
    assert html.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_template_text_of_pages_of_plain_blocks_goes(spark):
    page = lambda i: (
        "<html><body><div><p>Start here</p><p>All topics</p><p>Write to us</p></div>" + ("<div><p>A notice on some pages.</p></div>" if i % 2 == 0 else "")
        + f"<div><p>Title {i}</p><p>Body {i} of words. {'w%d ' % i * 20}</p><p>Shared by two {i // 2}</p></div><table><tr><td>Side box</td></tr></table><div>Made by the same hands, all rights kept.</div></body></html>"
    )
    rows = [(i, f"http://plain.example.com/{i}", page(i)) for i in range(12)]
    rows += [(100 + i, f"http://plain.example.com/copy?{i}", page(0)) for i in range(9)]  # copies of a page are no template
    rows += [(200 + i, "http://few.example.com/", page(i)) for i in range(3)]
    got = {r.page_id: r.text for r in html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in [*range(12), *range(100, 109)]:
        k = i if i < 100 else 0
        assert got[i] == f"Title {k}\n\nBody {k} of words. {('w%d ' % k * 20).strip()}\n\nShared by two {k // 2}"
    assert got[200].startswith("Start here") and got[200].endswith("rights kept.")  # too few pages to tell


@pytest.mark.parametrize("page", [
    '<body class="has-sidebar">{}</body>', '<body class="comments-open no-sidebar sidebar">{}</body>', '<html class="menu">{}</html>', '<div id="page" class="with-nav">{}</div>',
    '<form id="aspnet"><div class="content">{}</div></form>', '<div class="widget banner">{}</div>',
])
def test_a_block_that_holds_the_article_stays(page):
    for article in ('<article class="post related">{}</article>', '<main class="search">{}</main>', '<div role="main">{}</div>'):
        inner = article.format('<div class="post-header"><h1>Title</h1></div><p>Text.</p><div class="comments"><p>reader</p></div><div class="share-links">x</div>')
        text = page.format('<nav>n</nav><div class="site-header">h</div><div class="main-nav">m</div><div id="cookie_banner">c</div>' + inner + '<div class="sidebar-left">s</div>')
        assert html.extract(text, html.infer([text])) == "Title\n\nText."
    plain = page.format("<p>Text.</p>")  # no article: body, html and odd words say nothing
    if "widget" not in page and "form" not in page:
        assert html.extract(plain, html.infer([plain])) == "Text."
    aside = '<body><div class="content"><p>Text.</p><article>Own</article></div><div class="related"><article>Teaser</article></div></body>'
    assert html.extract(aside, html.infer([aside])) == "Own"


def test_pages_nested_below_the_depth_of_the_tree():
    for depth in (3, 36, 37, 38, 39, 45, 400):
        inner = "<div>" * depth + "<div>deep one<nav><div>n</div></nav><div class='comments'><div>c</div><p>d</p></div><div>two</div>three</div>" + "</div>" * depth
        text = f"<body><article><p>Before.</p><div>{inner}</div><p>After.</p></article><div>beside</div></body>"
        assert html.extract(text, html.infer([text])) == "Before.\n\ndeep one\n\ntwo\n\nthree\n\nAfter.", depth
        text = "<div>" * depth + "<p>x</p><article>a<aside>s</aside><div>b</div><header>c</header></article><div>y</div>" + "</div>" * depth + "z"
        assert html.extract(text, html.infer([text])) == "a\n\nb\n\nc", depth


def test_wrapper_is_a_union_free_expression():
    w = html.infer(["<div><h1>A</h1><p>x</p><p>y</p></div>", "<div><h1>A</h1><ul><li>k</li></ul><p>z</p></div>"])
    assert html.to_regex(w) == "<page><div><h1>A</h1>(<p>x</p>)?(<ul><li>k</li></ul>)?<p>#text</p></div></page>"
    w = html.infer(["<div><h1>A</h1><p>x</p><p>y</p></div>", "<div><h1>A</h1><p>x</p><p>z</p><p>u</p></div>", "<div><h1>A</h1><ul><li>k</li></ul><p>v</p></div>"])
    assert html.to_regex(w) == "<page><div><h1>A</h1>(<p>x</p>)?(<ul><li>k</li></ul>)?(<p>#text</p>)+</div></page>"


# ---- pipeline
def test_pipeline_stages_keep_their_promises(spark, docs, labels):
    import corpus_pipeline as pipe

    good = pipe.quality_stage(spark, docs, SMALL)
    assert good.columns == docs.columns
    model = quality.fit_quality(docs, labels)
    want = {r.doc_id for r in quality.score_quality(docs, model).where("predicted = 1").collect()}
    assert {r.doc_id for r in good.collect()} == want
    once = pipe.near_duplicate_stage(spark, docs, SMALL)
    comps = {r.component_id for r in ngram_join.jaccard_components(docs, 5, 80).collect()}
    assert {r.doc_id for r in once.collect()} == comps and once.columns == docs.columns
    cleaned = pipe.substring_stage(spark, docs, SMALL)
    assert cleaned.columns == docs.columns and all(r.n_chars == len(r.text or "") for r in cleaned.collect())
    out = pipe.run(spark, SMALL)
    assert out.count() > 0 and [n for n, _ in pipe.STAGES][-1] == "packing"
