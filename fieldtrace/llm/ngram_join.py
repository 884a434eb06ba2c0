"""N-gram Jaccard join with adaptive multi-match prefixes.

Every text becomes the set of its word shingles (64-bit hashes). Two texts link when their sets' Jaccard similarity is
at least ``threshold``. The join is exact and goes through four steps:

1. *Base prefix.* In the order of the hashes, a set of n shingles with overlap bound t = ceil(threshold * n) has a
   prefix of n - t + l shingles; linked sets share at least min(l) of them, l growing with n. One aggregation by
   shingle tells which shingles of the prefixes one text alone has. A text with fewer than l shared ones has no link.
2. *Adaptive prefix.* For the texts that are left, copies collapse to one class. Each class orders its prefix from the
   rarest shingle to the most frequent and picks k, the matches to require: the longer the prefix (k more shingles), the
   more matches. The choice minimises an estimated cost: postings read, plus the candidates that postings / k allows.
3. *Candidates.* Classes meet under the smallest class of a shingle's list. A meeting of at most PART classes is one group. Of a
   larger one, every class first meets only the smallest, in parts; those that link to it are in one component already,
   so pairs among them are not looked at again. The rest is split into bands of set size, of which only equal and
   neighbouring ones can link, and into parts by a hash; parts meet in pairs, so no task holds more than about two. Inside a
   task, pairs of compatible size with k shared prefix shingles are verified on whole sets, and a spanning forest of the
   links leaves the task.
4. *Components* of these links, joined back through the classes to every text.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, cut, keep_by_id, left_by, map_arrow, shingle_sets, slices, unused, write_shared
from .components import connected_components

#: Share of a set that the base prefix adds to the shortest valid one; each shingle added is one more match required.
EXTRA = 0.06
#: Classes that one part of a large meeting holds on average.
PART = 512
#: Cost of verifying a pair, in postings read.
VERIFY_COST = 8.0


def min_overlap(n: int | np.ndarray, percent: int) -> int | np.ndarray:
    """Least overlap of a set of ``n`` with any set that it links to."""
    return -(-(n * percent) // 100)


def matches_required(n: int | np.ndarray) -> int | np.ndarray:
    """l of the base prefix: grows with the set, never less than 1."""
    return 1 + (n * int(EXTRA * 1000)) // 1000


def base_prefix(n: int | np.ndarray, percent: int) -> int | np.ndarray:
    return np.minimum(n, n - min_overlap(n, percent) + matches_required(n))


def digest_of(shingles: bytes) -> bytes | None:
    return hashlib.blake2b(shingles, digest_size=16).digest() if shingles else None


def _sets(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, n, digest of the set, and its base prefix (ascending hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, digest, prefix = [], [], []
            for s in shingle_sets(batch.column(1).to_pylist(), words, lower=True):
                n.append(len(s))
                digest.append(digest_of(s.tobytes()))
                prefix.append(s[: int(base_prefix(len(s), percent))].view(np.int64).copy())  # not a view, which would hold the whole set
            ends = np.zeros(len(n) + 1, dtype=np.int32)
            np.cumsum([len(p) for p in prefix], out=ends[1:])
            flat = np.concatenate(prefix) if prefix else np.empty(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                names=["doc_id", "n", "digest", "prefix"],
            )

    return map_arrow(docs, run, "doc_id long, n long, digest binary, prefix array<long>")


def _adapt(rows: DataFrame, percent: int) -> DataFrame:
    """(doc_id, n, tokens array<struct<df, h>>) -> (doc_id, n, k, probe array<long>) by the cheapest k."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(frames):
            ids, out_n, ks, probes = [], [], [], []
            for i, n, p, df, h in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                df, h = np.array(df, dtype=np.float64), np.array(h, dtype=np.int64)
                order = np.lexsort((h, df))
                df, h = df[order], h[order]
                alone = p - len(h)  # prefix shingles that no other text has come first in the order
                least = int(matches_required(min_overlap(n, percent)))
                keep = p - least + np.arange(1, least + 1) - alone  # shared shingles probed for k = 1, 2, ...
                reads = np.concatenate([[0.0], np.cumsum(df - 1)])[np.clip(keep, 0, len(h))]
                k = int(np.argmin(reads + VERIFY_COST * reads / np.arange(1, least + 1))) + 1
                probe = h[: max(0, int(keep[k - 1]))]
                if len(probe) >= k:
                    ids.append(i), out_n.append(n), ks.append(k), probes.append(probe)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(out_n, pa.int64()), pa.array(ks, pa.int32()), pa.array(probes, pa.list_(pa.int64()))],
                names=["doc_id", "n", "k", "probe"],
            )

    return map_arrow(rows, run, "doc_id long, n long, k int, probe array<long>")


def _first_seats(meets: DataFrame, large: DataFrame, rows: int) -> DataFrame:
    """(z, doc_id, n) -> (z, i, side, doc_id): a small meeting is one group; in a large one each part meets the smallest class alone."""
    seat = lambda i, side: F.struct(i.cast("int").alias("i"), F.lit(side).alias("side"))
    head = F.transform(F.sequence(F.lit(0), F.coalesce("p", F.lit(1)) - 1), lambda i: seat(i, 0))
    seats = F.when(F.col("p").isNull(), F.array(seat(F.lit(0), 0))).when(F.col("doc_id") == F.col("z"), head).otherwise(
        F.array(seat(F.pmod(F.xxhash64("doc_id"), F.col("p").cast("long")), 1))
    )
    return attach(meets, large, "z", rows, "doc_id").select("z", "doc_id", F.explode(seats).alias("s")).select("z", "doc_id", "s.*")


#: Parts of one band and kind that a cell's number has room for.
_PARTS = 1 << 30


def _rest_seats(meets: DataFrame, percent: float, part: int) -> DataFrame:
    """(z, doc_id, n, hooked) -> (z, a, b, side, doc_id): cells a and b meet.

    A cell is a part of the classes of one band of set size that are, or are not, linked to the smallest class. Cells of
    linked classes do not meet each other.
    """
    # linked sets differ in size by at most the threshold, so by one band at most (a hair wider for rounding)
    width = math.log(100 / percent) * (1 + 1e-9)
    rows = meets.withColumn("group", 2 * F.floor(F.log("n") / width).cast("long") + F.col("hooked").cast("long"))
    sizes = cut(rows.groupBy("z", "group").agg(F.ceil(F.count("*") / part).cast("long").alias("p")))
    parts = sizes.groupBy("z").agg(F.map_from_entries(F.collect_list(F.struct("group", "p"))).alias("parts"))  # as many entries as bands
    rows = attach(rows, parts, "z", sizes.count(), "doc_id")
    cells = lambda g: F.transform(F.sequence(F.lit(0).cast("long"), F.try_element_at("parts", g) - 1), lambda x: g * _PARTS + x)
    own = F.col("group") * _PARTS + F.pmod(F.xxhash64("doc_id"), F.try_element_at("parts", F.col("group")))
    near = F.filter(F.map_keys("parts"), lambda g: (F.abs(F.shiftright(g, 1) - F.shiftright(F.col("group"), 1)) <= 1) & ((F.bitwise_not(g) % 2 != 0) | ~F.col("hooked")))
    rows = rows.withColumn("own", own).select("z", "doc_id", "own", F.explode(F.flatten(F.transform(near, cells))).alias("other"))
    return rows.select("z", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), (F.col("own") > F.col("other")).cast("int").alias("side"), "doc_id")


def meeting_links(meets: DataFrame, members: DataFrame, percent: float, part: int = PART) -> DataFrame:
    """(z, doc_id, n), z the smallest class of each meeting, and (doc_id, n, k, probe, shingles) -> (u, v) that join all linked members."""

    def verify(group: pa.Table) -> pa.Table:
        numbers = lambda name: group.column(name).to_numpy()
        probes = [x.values.to_numpy(zero_copy_only=False) for x in group.column("probe")]
        sets = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in group.column("shingles")]
        edges = verify_block(group.column("doc_id").to_pylist(), numbers("side"), numbers("n"), numbers("k"), probes, sets, percent)
        u, v = ([e[k] for e in edges] for k in range(2))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "z": pa.array([group.column("z")[0].as_py()] * len(edges), pa.int64())})

    def links(seats: DataFrame, *keys: str) -> DataFrame:
        return seats.join(members, "doc_id").groupBy("z", *keys).applyInArrow(verify, "u long, v long, z long")

    large = cut(meets.groupBy("z").agg(F.count("*").alias("m")).where(F.col("m") > part).select("z", F.ceil(F.col("m") / part).cast("int").alias("p")))
    rows = large.count()
    first = write_shared(links(_first_seats(meets, large, rows), "i"), "first-links")
    if not rows:
        return first.select("u", "v")
    inside = attach(meets, large, "z", rows, "doc_id").where("p is not null").drop("p")
    linked = first.where("v = z").select("z", F.col("u").alias("doc_id"), F.lit(True).alias("hooked")).distinct()
    marked = cut(inside.join(linked, ["z", "doc_id"], "left").withColumn("hooked", F.coalesce("hooked", F.col("doc_id") == F.col("z"))))
    open_ = marked.where("not hooked").select("z").distinct()  # meetings whose every class hangs on the smallest are done
    rest = marked.join(open_, "z", "left_semi")
    return first.select("u", "v").unionByName(links(_rest_seats(rest, percent, part), "a", "b").select("u", "v"))


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, digest of the set (as in the base prefixes), and the whole set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [s.tobytes() for s in shingle_sets(batch.column(1).to_pylist(), words, lower=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(digest_of, sets), pa.binary()), pa.array(sets, pa.binary())], names=["doc_id", "digest", "shingles"])

    return map_arrow(docs, run, "doc_id long, digest binary, shingles binary")


def forest(ids: list[int], links: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """Star edges (larger, smallest) of the components that ``links`` (positions) make of ``ids``."""
    root = list(range(len(ids)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            if ids[a] > ids[b]:
                a, b = b, a
            root[b] = a
    return [(ids[i], ids[find(i)]) for i in range(len(ids)) if find(i) != i]


def _shared(tokens: list[np.ndarray], left: np.ndarray, right: np.ndarray | None) -> np.ndarray:
    """Matrix of how many tokens each of ``left`` shares with each of ``right`` (with each of ``left`` where that is None)."""
    rows = left if right is None else np.concatenate([left, right])
    flat = np.concatenate([tokens[i] for i in rows])
    owner = np.repeat(np.arange(len(rows)), [len(tokens[i]) for i in rows])
    order = np.argsort(flat, kind="stable")  # owners ascend within a token
    flat, owner = flat[order], owner[order]
    cuts = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1], [True]]))
    out = np.zeros((len(left), len(left) if right is None else len(right)), dtype=np.int32)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if b - a > 1:
            o = owner[a:b]
            if right is None:
                out[np.ix_(o, o)] += 1
            else:
                s = int(np.searchsorted(o, len(left)))
                if 0 < s < b - a:
                    out[np.ix_(o[:s], o[s:] - len(left))] += 1
    return out


def verify_block(ids: list[int], side: np.ndarray, n: np.ndarray, k: np.ndarray, probes: list[np.ndarray], sets: list[np.ndarray], percent: float) -> list[tuple[int, int]]:
    """Links among the classes of a meeting, as star edges.

    ``side`` is 0 or 1; with both present only pairs across the sides are looked at. A pair qualifies with
    compatible sizes and min(k) shared probe shingles, then by its exact overlap.
    """
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if not len(left) or not len(right):
        left, right = np.arange(len(ids)), None
    other = left if right is None else right
    shared = _shared(probes, left, right)
    small, big = np.minimum(n[left][:, None], n[other][None, :]), np.maximum(n[left][:, None], n[other][None, :])
    fits = (shared >= np.minimum(k[left][:, None], k[other][None, :])) & (100 * small >= percent * big)
    if right is None:
        fits = np.triu(fits, 1)
        left = other = left[fits.any(0) | fits.any(1)]
        fits = fits[np.ix_(left, left)]
    else:
        a, b = fits.any(1), fits.any(0)
        left, other, fits = left[a], other[b], fits[np.ix_(a, b)]
    if not len(left):
        return []
    common = _shared(sets, left, None if right is None else other)
    linked = fits & (100 * common >= percent * (n[left][:, None] + n[other][None, :] - common))
    a, b = np.nonzero(linked)
    return forest(ids, zip(left[a].tolist(), other[b].tolist(), strict=True))


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Exact Jaccard join over word shingles -> ``(doc_id, n_shingles, component_id)``, one row per input row.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. ``percent`` is the threshold in hundredths. Null and wordless
    texts have the empty set and link to nothing; texts with fewer words than ``words`` have one shingle; equal sets always
    link. A null id keeps its row, with a null component, and takes no part. Repeated rows of an id are kept; of an id with
    several texts, that with the least digest takes part, the others only find texts equal to theirs. Other columns are
    ignored whatever they are named. An empty table gives an empty result.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sets = write_shared(_sets(base, words, percent), "ngram-sets")
    prefix = F.size("prefix").cast("long")

    # 1. shingles of the base prefixes that one text alone has, counted per text
    seen = sets.where("doc_id is not null").select("doc_id", F.explode("prefix").alias("h")).groupBy("h").agg(
        F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("df")
    )
    alone = seen.where("lo = hi and df = 1").groupBy(F.col("lo").alias("doc_id")).agg(F.count("*").alias("alone"))
    # of an id with several texts one takes part, that of the least digest
    nodes = sets.where("doc_id is not null and n > 0").groupBy("doc_id").agg(F.min(F.struct("digest", "n", prefix.alias("p"))).alias("t")).select("doc_id", "t.*")
    smallest = F.expr(f"-((-n * {percent}) div 100) + if(pmod(n * {percent}, 100) = 0, 0, 1)")  # least size of a partner
    required = F.expr("1 + (s * {}) div 1000".format(int(EXTRA * 1000)))
    able = (
        nodes.withColumn("s", smallest)
        .join(alone, "doc_id", "left")
        .where(F.col("p") - F.coalesce("alone", F.lit(0)) >= required)
    )
    # copies collapse: the smallest id stands for all texts with the same set
    able = cut(able.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("p").alias("p")))
    rows = able.count()

    # 2. rarest-first prefixes of the classes
    own = keep_by_id(sets, able.select("doc_id", "digest"), ["doc_id", "digest"], rows).select("doc_id", "n", "prefix").dropDuplicates(["doc_id"])
    posted = write_shared(own.select("doc_id", "n", prefix.alias("p"), F.explode("prefix").alias("h")), "ngram-posted")
    df = posted.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    known = posted.join(df, "h").groupBy("doc_id").agg(F.first("n").alias("n"), F.first("p").alias("p"), F.collect_list(F.struct("df", "h")).alias("t"))
    probed = cut(_adapt(known.select("doc_id", "n", "p", F.col("t.df").alias("df"), F.col("t.h").alias("h")), percent))

    # 3. classes meet under the smallest class of a shingle's list
    lists = probed.select("doc_id", "n", F.explode("probe").alias("h"))
    heads = lists.groupBy("h").agg(F.min("doc_id").alias("z"), F.max("doc_id").alias("last")).where("z < last").select("h", "z")
    meets = cut(lists.join(heads, "h").select("z", "doc_id", "n").distinct())
    busy = cut(meets.select("doc_id").distinct())
    whole = full_sets(keep_by_id(base, busy, "doc_id", busy.count()), words)
    members = probed.join(able.select("doc_id", "digest"), "doc_id").join(whole, ["doc_id", "digest"]).dropDuplicates(["doc_id"]).drop("digest")
    edges = meeting_links(meets, write_shared(members, "ngram-members"), percent)

    # 4. components of the classes, then of every text
    parts = connected_components(edges)
    classes = nodes.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    named = classes.join(parts, classes["rep"] == parts["node"], "left").select("digest", F.coalesce("component", "rep").alias("component"))
    return left_by(sets, named, "digest", "doc_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")
    )


def keep_first(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``docs``, all columns kept, whose id names its component: one text of each group stays.

    Rows with a null id, null texts and wordless ones all stay; rows that repeat a staying id stay together. Columns may have any
    names. An empty table gives an empty result.
    """
    key = unused(docs.columns, "key")
    gone = jaccard_components(docs, words, percent).where("component_id <> doc_id").select(F.col("doc_id").alias(key)).distinct()
    return left_by(docs.withColumn(key, F.col("doc_id").cast("long")), gone, key, "text", "left_anti").drop(key)


def oracle(words: int, percent: int) -> str:
    """The query over whole tables in DuckDB SQL: shingles as text, all sharing pairs counted, components by recursion."""
    gram = " || ' ' || ".join(f"w[i + {j}]" for j in range(words))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
    WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, {gram} AS g FROM t, unnest(range(1, len(w) - {words - 2})) AS u(i) WHERE len(w) >= {words}
        UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM t WHERE len(w) BETWEEN 1 AND {words - 1}),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
    e AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * o >= {percent} * (p.n + q.n - o)),
    b AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
    r(node, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT b.y, r.c FROM r JOIN b ON b.x = r.node WHERE r.c < b.y)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id
    FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(c) AS c FROM r GROUP BY node) m ON m.node = d.doc_id"""
