"""MinHash fingerprints of texts, their likeness, and near-duplicate classes by signature bands.

The signature has PERMUTATIONS components. Component j is the least value of a multiply-shift universal hash of the
text's shingle hashes; two texts agree in a component with probability equal to the Jaccard similarity of their sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ngram_join
from .common import cut, keep_by_id, map_arrow, mix64, shingle_hashes, shingle_sets, slices, write_shared
from .components import connected_components

PERMUTATIONS = 128
#: Bytes of text that one range of ids holds on average at most.
SLOT_BYTES = 64 << 20
#: Shingles hashed by one vectorised step; keeps its arrays in a core's cache.
STEP = 8192


def multipliers(count: int = PERMUTATIONS, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of the permutations, from a fixed seed."""
    with np.errstate(over="ignore"):
        x = mix64(np.arange(1, 2 * count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    return x[:count] | np.uint64(1), x[count:]


def signatures(shingles: list[np.ndarray], count: int = PERMUTATIONS) -> np.ndarray:
    """(texts, count) uint32 signatures; an empty set has the greatest value everywhere."""
    a, b = multipliers(count)
    out = np.full((len(shingles), count), 0xFFFFFFFF, dtype=np.uint32)
    lens = np.fromiter(map(len, shingles), dtype=np.int64, count=len(shingles))
    full = np.flatnonzero(lens)
    if not len(full):
        return out
    flat = np.concatenate([shingles[i] for i in full])
    bounds = np.concatenate([[0], np.cumsum(lens[full])])
    with np.errstate(over="ignore"):
        for at in range(0, len(flat), STEP):
            part = flat[at : at + STEP]
            lo = int(np.searchsorted(bounds, at, side="right")) - 1
            hi = int(np.searchsorted(bounds, at + len(part), side="left"))
            begins = np.maximum(bounds[lo:hi] - at, 0)
            rows = full[lo:hi]
            least = np.empty((count, len(begins)), dtype=np.uint32)
            for j in range(count):
                values = ((part * a[j] + b[j]) >> np.uint64(32)).astype(np.uint32)
                least[j] = np.minimum.reduceat(values, begins)
            out[rows] = np.minimum(out[rows], least.T)
    return out


def text_signatures(texts: list[str | None], words: int = 5, count: int = PERMUTATIONS) -> np.ndarray:
    """Signatures of whole texts over their ``words``-word shingles (A-Z lower-cased)."""
    return signatures(list(shingle_hashes(texts, words, lower=True)), count)


def fingerprint_text(signature: np.ndarray) -> list[str]:
    """Hex of the low 16 bits of every component (two components of unequal value agree there once in 65536)."""
    low = (signature & np.uint32(0xFFFF)).astype(">u2")
    return [row.tobytes().hex() for row in low]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal components, row by row."""
    return (a == b).mean(axis=1)


def edited(text: str, following: str) -> str:
    """``text`` with its last floor(n/4) code points replaced by the first as many (or all) of ``following``."""
    cut_at = len(text) // 4
    return text[: len(text) - cut_at] + following[:cut_at]


def _bounds(ids: DataFrame, parts: int) -> list[int]:
    """At most ``parts`` - 1 ascending cut points of the ids (driver holds these alone), each within a quarter of a range of its place."""
    points = ids.stat.approxQuantile("doc_id", [i / parts for i in range(1, parts)], min(0.001, 0.25 / parts)) if parts > 1 else []
    return sorted({int(p) for p in points})


def slots_for(docs: DataFrame) -> int:
    """Ranges of ids to cut the texts into: as many as the session's shuffle partitions, and more where these would pass SLOT_BYTES."""
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string"))).alias("n")).first()["n"] or 0
    return max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SLOT_BYTES))


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """(slot, doc_id, text, head) rows to be read slot by slot in id order; ``head`` marks the row that follows the slot's last.

    Slots are ranges of ids. The first row of each range goes to its own slot and, as head, to the slot before (that of
    the first range to the last slot). Order: id, then text; null ids first, null texts as empty.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    cuts = _bounds(docs.select("doc_id").where("doc_id is not null"), parts)
    table = F.array(*[F.lit(c).cast("long") for c in cuts])
    slot = F.coalesce(F.size(F.filter(table, lambda c: c <= F.col("doc_id"))), F.lit(0)) if cuts else F.lit(0)
    placed = docs.withColumn("slot", slot)
    # a head is the least (id, text) of its slot: found by id first, ties by text within the id
    heads = placed.groupBy("slot").agg(F.min(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("low")).orderBy("slot").collect()
    if not heads:
        return placed.select("slot", "doc_id", "text", F.lit(False).alias("head"))
    slots = [r["slot"] for r in heads]
    before = {r["low"]: slots[i - 1] for i, r in enumerate(heads)}
    lows = F.create_map(*[x for k, v in before.items() for x in (F.lit(k), F.lit(v))])
    own = placed.withColumn("before", F.element_at(lows, F.coalesce("doc_id", F.lit(-(1 << 63)))))
    spread = F.when(F.col("before").isNull(), F.array(F.struct(F.col("slot").alias("slot"), F.lit(False).alias("head")))).otherwise(
        F.array(F.struct(F.col("slot").alias("slot"), F.lit(False).alias("head")), F.struct(F.col("before").alias("slot"), F.lit(True).alias("head")))
    )
    return own.select("doc_id", "text", F.explode(spread).alias("to")).select("to.slot", "doc_id", "text", "to.head")


def fingerprint_documents(docs: DataFrame, words: int = 5) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likenesses.

    -> ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``, one row per input row.
    The next document is the next row by (id, text), after the last the first; a single row follows itself. Null texts
    count as empty; null ids come first. Texts without words have the empty set's fingerprint, whose likeness to itself
    is 1. Other columns are ignored. An empty table gives an empty result.
    """
    parts = slots_for(docs)
    rows = with_next(docs, parts).repartitionById(parts, "slot").sortWithinPartitions("slot", "head", F.col("doc_id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the slot, id, text and signature that wait for their next row
        done: int | None = None  # slot whose head has been used
        for batch in slices(batches):
            slot, ids, texts, head = (batch.column(i).to_pylist() for i in range(4))
            for at in range(0, len(texts), 256):
                part = texts[at : at + 256]
                sign = text_signatures(part, words)
                out: list[tuple] = []
                for i, text in enumerate(part):
                    r = at + i
                    if held is not None and held[0] == slot[r] and done != slot[r]:
                        out.append((*held[1:], text, sign[i]))
                    if head[r]:
                        done, held = slot[r], None
                    else:
                        held = (slot[r], ids[r], text, sign[i])
                if out:
                    yield _finish(out, words)

    return map_arrow(
        rows.select("slot", "doc_id", "text", "head"), run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )


def _finish(rows: list[tuple], words: int) -> pa.RecordBatch:
    ids, texts, signs, following, next_signs = zip(*rows, strict=True)
    changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
    own, nxt, new = (s & np.uint32(0xFFFF) for s in (np.stack(signs), np.stack(next_signs), text_signatures(changed, words)))  # what fingerprints show
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]),
            pa.array(fingerprint_text(own)), pa.array(fingerprint_text(new)), pa.array(likeness(own, new)), pa.array(likeness(own, nxt)),
        ],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def near_duplicate_classes(docs: DataFrame, words: int = 5, threshold: float = 0.8, bands: int = 32) -> DataFrame:
    """Near-duplicate classes: signature bands joined in Spark, Jaccard of the shingle sets verified.

    -> ``doc_id, class_id``: one row per distinct non-null id. Copies collapse first. Every pair of texts that share a band is
    verified: they meet under the smallest id of a bucket, and large meetings in parts, as in the n-gram join. Verified links
    make the classes. Texts without words stay alone; texts of a repeated id are one node.
    """
    base = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows, percent = PERMUTATIONS // bands, round(threshold * 100, 9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = list(shingle_sets(batch.column(1).to_pylist(), words, lower=True))
            sign = signatures(sets)
            keys = np.zeros((len(sets), bands), dtype=np.uint64)
            with np.errstate(over="ignore"):
                for j in range(rows):
                    keys = mix64(keys * np.uint64(31) + sign[:, j::rows][:, :bands] + np.uint64(j))
                keys = mix64(keys + np.arange(bands, dtype=np.uint64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([ngram_join.digest_of(s.tobytes()) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([k.view(np.int64).tolist() if len(s) else [] for k, s in zip(keys, sets, strict=True)], pa.list_(pa.int64())),
                ],
                names=["doc_id", "digest", "n", "bands"],
            )

    keyed = write_shared(map_arrow(base, run, "doc_id long, digest binary, n long, bands array<long>"), "minhash-bands").where("n > 0")
    classes = cut(keyed.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands")))
    lists = classes.select(F.col("rep").alias("doc_id"), "n", F.explode("bands").alias("band"))
    heads = lists.groupBy("band").agg(F.min("doc_id").alias("z"), F.max("doc_id").alias("last")).where("z < last").select("band", "z")
    meets = cut(lists.join(heads, "band").select("z", "doc_id", "n").distinct())
    busy = cut(meets.select("doc_id").distinct())
    # every pair of a bucket is a candidate: one probe that all share
    members = ngram_join.full_sets(keep_by_id(base, busy, "doc_id", busy.count()), words).join(classes.select(F.col("rep").alias("doc_id"), "digest", "n"), ["doc_id", "digest"])
    members = members.dropDuplicates(["doc_id", "digest"]).select("doc_id", "n", F.lit(1).alias("k"), F.array(F.lit(0).cast("long")).alias("probe"), "shingles")
    links = ngram_join.meeting_links(meets, write_shared(members, "minhash-members"), min(percent, 99.99))
    copies = keyed.join(classes.select("digest", "rep"), "digest").where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    parts = connected_components(links.unionByName(copies))
    every = base.select("doc_id").distinct()
    return every.join(parts, every["doc_id"] == parts["node"], "left").select("doc_id", F.coalesce("component", "doc_id").alias("class_id"))
