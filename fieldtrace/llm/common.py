"""Helpers shared by the operators of this subpackage: plans, paths, vectorised word hashing."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text hashed at once; bounds the work arrays of a task (about 40 bytes each).
BLOCK_BYTES = 1 << 19
#: Bytes of an Arrow batch that a Python worker takes up at once.
SLICE_BYTES = 4 << 20
#: Rows of a broadcast id list; above it the same join is shuffled.
BROADCAST_ROWS = 1_000_000
#: Shares that a hot key is dealt to where a join is salted.
SALTS = 16
#: Shares that rows with a null key are dealt to.
NULL_SHARES = 4096

_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: dict[str, np.ndarray] = {}
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session. A local session that names none (tests) gets one of its own; a cluster must name it."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        if not context.getCheckpointDir():
            context.setCheckpointDir(named)
        return named
    if not context.getCheckpointDir():
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(os.path.join(tempfile.gettempdir(), "fieldtrace-checkpoints"))
    return context.getCheckpointDir()


def _own_folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/fieldtrace-{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's part of the shared folder, for a table that is written once and read again."""
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def clean_shared(spark: SparkSession) -> bool:
    """Delete all tables that this application's operators wrote to the shared folder, once no result of theirs is read any more.

    Results are lazy, so operators cannot do it themselves. Checkpoints go by ``spark.cleaner.referenceTracking.cleanCheckpoints``.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder, so a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def write_shared(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(columns: list[str], name: str) -> str:
    """``name``, lengthened until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def attach(df: DataFrame, few: DataFrame, key: str, rows: int, spread: str) -> DataFrame:
    """``df`` left-joined to ``few`` (``rows`` distinct keys): broadcast while that is short, beyond it with every key salted by ``spread``."""
    if rows <= BROADCAST_ROWS:
        return df.join(F.broadcast(few), key, "left")
    salt = unused([*df.columns, *few.columns], "salt")
    left = df.withColumn(salt, F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    return left.join(few.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [key, salt], "left").drop(salt)


def left_by(df: DataFrame, few: DataFrame, key: str, spread: str, how: str) -> DataFrame:
    """``df`` joined to ``few`` ('left' or 'left_anti') by ``key``, which is never null in ``few``. Rows with a null key match nothing; they are dealt out by ``spread``
    instead of all meeting in one task."""
    salt = unused([*df.columns, *few.columns], "salt")
    dealt = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(spread), F.lit(NULL_SHARES)).cast("int") + 1).otherwise(0)
    return df.withColumn(salt, dealt).join(few.withColumn(salt, F.lit(0)), [key, salt], how).drop(salt)


def keep_by_id(df: DataFrame, ids: DataFrame, key: str | list[str], rows: int) -> DataFrame:
    """``df`` rows whose ``key`` is in ``ids`` (``rows`` distinct keys): broadcast while the list is small, shuffled beyond."""
    return df.join(F.broadcast(ids) if rows <= BROADCAST_ROWS else ids.hint("shuffle_hash"), key, "left_semi")


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow`` with Arrow batches of about SLICE_BYTES, on the JVM's side too, unless the session has a size of its own."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name) == "67108864b":  # Spark's default
        conf.set(name, SLICE_BYTES)
    return df.mapInArrow(run, schema)


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut into runs of rows of about SLICE_BYTES, so that a worker never holds a whole batch as Python objects.

    When a task's batches end, memory that its worker no longer uses goes back to the system: workers live on, and would
    otherwise keep the most that any stage took.
    """
    for batch in batches:
        rows = max(1, int(batch.num_rows * SLICE_BYTES // max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    _POWERS.clear()
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def text_blocks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Index ranges of ``texts`` whose sizes stay near BLOCK_BYTES (one long text makes a range of its own)."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        n = 0 if t is None else len(t)
        if size and size + n > BLOCK_BYTES:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, BLOCK_BYTES * 2)
        base = np.uint64(_ODD)
        inverse = np.uint64(pow(_ODD, -1, 1 << 64))
        with np.errstate(over="ignore"):
            up = np.full(size, base, dtype=np.uint64)
            down = np.full(size, inverse, dtype=np.uint64)
            up[0] = down[0] = 1
            np.multiply.accumulate(up, out=up)
            np.multiply.accumulate(down, out=down)
        if size > BLOCK_BYTES * 8:  # a giant text: do not keep its tables
            return up, down
        _POWERS["up"], _POWERS["down"] = up, down
    return _POWERS["up"], _POWERS["down"]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str | None], lower: bool = False, outside: np.ndarray = _WHITE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, and where each text's words begin (one more entry at the end). Words are runs of
    bytes not marked in ``outside`` (which must mark the line end): ``[^\\x20\\x09-\\x0D]+`` unless another table is given.

    A word's hash is a polynomial of its bytes taken as a difference of prefix sums modulo 2**64, then mixed with its length.
    """
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    lens = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    buf = np.frombuffer(b"\n".join([*raw, b""]), dtype=np.uint8)
    if lower:
        buf = _LOWER[buf]
    inside = np.empty(len(buf) + 1, dtype=bool)
    inside[0] = False
    np.logical_not(outside[buf], out=inside[1:])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[0::2], edges[1::2]
    up, down = _powers(len(buf) + 1)
    with np.errstate(over="ignore"):
        sums = np.empty(len(buf) + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * down[starts]
        h = mix64(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    offsets = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum(lens + 1, out=offsets[1:])
    return h, np.searchsorted(starts, offsets)


def shingle_hashes(texts: list[str | None], n: int, lower: bool = False) -> Iterator[np.ndarray]:
    """Per text the 64-bit hashes of its ``n``-word shingles in text order; fewer words than ``n``: the whole sequence as one; no word: none."""
    for a, b in text_blocks(texts):
        h, first = word_hashes(texts[a:b], lower)
        with np.errstate(over="ignore"):
            keys = mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_ODD)) | np.uint64(1)  # unrelated odd multipliers
            if len(h) >= n:
                total = h[: len(h) - n + 1] * keys[0]
                for j in range(1, n):
                    total = total + h[j : len(h) - n + 1 + j] * keys[j]
                full = mix64(total)
            else:
                full = np.empty(0, dtype=np.uint64)
            for i in range(b - a):
                s, e = first[i], first[i + 1]
                if e - s >= n:
                    yield full[s : e - n + 1]
                elif e > s:
                    x = np.uint64(e - s)
                    for j in range(e - s):
                        x = x + h[s + j] * keys[j]
                    yield mix64(np.array([x], dtype=np.uint64))
                else:
                    yield np.empty(0, dtype=np.uint64)


def shingle_sets(texts: list[str | None], n: int, lower: bool = False) -> Iterator[np.ndarray]:
    """Per text its distinct shingle hashes, ascending."""
    for s in shingle_hashes(texts, n, lower):
        if len(s) > 1:
            s = np.sort(s)
            keep = np.empty(len(s), dtype=bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            s = s[keep]
        yield s
