"""Array scans of text columns: words, word hashes and window hashes over Arrow buffers.

A batch of texts is one byte buffer with offsets, so words, hashes and windows
of many documents come from a few numpy passes with no loop over words. Memory
is bounded by the slice (``SLICE`` bytes of text, or one longer text).
"""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass takes.
SLICE = 2 << 20
#: Rows and bytes of an Arrow batch, where the session sets none.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}
#: Bytes whose prefix sums are held at once.
PIECE = 1 << 19
#: Stands for a null key; a key of this value counts as null.
NO_KEY = -(1 << 63)

_U = np.uint64


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit finaliser, so that every bit of the input reaches every bit of the output."""
    x = x ^ _U((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BASE = _U(0xD1342543DE82EF95)
_TABLE = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.concatenate((np.ones(1, _U), np.cumprod(np.full(n, base, _U))))


_POW = _powers(_BASE, PIECE)
_INV = _powers(_U(pow(int(_BASE), -1, 1 << 64)), PIECE)

#: Word bytes: all but ASCII white space.
NON_SPACE = np.ones(256, bool)
NON_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Word bytes: digits, a-z and everything above ASCII (after lowering A-Z).
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Lowers A-Z and nothing else.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; a null is an empty text."""
    texts = texts.fill_null("").cast(pa.large_string()) if isinstance(texts, pa.Array) else texts
    _, offsets, data = texts.buffers()
    o = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    b = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return b[o[0] : o[-1]], o - o[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of the batches with at most ``limit`` bytes of text (or one text): batch, bytes, offsets."""
    for batch in batches:
        data, offsets = buffers(batch.column(text))
        at = 0
        while at < len(offsets) - 1:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to
    trimmed()


def spans(data: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in byte order, and for each text the index of its first word (n + 1 entries)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = word[data]
    edge = np.zeros(n + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[offsets] = True  # a word ends with its text
    edge[0] = edge[n] = True
    cuts = np.flatnonzero(edge)
    keep = inside[cuts[:-1]]
    starts, ends = cuts[:-1][keep], cuts[1:][keep]
    return starts, ends, np.searchsorted(starts, offsets)


def _long(data: np.ndarray, at: int, to: int) -> np.uint64:
    """Hash of one span of any length."""
    total, power = _U(0), _U(1)
    while at < to:
        end = min(to, at + PIECE)
        total = total + power * (_TABLE[data[at:end]] * _POW[: end - at]).sum(dtype=_U)
        power = power * _POW[end - at]
        at = end
    return total


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span's bytes; equal bytes, equal hash, wherever they stand."""
    out = np.empty(len(starts), _U)
    if not len(starts):
        return out
    with np.errstate(over="ignore"):
        for at in range(0, len(data), PIECE):
            to = min(len(data), at + PIECE)
            i, j = np.searchsorted(starts, [at, to])
            inner = int(np.searchsorted(ends[i:j], to, "right")) + i
            if i == j:
                continue
            total = np.empty(to - at + 1, _U)
            total[0] = 0
            np.multiply(_TABLE[data[at:to]], _POW[: to - at], out=total[1:])
            np.cumsum(total, out=total)
            s = starts[i:inner] - at
            out[i:inner] = (total[ends[i:inner] - at] - total[s]) * _INV[s]
            for k in range(inner, j):
                out[k] = _long(data, int(starts[k]), int(ends[k]))
        return mix(out + (ends - starts).astype(_U))


def windows(h: np.ndarray, k: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of each k consecutive entries; len(h) - k + 1 of them (none if there are fewer)."""
    if len(h) < k:
        return np.zeros(0, _U)
    m = len(h) - k + 1
    out, done, part, size, power = None, 0, h, 1, _U(base | 1)
    with np.errstate(over="ignore"):
        while True:  # part: hashes of `size` entries, size a power of two; out: of the first `done`
            if k & size:
                out = part[:m].copy() if out is None else out * power + part[done : done + m]
                done += size
            if size * 2 > k:
                return out
            part = part[:-size] * power + part[size:]
            power, size = power * power, size * 2


def inside(first: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of the windows of k words over n words stay within one text; ``first``: index of each text's first word."""
    m = max(0, n - k + 1)
    ok = np.ones(m, bool)
    if m:
        bad = np.zeros(m + 1, np.int32)
        cuts = np.unique(first[1:-1])
        cuts = cuts[(cuts > 0) & (cuts < n)]
        np.add.at(bad, np.clip(cuts - k + 1, 0, m), 1)
        np.add.at(bad, np.clip(cuts, 0, m), -1)
        ok = np.cumsum(bad[:-1]) == 0
    return ok


def squeezed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with each run of ASCII white space as one space, none at their ends: bytes and offsets."""
    if not len(data):
        return data, offsets
    black = NON_SPACE[data]
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = black[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    before[heads] = False
    keep = black | before  # of a run of white space its first byte, if a word of this text precedes it
    out = np.where(black, data, np.uint8(32))[keep]
    kept = np.concatenate(([0], np.cumsum(keep)))[offsets]
    if len(out):
        lens = np.diff(kept)
        last = np.where(lens > 0, kept[1:] - 1, 0)
        drop = last[(lens > 0) & (out[last] == 32)]
        if len(drop):
            mask = np.ones(len(out), bool)
            mask[drop] = False
            out, kept = out[mask], kept - np.searchsorted(drop, kept, "left")
    return out, kept


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A string array over the bytes."""
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data)))


def trimmed() -> None:
    """Gives memory that a worker no longer uses back to the system; its next task may be of another operator."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def small_batches(df: DataFrame) -> None:
    """Batches of texts that fit a worker beside what it computes; a session's own setting stays."""
    conf = df.sparkSession.conf
    for key, value in BATCH.items():
        if conf.get(key, None) is None:
            conf.set(key, value)


def keyed(docs: DataFrame, key: str, text: str, *more: Column) -> DataFrame:
    """Only what an operator reads, under names of its own: k (a null key as NO_KEY) and t (a null text as empty)."""
    small_batches(docs)
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"), *more)


def unkeyed(name: str = "k") -> Column:
    return F.when(F.col(name) != F.lit(NO_KEY), F.col(name))


def partitions(df: DataFrame, least: int = 1) -> int:
    """Partitions for a shuffle, as the session sets them."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def shared_dir(df: DataFrame) -> None:
    """Checkpoints go to spark.checkpoint.dir. Where it is unset, a local session (tests) gets a folder of its own, removed
    at its end; a cluster session is refused, as its machines share no other folder that is known here."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isEmpty():
        return
    folder = sc.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="tarn-checkpoints-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """The rows, computed once and written to the shared folder, so that nothing before them runs again."""
    shared_dir(df)
    return df.checkpoint()
