"""Substring dedup: removes every word that a repeated window of ``width`` words covers, but for the first occurrence.

Pass 1, count-min prefilter. A window's cell is that of its anchor, the word
n-gram inside it with the smallest hash (leftmost on ties). Each occurrence of a
window has an anchor occurrence of its own, so an anchor's count is never below
the count of any window that has it. Partitions count their anchor occurrences
into a sketch of ``rows`` hash rows with counters that stop at 2; the sketches
are added up cell by cell in the shuffle. Estimates only err upwards, so a
window estimated at 1 is unique and none that repeats is lost.

Pass 2 groups exactly the windows estimated to be repeated, by 96 bits of hash.
Each task keeps the first occurrence of each such window that it sees (one row
a window and task, however often a hot passage occurs) and knows the others to
be repeats at once; reducers compare the tasks' first ones by (key, start).

Pass 3 joins each document with its repeated starts and drops the covered words.

The sketch's width follows the text's size between ``LEAST_CELLS`` and
``MOST_CELLS`` a row (at most 2 x 2**28 bits = 64 MB are broadcast); beyond that
more windows are estimated repeated, and pass 2 is exact all the same.

Defined cases: a null or empty text has no words; fewer words than a window are
all kept; equal (key, start) is not earlier, so repeated rows of one id don't
remove each other (ids are taken to be unique otherwise); a null key sorts first
and comes back null; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm import scan

#: Words of an anchor, hash rows of the sketch, and bounds of its cells a row.
ANCHOR, ROWS, LEAST_CELLS, MOST_CELLS = 8, 2, 1 << 20, 1 << 28
#: Cells whose positions travel in one row.
BLOCK = 1 << 18
#: Windows that a task holds before it passes them on, and anchors before it counts them.
HELD = 1 << 20
_U = np.uint64


def _anchors(h: np.ndarray, first: np.ndarray, width: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows, the anchor of each (index into the next), positions of the anchors, their hashes."""
    n = len(h)
    g = scan.windows(h, size, 0xC2B2AE3D27D4EB4F)
    starts = np.flatnonzero(scan.inside(first, width, n))
    if not len(starts):
        return starts, starts, starts, g[:0]
    span = width - size + 1
    value, place, reach = scan.mix(g, 7), np.arange(len(g)), 1
    val, pos = value, place
    while reach < span:  # smallest of `reach` n-grams from here on; leftmost on ties
        step = min(reach, span - reach)
        less = val[step:] < val[:-step]
        pos = np.where(less, pos[step:], pos[:-step])
        val = np.where(less, val[step:], val[:-step])
        reach += step
    chosen, index = np.unique(pos[starts], return_inverse=True)
    return starts, index, chosen, value[chosen]


def _cells(anchor: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (scan.mix(anchor, row + 11) >> _U(64 - bits)).astype(np.int64)


def _counted(parts: list[np.ndarray], rows: int, bits: int) -> Iterator[pa.RecordBatch]:
    anchor = np.concatenate(parts)
    block = min(BLOCK, 1 << bits)
    for row in range(rows):
        cell = np.sort(_cells(anchor, row, bits))
        head = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
        many = np.diff(np.append(head, len(cell))) > 1
        cell = cell[head]
        cut = np.searchsorted(cell, np.arange(0, (1 << bits) + 1, block))
        full = np.flatnonzero(np.diff(cut))
        one = [(cell[cut[b] : cut[b + 1]] % block).astype(np.uint32).tobytes() for b in full]
        two = [np.packbits(many[cut[b] : cut[b + 1]]).tobytes() for b in full]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(full), row, np.int32)), pa.array(full.astype(np.int32)), pa.array(one, pa.binary()), pa.array(two, pa.binary())], ["r", "b", "cells", "many"])


def repeated_cells(keyed: DataFrame, width: int, size: int, rows: int, bits: int) -> np.ndarray:
    """For each hash row the bit map of cells counted twice or more over all partitions; rows x 2**bits bits."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for _, data, offsets in scan.slices(batches, "t"):
            starts, ends, first = scan.spans(data, offsets, scan.NON_SPACE)
            anchors = _anchors(scan.word_hashes(data, starts, ends), first, width, size)[3]
            held.append(anchors)
            total += len(anchors)
            if total > HELD:
                yield from _counted(held, rows, bits)
                held, total = [], 0
        if total:
            yield from _counted(held, rows, bits)

    block = min(BLOCK, 1 << bits)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for r, b, cells, many in zip(*(batch.column(c).to_pylist() for c in ("r", "b", "cells", "many")), strict=True):
                at = np.frombuffer(cells, np.uint32)
                held = sums.setdefault((r, b), np.zeros(block, np.uint8))
                held[at] = np.minimum(2, held[at] + 1 + np.unpackbits(np.frombuffer(many, np.uint8), count=len(at)))
        for (r, b), held in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([b], pa.int32()), pa.array([np.packbits(held > 1).tobytes()], pa.binary())], ["r", "b", "map"])

    counted = keyed.mapInArrow(count, "r int, b int, cells binary, many binary")
    merged = counted.repartition(scan.partitions(keyed), "r", "b").mapInArrow(add, "r int, b int, map binary")
    out = np.zeros((rows, (1 << bits) // 8), np.uint8)
    for r, b, held in merged.collect():
        out[r, b * block // 8 : (b + 1) * block // 8] = np.frombuffer(held, np.uint8)
    return out


def _firsts(order_key: np.ndarray, start: np.ndarray, h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the first occurrence of each window, and of the later ones (not those equal to the first)."""
    order = np.lexsort((start, order_key, g, h))
    hs, gs = h[order], g[order]
    head = np.concatenate(([True], (hs[1:] != hs[:-1]) | (gs[1:] != gs[:-1])))
    lead = order[np.flatnonzero(head)][np.cumsum(head) - 1]
    later = (order_key[order] != order_key[lead]) | (start[order] != start[lead])
    return order[head], order[later]


def _by_key(k: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    order = np.lexsort((s, k))
    k, s = k[order], s[order].astype(np.int32)
    head = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
    return k[head], [x.tobytes() for x in np.split(s, head[1:])] if len(k) else []


def repeated_starts(keyed: DataFrame, cells: np.ndarray, width: int, size: int) -> DataFrame:
    """k and s (binary int32): starts of windows that also start earlier, one row for each key that has any."""
    spark = keyed.sparkSession
    rows, bits = cells.shape[0], (cells.shape[1] * 8).bit_length() - 1
    shared = spark.sparkContext.broadcast(cells)
    parts = scan.partitions(keyed)

    def estimated(anchor: np.ndarray) -> np.ndarray:
        ok = np.ones(len(anchor), bool)
        for row in range(rows):
            c = _cells(anchor, row, bits)
            ok &= (shared.value[row][c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 == 1
        return ok

    schema = "p int, h binary, g binary, k binary, s binary"

    def passed(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        h, g, k, s = (np.concatenate(x) for x in zip(*held, strict=True))
        first, later = _firsts(k, s, h, g)
        to = ((h[first] >> _U(33)) % _U(2 * parts)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        first, to = first[order], to[order]
        cut = np.searchsorted(to, np.arange(2 * parts + 1))
        full = np.flatnonzero(np.diff(cut))
        each = [first[cut[p] : cut[p + 1]] for p in full]
        if each:
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), *(pa.array([x[i].tobytes() for i in each], pa.binary()) for x in (h, g, k, s.astype(np.int32)))], ["p", "h", "g", "k", "s"])
        for at in range(0, len(later), 1 << 14):  # no hash: known to be repeats
            i = later[at : at + (1 << 14)]
            yield pa.RecordBatch.from_arrays([pa.array([int(scan.mix(np.array([k[i[0]] + 7919 * s[i[0]] + at]).view(_U), 13)[0] % _U(2 * parts))], pa.int32()), pa.array([None], pa.binary()), pa.array([None], pa.binary()), pa.array([k[i].tobytes()], pa.binary()), pa.array([s[i].astype(np.int32).tobytes()], pa.binary())], ["p", "h", "g", "k", "s"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch, data, offsets in scan.slices(batches, "t"):
            starts, ends, first = scan.spans(data, offsets, scan.NON_SPACE)
            h = scan.word_hashes(data, starts, ends)
            at, index, _, anchor = _anchors(h, first, width, size)
            at = at[estimated(anchor)[index]]
            if not len(at):
                continue
            doc = np.searchsorted(first, at, "right") - 1
            keys = batch.column("k").to_numpy(zero_copy_only=False)
            held.append((scan.windows(h, width)[at], (scan.windows(scan.mix(h, 3), width, 0xA0761D6478BD642F)[at] >> _U(32)).astype(np.uint32), keys[doc], at - first[doc]))
            total += len(at)
            if total > HELD:
                yield from passed(held)
                held, total = [], 0
        if total:
            yield from passed(held)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[tuple[np.ndarray, ...]] = []
        known: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for h, g, k, s in zip(*(batch.column(c).to_pylist() for c in ("h", "g", "k", "s")), strict=True):
                kk, ss = np.frombuffer(k, np.int64), np.frombuffer(s, np.int32)
                known.append((kk, ss)) if h is None else got.append((np.frombuffer(h, _U), np.frombuffer(g, np.uint32), kk, ss))
        if got:
            h, g, k, s = (np.concatenate(x) for x in zip(*got, strict=True))
            del got
            later = _firsts(k, s, h, g)[1]
            known.append((k[later], s[later]))
        if known:
            k, s = (np.concatenate(x) for x in zip(*known, strict=True))
            if not len(k):
                return
            to = (scan.mix(k.view(_U), 5) % _U(parts)).astype(np.int32)
            order = np.argsort(to, kind="stable")
            head = np.flatnonzero(np.concatenate(([True], to[order][1:] != to[order][:-1])))
            each = np.split(order, head[1:])
            yield pa.RecordBatch.from_arrays([pa.array(to[order][head]), pa.array([k[i].tobytes() for i in each], pa.binary()), pa.array([s[i].tobytes() for i in each], pa.binary())], ["d", "k", "s"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(np.frombuffer(k, np.int64), np.frombuffer(s, np.int32)) for b in batches for k, s in zip(b.column("k").to_pylist(), b.column("s").to_pylist(), strict=True)]
        if got:
            keys, lists = _by_key(*(np.concatenate(x) for x in zip(*got, strict=True)))
            for at in range(0, len(keys), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 10_000]), pa.array(lists[at : at + 10_000], pa.binary())], ["k", "s"])

    settled = keyed.mapInArrow(find, schema).repartition(parts, "p").mapInArrow(settle, "d int, k binary, s binary")
    return settled.repartition(parts, "d").mapInArrow(gather, "k long, s binary")


def _kept(words: int, starts: np.ndarray, width: int) -> np.ndarray:
    delta = np.zeros(words + 1, np.int32)
    starts = np.unique(starts)
    starts = starts[starts + width <= words]
    delta[starts] += 1
    delta[starts + width] -= 1
    return np.cumsum(delta[:-1]) == 0


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 20, more: list[str] | None = None) -> DataFrame:
    """One row per input row: k (NO_KEY for null), n_words, n_removed, kept_text (kept words joined by one space); with
    ``more`` also the text t and those columns as a struct."""
    size = min(ANCHOR, width)
    plain = scan.keyed(docs, key, text)
    volume = plain.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    bits = max(LEAST_CELLS.bit_length(), min(MOST_CELLS.bit_length(), (volume // 10).bit_length() + 1)) - 1  # about one anchor in 40 bytes
    repeats = repeated_starts(plain, repeated_cells(plain, width, size, ROWS, bits), width, size)
    extra = [F.struct(*[F.col(c) for c in more]).alias("more")] if more else []
    joined = scan.keyed(docs, key, text, *extra).join(repeats, "k", "left").select("k", "t", "s", *(["more"] if more else []))
    schema = joined.schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in scan.slices(batches, "t"):
            clean, at = scan.squeezed(data, offsets)
            starts, ends, first = scan.spans(clean, at, scan.NON_SPACE)
            n = np.diff(first)
            removed = np.zeros(len(n), np.int64)
            keep = np.ones(len(clean), bool)
            repeats = batch.column("s")
            for i in np.flatnonzero(repeats.is_valid().to_numpy(zero_copy_only=False)):
                words = _kept(int(n[i]), np.frombuffer(repeats[int(i)].as_py(), np.int32), width)
                removed[i] = n[i] - words.sum()
                lens = ends[first[i] : first[i + 1]] - starts[first[i] : first[i + 1]] + 1  # with the space behind
                lens[-1:] -= 1
                mask = np.repeat(words, lens)
                if words.any() and not words[-1]:  # no space behind the last kept word
                    mask[np.flatnonzero(mask)[-1]] = False
                keep[at[i] : at[i + 1]] = mask
            kept = np.concatenate(([0], np.cumsum(keep)))[at]
            cols = {"k": batch.column("k"), "n_words": pa.array(n.astype(np.int64)), "n_removed": pa.array(removed), "kept_text": scan.strings(clean[keep], kept).cast(pa.string())}
            if more:
                cols |= {"t": batch.column("t"), "more": batch.column("more")}
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    out = "k long, n_words long, n_removed long, kept_text string" + (f", t string, more {schema['more'].dataType.simpleString()}" if more else "")
    return joined.mapInArrow(cut, out)


def op9(spark, sf_dir: str) -> DataFrame:
    rows = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select(scan.unkeyed().alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 19)) AS i FROM w WHERE len(ws) >= 20
), x AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY list_aggregate(ws[i : i + 19], 'string_agg', ' ') ORDER BY doc_id, i) > 1 AS rep FROM s
), c AS (
  SELECT DISTINCT doc_id, unnest(generate_series(i, i + 19)) AS p FROM x WHERE rep
), t AS (
  SELECT doc_id, ws, unnest(generate_series(1, len(ws))) AS p FROM w
), k AS (
  SELECT t.doc_id, string_agg(t.ws[t.p], ' ' ORDER BY t.p) AS kept, count(*) AS n FROM t LEFT JOIN c ON c.doc_id = t.doc_id AND c.p = t.p WHERE c.p IS NULL GROUP BY 1
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""
