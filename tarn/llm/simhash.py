"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified Hamming links, components.

1. Each text becomes a 64-bit fingerprint: bit b is 1 if it is set in over half
   of the XXH64 hashes of its word shingles (repeats included).
2. Equal fingerprints are one vertex, so that groups of copies, however large,
   cost one row.
3. Pigeonhole: cut into ``blocks`` parts, two fingerprints at most ``radius``
   bits apart agree on ``blocks - radius`` parts at least. Every choice of that
   many parts is a join key; more blocks give longer keys, so buckets stay small
   as the number of fingerprints grows. The links are the same for any choice.
4. Within a bucket distances are verified and only a spanning forest is passed
   on (never all pairs), then components come from alternating min-label rounds,
   checkpointed, none of it on the driver.

``keepers`` does the same for a similarity of shingle sets (five words, 0.8): 64
bits can't tell 0.8 from 0.7, so it takes wide fingerprints over the different
shingles of a text, whose Hamming distance estimates the similarity (standard
error 0.018 with 2048 bits), cuts them into as many blocks as let 98 % of the
pairs at 0.8 share one, and verifies the distance over all bits.

Defined cases: a null or empty text, or one of white space, has fingerprint 0,
linked like any other; fewer words than a shingle make one shingle; repeated
rows share a component; null ids come back null and never name a component that
has another id (a component of null ids alone has the id null); rows with null
or repeated ids are linked by their texts alone; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm import scan

_U = np.uint64
# Primes of XXH64.
P1, P2, P3, P4, P5 = map(_U, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << _U(r)) | (x >> _U(64 - r))


def xxh64(data: np.ndarray, starts: np.ndarray, lens: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of many byte ranges at once; ranges of 32 bytes or more go to the library one by one."""
    buf = np.concatenate((data, np.zeros(8, np.uint8)))
    n = len(buf) - 7
    by8 = np.ndarray((n,), "<u8", buf, strides=(1,))
    by4 = np.ndarray((n,), "<u4", buf, strides=(1,))
    with np.errstate(over="ignore"):
        acc = lens.astype(_U) + (_U(seed) + P5)
        at = starts.copy()
        for lane in range(3):
            i = np.flatnonzero((lens >= 8 * lane + 8) & (lens < 32))
            acc[i] = _rot(acc[i] ^ _rot(by8[at[i]] * P2, 31) * P1, 27) * P1 + P4
            at[i] += 8
        i = np.flatnonzero((lens & 4) > 0)
        i = i[lens[i] < 32]
        acc[i] = _rot(acc[i] ^ by4[at[i]].astype(_U) * P1, 23) * P2 + P3
        at[i] += 4
        for left in range(3):
            i = np.flatnonzero((lens & 3) > left)
            i = i[lens[i] < 32]
            acc[i] = _rot(acc[i] ^ buf[at[i]].astype(_U) * P5, 11) * P1
            at[i] += 1
        acc = (acc ^ (acc >> _U(33))) * P2
        acc = (acc ^ (acc >> _U(29))) * P3
        acc ^= acc >> _U(32)
    for i in np.flatnonzero(lens >= 32):
        acc[i] = xxhash.xxh64_intdigest(data[starts[i] : starts[i] + lens[i]].tobytes(), seed)
    return acc


#: For 4 bits, a 64-bit word with each bit in a lane of 16 bits.
_LANES = np.array([sum(((v >> b) & 1) << (16 * b) for b in range(4)) for v in range(16)], _U)
#: Hashes whose bits are counted at once; a lane holds up to 65535.
_RUN = 60_000


def majority(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each range of hashes [bounds[i], bounds[i+1]) the bits set in over half of them; 0 for an empty range."""
    n = np.diff(bounds)
    out = np.zeros(len(n), _U)
    full = np.flatnonzero(n > 0)
    if not len(full):
        return out
    parts = (n[full] + _RUN - 1) // _RUN  # long ranges in runs, so that no lane overflows
    owner = np.repeat(np.arange(len(full)), parts)
    rank = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    cuts = bounds[:-1][full][owner] + rank * _RUN
    for nibble in range(16):
        lanes = np.add.reduceat(_LANES[((h >> _U(4 * nibble)) & _U(15)).astype(np.intp)], cuts)
        for b in range(4):
            ones = np.bincount(owner, ((lanes >> _U(16 * b)) & _U(0xFFFF)).astype(np.float64), len(full))
            out[full] |= (ones * 2 > n[full]).astype(_U) << _U(4 * nibble + b)
    return out


def text_fingerprints(data: np.ndarray, offsets: np.ndarray, shingle: int, seed: int) -> np.ndarray:
    data, offsets = scan.squeezed(scan.LOWER[data], offsets)
    starts, ends, first = scan.spans(data, offsets, scan.NON_SPACE)
    words = np.diff(first)
    per = np.where(words > 0, np.maximum(words - shingle + 1, 1), 0)
    bounds = np.concatenate(([0], np.cumsum(per)))
    out = np.zeros(len(words), _U)
    at = 0
    while at < len(words):  # a slice of texts, or a run of shingles of a long text
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + (1 << 19), "right")) - 1)
        doc = np.repeat(np.arange(at, to), per[at:to])
        s = first[doc] + np.arange(bounds[at], bounds[to]) - bounds[doc]
        last = np.minimum(s + shingle, first[doc + 1]) - 1
        h = np.concatenate([xxh64(data, starts[s[i : i + (1 << 19)]], ends[last[i : i + (1 << 19)]] - starts[s[i : i + (1 << 19)]], seed) for i in range(0, len(s), 1 << 19)] or [np.zeros(0, _U)])
        out[at:to] = majority(h, bounds[at : to + 1] - bounds[at])
        at = to
    return out


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, seed: int = 42, more: dict[str, Column] | None = None) -> DataFrame:
    """k (NO_KEY for null), the long columns ``more`` and fp (long) of every row, without a shuffle."""
    names = ["k", *(more or {})]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in scan.slices(batches, "t"):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(text_fingerprints(data, offsets, shingle, seed).view(np.int64))], [*names, "fp"])

    return scan.keyed(docs, key, text, *[c.alias(n) for n, c in (more or {}).items()]).mapInArrow(run, ", ".join(f"{c} long" for c in [*names, "fp"]))


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _find(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


def _hook(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Unites the classes of each linked pair; parents point to smaller indices."""
    while len(a):
        x, y = parent[a], parent[b]
        lo, hi = np.minimum(x, y), np.maximum(x, y)
        live = lo != hi
        if not live.any():
            return parent
        a, b = a[live], b[live]
        np.minimum.at(parent, hi[live], lo[live])
        parent = _find(parent)
    return parent


#: A bucket larger than this is searched by its neighbours' values, not by pairs.
_PAIRS = 4096


def _near_values(fp: np.ndarray, free: list[int], radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked index pairs in one large bucket: looks up every value at most ``radius`` free bits away, so the cost per
    fingerprint has a bound whatever the bucket's size."""
    order = np.argsort(fp)
    ordered = fp[order]
    for r in range(1, radius + 1):
        for bits in combinations(free, r):
            want = ordered ^ _U(sum(1 << b for b in bits))
            at = np.minimum(np.searchsorted(ordered, want), len(ordered) - 1)
            hit = np.flatnonzero((ordered[at] == want) & (want > ordered))
            if len(hit):
                yield order[hit], order[at[hit]]


def bucket_forest(key: np.ndarray, fp: np.ndarray, ident: np.ndarray, radius: int, free: dict[int, list[int]], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside each bucket: for each vertex that has a smaller one, that pair of ids.
    Rows are sorted by (table, key, ident)."""
    n = len(key)
    parent = np.arange(n)
    if not n:
        return ident, ident
    head = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (table[1:] != table[:-1]))))
    size = np.diff(np.append(head, n))
    small = np.repeat(size <= _PAIRS, size)
    last = np.repeat(head + size, size)
    step = 1
    live = np.flatnonzero(small & (np.arange(n) + 1 < last))
    while len(live):
        near = live[_popcount(fp[live] ^ fp[live + step]) <= radius]
        parent = _hook(parent, near, near + step)
        step += 1
        live = live[live + step < last[live]]
    for at, count in zip(head[size > _PAIRS], size[size > _PAIRS], strict=True):
        bits = free[int(table[at])]
        if sum(1 for r in range(1, radius + 1) for _ in combinations(bits, r)) < count:
            links = _near_values(fp[at : at + count], bits, radius)
        else:
            links = ((np.full(len(j), i), i + 1 + j) for i in range(count - 1) if len(j := np.flatnonzero(_popcount(fp[at + i] ^ fp[at + i + 1 : at + count]) <= radius)))
        held, total = [], 0
        for a, b in links:
            held.append((a + at, b + at))
            total += len(a)
            if total > 1 << 20:
                parent, held, total = _hook(parent, *map(np.concatenate, zip(*held, strict=True))), [], 0
        if held:
            parent = _hook(parent, *map(np.concatenate, zip(*held, strict=True)))
    child = np.flatnonzero(parent != np.arange(n))
    return ident[child], ident[parent[child]]


def block_masks(blocks: int, radius: int) -> list[int]:
    """For every choice of blocks - radius of the blocks, the mask of their bits."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    part = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(part[i] for i in pick) for pick in combinations(range(blocks), blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def whole_groups(batches: Iterator[pa.RecordBatch], names: list[str], by: int) -> Iterator[list[np.ndarray]]:
    """The columns of sorted batches in runs that cut no group of equal values in the first ``by`` columns; what is held
    is a batch and a group."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        last = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:by]], axis=0))
        begun = bool(held) and any(h[-1] != c[0] for h, c in zip(held[-1][:by], cols[:by], strict=True))
        at = int(last[-1]) + 1 if len(last) else 0
        if at or begun:
            yield [np.concatenate(x) for x in zip(*held, [c[:at] for c in cols], strict=True)]
            held = []
        held.append([c[at:] for c in cols])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def near_links(vertices: DataFrame, count: int, radius: int = 3) -> DataFrame:
    """Pairs (v, u), u < v, whose closure has the same components as all links of fingerprints at most ``radius`` bits apart."""
    blocks = radius + 1
    while blocks < radius + 4 and count >> min(m.bit_count() for m in block_masks(blocks, radius)) >= 16:
        blocks += 1
    masks = block_masks(blocks, radius)
    free = {i: [b for b in range(64) if not m >> b & 1] for i, m in enumerate(masks)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, key, fp, ident in whole_groups(batches, ["tab", "key", "fp", "v"], 2):
            a, b = bucket_forest(key, fp.view(_U), ident, radius, free, table)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["v", "u"])

    tables = F.array(*[F.struct(F.lit(i).alias("tab"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)])
    exploded = vertices.select("fp", "v", F.explode(tables).alias("b")).select("b.tab", "b.key", "fp", "v")
    return exploded.repartition(scan.partitions(vertices), "tab", "key").sortWithinPartitions("tab", "key", "v").mapInArrow(run, "v long, u long")


def components(links: DataFrame) -> DataFrame:
    """v, c: for every vertex with a smaller one in its component, the smallest. Alternating large-star and small-star
    rounds, checkpointed; their number grows with the logarithm of the longest path. The least neighbours are written
    before they are joined, so that both sides of the joins are plain shuffles and the rows of a hub can be split."""
    edges = scan.cut(links.where("u < v").distinct())
    while True:
        # large-star: every larger neighbour of x moves to the smallest of x's neighbourhood
        both = edges.select(F.col("v").alias("a"), F.col("u").alias("b")).unionByName(edges.select(F.col("u").alias("a"), F.col("v").alias("b")))
        low = scan.cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = scan.cut(both.join(low, "a").where("b > a").select(F.col("b").alias("v"), F.col("m").alias("u")).where("u < v").distinct())
        # small-star: the smaller neighbours of x, and x, move to the smallest of them
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(least.select("v", F.col("m").alias("u"))).where("u < v").distinct()
        new = scan.cut(small)
        same = "count(1)", "coalesce(sum(xxhash64(v, u) % 1000000007), 0)"
        if new.selectExpr(*same).first() == edges.selectExpr(*same).first():
            return new.select("v", F.col("u").alias("c"))
        edges = new


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 3, seed: int = 42) -> DataFrame:
    """One row per input row: k (NO_KEY for null), fp, c (the smallest key reachable, itself included; null if none of
    them has a key). Vertices are fingerprints, never keys, so rows that share a key (or have none) are linked only if
    their fingerprints are."""
    prints = scan.cut(fingerprints(docs, key, text, shingle, seed))
    vertices = scan.cut(prints.groupBy("fp").agg(F.min(scan.unkeyed()).alias("least")))
    comp = components(near_links(vertices.select("fp", F.col("fp").alias("v")), vertices.count(), radius))
    named = scan.cut(vertices.join(comp, vertices["fp"] == comp["v"], "left").select("fp", F.coalesce("c", "fp").alias("root"), "least"))
    roots = scan.cut(named.groupBy("root").agg(F.min("least").alias("c")))
    return prints.join(scan.cut(named.join(roots, "root").select("fp", "c")), "fp")


# -- similarity of word shingles -----------------------------------------------------------------------------------------

#: Bits of a wide fingerprint at least, and chance that a pair at the least similarity shares a block.
BITS, CAUGHT = 2048, 0.98
#: Bits of 64 in which a pair may differ before it is compared in all.
AHEAD = 22
#: For each byte a 64-bit word with each bit in a lane of 8 bits.
_BYTES = np.array([sum(((v >> b) & 1) << (8 * b) for b in range(8)) for v in range(256)], _U)


def apart(likeness: float) -> float:
    """Share of bits in which the fingerprints of two sets of this Jaccard similarity (and of like size) differ: the angle
    between the sets' vectors over pi."""
    return float(np.arccos(2 * likeness / (1 + likeness)) / np.pi)


def wide_blocks(count: int, likeness: float, caught: float = CAUGHT) -> tuple[int, int, int]:
    """Bits of a block, blocks and bits of a fingerprint for ``count`` fingerprints. A block has so many bits that
    chance puts about 16 of them into a bucket; blocks are so many that a pair of the likeness shares one with the
    chance ``caught``. (That all such pairs share one would take more blocks than bits they differ in, each of 5 bits.)"""
    width = max(16, min(40, (max(count, 1) - 1).bit_length() - 4))
    blocks = int(np.ceil(np.log(1 - caught) / np.log(1 - (1 - apart(likeness)) ** width)))
    return width, blocks, max(BITS, -(-width * blocks // 64) * 64)


def wide_fingerprints(data: np.ndarray, offsets: np.ndarray, shingle: int, words: int) -> np.ndarray:
    """For each text ``words`` 64-bit words: bits set in over half of the hashes of its different word shingles (A-Z lowered;
    fewer words: all of them); 0 for a text without words."""
    data = scan.LOWER[data]
    starts, ends, first = scan.spans(data, offsets, scan.NON_SPACE)
    h = scan.word_hashes(data, starts, ends)
    n = np.diff(first)
    out = np.zeros((len(n), words), _U)
    w = scan.windows(h, shingle)
    at = np.flatnonzero(scan.inside(first, shingle, len(h)))
    doc = np.searchsorted(first, at, "right") - 1
    short = np.flatnonzero((n > 0) & (n < shingle))
    with np.errstate(over="ignore"):
        brief = np.array([scan.windows(h[first[i] : first[i + 1]], int(n[i]))[0] + _U(n[i]) for i in short], _U)
    doc, w = np.concatenate((doc, short)), np.concatenate((w[at], brief))
    code = np.unique((doc.astype(_U) << _U(44)) | (scan.mix(w, 17) >> _U(20)))
    doc, code = (code >> _U(44)).astype(np.int64), code & _U((1 << 44) - 1)
    size = np.bincount(doc, minlength=len(n))
    bounds = np.concatenate(([0], np.cumsum(size)))
    full = np.flatnonzero(size)
    if not len(full):
        return out
    parts = -(-size[full] // 255)  # runs in which no lane of 8 bits overflows
    owner = np.repeat(np.arange(len(full)), parts)
    cuts = bounds[full][owner] + 255 * (np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts))
    begin = np.cumsum(parts) - parts
    for x in range(words):
        each = scan.mix(code, 1000 + x).view(np.uint8).reshape(-1, 8)
        for byte in range(8):
            lanes = np.add.reduceat(_BYTES[each[:, byte]], cuts).view(np.uint8).reshape(-1, 8)
            ones = np.add.reduceat(lanes, begin, axis=0, dtype=np.int64)
            bits = (ones * 2 > size[full][:, None]).astype(np.uint8)
            out[full, x] |= np.packbits(bits, axis=1, bitorder="little")[:, 0].astype(_U) << _U(8 * byte)
    return out


def _block(fp: np.ndarray, i: int, width: int) -> np.ndarray:
    word, shift = divmod(i * width, 64)
    key = fp[:, word] >> _U(shift)
    if shift + width > 64:
        key = key | fp[:, word + 1] << _U(64 - shift)
    return key & _U((1 << width) - 1)


def with_mates(bucket: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Which rows (sorted by bucket) have another in their bucket whose word differs in at most ``AHEAD`` bits; in a
    bucket beyond ``_PAIRS`` rows all are taken to have."""
    n = len(bucket)
    head = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    size = np.diff(np.append(head, n))
    found = np.repeat(size > _PAIRS, size)
    last = np.repeat(head + size, size)
    step = 1
    live = np.flatnonzero(~found & (np.arange(n) + 1 < last))
    while len(live):
        near = live[_popcount(word[live] ^ word[live + step]) <= AHEAD]
        found[near] = found[near + step] = True
        step += 1
        live = live[live + step < last[live]]
    return found


def wide_forest(fp: np.ndarray, ident: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links in one bucket (different fingerprints). Each round takes a leader that has no class
    yet and unites with it what is near; then only members of different classes whose leaders are at most three radii
    apart are compared, so a group of near copies around one text costs a comparison each."""
    n = len(ident)
    parent = np.arange(n)
    distance = lambda a, rows: _popcount(fp[rows] ^ fp[a]).sum(1, dtype=np.int64)
    left, groups = np.arange(n), []
    while len(left):
        near = distance(left[0], left) <= radius
        groups.append(left[near])
        parent[left[near]] = left[0]
        left = left[~near]
    leaders = np.array([g[0] for g in groups])
    for i, g in enumerate(groups):
        for j in np.flatnonzero(distance(leaders[i], leaders[i + 1 :]) <= 3 * radius) + i + 1:
            for x in g:
                if _find(parent)[leaders[i]] == _find(parent)[leaders[j]]:
                    break
                near = groups[j][distance(x, groups[j]) <= radius]
                if len(near):
                    parent = _hook(_find(parent), np.array([x]), near[:1])
    parent = _find(parent)
    child = np.flatnonzero(parent != np.arange(n))
    return ident[child], ident[parent[child]]


def similar_links(vertices: DataFrame, width: int, blocks: int, radius: int) -> DataFrame:
    """Pairs (v, u), u < v, whose closure has the components of all links of wide fingerprints (fp, binary) that share a
    block and differ in at most ``radius`` bits. First only a 64-bit word travels with each block; whole fingerprints
    follow for those that have a mate by it."""
    parts = scan.partitions(vertices)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ident = part.column("v").to_numpy()
                fp = np.frombuffer(b"".join(part.column("fp").to_pylist()), _U).reshape(len(ident), -1)
                words = fp.shape[1]
                bucket = np.concatenate([_block(fp, i, width) | _U(i << width) for i in range(blocks)])
                other = np.concatenate([fp[:, (i * width // 64 + words // 2) % words] for i in range(blocks)])
                yield pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), pa.array(other.view(np.int64)), pa.array(np.tile(ident, blocks))], ["bucket", "word", "v"])

    def mates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, word, ident in whole_groups(batches, ["bucket", "word", "v"], 1):
            ok = with_mates(bucket, word.view(_U))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[ok]), pa.array(ident[ok])], ["bucket", "v"])

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, ident, fp in whole_groups(batches, ["bucket", "v", "fp"], 1):
            head = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            for a, b in zip(head, np.append(head[1:], len(bucket)), strict=True):
                links = wide_forest(np.frombuffer(b"".join(fp[a:b]), _U).reshape(b - a, -1), ident[a:b], radius)
                if len(links[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in links], ["v", "u"])

    found = vertices.mapInArrow(explode, "bucket long, word long, v long").repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(mates, "bucket long, v long")
    return found.join(vertices, "v").select("bucket", "v", "fp").repartition(parts, "bucket").sortWithinPartitions("bucket", "v").mapInArrow(forest, "v long, u long")


def identity(key: str = "doc_id", text: str = "text") -> dict[str, Column]:
    """What tells rows apart whose ids are null or repeated: the id (NO_KEY for null) and two hashes of the text."""
    t = F.coalesce(F.col(text), F.lit(""))
    return {"k": F.coalesce(F.col(key).cast("long"), F.lit(scan.NO_KEY)), "h": F.xxhash64(t), "g": F.xxhash64(F.lit(1), t)}


def keepers(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, likeness: float = 0.8) -> DataFrame:
    """The identity (k, h, g) of the first row of each component of texts whose sets of word shingles are alike by at least
    ``likeness``, as their wide fingerprints tell. Rows that share an id and differ in text don't join their components."""
    width, blocks, bits = wide_blocks(docs.count(), likeness)
    names = ["k", "h", "g"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in scan.slices(batches, "t"):
            fp = wide_fingerprints(data, offsets, shingle, bits // 64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array([x.tobytes() for x in fp], pa.binary())], [*names, "fp"])

    more = {n: c for n, c in identity(key, text).items() if n != "k"}
    rows = scan.keyed(docs, key, text, *[c.alias(n) for n, c in more.items()])
    prints = rows.mapInArrow(run, "k long, h long, g long, fp binary")
    first = prints.groupBy("fp").agg(F.min(F.struct(*names)).alias("first"))
    vertices = scan.cut(first.select(F.monotonically_increasing_id().alias("v"), "fp", "first"))
    comp = components(similar_links(vertices.select("v", "fp"), width, blocks, round(bits * apart(likeness))))
    label = vertices.select("v", "first").join(comp, "v", "left").select(F.coalesce("c", "v").alias("c"), "first")
    return label.groupBy("c").agg(F.min("first").alias("first")).select("first.*")


def hex_fingerprint(c: Column) -> Column:
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def op10(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select(scan.unkeyed().alias("doc_id"), hex_fingerprint(F.col("fp")).alias("fingerprint"), scan.unkeyed("c").alias("component_id"))
