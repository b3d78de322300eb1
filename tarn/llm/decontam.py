"""Benchmark decontamination with training suffix arrays.

Documents are tokenised in shards of bounded size. A shard keeps only the words
that some benchmark item has (others can't take part in a match; each is a stop
that no match crosses) and sorts its suffixes into a suffix array: packed keys
first, then prefix doubling over what is still tied. Every benchmark suffix is
binary-searched in every shard; the neighbours of its place give the longest
verbatim match and where it is, and a second search gives the range of all
suffixes that begin with a whole window. Words inside any such occurrence are
hit. There is no shuffle: a document is judged where it is read.

The benchmark is taken in blocks of at most ``block_bytes`` of text (or one item),
each a pass of its own over the documents whose result is written before the next
begins: driver and workers hold two blocks at most, whatever the benchmark's size.

Words: A-Z lowered, runs of digits, a-z and non-ASCII characters. A window: 10
consecutive words of an item; an item of fewer words, but not none, is one
window. Defined cases: null or empty texts have no words and are clean; items
without words match nothing; items of one text both count; repeated rows get
equal results; null ids come back null (a null item id is left out of the list
of ids but counts); other columns are ignored; an empty benchmark leaves all
documents clean.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm import scan

WINDOW = 10
#: Bytes of benchmark text searched in one pass, and words of a shard.
BLOCK_BYTES, SHARD_WORDS = 16 << 20, 2 << 20
_U = np.uint64


class Tests:
    """One block of benchmark items: their words as ranks in a vocabulary (1 and up), item after item, each ended by 0."""

    def __init__(self, ids: list[str | None], texts: list[str | None], window: int = WINDOW):
        data, offsets = scan.buffers(pa.array(texts, pa.string()))
        data = scan.LOWER[data]
        starts, ends, first = scan.spans(data, offsets, scan.ALNUM)
        h = scan.word_hashes(data, starts, ends)
        self.ids, self.window = ids, window
        self.vocabulary = np.unique(h)
        n = np.diff(first)
        self.begin = first[:-1] + np.arange(len(n))  # of each item
        self.length = n
        self.tokens = np.zeros(len(h) + len(n) + 1, np.int64)
        item = np.repeat(np.arange(len(n)), n)
        self.tokens[np.arange(len(h)) + item] = np.searchsorted(self.vocabulary, h) + 1
        self.suffix = np.arange(len(h)) + item  # start of every suffix
        self.item = item
        self.left = (self.begin + n)[item] - self.suffix  # words to the item's end
        # windows: whole ones at each start, or the item itself if it is shorter
        size = np.where(n >= window, window, n)[item]
        self.windowed = np.flatnonzero((self.left >= size) & ((size == window) | (self.suffix == self.begin[item])))
        self.size = size

    def ranks(self, h: np.ndarray) -> np.ndarray:
        """Rank of each word hash, 0 if no item has the word."""
        if not len(self.vocabulary):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == h, at + 1, 0)


def suffix_array(tokens: np.ndarray, top: int) -> np.ndarray:
    """Starts of the suffixes whose first word is not 0, in order. A suffix ends at the first 0; among equal ones the
    order is free."""
    n = len(tokens)
    bits = max(1, int(top).bit_length())
    each = max(1, 62 // bits)
    key, alive = np.zeros(n, np.int64), np.ones(n, bool)
    padded = np.concatenate((tokens, np.zeros(each, np.int64)))
    for j in range(each):
        word = padded[j : j + n]
        alive &= word > 0
        key = (key << bits) | np.where(alive, word, 0)
    at = np.flatnonzero(tokens > 0)
    order = at[np.argsort(key[at], kind="stable")]
    rank = np.zeros(n + 1, np.int64)

    def number(members: np.ndarray, base: np.ndarray, new: np.ndarray) -> None:
        """Ranks: index of the first of its group, plus 1."""
        rank[members] = np.maximum.accumulate(np.where(new, base, 0)) + 1

    if not len(order):
        return order
    new = np.concatenate(([True], key[order][1:] != key[order][:-1]))
    number(order, np.arange(len(order)), new)
    open_ = np.zeros(n + 1, bool)  # undecided and not ended
    open_[:n] = alive & (tokens > 0)
    depth = each
    while True:
        single = np.concatenate((new, [True]))
        single = single[:-1] & single[1:]
        place = np.flatnonzero(~single & open_[order])
        if not len(place):
            return order
        members = order[place]
        follow = np.minimum(members + depth, n)
        r1, r2 = rank[members], rank[follow]
        by = np.lexsort((r2, r1))
        members, r1, r2 = members[by], r1[by], r2[by]
        # the open members of a group share its places: none of a group is open while another is ended, as their keys are equal
        order[place] = members
        fresh = np.concatenate(([True], (r1[1:] != r1[:-1]) | (r2[1:] != r2[:-1])))
        new[place] |= fresh
        go_on = open_[np.minimum(members + depth, n)]
        number(members, place, new[place])
        open_[members] = go_on & (r2 > 0)
        depth *= 2


def _compare(tokens: np.ndarray, at: np.ndarray, tests: np.ndarray, start: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of suffixes: words in common (up to the limit), and the sign of shard minus test beyond them."""
    common = np.zeros(len(at), np.int64)
    sign = np.zeros(len(at), np.int8)
    live = np.flatnonzero(limit > 0)
    while len(live):
        a, b = tokens[at[live] + common[live]], tests[start[live] + common[live]]
        equal = (a == b) & (a > 0)
        out = live[~equal]
        sign[out] = np.sign(a[~equal] - b[~equal])
        live = live[equal]
        common[live] += 1
        live = live[common[live] < limit[live]]
    return common, sign


def place(tokens: np.ndarray, order: np.ndarray, tests: np.ndarray, start: np.ndarray, limit: np.ndarray, after: bool = False) -> np.ndarray:
    """Binary search: for each test suffix (cut at its limit) how many of the shard's suffixes are before it, or with
    ``after`` before or beginning with it."""
    lo, hi = np.zeros(len(start), np.int64), np.full(len(start), len(order), np.int64)
    while True:
        live = np.flatnonzero(lo < hi)
        if not len(live):
            return lo
        mid = (lo[live] + hi[live]) >> 1
        _, sign = _compare(tokens, order[mid], tests, start[live], limit[live])
        less = sign <= 0 if after else sign < 0
        lo[live] = np.where(less, mid + 1, lo[live])
        hi[live] = np.where(less, hi[live], mid)


class Shard:
    """Documents of one shard: words of the vocabulary as ranks, and their suffix array."""

    def __init__(self, tests: Tests, parts: list[tuple[np.ndarray, np.ndarray]]):
        """parts: ranks of the words of some documents, and their numbers of words."""
        self.words = np.concatenate([n for _, n in parts])
        self.first = np.concatenate(([0], np.cumsum(self.words)))
        stop = self.first[:-1] + np.arange(len(self.words))  # a 0 before each document
        self.begin = stop + 1
        self.tokens = np.zeros(self.first[-1] + len(self.words) + 1, np.int64)
        self.tokens[np.arange(self.first[-1]) + np.repeat(np.arange(len(self.words)) + 1, self.words)] = np.concatenate([r for r, _ in parts])
        self.order = suffix_array(self.tokens, len(tests.vocabulary))
        self.tests = tests

    def longest(self) -> tuple[np.ndarray, np.ndarray]:
        """For every test suffix the words of its longest match in the shard and where that is."""
        t = self.tests
        if not len(self.order) or not len(t.suffix):
            return np.zeros(len(t.suffix), np.int64), np.zeros(len(t.suffix), np.int64)
        at = place(self.tokens, self.order, t.tokens, t.suffix, t.left)
        best, where = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for side in (at - 1, at):
            i = np.clip(side, 0, len(self.order) - 1)
            common, _ = _compare(self.tokens, self.order[i], t.tokens, t.suffix, t.left)
            where = np.where(common > best, self.order[i], where)
            best = np.maximum(best, common)
        return best, where

    def occurrences(self, best: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each place of each different window: position, words, the test suffix. Equal windows are searched once."""
        t = self.tests
        w = t.windowed[best[t.windowed] >= t.size[t.windowed]]
        empty = np.zeros(0, np.int64)
        if not len(w):
            return empty, empty, empty
        lo = place(self.tokens, self.order, t.tokens, t.suffix[w], t.size[w])
        hi = place(self.tokens, self.order, t.tokens, t.suffix[w], t.size[w], after=True)
        _, one = np.unique(np.stack((lo, t.size[w])), axis=1, return_index=True)
        self.alike = (w, lo)  # windows with one range are equal if their sizes are
        w, lo, hi = w[one], lo[one], hi[one]
        n = hi - lo
        at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return self.order[at], np.repeat(t.size[w], n), np.repeat(w, n)

    def judged(self) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
        """For each document: which words are hit (bit per word, all documents in one array), and its items."""
        best, _ = self.longest()
        pos, size, w = self.occurrences(best)
        delta = np.zeros(len(self.tokens) + 1, np.int64)
        np.add.at(delta, pos, 1)
        np.add.at(delta, pos + size, -1)
        hit = np.cumsum(delta[:-1]) > 0
        items: list[list[int]] = [[] for _ in self.words]
        if len(pos):
            doc = np.searchsorted(self.begin, pos, "right") - 1
            pair = np.unique(np.stack((doc, w)), axis=1)
            t = self.tests
            every, lo = self.alike
            group: dict[tuple[int, int], set[int]] = {}
            for x, y in zip(every, lo, strict=True):
                group.setdefault((int(y), int(t.size[x])), set()).add(int(t.item[x]))
            of = {int(x): group[int(y), int(t.size[x])] for x, y in zip(every, lo, strict=True)}
            found: dict[int, set[int]] = {}
            for d, x in pair.T.tolist():
                found.setdefault(d, set()).update(of[x])
            for d, s in found.items():
                items[d] = sorted(s)
        return hit, doc_sums(hit, self.begin, self.words), items


def doc_sums(hit: np.ndarray, begin: np.ndarray, words: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(hit)))
    return total[begin + words] - total[begin]


def blocks(benchmark: DataFrame, key: str, text: str, limit: int = BLOCK_BYTES) -> Iterator[tuple[list[str | None], list[str | None]]]:
    """The items in parts of at most ``limit`` bytes of text (or one item), one after another; a part is made when it is
    asked for, and the driver has one partition of the benchmark beside it."""
    ids: list[str | None] = []
    texts: list[str | None] = []
    size = 0
    for i, t in benchmark.select(F.col(key).cast("string").alias("i"), F.col(text).alias("t")).toLocalIterator():
        n = len((t or "").encode())
        if texts and size + n > limit:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(i)
        texts.append(t)
        size += n
    yield ids, texts


def _shards(batches: Iterator[pa.RecordBatch], tests: Tests, words: int) -> Iterator[tuple[Shard, list[pa.RecordBatch]]]:
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    held: list[pa.RecordBatch] = []
    total = 0
    for batch, data, offsets in scan.slices(batches, "t"):
        data = scan.LOWER[data]
        starts, ends, first = scan.spans(data, offsets, scan.ALNUM)
        parts.append((tests.ranks(scan.word_hashes(data, starts, ends)), np.diff(first)))
        held.append(batch)
        total += len(starts)
        if total >= words:
            yield Shard(tests, parts), held
            parts, held, total = [], [], 0
    if held:
        yield Shard(tests, parts), held


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, shard_words: int = SHARD_WORDS, more: list[str] | None = None) -> DataFrame:
    """One row per document: k (NO_KEY for null), n_words, n_hit, items (their ids as sorted strings), n_items; with
    ``more`` also the text t and those columns as a struct. Hit words are a bit map while there are several blocks."""
    extra = bool(more)
    source = scan.keyed(docs, key, text, *([F.struct(*[F.col(c) for c in more]).alias("more")] if more else []))
    kind = source.schema["more"].dataType.simpleString() if more else ""

    def judge(shared, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tests = shared.value
            for shard, held in _shards(batches, tests, shard_words):
                hit, _, items = shard.judged()
                at = 0
                for batch in held:
                    n = batch.num_rows
                    bits, lists, counts, hits = [], [], [], []
                    before = batch.column("bits") if "bits" in batch.schema.names else None
                    earlier = batch.column("items") if before is not None else None
                    for d in range(at, at + n):
                        own = hit[shard.begin[d] : shard.begin[d] + shard.words[d]]
                        ids = [tests.ids[i] for i in items[d]]
                        if before is not None and before[d - at].as_py():
                            own = own | np.unpackbits(np.frombuffer(before[d - at].as_py(), np.uint8), count=len(own)).astype(bool)
                        if earlier is not None:
                            ids += earlier[d - at].as_py()
                        hits.append(int(own.sum()))
                        bits.append(np.packbits(own).tobytes() if hits[-1] and not last else b"")
                        lists.append(sorted((i for i in ids if i is not None)) + [i for i in ids if i is None])
                        counts.append(int(shard.words[d]))
                    at += n
                    cols = {"k": batch.column("k")}
                    if extra or not last:
                        cols["t"] = batch.column("t")
                    if not last:
                        cols |= {"bits": pa.array(bits, pa.binary())}
                    cols |= {"n_words": pa.array(counts, pa.int64()), "n_hit": pa.array(hits, pa.int64()), "items": pa.array(lists, pa.list_(pa.string()))}
                    if extra:
                        cols["more"] = batch.column("more")
                    yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

        return run

    parts = blocks(benchmark, item, text, block_bytes)
    block = next(parts)
    while block is not None:
        following = next(parts, None)
        last = following is None
        out = "k long, " + ("t string, " if extra or not last else "") + ("" if last else "bits binary, ") + "n_words long, n_hit long, items array<string>" + (f", more {kind}" if more else "")
        shared = docs.sparkSession.sparkContext.broadcast(Tests(*block, window))
        source = source.mapInArrow(judge(shared, last), out)
        if not last:
            source = scan.cut(source)
            shared.destroy()
        block = following
    return source.withColumn("n_items", F.size("items").cast("long"))


def longest_matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", block_bytes: int = BLOCK_BYTES, shard_words: int = SHARD_WORDS) -> DataFrame:
    """For every benchmark suffix (item, first word) its longest verbatim match in all documents: words, the smallest
    key that has it, and the match's first word there. One row a suffix and shard is shuffled."""
    out = None
    for ids, texts in blocks(benchmark, item, text, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(Tests(ids, texts))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            tests = shared.value
            for shard, held in _shards(batches, tests, shard_words):
                best, where = shard.longest()
                i = np.flatnonzero(best)
                doc = np.searchsorted(shard.begin, where[i], "right") - 1
                keys = np.concatenate([b.column("k").to_numpy(zero_copy_only=False) for b in held])
                yield pa.RecordBatch.from_arrays([pa.array([tests.ids[x] for x in tests.item[i]], pa.string()), pa.array(tests.suffix[i] - tests.begin[tests.item[i]]), pa.array(best[i]), pa.array(keys[doc]), pa.array(where[i] - shard.begin[doc])], ["item", "at", "words", "k", "pos"])

        part = scan.keyed(docs, key, text).mapInArrow(run, "item string, at long, words long, k long, pos long")
        part = scan.cut(part.groupBy("item", "at").agg(F.min(F.struct((-F.col("words")).alias("less"), "k", "pos")).alias("b")))
        shared.destroy()
        out = part if out is None else out.unionByName(part)
    best = out.groupBy("item", "at").agg(F.min("b").alias("b"))
    return best.select("item", "at", (-F.col("b.less")).alias("words"), scan.unkeyed("b.k").alias("k"), "b.pos")


def op5(spark, sf_dir: str) -> DataFrame:
    rows = contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return rows.select(scan.unkeyed().alias("doc_id"), "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, n, list_aggregate(ws[i : i + n - 1], 'string_agg', ' ') AS g
  FROM (SELECT item_id, ws, least(10, len(ws)) AS n, unnest(generate_series(1, len(ws) - least(10, len(ws)) + 1)) AS i FROM b WHERE len(ws) > 0)
), dw AS (
  SELECT doc_id, n, i, list_aggregate(ws[i : i + n - 1], 'string_agg', ' ') AS g
  FROM (SELECT doc_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(ws) >= n)
), m AS (
  SELECT doc_id, item_id, i, dw.n AS n FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g
), h AS (
  SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM m) GROUP BY 1
), it AS (
  SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM m) GROUP BY 1
)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)
"""
