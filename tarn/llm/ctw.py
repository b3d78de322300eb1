"""Language-model scoring by context-tree weighting over bytes.

Each byte is eight binary decisions. For every context of the last 0 to ``DEPTH``
bytes and every decision, the counts of zeros and ones in the training texts give
a Krichevsky-Trofimov estimate; counts don't depend on order, so they are summed
over all partitions. From the deepest contexts upwards a node's probability is
half its own estimate and half the product of its children's; the share of its
own is the weight with which the node stops the tree. A text is coded with the
tree as it stands: the mixture over all depths along its contexts, where a
context that was never seen leaves the mixture to the shorter ones. The score is
the log10 probability; divided by the bytes it is the code length per byte.

Beside it stands a unigram base over words and an end token, add-0.1 smoothed.
Word counts are never broadcast as a whole: each task looks up the ``HOT`` most
frequent words itself and sends the others to the buckets of the counts.

What tasks receive has a bound: HOT words, and a tree of at most ``GRAMS``
different strings of DEPTH + 1 bytes (counted first). One task weights that tree
and writes it to the shared folder, from where workers map it: the driver holds
neither counts nor tree. Beyond the bound the same tree, of the same depth, is dealt into subtrees by the last ``TOP``
bytes of the context: each is weighted in a task of its own, which passes up what
its nodes give the shorter contexts (at most 256 * 255 sums), and those few levels
are broadcast. Every slice of text asks the subtrees for its different strings.

Defined cases: a null text is empty: one token (the end), score 0.0; with no
training row all counts are 0 and the tree gives every bit 1/2; repeated rows
get equal results; null ids come back null and are not held out; other columns
are ignored; an empty table gives no rows. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm import scan, warc

DEPTH, HOT, GRAMS = 5, 1 << 18, 4_000_000
#: Levels above the subtrees, and strings of a subtree bucket on average, where the tree is dealt.
TOP, DEALT = 2, 1_000_000
#: Bytes of text that one numpy pass takes here, beside the model.
PART = 2 << 20
#: Entries that a task gathers before it sums and sends them.
HELD = 6 << 20
_U = np.uint64
#: The end token's hash.
END = _U(0xE17D0E17D0E17D01)
_HALF = np.log(0.5)


def summed(codes: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Different codes, sorted, and the sum of their numbers (or how often they occur)."""
    if n is None:
        codes = np.sort(codes)
    else:
        order = np.argsort(codes, kind="stable")
        codes, n = codes[order], n[order]
    head = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.zeros(0, np.int64)
    if n is None:
        return codes[head], np.diff(np.append(head, len(codes)))
    return codes[head], np.add.reduceat(n, head) if len(head) else n[:0]


class Lookup:
    """Codes in a table with open addressing, to find many at once."""

    def __init__(self, codes: np.ndarray, slots: np.ndarray | None = None):
        if slots is not None:
            self.codes, self.slots, self.shift = codes, slots, 65 - len(slots).bit_length()
            return
        self.shift = 64 - max(4, int(2 * len(codes) + 1).bit_length())
        self.slots = np.full(1 << (64 - self.shift), -1, np.int32)
        self.codes = codes
        left = np.arange(len(codes), dtype=np.int32)
        at = self._home(codes)
        while len(left):
            free = self.slots[at] < 0
            _, one = np.unique(at[free], return_index=True)
            taken = np.flatnonzero(free)[one]
            self.slots[at[taken]] = left[taken]
            rest = np.ones(len(left), bool)
            rest[taken] = False
            left, at = left[rest], (at[rest] + 1) & (len(self.slots) - 1)

    def _home(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * _U(0x9E3779B97F4A7C15)) >> _U(self.shift)).astype(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Index of each code, -1 if it isn't there."""
        if not len(self.codes):
            return np.full(len(codes), -1, np.int32)
        at = self._home(codes)
        out = self.slots[at]
        live = np.flatnonzero(out >= 0)
        live = live[self.codes[out[live]] != codes[live]]
        while len(live):
            at[live] = (at[live] + 1) & (len(self.slots) - 1)
            out[live] = self.slots[at[live]]
            live = live[out[live] >= 0]
            live = live[self.codes[out[live]] != codes[live]]
        return out


def grams(data: np.ndarray, offsets: np.ndarray, depth: int) -> np.ndarray:
    """For every byte of every text: it, and above it the ``depth`` bytes before it, the last lowest; 0 before a text."""
    out = data.astype(_U)
    within = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    for j in range(1, depth + 1):
        before = np.zeros(len(data), _U)
        before[j:] = data[:-j] if j else data
        before[within < j] = 0
        out |= before << _U(8 * j)
    return out


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Log gamma for x > 0: Stirling's series at x + 8."""
    low = np.zeros_like(x)
    for i in range(8):
        low += np.log(x + i)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - low


def _up(key: np.ndarray, d: int) -> np.ndarray:
    """The same byte or decision in the context's last d bytes."""
    return key & _U((1 << (8 * d + 8)) - 1)


class Tree:
    """The weighted tree from counts of grams. For each depth it keeps the different grams of that depth, sorted, with
    running counts: a node is a range of them, so its own counts are differences. Beside them only the weight with which
    a node stops the tree is kept, at the range's first gram, for each of the eight decisions.

    With ``least`` it is a part of the subtrees from that depth down, and ``up`` has the sums of its log probabilities by
    the decisions of the depth above; with ``under``, such sums, it is the levels above the subtrees."""

    def __init__(self, codes: np.ndarray, n: np.ndarray, depth: int, least: int = 0, under: tuple[np.ndarray, np.ndarray] | None = None):
        self.depth, self.least = depth, least
        sums = {d: summed(_up(codes, d), n) for d in range(least, depth + 1)}
        self.levels = {d: (c, np.concatenate(([0], np.cumsum(m)))) for d, (c, m) in sums.items()}
        self.stops = {d: np.zeros((8, len(c)), np.float32) for d, (c, _) in sums.items() if d < depth or under is not None}
        passed: list[tuple[np.ndarray, np.ndarray]] = []
        for j in range(8):
            below: tuple[np.ndarray, np.ndarray] | None = None
            if under is not None:
                mine = (under[0] & _U(255)) >> _U(j) == 1
                below = under[0][mine], under[1][mine]
            for d in range(depth, least - 1, -1):
                c, m = sums[d]
                key = (c & ~_U(255)) | _U(1 << j) | ((c & _U(255)) >> _U(8 - j))
                head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
                key = key[head]
                ones = np.add.reduceat(np.where(c >> _U(7 - j) & _U(1) > 0, m, 0), head).astype(np.float64) if len(head) else np.zeros(0)
                both = np.add.reduceat(m, head).astype(np.float64) if len(head) else np.zeros(0)
                total = _lgamma(both - ones + 0.5) + _lgamma(ones + 0.5) - _lgamma(both + 1) - np.log(np.pi)
                if below is not None:
                    up = np.searchsorted(key, _up(below[0], d))
                    own = _HALF + total
                    total = np.logaddexp(own, _HALF + np.bincount(up, below[1], len(key)))
                    self.stops[d][j, head] = np.exp(np.minimum(own - total, 0))
                below = key, total
            if least:
                parents, at = np.unique(_up(below[0], least - 1), return_inverse=True)
                passed.append((parents, np.bincount(at, below[1], len(parents))))
        del sums, below
        if least or under is not None:
            self.up = tuple(map(np.concatenate, zip(*passed, strict=True))) if least else None
            return
        self.codes = self.levels[depth][0]
        self.logs = np.concatenate([self._logs(x).astype(np.float32) for x in np.array_split(self.codes, max(1, len(self.codes) >> 17))])
        self.table = Lookup(self.codes)

    def _logs(self, codes: np.ndarray, top: Tree | None = None) -> np.ndarray:
        """Log10 of the chance of the last byte of each gram, also of grams never seen; ``top``: the levels above."""
        chance, begun = np.full((8, len(codes)), 0.5), np.zeros((8, len(codes)), bool)
        for tree in (self, top) if top else (self,):
            tree._mix(codes, chance, begun)
        symbol = codes & _U(255)
        return sum(np.log10(np.where(symbol >> _U(7 - j) & _U(1) > 0, chance[j], 1 - chance[j])) for j in range(8))

    def _mix(self, codes: np.ndarray, chance: np.ndarray, begun: np.ndarray) -> None:
        """Chances of ones, mixed from this tree's deepest level to its least."""
        symbol = codes & _U(255)
        bits = [symbol >> _U(7 - j) & _U(1) > 0 for j in range(8)]
        for d in range(self.depth, self.least - 1, -1):
            c, upto = self.levels[d]
            if not len(c):
                continue
            context = _up(codes, d) & ~_U(255)
            low, high = np.searchsorted(c, context), np.searchsorted(c, context | _U(255), "right")
            for j in range(8):
                middle = np.searchsorted(c, context | (symbol & _U(256 - (1 << (8 - j)))) | _U(1 << (7 - j)))
                one = (upto[high] - upto[middle] + 0.5) / (upto[high] - upto[low] + 1.0)
                there = high > low
                w = 1.0 if d not in self.stops else np.where(begun[j], self.stops[d][j, np.minimum(low, len(c) - 1)], 1.0)  # the deepest context that was seen ends the path
                chance[j] = np.where(there, w * one + (1 - w) * chance[j], chance[j])
                begun[j] |= there
                low, high = np.where(bits[j], middle, low), np.where(bits[j], high, middle)

    def save(self, path: str) -> None:
        """Writes a whole tree as one file: a line that says where its arrays are, and the arrays."""
        arrays = {"logs": self.logs, "slots": self.table.slots} | {f"codes{d}": c for d, (c, _) in self.levels.items()} | {f"upto{d}": n for d, (_, n) in self.levels.items()} | {f"stops{d}": x for d, x in self.stops.items()}
        places, at = {}, 0
        for name, x in arrays.items():
            places[name] = (x.dtype.str, x.shape, at)
            at += -(-x.nbytes // 64) * 64
        head = json.dumps({"depth": self.depth, "arrays": places}).encode()
        head += b" " * (63 - len(head) % 64) + b"\n"
        with warc.opened(path, "wb") as f:
            f.write(head)
            for x in arrays.values():
                f.write(np.ascontiguousarray(x).tobytes())
                f.write(bytes(-x.nbytes % 64))

    @classmethod
    def load(cls, path: str) -> Tree:
        """The tree in a file; a local file is mapped, so that workers of one machine share it."""
        local = "/" + path[5:].lstrip("/") if path.startswith("file:") else path
        if "://" not in local and os.path.exists(local):
            data = np.memmap(local, np.uint8, "r")
        else:
            with warc.opened(path, "rb") as f:
                data = np.frombuffer(f.read(), np.uint8)
        head = 64
        while data[head - 1] != 10:
            head += 64
        said = json.loads(data[:head].tobytes())
        got = {name: np.frombuffer(data[head + at : head + at + int(np.prod(shape)) * np.dtype(kind).itemsize], kind).reshape(shape) for name, (kind, shape, at) in said["arrays"].items()}
        tree = cls.__new__(cls)
        tree.depth, tree.least = said["depth"], 0
        tree.levels = {d: (got[f"codes{d}"], got[f"upto{d}"]) for d in range(tree.depth + 1)}
        tree.stops = {d: got[f"stops{d}"] for d in range(tree.depth + 1) if f"stops{d}" in got}
        tree.codes, tree.logs = tree.levels[tree.depth][0], got["logs"]
        tree.table = Lookup(tree.codes, got["slots"])
        return tree

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Log10 probability of each text."""
        codes = grams(data, offsets, self.depth)
        at = self.table.find(codes)
        logs = self.logs[at].astype(np.float64) if len(self.logs) else np.zeros(len(codes))
        new = np.flatnonzero(at < 0)
        if len(new):
            different, index = np.unique(codes[new], return_inverse=True)
            logs[new] = self._logs(different)[index]
        total = np.concatenate(([0.0], np.cumsum(logs)))
        return total[offsets[1:]] - total[offsets[:-1]]


_LOADED: dict[str, Tree] = {}


def loaded(path: str) -> Tree:
    """The tree in a file, opened once in each worker."""
    if path not in _LOADED:
        _LOADED.clear()
        _LOADED[path] = Tree.load(path)
    return _LOADED[path]


def written(counts: DataFrame, depth: int) -> str:
    """The tree of all counted grams, weighted by one task and written to the shared folder: its path."""
    scan.shared_dir(counts)
    folder = f"{counts.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/tree-{uuid.uuid4().hex}"

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(np.frombuffer(a, _U), np.frombuffer(b, np.int64)) for x in batches for a, b in zip(x.column("codes").to_pylist(), x.column("ns").to_pylist(), strict=True)]
        codes, n = summed(*map(np.concatenate, zip(*got, strict=True))) if got else (np.zeros(0, _U), np.zeros(0, np.int64))
        del got
        path = f"{folder}/{uuid.uuid4().hex}"  # an attempt's own
        Tree(codes, n, depth).save(path)
        del codes, n
        scan.trimmed()
        yield pa.RecordBatch.from_arrays([pa.array([path])], ["path"])

    return scan.cut(counts.where("kind = 1").select("codes", "ns").repartition(1).mapInArrow(build, "path string")).first()["path"]


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = scan.LOWER[data]
    starts, ends, first = scan.spans(data, offsets, scan.NON_SPACE)
    return scan.word_hashes(data, starts, ends), first


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return (scan.mix(h, 9) % _U(n)).astype(np.int32)


def _split(to: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(to, kind="stable")
    head = np.flatnonzero(np.concatenate(([True], to[order][1:] != to[order][:-1]))) if len(to) else np.zeros(0, np.int64)
    for i in np.split(order, head[1:]) if len(to) else ():
        yield int(to[i[0]]), i


def counted(training: DataFrame, depth: int, buckets: int) -> DataFrame:
    """Counts of words (kind 0) and grams (kind 1) of all training texts (columns k, t), one row a bucket and kind:
    p, kind, codes, ns (sorted, as bytes), entries, total, top (index of the most frequent entries)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {0: [], 1: []}

        def sent() -> Iterator[pa.RecordBatch]:
            for kind, parts in held.items():
                if parts:
                    codes, n = summed(*map(np.concatenate, zip(*parts, strict=True)))
                    each = list(_split(_bucket(codes, buckets)))
                    yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in each], pa.int32()), pa.array([kind] * len(each), pa.int32()), pa.array([codes[i].tobytes() for _, i in each], pa.binary()), pa.array([n[i].astype(np.int64).tobytes() for _, i in each], pa.binary())], ["p", "kind", "codes", "ns"])
                    parts.clear()

        for batch, data, offsets in scan.slices(batches, "t", PART):
            h, _ = _words(data, offsets)
            held[0] += [summed(h), (np.array([END]), np.array([batch.num_rows]))]
            held[1].append(summed(grams(data, offsets, depth)))
            if sum(len(x) for parts in held.values() for x, _ in parts) > HELD:
                yield from sent()
        yield from sent()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for p, kind, codes, n in zip(*(batch.column(c).to_pylist() for c in ("p", "kind", "codes", "ns")), strict=True):
                parts = sums.setdefault((p, kind), [])
                parts.append((np.frombuffer(codes, _U), np.frombuffer(n, np.int64)))
                if len(parts) >= 64:
                    parts[:] = [summed(*map(np.concatenate, zip(*parts, strict=True)))]
        for (p, kind), parts in sums.items():
            codes, n = summed(*map(np.concatenate, zip(*parts, strict=True)))
            top = np.sort(np.argsort(-n, kind="stable")[: -(-HOT // buckets)]).astype(np.int32) if kind == 0 else np.zeros(0, np.int32)
            hot = np.stack((codes[top], n[top].astype(_U)))
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([kind], pa.int32()), pa.array([codes.tobytes()], pa.binary()), pa.array([n.astype(np.int64).tobytes()], pa.binary()), pa.array([len(codes)], pa.int64()), pa.array([int(n.sum())], pa.int64()), pa.array([hot.tobytes()], pa.binary())], ["p", "kind", "codes", "ns", "entries", "total", "hot"])

    sent = training.mapInArrow(count, "p int, kind int, codes binary, ns binary").repartition(buckets, "p", "kind")
    return scan.cut(sent.mapInArrow(add, "p int, kind int, codes binary, ns binary, entries long, total long, hot binary"))


def _beneath(codes: np.ndarray, parts: int) -> np.ndarray:
    """The bucket of each gram's subtree."""
    return _bucket(codes >> _U(8) & _U((1 << 8 * TOP) - 1), parts)


def dealt(rows: DataFrame, counts: DataFrame, depth: int, entries: int) -> DataFrame:
    """k, held, t and lm (log10 probability) of every row, by the tree of ``depth`` in subtrees that no task has all of."""
    spark = rows.sparkSession
    buckets = scan.partitions(rows)
    parts = max(buckets, -(-entries // DEALT))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column("codes").to_pylist(), batch.column("ns").to_pylist(), strict=True):
                codes, n = np.frombuffer(a, _U), np.frombuffer(b, np.int64)
                for q, i in _split(_beneath(codes, parts)):
                    yield pa.RecordBatch.from_arrays([pa.array([q], pa.int32()), pa.array([codes[i].tobytes()], pa.binary()), pa.array([n[i].tobytes()], pa.binary())], ["q", "codes", "ns"])

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for q, a, b in zip(*(batch.column(c).to_pylist() for c in ("q", "codes", "ns")), strict=True):
                got.setdefault(q, []).append((np.frombuffer(a, _U), np.frombuffer(b, np.int64)))
        for q in sorted(got):
            codes, n = summed(*map(np.concatenate, zip(*got.pop(q), strict=True)))
            short, often = summed(_up(codes, TOP - 1), n)
            cells = [codes, n, *Tree(codes, n, depth, TOP).up, short, often]
            yield pa.RecordBatch.from_arrays([pa.array([q], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in cells)], ["q", "codes", "ns", "keys", "sums", "short", "often"])

    dealt_out = counts.where("kind = 1").select("codes", "ns").mapInArrow(split, "q int, codes binary, ns binary").repartition(parts, "q")
    trees = scan.cut(dealt_out.mapInArrow(grow, "q int, codes binary, ns binary, keys binary, sums binary, short binary, often binary"))
    short, often = (np.zeros(0, _U), np.zeros(0, np.int64))
    keys, sums = (np.zeros(0, _U), np.zeros(0))
    for r in trees.select("q", "keys", "sums", "short", "often").orderBy("q").toLocalIterator():  # one at a time: at most 2**16 of each are held
        short, often = summed(np.concatenate((short, np.frombuffer(r["short"], _U))), np.concatenate((often, np.frombuffer(r["often"], np.int64))))
        keys, sums = summed(np.concatenate((keys, np.frombuffer(r["keys"], _U))), np.concatenate((sums, np.frombuffer(r["sums"], np.float64))))
    top = spark.sparkContext.broadcast(Tree(short, often, TOP - 1, 0, (keys, sums)))

    names = ["slice", "tag", "q", "a", "b", "c", "d"]
    types = (pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4)
    schema = "slice long, tag int, q int, a binary, b binary, c binary, d binary"

    def row(*cells) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(cells, types, strict=True)], names)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch, data, offsets in scan.slices(batches, "t", PART):
            k, held = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("k", "held"))
            yield row(number, 2, None, data.tobytes(), offsets.astype(np.int64).tobytes(), k.astype(np.int64).tobytes(), held.astype(bool).tobytes())
            codes = np.unique(grams(data, offsets, depth))
            for q, i in _split(_beneath(codes, parts)):
                yield row(number, 1, q, codes[i].tobytes(), None, None, None)
            number += 1

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tree = None, None
        for batch in batches:
            for number, tag, q, a, b in zip(*(batch.column(c).to_pylist() for c in names[:5]), strict=True):
                if tag == 0:
                    at, tree = q, Tree(np.frombuffer(a, _U), np.frombuffer(b, np.int64), depth, TOP)
                    continue
                if at != q:  # no training text has any of these contexts
                    at, tree = q, Tree(np.zeros(0, _U), np.zeros(0, np.int64), depth, TOP)
                codes = np.frombuffer(a, _U)
                logs = np.concatenate([tree._logs(x, top.value) for x in np.array_split(codes, max(1, len(codes) >> 17))])
                c = tree.levels[depth][0]
                if len(c):  # known strings as precise as in a tree that is broadcast
                    known = c[np.minimum(np.searchsorted(c, codes), len(c) - 1)] == codes
                    logs = np.where(known, logs.astype(np.float32), logs)
                yield row(number, 1, q, logs.tobytes(), None, None, None)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, np.ndarray] = {}
        for batch in batches:
            for tag, q, a, b, c, d in zip(*(batch.column(x).to_pylist() for x in names[1:]), strict=True):
                if tag == 1:
                    got[q] = np.frombuffer(a, np.float64)
                    continue
                data, offsets = np.frombuffer(a, np.uint8), np.frombuffer(b, np.int64)
                codes, index = np.unique(grams(data, offsets, depth), return_inverse=True)
                logs = np.zeros(len(codes))
                for q_, i in _split(_beneath(codes, parts)):
                    logs[i] = got[q_]
                total = np.concatenate(([0.0], np.cumsum(logs[index])))
                got = {}
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(c, np.int64)), pa.array(np.frombuffer(d, bool)), scan.strings(data, offsets).cast(pa.string()), pa.array(total[offsets[1:]] - total[offsets[:-1]])], ["k", "held", "t", "lm"])

    asked = scan.cut(rows.mapInArrow(ask, schema))
    none = F.lit(None).cast("binary")
    grown = trees.select(F.lit(0).cast("long").alias("slice"), F.lit(0).alias("tag"), "q", F.col("codes").alias("a"), F.col("ns").alias("b"), none.alias("c"), none.alias("d"))
    answers = asked.where("tag = 1").unionByName(grown).repartition(parts, "q").sortWithinPartitions("q", "tag").mapInArrow(answer, schema)
    return scan.cut(asked.where("tag = 2").unionByName(answers).repartition(buckets, "slice").sortWithinPartitions("slice", "tag").mapInArrow(gather, "k long, held boolean, t string, lm double"))


_DOC = np.dtype([("ref", "u8"), ("k", "i8"), ("held", "?"), ("n", "i8"), ("known", "i8"), ("sum", "f8"), ("bytes", "i8"), ("score", "f8")])
_PART = np.dtype([("ref", "u8"), ("known", "i8"), ("sum", "f8")])


def scored(docs: DataFrame, held: Column, key: str = "doc_id", text: str = "text", depth: int = DEPTH) -> DataFrame:
    """k (NO_KEY for null), held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes of every row; the model
    learns from the rows that aren't held out."""
    spark = docs.sparkSession
    buckets = scan.partitions(docs)
    rows = scan.keyed(docs, key, text, held.alias("held"))
    training = rows.where("not held").select("k", "t")
    counts = counted(training, depth, buckets)
    size = {r["kind"]: r for r in counts.groupBy("kind").agg(F.sum("entries").alias("entries"), F.sum("total").alias("total")).collect()}
    tokens, different = (size[0]["total"], size[0]["entries"]) if 0 in size else (0, 0)
    whole = depth < TOP or 1 not in size or size[1]["entries"] <= GRAMS
    if whole:
        path = written(counts, depth)
    else:
        rows = dealt(rows, counts, depth, size[1]["entries"])
    got = [np.frombuffer(r["hot"], _U).reshape(2, -1) for r in counts.where("kind = 0").select("hot").collect()]
    hot, often = np.concatenate(got, 1) if got else np.zeros((2, 0), _U)
    order = np.argsort(hot)
    common = spark.sparkContext.broadcast((Lookup(hot[order]), np.log10(often[order].astype(np.float64) + 0.1)))
    below = float(np.log10(tokens + 0.1 * (different + 1)))

    schema = "p int, tag int, a binary, b binary, c binary"
    names = ["p", "tag", "a", "b", "c"]

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, (known, logs) = loaded(path) if whole else None, common.value
        parts: list[tuple[np.ndarray, ...]] = []
        held: list[np.ndarray] = []
        count = 0

        def sent() -> Iterator[pa.RecordBatch]:
            doc = np.concatenate(held)
            each = [(p, 1, doc[i].tobytes(), None, None) for p, i in _split((doc["ref"] % _U(buckets)).astype(np.int32))]
            h, owner = (np.concatenate(x) for x in zip(*parts, strict=True))
            for p, i in _split(_bucket(h, buckets)):
                refs, index = np.unique(owner[i], return_inverse=True)
                each.append((p, 0, h[i].tobytes(), refs.tobytes(), index.astype(np.int32).tobytes()))
            for at in range(0, len(each), 16):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*each[at : at + 16], strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names)

        for batch, data, offsets in scan.slices(batches, "t", PART):
            h, first = _words(data, offsets)
            doc = np.zeros(batch.num_rows, _DOC)
            doc["k"] = batch.column("k").to_numpy(zero_copy_only=False)
            doc["held"] = batch.column("held").to_numpy(zero_copy_only=False)
            # equal rows share a reference; the second pass divides what they gathered
            doc["ref"] = scan.mix(scan.mix(doc["k"].view(_U), 1) ^ scan.word_hashes(data, offsets[:-1], offsets[1:]), 2)
            doc["bytes"] = np.diff(offsets)
            doc["score"] = model.scores(data, offsets) if whole else batch.column("lm").to_numpy(zero_copy_only=False)
            doc["n"] = np.diff(first) + 1
            h = np.insert(h, first[1:], END)
            owner = np.repeat(np.arange(batch.num_rows), doc["n"])
            at = known.find(h)
            ok = at >= 0
            doc["known"] = np.bincount(owner[ok], minlength=batch.num_rows)
            doc["sum"] = np.bincount(owner[ok], logs[at[ok]], batch.num_rows)
            held.append(doc)
            parts.append((h[~ok], doc["ref"][owner[~ok]]))
            count += len(parts[-1][0]) + len(doc)
            if count > HELD // 2:
                yield from sent()
                parts, held, count = [], [], 0
        if held:
            yield from sent()

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        asked: dict[int, list[tuple[bytes, bytes, bytes]]] = {}
        for batch in batches:
            for p, tag, a, b, c in zip(*(batch.column(x).to_pylist() for x in names), strict=True):
                if tag == 1:
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([1], pa.int32()), pa.array([a], pa.binary())], ["d", "tag", "a"])
                elif tag == 2:
                    tables[p] = [(np.frombuffer(a, _U), np.frombuffer(b, np.int64))]
                else:
                    asked.setdefault(p, []).append((a, b, c))
        gathered: list[np.ndarray] = []
        for p, rows in asked.items():
            codes, n = tables[p][0] if p in tables else (np.zeros(0, _U), np.zeros(0, np.int64))
            for a, b, c in rows:
                h, refs, index = np.frombuffer(a, _U), np.frombuffer(b, _U), np.frombuffer(c, np.int32)
                count = np.zeros(len(h))
                if len(codes):
                    at = np.minimum(np.searchsorted(codes, h), len(codes) - 1)
                    count = np.where(codes[at] == h, n[at], 0).astype(np.float64)
                part = np.zeros(len(refs), _PART)
                part["ref"], part["known"], part["sum"] = refs, np.bincount(index[count > 0], minlength=len(refs)), np.bincount(index, np.log10(count + 0.1), len(refs))
                gathered.append(part)
        if gathered:
            part = np.concatenate(gathered)
            for d, i in _split((part["ref"] % _U(buckets)).astype(np.int32)):
                yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([0], pa.int32()), pa.array([part[i].tobytes()], pa.binary())], ["d", "tag", "a"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs_, parts = [], []
        for batch in batches:
            for tag, a in zip(batch.column("tag").to_pylist(), batch.column("a").to_pylist(), strict=True):
                (docs_ if tag else parts).append(np.frombuffer(a, _DOC if tag else _PART))
        if not docs_:
            return
        doc = np.sort(np.concatenate(docs_), order="ref")
        refs, index, copies = np.unique(doc["ref"], return_inverse=True, return_counts=True)
        known, total = np.zeros(len(refs)), np.zeros(len(refs))
        if parts:
            part = np.concatenate(parts)
            part = part[np.lexsort((part["sum"], part["ref"]))]  # one order of summing whatever the order of arrival
            at = np.searchsorted(refs, part["ref"])
            known, total = np.bincount(at, part["known"], len(refs)) / copies, np.bincount(at, part["sum"], len(refs)) / copies
        base = doc["sum"] + total[index] - doc["n"] * below
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.ascontiguousarray(x)) for x in (doc["k"], doc["held"], doc["n"], doc["known"] + np.rint(known[index]).astype(np.int64), np.full(len(doc), tokens, np.int64), base, doc["score"], doc["bytes"])],
            ["k", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes"],
        )

    asked = rows.mapInArrow(first_pass, schema)
    tables = counts.where("kind = 0").select("p", F.lit(2).alias("tag"), F.col("codes").alias("a"), F.col("ns").alias("b"), F.lit(None).cast("binary").alias("c"))
    answers = asked.unionByName(tables).repartition(buckets, "p").mapInArrow(looked_up, "d int, tag int, a binary")
    return answers.repartition(buckets, "d").mapInArrow(joined, "k long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long")


def op6(spark, sf_dir: str) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))
    rows = scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), held)
    bits = F.when(F.col("n_bytes") > 0, -F.col("score") / F.log10(F.lit(2.0)) / F.col("n_bytes"))
    return rows.select(scan.unkeyed().alias("doc_id"), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", bits.alias("bits_per_byte"))
