"""SentencePiece encoding and decoding by a max-plus scan over token lattices.

The model's merges (any two neighbours whose concatenation is a piece, best score
first, leftmost on ties) have a lattice form: a sequence of pieces is the encoding
of a text if and only if each piece encodes to itself and each neighbouring pair
encodes to itself. With weight 0 on such steps and minus infinity on others, the
best path through the lattice is the library's encoding, exactly. The forward
pass keeps for each position the last piece of the best path to it.

Two characters that stand side by side in no piece have a cut between them on
every path (so at least before a space that follows another character). A text
falls apart there into units whose paths are independent; each is encoded once
per distinct unit and slice.

Giant texts are split into chunks, in rows of their own. The state at a chunk's
boundary is the piece that first ends at or behind it. Each chunk yields the
max-plus transfer matrix from the states at its left to those at its right; the
matrices of a text are combined associatively (prefix and suffix products), which
fixes the state at every boundary, and every chunk is then backtraced by itself.

Models: BPE with byte fallback, a leading space added, no other normalisation
(read from the file; any other kind is refused).

Defined cases: a null or empty text has no pieces and decodes to ""; characters
without a piece become their UTF-8 bytes' pieces; strings like those of control
pieces are ordinary text; the character that the model writes for a space is a
space, as in the library, and decodes as one; repeated rows get equal results; null ids come back
null; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm import scan

#: Where the vocabulary file is, unless given.
MODEL = os.environ.get("TARN_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
#: Characters beyond which a text is split, and of a chunk.
GIANT, CHUNK = 1 << 16, 1 << 15
#: Units and pairs that a worker remembers.
UNITS, PAIRS = 150_000, 400_000
SPACE = "▁"
#: No piece: start of a unit, and a character that has no piece.
BEGIN, UNKNOWN = -1, -2


def _varint(b: bytes, i: int) -> tuple[int, int]:
    x = s = 0
    while True:
        x |= (b[i] & 127) << s
        i, s = i + 1, s + 7
        if b[i - 1] < 128:
            return x, i


def _fields(b: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a protocol buffer message."""
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        if tag & 7 == 0:
            value, i = _varint(b, i)
        elif tag & 7 == 1:
            value, i = b[i : i + 8], i + 8
        elif tag & 7 == 5:
            value, i = b[i : i + 4], i + 4
        else:
            n, i = _varint(b, i)
            value, i = b[i : i + n], i + n
        yield tag >> 3, value


class Vocabulary:
    """The pieces of a model file, with the lattice's tests remembered."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        pieces, kinds, scores = [], [], []
        trainer, normal = {}, {}
        for number, value in _fields(data):
            if number == 1:
                x = dict(_fields(value))
                pieces.append(x[1].decode())
                scores.append(float(np.frombuffer(x.get(2, b"\0\0\0\0"), "<f4")[0]))
                kinds.append(x.get(3, 1))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normal = dict(_fields(value))
        if trainer.get(3, 1) != 2 or normal.get(2) or not normal.get(3, 1) or normal.get(4, 1):
            raise ValueError("only BPE models without normalisation, with a leading space, are supported")
        self.pieces = pieces
        self.ids = {p: i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == 1}
        self.scores = scores
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == 6}
        self.unknown = kinds.index(2)
        self.longest = max(map(len, self.ids))
        if any(SPACE in p.lstrip(SPACE) for p in self.ids) or any(c not in self.ids for p in self.ids for c in p):
            raise ValueError("pieces with inner spaces, or of characters that are no pieces, are not supported")
        # bytes of every piece, for decoding
        raw = [b"" if k in (2, 3) else bytes([int(p[3:5], 16)]) if k == 6 else p.replace(SPACE, " ").encode() for p, k in zip(pieces, kinds, strict=True)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_size = np.array([len(x) for x in raw], np.int64)
        self.raw_at = np.cumsum(self.raw_size) - self.raw_size
        self.adjacent = np.zeros(1 << 16, bool)  # pairs of bytes inside some piece
        for p in self.ids:
            x = np.frombuffer(p.replace(SPACE, " ").encode(), np.uint8).astype(np.int64)
            self.adjacent[x[:-1] << 8 | x[1:]] = True
        self._pair: dict[int, bool] = {}  # by a << 32 | b
        self.letters = {p for p in self.ids if len(p) == 1}
        self.found = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.found.add_word(p, (i, len(p)))
        self.found.make_automaton()
        self._unit: dict[bytes, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """Plain merging, for the lattice's tests on one or two pieces."""
        parts, ids, scores = list(text), self.ids, self.scores
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                p = ids.get(parts[i] + parts[i + 1])
                if p is not None and (best is None or scores[p] > best):
                    best, at = scores[p], i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, a: int, b: int) -> bool:
        """Weight 0 (not minus infinity) for piece b behind a."""
        if a == UNKNOWN or b == UNKNOWN:
            return True
        ok = self._pair.get(a << 32 | b)
        if ok is None:
            if len(self._pair) > PAIRS:
                self._pair.clear()
            y = self.pieces[b]
            ok = self._pair[a << 32 | b] = self.merged(y) == [y] if a == BEGIN else self.merged(self.pieces[a] + y) == [self.pieces[a], y]
        return ok

    def extend(self, text: str, last: list[int | None], at: int, to: int) -> None:
        """Forward pass: last[i] for at < i <= to, from what is known up to at. last[i] is None where no path ends."""
        ids, longest = self.ids, self.longest
        for i in range(at + 1, to + 1):
            last[i] = None
            known = False
            for j in range(max(0, i - longest), i):
                before = last[j]
                if before is None:
                    continue
                p = ids.get(text[j:i])
                if p is None:
                    continue
                known = True
                if self.fits(before, p) and (before >= 0 or self.fits(BEGIN, p)):
                    last[i] = p
                    break
            if last[i] is None and not known and last[i - 1] is not None and text[i - 1] not in ids:
                last[i] = UNKNOWN

    def forward(self, text: str) -> list[int | None]:
        """The forward pass over a whole unit whose characters all are pieces: at each end its pieces, longest first."""
        last: list[int | None] = [None] * (len(text) + 1)
        last[0] = BEGIN
        get = self._pair.get
        for end, (p, size) in self.found.iter(text):
            if last[end + 1] is None:
                before = last[end + 1 - size]
                if before is not None:
                    ok = get(before << 32 | p)
                    if ok or ok is None and self.fits(before, p):
                        last[end + 1] = p
        return last

    def back(self, text: str, last: list[int | None], at: int, to: int) -> list[int]:
        """Pieces of the best path from at to to; an unknown character as its bytes."""
        out: list[int] = []
        while to > at:
            p = last[to]
            if p == UNKNOWN:
                out.extend(self.bytes.get(b, self.unknown) for b in reversed(text[to - 1].encode("utf-8", "surrogatepass")))
                to -= 1
            else:
                out.append(p)
                to -= len(self.pieces[p])
        out.reverse()
        return out

    def unit(self, raw: bytes) -> bytes:
        """Pieces of one unit, as int32 in bytes."""
        got = self._unit.get(raw)
        if got is None:
            if len(self._unit) > UNITS:
                self._unit.clear()
            text = raw.decode("utf-8", "surrogatepass").replace(" ", SPACE)
            whole = self.ids.get(text)
            if whole is not None and self.fits(BEGIN, whole):
                ids = [whole]
            else:
                if self.letters.issuperset(text):
                    last = self.forward(text)
                else:
                    last = [BEGIN] + [None] * len(text)
                    self.extend(text, last, 0, len(text))
                ids = self.back(text, last, 0, len(text))
            got = array("i", ids).tobytes()
            if len(raw) <= 64:
                self._unit[raw] = got
        return got

    def encode_all(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of many texts, one after another, and where each text's begin."""
        full = np.diff(offsets) > 0
        shift = np.concatenate(([0], np.cumsum(full)))
        if not full.any():
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        text = np.insert(data, offsets[:-1][full], 0x20)  # the leading space
        offsets = offsets + shift
        head = (text & 0xC0) != 0x80
        head[1:] &= ~self.adjacent[text[:-1].astype(np.uint16) << 8 | text[1:]]
        head[offsets[:-1][full]] = True
        starts = np.flatnonzero(head)
        ends = np.append(starts[1:], len(text))
        _, one, index = np.unique(scan.word_hashes(text, starts, ends), return_index=True, return_inverse=True)
        raw = text.tobytes()
        each = [self.unit(raw[a:b]) for a, b in zip(starts[one].tolist(), ends[one].tolist(), strict=True)]
        flat = np.frombuffer(b"".join(each), np.int32)
        size = np.array([len(x) >> 2 for x in each], np.int64)
        begin = np.cumsum(size) - size
        n = size[index]
        at = np.cumsum(n) - n
        ids = flat[np.repeat(begin[index] - at, n) + np.arange(n.sum())]
        return ids, np.append(at, n.sum())[np.searchsorted(starts, offsets)]

    def decode_all(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of many piece sequences and their offsets; the leading space is taken off."""
        size = self.raw_size[ids]
        at = np.concatenate(([0], np.cumsum(size)))
        out = self.raw[np.repeat(self.raw_at[ids] - at[:-1], size) + np.arange(at[-1])]
        offsets = at[first]
        lead = offsets[:-1][np.diff(offsets) > 0]
        lead = lead[out[lead] == 0x20]
        keep = np.ones(len(out), bool)
        keep[lead] = False
        return out[keep], offsets - np.searchsorted(lead, offsets, "left")

    # -- chunks of a giant text ----------------------------------------------------------------------------------

    def states(self, text: str, at: int) -> list[tuple[int, int]]:
        """The possible states at a boundary: (piece, end) for pieces that begin before it and end at or behind it."""
        if at <= 0:
            return [(BEGIN, 0)]
        out = [(p, e) for s in range(max(0, at - self.longest), at) for e in range(at, min(len(text), s + self.longest) + 1) if (p := self.ids.get(text[s:e])) is not None]
        if text[at - 1] not in self.ids:
            out.append((UNKNOWN, at))
        return out

    def _run(self, text: str, state: tuple[int, int], to: int) -> list[int | None]:
        last: list[int | None] = [None] * (len(text) + 1)
        last[state[1]] = state[0]
        self.extend(text, last, state[1], to)
        return last

    def _forced(self, text: str, at: int, to: int) -> int | None:
        """The first position behind ``at`` where every path has a cut: before a space that no space precedes."""
        while (at := text.find(SPACE, at + 1, to)) >= 0:
            if text[at - 1] != SPACE:
                return at
        return None

    def transfer(self, text: str, left: int, right: int, ends: bool) -> tuple[list[tuple[int, int]], list[tuple[int, int]], np.ndarray]:
        """States at both boundaries and the max-plus matrix between them (0 or minus infinity). ``ends``: the text ends
        at ``right``. Runs that have met a cut that all paths share go on as one."""
        a, b = self.states(text, left), [(UNKNOWN, right)] if ends else self.states(text, right)
        m = np.full((len(a), len(b)), -np.inf)
        shared: np.ndarray | None = None
        for i, (piece, end) in enumerate(a):
            if end > right or ends and end > len(text):
                if (piece, end) in b:  # one piece covers the whole chunk
                    m[i, b.index((piece, end))] = 0
                continue
            cut = self._forced(text, end, right)
            if cut is None:
                m[i] = self._exits(text, self._run(text, (piece, end), right), b, ends)
                if not ends and (piece, end) in b:
                    m[i, b.index((piece, end))] = 0
                continue
            if self._run(text, (piece, end), cut)[cut] is None:
                continue
            if shared is None:
                final = cut
                while (nxt := self._forced(text, final, right)) is not None:
                    final = nxt
                shared = self._exits(text, self._run(text, (BEGIN, final), right), b, ends)
            m[i] = shared
        return a, b, m

    def _exits(self, text: str, last: list[int | None], b: list[tuple[int, int]], ends: bool) -> np.ndarray:
        out = np.full(len(b), -np.inf)
        for j, (piece, end) in enumerate(b):
            if ends:
                out[j] = 0 if last[end] is not None else -np.inf
                continue
            begin = end - (1 if piece == UNKNOWN else len(self.pieces[piece]))
            before = last[begin] if begin >= 0 else None
            if before is not None and self.fits(before, piece) and (before >= 0 or piece == UNKNOWN or self.fits(BEGIN, piece)):
                out[j] = 0
        return out

    def chunk_ids(self, text: str, enter: tuple[int, int], leave: tuple[int, int], ends: bool) -> list[int]:
        """Backtrace of one chunk: pieces behind the one that crosses its left boundary, up to and with the one that
        crosses its right boundary."""
        if enter[1] >= leave[1]:
            return []
        begin = leave[1] if ends else leave[1] - (1 if leave[0] == UNKNOWN else len(self.pieces[leave[0]]))
        out: list[int] = []
        at, last = enter[1], enter[0]
        while True:  # unit after unit
            cut = self._forced(text, at, begin)
            to = begin if cut is None else cut
            if last == BEGIN and to - at <= 64:
                out += np.frombuffer(self.unit(text[at:to].replace(SPACE, " ").encode("utf-8", "surrogatepass")), np.int32).tolist()
            else:
                run = self._run(text[:to], (last, at), to)
                out += self.back(text, run, at, to)
            if cut is None:
                break
            at, last = cut, BEGIN
        if not ends:
            out += [leave[0]] if leave[0] != UNKNOWN else [self.bytes.get(x, self.unknown) for x in text[begin].encode("utf-8", "surrogatepass")]
        return out


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The associative product of two transfer matrices."""
    return (a[:, :, None] + b[None, :, :]).max(1)


def boundary_states(matrices: list[np.ndarray]) -> list[int]:
    """Which state the best path has at each boundary, from prefix and suffix products."""
    before = [np.zeros((1, 1))]
    for m in matrices:
        before.append(max_plus(before[-1], m))
    after = [np.zeros((matrices[-1].shape[1], 1))]
    for m in reversed(matrices):
        after.append(max_plus(m, after[-1]))
    return [int((x[0] + y[:, 0]).argmax()) for x, y in zip(before, reversed(after), strict=True)]


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """Loaded once in each worker."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def _chunks(giants: DataFrame, size: int, reach: int) -> DataFrame:
    """k, h, i, n and the chunk's text with ``reach`` characters on either side; a leading space is added to the text,
    which is cut in one pass (what stands beside a chunk is taken from its neighbours, so they have ``reach`` at least)."""
    t = F.concat(F.lit(" "), F.replace("t", F.lit(SPACE), F.lit(" ")))
    rows = giants.select("k", "h", F.regexp_extract_all(t, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)).alias("cs"))
    rows = rows.select("k", "h", F.size("cs").alias("n"), F.posexplode(_with_neighbours(F.col("cs"))).alias("i", "c"))
    left, right = F.coalesce("c.left", F.lit("")), F.coalesce("c.right", F.lit(""))
    cut = F.substr(left, F.greatest(F.length(left) - reach, F.lit(0)) + 1)
    return rows.select("k", "h", "i", "n", F.concat(cut, "c.c", F.substr(right, F.lit(1), F.lit(reach))).alias("c"))


def _with_neighbours(cs: Column) -> Column:
    beside = F.arrays_zip(F.concat(F.array(F.lit("")), F.slice(cs, 1, F.size(cs) - 1)).alias("left"), cs.alias("c"), F.slice(cs, 2, F.size(cs)).alias("right"))
    return F.transform(beside, lambda x: F.struct(x["left"].alias("left"), x["c"].alias("c"), x["right"].alias("right")))


def _window(text: str, i: int, n: int, size: int, reach: int) -> tuple[str, int, int, bool]:
    """Text with pieces' spaces, left and right boundary in it, and whether the text ends with it."""
    left = min(i * size, reach)
    ends = i == n - 1
    return text.replace(" ", SPACE), left, len(text) if ends else left + size, ends


def encoded(docs: DataFrame, model: str = MODEL, key: str = "doc_id", text: str = "text", giant: int = GIANT, chunk: int = CHUNK, more: list[Column] | None = None) -> DataFrame:
    """k (NO_KEY for null), t, ids (array<int>) of every row, and the columns of ``more`` as a struct."""
    extra = bool(more)
    plain = scan.keyed(docs, key, text, *([F.struct(*more).alias("more")] if more else []))
    kind = f", more {plain.schema['more'].dataType.simpleString()}" if more else ""
    reach = vocabulary(model).longest + 1

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for batch, data, offsets in scan.slices(batches, "t"):
            if SPACE.encode() in data.tobytes():
                data, offsets = scan.buffers(pc.replace_substring(batch.column("t").cast(pa.large_string()), SPACE, " "))
            ids, first = v.encode_all(data, offsets)
            cols = {"k": batch.column("k"), "t": batch.column("t"), "ids": pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids))}
            if extra:
                cols["more"] = batch.column("more")
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    small = plain.where(F.length("t") <= giant).mapInArrow(short, f"k long, t string, ids array<int>{kind}")
    giants = plain.where(F.length("t") > giant).withColumn("h", F.xxhash64("t"))
    parts = _chunks(giants.select("k", "h", "t").dropDuplicates(["k", "h"]), chunk, reach)
    deal = scan.partitions(docs)

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for batch in batches:
            for k, h, i, n, c in zip(*(batch.column(x).to_pylist() for x in ("k", "h", "i", "n", "c")), strict=True):
                a, b, m = v.transfer(*_window(c, i, n, chunk, reach))
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (k, h)] + [pa.array([i], pa.int32()), pa.array([np.array(a, np.int32).tobytes()], pa.binary()), pa.array([np.array(b, np.int32).tobytes()], pa.binary()), pa.array([np.packbits(np.isfinite(m)).tobytes()], pa.binary())], ["k", "h", "i", "a", "b", "m"])

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict[tuple[int, int], list[tuple]] = {}
        for batch in batches:
            for k, h, *rest in zip(*(batch.column(x).to_pylist() for x in ("k", "h", "i", "a", "b", "m")), strict=True):
                texts.setdefault((k, h), []).append(tuple(rest))
        for (k, h), rows in texts.items():
            rows.sort()
            a, b = ([np.frombuffer(r[x], np.int32).reshape(-1, 2) for r in rows] for x in (1, 2))
            m = [np.where(np.unpackbits(np.frombuffer(r[3], np.uint8), count=len(x) * len(y)).reshape(len(x), len(y)) > 0, 0.0, -np.inf) for r, x, y in zip(rows, a, b, strict=True)]
            s = boundary_states(m)
            enter, leave = [x[j].tolist() for x, j in zip(a, s[:-1], strict=True)], [x[j].tolist() for x, j in zip(b, s[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(rows)), pa.array([h] * len(rows)), pa.array([r[0] for r in rows], pa.int32()), pa.array(enter, pa.list_(pa.int32())), pa.array(leave, pa.list_(pa.int32()))], ["k", "h", "i", "enter", "leave"])

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for batch in batches:
            for k, h, i, n, c, enter, leave in zip(*(batch.column(x).to_pylist() for x in ("k", "h", "i", "n", "c", "enter", "leave")), strict=True):
                text, _, _, ends = _window(c, i, n, chunk, reach)
                leave = (UNKNOWN, len(text)) if ends else tuple(leave)
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([h]), pa.array([i], pa.int32()), pa.array([v.chunk_ids(text, tuple(enter), leave, ends)], pa.list_(pa.int32()))], ["k", "h", "i", "ids"])

    found = parts.repartition(deal, "k", "h", "i").mapInArrow(matrices, "k long, h long, i int, a binary, b binary, m binary")
    ends = found.repartition(deal, "k", "h").mapInArrow(scanned, "k long, h long, i int, enter array<int>, leave array<int>")
    pieces = parts.join(ends, ["k", "h", "i"]).mapInArrow(traced, "k long, h long, i int, ids array<int>")
    whole = pieces.groupBy("k", "h").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", "ids"))), lambda x: x["ids"])).alias("ids"))
    return small.unionByName(giants.join(whole, ["k", "h"]).select("k", "t", "ids", *(["more"] if more else [])))


def decoded(rows: DataFrame, model: str = MODEL, ids: str = "ids") -> DataFrame:
    """The rows with the text of their pieces, as a column ``decoded``."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for batch in batches:
            at = 0
            lists = batch.column(ids)
            cuts = lists.offsets.to_numpy().astype(np.int64)
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(cuts, cuts[at] + (1 << 20), "right")) - 1)
                part = batch.slice(at, to - at)
                data, offsets = v.decode_all(lists.values.to_numpy()[cuts[at] : cuts[to]], cuts[at : to + 1] - cuts[at])
                text = [bytes(data[a:b]).decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(text, pa.string())], [*names, "decoded"])
                at = to

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())]))


def op1(spark, sf_dir: str) -> DataFrame:
    rows = encoded(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("k", "ids", F.xxhash64("t").alias("h"), F.length("t").cast("long").alias("n_chars"))
    back = decoded(rows)
    return back.select(scan.unkeyed().alias("doc_id"), "n_chars", F.size("ids").cast("long").alias("n_pieces"), "ids", (F.xxhash64("decoded") == F.col("h")).alias("round_trip"))
