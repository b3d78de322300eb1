"""Language ID by a linear-chain conditional random field over words.

Words are runs of letters (ASCII lower-cased). A word's emission score for each
language is the sum of learned weights of its byte n-grams with the word's ends
marked (so the first and last ones are its affixes), its entry in a lexicon of
words that recur in the training sample, and a bias. Learned transitions tie
neighbouring words. Forward-backward gives every word its posterior over the
languages; a text's language is that of the highest mean posterior, which is
its score.

Training takes a bounded sample: ``SAMPLE`` rows a language at most, those with
the smallest hashes of their ids, of at most ``SAMPLE_BYTES`` of text each.
Training lines are cut from them and joined across languages, so transitions
see switches. Only text and label are read; prediction sees the text alone.

Forward-backward runs for all texts of a slice at once: chains are cut into
blocks, each block's transfer matrix is computed side by side, the matrices are
chained per text, and each block is finished from its ends; this is exact for
any length.

Defined cases: a null text or one without a letter is "und" with score 0; words
of other scripts are words too; with no labelled row every text is "und"; null
ids are training rows if labelled, come back null and are not held out; repeated
rows get equal results; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm import scan

UND = "und"
SAMPLE, SAMPLE_BYTES = 400, 20_000
#: Hashed features, n-gram lengths, words of a training line and lines at most, rounds of training.
BUCKETS, GRAMS, LINE, LINES, ROUNDS = 1 << 17, (2, 3, 4), 32, 3000, 24
#: Words of a block in forward-backward.
CHAIN = 64
_U = np.uint64

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z and the accented capitals of Latin-1 in lower case."""
    out = scan.LOWER[data]
    if len(out) > 1:
        i = np.flatnonzero(out[:-1] == 0xC3) + 1
        i = i[(out[i] >= 0x80) & (out[i] <= 0x9E) & (out[i] != 0x97)]
        out[i] += 0x20
    return out


def _grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of the words, word after word, and where each word's begin (n + 1 entries)."""
    n = ends - starts
    size = n + 2
    begin = np.cumsum(size) - size
    total = int(size.sum())
    buf = np.empty(total + max(GRAMS), np.uint8)
    buf[total:] = 0
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    buf[np.repeat(begin + 1, n) + inner] = data[np.repeat(starts, n) + inner]
    buf[begin], buf[begin + size - 1] = 2, 3
    word = np.repeat(np.arange(len(n)), size)
    left = np.repeat(begin + size, size) - np.arange(total)  # bytes to the word's end
    ids, owner = [], []
    code = np.zeros(total, _U)
    for k in range(max(GRAMS)):
        code |= buf[k : k + total].astype(_U) << _U(8 * k)
        if k + 1 in GRAMS:
            ok = left > k
            ids.append((scan.mix(code[ok], k + 1) % _U(BUCKETS - 1)).astype(np.int32) + 1)
            owner.append(word[ok])
    order = np.argsort(np.concatenate(owner), kind="stable")
    counts = sum(np.bincount(o, minlength=len(n)) for o in owner)
    return np.concatenate(ids)[order], np.concatenate(([0], np.cumsum(counts)))


class Field:
    """The model: languages, weights of the hashed features, lexicon with weights, start and transition scores."""

    def __init__(self, languages: list[str], lexicon: np.ndarray):
        n = len(languages)
        self.languages, self.lexicon = languages, lexicon
        self.weights, self.words = np.zeros((BUCKETS, n)), np.zeros((len(lexicon) + 1, n))
        self.start, self.moves = np.zeros(n), np.zeros((n, n))

    def entry(self, h: np.ndarray) -> np.ndarray:
        """Index in the lexicon; its last row, which stays 0, for other words."""
        if not len(self.lexicon):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.lexicon, h), len(self.lexicon) - 1)
        return np.where(self.lexicon[at] == h, at, len(self.lexicon))

    def emissions(self, ids: np.ndarray, bounds: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """Scores of words; the mean over n-grams keeps long words from outweighing the chain."""
        out = np.empty((len(entry), len(self.languages)))
        for y in range(out.shape[1]):
            out[:, y] = np.add.reduceat(self.weights[:, y][ids], bounds[:-1]) if len(entry) else 0
        return out / np.sqrt(np.diff(bounds))[:, None] + self.words[entry] + self.weights[0]


def posteriors(psi: np.ndarray, first: np.ndarray, start: np.ndarray, moves: np.ndarray, block: int = CHAIN) -> np.ndarray:
    """Forward-backward of many chains: psi (words x labels, positive) of all chains, ``first`` where each begins
    (n + 1 entries), start and moves as factors. Returns each word's posterior."""
    n, m = np.diff(first), psi.shape[1]
    blocks = -(-n // block)
    owner = np.repeat(np.arange(len(n)), blocks)
    rank = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    at = first[:-1][owner] + rank * block
    size = np.minimum(block, first[1:][owner] - at)
    out = np.empty_like(psi)
    if not len(owner):
        return out
    order = np.argsort(-size, kind="stable")  # at step t the first live[t] blocks have a word
    at_o, size_o = at[order], size[order]
    live = np.searchsorted(-size_o, -np.arange(block), "left")
    steps = int(size_o[0])
    whole = np.zeros((len(owner), m, m))  # transfer matrix of each block
    for t in range(steps):
        k = live[t]
        p = psi[at_o[:k] + t]
        if t == 0:
            whole[:k, np.arange(m), np.arange(m)] = p
        else:
            whole[:k] = (whole[:k] @ moves) * p[:, None, :]
            whole[:k] /= whole[:k].sum((1, 2), keepdims=True)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    enter, leave = np.empty((len(owner), m)), np.ones((len(owner), m))
    base = np.cumsum(blocks) - blocks
    deep = np.argsort(-blocks, kind="stable")
    depth = -np.sort(-blocks)
    for j in range(int(blocks.max())):
        c = base[deep[: np.searchsorted(-depth, -j, "left")]] + j
        if j == 0:
            enter[place[c]] = start
        else:
            v = (enter[place[c - 1]][:, None, :] @ whole[place[c - 1]] @ moves)[:, 0]
            enter[place[c]] = v / v.sum(1, keepdims=True)
    for j in range(int(blocks.max()) - 2, -1, -1):
        c = base[deep[: np.searchsorted(-depth, -(j + 1), "left")]] + j
        v = (moves @ whole[place[c + 1]] @ leave[place[c + 1]][:, :, None])[:, :, 0]
        leave[place[c]] = v / v.sum(1, keepdims=True)
    a = enter
    for t in range(steps):
        k = live[t]
        if t:
            a = a[:k] @ moves
        a = a[:k] * psi[at_o[:k] + t]
        a /= a.sum(1, keepdims=True)
        out[at_o[:k] + t] = a
    b = leave.copy()
    for t in range(steps - 1, -1, -1):
        k = live[t]
        i = at_o[:k] + t
        g = out[i] * b[:k]
        out[i] = g / g.sum(1, keepdims=True)
        v = (psi[i] * b[:k]) @ moves.T
        b[:k] = v / v.sum(1, keepdims=True)
    return out


def _sample(labelled: DataFrame, key: str, text: str, label: str, per: int) -> list[tuple[str, str]]:
    """(label, text) of at most ``per`` rows a label, those with the smallest hashes of their ids."""
    counts = {r[0]: r[1] for r in labelled.groupBy(label).count().collect()}
    if not counts:
        return []
    limits = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1 << 30, int((1 << 30) * 1.5 * per / n)))])
    h = F.xxhash64(F.col(key), F.lit(3)).bitwiseAND(F.lit((1 << 30) - 1))
    rows = labelled.where(h < limits[F.col(label)]).select(F.col(label).alias("y"), F.col(text).alias("t"), h.alias("h")).where((F.octet_length("t") <= SAMPLE_BYTES)).orderBy("h", "t").limit(2 * per * len(counts)).collect()
    seen: dict[str, int] = {}
    out = []
    for r in rows:
        seen[r["y"]] = seen.get(r["y"], 0) + 1
        if seen[r["y"]] <= per:
            out.append((r["y"], r["t"]))
    return out


def train(labelled: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", per: int = SAMPLE, rounds: int = ROUNDS, seed: int = 7) -> Field | None:
    """The model from rows with a label and a text; None without any word."""
    rows = _sample(labelled, key, text, label, per)
    if not rows:
        return None
    languages = sorted({y for y, _ in rows})
    data, offsets = scan.buffers(pa.array([t for _, t in rows], pa.string()))
    data = lowered(data)
    starts, ends, first = scan.spans(data, offsets, _LETTER)
    if not len(starts):
        return None
    h = scan.word_hashes(data, starts, ends)
    different, one, index, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    model = Field(languages, different[count > 1])
    # lines: pieces of 4 to LINE words of random texts, joined to lines of LINE words
    rng = np.random.default_rng(seed)
    by = [np.array([i for i, (y, _) in enumerate(rows) if y == lang and first[i + 1] > first[i]]) for lang in languages]
    by = [b for b in by if len(b)]
    label_of = {y: i for i, y in enumerate(languages)}
    words, truth = np.zeros((LINES, LINE), np.int64), np.zeros((LINES, LINE), np.int64)
    for line in range(LINES):
        at = 0
        while at < LINE:
            doc = int(rng.choice(by[int(rng.integers(len(by)))]))
            size = min(LINE - at, int(rng.integers(8, LINE + 1)), int(first[doc + 1] - first[doc]))
            begin = int(rng.integers(first[doc], first[doc + 1] - size + 1))
            words[line, at : at + size] = index[begin : begin + size]
            truth[line, at : at + size] = label_of[rows[doc][0]]
            at += size
    used, flat = np.unique(words.ravel(), return_inverse=True)
    gold = truth.ravel()
    chains = np.arange(0, LINES * LINE + 1, LINE)
    ids, bounds = _grams(data, starts[one[used]], ends[one[used]])
    entry = model.entry(different[used])
    scale = np.sqrt(np.diff(bounds))
    owner = np.repeat(np.arange(len(used)), np.diff(bounds))
    n = len(languages)
    onehot = np.eye(n)[gold]
    params = {"weights": model.weights, "words": model.words, "start": model.start, "moves": model.moves}
    squares = {k: np.full_like(v, 1e-2) for k, v in params.items()}
    for step in range(rounds):
        e = model.emissions(ids, bounds, entry)[flat]
        psi = np.exp(e - e.max(1, keepdims=True))
        start, moves = np.exp(model.start), np.exp(model.moves)
        post = posteriors(psi, chains, start, moves, LINE)
        error = np.zeros((len(used), n))
        for y in range(n):
            error[:, y] = np.bincount(flat, (onehot - post)[:, y], len(used))
        grads = {"weights": np.zeros_like(model.weights), "words": np.zeros_like(model.words), "start": (onehot - post)[chains[:-1]].sum(0), "moves": _move_errors(psi, post, start, moves, truth, n)}
        per_gram = error / scale[:, None]
        for y in range(n):
            grads["weights"][:, y] = np.bincount(ids, per_gram[owner, y], BUCKETS)
            grads["words"][:, y] = np.bincount(entry, error[:, y], len(model.lexicon) + 1)
        grads["words"][-1] = 0
        grads["weights"][0] = error.sum(0)
        for k, v in params.items():  # AdaGrad with a little decay
            g = grads[k] - 0.02 * v
            squares[k] += g * g
            v += (0.5 if step < rounds * 3 // 4 else 0.2) * g / np.sqrt(squares[k])
    model.weights, model.words = model.weights.astype(np.float32), model.words.astype(np.float32)
    return model


def _move_errors(psi: np.ndarray, post: np.ndarray, start: np.ndarray, moves: np.ndarray, truth: np.ndarray, n: int) -> np.ndarray:
    """Seen minus expected transitions of equally long lines."""
    lines, size = truth.shape
    p = psi.reshape(lines, size, n)
    a = np.empty_like(p)
    a[:, 0] = start * p[:, 0]
    a[:, 0] /= a[:, 0].sum(1, keepdims=True)
    for t in range(1, size):
        a[:, t] = (a[:, t - 1] @ moves) * p[:, t]
        a[:, t] /= a[:, t].sum(1, keepdims=True)
    expected = np.zeros((n, n))
    b = np.ones((lines, n))
    for t in range(size - 1, 0, -1):
        right = p[:, t] * b
        pair = a[:, t - 1][:, :, None] * moves * right[:, None, :]
        expected += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
        b = right @ moves.T
        b /= b.sum(1, keepdims=True)
    seen = np.bincount(truth[:, :-1].ravel() * n + truth[:, 1:].ravel(), minlength=n * n).reshape(n, n)
    return seen - expected


def labelled_words(model: Field, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each word of each text, and where each text's words begin."""
    data = lowered(data)
    starts, ends, first = scan.spans(data, offsets, _LETTER)
    if not len(starts):
        return np.zeros((0, len(model.languages))), first
    different, one, index = np.unique(scan.word_hashes(data, starts, ends), return_index=True, return_inverse=True)
    e = model.emissions(*_grams(data, starts[one], ends[one]), model.entry(different))
    psi = np.exp(np.maximum(e - e.max(1, keepdims=True), -60))
    return posteriors(psi[index], first, np.exp(model.start), np.exp(model.moves)), first


def predicted(docs: DataFrame, model: Field | None, key: str = "doc_id", text: str = "text", more: list[Column] | None = None) -> DataFrame:
    """k (NO_KEY for null), lang_pred, score, n_words, n_switches (neighbouring words of different languages), spans
    (language and number of words of each run); with ``more`` also the text t and those columns as a struct."""
    extra = bool(more)
    plain = scan.keyed(docs, key, text, *([F.struct(*more).alias("more")] if more else []))
    out = "k long, lang_pred string, score double, n_words long, n_switches long, spans array<struct<lang:string,n_words:int>>"
    if more:
        out += f", t string, more {plain.schema['more'].dataType.simpleString()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in scan.slices(batches, "t"):
            n = batch.num_rows
            score, pick, switches = np.zeros(n), np.full(n, -1), np.zeros(n, np.int64)
            counts = np.zeros(n, np.int64)
            run_of, run_lang, run_size = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
            if model is not None:
                post, first = labelled_words(model, data, offsets)
                counts = np.diff(first)
                total = np.concatenate((np.zeros((1, post.shape[1])), np.cumsum(post, 0)))
                mean = (total[first[1:]] - total[first[:-1]]) / np.maximum(counts, 1)[:, None]
                ascii_letter = np.concatenate(([0], np.cumsum(((data | 0x20) >= 0x61) & ((data | 0x20) <= 0x7A) & (data < 0x80))))
                has = ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]
                for i in np.flatnonzero(~has & (counts > 0)):
                    has[i] = any(c.isalpha() for c in batch.column("t")[int(i)].as_py())
                ok = has & (counts > 0)
                pick = np.where(ok, mean.argmax(1), -1)
                score = np.where(ok, np.clip(mean.max(1), 0, 1), 0.0)
                label = post.argmax(1)
                new = np.ones(len(label), bool)
                new[1:] = label[1:] != label[:-1]
                new[first[:-1][first[:-1] < len(label)]] = True
                head = np.flatnonzero(new)
                run_of, run_lang = np.searchsorted(first, head, "right") - 1, label[head]
                run_size = np.diff(np.append(head, len(label)))
                switches = np.maximum(np.bincount(run_of, minlength=n) - 1, 0)
            names = pa.array([*(model.languages if model else []), UND])
            cuts = np.searchsorted(run_of, np.arange(n + 1)).astype(np.int32)
            spans = pa.ListArray.from_arrays(pa.array(cuts), pa.StructArray.from_arrays([names.take(pa.array(run_lang)), pa.array(run_size.astype(np.int32))], ["lang", "n_words"]))
            cols = {"k": batch.column("k"), "lang_pred": names.take(pa.array(np.where(pick < 0, len(names) - 1, pick))), "score": pa.array(score), "n_words": pa.array(counts.astype(np.int64)), "n_switches": pa.array(switches.astype(np.int64)), "spans": spans}
            if extra:
                cols |= {"t": batch.column("t"), "more": batch.column("more")}
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return plain.mapInArrow(run, out)


def held_out(key: str = "doc_id") -> Column:
    """Rows that training never sees; a null id is none of them."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fitted(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang") -> Field | None:
    return train(docs.where(~held_out(key) & F.col(label).isNotNull() & F.col(text).isNotNull()), key, text, label)


def op3(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = predicted(docs, fitted(docs), more=[held_out().alias("held_out")])
    return rows.select(scan.unkeyed().alias("doc_id"), F.col("more.held_out").alias("held_out"), "lang_pred", "score", "n_words", "n_switches")
