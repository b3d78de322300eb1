import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from conftest import *  # noqa: F403
from pyspark.sql import functions as F

from tarn.llm import ctw, decontam, fingerprint, langid, pieces, scan, sharding

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
KEY = lambda i: scan.NO_KEY if i is None else i


# -- 1 ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("giant", "chunk"), [(1 << 16, 1 << 15), (60, 40)])
def test_pieces_are_the_librarys(docs, texts, giant, chunk):
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rows = pieces.decoded(pieces.encoded(docs, giant=giant, chunk=chunk)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert list(r["ids"]) == sp.encode(r["t"]), r["t"][:80]
        assert r["decoded"] == r["t"]


def test_space_marks_and_empty_table(spark, nothing):
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    odd = ["▁a▁▁b ▁", "<s></s><0x41><unk>", "a" * 300, "the" * 90, "   ", "0" * 99 + "😀"]
    df = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    for giant, chunk in ((1 << 16, 1 << 15), (20, 18)):
        for r in pieces.encoded(df, giant=giant, chunk=chunk).collect():
            assert list(r["ids"]) == sp.encode(r["t"])
    assert pieces.decoded(pieces.encoded(nothing)).count() == 0


def test_max_plus_is_associative():
    rng = np.random.default_rng(0)
    a, b, c = (np.where(rng.random((4, 4)) < 0.5, 0.0, -np.inf) for _ in range(3))
    assert (pieces.max_plus(pieces.max_plus(a, b), c) == pieces.max_plus(a, pieces.max_plus(b, c))).all()


# -- 2 ---------------------------------------------------------------------------------------------------------------


def _sketch(spark, texts, **kw):
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    return [r["s"] for r in df.select("i", fingerprint.sketch(F.col("t"), **kw).alias("s")).orderBy("i").collect()]


def test_sketch_of_parts_is_that_of_the_whole(spark):
    texts = ["", "one two", words(1, 5), words(2, 400), "w" * 70 + " " + words(3, 30), "  " + words(4, 90).replace(" ", "\n ")]  # noqa: F405
    whole = _sketch(spark, texts, k=32)
    for part in (7, 40, 333):
        assert _sketch(spark, texts, k=32, part=part) == whole
    assert [len(s) for s in whole][:3] == [0, 1, 1]


def test_likeness_estimates(spark):
    rng = np.random.default_rng(1)
    pool = [f"w{i}" for i in rng.permutation(4000)]
    a, b = pool[:3000], pool[1000:]
    df = spark.createDataFrame([(" ".join(a), " ".join(b), "")], "a string, b string, e string").select(*[fingerprint.sketch(F.col(c), k=256).alias(c) for c in "abe"])
    r = df.select(fingerprint.resemblance(F.col("a"), F.col("b"), 256), fingerprint.containment(F.col("a"), F.col("b"), 256), fingerprint.distinct(F.col("a"), 256), fingerprint.resemblance(F.col("e"), F.col("e")), fingerprint.resemblance(F.col("a"), F.col("e"))).first()
    assert abs(r[0] - 0.5) < 0.1 and abs(r[1] - 2 / 3) < 0.12 and abs(r[2] / 2996 - 1) < 0.2 and r[3] == 1.0 and r[4] == 0.0


def test_next_document_and_edit(spark, tmp_path, texts, monkeypatch):
    monkeypatch.setattr(fingerprint, "NEIGHBOURS", 7)
    once = {i: t for i, t, _ in texts if i is not None}
    spark.createDataFrame([(i, t, "x") for i, t in once.items()], "doc_id long, text string, k string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in fingerprint.op2(spark, str(tmp_path)).collect()}
    order = sorted(once, reverse=True)
    by_text = {}
    for at, i in enumerate(order):
        t, nxt = once[i] or "", once[order[(at + 1) % len(order)]] or ""
        m = len(t) // 3
        r = rows[i]
        assert r["n_chars"] == len(t)
        assert r["edited_sha256"] == hashlib.sha256((t[: len(t) - m] + nxt[:m]).encode()).hexdigest(), i
        assert by_text.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if t == nxt:
            assert r["near_next"] == 1.0
    assert len(rows) == len(once)


def test_fingerprints_of_an_empty_table(spark, tmp_path, nothing):
    nothing.write.parquet(f"{tmp_path}/documents.parquet")
    assert fingerprint.op2(spark, str(tmp_path)).count() == 0


# -- 3 ---------------------------------------------------------------------------------------------------------------


def test_forward_backward():
    rng = np.random.default_rng(0)
    psi, first, start, moves = rng.random((37, 3)) + 0.1, np.array([0, 5, 5, 6, 30, 37]), rng.random(3) + 0.1, rng.random((3, 3)) + 0.1
    got = langid.posteriors(psi, first, start, moves, 4)
    for a, b in zip(first, first[1:], strict=False):
        if a == b:
            continue
        f, g = [start * psi[a]], [np.ones(3)]
        for t in range(a + 1, b):
            f.append((f[-1] @ moves) * psi[t])
        for t in range(b - 1, a, -1):
            g.append(moves @ (psi[t] * g[-1]))
        p = np.array(f) * np.array(g[::-1])
        assert np.allclose(p / p.sum(1, keepdims=True), got[a:b])


def test_language_held_out_accuracy_and_code_switching(spark, docs, nothing):
    train = [(i, words(5000 + i, 40, l), l) for i, l in enumerate(["en", "de", "fr"] * 30)]  # noqa: F405
    model = langid.fitted(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    test = [(i, words(9000 + i, 30, l), l) for i, l in enumerate(["en", "de", "fr"] * 20)]  # noqa: F405
    test += [(900, words(1, 20, "en") + " " + words(2, 20, "de"), "xx"), (901, None, None), (902, "12 -- 。", None), (903, "", None)]  # noqa: F405
    got = {r["k"]: r for r in langid.predicted(spark.createDataFrame(test, "doc_id long, text string, lang string"), model).collect()}
    assert sum(got[i]["lang_pred"] == l for i, _, l in test if i < 900) >= 58
    assert [s["lang"] for s in got[900]["spans"]][:1] == ["en"] and got[900]["spans"][-1]["lang"] == "de" and got[900]["n_switches"] <= 3
    for i in (901, 902, 903):
        assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
    assert langid.predicted(docs, model).count() == docs.count()
    assert langid.fitted(nothing) is None and langid.predicted(nothing, None).count() == 0
    assert {r["lang_pred"] for r in langid.predicted(docs, None).collect()} == {"und"}


# -- 4 ---------------------------------------------------------------------------------------------------------------


def test_shards(spark, docs, texts, nothing):
    rows = sharding.sharded(docs).collect()
    assert len(rows) == len(texts)
    moved = 0
    for s in range(16):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    by = defaultdict(set)
    for r in rows:
        by[r["key"]].add(r["shard"])
        assert r["grown_shard"] in (r["shard"], 16)
        moved += r["grown_shard"] == 16
    assert all(len(s) == 1 for s in by.values())
    have = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in texts)
    assert Counter((r["key"], r["size"], r["text_crc32"]) for r in rows) == have
    assert sharding.sharded(nothing).count() == 0
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    n = Counter(r["shard"] for r in sharding.sharded(many, weights=[1.0, 2.0, 1.0, 0.0]).collect())
    assert 3 not in n and abs(n[1] / 10_000 - 1) < 0.05


# -- 5 ---------------------------------------------------------------------------------------------------------------


def contamination(texts, items):
    split = lambda t: ALNUM.findall((t or "").translate(LOWER))
    wins = defaultdict(set)
    for i, t in items:
        w = split(t)
        n = min(10, len(w))
        for s in range(len(w) - n + 1 if w else 0):
            wins[tuple(w[s : s + n])].add(i)
    sizes = {len(g) for g in wins}
    out = {}
    for k, t, _ in texts:
        w, hit, ids = split(t), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in wins:
                    hit |= set(range(s, s + n))
                    ids |= wins[tuple(w[s : s + n])]
        out[KEY(k)] = (len(w), len(hit), sorted(map(str, ids)))
    return out


@pytest.mark.parametrize(("block", "shard"), [(1 << 20, 1 << 20), (300, 500)])
def test_contamination_against_brute_force(spark, docs, texts, block, shard):
    items = [(1, words(1, 60)), (2, words(2, 12)), (3, "the"), (4, None), (5, "--"), (6, words(1, 60)[:90].upper()), (10, "x" * 5000), (7, words(9, 300)), (8, " ".join(["a"] * 30))]  # noqa: F405
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = contamination(texts, items)
    rows = decontam.contaminated(docs, bench, block_bytes=block, shard_words=shard, more=["source", "k"]).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r["n_words"], r["n_hit"], list(r["items"])) == want[r["k"]], r["k"]
        assert r["more"]["k"] == "k"


def test_a_benchmark_of_many_blocks_takes_one_worker_at_a_time(spark, docs, texts):
    items = [(i, words(100 + i, 12) if i % 2 else words(500, 80)[i : i + 90]) for i in range(40)]  # noqa: F405
    bench = spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    assert len(list(decontam.blocks(bench, "item_id", "text", 1))) == 40
    rows = decontam.contaminated(docs, bench, block_bytes=1)
    assert rows._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted(((r["k"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in rows.collect())) == sorted((KEY(i), *contamination([(i, t, l)], items)[KEY(i)][:2], tuple(contamination([(i, t, l)], items)[KEY(i)][2])) for i, t, l in texts)


def test_suffix_array_and_longest_matches(spark):
    rng = np.random.default_rng(2)
    for tokens in (rng.integers(0, 3, 400), np.ones(300, np.int64), rng.integers(0, 900, 500)):
        tokens = np.append(tokens, 0)

        def suffix(i, t=tokens):
            end = i + int(np.argmin(t[i:] != 0))
            return t[i:end].tolist()

        order = decontam.suffix_array(tokens, int(tokens.max()))
        got = [suffix(i) for i in order]
        assert got == sorted(got) and sorted(order.tolist()) == np.flatnonzero(tokens).tolist()
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "x b c d y"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, "q b c d e z x")], "item_id long, text string")
    best = {r["at"]: (r["words"], r["k"], r["pos"]) for r in decontam.longest_matches(docs, items).collect()}
    assert best == {1: (4, 1, 1), 2: (3, 1, 2), 3: (2, 1, 3), 4: (1, 1, 4), 6: (1, 2, 0)}


def test_contamination_of_empty_tables(spark, docs, nothing):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated(nothing, none).count() == 0
    assert decontam.contaminated(docs, none).where("n_hit > 0").count() == 0


# -- 6 ---------------------------------------------------------------------------------------------------------------


def tree_scores(train, texts, depth):
    cnt, kids = defaultdict(lambda: [0, 0]), defaultdict(list)
    for t in train:
        b = b"\0" * depth + t.encode()
        for i in range(depth, len(b)):
            for d in range(depth + 1):
                node = 1
                for j in range(8):
                    bit = b[i] >> (7 - j) & 1
                    cnt[b[i - d : i], node][bit] += 1
                    node = node * 2 + bit
    for c, n in cnt:
        if c:
            kids[c[1:], n].append((c, n))
    pw, lg = {}, math.lgamma
    for c, n in sorted(cnt, key=lambda x: -len(x[0])):
        a, b = cnt[c, n]
        own = lg(a + 0.5) + lg(b + 0.5) - lg(a + b + 1) - math.log(math.pi)
        total = own if len(c) == depth else np.logaddexp(math.log(0.5) + own, math.log(0.5) + sum(pw[k][0] for k in kids[c, n]))
        pw[c, n] = (total, 1.0 if len(c) == depth else math.exp(min(0, math.log(0.5) + own - total)))
    out = []
    for t in texts:
        b, s = b"\0" * depth + t.encode(), 0.0
        for i in range(depth, len(b)):
            node = 1
            for j in range(8):
                bit, p = b[i] >> (7 - j) & 1, None
                for d in range(depth, -1, -1):
                    key = b[i - d : i], node
                    if key in cnt:
                        z, o = cnt[key]
                        kt = (o + 0.5) / (z + o + 1)
                        p = kt if p is None else pw[key][1] * kt + (1 - pw[key][1]) * p
                p = 0.5 if p is None else p
                s += math.log10(p if bit else 1 - p)
                node = node * 2 + bit
        out.append(s)
    return out


@pytest.mark.parametrize("hot", [8, 1 << 18])
def test_context_tree_and_base_against_brute_force(spark, texts, nothing, monkeypatch, hot):
    monkeypatch.setattr(ctw, "HOT", hot)
    rows = [(i, t) for i, t, _ in texts if t is None or len(t) < 700]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    held = F.coalesce(F.col("doc_id") % 3 == 0, F.lit(False))
    train = [t or "" for i, t in rows if i is None or i % 3]
    token = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), None]
    c = Counter(w for t in train for w in token(t))
    total, different = sum(c.values()), len(c)
    got = {r["k"]: r for r in ctw.scored(df, held, depth=3).collect()}
    want = dict(zip([KEY(i) for i, _ in rows], tree_scores(train, [t or "" for _, t in rows], 3), strict=True))
    for i, t in rows:
        r, w = got[KEY(i)], token(t)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), total)
        assert abs(r["base_score"] - sum(math.log10((c[x] + 0.1) / (total + 0.1 * (different + 1))) for x in w)) < 1e-6
        assert abs(r["score"] - want[KEY(i)]) < 1e-4 * max(1, abs(want[KEY(i)]))
    assert ctw.scored(df, held, depth=3).count() == len(rows)
    if hot == 8:
        assert ctw.scored(nothing, F.lit(False)).count() == 0
        r = ctw.scored(df.where("doc_id = 167"), F.lit(True), depth=2).first()
        assert abs(r["score"] + 8 * r["n_bytes"] * math.log10(2)) < 1e-6 and r["train_tokens"] == 0


def test_fewer_grams_by_smaller_depth(spark, monkeypatch):
    monkeypatch.setattr(ctw, "GRAMS", 40)
    df = spark.createDataFrame([(i, words(i, 50)) for i in range(6)], "doc_id long, text string")  # noqa: F405
    assert ctw.scored(df, F.lit(False)).count() == 6


def test_dealt_tree_keeps_its_depth(spark, texts, monkeypatch):
    """More different strings than are broadcast give the same scores: no context is lost."""
    df = spark.createDataFrame(rows_of(texts), SCHEMA)  # noqa: F405
    held = F.coalesce(F.col("doc_id") % 7 == 0, F.lit(False))
    key = lambda r: (r["k"], r["n_bytes"], r["score"])
    want = sorted(ctw.scored(df, held).collect(), key=key)
    monkeypatch.setattr(ctw, "GRAMS", 40)
    got = sorted(ctw.scored(df, held).collect(), key=key)
    assert len(got) == len(texts) and [r["k"] for r in got] == [r["k"] for r in want]
    np.testing.assert_allclose([r["score"] for r in got], [r["score"] for r in want], rtol=1e-9)
    assert [(r["n_tokens"], r["n_known"], r["held_out"]) for r in got] == [(r["n_tokens"], r["n_known"], r["held_out"]) for r in want]
