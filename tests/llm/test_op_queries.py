"""The registered queries themselves, every column, against brute force over a small fixture."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
import sentencepiece
import xxhash
from conftest import *  # noqa: F403
from test_dedup import kept
from test_texts import KEY, LOWER, contamination, tree_scores

from tarn.llm import decontam, fingerprint, langid, pieces, queries, scan

UNKEY = lambda k: None if k == scan.NO_KEY else k
SHA = lambda s: hashlib.sha256(s.encode()).hexdigest()


def table(spark, tmp_path, texts, items=()):
    spark.createDataFrame(rows_of(texts), SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")  # noqa: F405
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return lambda name: queries.queries()[name](spark, str(tmp_path)).collect()


@pytest.fixture
def single(texts):
    """One row of each id."""
    return [(i, t, l) for n, (i, t, l) in enumerate(texts) if i not in [x for x, _, _ in texts[:n]]]


def held(i, of, rest):
    return i is not None and zlib.crc32(str(i).encode()) % of == rest


def test_op1(spark, tmp_path, texts):
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    got = sorted((r["doc_id"] or -1, r["n_chars"], r["n_pieces"], list(r["ids"]), r["round_trip"]) for r in table(spark, tmp_path, texts)("op1_sentencepiece"))
    assert got == sorted((i or -1, len(t or ""), len(sp.encode(t or "")), sp.encode(t or ""), True) for i, t, _ in texts)


def sketch(text, k=fingerprint.K, size=fingerprint.SHINGLE):
    """Spark's xxhash64 over an array chains its elements from seed 42; signed."""
    w = [x for x in re.split(r"[ \t\n\x0b\f\r]+", text.lower()) if x]
    out = set()
    for i in range(max(1, len(w) - size + 1) if w else 0):
        h = 42
        for x in w[i : i + size]:
            h = xxhash.xxh64_intdigest(x.encode(), h)
        out.add(h - (1 << 64) if h >> 63 else h)
    return sorted(out)[:k]


def likeness(a, b, k=fingerprint.K):
    union = sorted(set(a) | set(b))[:k]
    return sum(x in a and x in b for x in union) / len(union) if union else 1.0


def test_op2(spark, tmp_path, single):
    rows = sorted(single, key=lambda r: KEY(r[0]), reverse=True)
    want = {}
    for n, (i, t, _) in enumerate(rows):
        t, nxt = t or "", rows[(n + 1) % len(rows)][1] or ""
        third = len(t) // 3
        edited = t[: len(t) - third] + nxt[:third]
        a, b, c = sketch(t), sketch(edited), sketch(nxt)
        name = lambda s: base64.b64encode(b"".join((x & (1 << 64) - 1).to_bytes(8, "big") for x in s)).decode()
        want[i] = (len(t), SHA(edited), name(a), name(b), likeness(a, b), likeness(a, c))
    got = {r["doc_id"]: (r["n_chars"], r["edited_sha256"], re.sub(r"\s", "", r["fingerprint"]), re.sub(r"\s", "", r["edited_fingerprint"]), r["near_edited"], r["near_next"]) for r in table(spark, tmp_path, single)("op2_fingerprints")}
    assert got.keys() == want.keys()
    for i, w in want.items():
        assert got[i] == pytest.approx(w), i


def test_op3_learns_from_training_rows_alone(spark, tmp_path, texts):
    """Held-out rows' languages, sources and the ids change nothing; equal texts get equal results."""
    first = table(spark, tmp_path / "a", texts)("op3_language_id")
    other = [(i, t, "en" if held(i, 4, 2) else l) for i, t, l in texts]
    second = table(spark, tmp_path / "b", other)("op3_language_id")
    key = lambda r: (r["doc_id"] or -1, r["lang_pred"], round(r["score"], 6), r["held_out"])
    assert sorted(map(key, first)) == sorted(map(key, second)) and len(first) == len(texts)
    learned = {l for i, _, l in texts if l and not held(i, 4, 2)}
    text = {i: t for i, t, _ in texts}
    seen = {}
    for r in first:
        assert r["held_out"] == held(r["doc_id"], 4, 2) and 0 <= r["score"] <= 1
        letter = any(c.isalpha() for c in text[r["doc_id"]] or "")
        assert r["lang_pred"] in (learned if letter else {langid.UND})
        assert seen.setdefault(text[r["doc_id"]], (r["lang_pred"], round(r["score"], 6))) == (r["lang_pred"], round(r["score"], 6))


@pytest.mark.parametrize("block", [decontam.BLOCK_BYTES, 200])
def test_op5(spark, tmp_path, single, monkeypatch, block):
    monkeypatch.setattr(decontam.contaminated, "__defaults__", tuple(block if x == decontam.BLOCK_BYTES else x for x in decontam.contaminated.__defaults__))
    items = [(1, words(1, 60)), (2, words(2, 12)), (3, "the"), (4, None), (5, "--"), (12, words(9, 300)), (101, "of the")]  # noqa: F405
    want = {UNKEY(k): (n, h, len(ids), SHA(",".join(ids)), h > 0) for k, (n, h, ids) in contamination(single, items).items()}
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in table(spark, tmp_path, single, items)("op5_decontamination")}
    assert got == want


def test_op6(spark, tmp_path, single):
    rows = [(i, t, l) for i, t, l in single if t is None or len(t) < 500]
    train = [t or "" for i, t, _ in rows if not held(i, 10, 0)]
    token = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), None]
    c = Counter(w for t in train for w in token(t))
    total, different = sum(c.values()), len(c)
    scores = tree_scores(train, [t or "" for _, t, _ in rows], 5)
    got = {r["doc_id"]: r for r in table(spark, tmp_path, rows)("op6_context_tree")}
    assert len(got) == len(rows)
    for (i, t, _), s in zip(rows, scores, strict=True):
        r, w = got[i], token(t)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i, 10, 0), len(w), sum(c[x] > 0 for x in w), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 0.1) / (total + 0.1 * (different + 1))) for x in w))
        assert r["score"] == pytest.approx(s, rel=1e-4, abs=1e-6)


def test_op9(spark, tmp_path, single):
    want = {UNKEY(k): (n, gone, SHA(t)) for k, (n, gone, t) in kept(single, 20).items()}
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in table(spark, tmp_path, single)("op9_substring_dedup")} == want


def test_queries_of_empty_tables(spark, tmp_path):
    run = table(spark, tmp_path, [])
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    for name in queries.queries():
        assert run(name) == [], name
