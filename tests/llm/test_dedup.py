import hashlib
import random
import re

import numpy as np
import xxhash
from conftest import *  # noqa: F403

from tarn.llm import scan, simhash, substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def fingerprint(text):
    w = WORD.findall((text or "").translate(LOWER))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def groups(prints):
    """Components by brute force: key -> smallest key."""
    keys = list(prints)
    up = {k: k for k in keys}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {k: find(k) for k in keys}


def named(texts):
    """(id, fingerprint, component id) of every row by brute force; ids may be null or repeated."""
    prints = {t: fingerprint(t) for _, t, _ in texts}
    different = sorted(set(prints.values()))
    root = groups({i: x for i, x in enumerate(different)})
    of = {x: root[i] for i, x in enumerate(different)}
    least = {}
    for i, t, _ in texts:
        if i is not None:
            c = of[prints[t]]
            least[c] = min(least.get(c, i), i)
    return sorted(((i, prints[t], least.get(of[prints[t]])) for i, t, _ in texts), key=repr)


def test_near_duplicates_against_brute_force(docs, texts):
    unkey = lambda i: None if i == scan.NO_KEY else i
    rows = simhash.near_duplicates(docs).collect()
    assert sorted(((unkey(r["k"]), r["fp"] & (1 << 64) - 1, r["c"]) for r in rows), key=repr) == named(texts)
    want = {i: c for i, _, c in named(texts)}
    assert want[104] == 100 and want[162] == want[160] == 160


def test_op10_with_null_and_repeated_ids(spark, tmp_path):
    a, b, c, d = (words(300 + i, 60) for i in range(4))  # noqa: F405
    texts = [(1, a, "en"), (None, a, "en"), (2, b, "en"), (None, b, "en"), (None, c, "en"), (None, c, "en"), (5, a, "en"), (5, d, "en"), (7, d, "en"), (7, d, "en"), (8, None, "en"), (9, " ", "en")]
    spark.createDataFrame(rows_of(texts), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")  # noqa: F405
    got = [(r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in simhash.op10(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == named(texts)
    assert {(i, x) for i, _, x in got} == {(1, 1), (None, 1), (5, 1), (2, 2), (None, 2), (None, None), (5, 5), (7, 5), (8, 8), (9, 8)}
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none/documents.parquet")  # noqa: F405
    assert simhash.op10(spark, f"{tmp_path}/none").collect() == []


def shingles(text, n=5):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_wide_fingerprints_estimate_similarity():
    import pyarrow as pa

    rng = np.random.default_rng(7)
    base = words(1, 600).split(" ")  # noqa: F405
    texts = ["", " \n", "one two", "one  TWO", "one", " ".join(base), " ".join(base) * 2]
    for changes in (1, 5, 10, 20, 40, 80):
        w = list(base)
        for i in rng.choice(len(w), changes, replace=False):
            w[i] = f"new{i}"
        texts.append(" ".join(w))
    fp = simhash.wide_fingerprints(*scan.buffers(pa.array(texts)), 5, 32)
    sets = [shingles(t) for t in texts]
    for i in range(2, len(texts)):
        for j in range(5, i):
            want, bits = alike(sets[i], sets[j]), int(np.bitwise_count(fp[i] ^ fp[j]).sum())
            if want >= 0.5:
                assert abs(bits / 2048 - simhash.apart(want)) < 0.045
            elif want < 0.05:
                assert bits > 700
    assert (fp[0] == 0).all() and (fp[1] == 0).all() and (fp[2] == fp[3]).all() and (fp[2] != fp[4]).any()
    mixed = simhash.scan.mix(np.array([5, 9], np.uint64), 1)
    assert mixed[0] != mixed[1]


def test_wide_fingerprints_against_a_loop():
    import pyarrow as pa

    texts = [words(i, n) for i, n in enumerate((1, 4, 5, 6, 300, 1500))]  # noqa: F405
    got = simhash.wide_fingerprints(*scan.buffers(pa.array(texts)), 5, 2)
    for t, fp in zip(texts, got, strict=True):
        data, offsets = scan.buffers(pa.array([t]))
        h = scan.word_hashes(data, *scan.spans(data, offsets, scan.NON_SPACE)[:2])
        with np.errstate(over="ignore"):
            w = scan.windows(h, 5) if len(h) >= 5 else scan.windows(h, len(h)) + np.uint64(len(h))
        code = {int(x) >> 20 for x in scan.mix(w, 17)}
        for x in range(2):
            mixed = [int(v) for v in scan.mix(np.array(sorted(code), np.uint64), 1000 + x)]
            assert int(fp[x]) == sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in mixed) > len(mixed))


def test_forest_of_a_bucket_has_the_components_of_all_pairs():
    rng = np.random.default_rng(2)
    for _ in range(20):
        n, words_, radius = int(rng.integers(2, 60)), 4, int(rng.integers(20, 60))
        fp = rng.integers(0, 1 << 63, (3, words_), np.int64).astype(np.uint64)[rng.integers(0, 3, n)]
        for i in range(n):
            for b in rng.choice(256, int(rng.integers(0, 45)), replace=False):
                fp[i, b // 64] ^= np.uint64(1 << (b % 64))
        ident = np.sort(rng.choice(1000, n, replace=False))
        up = {int(i): int(i) for i in ident}

        def find(x, up=up):
            while up[x] != x:
                x = up[x]
            return x

        for i in range(n):
            for j in range(i):
                if np.bitwise_count(fp[i] ^ fp[j]).sum() <= radius:
                    x, y = sorted((find(int(ident[i])), find(int(ident[j]))))
                    up[y] = x
        a, b = simhash.wide_forest(fp, ident, radius)
        got = {int(i): int(i) for i in ident} | dict(zip(a.tolist(), b.tolist(), strict=True))
        assert got == {i: find(i) for i in up}


def near_copies(seed, groups_, n=200):
    """Groups of a text and copies with some words changed, and texts of their own."""
    rng = random.Random(seed)
    out, k = [], 0
    for g in range(groups_):
        base = words(seed * 1000 + g, n).split(" ")  # noqa: F405
        for c in range(1 + g % 6):
            w = list(base)
            for _ in range(c * (g % 4)):
                w[rng.randrange(n)] = f"changed{rng.randrange(10**6)}"
            out.append((k, " ".join(w), "en"))
            k += 1
    return out


def test_keepers_by_similarity_of_five_words(spark):
    texts = near_copies(3, 60)
    sets = {i: shingles(t) for i, t, _ in texts}
    links = {(i, j): s for i in sets for j in sets if j < i and (s := alike(sets[i], sets[j])) > 0.7}
    root = {}
    for least in (0.76, 0.84):
        up = {i: i for i in sets}
        for (i, j), s in sorted(links.items()):
            if s >= least:
                a, b = i, j
                while up[a] != a:
                    a = up[a]
                while up[b] != b:
                    b = up[b]
                up[max(a, b)] = min(a, b)
        root[least] = {i for i in sets if up[i] == i}
    got = {r["k"] for r in simhash.keepers(spark.createDataFrame(rows_of(texts), SCHEMA)).collect()}  # noqa: F405
    assert root[0.76] <= got <= root[0.84] and len(got) < len(texts)


def test_chain_of_links_and_large_bucket(spark, monkeypatch):
    """A path whose ends are far apart, and a bucket beyond the pair limit, give one component each."""
    monkeypatch.setattr(simhash, "_PAIRS", 8)
    rng = np.random.default_rng(3)
    fps, v = [], 0
    for b in range(0, 60, 2):
        fps.append(v)
        v ^= 3 << b
    base = int(rng.integers(1 << 62)) | 1 << 63
    ball = list({base ^ (1 << int(rng.integers(20))) ^ (1 << int(rng.integers(20, 40))) for _ in range(60)} | {base})
    rows = [(x - (1 << 64) if x >> 63 else x, i) for i, x in enumerate(fps + ball)]
    vertices = spark.createDataFrame(rows, "fp long, v long")
    comp = {r["v"]: r["c"] for r in simhash.components(simhash.near_links(vertices, len(rows))).collect()}
    want = groups({i: x for i, x in enumerate(fps + ball)})
    assert {i: comp.get(i, i) for i in want} == want
    for blocks in (5, 6):
        masks = simhash.block_masks(blocks, 3)
        key, fp, ident, tab = [], [], [], []
        for t, m in enumerate(masks):
            for i, x in enumerate(fps + ball):
                key.append(np.uint64(x & m).astype(np.int64)), fp.append(np.uint64(x)), ident.append(i), tab.append(t)
        key, fp, ident, tab = np.array(key), np.array(fp), np.array(ident), np.array(tab)
        o = np.lexsort((ident, key, tab))
        a, b = simhash.bucket_forest(key[o], fp[o], ident[o], 3, {t: [i for i in range(64) if not m >> i & 1] for t, m in enumerate(masks)}, tab[o])
        up = {i: i for i in want}
        for _ in range(len(want)):
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                up[x] = up[y] = min(up[x], up[y])
        assert up == want


def kept(texts, width):
    rows = sorted(((scan.NO_KEY if i is None else i, t) for i, t, _ in texts), key=lambda r: r[0])
    first = {}
    for k, t in rows:
        w = WORD.findall(t or "")
        for s in range(len(w) - width + 1):
            g = tuple(w[s : s + width])
            first[g] = min(first.get(g, (k, s)), (k, s))
    out = {}
    for k, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for s in range(len(w) - width + 1):
            if first[tuple(w[s : s + width])] < (k, s):
                gone |= set(range(s, s + width))
        out[k] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def test_substring_against_brute_force(docs, texts):
    for width in (20, 5, 1):
        want = kept(texts, width)
        rows = substring.remove_repeats(docs, width=width).collect()
        assert len(rows) == len(texts)
        for r in rows:
            assert (r["n_words"], r["n_removed"], r["kept_text"]) == want[r["k"]], (width, r["k"])


def test_substring_small_sketch_loses_none(docs, texts, monkeypatch):
    """With almost no cells every window is estimated repeated; the result stays."""
    monkeypatch.setattr(substring, "LEAST_CELLS", 1 << 4)
    monkeypatch.setattr(substring, "MOST_CELLS", 1 << 4)
    monkeypatch.setattr(substring, "HELD", 50)
    want = kept(texts, 20)
    for r in substring.remove_repeats(docs).collect():
        assert (r["n_words"], r["n_removed"], r["kept_text"]) == want[r["k"]]


def test_repeated_passage_stays_once(docs):
    got = {r["k"]: r for r in substring.remove_repeats(docs).collect()}
    assert got[140]["n_removed"] == 0 and all(got[140 + i]["n_removed"] == 60 for i in (1, 2, 3))
    assert got[150]["n_removed"] == 50 and got[151]["n_removed"] == 25
    assert hashlib.sha256(got[160]["kept_text"].encode()).hexdigest() == hashlib.sha256(b"").hexdigest()


def test_empty_tables(nothing):
    assert simhash.near_duplicates(nothing).count() == 0
    assert substring.remove_repeats(nothing).count() == 0
