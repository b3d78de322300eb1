import numpy as np
import pyarrow as pa
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tarn.llm import scan, simhash

TEXT = st.lists(st.one_of(st.none(), st.text(alphabet=" \n\tabAé日\x0b.", max_size=60)), min_size=1, max_size=8)


@settings(max_examples=60, deadline=None)
@given(TEXT)
def test_words_hashes_and_squeezed_texts(texts):
    b, o = scan.buffers(pa.array(texts, pa.string()))
    s, e, f = scan.spans(b, o, scan.NON_SPACE)
    seen = {}
    h = scan.word_hashes(b, s, e)
    clean, at = scan.squeezed(b, o)
    for i, t in enumerate(texts):
        want = (t or "").encode().split()
        assert [bytes(b[x:y]) for x, y in zip(s[f[i] : f[i + 1]], e[f[i] : f[i + 1]], strict=True)] == want
        assert bytes(clean[at[i] : at[i + 1]]) == b" ".join(want)
    for x, y, z in zip(s, e, h, strict=True):
        assert seen.setdefault(bytes(b[x:y]), z) == z
    assert len(set(seen.values())) == len(seen)


def test_hash_of_a_word_does_not_depend_on_pieces():
    long = b"ab" * (scan.PIECE + 17)
    data = np.frombuffer(b"x " + long + b" y " + long, np.uint8)
    s, e, _ = scan.spans(data, np.array([0, len(data)]), scan.NON_SPACE)
    h = scan.word_hashes(data, s, e)
    assert h[1] == h[3] and len(set(h.tolist())) == 3


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 21))
def test_windows(values, k):
    w = scan.windows(np.array(values, np.uint64), k)
    groups = {}
    for i in range(max(0, len(values) - k + 1)):
        assert groups.setdefault(tuple(values[i : i + k]), w[i]) == w[i]
    assert len(set(groups.values())) == len(groups) and len(w) == max(0, len(values) - k + 1)


def test_inside():
    first = np.array([0, 3, 3, 7, 7])
    got = scan.inside(first, 3, 7)
    assert got.tolist() == [True, False, False, True, True]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=70), min_size=1, max_size=9), st.integers(0, 99))
def test_xxh64(parts, seed):
    data = np.frombuffer(b"".join(parts) or b"\0", np.uint8)
    lens = np.array([len(p) for p in parts])
    got = simhash.xxh64(data, np.cumsum(lens) - lens, lens, seed)
    assert got.tolist() == [xxhash.xxh64_intdigest(p, seed) for p in parts]
