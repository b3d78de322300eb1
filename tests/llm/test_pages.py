import gzip
import hashlib
import math
import random
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tarn.llm import extract, warc

SCHEMA = "page_id long, url string, html string, id string, digest string, host string, low string"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "i", "d", "h", "l") for r in rows], SCHEMA)


# -- 7 ---------------------------------------------------------------------------------------------------------------


def test_archives_round_trip(spark, tmp_path):
    big, other = "<p>é" + "x" * 1200, "y" * 1000
    rows = [(1, "http://a/\r\nb", big), (2, None, big), (3, "u", big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (8, "u", other), (9, "u", "z" * 300_000), (None, "u", other), (8, "u", other)]
    manifest = warc.write_archives(pages_of(spark, rows), str(tmp_path / "w"), archive=600)
    got = warc.read_archives(manifest).collect()
    assert len(got) == len(rows) and manifest.agg(F.sum("records")).first()[0] == len(rows)
    by = {r["page_id"]: r for r in got if r["page_id"] != 8}
    for i, _, html in rows:
        p = (html or "").encode()
        if i != 8:
            assert (by[i]["payload_bytes"], by[i]["payload_digest"]) == (len(p), hashlib.sha1(p).hexdigest())
            assert by[i]["block"] == (p if by[i]["record_type"] == "response" else b"")
    assert {i: (by[i]["record_type"], by[i]["refers_to"]) for i in by} == {1: ("revisit", 3), 2: ("revisit", 3), 3: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None), 7: ("response", None), 9: ("response", None), None: ("revisit", 8)}
    assert sorted((r["record_type"], r["refers_to"]) for r in got if r["page_id"] == 8) == [("response", None), ("revisit", 8)]
    files = list(Path(tmp_path / "w").iterdir())
    assert len(files) > 1 and all(gzip.decompress(f.read_bytes()).startswith(b"WARC/1.1\r\n") for f in files)


def brute_records(rows):
    """(page_id, bytes, digest, type, refers_to) of every row, sorted."""
    groups, out = defaultdict(list), []
    for i, _, html in rows:
        groups[(html or "").encode()].append(i)
    for p, ids in groups.items():
        known = [i for i in ids if i is not None]
        last = max(known) if known else None
        responses = len(ids) if len(p) < warc.LEAST else 1
        ids.remove(last) if responses == 1 else None
        digest = hashlib.sha1(p).hexdigest()
        out += [(i, len(p), digest, "response", None) for i in ([last] if responses == 1 else ids)]
        out += [(i, len(p), digest, "revisit", last) for i in (ids if responses == 1 else [])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("told", [warc.TOLD, 0])
def test_op7_query_with_repeated_and_null_ids(spark, tmp_path, monkeypatch, told):
    monkeypatch.setattr(warc, "TOLD", told)
    a, b, c, d = ("é" + x * 1500 for x in "abcd")
    rows = [(1, "u", a), (1, "u", a), (1, "v", a), (None, "u", a), (2, "u", b), (2, "u", c), (3, "u", b), (None, "u", d), (None, "u", d), (4, "u", "x" * 999), (4, "u", "x" * 999), (5, None, None), (6, "u", "y" * 1000), (7, "u", "y" * 1000)]
    pages_of(spark, rows).write.parquet(f"{tmp_path}/pages.parquet")
    got = [tuple(r) for r in warc.op7(spark, str(tmp_path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(got, key=repr) == brute_records(rows)


def test_damage_is_found(tmp_path):
    data = warc.record("response", "1", "u", b"hello", hashlib.sha1(b"hello").hexdigest())
    fields, block = warc.parsed(data)
    assert block == b"hello" and fields["warc-type"] == "response"
    for bad in (data.replace(b"hello", b"hallo"), data.replace(b"Content-Length: 5", b"Content-Length: 4"), data[:-2], b"x" + data):
        with pytest.raises(warc.Damaged):
            warc.parsed(bad)
    path = tmp_path / "x.warc.gz"
    path.write_bytes((warc.member(data) * 3)[:-5])
    with pytest.raises(warc.Damaged), open(path, "rb") as f:
        list(warc.members(f, 7))
    path.write_bytes(warc.member(data) * 3)
    with open(path, "rb") as f:
        assert list(warc.members(f, 7)) == [data] * 3


def test_no_pages(spark, tmp_path):
    assert warc.read_archives(warc.write_archives(pages_of(spark, []), str(tmp_path / "w"))).count() == 0
    assert extract.extracted(pages_of(spark, [])).count() == 0


# -- 8 ---------------------------------------------------------------------------------------------------------------


def text(html):
    return extract.Page(html).text()


def test_markup():
    assert text('<body><nav>x</nav><div class="ad">ad<p>k</div><article><h1>T&amp;t</h1><p><b>a  b.<br><p>c<b>d</b>e</p><form>f</form><div class=comments><p>no</div><script>var a="</p>"</script><aside>q</aside> tail</article><footer>z') == "T&t a b. cde tail"
    assert text("<div id=sidebar>no</div><div><p>yes &lt;b&gt; &eacute;<p>more<ul><li>1<li>2</ul></div><table><tr><td>a<td>b</table>") == "yes <b> é more 1 2 a b"
    assert text('<header>site</header><main><div class="cookie-notice">ok?</div><p>x<!-- y --> z</p><section id="reader-comments"><p>c</p></section></main>') == "x z"
    assert text('<article><header><h1>Head</h1></header><p>body</p><footer>f</footer></article>') == "Head body"
    assert text('<p hidden>a</p><p style="display: none">b</p><div role="navigation">c</div><p>d</p>') == "d"
    for odd in ("", "<", "<<<a <b", "</p></div>", "<script>never closed", "<!-- never closed", "&#x110000; &bogus; &amp", "<p " + "a" * 1000):
        assert isinstance(text(odd), str)
    assert text("a &amp; b &#233; &lt;p&gt;") == "a & b é <p>"


def test_style_tree_removes_what_a_host_repeats(spark):
    def page(i, n):
        return f'<html><body><div class="top{i}"></div><div class="box">Always the same words {n}</div><div class="story"><p>Text number {i} of its own, {i * 7}.</p><p>A shared paragraph.</p></div></body></html>'

    rows = [(i, f"http://h.example/{i}", page(i, 0)) for i in range(20)] + [(100 + i, f"http://few.example/{i}", page(i, 1)) for i in range(3)]
    rows += [(200, None, None), (201, "", ""), (None, "http://h.example/x", page(99, 0))]
    got = {r["page_id"]: r["text"] for r in extract.extracted(pages_of(spark, rows)).collect()}
    assert len(got) == len(rows)
    assert got[3] == "Text number 3 of its own, 21. A shared paragraph."
    assert got[None] == "Text number 99 of its own, 693. A shared paragraph."
    assert got[101] == "Always the same words 1 Text number 1 of its own, 7. A shared paragraph."  # too few pages to tell
    assert got[200] == got[201] == ""
    tree = extract.style_tree(pages_of(spark, rows)).where("pages >= 20").collect()
    assert min(r["importance"] for r in tree) < 0.2 < 0.8 < max(r["importance"] for r in tree)


def test_host():
    assert [extract.host_of(u) for u in ("http://a.B.c:80/x", "//u@h/x", None, "x", "https://h?q")] == ["a.b.c", "h", "", "", "h"]


def test_copies_of_a_page_are_no_evidence(spark):
    def page(i):
        return f'<html><body><div class="bar">Same on all</div><div class="story"><p>Intro {i}.</p><ul><li>Point {i * 3}</li></ul></div></body></html>'

    one = [(i, f"http://one.example/{i}", page(1)) for i in range(20)]
    two = [(100 + i, f"http://two.example/{i}", page(1 + i % 2)) for i in range(100)]
    got = {r["page_id"]: r["text"] for r in extract.extracted(pages_of(spark, one + two)).collect()}
    assert got[3] == got[102] == "Same on all Intro 1. Point 3" and got[101] == "Same on all Intro 2. Point 6"
    assert {r["pages"] for r in extract.style_tree(pages_of(spark, one)).collect()} == {1}


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def undeclared(seed, hosts, each):
    """Pages without an article whose menus, adverts and footers have meaningless names and new words on every page."""
    rng = random.Random(seed)
    rows = []
    for h in range(hosts):
        for i in range(each):
            menu = "".join(f"<a href=x>{sentence(rng, 1)}</a> " for _ in range(rng.randint(3, 6)))
            paragraphs = [sentence(rng, rng.randint(20, 90)) for _ in range(rng.randint(2, 6))]
            title, note = sentence(rng, 4), f"{sentence(rng, 6)}"
            inner = "".join(f"<p>{p}</p>" for p in paragraphs)
            html = f'<html><body><div class=qa>{menu}</div><div class=qb><h1>{title}</h1>{inner}<div class=qc>Follow all our news</div><p class=qd>Rated by our users</p></div><div class=qe>{note}</div><div class=qf>Made by {sentence(rng, 2)}</div></body></html>'
            rows.append((h * 1000 + i, f"http://h{h}.example/{i}", html, " ".join([title, *paragraphs])))
    return rows


def brute_tree(pages, evidence, threshold, share):
    """The tree and what it says, with plain dictionaries: host -> texts of its pages by id."""
    by_host, out = defaultdict(dict), {}
    for _, u, t in pages:
        page = extract.Page(t or "")
        by_host[extract.host_of(u)].setdefault(page.copy(), {})[extract._digest(t or "")] = page
    for host, groups in by_host.items():
        nodes = defaultdict(list)
        for group in groups.values():
            for up, path, role, content, style, words in group[min(group)].nodes():
                nodes[up, path, role].append((content, style, words))
        for (up, path, role), seen in nodes.items():
            m = len(seen)
            texts, styles = Counter(c for c, _, _ in seen), Counter(s for _, s, _ in seen)
            log = lambda x: math.log(x) / math.log(m) if m > 1 else 0.0
            presentation = -sum(n / m * log(n / m) for n in styles.values()) if m > 1 else 1.0
            content = 1 - sum(log(n) for n in texts.values()) / len(texts)
            information = sum(w * (1 - log(texts[c])) for c, _, w in seen) / m
            out[host, up, path, role] = (m, 0.1 * presentation + 0.9 * content, information)
    said = defaultdict(lambda: (set(), set(), set(), set()))
    known = {h for (h, _, _, role), v in out.items() if role == extract.ROOT and v[0] >= evidence}
    for (h, up, path, role), (m, importance, information) in out.items():
        if m < evidence:
            continue
        node = extract._digest(f"{h}\x1f{path}")
        if role in (extract.BLOCK, extract.BOX) and importance < threshold:
            said[h][0].add(node)
        beside = [v[2] for (g, u, _, r), v in out.items() if (g, u) == (h, up) and r in (extract.BOX, extract.BESIDE) and v[0] >= evidence and math.floor(100 * math.log10(v[0])) >= math.floor(100 * math.log10(m)) - 100]
        if role == extract.BOX and information < share * max(beside):
            said[h][1].add(node)
        if role == extract.BOX and information >= max(beside) and information > 0:
            said[h][2].add(node)
        if role == extract.BESIDE and information >= share * max(beside) and information > 0:
            said[h][3].add(extract._digest(f"{h}\x1f{up}"))
    return out, {h: said[h] for h in known}


def test_tree_against_plain_dictionaries(spark, monkeypatch):
    rows = [r[:3] for r in undeclared(1, 3, 12)] + [(9000 + i, "http://h0.example/copy", undeclared(1, 1, 1)[0][2]) for i in range(9)]
    rows += [(9100 + i, "http://few.example/", f"<div class=ad>x</div><p>{i}</p>") for i in range(3)] + [(9200, None, None), (9200, None, None), (None, "http://h1.example/", "<nav>a</nav><div>b c")]
    tree, said = brute_tree(rows, extract.EVIDENCE, extract.THRESHOLD, extract.SHARE)
    want = {(h, extract._digest(f"{h}\x1f{up}"), extract._digest(f"{h}\x1f{path}"), role): v for (h, up, path, role), v in tree.items()}
    got = {(r["host"], r["up"], r["node"], r["role"]): (r["pages"], r["importance"], r["information"]) for r in extract.style_tree(pages_of(spark, rows)).collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-9)
    texts = sorted((repr(i), extract.Page(t or "").text(extract.host_of(u), said.get(extract.host_of(u)))) for i, u, t in rows)
    for nodes, salted in ((extract.NODES, extract.SALTED), (0, 4)):
        monkeypatch.setattr(extract, "NODES", nodes)
        monkeypatch.setattr(extract, "SALTED", salted)
        assert sorted((repr(r["page_id"]), r["text"]) for r in extract.extracted(pages_of(spark, rows)).collect()) == texts


def test_the_tree_decides_without_landmarks_and_names(spark):
    rows = undeclared(2, 4, 25)
    pages = pages_of(spark, [r[:3] for r in rows])
    with_tree = {r["page_id"]: r["text"] for r in extract.extracted(pages).collect()}
    without = {r["page_id"]: r["text"] for r in extract.extracted(pages, evidence=10**9).collect()}
    assert with_tree == {i: text for i, _, _, text in rows}  # all planted boilerplate goes, all of the story stays
    assert all("Follow all our news" in t and "Rated by our users" in t and "Made by" in t for t in without.values())


def test_names_do_not_remove_the_strongest_branch_and_readers_go(spark):
    rng = random.Random(4)
    want, rows = {}, []
    for i in range(20):
        story, remark = sentence(rng, 60), sentence(rng, 80)
        want[i] = story
        rows.append((i, "http://h.example/", f"<body><div class=sidebar-layout><p>{story}</p></div><div class=notice>{sentence(rng, 30)}</div><div class=comments><p>{remark}</p></div></body>"))
    assert {r["page_id"]: r["text"] for r in extract.extracted(pages_of(spark, rows)).collect()} == want


def test_copies_of_an_article_with_new_adverts_are_one_page(spark):
    rng = random.Random(5)
    story = sentence(rng, 100)
    rows = [(i, "http://h.example/", f"<body><div class=x>{sentence(rng, 12)}</div><article><p>{story}</p></article></body>") for i in range(30)]
    assert {r["text"] for r in extract.extracted(pages_of(spark, rows)).collect()} == {story}
    assert extract.style_tree(pages_of(spark, rows)).agg(F.max("pages")).first()[0] == 1


def test_op8_query(spark, tmp_path):
    rows = [r[:3] for r in undeclared(6, 1, 10)] + [(500, None, None), (501, "u", "<article>é&amp;x</article>")]
    pages_of(spark, rows).select("page_id", "url", "html").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r for r in extract.op8(spark, str(tmp_path)).collect()}
    want = {i: t for i, _, _, t in undeclared(6, 1, 10)} | {500: "", 501: "é&x"}
    assert {i: (r["url"], r["text"], r["n_chars"]) for i, r in got.items()} == {i: (u, want[i], len(want[i])) for i, u, _ in rows}
