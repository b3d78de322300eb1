"""Main text of web pages by a site style tree.

Pages become trees (a tolerant reader with implied end tags). The trees of one
host are merged: elements with the same path of tag, class and id are one node
of the site style tree, and the text that a container holds outside its inner
containers is a node beside these. A node on m pages has

* presentation: entropy, base m, of the child sequences that it shows;
* content: 1 minus the mean, over the different texts of its branch, of
  log_m(number of pages that show the text): 0 if all pages show one text, 1 if
  each shows its own; importance joins the two;
* information: mean over the pages of the words it shows, each text counted by
  1 - log_m(pages that show it); standing is its information as a share of the
  strongest sibling's (of those on a tenth as many pages at least).

On a host with at least ``evidence`` different pages the tree decides:

* a branch whose importance is below ``threshold`` goes (what a host repeats);
* from the root down to the nodes that hold text of some standing themselves (or
  are an article or main element), a container whose standing is below ``share``
  goes, however new its words are (menus, adverts, footers that differ by page);
* there a container that declares itself as a menu, header, notice and so on
  (fixed lists below) goes unless it is the strongest of its siblings.

Declarations decide alone where the tree can say nothing: on hosts of fewer pages
(there text is taken from an article, else a main element, if a page has one),
for nodes on fewer pages, inside the text, and for readers' comments, whose words
are as rare as the author's. Article and main elements and what holds them are
never removed by the tree, nor are paragraphs, lists and headings by standing.

Pages of a host whose longest blocks (at least half as long as the longest) are
equal are copies: one stands for them in the tree.

Only per-page digests (one row a page) are shuffled for the tree, copies
pre-aggregated. What the tree says of a host (its few low, strongest and text
nodes) is broadcast if there are at most ``NODES`` of them in all; else it is
joined by host with salts after the number of the host's pages.

Defined cases: a null html is an empty page (empty text); a null url is the host
""; broken or unclosed markup never raises; repeated rows are copies; null ids
come back null; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm import scan

THRESHOLD, SHARE, EVIDENCE, GAMMA = 0.25, 0.125, 8, 0.9
#: Nodes that are broadcast, and pages of a host to a salt beyond that.
NODES, SALTED = 1_000_000, 5_000

# Elements by how HTML treats them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: Start tags that end an open p.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: A start tag of the key ends the nearest open one of these, but not beyond the bounds.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
#: Blocks that are text; other blocks are containers.
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol li dl dt dd table caption thead tbody tfoot tr td th figure figcaption address hr hgroup details summary".split())
#: Elements that are never part of the text; those that declare another part; those that do outside an article.
NEVER = frozenset("head title script style noscript template svg math canvas iframe object embed audio video form button select option textarea input datalist map noembed noframes".split())
APART = frozenset("nav footer aside dialog menu".split())
OUTSIDE = frozenset(["header"])
ROLES = frozenset("navigation banner contentinfo search complementary dialog alert alertdialog menu menubar form toolbar".split())
#: Words in a class or id that name a part that isn't the text.
NAMES = frozenset(
    "nav navbar navigation menu menubar menus breadcrumb breadcrumbs masthead footer sidebar aside widget widgets ad ads adv advert adverts advertisement advertising adslot sponsor sponsored sponsors promo promos promotion "
    "cookie cookies consent notice notices gdpr popup modal overlay newsletter subscribe subscription signup login signin search share sharing sharebar social related recommended recommendations teaser teasers comment comments commentlist "
    "reply replies disqus discussion respond pagination pager toolbar copyright legal skip skiplink paywall".split()
)
#: Such words for what readers write.
READERS = frozenset("comment comments commentlist reply replies disqus discussion respond".split())
#: Such words that name a page's part only if no word for the text stands beside them.
WEAK = frozenset("header banner top bottom side left right meta".split())
TEXTUAL = frozenset("article post entry content story main body text page".split())
#: Their names declare nothing.
NAMELESS = frozenset("html body article main".split())

#: Roles of nodes: text blocks, containers, the text beside a container's containers, the page.
BLOCK, BOX, BESIDE, ROOT = range(4)
#: What the tree says: the host repeats the branch; a container of little standing; the strongest of its siblings; a node
#: whose own text has standing; the root of a host with enough pages.
SAME, SMALL, TOP, FULL, KNOWN = range(5)

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
DIGITS = re.compile(r"\d+")


class Page:
    """A page as a list of nodes (tag, path, parent, what it declares) and of texts (node, string or None for a break)."""

    def __init__(self, source: str):
        self.tag: list[str] = ["#"]
        self.path: list[str] = [""]
        self.parent: list[int] = [-1]
        self.never: list[bool] = [False]  # not text whatever the tree says
        self.apart: list[bool] = [False]  # declares another part of the page
        self.children: list[list[str]] = [[]]
        self.texts: list[tuple[int, str | None]] = []
        stack = [0]
        at, end = 0, len(source)
        while at < end:
            m = TOKEN.search(source, at)
            if m is None:
                self._text(stack[-1], source[at:])
                break
            if m.start() > at:
                self._text(stack[-1], source[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                self._close(stack, tag)
                continue
            self._open(stack, tag, m[3])
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, at)
                body, at = (source[at : close.start()], close.end()) if close else (source[at:], end)
                self._text(stack[-1], body)
                self._close(stack, tag)
            elif tag in VOID:
                stack.pop()

    def _text(self, node: int, text: str) -> None:
        self.texts.append((node, text))

    def _open(self, stack: list[int], tag: str, attributes: str) -> None:
        if tag in ENDS_P and any(self.tag[i] == "p" for i in stack):
            self._pop(stack, {"p"}, set())
        elif tag in ENDS:
            self._pop(stack, *ENDS[tag])
        up = stack[-1]
        name, never, apart = tag, tag in NEVER, tag in APART or tag in OUTSIDE and not any(self.tag[i] in ("article", "main") for i in stack)
        if attributes:
            a = {k.lower(): entities.unescape(x or y or z) for k, x, y, z in ATTRIBUTE.findall(attributes)}
            label = " ".join(sorted(a.get("class", "").split()))
            if label or "id" in a:
                name = DIGITS.sub("0", f"{tag}.{label}#{a.get('id', '')}")
            words = {w.lower() for w in NAME_WORD.findall(f"{a.get('class', '')} {a.get('id', '')}")}
            never = never or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in a.get("style", "").replace(" ", "").lower()
            if tag not in NAMELESS:
                never = never or bool(words & READERS)
                apart = apart or bool(words & NAMES) or bool(words & WEAK) and not words & TEXTUAL
            elif tag in ("article", "main") and words & {"comment", "comments", "reply", "teaser", "related"}:
                never = True
            apart = apart or a.get("role", "").lower() in ROLES
        self.children[up].append(name)
        self.tag.append(tag)
        self.path.append(f"{self.path[up]}/{name}")
        self.parent.append(up)
        self.never.append(never or self.never[up])
        self.apart.append(apart)
        self.children.append([])
        if tag not in INLINE:
            self.texts.append((len(self.tag) - 1, None))
        stack.append(len(self.tag) - 1)

    def _pop(self, stack: list[int], tags: set[str], bounds: set[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if self.tag[stack[i]] in tags:
                self._cut(stack, i)
                return
            if self.tag[stack[i]] in bounds:
                return

    def _close(self, stack: list[int], tag: str) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if self.tag[stack[i]] == tag:
                self._cut(stack, i)
                return
            if tag in INLINE and self.tag[stack[i]] not in INLINE:
                return  # an inline end tag doesn't end a block
        if tag in ("br", "p"):
            self.texts.append((stack[-1], None))

    def _cut(self, stack: list[int], i: int) -> None:
        if any(self.tag[n] not in INLINE for n in stack[i:]):
            self.texts.append((stack[i - 1], None))
        del stack[i:]

    def _container(self, node: int) -> bool:
        return self.tag[node] not in INLINE and self.tag[node] not in FLOW

    def blocks(self) -> list[str]:
        """What the page shows or hides, block by block, as it stands in the markup."""
        out, block = [], []
        for node, text in self.texts:
            if text is None:
                out.append(" ".join("".join(block).split()))
                block = []
            elif not self.never[node]:
                block.append(text)
        return [*out, " ".join("".join(block).split())]

    def copy(self) -> str:
        """Equal for pages with the same long blocks."""
        blocks = self.blocks()
        least = max(1, max(map(len, blocks)) / 2)
        return "\x1f".join(b for b in blocks if len(b) >= least)

    def nodes(self) -> Iterator[tuple[str, str, int, str, str, int]]:
        """For each block path of the page: parent's path, path, role, the branch's texts, the child sequences, the words."""
        content: dict[str, list[str]] = {}
        for node, text in self.texts:
            if text is not None and not self.never[node] and (text := " ".join(text.split())):
                near, seen = node, set()
                while near > 0 and not self._container(near):
                    near = self.parent[near]
                content.setdefault(f"{self.path[near]}/#", []).append(text)
                while node >= 0:
                    if self.tag[node] not in INLINE and self.path[node] not in seen:
                        seen.add(self.path[node])
                        content.setdefault(self.path[node], []).append(text)
                    node = self.parent[node]
        kids: dict[str, tuple[str, int, list[str]]] = {}
        for n in range(len(self.tag)):
            if self.tag[n] not in INLINE and not self.never[n]:
                up = self.parent[n]
                while up > 0 and self.tag[up] in INLINE:
                    up = self.parent[up]
                role = ROOT if n == 0 else BOX if self._container(n) else BLOCK
                kids.setdefault(self.path[n], (self.path[up] if up >= 0 else "-", role, []))[2].append(",".join(self.children[n]))
                if f"{self.path[n]}/#" in content:
                    kids.setdefault(f"{self.path[n]}/#", (self.path[n], BESIDE, []))
        for path, (up, role, styles) in kids.items():
            texts = content.get(path, [])
            yield up, path, role, "\x1f".join(texts), "\x1f".join(styles), sum(t.count(" ") + 1 for t in texts)

    def text(self, host: str = "", said: tuple[set[int], set[int], set[int], set[int]] | None = None) -> str:
        """The text. ``said``: what the tree says of the host (see ``verdicts``); None: nothing, there are too few pages."""
        n = len(self.tag)
        same, small, top, full = said or (set(), set(), set(), set())
        dropped, holds, judged, within = list(self.never), [False] * n, [False] * n, [False] * n
        at = [_digest(f"{host}\x1f{p}") for p in self.path] if said else []
        for mark in ("article", "main"):
            marks = [i for i in range(n) if self.tag[i] == mark and not self.never[i] and not self._apart(i)]
            if marks:
                break
        for i in marks:
            up = i
            while up >= 0 and not holds[up]:
                holds[up] = True
                up = self.parent[up]
        for i in range(n):
            up = self.parent[i]
            if said:
                judged[i] = i == 0 or judged[up] and at[up] not in full and self.tag[up] not in ("article", "main")
                low = at[i] in same or judged[i] and self._container(i) and at[i] in small
                out = low and not holds[i] and self.tag[i] not in INLINE or self.apart[i] and not (judged[i] and at[i] in top)
            else:
                out = self.apart[i]
            within[i] = bool(said) or i in marks or i > 0 and within[up]
            dropped[i] = dropped[i] or out or i > 0 and dropped[up]
        blocks, block = [], []
        for node, text in self.texts:
            if text is None:
                blocks.append("".join(block))
                block = []
            elif not dropped[node] and (within[node] or not marks):
                block.append(text)
        blocks.append("".join(block))
        return " ".join(x for x in (" ".join(entities.unescape(b).split()) for b in blocks) if x)

    def _apart(self, node: int) -> bool:
        while node >= 0 and not self.apart[node]:
            node = self.parent[node]
        return node >= 0


def _digest(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def _host(url: str) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


_NODE = pa.struct([("up", pa.int64()), ("node", pa.int64()), ("role", pa.int32()), ("content", pa.int64()), ("style", pa.int64()), ("words", pa.int32())])


def style_tree(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """The merged trees: host, up (the parent), node, role, pages (different ones that have it), importance, information."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for u, t in zip(part.column("u").to_pylist(), part.column("t").to_pylist(), strict=True):
                    h, page = host_of(u), Page(t or "")
                    nodes = [{"up": _digest(f"{h}\x1f{up}"), "node": _digest(f"{h}\x1f{path}"), "role": role, "content": _digest(x), "style": _digest(y), "words": w} for up, path, role, x, y, w in page.nodes()]
                    rows.append((h, _digest(page.copy()), _digest(t or ""), nodes))
                yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in list(zip(*rows, strict=True))[:3]), pa.array([r[3] for r in rows], pa.list_(_NODE))], ["host", "copy", "page", "nodes"])

    seen = pages.select(F.col(url).alias("u"), F.col(html).alias("t")).mapInArrow(digest, "host string, copy long, page long, nodes array<struct<up: long, node: long, role: int, content: long, style: long, words: int>>")
    once = seen.groupBy("host", "copy").agg(F.min_by("nodes", "page").alias("nodes")).select("host", F.explode("nodes").alias("n")).select("host", "n.*")
    # one pass: a row for each text and one for each child sequence
    shown = F.array(F.struct(F.lit(True).alias("text"), F.col("content").alias("v"), F.col("words").alias("w")), F.struct(F.lit(False).alias("text"), F.col("style").alias("v"), F.lit(0).alias("w")))
    key = ["host", "up", "node", "role"]
    counts = once.select(*key, F.explode(shown).alias("x")).groupBy(*key, "x.text", "x.v").agg(F.count("*").alias("c"), F.max("x.w").alias("w"))
    c, text, words = F.col("c"), F.col("text"), F.col("c") * F.col("w")
    sums = counts.groupBy(*key).agg(
        F.sum(F.when(text, c)).alias("pages"), F.sum(F.when(text, F.ln("c"))).alias("logs"), F.count(F.when(text, F.lit(1))).alias("texts"), F.sum(F.when(~text, c * F.ln("c"))).alias("clogs"),
        F.sum(F.when(text, words)).alias("words"), F.sum(F.when(text, words * F.ln("c"))).alias("wlogs"),
    )
    m = F.when(F.col("pages") < 2, F.lit(1.0)).otherwise(F.ln("pages"))
    importance = (1 - GAMMA) * (1 - F.col("clogs") / F.col("pages") / m) + GAMMA * (1 - F.col("logs") / F.col("texts") / m)
    return sums.select(*key, "pages", importance.alias("importance"), ((F.col("words") - F.col("wlogs") / m) / F.col("pages")).alias("information"))


def verdicts(tree: DataFrame, threshold: float = THRESHOLD, share: float = SHARE, evidence: int = EVIDENCE) -> DataFrame:
    """host, node, said: what the tree says of the nodes on enough pages."""
    role, info, best = F.col("role"), F.col("information"), F.col("best")
    beside = Window.partitionBy("host", "up", "boxed").orderBy(F.floor(100 * F.log10("pages"))).rangeBetween(-100, Window.unboundedFollowing)  # a tenth of the pages
    nodes = tree.where(F.col("pages") >= evidence).withColumn("boxed", role.isin(BOX, BESIDE)).withColumn("best", F.when(F.col("boxed"), F.max("information").over(beside)))
    box = role == BOX
    said = F.array(
        F.when((role != BESIDE) & (role != ROOT) & (F.col("importance") < threshold), F.struct(F.col("node"), F.lit(SAME).alias("said"))),
        F.when(box & (info < share * best), F.struct(F.col("node"), F.lit(SMALL).alias("said"))),
        F.when(box & (info >= best) & (info > 0), F.struct(F.col("node"), F.lit(TOP).alias("said"))),
        F.when((role == BESIDE) & (info >= share * best) & (info > 0), F.struct(F.col("up").alias("node"), F.lit(FULL).alias("said"))),
        F.when(role == ROOT, F.struct(F.col("node"), F.lit(KNOWN).alias("said"))),
    )
    return nodes.select("host", F.explode(F.array_compact(said)).alias("s")).select("host", "s.node", "s.said")


def extracted(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", threshold: float = THRESHOLD, share: float = SHARE, evidence: int = EVIDENCE) -> DataFrame:
    """page_id, url, text of every row."""
    scan.small_batches(pages)
    said = scan.cut(verdicts(style_tree(pages, url, html), threshold, share, evidence))
    kinds = [SAME, SMALL, TOP, FULL]
    lists = said.groupBy("host").agg(*[F.collect_list(F.when(F.col("said") == k, F.col("node"))).alias(f"s{k}") for k in kinds])
    rows = pages.select(F.col(key).cast("long").alias("id"), F.col(url).alias("u"), F.col(html).alias("t"), _host(url).alias("host"))
    if said.count() <= NODES:
        joined = rows.join(F.broadcast(lists), "host", "left")
    else:  # hosts of more than `per` pages, a million at most, get salts
        sizes = scan.cut(rows.groupBy("host").count())
        per = max(SALTED, (sizes.agg(F.sum("count")).first()[0] or 0) // 1_000_000)
        hot = F.broadcast(sizes.where(F.col("count") > per).select("host", F.ceil(F.col("count") / per).cast("int").alias("salts")))
        salts = F.coalesce("salts", F.lit(1))
        rows = rows.join(hot, "host", "left").withColumn("salt", F.pmod(F.xxhash64("id", "t"), salts).cast("int")).drop("salts")
        joined = rows.join(lists.join(hot, "host", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts"), ["host", "salt"], "left")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple[str | None, tuple | None] = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = []
                for i, (t, h) in enumerate(zip(part.column("t").to_pylist(), part.column("host").to_pylist(), strict=True)):
                    if known[0] != h:
                        known = h, tuple(set(part.column(f"s{k}")[i].as_py()) for k in kinds) if part.column("s0")[i].is_valid else None
                    texts.append(Page(t or "").text(*known))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("u"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return joined.select("id", "u", "t", "host", *[f"s{k}" for k in kinds]).mapInArrow(take, "page_id long, url string, text string")


def op8(spark, sf_dir: str) -> DataFrame:
    rows = extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
