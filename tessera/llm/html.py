"""Operator 10: main text of web pages, with the templates of each site removed."""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.session import materialize

#: What a subtree must recur with to be template, by the place it has in the page at hand: (different articles of
#: the host, share of them). Chrome is what stands outside a marked article; prose is the article's own elements.
CHROME, PART, PROSE_PART = (5, 0.01), (5, 0.2), (10, 0.5)
#: Up to so many templates of all sites together (12 MB) are broadcast; more are joined.
MAX_SHARED = 1_000_000

#: Element names of HTML by the part they play here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
DROP = frozenset(
    "script style noscript template iframe object svg canvas nav header footer aside form button select option textarea "
    "input dialog menu head title audio video map".split()
)
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Inside a marked article these are its prose, which a site repeats more often before it is template (quotes, shared passages).
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt figcaption td th".split())
#: A start tag of the key's set ends an open element of the key.
CLOSED_BY = {
    "p": BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"},
    "li": frozenset({"li"}),
    "dt": frozenset({"dt", "dd"}),
    "dd": frozenset({"dt", "dd"}),
    "tr": frozenset({"tr", "tbody", "thead", "tfoot"}),
    "td": frozenset({"td", "th", "tr", "tbody", "thead", "tfoot"}),
    "th": frozenset({"td", "th", "tr", "tbody", "thead", "tfoot"}),
    "option": frozenset({"option", "optgroup"}),
}
#: Words in class, id or role that mark what is not the article.
_MARKS = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|breadcrumbs?|header|masthead|footer|sidebar|aside|widget|ads?|advert\w*|sponsor\w*|"
    r"promo\w*|banner|cookies?|consent|gdpr|notice|popup|modal|newsletter|subscribe|subscription|signup|login|social|share|sharing|"
    r"related|recommend\w*|comments?|commentlist|disqus|replies|reply|contentinfo|complementary|search|pagination|pager|skip|toolbar|alert)"
    r"(?=$|[\s_-])",
    re.I,
)
_OTHER = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
#: A tag up to its '>'; possessive, so that a tag without an end is read once.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


@dataclass(slots=True)
class Node:
    """An element: its children are nodes and pieces of text, in page order; `parent` is a place in the page's list."""

    tag: str
    parent: int = -1
    marks: str = ""
    named: bool = False
    children: list = field(default_factory=list)
    digest: int = 0
    size: int = 0


class _Open:
    """The open elements, with the places of each tag and of blocks, so that an end tag costs no search."""

    def __init__(self, nodes: list[Node]):
        self.nodes, self.stack = nodes, [0]
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, place: int) -> None:
        tag = self.nodes[place].tag
        self.at.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(place)

    def cut(self, depth: int) -> None:
        """Close everything from `depth` on."""
        while len(self.stack) > depth:
            tag = self.nodes[self.stack.pop()].tag
            self.at[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()

    def top(self) -> Node:
        return self.nodes[self.stack[-1]]

    def start(self, name: str) -> None:
        """Close what a start tag of that name ends."""
        while len(self.stack) > 1 and name in CLOSED_BY.get(self.top().tag, ()):
            self.cut(len(self.stack) - 1)
        if name in CLOSED_BY["p"] and self.blocks and self.nodes[self.stack[self.blocks[-1]]].tag == "p":
            self.cut(self.blocks[-1])  # an open paragraph with open inline elements

    def end(self, name: str) -> None:
        """Close the last element of that name; an inline end tag doesn't close blocks."""
        at = self.at.get(name)
        if at and (name in BLOCK or not self.blocks or at[-1] > self.blocks[-1]):
            self.cut(at[-1])


def parse(page: str) -> list[Node]:
    """The elements of the page in page order, a root first.

    Unclosed and misnested tags are forgiven; attributes but class, id and role are dropped. One pass, linear
    in the page: any depth, any number of unclosed tags, quotes or stray end tags.
    """
    nodes = [Node("#root")]
    own, at, n = _Open(nodes), 0, len(page)
    while at < n:
        begin = page.find("<", at)
        if begin < 0:
            own.top().children.append(page[at:])
            break
        kind = page[begin + 1 : begin + 2]
        m = _OTHER.match(page, begin) if kind in ("!", "?") else _TAG.match(page, begin) if kind == "/" or kind.isascii() and kind.isalpha() else None
        if not m:  # a lone '<' is text, unless it opens the last end tag of a page that is cut off
            own.top().children.append(page[at : begin + 1] if begin + 1 < n else page[at:begin])
            at = begin + 1
            continue
        if begin > at:
            own.top().children.append(page[at:begin])
        if kind in ("!", "?"):
            at = m.end()
            if m[0].startswith("<![CDATA["):
                own.top().children.append(_escape(m[0][9:].removesuffix("]]>")))
            continue
        end = m.end() if page.startswith(">", m.end()) else page.find(">", m.end())  # an open quote ends the tag at the next '>'
        if end < 0:
            break  # the page's end cuts the tag off
        at = end + 1
        name, attributes = m[2].lower(), page[m.start(3) : end]
        if m[1]:
            own.end(name)
            continue
        own.start(name)
        marks = _marks(attributes)
        node = Node(name, own.stack[-1], marks, bool(marks and _MARKS.search(marks)))
        own.top().children.append(node)
        nodes.append(node)
        if name in VOID or attributes.endswith("/"):
            continue
        if name in RAW:
            stop = _RAW_END[name].search(page, at)
            node.children.append(page[at : stop.start() if stop else n])
            at = page.find(">", stop.end()) + 1 if stop else n
            at = at or n
            continue
        own.push(len(nodes) - 1)
    return nodes


def _signed(digest: int) -> int:
    return digest - (1 << 64) if digest >> 63 else digest


def _escape(text: str) -> str:
    return text.replace("&", "&amp;")


def _marks(attributes: str) -> str:
    if not attributes or "=" not in attributes and "hidden" not in attributes.lower():
        return ""
    out = []
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            out.append("modal")
        elif name != "aria-hidden":
            out.append(value)
    return " ".join(out)


def digest(nodes: list[Node]) -> None:
    """Hash each subtree from its tag, marks, text and children, 0 if it holds no text; and sum up its text."""
    for node in reversed(nodes):  # children come after their parents
        h = hashlib.blake2b(f"{node.tag}\0{node.marks}".encode("utf-8", "surrogatepass"), digest_size=8)
        full, node.size = False, 0
        for child in node.children:
            if isinstance(child, str):
                text = " ".join(child.split())
                full |= bool(text)
                node.size += len(text)
                h.update(b"\1" + text.encode("utf-8", "surrogatepass"))
            else:
                full |= child.digest != 0
                node.size += child.size
                h.update(b"\2" + child.digest.to_bytes(8, "little"))
        if node.tag in ("script", "style"):
            full = False
        node.digest = int.from_bytes(h.digest(), "little") | 1 if full else 0


def _article(nodes: list[Node]) -> int:
    """Place of the element that holds the article: the one <main> or <article>, else the largest <article>, else the page."""
    found: dict[str, list[int]] = {"article": [], "main": []}
    out = [False] * len(nodes)
    for i, node in enumerate(nodes[1:], 1):
        if out[node.parent] or node.tag in DROP - {"header"} or node.named and node.tag not in ("body", "html"):
            out[i] = True
            continue
        kind = "main" if node.marks and node.tag != "body" and re.search(r"(?:^|\s)main(?:$|\s)", node.marks) else node.tag
        if kind in found:
            found[kind].append(i)
    for kind in ("main", "article"):
        if len(found[kind]) == 1:
            return found[kind][0]
    every = found["article"] or found["main"]
    if len(every) < 2:
        return every[0] if every else 0
    size = [0] * len(nodes)
    for i in range(len(nodes) - 1, 0, -1):
        size[i] += sum(len(c) for c in nodes[i].children if isinstance(c, str))
        size[nodes[i].parent] += size[i]
    return max(every, key=lambda i: size[i])


def _may_go(node: Node) -> bool:
    """Whether the subtree may be template as a whole: a block with text."""
    return bool(node.digest) and node.tag in BLOCK and node.tag not in ("html", "body", "article", "main")


def delete_templates(nodes: list[Node], level: dict[int, int]) -> tuple[list[Node], int]:
    """The page without the subtrees that its site repeats, and how much text went with them.

    `level` has the recurring subtrees: 0 recurs often enough for chrome, 1 for a part of the content, 2 for prose
    of a marked article. The article is what the page's markup says before anything goes.
    """
    article = _article(nodes)
    inside, gone = [False] * len(nodes), [False] * len(nodes)
    removed, kept = 0, []
    for i, node in enumerate(nodes):
        up = node.parent
        inside[i] = i == article or up >= 0 and inside[up]
        gone[i] = up >= 0 and gone[up]
        if not gone[i] and i and i != article and node.digest in level and _may_go(node):
            need = 0 if not inside[i] else 2 if article and node.tag in PROSE else 1
            if level[node.digest] >= need:
                gone[i] = True
                removed += node.size
                # What stands on both sides of a block that goes stays apart.
                node.children = []
    for i, node in enumerate(nodes):
        if not gone[i] or not gone[node.parent]:
            kept.append(i)
    place = {old: new for new, old in enumerate(kept)}
    for i in kept:
        if nodes[i].parent >= 0:
            nodes[i].parent = place[nodes[i].parent]
    return [nodes[i] for i in kept], removed


def _not_article(node: Node) -> bool:
    """By name, class, id or role: what is left where a site repeats too little."""
    return node.tag in DROP or node.named and node.tag in BLOCK | {"span", "ins"} and node.tag not in ("html", "body", "article", "main")


def main_text(nodes: list[Node]) -> str:
    """The article's blocks, one a line: character references decoded, white space folded."""
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = " ".join(entities.unescape("".join(line)).split())
        if text:
            blocks.append(text)
        line.clear()

    root = nodes[_article(nodes)]
    open_nodes = [(root, iter(root.children))]
    while open_nodes:
        node, rest = open_nodes[-1]
        child = next(rest, None)
        if child is None:
            open_nodes.pop()
            if node.tag in BLOCK:
                flush()
        elif isinstance(child, str):
            line.append(child)
        else:
            if child.tag in BLOCK:
                flush()
            if not _not_article(child):
                if child.tag == "br":
                    line.append(" ")
                open_nodes.append((child, iter(child.children)))
    flush()
    return "\n".join(blocks)


def host_of(url: str) -> Column:
    """Column: the host of a URL in lower case, '' if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))


def _host_id() -> Column:
    return F.xxhash64("host")


def page_subtrees(pages: DataFrame) -> DataFrame:
    """(key, host, article, digests) from (key, host, html): the hashes of a page's blocks, each once, and of its article."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, articles = [], []
            for page in batch.column("html").to_pylist():
                nodes = parse(page or "")
                digest(nodes)
                own.append(sorted({_signed(node.digest) for node in nodes if _may_go(node)}))
                articles.append(_signed(nodes[_article(nodes)].digest))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("host"), pa.array(articles, pa.int64()), pa.array(own, pa.list_(pa.int64()))],
                names=["key", "host", "article", "digests"],
            )

    return pages.mapInArrow(hashes, "key long, host long, article long, digests array<long>")


def site_templates(subtrees: DataFrame) -> DataFrame:
    """(host, digest, level) of the subtrees that recur across the articles of their host.

    Each article of a host counts once, with the subtrees of its page with the smallest key, so copies of a page don't
    make a template and reruns agree. The counts are summed before the shuffle, in which a host with many pages is split by subtree.
    """
    once = subtrees.groupBy("host", "article").agg(F.min_by("digests", "key").alias("digests"))
    once = materialize(once.select("host", "digests"), "articles")
    sizes = once.groupBy("host").agg(F.count("*").alias("articles"))
    counts = once.select("host", F.explode("digests").alias("digest")).groupBy("host", "digest").agg(F.count("*").alias("n"))
    counts = counts.filter(F.col("n") >= min(CHROME[0], PART[0], PROSE_PART[0])).join(sizes.filter(F.col("articles") >= CHROME[0]), "host")
    recurs = lambda rule: (F.col("n") >= rule[0]) & (F.col("n") >= rule[1] * F.col("articles"))
    level = F.when(recurs(PROSE_PART), 2).when(recurs(PART), 1).when(recurs(CHROME), 0)
    return counts.select("host", "digest", level.alias("level")).filter("level is not null")


class _Shared:
    """Templates by host in sorted arrays; the tables of the hosts in use are kept, a bounded number of them."""

    def __init__(self, table: pa.Table):
        host = table["host"].to_numpy()
        order = np.argsort(host, kind="stable")
        self.host, self.digest = host[order], table["digest"].to_numpy()[order]
        self.level = table["level"].to_numpy()[order].astype(np.int8)
        self.cache: dict[int, dict[int, int]] = {}

    def of(self, host: int) -> dict[int, int]:
        if host not in self.cache:
            if len(self.cache) >= 200:
                self.cache.clear()
            a, b = np.searchsorted(self.host, [host, host + 1])
            self.cache[host] = {int(d) & _ALL: int(v) for d, v in zip(self.digest[a:b], self.level[a:b], strict=True)}
        return self.cache[host]


_ALL = 0xFFFFFFFFFFFFFFFF


def page_text(page: str | None, level: dict[int, int]) -> tuple[str, int]:
    """The main text of a page, and the characters that went as template; a page that they would empty keeps its text."""
    nodes, removed = parse(page or ""), 0
    if level:
        digest(nodes)
        nodes, removed = delete_templates(nodes, level)
    text = main_text(nodes)
    return (text, removed) if text or not removed else (main_text(parse(page or "")), 0)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", max_shared: int = MAX_SHARED) -> DataFrame:
    """(id, url, text, n_template): the article's text of every page, without the templates of its site.

    Two passes over the pages. The first hashes every block's subtree, and Spark counts per host the different
    articles that each comes with. The second deletes from each page the subtrees that recur enough
    (`n_template` characters), and takes the article out of what is left; elements that are not the article by
    name (nav, aside, form ...), class, id or role go too, which is all there is for a host of few pages.

    A host's templates are bounded by 100 times the blocks of a mean page. If all sites together have no more
    than `max_shared`, they are broadcast; else each page is joined with its own.

    Cases: null or empty html gives an empty text; a null or hostless URL puts the page on a host of that kind;
    repeated rows stay, and count as one article; null and repeated ids are no special case, as pages are told
    apart by a hash of their content; broken markup of any depth is parsed leniently; an empty table gives an
    empty result; other columns are not read. Prose of a marked article stays unless half of the host's articles
    (10 at least) have it; if template removal would empty a page, its text is kept.
    """
    base = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(url_col).alias("host"))
    base = base.select("page", "url", "html", _host_id().alias("host"), F.xxhash64("host", "html").alias("key"))
    subtrees = materialize(page_subtrees(base.select("key", "host", "html")), "subtrees")
    templates = materialize(site_templates(subtrees), "templates")
    out = f"page {base.schema['page'].dataType.simpleString()}, url string, text string, n_template long"

    def texts(batches: Iterator[pa.RecordBatch], levels) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [page_text(page, level) for page, level in zip(batch.column("html").to_pylist(), levels(batch), strict=True)]
            text, removed = pa.array([t for t, _ in done], pa.string()), pa.array([r for _, r in done], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("page"), batch.column("url"), text, removed], names=["page", "url", "text", "n_template"])

    if templates.count() <= max_shared:
        shared = pages.sparkSession.sparkContext.broadcast(_Shared(templates.toArrow()))
        by_host = lambda batch: [shared.value.of(h) for h in batch.column("host").to_pylist()]
        got = base.select("page", "url", "html", "host").mapInArrow(lambda b: texts(b, by_host), out)
    else:
        nodes = subtrees.select("key", "host", F.explode("digests").alias("digest"))
        hits = nodes.distinct().join(templates, ["host", "digest"]).groupBy("key").agg(F.collect_list(F.struct("digest", "level")).alias("template"))
        own = lambda batch: [{t["digest"] & _ALL: t["level"] for t in ts or ()} for ts in batch.column("template").to_pylist()]
        got = base.join(hits, "key", "left").select("page", "url", "html", "template").mapInArrow(lambda b: texts(b, own), out)
    return got.withColumnRenamed("page", id_col)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    out = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_template")
