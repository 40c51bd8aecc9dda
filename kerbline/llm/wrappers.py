"""Main text of web pages by wrapper induction over the pages of a host.

The library's own records hold no web pages, so the operator is general: any table
with a page number, its address and its markup.
"""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm import text as tx
from kerbline.session import cut_lineage

#: Share of a host's varying text that the content container must hold.
CONTENT_SHARE = 0.8

# Fixed element names and class words.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template head title svg iframe object textarea select option button canvas math audio video".split())
APART = frozenset("nav header footer aside form menu dialog".split())
APART_WORDS = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|banner|sponsor|sponsored|promo|nav|navbar|menu|breadcrumb|breadcrumbs|header|footer|sidebar|comment|comments|reply|replies|notice|cookie|cookies|consent|popup|modal|newsletter|subscribe|related|share|social|widget|form|login|search)(?:$|[\s_-])", re.I)
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt", "summary", "figcaption"}


class Node:
    __slots__ = ("tag", "apart", "items", "digest", "size", "shape")

    def __init__(self, tag: str, apart: bool):
        self.tag, self.apart, self.items = tag, apart, []

    def children(self) -> list["Node"]:
        return [x for x in self.items if isinstance(x, Node)]


class _Builder(HTMLParser):
    """A forgiving tree of one page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#page", False)
        self.open = [self.root]

    def _close(self, tags: frozenset | set, until: frozenset | set) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                del self.open[i:]
                return
            if self.open[i].tag in until:
                return

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P:
            self._close({"p"}, BLOCKS - {"p"})
        elif tag in ("li", "dd", "dt", "option", "tr", "td", "th"):
            alike = {"dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "td": {"td", "th"}, "th": {"td", "th"}}.get(tag, {tag})
            self._close(alike, {"ul", "ol", "dl", "table", "menu"})
        marks = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role"))
        inside = tag not in ("article", "main", "html", "body")
        node = Node(tag, tag in APART or tag in HIDDEN or bool(inside and marks and APART_WORDS.search(marks)))
        self.open[-1].items.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self._close({tag}, BLOCKS - {tag} if tag not in BLOCKS else set())

    def handle_data(self, data):
        if self.open[-1].tag != "#page" or data.strip():
            self.open[-1].items.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def main_blocks(node: Node) -> list[str]:
    """Text of each block in page order, what stands apart left out."""
    out, line = [], []

    def end():
        joined = " ".join("".join(line).split())
        line.clear()
        if joined:
            out.append(joined)

    stack = [(node, False)]
    while stack:
        item, done = stack.pop()
        if done:
            end()
        elif isinstance(item, str):
            line.append(item)
        elif item.tag == "br":
            line.append(" ")
        elif not (item.apart and item is not node):
            if item.tag in BLOCKS:
                end()
                stack.append((item, True))
            stack.extend((x, False) for x in reversed(item.items))
    end()
    return out


def unrolled(call):
    """The value of a recursive generator, which yields the calls it makes; a page of any depth fits the stack."""
    stack, value = [call], None
    while stack:
        try:
            deeper = stack[-1].send(value)
        except StopIteration as end:
            stack.pop()
            value = end.value
        else:
            stack.append(deeper)
            value = None
    return value


def skeleton(root: Node) -> list:
    """[tag, apart, text hash, text length, number of children] of each node of a tree, parents first."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        own = " ".join("".join(x for x in node.items if isinstance(x, str)).split())
        kids = [] if node.apart else node.children()
        out.append([node.tag, int(node.apart), xxhash.xxh3_64_intdigest(own.encode()) >> 1 if own else 0, len(own), len(kids)])
        stack.extend(reversed(kids))
    return out


def grown(flat: list) -> list:
    """The tree of a skeleton: [tag, apart, text hash, text length, children, hash of the tags below]."""
    nodes = [[*entry[:4], [None] * entry[4], 0] for entry in flat]
    waiting: list[tuple[list, int]] = []
    for node in nodes:
        if waiting:
            parent, at = waiting.pop()
            parent[4][at] = node
        waiting.extend((node, i) for i in reversed(range(len(node[4]))))
    for node in reversed(nodes):
        node[5] = hash((node[0], *(c[5] for c in node[4])))
    return nodes[0]


def match_trees(a: list, b: list) -> tuple[int, list]:
    """Simple tree matching: size of the largest match that keeps order and ancestors, and its node pairs."""
    return unrolled(_match(a, b))


def _alike(a: list, b: list) -> list:
    """The node pairs of two trees of one shape."""
    pairs = [(a, b)]
    for x, y in pairs:
        pairs.extend(zip(x[4], y[4]))
    return pairs


def _match(a: list, b: list):
    if a[0] != b[0]:
        return 0, []
    xs, ys = a[4], b[4]
    size, pairs = 1, [(a, b)]
    lo, hi = 0, 0
    # Equal trees at either end match each other in some largest match.
    while lo < min(len(xs), len(ys)) and xs[lo][5] == ys[lo][5]:
        lo += 1
    while hi < min(len(xs), len(ys)) - lo and xs[-1 - hi][5] == ys[-1 - hi][5]:
        hi += 1
    for x, y in [*zip(xs[:lo], ys[:lo]), *(zip(xs[-hi:], ys[-hi:]) if hi else ())]:
        more = _alike(x, y)
        size += len(more)
        pairs.extend(more)
    xs, ys = xs[lo : len(xs) - hi], ys[lo : len(ys) - hi]
    if xs and ys:
        known = {}
        best = np.zeros((len(xs) + 1, len(ys) + 1), np.int64)
        for i, x in enumerate(xs):
            for j, y in enumerate(ys):
                here = 0
                if x[0] == y[0]:
                    if (x[5], y[5]) not in known:
                        known[x[5], y[5]] = (yield _match(x, y))[0]
                    here = best[i, j] + known[x[5], y[5]]
                best[i + 1, j + 1] = max(best[i, j + 1], best[i + 1, j], here)
        i, j = len(xs), len(ys)
        size += int(best[i, j])
        while i and j:
            if best[i, j] == best[i - 1, j]:
                i -= 1
            elif best[i, j] == best[i, j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.extend((yield _match(xs[i], ys[j]))[1])
    return size, pairs


def below(path: str, tag: str) -> str:
    """Name of the path that leads one node deeper, of one length at any depth."""
    return xxhash.xxh3_128_hexdigest(f"{path}>{tag}")


def varying_text(page: list, model: list) -> dict[tuple[int, str], int]:
    """Characters of varying slots below each (depth, path): text that differs from the matched node's or has no match."""
    page, model = grown(page), grown(model)
    constant = {id(a) for a, b in match_trees(page, model)[1] if a[2] == b[2]}
    out: dict[tuple[int, str], int] = {}
    placed, stack = [], [(page, below("", page[0]), 1, -1)]
    while stack:
        node, path, deep, parent = stack.pop()
        if not node[1]:
            placed.append([node[0], path, deep, parent, 0 if id(node) in constant else node[3]])
            stack.extend((c, below(path, c[0]), deep + 1, len(placed) - 1) for c in reversed(node[4]))
    for tag, path, deep, parent, n in reversed(placed):
        if parent >= 0:
            placed[parent][4] += n
        if n and tag in BLOCKS and tag != "p":
            out[deep, path] = out.get((deep, path), 0) + n
    return out


def find_container(root: Node, path: str | None) -> list[Node]:
    """Nodes at the host's content path; else articles, else main, else the whole page."""
    found: list[Node] = []
    stack = [(root, below("", root.tag))]
    named: dict[str, list[Node]] = {"article": [], "main": []}
    while stack:
        node, at = stack.pop()
        if node.apart:
            continue
        if at == path:
            found.append(node)
        if node.tag in named:
            named[node.tag].append(node)
            if path is None:
                continue
        stack.extend((c, below(at, c.tag)) for c in reversed(node.children()))
    return found or named["article"] or named["main"] or [root]


def extract_main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Main text of each page: `key`, `url`, text, n_chars.

    Every page's tree is aligned by simple tree matching with that of its host's page of
    least `key`. Matched nodes with equal text are template; all others are varying
    slots. The content container of a host is the deepest path that holds at least
    CONTENT_SHARE of the varying text of all its pages; it is extracted from each page
    without what stands apart inside (menus, notices, adverts, forms, comments).
    Hosts without varying text, and pages without their host's container, fall back on
    the article or main element, then on the page.

    Blocks are joined by a line end, white space inside becomes one space. A null page
    gives an empty text; a null address is a host of its own; repeated rows are
    extracted one by one; pages of any depth are fine; an empty table gives no rows.
    """
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (key, url)}
    host = F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))
    given = pages.select(key, url, html, host.alias("host"))

    def outline(batches):
        for batch in batches:
            trees = [json.dumps(skeleton(parse(h)), separators=(",", ":")) for h in tx.plain(batch.column(html)).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column(key), pa.array(trees, pa.string())], names=["host", "id", "tree"])

    def vote(batches):
        for batch in batches:
            hosts, deeps, paths, sizes = [], [], [], []
            for h, tree, model in zip(*(batch.column(c).to_pylist() for c in ("host", "tree", "model"))):
                for (deep, path), n in varying_text(json.loads(tree), json.loads(model)).items():
                    hosts.append(h), deeps.append(deep), paths.append(path), sizes.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(deeps, pa.int32()), pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["host", "deep", "path", "n"])

    def extract(batches):
        for batch in batches:
            texts = []
            for h, path in zip(tx.plain(batch.column(html)).to_pylist(), batch.column("path").to_pylist()):
                texts.append("\n".join(b for node in find_container(parse(h), path) for b in main_blocks(node)))
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column(url), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[key, url, "text", "n_chars"])

    trees = cut_lineage(given.select("host", key, html).mapInArrow(outline, f"host string, id {kinds[key]}, tree string"))
    models = trees.groupBy("host").agg(F.min(F.struct(F.col("id").isNull().alias("unknown"), "id", "tree")).alias("x")).select("host", F.col("x.tree").alias("model"))
    votes = trees.join(models, "host").select("host", "tree", "model").mapInArrow(vote, "host string, deep int, path string, n long").groupBy("host", "deep", "path").agg(F.sum("n").alias("n"))
    most = votes.groupBy("host").agg(F.max("n").alias("all"))
    depth = F.struct("deep", "n", "path")
    chosen = votes.join(most, "host").filter(F.col("n") >= CONTENT_SHARE * F.col("all")).groupBy("host").agg(F.max(depth)["path"].alias("path"))
    return given.join(cut_lineage(chosen), "host", "left").select(key, url, html, "path").mapInArrow(extract, f"`{key}` {kinds[key]}, `{url}` {kinds[url]}, text string, n_chars long")
