"""Main text of web pages by a tree-structured graphical model over the DOM.

Each element and each block of text is a variable with three states: skeleton, content, boilerplate. Node potentials come from
what is seen there (tag; words of class, id and role; a block's length, links and last sign), edge potentials from the states of parent and
child. Both are smoothed frequencies counted on labelled pages. Sum-product messages go up from the leaves and down from the root once; blocks
of text whose marginal of content is at least one half are the page's text.

Every character of a page is read a bounded number of times, however its markup is broken. <head> and </head> may be left out: neither makes a node. Scripts, styles, titles and text areas without an end run to the end of the page, as in browsers;
other silent elements without an end, or closed in themselves, are only a tag.

Inline tags and <br> don't end a block; white space inside a block becomes one space; blocks are joined by one line break. Scripts,
styles, comments and form controls have no text. Pages of any length are parsed whole, their tree in memory. Nulls: a null html is empty, with empty text; null ids and urls and repeated
rows are kept, one result row for each.
A block whose marginal is exactly one half is content. Other columns are left behind; an empty table gives no rows.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rackwise.llm.common import blocks, table
from rackwise.llm.html_pages import labelled_pages

SKELETON, CONTENT, BOILERPLATE = range(3)

#: HTML's tags by their part in a page's text.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr object canvas math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style title textarea noscript template svg iframe select annotation annotation-xml".split())
TO_THE_END = frozenset("script style title textarea".split())
OF_HEAD = frozenset("base basefont bgsound link meta".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
ITEMS = {"li": ("li", ("ul", "ol")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
AGAINST = frozenset("ad ads adv advert advertisement banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies copyright disqus footer form header login masthead menu modal nav navbar navigation newsletter notice popup promo recommended related replies reply search share sharing sidebar signup social sponsor sponsored subscribe tags toolbar widget".split())
FOR = frozenset("article body content entry main post story text".split())

#: Attributes as browsers read them: a value in quotes, or one without that may hold quotes; a stray quote is the name of another attribute.
ATTRIBUTES = r"""(?:[\s/]++|=?[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)?+)?+|=)*+"""
BEGIN = re.compile(r"<(?:(!--)|[!?]|(/?)([a-zA-Z][^\s/>]*))")
TAG = re.compile(rf"({ATTRIBUTES})>", re.S)
COMMENT = re.compile(r"--!?>")
ALONE = re.compile(r"""(?:^|[\s"'])/$""")
END = {t: re.compile(rf"</{t}\s*>", re.I) for t in SILENT}
#: Silent elements that may hold their like.
NESTED = {t: re.compile(rf"<(/?){t}(?=[\s/>])[^>]*>", re.I) for t in ("template", "svg")}
NAMED = re.compile(r"""(?<![\w-])(class|id|role|data-l)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
PART = re.compile(r"[a-z]+")


class Tree:
    """parent, what is seen, and mark of each node; a block of text is a node with a text. Parents come before children."""

    __slots__ = ("parent", "seen", "mark", "text")

    def __init__(self) -> None:
        self.parent, self.seen, self.mark, self.text = [-1], [("tag=#root",)], [""], [None]

    def add(self, parent: int, seen: tuple, mark: str, text: str | None = None) -> int:
        self.parent.append(parent)
        self.seen.append(seen)
        self.mark.append(mark)
        self.text.append(text)
        return len(self.parent) - 1


def _names(attributes: str) -> tuple[str, str]:
    words, mark = set(), ""
    for name, a, b, c in NAMED.findall(attributes):
        if name.lower() == "data-l":
            mark = a or b or c
        else:
            words.update(PART.findall((a or b or c).lower()))
    against, pro = bool(words & AGAINST), bool(words & FOR)
    return "names=" + ("against" if against else "for" if pro else "other" if words else "none"), mark


class Tokens:
    """Tags of a page, (start, end, closing, tag, attributes), the rest is text; comments and declarations are tokens without a tag. A tag whose end can't be told
    by its quotes ends at the next sign of one, and so do all after it: then the quotes have been read to the end of the page once, and
    every character is read a bounded number of times. A sign of a tag behind the page's last > is text."""

    def __init__(self, page: str) -> None:
        self.page, self.last, self.plain = page, page.rfind(">"), False

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        page = self.page
        m = BEGIN.search(page, at)
        if not m or m.start() > self.last and not m[1]:
            return None
        if m[1]:
            if page.startswith((">", "->"), m.end()):  # an empty comment
                return m.start(), page.index(">", m.end()) + 1, "", "", ""
            end = COMMENT.search(page, m.end())
            return m.start(), end.end() if end else len(page), "", "", ""
        if not m[3]:
            return m.start(), page.index(">", m.end()) + 1, "", "", ""
        found = None if self.plain else TAG.match(page, m.end())
        if found:
            return m.start(), found.end(), m[2], m[3], found[1]
        self.plain = True
        end = page.find(">", m.end())
        return (m.start(), end + 1, m[2], m[3], page[m.end() : end]) if end >= 0 else None

    def silent_end(self, tag: str, at: int) -> int:
        """Where a silent element's content ends, its end tag included; -1 without one."""
        if tag not in NESTED:
            m = END[tag].search(self.page, at)
            return m.end() if m else -1
        depth = 1
        for m in NESTED[tag].finditer(self.page, at):
            depth += -1 if m[1] else not m[0].endswith("/>")
            if not depth:
                return m.end()
        return -1


def parse(page: str) -> Tree:
    tree, open_tags, at = Tree(), [("#root", 0)], 0
    places: dict[str, list[int]] = {}
    tokens = Tokens(page)
    run: list[str] = []
    linked = total = in_link = 0

    def end_block() -> None:
        nonlocal linked, total
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            if text:
                n, share = len(text), linked / max(1, total)
                seen = ("size=" + ("10" if n < 10 else "40" if n < 40 else "120" if n < 120 else "400" if n < 400 else "more"), "links=" + ("none" if not share else "few" if share < 0.4 else "most"), "end=" + ("stop" if text[-1] in ".!?…:;\"'" else "none"))
                tree.add(open_tags[-1][1], seen, "", text)
            run.clear()
        linked = total = 0

    def put(s: str) -> None:
        nonlocal linked, total
        run.append(s)
        total += len(s)
        if in_link:
            linked += len(s)

    def close(names: tuple, within: tuple = ()) -> None:
        """Closes up to the innermost open tag of these names, unless one of `within` lies further in."""
        innermost = lambda of: max((places[t][-1] for t in of if places.get(t)), default=0)
        k = innermost(names)
        if k and k >= innermost(within):
            end_block()
            for t, _ in open_tags[k:]:
                places[t].pop()
            del open_tags[k:]

    unclosed: set[str] = set()
    in_head = False
    while token := tokens.next(at):
        start, end, ends, tag, attributes = token
        if start > at:
            put(page[at:start])
        at = end
        if not tag:
            continue
        tag = tag.lower()
        if tag in SILENT:
            run.append(" ")
            alone = ALONE.search(attributes) is not None
            if ends or alone and tag not in TO_THE_END:
                continue
            end = -1 if tag in unclosed else tokens.silent_end(tag, at)
            if end >= 0:
                at = end
            elif tag in TO_THE_END and not alone:
                at = len(page)
            else:
                unclosed.add(tag)
            continue
        if tag == "head":
            in_head = not ends
            continue
        in_head = in_head and tag in OF_HEAD
        if in_head:
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if ends else 1
            elif tag == "br":
                run.append(" ")
            continue
        if ends:
            if tag == "p" and not places.get("p"):
                end_block()
            close((tag,))
            in_link = 0
            continue
        end_block()
        in_link = 0
        if tag in CLOSES_P:
            close(("p",), ("td", "th", "li", "article", "section", "div", "aside", "blockquote", "main"))
        if tag in ITEMS:
            names, within = ITEMS[tag]
            names = names.split()
            for _ in names:
                close(tuple(names), within)
        names, mark = _names(attributes) if attributes else ("names=none", "")
        node = tree.add(open_tags[-1][1], ("tag=" + tag, names), mark)
        if tag not in VOID and not ALONE.search(attributes):
            places.setdefault(tag, []).append(len(open_tags))
            open_tags.append((tag, node))
    if at < len(page):
        put(page[at:])
    end_block()
    return tree


def states(tree: Tree) -> list[int]:
    """The labelled states: below a mark they are the mark's."""
    out = []
    for parent, mark in zip(tree.parent, tree.mark):
        out.append(CONTENT if mark == "c" else BOILERPLATE if mark == "b" else out[parent] if parent >= 0 else SKELETON)
    return out


def evidence_counts(page: str) -> Counter:
    """Counts of (kind, state, value) in one labelled page: what is seen by state, and the child's state by its parent's."""
    tree, found = parse(page), Counter()
    state = states(tree)
    for node, (parent, seen, text) in enumerate(zip(tree.parent, tree.seen, tree.text)):
        found["state", state[node], ""] += 1
        for s in seen:
            found["seen", state[node], s] += 1
        if parent >= 0:
            found["edge" if text is None else "leaf", state[parent], str(state[node])] += 1
    return found


class Model:
    """Log potentials from counts, with each frequency smoothed by one observation spread over the states."""

    def __init__(self, counts: dict[tuple[str, int, str], int]) -> None:
        n = [counts.get(("state", s, ""), 0) + 1 for s in range(3)]
        values = {v for kind, _, v in counts if kind == "seen"}
        self.seen = {v: [math.log((counts.get(("seen", s, v), 0) + 0.5) / (n[s] + 1)) for s in range(3)] for v in values}
        self.edge, self.leaf = ([[math.log((counts.get((kind, a, str(b)), 0) + 0.5) / (sum(counts.get((kind, a, str(k)), 0) for k in range(3)) + 1.5)) for b in range(3)] for a in range(3)] for kind in ("edge", "leaf"))
        self.edge_p, self.leaf_p = ([[math.exp(x) for x in row] for row in rows] for rows in (self.edge, self.leaf))
        self.cache: dict[tuple, tuple[float, float, float]] = {}

    def node(self, seen: tuple) -> tuple[float, float, float]:
        p = self.cache.get(seen)
        if p is None:
            logs = [sum(self.seen[v][s] for v in seen if v in self.seen) for s in range(3)]
            top = max(logs)
            p = self.cache[seen] = tuple(math.exp(x - top) for x in logs)
        return p

    def marginals(self, tree: Tree) -> list[float]:
        """P(content) of each node: messages upward in reverse order, then downward."""
        n = len(tree.parent)
        own = [list(self.node(s)) for s in tree.seen]
        own[0] = [1.0, 1e-6, 1e-6]
        up: list = [None] * n
        for v in range(n - 1, 0, -1):
            a, b, c = own[v]
            e = self.edge_p if tree.text[v] is None else self.leaf_p
            m = [x[0] * a + x[1] * b + x[2] * c for x in e]
            t = max(m)
            up[v] = m = [x / t for x in m]
            p = own[tree.parent[v]]
            p[0] *= m[0]
            p[1] *= m[1]
            p[2] *= m[2]
            t = max(p)
            if t < 1e-100:
                p[:] = [x / t for x in p]
        belief = own
        out = [0.0] * n
        for v in range(1, n):
            p, m = belief[tree.parent[v]], up[v]
            without = [p[s] / m[s] if m[s] else 0.0 for s in range(3)]
            t = max(without) or 1.0
            e = self.edge_p if tree.text[v] is None else self.leaf_p
            b = belief[v]
            for s in range(3):
                b[s] *= (without[0] * e[0][s] + without[1] * e[1][s] + without[2] * e[2][s]) / t
            t = sum(b) or 1.0
            b[:] = [x / t for x in b]
            out[v] = b[CONTENT]
        return out

    def text(self, page: str) -> str:
        tree = parse(page)
        return "\n".join(t for t, p in zip(tree.text, self.marginals(tree)) if t is not None and p >= 0.5)


def train(labelled: DataFrame) -> Model:
    """A model from labelled(html) with data-l marks. Collected: one row for each tag or sign seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for page in batch.column("html").to_pylist():
                found.update(evidence_counts(page or ""))
        rows = list(found.items())
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.int32()), pa.array([k[2] for k, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], ["kind", "state", "value", "n"])

    counts = labelled.select("html").mapInArrow(run, "kind string, state int, value string, n long").groupBy("kind", "state", "value").agg(F.sum("n").alias("n"))
    return Model({(r.kind, r.state, r.value): r.n for r in counts.collect()})


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages(page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw in blocks(batches, "html", as_bytes=False):
            texts = [model.text(page) if page else "" for page in raw]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = train(spark.createDataFrame([(p,) for p in labelled_pages()], "html string"))
    return extract(table(spark, sf_dir, "pages"), model)
