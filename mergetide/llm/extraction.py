"""Main text of web pages by a site style tree.

The DOMs of a host's distinct pages are merged into one tree, whose nodes are element paths (tags with class and id
names).  A node's presentation importance is the entropy of its child sequences over the pages; the
content importance of its own text is what its texts lack in repetition; the importance of a branch composes
both from the leaves up.  Branches of low importance are the site's own furniture and are cut out of every page.
Elements that HTML itself marks as furniture (menus, headers, footers, asides, forms, scripts, adverts,
comments) go on any page, also of hosts with few pages.  What only a class or id names so stays if it holds the
article or most of the text, and a page with sentences never comes out empty by names alone; one of nothing but furniture does.  A page's mark of its article is a prior: only what is
marked is kept if one marked part holds at least as much text as all that isn't marked; else both stay, as the marks may be
teasers.  In an article each text is a leaf of the tree of its own: what most of a host's pages repeat goes, unless
that is more than half of a page's article, since a host may repeat an article.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, small, stage

#: Share of the text above which a branch stays, by whether one of its names is furniture in part (1) or as a whole (2).
SHARE = {1: 0.5, 2: 0.9}
#: Weight of what lies below a node, importance below which a branch goes, distinct pages that a host needs.
GAMMA, THRESHOLD, MIN_PAGES = 0.9, 0.2, 10

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORDS = re.compile(r"[a-z]+")
STOP = re.compile(r"[.!?…。]")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

# Kinds of elements of HTML, and names of page furniture.
RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set(
    "address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav object ol optgroup option p pre "
    "section select summary svg table tbody td tfoot th thead tr ul video audio canvas".split()
)
FURNITURE = set("head nav footer aside form button select option dialog menu svg object video audio canvas header".split())
ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
NAMES = set(
    "ad ads advert adverts advertisement advertising adsense adsbygoogle sponsor sponsored sponsors promo promoted promotion banner "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead footer sidebar aside widget widgets related recommended "
    "share sharing social comment comments respond disqus reply replies cookie cookies consent gdpr notice newsletter subscribe "
    "subscription signup login popup modal overlay pagination pager toolbar copyright legal disclaimer".split()
)
ARTICLE = {"article", "main"}
PARAGRAPHS = set("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption".split())
#: What a start tag closes, and what the search for it doesn't leave.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


def prose(s: str) -> bool:
    """Whether a text has at least six words and a sentence's end."""
    return bool(STOP.search(s)) and len(s.split(None, 6)) >= 6


def text_hash(s: str) -> int:
    return xxhash.xxh64_intdigest(s) - (1 << 63)


class Page:
    """The elements of a page in order, each with its parent, and its text blocks."""

    def __init__(self, source: str):
        self.parent, self.tag, self.key, self.noise, self.inside = [-1], ["#root"], [0], [False], [0]  # inside: the outermost marked element
        self.named = [0]  # as in SHARE
        self.children: list[list[int]] = [[]]
        self.blocks: list[list[tuple[int, str]]] = []  # each a run of texts, and the elements they stand in
        self.open: dict[str, int] = defaultdict(int)  # elements of each tag on the stack
        self._parse(source)
        self.unnamed = self.noise
        if any(self.named):
            self.noise = self._cut_names()

    def _push(self, stack: list[int], tag: str, attributes: str) -> None:
        up = stack[-1]
        names, role, hidden = "", "", False
        if attributes:
            for name, a, b, c in ATTRIBUTE.findall(attributes):
                name, value = name.lower(), a or b or c
                if name in ("class", "id"):
                    names += f" {value}"
                elif name == "role":
                    role = value.strip().lower()
                elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                    hidden = True
        words = set(WORDS.findall(CAMEL.sub(" ", names).lower())) if names else set()
        main = tag in ARTICLE or role == "main"
        inside = self.inside[up]
        bad = hidden or role in ROLES or tag in FURNITURE
        named = 0
        if words & NAMES and tag not in ("html", "body", "main"):
            named = 2 if any((own := set(WORDS.findall(CAMEL.sub(" ", x).lower()))) and own <= NAMES for x in names.split()) else 1
        if inside and not hidden and (tag == "header" or words & NAMES == {"header"} and tag not in FURNITURE) and role not in ROLES:
            bad, named = False, 0  # an article's own heading
        self.parent.append(up)
        self.tag.append(tag)
        self.noise.append(self.noise[up] or bad)
        self.named.append(named)
        self.inside.append(inside or (len(self.tag) - 1 if main and not self.noise[-1] else 0))
        self.key.append(xxhash.xxh64_intdigest(f"{self.key[up]}/{tag}/{' '.join(sorted(words))}") - (1 << 63))
        self.children.append([])
        self.children[up].append(len(self.tag) - 1)
        stack.append(len(self.tag) - 1)
        self.open[tag] += 1

    def _close(self, stack: list[int], tags: set, within: set = frozenset()) -> None:
        if not any(self.open[t] for t in tags):
            return
        for i in range(len(stack) - 1, 0, -1):
            if self.tag[stack[i]] in tags:
                for j in stack[i:]:
                    self.open[self.tag[j]] -= 1
                del stack[i:]
                return
            if self.tag[stack[i]] in within:
                return

    def _parse(self, source: str) -> None:
        stack, block, at, inline = [0], None, 0, 0
        while at < len(source):
            m = TOKEN.search(source, at)
            text = source[at : m.start() if m else len(source)]
            if text:
                if block is None:
                    self.blocks.append(block := [])
                block.append((stack[-1], html.unescape(text) if "&" in text else text))
            if not m:
                break
            at = m.end()
            tag = m[2] or m[5]
            if not tag:
                continue
            tag, end, attributes = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
            structural = tag in BLOCK or "-" in tag
            if end:
                if structural or tag in ARTICLE:
                    self._close(stack, {tag})
                    block = None
                elif inline and self.open[tag]:
                    self._close(stack, {tag})
                    inline -= 1
            elif tag in RAW:
                close = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(source, at)
                at = close.end() if close else len(source)
            elif tag in VOID:
                if tag == "hr":
                    block = None
                elif tag == "br" and block is not None:
                    block.append((stack[-1], " "))
            elif structural:
                if tag != "head" and self.tag[stack[-1]] == "head":
                    self._close(stack, {"head"})
                if tag in CLOSES:
                    self._close(stack, *CLOSES[tag])
                if tag not in ("button", "svg", "select", "option", "object", "canvas", "audio", "video"):
                    self._close(stack, {"p"}, {"button", "object", "td", "th", "table"})
                self._push(stack, tag, attributes)
                block = None
            elif attributes:
                n = len(self.tag)
                self._push(stack, tag, attributes)
                if (self.noise[n] or self.named[n]) and not self.noise[stack[-2]]:
                    inline += 1
                else:  # inline elements that mark nothing are no nodes
                    self.open[tag] -= 1
                    stack.pop()
                    self.children[self.parent[n]].pop()
                    for x in (self.parent, self.tag, self.noise, self.named, self.inside, self.key, self.children):
                        x.pop()

    def _cut_names(self) -> list[bool]:
        """``noise`` with the branches that names call furniture, but those that hold the article or more than their SHARE of the text, in sentences."""
        held, whole, told = [0] * len(self.tag), [False] * len(self.tag), [False] * len(self.tag)
        for parts in self.blocks:
            for i, x in parts:
                if not self.noise[i]:
                    held[i] += len(x.strip())
            told[parts[0][0]] |= prose("".join(x for _, x in parts))
        for i in range(len(held) - 1, 0, -1):
            held[self.parent[i]] += held[i]
            told[self.parent[i]] |= told[i]
        for i in range(1, len(whole)):
            whole[i] = whole[self.parent[i]] or self.named[i] == 2
        marked = [i for i in range(1, len(held)) if self.inside[i] == i and held[i] and (not whole[i] or 2 * held[i] > held[0])]
        article = max(marked, key=lambda i: (not whole[i], held[i]), default=0)
        holds, i = set(), article
        while i > 0:
            holds.add(i)
            i = self.parent[i]
        noise = list(self.noise)
        for i in range(1, len(noise)):
            noise[i] = noise[i] or noise[self.parent[i]]
            if (n := self.named[i]) and i not in holds:
                if article and self.inside[i] == article:
                    noise[i] |= held[i] <= SHARE[n] * held[article]
                else:
                    noise[i] |= n == 2 and (bool(article) or not told[i]) or held[i] <= SHARE[n] * held[0]
        return noise

    def text(self, furniture: set[int] | frozenset = frozenset(), repeated: set[tuple[int, int]] | frozenset = frozenset(), names: bool = True) -> str:
        """The main text; ``furniture``: keys of branches that the host's style tree cuts; ``repeated``: (key, hash) of texts in articles that it cuts."""
        cut = list(self.noise if names else self.unnamed)
        for i in range(1, len(cut)):
            cut[i] = cut[i] or cut[self.parent[i]] or self.key[i] in furniture and self.cuttable(i)
        blocks = []
        for parts in self.blocks:
            left = [(i, x) for i, x in parts if not cut[i]]
            if left and (s := " ".join("".join(x for _, x in left).split())):
                blocks.append((self.inside[left[0][0]], left[0][0], s))
        if repeated:
            again = {k for k, (inside, i, s) in enumerate(blocks) if inside and (self.key[i], text_hash(s)) in repeated}
            if 2 * sum(len(blocks[k][2]) for k in again) <= sum(len(s) for inside, _, s in blocks if inside):
                blocks = [x for k, x in enumerate(blocks) if k not in again]
        held = defaultdict(int)  # characters by marked element; 0: not marked
        for inside, _, s in blocks:
            held[inside] += len(s)
        if max((n for inside, n in held.items() if inside), default=-1) >= held[0]:
            blocks = [x for x in blocks if x[0]]
        if not blocks and furniture:
            return self.text()
        if not blocks and names and self.noise is not self.unnamed:
            whole = self.text(names=False)  # a page of nothing but furniture holds no sentences
            return whole if any(prose(x) for x in whole.split("\n\n")) else ""
        return "\n\n".join(s for _, _, s in blocks)

    def cuttable(self, i: int) -> bool:
        return self.tag[i] not in ("html", "body") and self.tag[i] not in ARTICLE and not (self.inside[i] and self.tag[i] in PARAGRAPHS)

    def features(self) -> Iterator[tuple[int, int, int, int, int]]:
        """(path, parent's path, kind, value, count): kind 0 a node's style, 1 the hash of a text of its own, 2 of one in an article."""
        own = defaultdict(int)
        for i in range(1, len(self.tag)):
            style = xxhash.xxh64(",".join(self.tag[c] for j, c in enumerate(self.children[i]) if not j or self.tag[c] != self.tag[self.children[i][j - 1]])).intdigest()
            own[self.key[i], self.key[self.parent[i]], 0, style - (1 << 63)] += 1
        for parts in self.blocks:
            left = [(i, x) for i, x in parts if not self.noise[i]] or parts
            i = left[0][0]
            if i and (s := " ".join("".join(x for _, x in left).split())):
                own[self.key[i], self.key[self.parent[i]], 2 if self.inside[i] and not self.noise[i] else 1, text_hash(s)] += 1
        return ((*k, n) for k, n in own.items())


def host(url: Column) -> Column:
    """The host of an address in lower case; empty for null and for what has none."""
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit(""))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("host", pa.string()), *((x, pa.int64()) for x in ("path", "up", "kind", "value", "n"))])
    for part in slices(batches):
        rows = [(h, *x) for h, s in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for x in Page(s).features()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _importance(nodes: pd.DataFrame) -> pd.DataFrame:
    """One row: the paths of a host's style tree whose branches go, from a row for each path."""
    rows = {r.path: r for r in nodes.itertuples()}
    below = defaultdict(list)
    for r in rows.values():
        below[r.up].append(r.path)
    value: dict[int, float] = {}
    order, todo = [], [p for p, r in rows.items() if r.up not in rows]
    while todo:
        order.append(p := todo.pop())
        todo += below[p]
    for p in reversed(order):
        r = rows[p]
        parts = [(rows[c].m, value[c]) for c in below[p]] + ([(r.texts, r.content)] if r.texts else [])
        inner = sum(n * x for n, x in parts) / sum(n for n, _ in parts) if parts else None
        if inner is None:
            value[p] = r.entropy
        else:
            weight = GAMMA**r.styles
            value[p] = (1 - weight) * r.entropy + weight * inner
    gone = [p for p in order if rows[p].pages >= MIN_PAGES and value[p] < THRESHOLD]
    return pd.DataFrame({"host": [nodes["host"].iloc[0]], "paths": [gone]})


def style_values(pages: DataFrame) -> DataFrame:
    """``pages``: host, html (distinct) -> host, path, up, kind, value, n, on: how often a style or text is at a path, and on how many pages."""
    seen = pages.mapInArrow(_features, "host string, path long, up long, kind long, value long, n long")
    return seen.groupBy("host", "path", "up", "kind", "value").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("on"))


def style_tree(values: DataFrame) -> DataFrame:
    """``values``: of :func:`style_values` -> host, path, up, m, styles, entropy, texts, content, pages: a row for each path of each host.

    ``pages``: how many pages have the path's most common style, so at least as many have the path.
    """
    style, text = F.col("kind") == 0, F.col("kind") > 0
    xlogx = lambda c: F.col(c) * F.log(F.col(c))
    nodes = values.groupBy("host", "path", "up").agg(
        F.sum(F.when(style, F.col("n"))).alias("m"), F.count(F.when(style, 1)).alias("styles"), F.sum(F.when(style, xlogx("n"))).alias("e"),
        F.coalesce(F.sum(F.when(text, F.col("n"))), F.lit(0)).alias("texts"), F.sum(F.when(text, F.col("n") * F.log("on"))).alias("c"), F.max(F.when(style, F.col("on"))).alias("pages"),
    )
    log_m = F.log(F.col("m").cast("double"))
    entropy = F.when(F.col("m") > 1, (log_m - F.col("e") / F.col("m")) / log_m).otherwise(1.0)
    content = F.when(F.col("m") > 1, F.greatest(F.lit(0.0), 1 - F.col("c") / F.col("texts") / log_m)).otherwise(1.0)
    return nodes.select("host", "path", "up", "m", "styles", entropy.alias("entropy"), "texts", F.coalesce(content, F.lit(1.0)).alias("content"), "pages")


def furniture(pages: DataFrame) -> DataFrame:
    """``pages``: page_id, host, html -> host, paths (an array) of the branches to cut, texts (an array of path, value) to cut in articles."""
    keyed = pages.select("page_id", "host", F.xxhash64("html").alias("h")).where("host <> ''")
    distinct = stage(keyed.groupBy("host", "h").agg(F.min("page_id").alias("low"), F.count(F.lit(1)).alias("n")), "copies")
    hosts = stage(distinct.groupBy("host").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("pages")).where(F.col("n") >= MIN_PAGES).select("host", "pages"), "hosts")
    once = pages.withColumn("h", F.xxhash64("html")).join(small(hosts.select("host")), "host", "left_semi")
    once = once.join(small(distinct.where("n > 1").select("host", "h", "low")), ["host", "h"], "left").where(F.col("low").isNull() | (F.col("low") == F.col("page_id")))
    values = stage(style_values(once.select("host", "html")), "values")
    tree = stage(style_tree(values), "tree")
    branches = tree.groupBy("host").applyInPandas(_importance, "host string, paths array<long>").where(F.size("paths") > 0)
    often = values.where((F.col("kind") == 2) & (F.col("on") >= MIN_PAGES)).join(small(hosts), "host")
    often = often.where(F.log("on") > (1 - THRESHOLD) * F.log("pages"))  # the importance of a text as a leaf is 1 - log(on) / log(pages)
    often = often.groupBy("host").agg(F.collect_list(F.struct("path", "value")).alias("texts"))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    both = branches.select("host", "paths", none("struct<path: long, value: long>").alias("texts")).unionByName(often.select("host", none("long").alias("paths"), "texts"))
    return both.groupBy("host").agg(F.flatten(F.collect_list("paths")).alias("paths"), F.flatten(F.collect_list("texts")).alias("texts"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: the main text of each row of ``pages`` (page_id, url, html).

    A null, empty or textless html gives an empty text.  Pages without a host, and hosts with fewer than
    ``MIN_PAGES`` pages, are not cut by style tree.  Copies within a host count once for its tree.  Broken
    markup is read like a browser would, as far as blocks are concerned.  An empty table gives an empty table.
    """
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), host(pages["url"]).alias("host"), F.coalesce(pages["html"].cast("string"), F.lit("")).alias("html"))
    cuts = stage(furniture(rows), "furniture")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for part in slices(batches):
            texts = []
            for name, source, paths, often in zip(*(part.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True):
                if name not in known:
                    cut = frozenset(paths or ()), frozenset((x["path"], x["value"]) for x in often or ())
                    known = {name: cut} if len(known) > 1000 else known | {name: cut}
                texts.append(Page(source).text(*known[name]))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    out = rows.join(small(cuts, weight=1 + F.size("paths") + 2 * F.size("texts")), "host", "left").select("page_id", "url", "host", "html", "paths", "texts").mapInArrow(read, "page_id long, url string, text string")
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
