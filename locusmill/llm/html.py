"""Main text of web pages by site style trees.

The pages of a host are merged into one tree. An element's children, as a sequence of tags and classes, are a style of it; an element node is told by its
parent, the parent's style, its place in it, and its own tag and class. So pages share a node only if they are laid out alike down to it. How
important a node is:

* presentation of an inner node: normalised entropy of its styles over the pages that have it;
* content of a leaf: 1 less the mean, over the features (sentences) it has on any page, of log(pages with the feature) / log(pages with the node);
* an inner node of l styles: (1 - 0.9^l) of its presentation and 0.9^l of the mean importance of its children, over pages and children.

A node is noise if it and everything below it are of low importance; the highest such nodes are removed from each page, with all that is below them.
Menus, headers and notices that a template repeats are found so; what differs from page to page, or stands on few pages, isn't. Therefore elements that
HTML or their class says are no part of an article go by rule, and where a page marks an article only that is kept.
"""

from __future__ import annotations

import functools
import html as entities
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusmill.llm._tables import dropped, small, written
from locusmill.llm._words import lean, pieces

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|[^<]++|<", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
WORDS = re.compile(r"[A-Za-z][a-z]*")

#: Elements of HTML by what they do.
RAW = frozenset("script style iframe textarea title xmp noembed noframes".split())
UNSHOWN = frozenset("template noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr svg g path text tspan math mi mn mo mrow msup msub mfrac msqrt mtext semantics annotation object".split())
NO_ARTICLE = frozenset("nav footer aside form button select option input fieldset dialog menu head audio video canvas map".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME_CLOSE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "p": ("p",)}
SCOPE = frozenset("html body article section div main ul ol dl table td th blockquote aside nav footer header form".split())
#: Words in class, id or role that name what is no part of an article.
NO_ARTICLE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead "
    "cookie cookies consent notice gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget comment comments "
    "disqus reply replies respond discussion pagination pager toolbar copyright disclaimer search skip contentinfo complementary hidden form".split()
)
HEADER_WORDS = frozenset(["header", "topbar"])

LEAST_PAGES = 4  # different pages that must have a node before it can be noise
PASSAGE = 20  # words of a block that tells stories apart by itself
LOW = 0.25
GAMMA = 0.9
DEPTH = 64  # elements nested deeper belong to the one at this depth
SENTENCE = re.compile(r"(?<=[.!?…。！？])\s+")


def host_of(url: Column) -> Column:
    """The URL's host in lower case; empty where there's none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def _host_key(url: Column) -> Column:
    """Digest of the host; null where there's none."""
    return F.when(host_of(url) != "", F.xxhash64(host_of(url)))


def _named(attributes: str) -> tuple[str, set[str], bool]:
    """Class for the path (digits left out, so that numbered ones meet), words of class, id and role, and whether the element is hidden."""
    cls, said, hidden = "", set(), False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
            hidden = True
        elif name in ("class", "id", "role"):
            said.update(w.lower() for w in WORDS.findall(value))
            if name == "class":
                cls = re.sub(r"\d+", "", " ".join(sorted(value.split())))
    return cls, said, hidden


class Page:
    """A page's element nodes and its blocks of text in order.

    parent, label, children: of each element; element 0 is the page itself, children are numbers of elements or, below 0, -1 - number of a block.
    blocks: element, text, whether it stands in an article, whether HTML or a class rules it out. References are decoded, white
    space is one space; blocks without text are left out. Unclosed elements end with what encloses them."""

    def __init__(self, page: str):
        self.parent, self.label, self.children = [-1], [""], [[]]
        self.blocks: list[tuple[int, str, bool, bool]] = []
        self._read(page)

    def _read(self, page: str) -> None:
        stack: list[tuple[str, int, bool, bool, int]] = []  # tag, element, in article, ruled out, depth
        opened: dict[str, int] = defaultdict(int)  # open elements of each tag
        here, article, out, depth = 0, False, False, 0
        text: list[str] = []

        def flush() -> None:
            if text:
                joined = "".join(text)
                if "&" in joined:
                    joined = entities.unescape(joined)
                joined = " ".join(joined.split())
                if joined:
                    self.children[here].append(-1 - len(self.blocks))
                    self.blocks.append((here, joined, article, out))
                text.clear()

        def set_top() -> None:
            nonlocal here, article, out, depth
            _, here, article, out, depth = stack[-1] if stack else ("", 0, False, False, 0)

        def pop_to(d: int) -> None:
            if any(s[0] not in INLINE for s in stack[d:]) or out and not (stack[d - 1][3] if d else False):
                flush()
            for s in stack[d:]:
                opened[s[0]] -= 1
            del stack[d:]
            set_top()

        def push(tag: str, element: bool, label: str, inside: bool, rules_out: bool) -> None:
            if element and depth < DEPTH:
                self.children[here].append(len(self.parent))
                self.parent.append(here)
                self.label.append(label)
                self.children.append([])
                stack.append((tag, len(self.parent) - 1, inside, rules_out, depth + 1))
            else:
                stack.append((tag, here, inside, rules_out, depth))
            opened[tag] += 1
            set_top()

        at, n = 0, len(page)
        while at < n:
            m = TOKEN.match(page, at)
            at = m.end()
            said = m[0]
            if said[0] != "<" or said == "<":
                text.append(said)
                continue
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            if m[1] or m[4]:
                if opened[tag] > 0:
                    for d in range(len(stack) - 1, -1, -1):
                        if stack[d][0] == tag:
                            pop_to(d)
                            break
                        if tag in INLINE and stack[d][0] in SCOPE:
                            break
                elif tag == "p":
                    flush()
                continue
            attributes = m[3] if m[2] else m[6] or ""
            if tag in RAW or tag in UNSHOWN:
                end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
                if tag in UNSHOWN and not end:  # never closed: what follows isn't part of it
                    continue
                if tag not in ("script", "style", "noscript", "template"):
                    flush()
                if not attributes.rstrip().endswith("/") or tag in ("script", "style", "title", "textarea"):
                    at = end.end() if end else n
                continue
            if tag in VOID:
                if tag == "br":
                    text.append(" ")
                elif tag not in INLINE:
                    flush()
                continue
            if tag in CLOSES_P and opened["p"] > 0:
                for d in range(len(stack) - 1, -1, -1):
                    if stack[d][0] == "p":
                        pop_to(d)
                        break
                    if stack[d][0] in SCOPE:
                        break
            if tag in SAME_CLOSE and tag != "p" and any(opened[x] > 0 for x in SAME_CLOSE[tag]):
                for d in range(len(stack) - 1, -1, -1):
                    if stack[d][0] in SAME_CLOSE[tag]:
                        pop_to(d)
                        break
                    if stack[d][0] in ("ul", "ol", "dl", "table", "select"):
                        break
            cls, names, hidden = _named(attributes) if attributes and not attributes.isspace() else ("", set(), False)
            rules_out = out or hidden or tag in NO_ARTICLE or bool(names & NO_ARTICLE_WORDS) and tag not in ("html", "body", "article", "main")
            inside = article or tag in ("article", "main") or "main" in names and tag == "div"
            if (tag == "header" or names & HEADER_WORDS) and not inside:
                rules_out = True
            if tag == "article" and names & NO_ARTICLE_WORDS:
                rules_out = True
            label = f"{tag}.{cls}" if cls else tag
            if tag in INLINE:
                if rules_out and not out:  # an inline element that is ruled out stands for itself
                    flush()
                    push(tag, True, label, inside, True)
                else:
                    push(tag, False, "", article, out)
                continue
            flush()
            push(tag, True, label, inside, rules_out)
        flush()

    def keys(self, host: int) -> tuple[list[int], list[int], list[int], list[int]]:
        """Key and style of each element, how many children its parent has, and the key of each block's node: the element, where the block is all that it
        has, else a text node of its own."""
        key, style, beside, leaf = [0] * len(self.parent), [0] * len(self.parent), [1] * len(self.parent), [0] * len(self.blocks)
        key[0] = host
        for e, kids in enumerate(self.children):  # parents come before their children
            if len(kids) == 1 and kids[0] < 0:
                leaf[-1 - kids[0]] = key[e]
                continue
            style[e] = _digest("|".join([self.label[c] if c >= 0 else "#" for c in kids]))
            for place, c in enumerate(kids):
                k = _digest(f"{key[e]} {style[e]} {place} {self.label[c] if c >= 0 else '#'}")
                if c >= 0:
                    key[c], beside[c] = k, len(kids)
                else:
                    leaf[-1 - c] = k
        return key, style, beside, leaf

    def story(self) -> int:
        """Digest of what makes a page a different one: of the blocks that aren't ruled out those in a marked article, if they have at least half of
        the words; of these the ones of at least PASSAGE words, if there are any."""
        own = [(article, text, len(text.split())) for _, text, article, out in self.blocks if not out]
        marked = [x for x in own if x[0]]
        if 2 * sum(n for _, _, n in marked) >= sum(n for _, _, n in own):
            own = marked
        return _digest("\n".join([t for _, t, n in own if n >= PASSAGE] or [t for _, t, _ in own]))

    def text(self, noise=None, host: int | None = None) -> str:
        """Text of the blocks that are neither ruled out nor at or below a node of `noise` (sorted keys); where an article is marked, of its blocks only."""
        gone = np.zeros(len(self.blocks), bool)
        if host is not None and noise is not None and len(noise):
            key, _, _, leaf = self.keys(host)
            low = _among(np.array(key, np.int64), noise)
            for e, p in enumerate(self.parent):
                low[e] |= p >= 0 and low[p]
            gone = _among(np.array(leaf, np.int64), noise) | low[[b[0] for b in self.blocks]] if self.blocks else gone
        keep = [(article, text) for (_, text, article, out), g in zip(self.blocks, gone) if not out and not g]
        if any(a for a, _ in keep):
            keep = [x for x in keep if x[0]]
        return " ".join(t for _, t in keep)


def _among(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[np.minimum(np.searchsorted(table, keys), len(table) - 1)] == keys


@functools.lru_cache(1 << 14)
def _digest(x: str) -> int:
    return xxhash.xxh64_intdigest(x) - (1 << 63)


NODE = "key long, host long, parent long, depth int, beside int, kind int, x long, w double"


def _node_rows(page: Page, host: int, weight: float, out: list[tuple]) -> None:
    """Adds rows of NODE: one for each node with its style (kind 0), one for each feature of a leaf (kind 1)."""
    key, style, beside, leaf = page.keys(host)
    depth = [0] * len(key)
    holds = set(leaf)
    for e, p in enumerate(page.parent):
        depth[e] = depth[p] + 1 if p >= 0 else 0
        out.append((key[e], host, key[p] if p >= 0 else None, depth[e], beside[e], 0, 0 if key[e] in holds else style[e], weight))
    for (e, text, _, _), k in zip(page.blocks, leaf):
        if k != key[e]:
            out.append((k, host, key[e], depth[e] + 1, len(page.children[e]), 0, 0, weight))
        for f in {_digest(s) for s in SENTENCE.split(text)}:
            out.append((k, host, None, None, None, 1, f, weight))


UNITS = 1e9  # sums of importance are whole numbers of this part of one, so that no order of adding them changes the result


def composed(nodes: list[tuple], rest: dict[int, int]) -> dict[int, tuple[float, bool]]:
    """key -> (importance, whether it is low, so is everything below, and there is any text) of one host's nodes.

    nodes, deepest first: key, parent, children of the parent, pages, part of the children (0.9^styles), presentation, content (None for inner nodes); rest: for
    each parent the sum (in UNITS) of pages over children of its children that few pages have, which count as important. by_levels() says the same."""
    below, high, holds, out = dict(rest), set(rest), set(rest), {}
    for key, parent, beside, pages, part, presentation, content in nodes:
        importance = content if content is not None else (1 - part) * presentation + part * (below.get(key, 0) / UNITS) / pages
        importance = math.floor(importance * UNITS + 0.5) / UNITS
        low, any_text = importance < LOW and key not in high, content is not None or key in holds
        out[key] = importance, low and any_text
        if parent is not None:
            below[parent] = below.get(parent, 0) + math.floor(pages * importance / beside * UNITS + 0.5)
            if not low:
                high.add(parent)
            if any_text:
                holds.add(parent)
    return out


def _units(x: Column) -> Column:
    return F.floor(x * F.lit(UNITS) + F.lit(0.5))


def by_levels(kept: DataFrame) -> DataFrame:
    """composed() of hosts of any size: columns of TREE. One level of depth after the other, the deepest first, each a join with the sums of the one below."""
    own = [F.max(c).alias(c) for c in ("host", "parent", "depth", "beside", "pages", "styles", "part", "presentation", "content")]
    nodes = written(kept.groupBy("key").agg(*own, F.sum("rest").alias("rest"), F.max("own").alias("own")).where("own").drop("own"), "site-levels")
    deepest = nodes.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    levels: list[DataFrame] = []
    for depth in range(deepest, -1, -1):
        rows = nodes.where(F.col("depth") == depth)
        if levels:
            given = levels[-1].groupBy("parent").agg(F.sum("gives").alias("__below"), F.max(~F.col("low")).alias("__high"), F.max("any_text").alias("__holds")).withColumnRenamed("parent", "__parent")
            rows = rows.join(given, F.col("key") == F.col("__parent"), "left")
        else:
            rows = rows.withColumns({"__below": F.lit(0).cast("long"), "__high": F.lit(False), "__holds": F.lit(False)})
        few = F.col("rest").isNotNull()
        below = F.coalesce("__below", F.lit(0)) + F.coalesce("rest", F.lit(0))
        inner = (1 - F.col("part")) * F.col("presentation") + F.col("part") * (below / F.lit(UNITS)) / F.col("pages")
        rows = rows.withColumn("importance", _units(F.coalesce("content", inner)) / F.lit(UNITS))
        rows = rows.withColumn("low", (F.col("importance") < LOW) & ~few & ~F.coalesce("__high", F.lit(False))).withColumn("any_text", F.col("content").isNotNull() | few | F.coalesce("__holds", F.lit(False)))
        rows = rows.withColumn("gives", _units(F.col("pages") * F.col("importance") / F.col("beside")))
        levels.append(written(rows.select("host", "key", "parent", "depth", "pages", "styles", "importance", "low", "any_text", "gives"), "site-level"))
    every = functools.reduce(DataFrame.union, levels)
    gone = F.col("low") & F.col("any_text")
    above = every.where(gone).select(F.col("key").alias("__above"))
    out = every.join(above, F.col("parent") == F.col("__above"), "left")
    out = written(out.select("host", "key", "parent", "depth", "pages", "styles", "importance", (gone & F.col("__above").isNull()).alias("noise")), "site-composed")
    dropped(nodes, *levels)
    return out


def site_tree(pages: DataFrame, url: str = "url", html: str = "html", most: int = 200_000) -> DataFrame:
    """The hosts' style trees: host and key (digests), parent, depth, pages, styles, importance, noise (whether it is to be removed from pages).

    Nodes that at least LEAST_PAGES different pages of a host have. Pages of a host with one story count once, whatever navigation, adverts and footers they
    have: a story that copies repeat weighs as much as one that stands alone. Pages without a host are in no tree. Counts
    are pre-aggregated, also of hosts with very many pages. Importance is composed in one task for each host of up to `most` nodes, and level by level
    over all tasks for larger ones, with the same results: both add whole numbers up, and round alike."""
    value = pages[html].cast("string")
    src = pages.select(_host_key(pages[url]).alias("host"), F.xxhash64(value).alias("dg"), value.alias("html")).where("host IS NOT NULL AND html IS NOT NULL")

    def stories(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "html"):
                found = [Page(x).story() for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("host"), pa.array(found, pa.int64()), part.column("dg")], names=["host", "story", "dg"])

    one = src.mapInArrow(lean(stories), "host long, story long, dg long").groupBy("host", "story", "dg").agg(F.count(F.lit(1)).alias("n"))
    one = written(one.groupBy("host", "story").agg(F.min("dg").alias("__dg"), F.min_by("n", "dg").alias("n")).select(F.col("host").alias("__host"), "__dg", "n"), "stories")
    # rows that repeat a page exactly weigh one together
    chosen = src.join(small(one), (F.col("host") == F.col("__host")) & (F.col("dg") == F.col("__dg"))).select("host", (1 / F.col("n")).alias("w"), "html")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.float64())
        for batch in batches:
            for part in pieces(batch, "html"):
                out: list[tuple] = []
                for host, w, page in zip(*(part.column(c).to_pylist() for c in ("host", "w", "html"))):
                    _node_rows(Page(page), host, w, out)
                yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(zip(*out), kinds)], names=["key", "host", "parent", "depth", "beside", "kind", "x", "w"])

    fixed = [F.min(c).alias(c) for c in ("host", "parent", "depth", "beside")]  # of a key they are always the same
    counts = chosen.mapInArrow(lean(rows), NODE).groupBy("key", "kind", "x").agg(F.round(F.sum("w")).alias("c"), *fixed)
    style, feature = F.col("kind") == 0, F.col("kind") == 1
    nodes = counts.groupBy("key").agg(
        F.sum(F.when(style, F.col("c"))).alias("pages"), F.count_if(style).alias("styles"), F.sum(F.when(style, F.col("c") * F.log("c"))).alias("spread"),
        F.count_if(feature).alias("features"), F.sum(F.when(feature, F.log("c"))).alias("shared"), *fixed,
    )
    own = F.col("pages") >= LEAST_PAGES
    kept = nodes.groupBy(F.when(own, F.col("key")).otherwise(F.col("parent")).alias("key"), own.alias("own")).agg(
        F.sum(F.when(~own, _units(F.col("pages") / F.col("beside")))).alias("rest"), *[F.min(F.when(own, F.col(c))).alias(c) for c in ("pages", "styles", "spread", "features", "shared", "parent", "depth", "beside")], F.min("host").alias("host"),
    )
    log_pages = F.log("pages")
    presentation, content = 1 - F.col("spread") / (F.col("pages") * log_pages), F.when(F.col("features") > 0, 1 - F.col("shared") / (F.col("features") * log_pages))
    kept = written(kept.where("key IS NOT NULL").select("host", "key", "own", "rest", "parent", "depth", "beside", "pages", "styles", F.pow(F.lit(GAMMA), "styles").alias("part"), presentation.alias("presentation"), content.alias("content")), "site-nodes")
    dropped(one)
    sizes = written(kept.groupBy(F.col("host").alias("__host")).agg(F.count(F.lit(1)).alias("__n")), "hosts")
    sized = kept.join(small(sizes), F.col("host") == F.col("__host"))

    def tree(key: tuple, t: pa.Table) -> pa.Table:
        got = [r for r in t.to_pylist() if r["own"]]
        got.sort(key=lambda r: (-r["depth"], r["key"]))
        rest = {r["key"]: r["rest"] for r in t.to_pylist() if not r["own"]}
        made = composed([(r["key"], r["parent"], r["beside"], r["pages"], r["part"], r["presentation"], r["content"]) for r in got], rest)
        noise = [made[r["key"]][1] and not (r["parent"] in made and made[r["parent"]][1]) for r in got]
        named = {c: [r[c] for r in got] for c in ("host", "key", "parent", "depth", "pages", "styles")}
        return pa.table({**named, "importance": [made[r["key"]][0] for r in got], "noise": noise}, schema=TREE)

    whole = sized.where(F.col("__n") <= most).drop("__host", "__n").groupBy("host").applyInArrow(tree, "host long, key long, parent long, depth int, pages double, styles long, importance double, noise boolean")
    if sizes.where(F.col("__n") > most).isEmpty():
        out = written(whole, "site-tree")
    else:
        large = by_levels(sized.where(F.col("__n") > most).drop("__host", "__n"))
        out = written(whole.union(large), "site-tree")
        dropped(large)
    dropped(kept, sizes)
    return out


TREE = pa.schema([("host", pa.int64()), ("key", pa.int64()), ("parent", pa.int64()), ("depth", pa.int32()), ("pages", pa.float64()), ("styles", pa.int64()), ("importance", pa.float64()), ("noise", pa.bool_())])


def main_text(page: str) -> str:
    """Text of a page by what HTML and classes say alone."""
    return Page(page).text()


def extract(pages: DataFrame, url: str = "url", html: str = "html", keep: list[str] | None = None, most_nodes: int = 1_000_000) -> DataFrame:
    """text (the page's article, blocks joined by one space) and n_chars (code points) beside the columns `keep`.

    One row for each input row, repeated ones too; an empty table gives none. A null or empty html gives an empty text. Noise of the host's style tree is
    removed from its pages. A page with a null or odd url, or of a host of fewer than LEAST_PAGES different pages, is judged by
    HTML and classes alone. Whole pages are read, however long or deep; nothing is cut. Nodes to remove go to all tasks as one sorted array if they
    are at most `most_nodes` (8 bytes each), else to pages by their host in a join. Input columns named text or n_chars give way to the results.
    """
    keep = [c for c in (["page_id", "url"] if keep is None else keep) if c not in ("text", "n_chars")]
    tree = site_tree(pages, url, html)
    noise = written(tree.where("noise").select("host", "key"), "noise")
    dropped(tree)
    src = pages.select(*[pages[c] for c in keep], pages[html].cast("string").alias("__html"), _host_key(pages[url]).alias("__host"))
    shared = None
    if noise.count() <= most_nodes:
        found = noise.select("key").toArrow().column("key").to_numpy()
        shared = pages.sparkSession.sparkContext.broadcast(np.unique(found))
        src = src.withColumn("__noise", F.lit(None).cast("array<long>"))
        dropped(noise)
    else:
        per = noise.groupBy(F.col("host").alias("__h")).agg(F.sort_array(F.collect_list("key")).alias("__noise"))
        src = src.join(per, F.col("__host") == F.col("__h"), "left").drop("__h")
    schema = src.select(*keep, F.lit("").cast("string").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "__html"):
                texts = []
                for page, host, noise in zip(*(part.column(c).to_pylist() for c in ("__html", "__host", "__noise"))):
                    texts.append(Page(page or "").text(shared.value if shared else np.array(noise or [], np.int64), host))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], np.int64))], names=[*names, "text", "n_chars"])

    return src.select(*names, "__html", "__host", "__noise").mapInArrow(lean(run), schema)
