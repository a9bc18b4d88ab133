"""HTML extraction by site style trees.

Every page is read once into its blocks, runs of text, and the elements above them. Pages of a host merge into one
style tree, whose nodes are paths of elements (tag, class and id of each, without positions). A node's presentation
importance is the entropy of the styles of its children among the pages that have it, its content importance the
entropy of the texts below it, both to the base of the number of pages, so 1 says that every page differs and 0 that all
are alike; its importance is the greater of both. A page loses a branch if all of it is of low importance: a block goes
if the nearest element above it that `LEAST_PAGES` pages of the host have falls below `LEAST_IMPORTANCE`, so what is
important inside an unimportant branch stays.

The tree says nothing of paths that fewer pages of a host have, and what differs from page to page may still not belong to
the article (related links, adverts, readers' comments): elements whose name, role, class or id says so are removed
as branches on every page. A class or id says so if each of its words is such a word or merely says where something is or
what it holds (`PLAIN_WORDS`). If a page has an article or main element with text left, blocks outside all of them go.

Counts are combined before the shuffle, so a host with a third of all pages is summed by many tasks. Only hosts that have
low paths matter further. If their judged paths are few, counted first, each page gets those of its host by a broadcast and no page is
shuffled; otherwise they meet the paths of their pages as rows, in a join that Spark can split, and a page gets back
those of its own. Work is in proportion to a page's length, however deep its elements are.

Null, empty and text-free pages give empty text. Very long pages are read whole. Empty tables give no rows. Repeated rows
give repeated results, and copies of a page count once in the tree; pages without a host count as one host. Further
input columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialise

LEAST_IMPORTANCE = 0.3
LEAST_PAGES = 8
#: Judged paths of all hosts that are broadcast at most; beyond, they are joined by a shuffle.
MOST_JUDGED = 50_000

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg math iframe object noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag of the key closes an open element of these kinds.
CLOSES = {
    **dict.fromkeys("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split(), ("p",)),
    "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"),
    "thead": ("tr", "td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tr", "td", "th"), "option": ("option",), "optgroup": ("option", "optgroup"),
}
#: Elements and roles that are never part of the article.
NOISE_TAGS = frozenset("nav footer aside form button select dialog menu search head header canvas audio video map datalist".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of a class or id that mark a branch as none of the article.
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs header masthead footer "
    "sidebar aside widget widgets related recommended recommendations share sharing cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login "
    "comment comments commentlist disqus reply replies respond form search pagination pager toolbar tags copyright disclaimer skip".split()
)
#: Words beside them that don't make a branch part of the article.
PLAIN_WORDS = frozenset(
    "site page pages main top bottom left right middle upper lower inner outer box bar list block wrapper wrap container section area region holder panel group row col column slot unit item items "
    "link links button buttons icon icons title text content global primary secondary sub mobile desktop fixed sticky post posts article articles story stories news user users reader readers social media web blog thread "
    "feed more policy banner message footer header js the and to of in on".split()
)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z)|([^<]+|<)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>][^\s=/>]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SPACE = re.compile(r"\s+")

#: A block's node is its place among the page's nodes, and so is a node's parent; -1 is the page itself.
PARTS = (
    "blocks array<struct<node: int, text: string, noise: boolean, main: boolean>>, tree array<struct<path: bigint, parent: int>>, whole bigint, "
    "nodes array<struct<path: bigint, content: bigint, style: bigint>>"
)


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)} if text.strip(" /\n\t") else {}


def marks_noise(marks: str, inside: bool) -> bool:
    """Whether one of the classes or ids names something beside the article. A header inside an article holds its title."""
    for name in marks.split():
        words = {w.lower() for w in _WORDS.findall(name) if len(w) > 1}
        bad = words & NOISE_WORDS - ({"header"} if inside else set())
        if bad and words <= NOISE_WORDS | PLAIN_WORDS:
            return True
    return False


def _element(tag: str, text: str, inside: bool) -> tuple[str, bool]:
    """An element's style and whether it marks noise."""
    a = _attributes(text)
    marks = f"{a.get('class', '')} {a.get('id', '')}".strip()
    style = tag + ("." + ".".join(sorted(marks.split())) if marks else "")
    named = bool(marks) and tag not in ("html", "body", "article", "main") and marks_noise(marks, inside)
    hidden = "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower()
    return style, tag in NOISE_TAGS - ({"header"} if inside else set()) or a.get("role", "").lower() in NOISE_ROLES or named or hidden


@lru_cache(maxsize=None)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}[\s/>]", re.I)


def read_blocks(html: str | None) -> tuple[list[dict], list[tuple[int, int]]]:
    """A page's blocks in order, with flags and their node, and the nodes as (path hash, parent)."""
    nodes: list[tuple[int, int]] = []
    stack: list[tuple[str, int, int, bool, bool, int]] = [("", 0, -1, False, False, 0)]  # tag, path hash, node, noise, in the main part, place of the innermost block
    depth: dict[str, int] = {}  # open elements of each tag
    out: list[dict] = []
    run: list[str] = []
    held = stack[0]

    def flush() -> None:
        text = _SPACE.sub(" ", unescape("".join(run))).strip()
        if text:
            out.append({"node": held[2], "text": text, "noise": held[3], "main": held[4]})
        run.clear()

    def close(k: int) -> None:
        for e in stack[k:]:
            depth[e[0]] -= 1
        del stack[k:]

    position, html = 0, html or ""
    while position < len(html):
        m = _TOKEN.match(html, position)
        position = m.end()
        if m[4] is not None:
            if not run:
                held = stack[-1]
            elif stack[-1][3] != held[3]:  # noise inside a block, or its end
                flush()
                held = stack[-1]
            run.append(m[4])
            continue
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in BLOCK:
            flush()
        if closing:
            for k in range(len(stack) - 1, 0, -1) if depth.get(tag) else ():
                if stack[k][0] == tag:
                    close(k)
                    break
                if stack[k][0] in ("table", "td", "th", "article", "main", "body") and tag in ("p", "li", "div", "span", "a", "b", "i"):
                    break
            continue
        if tag in RAW:
            if tag not in ("svg", "math") or not m[3].rstrip().endswith("/"):  # only foreign elements close themselves
                end = _raw_end(tag).search(html, position)
                position = html.find(">", end.start()) + 1 or len(html) if end else len(html)
            continue
        while len(stack) > 1 and stack[-1][0] in CLOSES.get(tag, ()):
            close(len(stack) - 1)
        if stack[stack[-1][5]][0] in CLOSES.get(tag, ()):  # inline elements left open do not outlive their paragraph
            close(stack[-1][5])
        if tag in VOID or m[3].rstrip().endswith("/") and tag not in BLOCK:
            continue
        _, path, node, above, inside, block = stack[-1]
        style, noise = _element(tag, m[3], inside)
        path = _below(path, style)
        if tag in BLOCK or noise:
            nodes.append((path, node))
            node = len(nodes) - 1
        stack.append((tag, path, node, above or noise, inside or tag in ("article", "main"), len(stack) if tag in BLOCK else block))
        depth[tag] = depth.get(tag, 0) + 1
    flush()
    return out, nodes


def hashed(text: str) -> int:
    from xxhash import xxh3_64_intdigest

    return _signed(xxh3_64_intdigest(text.encode("utf-8", "replace")))


def _signed(h: int) -> int:
    h &= (1 << 64) - 1
    return h - (1 << 64) if h >> 63 else h


@lru_cache(maxsize=100_000)
def _style_hash(style: str) -> int:
    return hashed(style)


def _below(path: int, style: str) -> int:
    """The hash of the path that goes on from a path with an element of this style."""
    return _signed(((path ^ path >> 29) * 0x9E3779B97F4A7C15 + _style_hash(style)) * 0xC2B2AE3D27D4EB4F)


def page_parts(html: str | None) -> tuple[list[dict], list[dict], int, list[dict]]:
    """A page's blocks, its tree, a hash of the page, and its nodes: for each path the hashes of the texts
    below it and of the styles that its children have, as sums that no order changes."""
    blocks, nodes = read_blocks(html)
    content, n, style, whole = [0] * len(nodes), [0] * len(nodes), [0] * len(nodes), 0
    for b in blocks:
        h = hashed(b["text"])
        whole = whole * 31 + h & (1 << 64) - 1
        if b["node"] >= 0:
            content[b["node"]] += h
            n[b["node"]] += 1
    for k in range(len(nodes) - 1, -1, -1):  # a parent comes before its children
        path, parent = nodes[k]
        if parent >= 0 and n[k]:
            content[parent] += content[k]
            n[parent] += n[k]
            style[parent] += n[k] * path
    by_path: dict[int, list[int]] = {}
    for k, (path, _) in enumerate(nodes):
        if n[k]:
            sums = by_path.setdefault(path, [0, 0])
            sums[0] += content[k]
            sums[1] += style[k]
    shown = [{**b, "text": "" if b["noise"] else b["text"]} for b in blocks]  # the tree needs the nodes, the page only the texts that may stay
    return shown, [{"path": p, "parent": up} for p, up in nodes], _signed(whole), [{"path": p, "content": _signed(c), "style": _signed(s)} for p, (c, s) in by_path.items()]


def main_text(blocks: list[dict], tree: list[dict], judged: dict[int, bool]) -> str:
    """The text of the blocks that stay. judged: whether a path is of low importance, where the host's tree tells."""
    low: list[bool] = []  # of each node: what it or the nearest judged node above it is
    for e in tree:
        above = e["parent"] >= 0 and low[e["parent"]]
        low.append(judged.get(e["path"], above))
    kept = [b for b in blocks if not b["noise"] and not (b["node"] >= 0 and low[b["node"]])]
    return " ".join(b["text"] for b in ([b for b in kept if b["main"]] or kept))


def style_tree(pages: DataFrame, least_pages: int = LEAST_PAGES, least: float = LEAST_IMPORTANCE) -> DataFrame:
    """(host, path, low): the hashed paths that enough pages have, of the hosts that have one of low importance."""
    each = pages.select("host", "whole", F.inline("nodes"))
    each = each.groupBy("host", "path", "whole").agg(F.min("content").alias("content"), F.min("style").alias("style"))  # copies of a page count once

    def entropy(of: str) -> DataFrame:
        counts = each.groupBy("host", "path", of).agg(F.count("*").alias("n"))
        m = F.sum("n")
        return counts.groupBy("host", "path").agg(m.alias("m"), ((F.log(m) - F.sum(F.col("n") * F.log("n")) / m) / F.log(F.greatest(m, F.lit(2)))).alias(of))

    tree = entropy("content").join(entropy("style").drop("m"), ["host", "path"])
    tree = materialise(tree.where(F.col("m") >= least_pages).select("host", "path", (F.greatest("content", "style") < least).alias("low")), "style-tree")
    return tree.join(tree.where("low").select("host").distinct(), "host", "left_semi")


def host_of(url: str):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"://([^/?#]*)", 1))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_pages: int = LEAST_PAGES, least: float = LEAST_IMPORTANCE) -> DataFrame:
    """One row a page: id, url, text, n_chars."""

    def make():
        def work(ids, urls, htmls):
            return ids, urls, *zip(*map(page_parts, htmls), strict=True)

        return work

    kind = dict(pages.dtypes)[id_col]
    read = map_batches(pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string")), make, f"id {kind}, url string, {PARTS}")
    read = materialise(read.withColumns({"host": F.xxhash64(host_of("url")), "row": F.monotonically_increasing_id()}), "blocks")
    tree = materialise(style_tree(read, least_pages, least), "judged")
    judged = F.collect_list(F.struct("path", "low")).alias("judged")
    if tree.count() <= MOST_JUDGED:
        pruned = read.join(F.broadcast(tree.groupBy("host").agg(judged)), "host", "left")
    else:
        own = read.select("row", "host", F.explode(F.array_distinct(F.col("tree.path"))).alias("path"))
        hit = own.join(tree, ["host", "path"]).groupBy("row").agg(judged)
        pruned = read.select("row", "id", "url", "blocks", "tree").join(hit, "row", "left")

    def finish():
        def work(ids, urls, blocks, trees, judged):
            return ids, urls, [main_text(b, t, {j["path"]: j["low"] for j in js or ()}) for b, t, js in zip(blocks, trees, judged, strict=True)]

        return work

    out = map_batches(pruned.select("id", "url", "blocks", "tree", "judged"), finish, f"id {kind}, url string, text string")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
