"""HTML extraction: boosted trees over DOM nodes, decoded from the root down."""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Forest, fit_forest
from .common import chunks

#: Fixed values of HTML: elements without content, with raw content, inside a line, and never shown.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg xmp noembed noframes annotation annotation-xml".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img picture audio video".split()) | frozenset(
    "math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
)
#: Fixed values of HTML: what may stand in a head; anything else ends it.
IN_HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template".split())
HIDDEN = frozenset("head script style textarea title noscript iframe template svg xmp noembed noframes form button select option datalist input nav object canvas dialog".split())
#: Fixed values of HTML: a start tag of the first ends an open element of the second.
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}, "option": {"option"}}
SCOPE = frozenset("table ul ol dl div section article main aside nav body select".split())

TAGS = ("body", "div", "article", "main", "section", "p", "h", "li", "list", "nav", "header", "footer", "aside", "form", "table", "quote", "other")
_TAG = {**{t: i for i, t in enumerate(TAGS)}, **{f"h{i}": 6 for i in range(1, 7)}, "ul": 8, "ol": 8, "dl": 8, "menu": 8, "dt": 7, "dd": 7, "td": 14, "tr": 14, "th": 14, "tbody": 14, "thead": 14, "blockquote": 15, "pre": 15, "figure": 15, "figcaption": 15}
#: Tokens of class, id, role and itemprop, by what they tend to mark.
TOKENS = {
    "content": "article articlebody body content contents entry hentry main maincontent maintext post postbody prose story text page blog news",
    "menu": "breadcrumb breadcrumbs menu nav navbar navigation navi pager pagination tabs toc toolbar topbar skip links sitemap",
    "edge": "banner contentinfo copyright foot footer head header masthead legal logo top bottom complementary",
    "side": "aside extra rail related sidebar sidebox widget recommended popular teaser trending tags tagcloud more",
    "advert": "ad ads adbox adslot adsense advert advertisement advertorial promo promoted promotion sponsor sponsored",
    "notice": "alert consent cookie cookies gdpr modal notice notification overlay popup warning disclaimer newsletter subscribe signup paywall",
    "talk": "comment comments commentlist discuss discussion disqus reply replies respond reviews feedback",
    "social": "share sharing social follow facebook twitter like likes meta byline author print",
    "form": "form login search searchbox searchform register contact input field button",
}
_GROUP = {t: i for i, words in enumerate(TOKENS.values()) for t in words.split()}
N_GROUPS = len(TOKENS)
#: Groups that make an element of a line a node, for the forest to judge.
_APART = sum(1 << list(TOKENS).index(g) for g in ("advert", "notice", "talk", "social"))
#: Attributes that can make an element of a line a node.
_TELLING = re.compile(r"class|id|role|itemprop|hidden|style|data-y", re.I)
CONTENT, BOILERPLATE, MIXED = range(3)

_MARKUP = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>?", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("tag", "groups", "up", "kids", "chars", "link_chars", "words", "stops", "tags", "depth", "place", "mark")

    def __init__(self, tag: str, up: Node | None, groups: int = 0, mark: str = "") -> None:
        self.tag, self.up, self.groups, self.mark = tag, up, groups, mark
        self.kids: list[Node | str] = []
        self.chars = self.link_chars = self.words = self.stops = self.tags = self.place = 0
        self.depth = up.depth + 1 if up else 0


def attribute_groups(raw: str) -> tuple[int, str]:
    """Bits of TOKENS that class, id, role or itemprop name, and a training mark."""
    bits, mark = 0, ""
    for name, a, b, c in _ATTRIBUTE.findall(raw):
        name = name.lower()
        value = a or b or c
        if name in ("class", "id", "role", "itemprop"):
            for t in _WORDS.findall(_CAMEL.sub(" ", value).lower()):
                if t in _GROUP:
                    bits |= 1 << _GROUP[t]
        elif name == "data-y":
            mark = value
        elif name in ("hidden",) or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            mark = mark or "hidden"
    return bits, mark


def parse(page: str) -> Node:
    """The tree of elements below a root; text and a line's markup are strings in their block (links counted), a space
    for <br>.  A line's elements are nodes where they are hidden or their class, id or role names adverts, notices, talk
    or sharing.  Unclosed and stray tags are mended as browsers do, in linear time: what is open is counted by name, in all,
    since the last block (for the line's elements) and since the last container (for what a start tag closes)."""
    root = at = Node("body", None)
    open_: list[tuple[str, Node]] = []
    in_all: dict[str, int] = {}
    in_line: list[dict[str, int]] = [{}]
    in_scope: list[dict[str, int]] = [{}]
    links = 0
    pos, n = 0, len(page)

    def open_one(tag: str) -> None:
        open_.append((tag, at))
        in_all[tag] = in_all.get(tag, 0) + 1
        in_scope[-1][tag] = in_scope[-1].get(tag, 0) + 1
        if tag in SCOPE:
            in_scope.append({})
        if tag in INLINE:
            in_line[-1][tag] = in_line[-1].get(tag, 0) + 1
        else:
            in_line.append({})

    def close(until: int) -> None:
        nonlocal at, links
        while len(open_) > until:
            tag, at = open_.pop()
            links -= tag == "a"
            in_all[tag] -= 1
            if tag in SCOPE:
                in_scope.pop()
            in_scope[-1][tag] -= 1
            if tag in INLINE:
                in_line[-1][tag] -= 1
            else:
                in_line.pop()

    def close_last(tags: set[str]) -> None:
        i = len(open_) - 1
        while open_[i][0] not in tags:
            i -= 1
        close(i)

    def put(text: str) -> None:
        if text:
            if at.tag == "head" and not text.isspace():
                close(0)
            at.kids.append(text)
            bare = len(text) - text.count(" ")
            if bare:
                at.chars += bare
                at.words += text.count(" ") + 1
                at.stops += text.count(".") + text.count(",")
                if links:
                    at.link_chars += bare

    while pos < n:
        m = _MARKUP.search(page, pos)
        if not m:
            put(html.unescape(page[pos:]))
            break
        if m.start() > pos:
            put(html.unescape(page[pos : m.start()]))
        pos = m.end()
        end, name, raw = m.groups()
        if name is None:
            continue
        name = name.lower()
        if end:
            if (in_line[-1] if name in INLINE else in_all).get(name):
                close_last({name})
            continue
        if at.tag == "head" and name not in IN_HEAD and name != "html":
            close(0)
        if name == "head" and (open_ or root.chars or root.tags or any(type(k) is Node for k in root.kids)):
            continue
        if name in RAW:
            stop = re.compile(f"</{re.escape(name)}", re.I).search(page, pos)
            pos = stop.start() if stop else n
            after = page.find(">", pos)
            pos = after + 1 if after >= 0 else n
            continue
        if name in ("html", "body"):
            bits, mark = attribute_groups(raw)
            root.groups |= bits
            root.mark = mark or root.mark
            if name == "body":
                close(0)
            continue
        if name in CLOSES_P or name in CLOSES:
            targets = CLOSES.get(name, set()) | ({"p"} if name in CLOSES_P else set())
            while any(in_scope[-1].get(t) for t in targets):
                close_last(targets)
        if name in ("br", "hr", "wbr"):
            put(" ") if name != "wbr" else None
            at.tags += 1
        elif name in VOID:
            at.tags += 1
        elif name in INLINE:
            at.tags += 1
            if name in ("mtd", "mtr"):
                put(" ")
            open_one(name)
            links += name == "a"
            bits, mark = attribute_groups(raw) if _TELLING.search(raw) else (0, "")
            if mark or bits & _APART:
                node = Node(name, at, bits, mark)
                at.kids.append(node)
                at = node
        else:
            bits, mark = attribute_groups(raw) if raw.strip() else (0, "")
            node = Node(name, at, bits, mark)
            at.kids.append(node)
            open_one(name)
            at = node
    return root


FEATURES = len(TAGS) * 2 + 3 * N_GROUPS + 17


def node_features(root: Node) -> tuple[list[Node], np.ndarray]:
    """All nodes in page order and their features: tag, parent's tag, attribute tokens of the node, of all above it and of
    the sibling behind it, depth, place among siblings, and text, links, stops and density of subtree, parent and page."""
    nodes: list[Node] = []
    stack = [root]
    while stack:
        x = stack.pop()
        nodes.append(x)
        own = [k for k in x.kids if type(k) is Node]
        for i, k in enumerate(own):
            k.place = i
        stack.extend(reversed(own))
    sums: dict[int, list[int]] = {}
    many: dict[int, int] = {}
    behind: dict[int, int] = {}
    for x in reversed(nodes):
        own = [k for k in x.kids if type(k) is Node]
        many[id(x)] = len(own)
        behind.update((id(a), b.groups) for a, b in zip(own, own[1:]))
        t = [x.chars, x.link_chars, x.words, x.stops, x.tags + 1, x.tag == "p"]
        longest = x.chars
        for k in x.kids:
            if type(k) is Node:
                s = sums[id(k)]
                for j in range(6):
                    t[j] += s[j]
                longest = max(longest, s[6])
        sums[id(x)] = [*t, longest]
    all_ = sums[id(root)]
    for x in nodes:
        # A form around the page, with sentences, is a plain container; its controls stay hidden.
        if x.tag == "form" and not x.mark and 2 * sums[id(x)][0] > all_[0] and sums[id(x)][3] > 1:
            x.tag, x.groups = "div", x.groups & ~(1 << _GROUP["form"])
    out = np.zeros((len(nodes), FEATURES), np.float32)
    above: dict[int, int] = {}
    log, a, g = np.log1p, len(TAGS), 2 * len(TAGS)
    numbers = np.empty((len(nodes), 17), np.float64)
    for i, x in enumerate(nodes):
        s, up = sums[id(x)], x.up
        bits = x.groups
        out[i, _TAG.get(x.tag, a - 1)] = 1
        over = above[id(up)] | up.groups if up else 0
        above[id(x)] = over
        su = sums[id(up)] if up else s
        if up:
            out[i, a + _TAG.get(up.tag, a - 1)] = 1
        for start, named in ((g, bits), (g + N_GROUPS, over), (g + 2 * N_GROUPS, behind.get(id(x), 0))):
            while named:
                if named & 1:
                    out[i, start] = 1
                named >>= 1
                start += 1
        kids = len(x.kids)
        numbers[i] = (
            x.depth, x.place, many[id(up)] if up else 1, kids, s[0], s[2], s[3], s[4], s[5], x.chars, s[1] / max(1, s[0]), s[3] / max(1, s[2]),
            s[0] / s[4], s[0] / max(1, all_[0]), s[0] / max(1, su[0]), s[6] / max(1, s[0]), s[5] / max(1, all_[5]),
        )
    numbers[:, 2:10] = log(numbers[:, 2:10])
    out[:, g + 3 * N_GROUPS :] = numbers
    return nodes, out


def decode_tree(nodes: list[Node], scores: np.ndarray) -> dict[int, int]:
    """States by id(node), from the root down and without contradictions: below boilerplate all is boilerplate, below content
    nothing is mixed; below a mixed node all goes.  A node's shares are given that what holds it isn't
    boilerplate, so the choice at each node is the likeliest of those that its parent's state leaves."""
    state: dict[int, int] = {}
    for x, s in zip(nodes, scores.tolist(), strict=True):
        up = state[id(x.up)] if x.up else MIXED
        if up == BOILERPLATE or x.tag in HIDDEN or x.mark == "hidden":
            state[id(x)] = BOILERPLATE
        elif up == CONTENT:
            state[id(x)] = CONTENT if s[CONTENT] >= s[BOILERPLATE] else BOILERPLATE
        else:
            state[id(x)] = max((CONTENT, BOILERPLATE, MIXED), key=lambda k: (s[k], -k))
    return state


def blocks_of(root: Node, state: dict[int, int]) -> list[str]:
    """Texts of the content blocks in page order, white space turned into single spaces and trimmed."""
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = " ".join("".join(line).split())
        if text:
            out.append(text)
        line.clear()

    # After a node's kids, how it ends: None for a block, False for an element of a line.
    stack: list[Node | str | bool | None] = [root]
    keep = [False]
    while stack:
        x = stack.pop()
        if not x and x != "":
            if x is None:
                flush()
            keep.pop()
        elif type(x) is str:
            if keep[-1]:
                line.append(x)
        else:
            inside = x.tag in INLINE
            if not inside:
                flush()
            keep.append(state[id(x)] == CONTENT)
            stack.append(False if inside else None)
            stack.extend(reversed(x.kids))
    return out


def extract(pages: list[str], forest: Forest) -> list[str]:
    trees = [parse(p) for p in pages]
    found = [node_features(t) for t in trees]
    scores = forest.log_shares(np.concatenate([f for _, f in found])) if found else np.empty((0, 3))
    out, at = [], 0
    for tree, (nodes, f) in zip(trees, found, strict=True):
        out.append("\n".join(blocks_of(tree, decode_tree(nodes, scores[at : at + len(f)]))))
        at += len(f)
    return out


@lru_cache(maxsize=2)
def trained(n_pages: int = 700, rounds: int = 30, seed: int = 5) -> Forest:
    """A forest trained on ``n_pages`` made-up pages whose parts are known (see page_maker)."""
    from .page_maker import make_page

    r = np.random.default_rng(seed)
    xs, ys = [], []
    for _ in range(n_pages):
        nodes, f = node_features(parse(make_page(r)))
        state: dict[int, int] = {}
        for x in nodes:
            state[id(x)] = {"c": CONTENT, "b": BOILERPLATE, "m": MIXED}[x.mark] if x.mark in ("c", "b", "m") else state[id(x.up)] if x.up else MIXED
        open_ = np.array([x.up is None or state[id(x.up)] != BOILERPLATE for x in nodes])
        xs.append(f[open_])
        ys.append(np.array([state[id(x)] for x in nodes])[open_])
    return fit_forest(np.concatenate(xs), np.concatenate(ys), 3, rounds=rounds)


def _extract(forest: Forest):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (_, _, pages) in chunks(batches, 128):
            texts = extract([p or "" for p in pages], forest)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of ``pages`` (page_id, url, html).

    The whole html is parsed; each block element, and each hidden or telling element of a line, gets a share for content, boilerplate and mixed from the forest; states
    without contradictions are chosen from the root down, and the blocks of content nodes are joined by
    newlines.  Null or empty html, and pages without content: empty text.  Other columns don't matter,
    repeated rows are treated one by one, no rows give no rows.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return own.mapInArrow(_extract(trained()), "page_id long, url string, text string, n_chars long")
