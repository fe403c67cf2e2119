"""Main text of web pages: boosted trees score the nodes of a page's tree, and a decoding over the tree picks consistent ones.

A page becomes a tree of its block elements, and of inline elements with attributes; a node has features of its own text, of its subtree (text, share of
link text, share of punctuation, paragraphs, controls), of its siblings, its depth and place, and of its name and attribute tokens and
those above it. Gradient-boosted trees turn them into log odds of "part of the article". A node is outside, in the article or cut out of it, and on
every way down from the root these follow in that order: the best such labelling by the nodes' summed log odds is found bottom-up,
so a kept paragraph can't sit in a rejected sidebar, nor an article contain one by accident.

The trees are trained here, on about ``pages`` pages drawn by a hash of the id: text that a page marks as its article (``article`` or ``main``) and text
that it marks as something else (``nav``, ``footer``, ...). So that names alone don't decide, each page is also laid out anew in
several ways, as other sites build theirs: its article in a ``div`` or ``section`` with telling or blank attributes, among menus,
sidebars, notices, adverts, forms, link lists and reader comments that are made of short texts of these pages.

Never text: scripts, styles, the head, form controls, embedded objects, comments and markup.

Defined cases: null and empty pages give an empty text; entities are decoded as in HTML 5, with or without semicolon, and what is none stays; white space (Unicode's) inside a block becomes
one space; a line break is white space; unclosed elements end with their parents; without a page that marks an article the trees are trained on nothing and text is kept
where elements and attributes don't speak against it; repeated rows give a row each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, pieces, table

_NAMES = lambda s: frozenset(s.split())
VOID = _NAMES("area base br col embed hr img input link meta param source track wbr")
INLINE = _NAMES("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr img br")
RAW = _NAMES("script style title textarea noscript iframe xmp noembed noframes template")
NEVER = _NAMES("head script style title textarea noscript iframe xmp noembed noframes template button select option optgroup input object embed applet svg math canvas audio video map datalist")
PARAGRAPH_ENDS = _NAMES("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul")
#: An opening element ends an open one of these, up to the named border.
REPLACES = {"li": (_NAMES("li"), _NAMES("ul ol menu")), "dt": (_NAMES("dt dd"), _NAMES("dl")), "dd": (_NAMES("dt dd"), _NAMES("dl")), "tr": (_NAMES("tr td th"), _NAMES("table")), "td": (_NAMES("td th"), _NAMES("tr table")), "th": (_NAMES("td th"), _NAMES("tr table")), "option": (_NAMES("option"), _NAMES("select"))}
#: Fixed words of attribute values and names, by what they speak for.
GROUPS = {
    "article": _NAMES("article articlebody body content entry hentry main maincontent page post prose story text"),
    "menu": _NAMES("breadcrumb breadcrumbs crumbs dropdown header masthead menu nav navbar navigation navi pager pagination tabs toc toolbar topbar"),
    "footer": _NAMES("bottom colophon copyright credits foot footer imprint legal"),
    "side": _NAMES("aside complementary rail recommended related sidebar sidenav teaser teasers trending widget widgets popular more"),
    "advert": _NAMES("ad ads adslot adsense advert advertisement banner commercial outbrain promo promoted promotion sponsor sponsored taboola"),
    "notice": _NAMES("alert consent cookie cookies dialog disclaimer gdpr hidden message modal notice notification overlay popup privacy toast warning"),
    "form": _NAMES("contact form login newsletter register search searchbox signin signup subscribe subscription"),
    "comments": _NAMES("comment commentlist comments discussion disqus feedback reader readers replies reply respond response responses thread"),
    "share": _NAMES("author byline share sharing social tags tools"),
}
TAG_GROUPS = {"article": _NAMES("article main"), "menu": _NAMES("nav header menu"), "footer": _NAMES("footer"), "side": _NAMES("aside"), "form": _NAMES("form fieldset"), "notice": _NAMES("dialog"), "paragraph": _NAMES("p blockquote pre figcaption"), "heading": _NAMES("h1 h2 h3 h4 h5 h6"), "list": _NAMES("ul ol li dl dt dd"), "cell": _NAMES("table tr td th tbody thead tfoot"), "inline": INLINE}
_TAG = re.compile(r"<(?:!--(?P<note>.*?)(?:--!?>|\Z)|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|[!?/][^>]*(?:>|\Z))", re.S)
_CUT = re.compile(r"<[a-zA-Z/!][^>]*\Z")
_ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|hidden|aria-hidden|aria-label|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", re.I | re.S)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Page:
    """The tree of a page, nodes in page order: name, parent, end (behind the last node of the subtree), depth, place among its siblings; ``attributed`` are (node, tokens),
    ``texts`` (node, run, decoded text), runs are blocks."""

    def __init__(self, source: str):
        self.name, self.parent, self.end, self.depth, self.place, self.children = ["#"], [-1], [0], [0], [0], [0]
        self.texts: list[tuple[int, int, str]] = []
        self.links: list[bool] = []
        self.attributed: list[tuple[int, tuple[str, ...]]] = []
        open_, run, at, link = [(0, "#")], 0, 0, 0  # open_: (node, name); inline elements without attributes stand for the node around them
        cut = _CUT.search(source)
        end = len(source) if cut is None or _TAG.match(source, cut.start()) else cut.start()
        for m in iter(lambda: _TAG.search(source, at, end), None):
            self._text(source[at : m.start()], open_[-1][0], run, link > 0)
            at = m.end()
            name = m["name"] and m["name"].lower()
            if not name:
                continue
            block = name not in INLINE and name not in RAW
            if m["end"]:
                k = next((k for k in range(len(open_) - 1, 0, -1) if open_[k][1] == name or (not block and open_[k][1] not in INLINE)), 0)
                if k and open_[k][1] == name:
                    link -= self._close(open_, k)
                run += block
                continue
            if name in PARAGRAPH_ENDS:
                k = next((k for k in range(len(open_) - 1, 0, -1) if open_[k][1] not in INLINE), 0)
                if k and open_[k][1] == "p":
                    link -= self._close(open_, k)
            if name in REPLACES:
                ends, border = REPLACES[name]
                k = next((k for k in range(1, len(open_)) if open_[k][1] in ends and not any(o[1] in border for o in open_[k:])), 0)
                if k:
                    link -= self._close(open_, k)
            run += block
            if name == "br":
                self._text(" ", open_[-1][0], run, False)
            if name in VOID:
                if name == "input":
                    self._node(name, open_[-1][0], m["rest"])
                continue
            if name in RAW:
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(source, at)
                self._node(name, open_[-1][0], m["rest"])
                at = close.end() if close else end
                continue
            rest = m["rest"]
            node = self._node(name, open_[-1][0], rest) if name not in INLINE or (len(rest) > 5 and _ATTRIBUTE.search(rest)) else open_[-1][0]
            open_.append((node, name))
            link += name == "a"
        self._text(source[at:end], open_[-1][0], run, link > 0)
        self._close(open_, 0)

    def _text(self, raw: str, node: int, run: int, link: bool) -> None:
        if raw:
            self.texts.append((node, run, html.unescape(raw) if "&" in raw else raw))
            self.links.append(link)

    def _node(self, name: str, parent: int, rest: str) -> int:
        node = len(self.name)
        self.name.append(name)
        self.parent.append(parent)
        self.end.append(node + 1)
        self.depth.append(self.depth[parent] + 1)
        self.place.append(self.children[parent])
        self.children.append(0)
        self.children[parent] += 1
        found = []
        if rest:
            for key, *value in _ATTRIBUTE.findall(rest):
                value, key = "".join(value), key.lower()
                if key == "style":
                    found += ["hidden"] * bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value))
                elif key == "hidden" or (key == "aria-hidden" and value == "true"):
                    found.append("hidden")
                else:
                    found += [t.lower() for t in _TOKEN.findall(value)]
        if found:
            self.attributed.append((node, tuple(found)))
        return node

    def _close(self, open_: list, k: int) -> int:
        links = sum(name == "a" for _, name in open_[k:])
        for node, _ in open_[k:]:
            self.end[node] = len(self.name)
        del open_[k:]
        return links


FEATURES = (
    [f"own_{x}" for x in ("chars", "words", "stops", "link_share")] + [f"all_{x}" for x in ("chars", "link_share", "mean_words", "stop_rate", "comma_rate", "paragraph_share", "link_rate", "control_rate", "item_share")]
    + ["share_of_page", "share_of_parent", "depth", "place", "siblings", "like_siblings", "before_chars", "after_chars", "heading_before", "nodes"]
    + [f"tag_{g}" for g in TAG_GROUPS] + [f"token_{g}" for g in GROUPS] + [f"above_tag_{g}" for g in ("article", "menu", "footer", "side", "form", "notice", "list", "cell")] + [f"above_token_{g}" for g in GROUPS] + ["names_article", "is_root"]
)
def _flags(groups: dict[str, frozenset]) -> dict[str, list[int]]:
    out: dict[str, list[int]] = {}
    for g, members in enumerate(groups.values()):
        for w in members:
            out.setdefault(w, []).append(g)
    return out


_GROUP_OF, _TAGS_OF = _flags(GROUPS), _flags(TAG_GROUPS)
_ABOVE_TAGS = [list(TAG_GROUPS).index(g) for g in ("article", "menu", "footer", "side", "form", "notice", "list", "cell")]


def features(pages: list[Page]) -> np.ndarray:
    """A row of FEATURES for each node of the pages, in order."""
    sizes = np.array([len(p.name) for p in pages])
    first = np.cumsum(sizes) - sizes
    n, row = int(sizes.sum()), np.arange(int(sizes.sum()))
    root = np.repeat(first, sizes)
    names = [x for p in pages for x in p.name]
    number: dict[str, int] = {}
    code = np.array([number.setdefault(x, len(number)) for x in names])
    parent = np.concatenate([p.parent for p in pages]) + root
    parent[first] = first
    end = np.concatenate([p.end for p in pages]) + root
    depth, place = np.concatenate([p.depth for p in pages]), np.concatenate([p.place for p in pages])
    count = np.concatenate([p.children for p in pages])[parent]
    by_name = np.zeros((len(number), len(TAG_GROUPS) + 5))
    for x, k in number.items():
        by_name[k, _TAGS_OF.get(x, [])] = 1
        by_name[k, len(TAG_GROUPS) :] = x == "p", x == "a", x in NEVER, x == "li", x[0] == "h" and x[1:].isdigit()
    kinds = by_name[code]
    tag, own = kinds[:, : len(TAG_GROUPS)], np.concatenate([np.zeros((n, 5)), kinds[:, len(TAG_GROUPS) :]], axis=1)
    told = [(f + i, g) for f, p in zip(first.tolist(), pages, strict=True) for i, ts in p.attributed for t in ts for g in _GROUP_OF.get(t, ())]
    token = np.zeros((n, len(GROUPS)))
    if told:
        token[tuple(np.array(told).T)] = 1
    pieces_ = [(f + node, len(text), len(text) * link, len(text.split()), text.count(". ") + text.count("! ") + text.count("? ") + (text.rstrip()[-1:] in tuple(".!?")), text.count(",")) for f, p in zip(first.tolist(), pages, strict=True) for (node, _, text), link in zip(p.texts, p.links, strict=True) if not text.isspace()]
    if pieces_:
        at, *values = np.array(pieces_, dtype=float).T
        for k, v in enumerate(values):
            own[:, k] = np.bincount(at.astype(np.int64), v, n)
    total = np.concatenate([np.zeros((1, own.shape[1])), np.cumsum(own, axis=0)])
    whole = total[end] - total[row]
    above_tag, above_token = np.zeros((n, len(_ABOVE_TAGS))), np.zeros((n, len(GROUPS)))
    order = np.argsort(depth, kind="stable")
    for level in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)[1:]:
        up = parent[level]
        above_tag[level], above_token[level] = np.maximum(above_tag[up], tag[np.ix_(up, _ABOVE_TAGS)]), np.maximum(above_token[up], token[up])
    _, like, times = np.unique(parent * len(number) + code, return_inverse=True, return_counts=True)
    heading = np.maximum.accumulate(np.where(own[:, 9] > 0, row, -1))
    heading = np.concatenate([[-1], heading[:-1]])
    chars, words, units, width = np.maximum(whole[:, 0], 1), np.maximum(whole[:, 2], 1), end - row, np.maximum(count, 1)
    of_page = np.maximum(whole[root, 0], 1)
    out = np.column_stack([
        np.log1p(own[:, 0]), np.log1p(own[:, 2]), own[:, 3], own[:, 1] / np.maximum(own[:, 0], 1),
        np.log1p(whole[:, 0]), whole[:, 1] / chars, whole[:, 2] / units, whole[:, 3] / words, whole[:, 4] / words, whole[:, 5] / units, whole[:, 6] / words, whole[:, 7] / units, whole[:, 8] / units,
        whole[:, 0] / of_page, whole[:, 0] / chars[parent], depth, place / width, count, times[like] / width, (total[row, 0] - total[root, 0]) / of_page, (total[end[root], 0] - total[end, 0]) / of_page,
        (heading >= root) & (row - heading <= 6), np.log1p(units),
        tag, token, above_tag, above_token, np.maximum.reduceat(tag[:, 0], first).repeat(sizes) if n else np.zeros(0), row == root,
    ])
    out[own[:, 7] > 0, 0] = -1
    return out


# --- boosted trees ---------------------------------------------------------------------------------------------------------------


def _grow(binned: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, bins: int, least: float = 4.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A complete tree of ``depth`` levels: feature and bin of every inner node, value of every leaf."""
    feature, cut, at = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, bins), np.zeros(len(g), np.int64)
    n = binned.shape[1]
    for level in range(depth):
        base, width = (1 << level) - 1, 1 << level
        key = ((at - base)[:, None] * n + np.arange(n)) * bins + binned
        sums = [np.bincount(key.ravel(), np.repeat(x, n), width * n * bins).reshape(width, n, bins).cumsum(axis=2) for x in (g, h)]
        gl, hl, gt, ht = sums[0][:, :, :-1], sums[1][:, :, :-1], sums[0][:, :, -1:], sums[1][:, :, -1:]
        gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
        gain[(hl < least) | (ht - hl < least)] = 0
        best = gain.reshape(width, -1).argmax(axis=1)
        split = gain.reshape(width, -1)[np.arange(width), best] > 1e-6
        feature[base : base + width] = np.where(split, best // (bins - 1), 0)
        cut[base : base + width] = np.where(split, best % (bins - 1), bins)  # no split: all go left
        at = 2 * at + 1 + (binned[np.arange(len(g)), feature[at]] > cut[at])
    leaf = at - ((1 << depth) - 1)
    return feature, cut, np.bincount(leaf, g, 1 << depth) / (np.bincount(leaf, h, 1 << depth) + 1)


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32) -> dict:
    """Boosted trees for 0/1 labels with logistic loss."""
    cuts = [np.unique(np.quantile(f, np.linspace(0, 1, bins + 1)[1:-1])) if len(f) else np.zeros(0) for f in x.T]
    binned = np.stack([np.searchsorted(c, f, "left") for c, f in zip(cuts, x.T, strict=True)], axis=1)
    share = float(np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3))
    score, grown = np.full(len(y), math.log(share / (1 - share))), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        feature, cut, leaf = _grow(binned, weight * (y - p), weight * p * (1 - p), depth, bins)
        at = np.zeros(len(y), np.int64)
        for _ in range(depth):
            at = 2 * at + 1 + (binned[np.arange(len(y)), feature[at]] > cut[at])
        leaf = np.clip(rate * leaf, -1, 1)
        score += leaf[at - ((1 << depth) - 1)]
        limit = np.array([cuts[f][c] if c < len(cuts[f]) else np.inf for f, c in zip(feature, cut, strict=True)])
        grown.append((feature, limit, leaf))
    return {"bias": math.log(share / (1 - share)), "depth": depth, "trees": grown}


def odds(x: np.ndarray, model: dict) -> np.ndarray:
    """Log odds of rows of features."""
    out, row = np.full(len(x), model["bias"]), np.arange(len(x))
    for feature, limit, leaf in model["trees"]:
        at = np.zeros(len(x), np.int64)
        for _ in range(model["depth"]):
            at = 2 * at + 1 + (x[row, feature[at]] > limit[at])
        out += leaf[at - len(feature)]
    return out


# --- decoding and text -----------------------------------------------------------------------------------------------------------


#: Elements of running text.
PLAIN = TAG_GROUPS["paragraph"] | TAG_GROUPS["heading"] | TAG_GROUPS["list"] | TAG_GROUPS["cell"] | INLINE


def leaving(page: Page, bare: float = 4.0, other: float = 1.0) -> list[float]:
    """What it costs to cut a node out of an article: ``bare`` for an element of running text that has no telling attributes, ``other`` for the rest, nothing for what never is text."""
    out = [0.0 if name in NEVER else bare if name in PLAIN else other for name in page.name]
    for i, _ in page.attributed:
        out[i] = min(out[i], other)
    return out


def decode(page: Page, score: np.ndarray, enter: float = 3.0) -> list[bool]:
    """Which nodes are in the article: the labelling outside* inside* cut* with the largest sum of log odds, less what each start (``enter``) and end of a region costs."""
    n, leave = len(page.name), leaving(page)
    value = np.clip(score, -6, 6).tolist()
    value = [-1e6 if page.name[i] in NEVER else v for i, v in enumerate(value)]
    outside, inside, cut = [0.0] * n, [0.0] * n, [0.0] * n  # best sums of the subtree, if its top has that state
    parent = page.parent
    for i in range(n - 1, -1, -1):
        v = value[i]
        outside[i] -= v
        inside[i] += v
        cut[i] -= v
        if i:
            p = parent[i]
            outside[p] += max(outside[i], inside[i] - enter)
            inside[p] += max(inside[i], cut[i] - leave[i])
            cut[p] += cut[i]
    state = [0] * n
    state[0] = int(inside[0] - enter > outside[0])
    for i in range(1, n):
        s = state[parent[i]]
        state[i] = int(inside[i] - enter > outside[i]) if s == 0 else (1 if s == 1 and inside[i] >= cut[i] - leave[i] else 2)
    return [s == 1 for s in state]


def render(page: Page, kept: list[bool]) -> str:
    """Kept text: runs as blocks, joined by an empty line."""
    blocks, last, piece = [], None, []
    for node, run, text in page.texts:
        if kept[node]:
            if run != last and piece:
                blocks.append("".join(piece))
                piece = []
            last = run
            piece.append(text)
    blocks.append("".join(piece))
    return "\n\n".join(b for b in (" ".join(x.split()) for x in blocks) if b)


# --- training --------------------------------------------------------------------------------------------------------------------

_OTHER = _NAMES("nav footer aside form dialog header")


def _speaks_against(page: Page) -> set[int]:
    """Nodes whose element or attributes name something else than an article."""
    names = {i for i, name in enumerate(page.name) if name in NEVER or name in _OTHER}
    return names | {i for i, tokens in page.attributed if any(g > 0 for t in tokens for g in _GROUP_OF.get(t, ()))}  # group 0 is the article's


def marked(page: Page) -> np.ndarray | None:
    """Labels by what the page says itself: 1 in an article, 0 elsewhere; None where nothing is marked. Parts of an article that are named as something else are 0."""
    n, bad_names = len(page.name), _speaks_against(page)
    inside, told = np.zeros(n, np.int64), False
    for i in range(1, n):
        name, p = page.name[i], page.parent[i]
        bad = i in bad_names
        if inside[p] == 1:
            inside[i] = 2 if bad else 1
        elif inside[p] == 2:
            inside[i] = 2
        else:
            inside[i] = int(name in ("article", "main"))
        told |= inside[i] == 1
    return (inside == 1).astype(float) if told else None


def _laid_out(rng: random.Random, article: list[tuple[str, str]], short: list[str], long: list[str]) -> str:
    """A page around the article's blocks (name, text) as another site might build it; true parts carry role="truth"."""
    e = html.escape
    some = lambda k, of=None: [rng.choice(of or short) for _ in range(k)]
    blank = lambda: rng.choice(["", "", f' class="c{rng.randrange(99)}"', f' id="x{rng.randrange(99)}"', ' class="row"', ' class="inner wrap"'])

    def named(group: str, tag: str | None = None) -> str:
        word = rng.choice(sorted(GROUPS[group]))
        return rng.choice([f' class="{word}"', f' id="{word}"', f' class="{word}-box b{rng.randrange(9)}"', f' class="site-{word}"']) if rng.random() < 0.75 else blank()

    def links(tag: str, group: str) -> str:
        items = "".join(f'<li><a href="/{i}">{e(x[:40])}</a></li>' for i, x in enumerate(some(rng.randrange(3, 9))))
        inner = rng.choice([f"<ul>{items}</ul>", items.replace("<li>", "").replace("</li>", " "), f"<h3>{e(some(1)[0][:30])}</h3><ul>{items}</ul>"])
        return f"<{tag}{'' if tag != 'div' else named(group)}>{inner}</{tag}>"

    def advert() -> str:
        return f"<div{named('advert')}>{rng.choice(['<p>%s</p>', '%s', '<a href=x>%s</a>']) % e(some(1, rng.choice([short, long]))[0][:160])}</div>"

    def notice() -> str:
        return f"<{(t := rng.choice(['div', 'section', 'div']))}{named('notice')}><p>{e(some(1, rng.choice([short, long]))[0][:200])}</p>{rng.choice(['', '<button>OK</button>', '<a href=x>%s</a>' % e(some(1)[0][:20])])}</{t}>"

    def form() -> str:
        return f"<form{blank()}><p>{e(some(1)[0][:80])}</p><label>{e(some(1)[0][:20])}</label><input name=q><button>{e(some(1)[0][:12])}</button></form>"

    def comments() -> str:
        tag = rng.choice(["div", "section", "ol"])
        one = "li" if tag == "ol" else rng.choice(["div", "article", "div"])
        each = "".join(f"<{one}{named('comments')}><b>{e(some(1)[0][:16])}</b><p>{e(x[: rng.randrange(20, 400)])}</p></{one}>" for x in some(rng.randrange(1, 7), rng.choice([short, long])))
        word = rng.choice(sorted(GROUPS["comments"]))
        return f'<{tag} {rng.choice(["class", "id"])}="{word}"><h3>{e(some(1)[0][:24])}</h3>{each}</{tag}>'

    def side() -> str:
        tag = rng.choice(["aside", "div", "div"])
        return f"<{tag}{named('side')}>" + "".join(rng.choice([f"<h3>{e(x[:30])}</h3><p>{e(some(1)[0][:90])}</p>", links("div", "side"), advert()]) for x in some(rng.randrange(1, 4))) + f"</{tag}>"

    def foot() -> str:
        tag = rng.choice(["footer", "footer", "div"])
        return f"<{tag}{'' if tag == 'footer' else named('footer')}>{rng.choice(['&copy; ', ''])}{rng.choice(['<p>%s</p>', '%s']) % e(some(1, rng.choice([short, long]))[0][:140])}{rng.choice(['', links('div', 'footer')])}</{tag}>"

    def head() -> str:
        tag = rng.choice(["header", "header", "div"])
        return f"<{tag}{'' if tag == 'header' else named('menu')}>{rng.choice(['<h1>%s</h1>', '<a href=/>%s</a>', '<p>%s</p>']) % e(some(1)[0][:30])}{rng.choice(['', links('nav', 'menu')])}</{tag}>"

    bits = []
    for i, (name, text) in enumerate(article):
        bits.append(f'<{name} role="truth"{blank() if rng.random() < 0.1 else ""}>{e(text)}</{name}>')
        if i and rng.random() < 0.06:
            bits.append(rng.choice([advert, notice, side, form])())
    if rng.random() < 0.15:
        bits.append(rng.choice([comments, lambda: links("div", "share")])())
    inner = "".join(bits)
    if rng.random() < 0.3:
        inner = f'<div role="truth"{blank()}>{inner}</div>'
    tag = rng.choice(["article", "main", "section", "div", "div", "div"])
    told = "" if tag in ("article", "main") else (f' class="{rng.choice(sorted(GROUPS["article"]))}"' if rng.random() < 0.7 else blank())
    middle = f'<{tag}{told} role="truth">{inner}</{tag}>'
    if rng.random() < 0.15:  # a page of nothing else
        return rng.choice(["%s", "<body>%s</body>", "<html><body><div>%s</div></body></html>"]) % middle
    around = [x() for x in rng.sample([side, side, advert, notice, form, comments, lambda: links("div", "side")], rng.randrange(5))]
    k = rng.randrange(len(around) + 1)
    body = "".join(around[:k]) + middle + "".join(around[k:])
    if rng.random() < 0.5:
        body = f"<div{blank()}>{body}</div>"
    first = [x() for x in rng.sample([head, lambda: links("nav", "menu"), lambda: links("div", "menu"), notice, advert], rng.randrange(1, 4))]
    return f"<html><head><title>{e(some(1)[0])}</title></head><body>{''.join(first)}{body}{foot() if rng.random() < 0.9 else ''}</body></html>"


def training_set(sources: list[str], layouts: int = 1_200, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and weights of nodes of pages that mark their article, as they are and laid out anew, in about ``layouts`` pages in all."""
    rng, articles, short, long, rows = random.Random(seed), [], [], [], []  # rows: features, labels, weight of the page
    for source in sources:
        page = Page(source)
        label = marked(page)
        runs: dict[int, list] = {}
        for node, run, text in page.texts:
            runs.setdefault(run, [node, []])[1].append(text)
        blocks = [(node, " ".join("".join(t).split())) for node, t in runs.values() if page.name[node] not in NEVER]
        blocks = [b for b in blocks if b[1]]
        if label is not None:
            rows.append((features([page]), label, 3.0))
            article = [(page.name[node] if page.name[node] in ("p", "h1", "h2", "h3", "li", "blockquote", "pre") else "p", text) for node, text in blocks if label[node]]
            if article:
                articles.append(article)
        for node, text in blocks:
            (short if len(text) < 120 else long).append(text[:600])
    if articles and (short or long):
        for article in articles:
            for _ in range(-(-layouts // len(articles))):
                pick = article[: rng.randrange(1, len(article) + 1)] if rng.random() < 0.3 else article
                page = Page(_laid_out(rng, pick, short or long, long or short))
                label = _truth(page)
                rows.append((features([page]), label, 1.0))
    if not rows:
        return np.zeros((0, len(FEATURES))), np.zeros(0), np.zeros(0)
    return np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), np.concatenate([np.full(len(r[1]), r[2] / math.sqrt(len(r[1]))) for r in rows])


def _truth(page: Page) -> np.ndarray:
    """Labels of a page that was laid out here, whose marks are taken off. Bare elements inside a marked block go with it."""
    label = np.zeros(len(page.name))
    label[[i for i, t in page.attributed if "truth" in t]] = 1
    page.attributed = [(i, tuple(x for x in t if x != "truth")) for i, t in page.attributed]
    return label


def learn(pages: DataFrame, limit: int = 300) -> dict | None:
    """Trees from about ``limit`` pages (page_id, html); None where no page marks an article."""
    n = pages.count()
    key = F.pmod(F.xxhash64(F.lit(3), "page_id"), F.lit(1 << 30))
    rows = pages.where((key < math.ceil((1 << 30) * min(1.0, limit / max(n, 1)))) & (F.length("html") < 200_000)).select("page_id", "html").collect()
    x, y, w = training_set([r.html for r in sorted(rows, key=lambda r: (r.page_id is None, r.page_id or 0, r.html)) if r.html])
    w = w * (len(w) / max(w.sum(), 1e-9))
    return fit(x, y, w) if len(np.unique(y)) == 2 else None


def _plain(page: Page) -> np.ndarray:
    """Log odds without trees: text is kept unless its element or attributes speak against it."""
    out = np.full(len(page.name), 4.0)
    out[list(_speaks_against(page))] = -4
    return out


def main_texts(sources: list[str | None], model: dict | None) -> list[str]:
    pages = [Page(s or "") for s in sources]
    if model is None:
        scores = [_plain(p) for p in pages]
    else:
        size = np.cumsum([len(p.name) for p in pages])
        scores = np.split(odds(features(pages), model), size[:-1])
    return [render(p, decode(p, s)) for p, s in zip(pages, scores, strict=True)]


def extract(pages: DataFrame, model: dict | None) -> DataFrame:
    """Rows (page_id, url, text, n_chars) of pages (page_id, url, html)."""
    shared = pages.sparkSession.sparkContext.broadcast(model)  # some sixty trees of fixed depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "html", 1 << 20):
                texts = main_texts(part.column("html").to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(lean(run), "page_id long, url string, text string, n_chars long")


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, learn(pages))
