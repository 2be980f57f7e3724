"""Operator 3: main text of web pages by sum-product message passing on the tree of blocks."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text up to their end tag, and is never prose: scripts, styles, the page's title, form fields.
RAW = frozenset("script style title textarea template".split())
#: Choices of a form; without an end tag they go on while options do.
CHOICE = frozenset("select datalist".split())
BLOCK = (
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th blockquote pre figure figcaption "
    "header footer nav aside form fieldset address details summary dialog center hgroup menu search caption #inline"
).split()
BLOCK_ID = {name: i for i, name in enumerate(BLOCK)}
CLOSES_P = frozenset(BLOCK) - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
ROWS = frozenset("tr tbody thead tfoot".split())
MAIN = frozenset({"article", "main"})
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SCOPE = frozenset("ul ol dl table html body article section div main aside nav form header footer menu".split())

#: Words in class, id and role that hint at either side.
HINTS = (
    ("nav menu navbar breadcrumb breadcrumbs toolbar tabs pager pagination skip", 0),
    ("header masthead banner topbar logo branding", 1),
    ("footer copyright legal colophon imprint", 2),
    ("sidebar aside widget related recommended", 3),
    ("ad ads advert advertisement sponsor sponsored promo promotion promoted", 4),
    ("comment comments reply replies response responses discussion disqus respond feedback", 5),
    ("notice cookie cookies consent gdpr alert popup modal overlay dialog paywall", 6),
    ("form search login signup subscribe newsletter share social sharing", 7),
    ("article post entry story content main body text prose", 8),
)
HINT = {word: group for words, group in HINTS for word in words.split()}
N_HINTS = len(HINTS)
#: Groups whose words make a block of an inline element, named #inline: adverts and comments.
INSETS = frozenset({4, 5})
#: A heading of at most so many words names the block that it is in.
TITLE_WORDS = 4

#: Comments, declarations, CDATA, stray ends, tags. A quotation mark opens a value only after an equals sign.
TAG = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</(?:>|[^a-zA-Z>][^>]*>?)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z)", re.S
)
NAMED = re.compile(r"(?:^|[\s\"'/])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
PIECES = re.compile(r"[a-z]+")
OPTIONS = re.compile(r"(?:[^<]|<(?:/?(?:option|optgroup|hr)\b[^>]*>|!--.*?-->|[^a-zA-Z/!?]))*", re.I | re.S)

N_FEATURES = len(BLOCK) + 3 * N_HINTS + 2 + 12


class Open:
    """The open elements, with the places of each name, so that no tag walks through all of them."""

    __slots__ = ("blocks", "items", "places")

    def __init__(self):
        self.items: list[tuple[str, int]] = [("#top", 0)]
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []  # places of block elements

    def push(self, name: str, block: int) -> None:
        self.places.setdefault(name, []).append(len(self.items))
        if name in BLOCK_ID:
            self.blocks.append(len(self.items))
        self.items.append((name, block))

    def cut(self, to: int) -> None:
        while len(self.items) > to:
            name, _ = self.items.pop()
            self.places[name].pop()
            if name in BLOCK_ID:
                self.blocks.pop()

    def last(self, names) -> int:
        """Place of the innermost open element of these names, 0 if there is none."""
        return max((p[-1] for n in names if (p := self.places.get(n))), default=0)

    def close(self, names: set) -> None:
        """End the nearest open element of these names within the present scope."""
        at = self.last(names)
        if at > self.last(SCOPE) and ("tr" in names or at > self.last(ROWS)):
            self.cut(at)

    @property
    def linked(self) -> bool:
        return bool(self.places.get("a"))


class Page:
    """Blocks of a page in document order, each with its parent, and the text pieces in page order."""

    __slots__ = ("links", "name", "own", "parent", "pieces", "titled")

    def __init__(self, source: str):
        self.parent, self.name, self.links, self.own = [-1], [("body", frozenset())], [0], [0]
        self.pieces: list[tuple[int, str]] = []
        opened, at, end, unended = Open(), 0, len(source), set()
        while at < end:
            m = TAG.search(source, at)
            stop = m.start() if m else end
            block = opened.items[-1][1]
            if stop > at:
                self.text(block, source[at:stop], opened.linked)
            if not m:
                break
            at, name = m.end(), m.group(2)
            if name is None:
                if m.group().startswith("<![CDATA["):
                    self.text(block, m.group()[9:].removesuffix("]]>"), opened.linked)
                continue
            name = name.lower()
            if m.group(1):
                depth = opened.last((name,))
                if name == "br" or name == "p" and not depth:
                    self.gap(block)
                if depth and (name in BLOCK_ID or depth > (opened.blocks[-1] if opened.blocks else 0)):
                    opened.cut(depth)
                if name in BLOCK_ID:
                    self.gap(opened.items[-1][1])
                continue
            attrs = m.group(3)
            if name in RAW or name in CHOICE:
                close = None if name in unended else re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                if close:
                    at = close.end()
                elif name in CHOICE:
                    unended.add(name)
                    at = OPTIONS.match(source, at).end()
                elif name != "template":
                    at = end
                self.gap(block)
            elif name == "head":
                close = re.compile(r"</head\s*>|<body\b", re.I).search(source, at)
                at = at if not close else close.end() if close.group()[1] == "/" else close.start()
            elif name in VOID:
                if name in ("br", "hr"):
                    self.gap(block)
            elif name in ("html", "body"):
                opened.close({"p"})
            elif name in BLOCK_ID:
                if name in CLOSES_P:
                    opened.close({"p"})
                if name in CLOSED_BY:
                    opened.close(CLOSED_BY[name])
                if name in HEADINGS and opened.items[-1][0] in HEADINGS:
                    opened.cut(len(opened.items) - 1)
                block = self.block(opened.items[-1][1], name, self.hints(attrs))
                self.gap(block)
                opened.push(name, block)
            elif not attrs.endswith("/"):
                hints = self.hints(attrs)
                opened.push(name, self.block(block, "#inline", hints) if hints & INSETS else block)
        self.titled = self.titles()

    def block(self, parent: int, name: str, hints: frozenset) -> int:
        self.parent.append(parent)
        self.name.append((name, hints))
        self.links.append(0)
        self.own.append(0)
        return len(self.parent) - 1

    def titles(self) -> dict[int, frozenset]:
        """Hints in the brief headings of a block, by block. The page's own title, h1, is none of them."""
        heads: dict[int, str] = {}
        for block, text in self.pieces:
            if self.name[block][0] in HEADINGS and self.name[block][0] != "h1" and len(heads.get(block, "")) < 80:
                heads[block] = heads.get(block, "") + text[:80]
        out: dict[int, frozenset] = {}
        for block, text in heads.items():
            words = PIECES.findall(text.lower())
            if len(words) <= TITLE_WORDS and (found := frozenset(HINT[w] for w in words if w in HINT)):
                out[self.parent[block]] = out.get(self.parent[block], frozenset()) | found
        return out

    @staticmethod
    def hints(attrs: str) -> frozenset:
        if "=" not in attrs:
            return frozenset()
        words = " ".join(a or b or c for a, b, c in NAMED.findall(attrs)).lower()
        return frozenset(HINT[w] for w in PIECES.findall(words) if w in HINT)

    def gap(self, block: int) -> None:
        self.pieces.append((block, " "))

    def text(self, block: int, raw: str, linked: bool) -> None:
        if "&" in raw:
            raw = entities.unescape(raw)
        self.pieces.append((block, raw))
        n = len(raw) - raw.count(" ")
        self.own[block] += n
        if linked:
            self.links[block] += n

    def main_text(self, content: np.ndarray) -> str:
        """Pieces of content blocks; a piece left out stands for a gap."""
        return " ".join("".join(t if content[b] else " " for b, t in self.pieces).split())


#: Depth up to which a forest's blocks are worked level by level.
DEEP = 64


class Forest:
    """The trees of many pages laid end to end, with features of every block."""

    def __init__(self, pages: list[Page]):
        size = [len(p.parent) for p in pages]
        self.start = np.concatenate([[0], np.cumsum(size)])
        root = np.repeat(self.start[:-1], size)
        local = np.concatenate([np.array(p.parent) for p in pages])
        self.parent = np.where(local < 0, -1, local + root)
        n = len(local)
        depth = np.zeros(n, int)
        for p, lo in zip(pages, self.start):  # parents precede children
            own = p.parent
            d = [0] * len(own)
            for i in range(1, len(own)):
                d[i] = d[own[i]] + 1
            depth[lo : lo + len(own)] = d
        # Shallow blocks go level by level; what lies deeper is few and goes one by one, children after parents.
        order = np.argsort(depth, kind="stable")
        cut = np.searchsorted(depth[order], np.arange(1, min(int(depth.max(initial=0)), DEEP) + 2))
        self.levels = [order[lo:hi] for lo, hi in zip(cut[:-1], cut[1:])]
        self.deep = np.sort(order[cut[-1] :]).tolist()
        own = np.concatenate([np.array(p.own, float) for p in pages])
        links = np.concatenate([np.array(p.links, float) for p in pages])
        below, below_links = own.copy(), links.copy()
        for i in reversed(self.deep):
            below[self.parent[i]] += below[i]
            below_links[self.parent[i]] += below_links[i]
        for level in reversed(self.levels):
            np.add.at(below, self.parent[level], below[level])
            np.add.at(below_links, self.parent[level], below_links[level])
        prose = below - below_links
        part = prose / np.maximum(np.repeat(prose[self.start[:-1]], size), 1)
        bulk = (part > 0.5).tolist()
        f = np.zeros((n, N_FEATURES), np.float32)
        tags, at = len(BLOCK), 0
        for p in pages:
            seen: list[frozenset] = []
            titled: list[frozenset] = []
            inside: list[bool] = []
            marked = any(name in MAIN and 5 not in hints for name, hints in p.name)
            for i, (name, hints) in enumerate(p.name):
                inside.append(name in MAIN and 5 not in hints or i > 0 and inside[p.parent[i]])
                f[at, -1] = marked and not inside[i]
                f[at, BLOCK_ID[name]] = 1
                up = seen[p.parent[i]] if i else frozenset()
                over = titled[p.parent[i]] if i else frozenset()
                if name in ROLE:
                    hints = hints | ROLE[name]
                for h in hints:
                    f[at, tags + h] = 1
                if not hints:
                    f[at, tags + N_HINTS] = 1
                # What holds most of a page's prose passes on that it is the article, or comments, and no other hint.
                seen.append(up | (hints & LASTING if bulk[at] else hints))
                titled.append(over if bulk[at] else over | p.titled.get(i, frozenset()))
                for h in up | hints:
                    f[at, tags + N_HINTS + 1 + h] = 1
                for h in titled[i]:
                    f[at, tags + 2 * N_HINTS + 2 + h] = 1
                at += 1
        share = below_links / np.maximum(below, 1)
        m = tags + 3 * N_HINTS + 2
        f[:, m] = 1
        f[:, m + 1] = np.log1p(own) / 4
        f[:, m + 2] = np.log1p(below) / 6
        f[:, m + 3] = share
        f[:, m + 4] = share > 0.6
        f[:, m + 5] = own > 60
        f[:, m + 6] = links > 0.6 * np.maximum(own, 1)
        f[:, m + 7] = np.minimum(depth, 8) / 8
        f[:, m + 8] = below == 0
        f[:, m + 9] = part
        f[:, m + 10] = part > 0.5
        self.features = f


ROLE = {"article": frozenset({8}), "main": frozenset({8}), "nav": frozenset({0}), "header": frozenset(), "footer": frozenset({2}), "aside": frozenset({3}), "form": frozenset({7}), "dialog": frozenset({6}), "search": frozenset({7}), "menu": frozenset({0})}

#: Groups that reach below a block of most of the prose: comments and the article.
LASTING = frozenset({5, 8})


class TreeModel:
    """Two states for each block; unary potentials from features, a 2 x 2 table on every parent-child edge."""

    def __init__(self, weights: np.ndarray, pair: np.ndarray):
        self.weights, self.pair = weights, pair

    def messages(self, forest: Forest) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Messages upward level by level, then downward: what each block gathers, sends to its parent, and is told."""
        z = forest.features @ self.weights
        unary = np.stack([np.zeros_like(z), z], 1).astype(float)
        up = unary.copy()  # a block's own potential and its children's messages
        sent = np.zeros_like(unary)
        for i in reversed(forest.deep):
            sent[i] = np.logaddexp(self.pair[:, 0] + up[i, 0], self.pair[:, 1] + up[i, 1])
            up[forest.parent[i]] += sent[i]
        for level in reversed(forest.levels):
            sent[level] = np.logaddexp(self.pair[:, 0] + up[level, :1], self.pair[:, 1] + up[level, 1:])
            np.add.at(up, forest.parent[level], sent[level])
        down = np.zeros_like(unary)
        for level in forest.levels:
            above = forest.parent[level]
            rest = up[above] + down[above] - sent[level]
            down[level] = np.logaddexp(rest[:, :1] + self.pair[0], rest[:, 1:] + self.pair[1])
        for i in forest.deep:
            rest = up[forest.parent[i]] + down[forest.parent[i]] - sent[i]
            down[i] = np.logaddexp(rest[0] + self.pair[0], rest[1] + self.pair[1])
        return up, sent, down

    def marginals(self, forest: Forest) -> np.ndarray:
        """P(content) of every block, exactly."""
        up, _, down = self.messages(forest)
        both = up + down
        return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500)))

    def statistics(self, forest: Forest) -> tuple[np.ndarray, np.ndarray]:
        """P(content) of every block, and the expected number of parent-child pairs in each two states."""
        up, sent, down = self.messages(forest)
        both = up + down
        child = np.flatnonzero(forest.parent >= 0)
        above = forest.parent[child]
        joint = (both[above] - sent[child])[:, :, None] + self.pair + up[child][:, None, :]
        joint = np.exp(joint - joint.max((1, 2), keepdims=True))
        return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500))), (joint / joint.sum((1, 2), keepdims=True)).sum(0)

    @classmethod
    def train(cls, pages: list[Page], labels: list[np.ndarray], steps: int = 400, rate: float = 0.1, decay: float = 5e-5) -> TreeModel:
        """Maximum likelihood: observed minus expected statistics, the expectation exact from the messages."""
        forest, y = Forest(pages), np.concatenate(labels).astype(float)
        child = np.flatnonzero(forest.parent >= 0)
        x, yi = forest.features.astype(float), y.astype(int)
        met = np.bincount(2 * yi[forest.parent[child]] + yi[child], minlength=4).reshape(2, 2)
        values = np.zeros(N_FEATURES + 4)  # feature weights, then the pair table
        first, second = np.zeros_like(values), np.zeros_like(values)
        for step in range(1, steps + 1):
            p, pairs = cls(values[:-4], values[-4:].reshape(2, 2)).statistics(forest)
            grad = np.concatenate([x.T @ (y - p), (met - pairs).ravel()]) / len(y) - decay * values
            first += 0.1 * (grad - first)
            second += 0.01 * (grad**2 - second)
            values = values + rate * (1 - 0.9 * step / steps) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
        return cls(values[:-4].astype(np.float32), values[-4:].reshape(2, 2))


def labelled_pages(n: int = 1200, seed: int = 5, mislead: float = 0.0) -> tuple[list[Page], list[np.ndarray]]:
    """Training pages drawn from a grammar of common layouts; every block knows whether it is article text.
    `mislead` is the share of names that say nothing or point to the wrong side."""
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[rng.integers(len(x))]
    odds = lambda p: rng.random() < p

    def words(lo: int, hi: int) -> str:
        return " ".join("x" * int(k) for k in rng.integers(2, 11, rng.integers(lo, hi)))

    def links(k: int, tag: str = "li") -> str:
        return "".join(f"<{tag}><a href='/'>{words(1, 4)}</a></{tag}>" for _ in range(k))

    def named(*values: str) -> str:
        if odds(mislead):  # names that say nothing, or the wrong thing
            return pick("", "", f' class="{pick("block", "item", "c12", "inner", "panel-x")}"', f' class="{pick(*HINT)}"')
        return pick(f' class="{pick(*values)}"', f' id="{pick(*values)}"', f' class="{pick("box", "col", "wrap")} {pick(*values)}"')

    def menu() -> str:
        body = f"<ul>{links(rng.integers(3, 9))}</ul>"
        return pick(f"<nav>{body}</nav>", f"<div{named('nav', 'menu', 'navbar', 'breadcrumb')}>{body}</div>", f"<header>{pick('', '<h1>' + words(1, 3) + '</h1>')}<nav>{body}</nav></header>", f"<nav>{links(4, 'p')}</nav>", f"<div>{links(rng.integers(2, 7), pick('span', 'p', 'div'))}</div>")

    def head() -> str:
        return pick(f"<header><div{named('logo', 'branding')}>{words(1, 4)}</div><p>{words(3, 9)}</p></header>", f"<div{named('header', 'masthead', 'banner')}><h1>{words(1, 4)}</h1><p>{words(2, 12)}</p></div>")

    def foot() -> str:
        body = pick(f"&copy; {words(2, 8)}", f"<p>{words(4, 20)}</p><ul>{links(3)}</ul>", f"<p>&copy; {words(2, 6)}</p>")
        return pick(f"<footer>{body}</footer>", f"<div{named('footer', 'copyright', 'legal')}>{body}</div>")

    def side() -> str:
        body = pick(f"<h3>{words(1, 4)}</h3><ul>{links(4)}</ul>", f"<h4>{words(1, 4)}</h4><p>{words(5, 40)}</p>", f"<p>{words(8, 50)}</p><p>{words(8, 50)}</p>")
        return pick(f"<aside>{body}</aside>", f"<div{named('sidebar', 'related', 'widget', 'rail')}>{body}</div>", f"<section{named('related', 'sidebar', 'recommended')}>{body}</section>")

    def advert() -> str:
        name = named("ad", "ads", "advert", "sponsored", "promo")
        return pick(f"<div{name}>{words(3, 30)}</div>", f"<div{name}><p>{words(3, 40)}</p></div>", f"<section{name}><a href='/'>{words(3, 9)}</a></section>", f"<aside{name}><p>{words(4, 30)}</p></aside>")

    def notice() -> str:
        name = named("cookie", "notice", "consent", "popup", "alert", "modal", "cookie-notice", "gdpr-message")
        return pick(f"<div{name}>{words(5, 40)}</div>", f"<div{name}><p>{words(5, 40)}</p></div>", f"<section{name}><p>{words(5, 40)}</p><p>{words(2, 9)}</p></section>", f"<dialog><p>{words(5, 20)}</p></dialog>")

    def form() -> str:
        body = pick(f"<p>{words(2, 12)}</p><input name=q>", f"<label>{words(1, 4)}</label><input name=q>", f"<div>{words(3, 15)}</div>")
        return pick(f"<form>{body}</form>", f"<div{named('newsletter', 'subscribe', 'search', 'login', 'share', 'social')}>{body}</div>", f"<form{named('search', 'login', 'newsletter')}>{body}</form>")

    def comments() -> str:
        one = lambda: pick(f"<p>{words(3, 60)}</p>", f"<div class='comment'><p>{words(3, 60)}</p></div>", f"<article class='comment'><h4>{words(1, 3)}</h4><p>{words(3, 60)}</p></article>", f"<li><p>{words(3, 40)}</p></li>")
        body = pick("", f"<h3>{words(1, 3)}</h3>", f"<h{(k := pick(2, 3, 4))}>{pick('Comments', '3 comments', 'Reader comments', 'Replies', 'Discussion', '7 responses')}</h{k}>") + "".join(one() for _ in range(rng.integers(1, 6)))
        if body.startswith(("<h2", "<h4")) and odds(0.5):
            return f"<{(t := pick('section', 'div'))}{pick('', ' class=box', ' class=user-area', ' id=c2')}>{body}</{t}>"
        return pick(f"<section{named('comments', 'discussion', 'replies', 'reader-comments')}>{body}</section>", f"<div{named('comments', 'comment-list', 'respond')}>{body}</div>", f"<ul class='comments'>{body}</ul>")

    def junk() -> str:
        return pick(menu, head, foot, side, advert, notice, form)()

    def prose(inner: bool = True) -> str:
        out = [pick("", f"<h1>{words(2, 12)}</h1>", f"<header><h1>{words(2, 12)}</h1></header>", f"<h2>{words(2, 9)}</h2>")]
        if odds(0.2):
            out.append(f"<p>{words(1, 5)}</p>" * rng.integers(3, 25))
        for _ in range(rng.integers(1, 9)):
            out.append(
                pick(
                    f"<p>{words(10, 120)}</p>", f"<p>{words(10, 120)}</p>", f"<p>{words(1, 9)}</p>", f"<p><b>{words(1, 9)}<br>", f"<p>{words(9, 60)} <a href='/'>{words(1, 4)}</a> {words(3, 50)}</p>",
                    f"<h2>{words(1, 9)}</h2>", f"<ul><li>{words(2, 30)}</li><li>{words(2, 30)}</li></ul>", f"<ol><li>{words(2, 20)}<li>{words(2, 20)}</ol>", f"<blockquote><p>{words(5, 50)}</p></blockquote>",
                    f"<blockquote>{words(5, 50)}</blockquote>", f"<pre>{words(3, 30)}</pre>", f"<table><tr><td>{words(1, 6)}</td><td>{words(1, 6)}</td></tr></table>", f"<figure><figcaption>{words(3, 14)}</figcaption></figure>", f"<div>{words(10, 90)}</div>", f"<section><h3>{words(1, 6)}</h3><p>{words(9, 80)}</p></section>",
                )
            )
            if odds(0.05):
                mark = pick("advert", "ad", "sponsored", "promo", "comment", "comments-count")
                out.append(f"<p>{words(5, 40)} \x00<{(t := pick('span', 'a', 'b'))} class='{mark}'>{words(1, 9)}</{t}>\x01 {words(5, 40)}</p>")
            if inner and odds(0.2):
                out.append("\x00" + pick(advert, side, form, notice)() + "\x01")
        return "".join(out)

    pages, labels = [], []
    for _ in range(n):
        body = prose()
        if odds(mislead):  # a frame with a name of the other side
            body = f"<{(t := pick('section', 'div'))} {pick('class', 'id')}='{pick(*HINT)}'>{body}</{t}>"
        main = pick(
            f"<article>{body}</article>", f"<article>{body}</article>", f"<main>{body}</main>", f"<main><article>{body}</article></main>", f"<div{named('content', 'post', 'article', 'entry', 'story', 'main')}>{body}</div>",
            f"<div class='wrap'><article{named('post', 'entry')}><div class='body'>{body}</div></article></div>", f"<div>{body}</div>", f"<section{named('content', 'story')}>{body}</section>", body, words(20, 120),
        )
        if odds(mislead):
            main = main.replace("<article>", f"<article class='post {pick(*HINT)}'>", 1)
        if odds(0.25):
            main = main.replace("</article>", "\x00" + comments() + "\x01</article>", 1)
        parts = ["\x00" + junk() + "\x01" for _ in range(rng.integers(0, 4))] + ["\x02" + main + "\x03"] + ["\x00" + pick(junk, comments, foot)() + "\x01" for _ in range(rng.integers(0, 4))]
        source = "<html><head><title>t</title></head><body>" + "".join(parts) + "</body></html>"
        page = Page(source)
        # The marks are text: a block is content if its first text lies in the article and in no inset.
        inside = inset = 0
        own, gap = np.full(len(page.parent), -1), np.full(len(page.parent), -1)
        for block, text in page.pieces:
            for c in text:
                inside += {"\x02": 1, "\x03": -1}.get(c, 0)
                inset += {"\x00": 1, "\x01": -1}.get(c, 0)
                if c == "x" and own[block] < 0:
                    own[block] = int(inside > 0 and inset <= 0)
            if gap[block] < 0:
                gap[block] = int(inside > 0 and inset <= 0)
        own = np.where(own < 0, gap, own)
        own[0] = max(own[0], 0)
        for i in range(len(own) - 1, 0, -1):  # a frame of blocks is content if any of them is
            if own[i] == 1 and own[page.parent[i]] < 0:
                own[page.parent[i]] = 1
        clean = Page(re.sub("[\x00-\x03]", "", source))
        if len(clean.parent) == len(own):
            pages.append(clean)
            labels.append((own == 1).astype(int))
    return pages, labels


@lru_cache(1)
def model() -> TreeModel:
    return TreeModel.train(*labelled_pages(mislead=0.1))


def extract_texts(sources: list[str], tree: TreeModel) -> list[str]:
    pages = [Page(s) for s in sources]
    if not pages:
        return []
    forest = Forest(pages)
    content = tree.marginals(forest) > 0.5
    return [p.main_text(content[lo:hi]) for p, lo, hi in zip(pages, forest.start[:-1], forest.start[1:])]


def extract(pages: DataFrame, columns: tuple[str, ...] = ("page_id", "url"), source: str = "html") -> DataFrame:
    """The given columns, text and n_chars (code points) of every page.

    A null or empty page, or one without an article, has an empty text; hidden elements are text like others; broken or
    cut markup is read as far as it goes, and so is nesting of any depth; repeated rows are read one by one; an empty table gives none; other columns
    are ignored. The model is trained once, on the driver, from generated labelled pages.
    """
    weights, pair = model().weights, model().pair

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = TreeModel(weights, pair)
        for batch in batches:
            out: list[str] = []
            room: list[str] = []
            for value in batch.column(len(columns)):
                room.append(value.as_py() or "")
                if len(room) == 64:
                    out += extract_texts(room, tree)
                    room = []
            out += extract_texts(room, tree)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(columns))), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], [*columns, "text", "n_chars"])

    picked = pages.select(*columns, source)
    schema = picked.select(*columns).schema.add("text", "string").add("n_chars", "long")
    return picked.mapInArrow(scan, schema)
