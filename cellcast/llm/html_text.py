"""Main text of HTML pages by a tree-structured graphical model.

A page becomes its tree of block elements.  Each node is content or not; what it is (tag, class
and id words, share of links, length of text) gives it a potential of its own, and potentials on
parent and child tie it to its neighbours, with one table for elements that divide a page and one
for those that hold its text.  One upward and one downward pass of sum-product messages give the
exact marginals, and the text of nodes with a marginal above one half is the main text.  The
potentials are fitted by maximum likelihood, with the same messages, to ``labelled_pages``.

Blocks are the runs of text between starts and ends of block elements.  Character references are
decoded, white space becomes one space, blocks are joined by one line break.

Defined results: a null or empty page gives an empty text; unclosed, stray and unknown tags never
fail; a page without markup is one block; rows are read one by one, so ties and repeated rows
repeat; a null ``page_id`` or ``url`` stays null; an empty table gives an empty table.  Pages of any
length are read whole, in time linear in it however broken their markup is; from a tag whose quotes
do not close, quotes are taken as plain characters of tags.  Of the table only ``page_id``, ``url``
and ``html`` are read, so other columns may have any name.
"""

from __future__ import annotations

import functools
import html
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cellcast.llm.common import sliced, tune

#: Fixed values of HTML: elements without an end, of raw text, that are never shown, and inline.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
HIDDEN = frozenset("head script style noscript template iframe svg math canvas object audio video select option datalist textarea button title xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: A start tag here ends an open element of the set beside it.
ENDS = {
    "p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"},
    "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}, "body": {"head"}, "option": {"option"},
}
#: No implied end reaches beyond these.
SCOPES = frozenset("html body article main section nav aside header footer div form table ul ol dl td th blockquote figure fieldset button".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())
DIVIDERS = frozenset("html body article main section nav aside header footer div form table tbody thead tfoot tr td ul ol dl fieldset details dialog center menu search".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_MARKUP = re.compile(r"<(?=[!?]|/?[a-zA-Z])")
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_NAME = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("tag", "attrs", "parent", "chars", "linked", "words", "label")

    def __init__(self, tag: str, attrs: str, parent: int):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.chars = self.linked = self.words = 0
        self.label = None


class Open:
    """The open elements of a page, with counts that tell without a search what is open where.

    A search through the stack is only made when it will find an element and close all above it,
    so that all searches of a page together pass each element once.
    """

    def __init__(self):
        self.stack: list[tuple[str, int]] = [("html", 0)]  # inline ones carry their block's node
        self.total: dict[str, int] = {}
        self.inline: list[dict[str, int]] = [{}]  # inline elements since each element that is not
        self.scopes: list[tuple[int, dict[str, int]]] = [(0, {})]  # place of each scope, and what is open in it

    def push(self, tag: str, node: int) -> None:
        self.stack.append((tag, node))
        self.total[tag] = self.total.get(tag, 0) + 1
        if tag in INLINE:
            self.inline[-1][tag] = self.inline[-1].get(tag, 0) + 1
        else:
            self.inline.append({})
        if tag in SCOPES:
            self.scopes.append((len(self.stack) - 1, {}))
        else:
            held = self.scopes[-1][1]
            held[tag] = held.get(tag, 0) + 1

    def pop(self) -> tuple[str, int]:
        tag, node = self.stack.pop()
        self.total[tag] -= 1
        if tag in INLINE:
            self.inline[-1][tag] -= 1
        else:
            self.inline.pop()
        if tag in SCOPES:
            self.scopes.pop()
        else:
            self.scopes[-1][1][tag] -= 1
        return tag, node

    def nearest(self, tags) -> int:
        """Place of the topmost open element of ``tags``, of which there is one."""
        return next(d for d in range(len(self.stack) - 1, 0, -1) if self.stack[d][0] in tags)

    def ended_by(self, tag: str) -> int | None:
        """Place of the element that an end tag closes; an inline one never reaches beyond its block."""
        held = self.inline[-1] if tag in INLINE else self.total
        return self.nearest((tag,)) if held.get(tag) else None

    def implied(self, ends) -> int | None:
        """Place of the nearest element of ``ends`` that is open in the scope, the scope itself included."""
        at, held = self.scopes[-1]
        if any(held.get(e) for e in ends):
            return self.nearest(ends)
        return at if at and self.stack[at][0] in ends else None


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Nodes in page order (a parent before its children), and (node, text) of every block."""
    nodes = [Node("html", "", -1)]
    open_ = Open()
    runs: list[tuple[int, list[str]]] = []
    pieces: list[str] = []
    owner = 0
    links = hidden = 0
    last_end, pattern = page.rfind(">"), _TAG

    def flush() -> None:
        nonlocal pieces
        if pieces:
            runs.append((owner, pieces))
            pieces = []

    def text(raw: str) -> None:
        if hidden or not raw:
            return
        if "&" in raw:
            raw = html.unescape(raw)
        pieces.append(raw)
        if links:
            nodes[owner].linked += len(raw.strip())

    def close(depth: int) -> None:
        """Pop open elements down to ``depth``."""
        nonlocal owner, links, hidden
        while len(open_.stack) > depth:
            tag, _ = open_.pop()
            if tag == "a":
                links -= 1
            elif tag in HIDDEN:
                hidden -= 1
            if tag not in INLINE and tag not in HIDDEN:
                flush()
                owner = open_.stack[-1][1]

    at, size = 0, len(page)
    shown = 0  # up to where the page's text has been taken
    while at < size:
        start = _MARKUP.search(page, at)
        if not start or (start.start() > last_end and not page.startswith("<!--", start.start())):
            break  # no tag ends after here
        at = start.start()
        if page.startswith("<!--", at):
            text(page[shown:at])
            end = page.find("-->", at + 4)
            at = shown = size if end < 0 else end + 3
            continue
        if page[at + 1] in "!?":
            text(page[shown:at])
            at = shown = page.find(">", at) + 1
            continue
        found = pattern.match(page, at)
        if not found and pattern is _TAG:
            pattern = _PLAIN_TAG
            found = pattern.match(page, at)
        if not found:
            at += 1
            continue
        text(page[shown:at])
        at = shown = found.end()
        tag = found[2].lower()
        if found[1]:
            depth = open_.ended_by(tag)
            if depth is not None:
                close(depth)
            elif tag == "p":
                flush()
            continue
        if tag in ENDS or tag in ENDS_P:
            ends = ENDS.get(tag, ()) or {"p"}
            while (depth := open_.implied(ends)) is not None:
                name = open_.stack[depth][0]
                close(depth)
                if tag == "p" or name not in ("td", "th"):
                    break
        if tag == "br":
            text(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        closed = found[3].endswith("/") and tag in ("svg", "math", "path", "iframe", "script")
        if tag in RAW and not closed:
            end = re.compile(rf"</{re.escape(tag)}\s*>?", re.I).search(page, at)
            at = shown = end.end() if end else size
            continue
        if closed:
            continue
        if tag in INLINE:
            if tag == "a":
                links += 1
            open_.push(tag, owner)
        elif tag in HIDDEN:
            hidden += 1
            open_.push(tag, owner)
        else:
            flush()
            nodes.append(Node(tag, found[3], owner))
            owner = len(nodes) - 1
            open_.push(tag, owner)
    text(page[shown:])
    flush()
    blocks = []
    for node, parts in runs:
        words = "".join(parts).split()
        if words:
            line = " ".join(words)
            nodes[node].chars += len(line)
            nodes[node].words += len(words)
            blocks.append((node, line))
    return nodes, blocks


def names(attrs: str) -> list[str]:
    """Words of class, id and role; hidden elements get a word of their own."""
    out = []
    for key, *values in _ATTR.findall(attrs):
        value = next((v for v in values if v), "")
        key = key.lower()
        if key in ("hidden", "aria-hidden"):
            out += ["~hidden"] if key == "hidden" or value.lower() == "true" else []
        elif key == "style":
            out += ["~hidden"] if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) else []
        else:
            out += _NAME.findall(_CAMEL.sub(" ", value).lower())
    return out


def features(nodes: list[Node]) -> list[list[str]]:
    """Named features of every node; sums over subtrees come from one backward pass."""
    chars, linked, words = ([getattr(n, k) for n in nodes] for k in ("chars", "linked", "words"))
    for i in range(len(nodes) - 1, 0, -1):
        p = nodes[i].parent
        chars[p] += chars[i]
        linked[p] += linked[i]
        words[p] += words[i]
    out = []
    for i, node in enumerate(nodes):
        found = ["bias", f"tag {node.tag}"]
        for name in names(node.attrs) if node.attrs else ():
            found.append(f"name {name}")
            if len(name) > 5:
                found.append(f"start {name[:5]}")
        n = words[i]
        found.append("words 0" if n == 0 else "words 1" if n < 4 else "words 2" if n < 12 else "words 3" if n < 40 else "words 4")
        if chars[i]:
            share = linked[i] / chars[i]
            found.append("links 0" if share < 0.05 else "links 1" if share < 0.4 else "links 2" if share < 0.75 else "links 3")
            part = chars[i] / chars[0]
            found.append("part 0" if part < 0.1 else "part 1" if part < 0.4 else "part 2" if part < 0.7 else "part 3" if part < 0.98 else "part 4")
            if node.chars:
                found.append("own 0" if node.chars < 0.5 * chars[0] else "own 1" if node.chars < chars[0] else "own 2")
        out.append(found)
    return out


def kind(tag: str) -> int:
    return 0 if tag in DIVIDERS else 1


def marginals(parents: list[int], kinds: list[int], unary: list[float], tables) -> list[float]:
    """Log-odds of content of every node: upward then downward sum-product on the tree.

    ``tables[kind][yp][yc]`` are log potentials of parent and child; ``unary`` are log-odds.
    """

    def soft(a: float, b: float) -> float:
        return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))

    n = len(parents)
    belief = list(unary)  # own potential and messages from children
    up = [0.0] * n
    for i in range(n - 1, 0, -1):
        t, x = tables[kinds[i]], belief[i]
        up[i] = soft(t[1][0], t[1][1] + x) - soft(t[0][0], t[0][1] + x)
        belief[parents[i]] += up[i]
    for i in range(1, n):
        t, x = tables[kinds[i]], belief[parents[i]] - up[i]
        belief[i] += soft(t[0][1], t[1][1] + x) - soft(t[0][0], t[1][0] + x)
    return belief


class Model:
    def __init__(self, weights: dict[str, float], tables):
        self.weights, self.tables = weights, tables

    def text(self, page: str | None) -> str:
        if not page:
            return ""
        nodes, blocks = parse(page)
        if not blocks:
            return ""
        weights = self.weights
        unary = [sum(weights.get(f, 0.0) for f in found) for found in features(nodes)]
        odds = marginals([n.parent for n in nodes], [kind(n.tag) for n in nodes], unary, self.tables)
        return "\n".join(line for node, line in blocks if odds[node] > 0)


#: Names that sites give to parts of a page; the labelled pages use them.
PARTS = {
    "menu": "nav menu navbar navigation topnav breadcrumb breadcrumbs pagination pager tabs toolbar links",
    "header": "header masthead site-header top topbar branding logo banner-top",
    "footer": "footer site-footer bottom colophon copyright legal credits",
    "side": "sidebar side aside widget widgets rail related recommended trending popular tags social share sharing",
    "notice": "notice cookie cookies consent cookie-banner gdpr alert popup modal overlay disclaimer message privacy announcement subscribe-notice paywall",
    "advert": "ad ads advert adverts advertisement adbox ad-slot banner promo promotion sponsor sponsored teaser offer",
    "form": "form search newsletter subscribe signup login contact-form feedback survey",
    "comments": "comments comment comment-list comment-body replies reply responses discussion disqus respond user-comments reader-comments",
}
CONTENT = "content main-content article post post-body post-content entry entry-content story story-body text body-text article-body main page-content prose".split()
WORDS = "river stone market winter letter garden people science music report engine history water school council summer paper village theory valley ship signal forest window bridge doctor island".split()


def labelled_pages(count: int = 400, seed: int = 7) -> list[tuple[str, list[str]]]:
    """Pages and the lines of their main text, made from a grammar of common page layouts."""
    rng = random.Random(seed)
    pages = []

    def sentence(low: int = 4, high: int = 14) -> str:
        return " ".join(rng.choice(WORDS) for _ in range(rng.randint(low, high))).capitalize() + "."

    def prose() -> str:
        return rng.choice(WORDS).capitalize() + "." if rng.random() < 0.15 else " ".join(sentence() for _ in range(rng.randint(1, 6)))

    def attr(words: str) -> str:
        return f'{rng.choice(("class", "class", "id"))}="{rng.choice(words.split())}"'

    def anchors(n: int) -> str:
        return "".join(f'<li><a href="/{rng.choice(WORDS)}">{rng.choice(WORDS)}</a></li>' for _ in range(n))

    def noise(part: str) -> str:
        own = {"menu": "nav", "header": "header", "footer": "footer", "side": "aside", "form": "form", "comments": "section"}.get(part, "div")
        bare = own not in ("div", "section") and rng.random() < 0.6
        tag = own if bare else rng.choice((own, "div", "section", "div"))
        start = f"<{tag}>" if bare else f"<{tag} {attr(PARTS[part])}>"
        if part == "menu":
            inner = f"<ul>{anchors(rng.randint(3, 8))}</ul>"
        elif part == "comments":
            inner = "<h3>Comments</h3>" * rng.randint(0, 1) + "".join(rng.choice(("<p>{0}</p>", '<div class="comment"><p>{0}</p></div>', "<li><p>{0}</p></li>", "<article class='comment'><p>{0}</p></article>")).format(prose()) for _ in range(rng.randint(1, 6)))
        elif part == "form":
            inner = f"<p>{sentence()}</p><label>{rng.choice(WORDS)}</label><input><button>Send</button>"
        elif part in ("side", "header"):
            inner = rng.choice((f"<h3>{rng.choice(WORDS)}</h3><ul>{anchors(4)}</ul>", f"<p>{prose()}</p>", sentence(), f"<h2>{rng.choice(WORDS)}</h2><p>{sentence()}</p>", f"<div>{sentence()}</div>", f"<{'h1' if part == 'header' else 'h4'}>{sentence(1, 3)}</{'h1' if part == 'header' else 'h4'}>"))
        else:
            inner = rng.choice((sentence(), prose(), f"<p>{prose()}</p>", f'&copy; {rng.choice(WORDS)} &middot; {sentence()}', f"<p>{sentence()}</p><a href='/'>{rng.choice(WORDS)}</a>"))
        return f"{start}{inner}</{tag}>"

    for _ in range(count):
        lines: list[str] = []

        def keep(line: str, lines=lines) -> str:
            lines.append(line)
            return line

        body = [f"<h1>{keep(sentence(2, 8))}</h1>"] if rng.random() < 0.8 else []
        for _ in range(rng.choice((1, 1, 2, 3, 5, 8, 12))):
            pick = rng.random()
            if pick < 0.68:
                body.append(f"<p>{keep(prose())}</p>")
            elif pick < 0.74:
                body.append(f"<p><b>{keep(prose())}<br>")
            elif pick < 0.80:
                body.append(f"<h2>{keep(sentence(1, 5))}</h2>")
            elif pick < 0.84:
                body.append("<ul>" + "".join(f"<li>{keep(sentence(1, 9))}</li>" for _ in range(rng.randint(1, 5))) + "</ul>")
            elif pick < 0.87:
                body.append(f"<blockquote>{keep(prose())}</blockquote>")
            elif pick < 0.89:
                body.append(f"<div>{keep(prose())}</div>")
            elif pick < 0.91:
                body.append(f"<figure><img src='a.png'><figcaption>{keep(sentence(2, 8))}</figcaption></figure>")
            elif pick < 0.93:
                body.append("<table>" + "".join(f"<tr><td>{keep(rng.choice(WORDS))}</td><td>{keep(rng.choice(WORDS))}</td></tr>" for _ in range(rng.randint(1, 4))) + "</table>")
            elif pick < 0.95:
                first, second = rng.choice(WORDS), sentence()
                keep(f"{first} {second}")
                body.append(f"<p><a href='/x'>{first}</a> {second}</p>")
            else:
                body.append(noise(rng.choice(("side", "advert", "advert", "form", "notice", "menu"))))
        if rng.random() < 0.15:  # nothing but text, or bare paragraphs
            plain = "".join(body) if rng.random() < 0.6 else f"{keep(prose())}" if not lines else None
            if plain is None:
                lines.clear()
                plain = keep(prose())
            pages.append((rng.choice(("{}", "<html><body>{}</body></html>", "<div>{}</div>")).format(plain), lines))
            continue
        tag = rng.choice(("article", "article", "article", "main", "div", "section"))
        start = f"<{tag}>" if tag in ("article", "main") and rng.random() < 0.7 else f'<{tag} {attr(" ".join(CONTENT))}>'
        inner = f"{start}{''.join(body)}</{tag}>"
        if rng.random() < 0.2:
            inner = f"<main>{inner}{noise('comments') if rng.random() < 0.5 else ''}</main>"
        before = [noise(p) for p in ("header", "menu", "notice", "advert", "side", "form") if rng.random() < 0.5]
        after = [noise(p) for p in ("side", "comments", "advert", "notice", "form", "footer", "footer", "menu") if rng.random() < 0.5]
        whole = "".join(before) + inner + "".join(after)
        if rng.random() < 0.3:
            whole = f'<div class="{rng.choice(("wrapper", "container", "page", "site", "row", "layout", "app"))}">{whole}</div>'
        pages.append((f"<!DOCTYPE html><html><head><title>{lines[0] if lines else ""}</title><style>p{{}}</style></head><body>{whole}</body></html>", lines))
    return pages


def labels(page: str, lines: list[str]) -> tuple[list[Node], list[int]]:
    """Nodes of a labelled page: content when most of the text below them is."""
    nodes, blocks = parse(page)
    good, all_ = [0] * len(nodes), [0] * len(nodes)
    at = 0
    for node, line in blocks:
        all_[node] += len(line)
        if at < len(lines) and line == " ".join(lines[at].split()):
            good[node] += len(line)
            at += 1
    for i in range(len(nodes) - 1, 0, -1):
        p = nodes[i].parent
        good[p] += good[i]
        all_[p] += all_[i]
    return nodes, [int(2 * g > a) for g, a in zip(good, all_)]


def beliefs(parent: np.ndarray, kinds: np.ndarray, levels: list[np.ndarray], unary: np.ndarray, t: np.ndarray):
    """Sum-product over many trees at once: log-odds of the nodes, and of pairs of each edge.

    ``levels`` has the nodes of each depth; a level's messages are computed together.  The second
    result has, for each node but the roots, log potentials (yp, yc) of its parent and itself.
    """
    soft = np.logaddexp
    up, belief = np.zeros(len(unary)), unary.copy()
    for at in reversed(levels[1:]):
        k, x = t[kinds[at]], belief[at]
        up[at] = soft(k[:, 1, 0], k[:, 1, 1] + x) - soft(k[:, 0, 0], k[:, 0, 1] + x)
        np.add.at(belief, parent[at], up[at])
    inner, outer = belief.copy(), np.zeros(len(unary))
    for at in levels[1:]:
        k, x = t[kinds[at]], belief[parent[at]] - up[at]
        outer[at] = x
        belief[at] += soft(k[:, 0, 1], k[:, 1, 1] + x) - soft(k[:, 0, 0], k[:, 1, 0] + x)
    pairs = t[kinds] + outer[:, None, None] * np.array([0, 1])[None, :, None] + inner[:, None, None] * np.array([0, 1])[None, None, :]
    return belief, pairs


@functools.cache
def trained(count: int = 1_500, rounds: int = 400, ridge: float = 2e-5, rate: float = 0.15) -> Model:
    """Maximum likelihood: the gradient is what the model expects less what the labels show."""
    index: dict[str, int] = {}
    rows, cols, y, parent, kinds, depth = [], [], [], [], [], []
    for page, lines in labelled_pages(count):
        nodes, marks = labels(page, lines)
        base = len(y)
        for i, (node, found) in enumerate(zip(nodes, features(nodes))):
            for f in found:
                rows.append(base + i)
                cols.append(index.setdefault(f, len(index)))
            parent.append(base + max(node.parent, 0))
            depth.append(depth[base + node.parent] + 1 if i else 0)
            kinds.append(kind(node.tag))
        y += marks
    rows, cols, y, parent, kinds, depth = (np.array(x) for x in (rows, cols, y, parent, kinds, depth))
    levels = [np.flatnonzero(depth == d) for d in range(depth.max() + 1)]
    below = np.flatnonzero(depth > 0)
    shown = np.zeros((2, 2, 2))
    np.add.at(shown, (kinds[below], y[parent[below]], y[below]), 1)
    w, t = np.zeros(len(index)), np.zeros((2, 2, 2))
    memory = [np.zeros_like(x) for x in (w, w, t, t)]
    for step in range(1, rounds + 1):  # Adam on the full batch
        belief, pairs = beliefs(parent, kinds, levels, np.bincount(rows, w[cols], len(y)), t)
        error = 1 / (1 + np.exp(-np.clip(belief, -30, 30))) - y
        chance = np.exp(pairs[below] - pairs[below].max(axis=(1, 2), keepdims=True))
        chance /= chance.sum(axis=(1, 2), keepdims=True)
        expected = np.array([chance[kinds[below] == k].sum(axis=0) for k in (0, 1)])
        for value, grad, m, v in ((w, np.bincount(cols, error[rows], len(w)) / len(y) + ridge * w, *memory[:2]), (t, (expected - shown) / len(y) + ridge * t, *memory[2:])):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model({f: float(w[i]) for f, i in index.items()}, tuple(tuple(map(tuple, x)) for x in t.tolist()))


def extractor(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "html"):
            texts = [model.text(page) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract_text(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` of every row of ``pages``; nothing is shuffled."""
    tune(pages.sparkSession)
    return pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html")).mapInArrow(extractor(trained()), "page_id long, url string, text string, n_chars long")
