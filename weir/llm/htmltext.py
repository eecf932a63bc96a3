"""Main text of web pages by a tree-structured graphical model.

The block elements of a page form a tree; each has a hidden state, boilerplate
or content.  A node's potential is linear in its features (tag, class and id
words, text, links), an edge's potential is a learned table over the states of
parent and child.  Sum-product messages go up from the leaves and down from the
root once each and give every node its exact content marginal; the text of the
nodes with a marginal of at least ``THRESHOLD`` is kept, in page order.

The weights are fitted by gradient ascent on the conditional likelihood of
labelled pages (observed minus expected feature counts, the latter from the
same messages).  The labelled pages are written by :func:`labelled_pages`: a
fixed, seeded number of layouts whose parts carry their label.

Messages run over whole blocks of pages at once, level by level of the forest.

Inline elements belong to the block around them unless their class says
otherwise.  Character references are decoded, white space becomes one space,
block boundaries and line breaks count as white space.

Edge cases: null or empty html, and html without content, give the empty
string; unclosed and stray tags are tolerated; elements nested deeper than
``MAX_DEPTH`` are siblings; nothing is dropped for its length; repeated rows and
null ids are passed along, kept columns named like a result get underscores in
front.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm.common import kept_as, small_batches, table
from weir.llm.langid import text_blocks

THRESHOLD = 0.5
LABELLED_PAGES = 300
STEPS = 300
DECAY = 0.002

#: Elements by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Scripts, styles and form controls, whose inside is no text of the page, and what holds raw text only.
RAW = frozenset("script style template textarea select iframe title".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot semantics annotation svg g text tspan".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
TAGS = "html head body header nav main article section aside footer form div p h1 h2 h3 h4 ul ol li dl dt dd table tr td th blockquote pre figure figcaption button address inline".split()
ASIDE = frozenset(("nav", "aside", "footer", "form"))  # elements that speak against content as words do
#: Words of class, id, role and aria-label that speak against and for content.
AGAINST = frozenset("ad ads adv advert advertisement advertising adbox alert banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies copyright disclaimer discussion disqus feedback foot footer form gdpr head header legal login masthead menu meta modal nav navbar navigation newsletter notice notification overlay pager pagination paywall popup promo promoted promotion rail recommended related replies reply respond response responses search share sharing side sidebar signup skip social sponsor sponsored subscribe tags toolbar topbar toc warning widget".split())
IN_FAVOUR = frozenset("article articlebody body content entry main maincontent page post postbody prose story storybody text".split())

#: The rest of a tag after its name: quoted values may hold ``>``.
_TAG_END = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_ATTR = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>]++)))?""")
_READ = frozenset(("class", "id", "role", "aria-label"))
_LONG_NUMBER = re.compile(r"&#0*+([0-9]{8,}+);?")
_LEADING_ZEROS = re.compile(r"&#0++(?=[0-9])")
#: Elements nested deeper hang under the one at this depth, as in browsers.
MAX_DEPTH = 512
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_SENTENCE = re.compile(r"[.!?…。](?:\s|$)")


def tokens(html: str) -> Iterator[tuple[int, int, str | None, bool, str]]:
    """Markup in page order: (start, end, element name or None, whether it closes, attributes).

    Each character is scanned a bounded number of times, whatever is missing:
    a tag whose quotes don't close ends at the next ``>``, one without any
    ``>`` is dropped with what follows it, as is an open comment.  Who reads
    the tokens may send back a position to go on at.
    """
    at, size = 0, len(html)
    while (at := html.find("<", at)) >= 0:
        start = at
        sent = None
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            at = end + 3 if end >= 0 else size
            sent = yield start, at, None, False, ""
        elif html.startswith(("<!", "<?"), at):
            end = html.find(">", at)
            at = end + 1 if end >= 0 else size
            sent = yield start, at, None, False, ""
        else:
            closes = html.startswith("</", at)
            name = _NAME.match(html, at + 1 + closes)
            if name is None:
                at += 1
                continue
            rest = _TAG_END.match(html, name.end())
            end = rest.end() if rest else html.find(">", name.end()) + 1
            at = end or size
            sent = yield start, at, name[0].lower(), closes, html[name.end() : at - 1] if end else ""
        if sent is not None:
            at = sent


def decoded(raw: str) -> str:
    """``raw`` with character references decoded; numbers beyond all characters are U+FFFD."""
    if "&" not in raw:
        return raw
    if "&#" in raw:
        raw = _LONG_NUMBER.sub("\ufffd", _LEADING_ZEROS.sub("&#", raw))
    return unescape(raw)


#: Where a raw element ends; only A-Z and a-z are alike in names.
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+(?:>|\Z)", re.I | re.A) for name in RAW}
#: An element of the first kind ends an open one of the others.
PEERS = {"li": ("li",), "tr": ("tr",), "option": ("option",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}


class Page:
    """Blocks of one page: parents, tags, cues and the text runs with the block each belongs to.

    ``labelled`` pages carry the state of a block in ``data-label``.
    """

    def __init__(self, html: str, labelled: bool = False) -> None:
        self.parent, self.tag, self.against, self.favour, self.label = [-1], ["html"], [0], [0], [-1]
        self.depth = [0]
        self.runs: list[tuple[int, str]] = []
        self.links: dict[int, int] = {}
        self._read(html, labelled)

    def _open(self, parent: int, tag: str, against: int, favour: int, label: int) -> int:
        if self.depth[parent] >= MAX_DEPTH:
            parent = self.parent[parent]
        for own, x in ((self.parent, parent), (self.tag, tag), (self.against, against), (self.favour, favour), (self.label, label), (self.depth, self.depth[parent] + 1)):
            own.append(x)
        return len(self.parent) - 1

    def _read(self, html: str, labelled: bool) -> None:
        stack: list[tuple[str, int]] = [("html", 0)]  # open elements with their block
        opened: dict[str, int] = {}  # how many of each name are open
        at, runs = 0, self.runs
        body = False
        unclosed = set()  # raw elements without an end tag in the rest of the page

        def push(name: str, block: int) -> None:
            stack.append((name, block))
            opened[name] = opened.get(name, 0) + 1

        def need_body() -> None:
            """What stands in no other place is in the body, whether the page says so or not."""
            nonlocal body
            if not body and stack[-1][1] == 0:
                body = True
                push("body", self._open(0, "body", 0, 0, -1))

        def text(raw: str) -> None:
            if raw:
                if not raw.isspace():
                    need_body()
                block = stack[-1][1]
                raw = decoded(raw)
                runs.append((block, raw))
                if opened.get("a"):
                    self.links[block] = self.links.get(block, 0) + len(raw.strip())

        def close(name: str) -> None:
            if opened.get(name):
                while True:
                    gone = stack.pop()[0]
                    opened[gone] -= 1
                    if gone == name:
                        return

        reader = tokens(html)
        token = next(reader, None)
        while token is not None:
            start, end, name, closes, attributes = token
            text(html[at:start])
            at, skip = end, None
            if name is not None and closes:
                if name not in INLINE:
                    runs.append((stack[-1][1], "\n"))
                close(name)
            elif name is not None:
                if name not in INLINE:
                    runs.append((stack[-1][1], "\n"))
                if name in RAW:
                    if not attributes.endswith("/") and name not in unclosed:
                        tail = _RAW_END[name].search(html, at)
                        if tail is not None:
                            at = skip = tail.end()
                        elif name == "title":
                            unclosed.add(name)
                        else:
                            at = skip = len(html)
                elif not (name in VOID or name == "html" or name == "body" and body):
                    if name == "body":
                        body = True
                    elif name != "head":
                        need_body()
                    if opened.get("p") and name in ENDS_P:
                        close("p")
                    elif name in PEERS and (stack[-1][0] in PEERS[name] or stack[-1][0] in INLINE and any(s[0] in PEERS[name] for s in stack[-3:])):
                        close(next(s[0] for s in reversed(stack) if s[0] in PEERS[name]))
                    against, favour, label = int(name in ASIDE), 0, -1
                    for key, *values in _ATTR.findall(attributes):
                        key, value = key.lower(), values[0] or values[1] or values[2]
                        if key in _READ:
                            words = {w.lower() for w in _WORDS.findall(value)}
                            against += len(words & AGAINST)
                            favour += len(words & IN_FAVOUR)
                        elif labelled and key == "data-label":
                            label = int(value)
                    block = stack[-1][1]
                    if name not in INLINE or against:
                        block = self._open(block, name if name not in INLINE else "inline", against, favour, label)
                    push(name, block)
            try:
                token = reader.send(skip)
            except StopIteration:
                token = None
        text(html[at:])

    def features(self) -> np.ndarray:
        n = len(self.parent)
        chars, words, ends = np.zeros(n), np.zeros(n), np.zeros(n)
        for block, raw in self.runs:
            if raw != "\n":
                stripped = raw.strip()
                if stripped:
                    chars[block] += len(stripped)
                    words[block] += stripped.count(" ") + 1
                    ends[block] += len(_SENTENCE.findall(stripped))
        links = np.zeros(n)
        for block, size in self.links.items():
            links[block] = size
        below, below_links = chars.copy(), links.copy()
        parent = self.parent
        for k in range(n - 1, 0, -1):
            below[parent[k]] += below[k]
            below_links[parent[k]] += below_links[k]
        x = np.zeros((n, FEATURES))
        x[:, 0] = 1
        x[np.arange(n), [1 + _TAG_AT.get(t, len(TAGS)) for t in self.tag]] = 1
        a = len(TAGS) + 2
        x[:, a] = np.minimum(self.against, 2)
        x[:, a + 1] = np.minimum(self.favour, 2)
        x[:, a + 2] = np.log1p(np.minimum(chars, 2000)) / 4
        x[:, a + 3] = chars > 0
        x[:, a + 4] = links / np.maximum(chars, 1)
        x[:, a + 5] = np.minimum(ends, 5) / 5
        x[:, a + 6] = (words > 0) & (words < 6)
        x[:, a + 7] = np.log1p(np.minimum(below, 4000)) / 4
        x[:, a + 8] = below_links / np.maximum(below, 1)
        return x

    def text(self, content: np.ndarray) -> str:
        """The text of the blocks flagged as content."""
        out, gap = [], False
        for block, raw in self.runs:
            if content[block] and raw != "\n":
                out.append(raw)
            elif not out or out[-1] != "\n":
                out.append("\n")
        return " ".join("".join(out).split())


_TAG_AT = {t: k for k, t in enumerate(TAGS)}
FEATURES = 1 + len(TAGS) + 1 + 9


class Forest:
    """The blocks of many pages, with the nodes of each level."""

    def __init__(self, pages: list[Page]) -> None:
        self.first = np.cumsum([0, *[len(p.parent) for p in pages]])
        self.parent = np.concatenate([np.where(np.array(p.parent) < 0, -1, np.array(p.parent) + f) for p, f in zip(pages, self.first, strict=False)])
        self.x = np.concatenate([p.features() for p in pages])
        depth = np.concatenate([np.array(p.depth) for p in pages])
        order = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[order], np.arange(int(depth.max()) + 2))
        self.levels = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        # in page order, the nodes of a level stand by their parents
        self.families = [(self.parent[x[s]], s) for x, s in ((x, np.flatnonzero(np.diff(self.parent[x], prepend=-2))) for x in self.levels)]

    def infer(self, weights: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Node marginals (n, 2), edge marginals (n, 2, 2; parent's state first) and the log-partition sum."""
        own = np.zeros((len(self.parent), 2))
        own[:, 1] = self.x @ weights
        up = own.copy()  # potential and messages from the children
        sent = np.zeros_like(own)
        for level, (above, begin) in zip(self.levels[:0:-1], self.families[:0:-1], strict=True):
            joint = edge[None] + up[level][:, None, :]
            top = joint.max(2)
            sent[level] = top + np.log(np.exp(joint - top[:, :, None]).sum(2))
            up[above] += np.add.reduceat(sent[level], begin)
        roots = self.levels[0]
        total = float(np.logaddexp(up[roots, 0], up[roots, 1]).sum())
        down = np.zeros_like(own)
        belief = up.copy()
        pair = np.zeros((len(own), 2, 2))
        for level in self.levels[1:]:
            rest = belief[self.parent[level]] - sent[level]  # the parent without this child
            joint = rest[:, :, None] + edge[None] + up[level][:, None, :]
            top = joint.max((1, 2), keepdims=True)
            p = np.exp(joint - top)
            p /= p.sum((1, 2), keepdims=True)
            pair[level] = p
            part = rest[:, :, None] + edge[None]
            high = part.max(1)
            down[level] = high + np.log(np.exp(part - high[:, None, :]).sum(1))
            belief[level] = up[level] + down[level]
        belief -= np.logaddexp(belief[:, 0], belief[:, 1])[:, None]
        return np.exp(belief), pair, total


_LETTERS = "aeiou" + "bcdfglmnprstvü" * 2


def _prose(rng: np.random.Generator, words: int) -> str:
    sizes = rng.integers(2, 9, words)
    letters = "".join(_LETTERS[k] for k in rng.integers(0, len(_LETTERS), int(sizes.sum())))
    ends = np.cumsum(sizes).tolist()
    made = [letters[a:b] for a, b in zip([0, *ends], ends, strict=False)]
    out = []
    for k, w in enumerate(made):
        out.append(w.capitalize() if k == 0 or out[-1].endswith(".") else w)
        if k + 1 == words or rng.random() < 0.12:
            out[-1] += "."
        elif rng.random() < 0.08:
            out[-1] += ","
    return " ".join(out)


def labelled_pages(count: int = LABELLED_PAGES, seed: int = 5) -> list[str]:
    """Pages of many layouts whose blocks carry ``data-label`` (1: content; without: as the parent)."""
    rng = np.random.default_rng(seed)
    pick = lambda *x: str(x[rng.integers(len(x))])
    some = lambda p: rng.random() < p
    pick_size = lambda: 3 if rng.random() < 0.4 else 12

    def links(n: int) -> str:
        items = "".join(f"<li><a href='/x'>{_prose(rng, int(rng.integers(1, 4))).rstrip('.')}</a></li>" for _ in range(n))
        return f"<ul>{items}</ul>"

    def junk(tag: str, cls: str, inner: str) -> str:
        attr = f" {pick('class', 'class', 'id')}='{cls}'" if cls else ""
        return f"<{tag}{attr} data-label=0>{inner}</{tag}>"

    def short(n: int = 25) -> str:
        return _prose(rng, int(rng.integers(2, n + 1)))

    def boiler() -> str:
        return pick(
            junk("div", pick("ad", "ads", "advert", "ad-box", "banner", "sponsored", "promo"), pick(short(), f"<p>{short(40)}</p>")),
            junk(pick("aside", "div"), pick("sidebar", "related", "widget", "side", "rail"), f"<h3>{short(5)}</h3>" + pick(links(4), f"<p>{short(40)}</p>")),
            junk("aside", "", pick(links(5), f"<p>{short(40)}</p><p>{short(40)}</p>")),
            junk(pick("div", "section", "p"), pick("cookie-notice", "notice", "consent", "alert", "gdpr"), short(30)),
            junk("form", pick("", "search", "newsletter", "login"), f"<p>{short(12)}</p><input name=q><label>{short(4)}</label><button>Go</button>"),
            junk("div", pick("share", "social", "breadcrumbs", "tags", "pagination"), links(3)),
        )

    def comments() -> str:
        each = "".join(pick(f"<div class='comment'><p>{short(40)}</p></div>", f"<li><p>{short(30)}</p></li>", f"<article class='comment'><h4>{short(4)}</h4><p>{short(40)}</p></article>") for _ in range(int(rng.integers(1, 5))))
        return junk(pick("section", "div", "ol"), pick("comments", "comment-list", "discussion", "responses"), f"<h3>{short(4)}</h3>{each}")

    def piece() -> str:
        return pick(
            *[f"<p>{short(90)}</p>"] * 5,
            f"<p>{short(4)}</p>",
            f"<p>{short(20)} <a href='/y'>{short(6)}</a> {short(20)}</p>",
            f"<h2>{short(7).rstrip('.')}</h2>",
            f"<ul><li>{short(12)}</li><li>{short(5)}</li></ul>",
            f"<ol><li><p>{short(12)}</p></li><li>{short(25)}</li></ol>",
            f"<blockquote><p>{short(30)}</p></blockquote>",
            f"<div><p>{short(60)}</p>{short(20)}</div>",
            f"<table><tr><th>{short(3)}</th><td>{short(4)}</td></tr></table>",
            f"<pre>{short(12)}</pre>",
            f"<figure><img src=z><figcaption>{short(10)}</figcaption></figure>",
            f"<p><b>{short(50)}<br><p>{short(40)}</p>",
            f"<section><h3>{short(5)}</h3><p>{short(60)}</p></section>",
        )

    pages = []
    for _ in range(count):
        inner = "".join(piece() + (boiler() if some(0.15) else "") for _ in range(int(rng.integers(1, pick_size()))))
        title = f"<h1>{short(12)}</h1>"
        title = pick(title, title, f"<header class='entry-title'>{title}</header>") if some(0.9) else ""
        body = pick(
            f"<article data-label=1>{title}{inner}</article>",
            f"<article data-label=1 class='post'>{title}{inner}</article>",
            f"<article data-label=1>{title}{inner}</article>",
            f"<article data-label=1>{title}<p><b>{short(12)}<br><p>{short(12)}</p></article>",
            f"<main data-label=1>{title}{inner}</main>",
            f"<main data-label=1><article>{title}{inner}</article></main>",
            f"<div class='{pick('content', 'post-content', 'entry', 'story', 'main', 'article-body')}' data-label=1>{title}{inner}</div>",
            f"<div><div id='content' data-label=1>{title}{inner}</div></div>",
            f"<div data-label=1>{title}{inner}</div>",
        )
        head = "".join(x for x in (junk("header", pick("", "site-header"), short(6) + links(3)), junk("nav", pick("", "navbar"), pick(links(6), short(8), f"<a href='/a'>{short(2)}</a> | <a href='/b'>{short(2)}</a>")), junk("div", "menu", links(5))) if some(0.5))
        foot = "".join(x for x in (comments(), boiler(), boiler(), junk("footer", pick("", "footer"), pick(short(30), links(4), f"<p>&copy; {short(20)}</p>"))) if some(0.5))
        before = "".join(boiler() for _ in range(int(rng.integers(0, 3))))
        if some(0.2):  # a fragment
            pages.append(f"{head}{before}{body}{foot}")
            continue
        pages.append(f"<!DOCTYPE html><html><head><meta charset=utf-8><title>x</title></head><body data-label=0>{head}{before}{body}{foot}</body></html>")
    return pages


@lru_cache(maxsize=2)
def train(count: int = LABELLED_PAGES, steps: int = STEPS, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Node weights and edge table fitted on the labelled pages."""
    pages = [Page(h, labelled=True) for h in labelled_pages(count, seed)]
    forest = Forest(pages)
    labels = np.zeros(len(forest.parent), np.int64)
    for p, f in zip(pages, forest.first, strict=False):
        for k in range(len(p.parent)):
            labels[f + k] = p.label[k] if p.label[k] >= 0 else (labels[f + p.parent[k]] if k else 0)
    inner = np.flatnonzero(forest.parent >= 0)
    seen_x = forest.x[labels == 1].sum(0)
    seen_edge = np.zeros((2, 2))
    np.add.at(seen_edge, (labels[forest.parent[inner]], labels[inner]), 1)
    weights, edge = np.zeros(FEATURES), np.zeros((2, 2))
    mean_w, mean_e, var_w, var_e = np.zeros(FEATURES), np.zeros((2, 2)), np.zeros(FEATURES), np.zeros((2, 2))
    for t in range(1, steps + 1):
        node, pair, _ = forest.infer(weights, edge)
        grad_w = (seen_x - node[:, 1] @ forest.x) / count - DECAY * weights
        grad_e = (seen_edge - pair[inner].sum(0)) / count - DECAY * edge
        mean_w, mean_e = 0.9 * mean_w + 0.1 * grad_w, 0.9 * mean_e + 0.1 * grad_e
        var_w, var_e = 0.99 * var_w + 0.01 * grad_w**2, 0.99 * var_e + 0.01 * grad_e**2
        scale = (0.3 if 2 * t < steps else 0.05) * np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
        weights += scale * mean_w / (np.sqrt(var_w) + 1e-8)
        edge += scale * mean_e / (np.sqrt(var_e) + 1e-8)
    return weights, edge


def main_texts(htmls: list[str], weights: np.ndarray, edge: np.ndarray, threshold: float = THRESHOLD) -> list[str]:
    pages = [Page(h) for h in htmls]
    if not pages:
        return []
    forest = Forest(pages)
    content = forest.infer(weights, edge)[0][:, 1] >= threshold
    return [p.text(content[a:b]) for p, a, b in zip(pages, forest.first[:-1].tolist(), forest.first[1:].tolist(), strict=True)]


def extract_text(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), threshold: float = THRESHOLD) -> DataFrame:
    """The ``keep`` columns with the main text and its length in code points."""
    weights, edge = train()
    rows = pages.select(*keep, F.col(html_col).cast("string").alias("_html"))
    fields = rows.schema.fields[:-1]
    names = [*kept_as(keep, ("text", "n_chars")), "text", "n_chars"]
    schema = ", ".join(f"`{n}` {f.dataType.simpleString()}" for n, f in zip(names, fields, strict=False)) + ", text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, htmls in text_blocks(batch.column(batch.num_columns - 1)):
                texts = main_texts(htmls, weights, edge, threshold)
                kept = [batch.column(k).slice(first, len(htmls)) for k in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=names)

    return small_batches(rows).mapInArrow(run, schema)


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
