"""HTML extraction: a linear-chain conditional random field over leaf blocks.

A page is cut into leaf blocks: the text between the borders of block-level
elements. Each block is described by its ancestors' tags, classes and ids and
by its text; a chain over the page's blocks, trained on labelled pages,
decides by Viterbi which of them are the article.

The labelled pages are made from templates of many page layouts: navigation,
headers, sidebars, notices, adverts, forms, link lists, comments and footers,
around and inside articles.

Defined cases: a null page is empty; a page without an article has an empty
text; unclosed and stray tags are taken as browsers do (a paragraph ends where
the next block begins); scripts, styles, comments and the head never count;
repeated pages are reported each; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, slices

SILENT = frozenset("script style noscript template head title svg math iframe object".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span"
    " strike strong sub sup time tt u var wbr br img".split()
)
ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav"
    " ol p pre section table ul".split()
)
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = frozenset("ul ol dl table select div section article aside body main nav footer header form".split())
_PART = re.compile(r"[a-z]+")
#: Words of page furniture, looked for in blocks of at most ``SHORT`` words.
FURNITURE = frozenset(
    "share tweet twitter facebook email print related menu rights reserved copyright subscribe newsletter login register search comments reply"
    " advertisement sponsored cookies cookie privacy terms imprint contact home follow tags more read next previous".split()
)
SHORT = 12


class Blocks(HTMLParser):
    """Leaf blocks of a page: (features, text)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        self.silent = 0
        self.links = 0
        self.text: list[str] = []
        self.linked = 0
        self.out: list[tuple[list[str], str]] = []

    def read(self, html: str) -> list[tuple[list[str], str]]:
        self.feed(html)
        self.close()
        self._flush()
        return self.out

    def _flush(self) -> None:
        raw = "".join(self.text)
        text = " ".join(raw.split())
        if text:
            self.out.append((features(self.stack, text, self.linked), text))
        self.text, self.linked = [], 0

    def _drop(self, at: int) -> None:
        for tag, _ in self.stack[at:]:
            self.silent -= tag in SILENT
        del self.stack[at:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "a":
            self.links += 1
        if tag in INLINE:
            if tag in ("br", "img"):
                self.text.append(" ")
            return
        if tag == "body" and self.silent:
            self._drop(0)
        self._flush()
        if tag in VOID:
            return
        tags = [t for t, _ in self.stack]
        if tag in ENDS_P and "p" in tags:
            self._drop(len(tags) - 1 - tags[::-1].index("p"))
        elif tag in SAME:
            for k in range(len(tags) - 1, -1, -1):
                if tags[k] in SAME[tag]:
                    self._drop(k)
                    break
                if tags[k] in HOLDS:
                    break
        names = []
        for key, value in attrs:
            if key in ("class", "id", "role") and value:
                names += _PART.findall(value.lower())
        self.stack.append((tag, tuple(names)))
        self.silent += tag in SILENT

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in INLINE and tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self.links = max(0, self.links - 1)
        if tag in INLINE or tag in VOID:
            return
        self._flush()
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                self._drop(k)
                break

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.text.append(data)
            if self.links:
                self.linked += len(data)


def features(stack: list[tuple[str, tuple[str, ...]]], text: str, linked: int) -> list[str]:
    tags = [t for t, _ in stack if t not in ("html", "body")]
    out = [f"in:{t}" for t in set(tags)]
    out.append(f"parent:{tags[-1] if tags else 'none'}")
    out.append(f"outer:{tags[0] if tags else 'none'}")
    out += [f"name:{n}" for n in {n for _, ns in stack for n in ns}]
    words = text.count(" ") + 1
    out.append(f"words:{min(int(np.log2(words)), 7)}")
    out.append(f"links:{min(4, int(5 * linked / max(1, len(text))))}")
    out.append(f"end:{'stop' if text[-1] in '.!?…»”\"' else 'open'}")
    if words <= SHORT:
        say = "inner" if "article" in tags or "main" in tags else "says"
        out += [f"{say}:{w}" for w in FURNITURE.intersection(_PART.findall(text.lower()))]
    if text[0] in "©®" or "©" in text[:30]:
        out.append("copyright")
    if text.count("|") > 2:
        out.append("bars")
    return out


# ---------------------------------------------------------------- the chain


class Chain:
    """Two labels, 0 other and 1 article, over the blocks of a page."""

    def __init__(self, names: list[str]):
        self.names = {n: k for k, n in enumerate(names)}
        self.w = np.zeros((len(names), 2))
        self.move = np.zeros((2, 2))
        self.start = np.zeros(2)

    @staticmethod
    def fit(pages: list[tuple[list[list[str]], list[int]]], steps: int = 250, penalty: float = 2e-4) -> Chain:
        """Conditional likelihood with a penalty on squares, by Adam over all pages."""
        chain = Chain(sorted({f for fs, _ in pages for block in fs for f in block}))
        n, t = len(pages), max(len(y) for _, y in pages)
        mask, y = np.zeros((t, n)), np.zeros((t, n), int)
        rows, cols = [], []
        for j, (fs, labels) in enumerate(pages):
            for k, (block, label) in enumerate(zip(fs, labels)):
                mask[k, j], y[k, j] = 1, label
                cols += [chain.names[f] for f in block]
                rows += [k * n + j] * len(block)
        x = np.zeros((t * n, len(chain.names)), np.float32)
        x[rows, cols] = 1
        used = np.flatnonzero(mask.ravel())
        x = x[used]
        gold = np.eye(2)[y.ravel()[used]]
        pairs = np.zeros((2, 2))
        for k in range(1, t):
            np.add.at(pairs, (y[k - 1], y[k]), mask[k])
        first = np.eye(2)[y[0]].sum(axis=0)
        p = [chain.w, chain.move, chain.start]
        m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
        for step in range(1, steps + 1):
            s = np.zeros((t * n, 2))
            s[used] = x @ chain.w
            s = s.reshape(t, n, 2)
            a, b = np.empty((t, n, 2)), np.zeros((t, n, 2))
            a[0] = s[0] + chain.start
            for k in range(1, t):
                on = mask[k][:, None] > 0
                a[k] = np.where(on, s[k] + np.logaddexp.reduce(a[k - 1][:, :, None] + chain.move, axis=1), a[k - 1])
            for k in range(t - 2, -1, -1):
                on = mask[k + 1][:, None] > 0
                b[k] = np.where(on, np.logaddexp.reduce(chain.move + (s[k + 1] + b[k + 1])[:, None, :], axis=2), 0)
            z = np.logaddexp.reduce(a[-1], axis=1)
            q = np.exp(a + b - z[:, None])
            gm = -pairs
            for k in range(1, t):
                e = np.exp(a[k - 1][:, :, None] + chain.move + (s[k] + b[k] - z[:, None])[:, None, :])
                gm = gm + (e * mask[k][:, None, None]).sum(axis=0)
            g = [x.T @ (q.reshape(-1, 2)[used] - gold) / n + penalty * chain.w, gm / n, (q[0].sum(axis=0) - first) / n]
            for k in range(3):
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.01 * (g[k] ** 2 - v[k])
                p[k] -= 0.1 * (1 - step / (steps + 1)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-9)
        return chain

    def decode(self, blocks: list[list[str]]) -> list[int]:
        """The best labels (Viterbi)."""
        if not blocks:
            return []
        w = self.w.tolist()
        (m00, m01), (m10, m11) = self.move.tolist()
        a, b = self.start.tolist()
        back: list[tuple[int, int]] = []
        for k, block in enumerate(blocks):
            s0 = s1 = 0.0
            for f in block:
                i = self.names.get(f)
                if i is not None:
                    s0 += w[i][0]
                    s1 += w[i][1]
            if k:
                to0, to1 = (0 if a + m00 >= b + m10 else 1), (0 if a + m01 >= b + m11 else 1)
                a, b = max(a + m00, b + m10), max(a + m01, b + m11)
                back.append((to0, to1))
            a, b = a + s0, b + s1
        out = [0 if a >= b else 1]
        for step in reversed(back):
            out.append(step[out[-1]])
        return out[::-1]


# ---------------------------------------------------------------- labelled pages


def labelled_pages(n: int = 700, seed: int = 4) -> list[str]:
    """Invented pages; a block of the article begins with the sign U+E000."""
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[int(rng.integers(len(x)))]
    chance = lambda p: rng.random() < p

    def text(low: int = 1, high: int = 80) -> str:
        k = int(np.exp(rng.uniform(np.log(low), np.log(high + 1))))
        words = ["".join(pick(*"abcdefghilmnoprstué") for _ in range(int(rng.integers(2, 9)))) for _ in range(max(1, k))]
        if chance(0.05):
            return " | ".join(words)
        return escape(" ".join(words).capitalize() + pick(".", ".", ".", "!", "?", ""))

    def links(k: int) -> str:
        return "".join(f'<li><a href="/x">{text(1, 3)}</a></li>' for _ in range(k))

    def named(*names: str) -> str:
        name = pick(*names)
        return pick(f'class="{name}"', f'id="{name}"', f'class="{name} {pick("wide", "box", "block", "wrap", "inner")}"', f'class="{pick("site", "page", "js")}-{name}"')

    def noise() -> str:
        ps = "".join(f"<p>{text(1, 40)}</p>" for _ in range(int(rng.integers(1, 3))))
        return pick(
            f'<div {named("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner")}>{pick(text(1, 40), ps)}</div>',
            f'<div {named("cookie", "consent", "notice", "alert", "message", "popup")}>{pick(text(3, 40), ps)}<button>{text(1, 2)}</button></div>',
            f"<aside>{pick(ps, text(1, 40), f'<h3>{text(1, 4)}</h3><ul>{links(3)}</ul>')}</aside>",
            f'<div {named("sidebar", "widget", "related", "recommended", "popular", "trending", "more")}><h3>{text(1, 4)}</h3>{pick(ps, f"<ul>{links(4)}</ul>")}</div>',
            f'<div {named("share", "social", "tools", "tags", "breadcrumb", "breadcrumbs", "byline", "meta")}>{pick(text(1, 5), f"<ul>{links(3)}</ul>")}</div>',
            f'<form action="/s"><label>{text(1, 4)}</label><input name="q"><textarea>{text(1, 9)}</textarea><button>{text(1, 2)}</button>{pick("", ps)}</form>',
            f'<div {named("newsletter", "subscribe", "signup", "login", "search")}>{ps}<form><input><button>{text(1, 2)}</button></form></div>',
            f'<div {named("menu", "nav", "navigation", "navbar", "topbar")}><ul>{links(5)}</ul></div>',
            f"<div>{furniture()}</div>",
        )

    def furniture() -> str:
        """What surrounds an article, told by its words alone."""
        return pick(
            "Share on Twitter Facebook", "Share this", "Tweet", f"Related: {text(2, 6)}", f"Related {text(1, 4)}", "Menu", "All rights reserved.", f"{text(1, 3)} All rights reserved",
            "Subscribe to our newsletter", "Login | Register", "Home | Contact | Imprint", "Privacy and cookies", "Advertisement", f"Sponsored: {text(1, 6)}", "Print this page",
            "Read more", "Next", "Previous", "Search", "Terms of use", f"Tags: {text(1, 3)}", "Follow us on Facebook",
        )

    def plain_page() -> str:
        """A page of divisions or of table cells without telling names or tags."""
        box = lambda s: f"<div>{s}</div>"
        cell = lambda s: f"<td>{s}</td>"
        anchors = lambda k: " ".join(f'<a href="/x">{text(1, 2)}</a>' for _ in range(k))
        para = lambda: pick(f"<p>\ue000{text(6, 90)}</p>", f"<div>\ue000{text(10, 90)}</div>", f"<p>\ue000{text(1, 30)}</p>", f"<h2>\ue000{text(1, 8)}</h2>")
        body = pick("", f"<h1>\ue000{text(2, 9)}</h1>", f"<div>\ue000{text(2, 9)}</div>") + "".join(para() for _ in range(int(rng.integers(1, 8))))
        around = lambda: pick(furniture(), anchors(int(rng.integers(2, 6))), furniture())
        if chance(0.5):
            top = "".join(box(around()) for _ in range(int(rng.integers(0, 4))))
            low = "".join(box(around()) for _ in range(int(rng.integers(1, 4))))
            if chance(0.3):
                body += box(furniture())
            return top + pick(body, box(body), box(box(body))) + low
        rows = [f"<tr>{cell(around())}{cell(around())}</tr>" for _ in range(int(rng.integers(0, 3)))]
        rows.append(f"<tr>{pick(cell(around()), '')}{cell(body)}{pick(cell(around()), '')}</tr>")
        rows += [f"<tr>{cell(around())}</tr>" for _ in range(int(rng.integers(0, 3)))]
        return f"<table>{''.join(rows)}</table>"

    def main_blocks() -> str:
        out = []
        for _ in range(int(rng.integers(0, 9))):
            s = "\ue000" + text(1, 120)
            out.append(
                pick(
                    f"<p>{s}</p>", f"<p>{s}</p>", f"<p>{s}</p>", f"<p>{s}", f"<p><b>{s}<br>", f"<h2>\ue000{text(1, 8)}</h2>", f"<h3>\ue000{text(1, 8)}</h3>",
                    f"<blockquote>{s}</blockquote>", f"<blockquote><p>{s}</p></blockquote>", f"<ul><li>{s}</li><li>\ue000{text(1, 20)}</li></ul>", f"<pre>{s}</pre>",
                    f"<div>{s}</div>", f'<p>{s} <a href="/y">{text(1, 4)}</a> {text(1, 9)}</p>', f"<ol><li>{s}<li>\ue000{text(1, 20)}</ol>",
                    f"<table><tr><td>\ue000{text(1, 5)}</td><td>\ue000{text(1, 5)}</td></tr></table>", f"<section><p>{s}</p></section>",
                )
            )
            if chance(0.12):
                out.append(noise())
            if chance(0.06):  # an article may quote such words
                out.append(f"<p>\ue000{pick(furniture(), 'All rights reserved.')}</p>")
        return "".join(out)

    def comments() -> str:
        one = lambda: pick(f"<p>{text(1, 60)}</p>", f'<div class="comment"><h4>{text(1, 3)}</h4><p>{text(1, 60)}</p></div>', f"<li><p>{text(1, 60)}</p></li>", f"<article><p>{text(1, 60)}</p></article>")
        kind = pick("div", "section", "section", "ol")
        return f'<{kind} {named("comments", "comment", "discussion", "replies", "responses", "disqus")}>{pick("", f"<h2>{text(1, 3)}</h2>")}{"".join(one() for _ in range(int(rng.integers(1, 5))))}</{kind}>'

    pages = []
    for _ in range(n):
        title = text(2, 10)
        head = f"<!DOCTYPE html><html><head><title>{title}</title></head><body>"
        if chance(0.25):
            pages.append(head + plain_page())
            continue
        parts = [f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var a='<p>';</script></head><body>"]
        if chance(0.4):
            parts.append(f"<header><h1>{text(1, 4)}</h1>{pick('', f'<p>{text(1, 12)}</p>')}</header>" if chance(0.5) else f'<div {named("header", "masthead", "top")}><p>{text(1, 9)}</p></div>')
        parts.append(pick(f"<nav><ul>{links(6)}</ul></nav>", f"<nav>{text(1, 5)}</nav>", "", f'<ul {named("menu", "nav")}>{links(5)}</ul>'))
        parts += [noise() for _ in range(int(rng.integers(0, 4)))]
        heading = pick("", f"<h1>\ue000{title}</h1>", f"<h1>\ue000{title}</h1>", f"<header><h1>\ue000{title}</h1></header>")
        inner = heading + main_blocks()
        tail = comments() if chance(0.35) else ""
        if chance(0.4):
            inner, tail = inner + tail, ""
        box = pick("article", "article", "article", "main", "div", "div", "both")
        if box == "div":
            inner = f'<div {named("content", "article", "post", "entry", "story", "main", "text", "body")}>{inner}</div>'
        elif box == "both":
            inner = f'<main><div {named("content", "container", "wrapper")}><article>{inner}</article></div></main>'
        else:
            inner = f"<{box}>{inner}</{box}>"
        parts.append(inner if chance(0.95) else pick("", f"<article>{noise()}</article>"))
        parts.append(tail)
        parts += [noise() for _ in range(int(rng.integers(0, 3)))]
        foot = pick("&copy; ", "") + text(1, 40)
        parts.append(pick(f"<footer>{foot}", f"<footer><p>{foot}</p><ul>{links(3)}</ul></footer>", f'<div {named("footer", "copyright", "bottom", "legal")}><p>{foot}</p></div>', ""))
        pages.append("".join(parts) + pick("</body></html>", ""))
    return pages


def marked(page: str) -> tuple[list[list[str]], list[int]]:
    """Features and labels of a labelled page."""
    read = Blocks().read(page)
    labels = [int("\ue000" in t) for _, t in read]
    read = Blocks().read(page.replace("\ue000", ""))
    return [f for f, _ in read], labels


@lru_cache(maxsize=1)
def trained() -> Chain:
    pages = [marked(p) for p in labelled_pages()]
    return Chain.fit([p for p in pages if p[1] and len(p[0]) == len(p[1])])


def article(html: str | None, chain: Chain) -> str:
    """The main text of a page; its blocks are joined by line feeds."""
    read = Blocks().read(html or "")
    labels = chain.decode([f for f, _ in read])
    return "\n".join(t for (_, t), label in zip(read, labels) if label)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""
    sent = pages.sparkSession.sparkContext.broadcast(trained())
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for part in slices(batch):
                texts = [article(h, sent.value) for h in part.column("html").to_pylist()]
                yield {
                    "page_id": part.column("page_id"), "url": part.column("url"),
                    "text": texts, "n_chars": [len(t) for t in texts],
                }

    rows = pages.select("page_id", "url", "html")
    return map_batches(rows, run, f"page_id {kind}, url string, text string, n_chars bigint")
