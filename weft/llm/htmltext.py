"""Operator 10: main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is scanned once into leaf blocks: runs of text with no block-level tag inside, each with what
the tags and class or id words of all its ancestors come to. Every block has binary features of its ancestors, its
text and its links; a two-label chain (main text or not) is trained on labelled pages and decoded by
Viterbi. The labelled pages are made here by a seeded generator of page layouts.

Scripts, styles, comments and markup never become text; text in svg, math, object and noscript is text like any other. What an
article holds is its own: headings in a header of its own, the author's line, captions, credits and tags stay. Character references are decoded, white space
in a block becomes one space, blocks are joined by a newline. A null or empty page has an empty text;
unclosed and cut-off markup is tolerated: an open tag ends with the page, but only an open script or
style hides what follows it. Pages of any length are read whole; equal rows get equal texts, an empty table an empty result. Columns
named in ``keep`` must not be named as those it adds (ValueError).
"""

from __future__ import annotations

import random
import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, table

# --- blocks --------------------------------------------------------------------------------------

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'<]|"[^"<]*"|'[^'<]*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|</[^>]*(?:>|\Z)""", re.S)
VALUES = re.compile(r"""\b(?:class|id|role|style|hidden|aria-hidden)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
WORDS = re.compile(r"[a-z]+|:none")
#: Their content is no text of the page.
RAW = {"script", "style", "template", "textarea", "iframe"}
#: Without a closing tag, these hold the rest of the page; of the others only the tag itself is skipped.
TO_THE_END = {"script", "style"}
#: The text in these is part of the block around them, whatever their tags, up to their end or the next tag of HTML's own.
FOREIGN = {"svg", "math"}
#: An attribute value without quotes that takes the slash at the tag's end.
OPEN_VALUE = re.compile(r"""=\s*[^\s"'>]*/$""")
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp noscript object small span strike strong sub sup time tt u var wbr br".split())
#: A start tag on the left closes the nearest open one on the right, unless one of SCOPE stands between.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"ul", "ol", "dl", "table", "article", "section", "div", "main", "nav", "aside", "body", "select"}


class Block:
    __slots__ = ("text", "path", "linked", "at")

    def __init__(self, text: str, path: tuple, linked: int, at: int):
        self.text, self.path, self.linked, self.at = text, path, linked, at


def blocks_of(html: str | None) -> list[Block]:
    """Leaf blocks of a page in order, each with the ``Path`` of its ancestors, however many there are."""
    found: list[Block] = []
    if not html:
        return found
    stack: list[tuple[str, Path]] = []
    opened: dict[str, list[int]] = {}  # places in the stack of each tag
    parts: list[str] = []
    unclosed: set[str] = set()
    state = [0, 0]  # letters inside links so far in this block, open links
    foreign = 0  # open tags of FOREIGN

    def text(piece: str) -> None:
        if piece:
            parts.append(piece)
            if state[1]:
                state[0] += len(piece)

    def flush() -> None:
        if parts:
            joined = " ".join(unescape("".join(parts)).split())
            if joined:
                found.append(Block(joined, stack[-1][1] if stack else ROOT, state[0], len(found)))
            parts.clear()
        state[0] = 0

    def leave(k: int) -> None:
        for name, _ in stack[k:]:
            opened[name].pop()
        del stack[k:]

    def nearest(names) -> int:
        return max((opened[x][-1] for x in names if opened.get(x)), default=-1)

    at, end = 0, len(html)
    while at < end:
        m = TOKEN.search(html, at)
        if m is None:
            text(html[at:])
            break
        text(html[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag = tag.lower()
        closing = bool(m[1] or m[4])
        if tag in INLINE:
            if tag == "br":
                text(" ")
            elif tag == "a":
                state[1] = 0 if closing else 1
            continue
        if tag in FOREIGN:
            attributes = m[3] or m[6] or ""
            if closing:
                foreign = max(0, foreign - 1)
            elif not (attributes.endswith("/") and not OPEN_VALUE.search(attributes)):
                foreign += 1
            text(" ")
            continue
        if foreign and tag not in RAW:
            if tag not in OF_HTML:
                text(" ")
                continue
            foreign = 0
        if tag in RAW:
            if not closing:
                close = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(html, at)
                if close:
                    at = close.end()
                elif tag in TO_THE_END:
                    at = end
                else:
                    unclosed.add(tag)  # nor is a later one closed
            if not closing:
                text(" ")
            continue
        flush()
        state[1] = 0
        if tag in VOID:
            continue
        if closing:
            if opened.get(tag):
                leave(opened[tag][-1])
            continue
        if stack and stack[-1][0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6") and tag not in ("summary", "figcaption", "caption"):
            leave(len(stack) - 1)  # paragraphs and headings hold no blocks
        if tag in CLOSES and (k := nearest(CLOSES[tag])) > nearest(SCOPE):
            leave(k)
        attributes = m[3] or m[6] or ""
        words = tuple(dict.fromkeys(w for v in VALUES.findall(attributes) for w in WORDS.findall(v.lower()))) if "=" in attributes else ()
        opened.setdefault(tag, []).append(len(stack))
        stack.append((tag, below(stack[-1][1] if stack else ROOT, tag, words)))
    flush()
    return found


# --- features ------------------------------------------------------------------------------------

#: Meanings of class, id and role words; a word counts for every meaning whose stem it starts with.
MEANINGS = {
    "advert": ("ad", "ads", "adv", "advert", "advertisement", "sponsor", "sponsored", "promo", "banner", "doubleclick"),
    "notice": ("cookie", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "toast", "warning", "privacy"),
    "menu": ("nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "tabs", "pagination", "pager", "toc", "skip"),
    "side": ("side", "sidebar", "aside", "widget", "related", "recommend", "recommended", "trending", "popular", "rail", "more", "complementary"),
    "head": ("header", "masthead", "top", "logo", "branding"),
    "foot": ("footer", "foot", "copyright", "colophon", "contentinfo", "legal"),
    "reader": ("comment", "comments", "commentlist", "reply", "replies", "respond", "discussion", "disqus", "feedback", "thread", "review", "reviews"),
    "social": ("share", "sharing", "social", "follow", "tweet", "like"),
    "form": ("form", "search", "login", "signup", "subscribe", "newsletter", "contact", "input"),
    "meta": ("meta", "byline", "author", "tags", "tag", "date", "caption", "credit"),
    "main": ("article", "content", "post", "entry", "story", "main", "body", "text", "prose", "page"),
    "hidden": ("hidden", ":none"),
}
MEANING_OF: dict[str, list[str]] = {}
for _meaning, _words in MEANINGS.items():
    for _word in _words:
        MEANING_OF.setdefault(_word, []).append(_meaning)
TAGS = "head title body header nav main article section aside footer form fieldset div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th pre blockquote figure figcaption button select option legend details summary address menu dialog center".split()


#: Start tags that end what is open of FOREIGN.
OF_HTML = {*TAGS} - {"title"}

#: What the ancestors of a block come to: features of their tags and meanings, the innermost named region, the leaf's tag.
Path = tuple[frozenset, str, str]
ROOT: Path = (frozenset(), "none", "none")


def below(path: Path, tag: str, words: tuple[str, ...]) -> Path:
    """The path of a tag inside ``path``; its size is bounded, whatever the depth."""
    features, region, _ = path
    meanings = {m for w in words for m in MEANING_OF.get(w, ())}
    weak = sorted(meanings - {"main"}) or sorted(meanings)
    if tag in ("nav", "header", "footer", "aside", "form", "article", "main", "head"):
        region = tag
    elif weak:
        region = weak[0]
    own = {f"in:{tag}" if tag in TAGS else "in:other", *(f"means:{m}" for m in meanings)}
    return (features if own <= features else features | own), region, tag if tag in TAGS else "none"


def path_features(path: Path) -> tuple[str, ...]:
    """Features of the ancestors: tags, meanings, the leaf's tag and the innermost named region."""
    features, region, leaf = path
    return tuple(sorted({*features, f"region:{region}", f"leaf:{leaf}"}))


def text_features(block: Block) -> list[str]:
    text, n = block.text, len(block.text)
    words = text.count(" ") + 1
    out = [f"words:{min(7, words.bit_length())}", f"links:{min(4, 4 * block.linked // max(1, n))}"]
    if text[-1] in ".!?…。\"'”»":
        out.append("ends")
    if "," in text or ". " in text:
        out.append("clauses")
    if "©" in text or "|" in text or "·" in text:
        out.append("marks")
    if block.at == 0:
        out.append("first")
    return out


# --- the chain -----------------------------------------------------------------------------------


class Chain:
    """Weights of features for the label "main" against "other", and of label changes."""

    def __init__(self, weights: dict[str, float], change: np.ndarray):
        self.weights = weights
        self.change = [[float(x) for x in row] for row in change]
        self.of_path: dict[tuple, float] = {}

    def emission(self, block: Block) -> float:
        score = self.of_path.get(block.path)
        if score is None:
            if len(self.of_path) > 50_000:
                self.of_path.clear()
            score = self.of_path[block.path] = sum(self.weights.get(f, 0.0) for f in path_features(block.path)) + self.weights.get("bias", 0.0)
        return score + sum(self.weights.get(f, 0.0) for f in text_features(block))

    def decode(self, blocks: list[Block]) -> list[int]:
        """Viterbi: the labels with the greatest sum."""
        (a00, a01), (a10, a11) = self.change
        s0 = s1 = 0.0
        back = []
        for i, block in enumerate(blocks):
            e = self.emission(block)
            if i:
                to0, to1 = (0, 1)[s1 + a10 > s0 + a00], (0, 1)[s1 + a11 > s0 + a01]
                back.append((to0, to1))
                s0, s1 = max(s0 + a00, s1 + a10), max(s0 + a01, s1 + a11) + e
            else:
                s1 = e
        if not blocks:
            return []
        labels = [int(s1 > s0)]
        for to in reversed(back):
            labels.append(to[labels[-1]])
        return labels[::-1]

    def main_text(self, html: str | None) -> str:
        blocks = blocks_of(html)
        return "\n".join(b.text for b, y in zip(blocks, self.decode(blocks)) if y)


def train(pages: list[tuple[str, list[int]]], rounds: int = 120, rate: float = 0.25, ridge: float = 0.02) -> Chain:
    """Conditional likelihood by Adam over all pages at once; forward and backward sums are batched."""
    names: dict[str, int] = {}
    rows = []
    for html, labels in pages:
        blocks = blocks_of(html)
        if len(blocks) != len(labels):
            raise ValueError("a label for each block is needed")
        rows.append([[names.setdefault(f, len(names)) for f in ("bias", *path_features(b.path), *text_features(b))] for b in blocks])
    n, longest = len(pages), max(len(r) for r in rows)
    at = np.array([(i * longest + t, f) for i, r in enumerate(rows) for t, fs in enumerate(r) for f in fs])
    x = np.zeros((n * longest, len(names)), np.float32)
    x[at[:, 0], at[:, 1]] = 1
    there = np.array([[t < len(r) for t in range(longest)] for r in rows])
    y = np.array([[labels[t] if t < len(labels) else 0 for t in range(longest)] for _, labels in pages])
    w, a = np.zeros(len(names)), np.zeros((2, 2))
    both = there[:, 1:]
    seen = np.array([[((y[:, :-1] == p) & (y[:, 1:] == q) & both).sum() for q in (0, 1)] for p in (0, 1)], float)
    m = [np.zeros_like(w), np.zeros_like(a)]
    v = [np.zeros_like(w), np.zeros_like(a)]
    for step in range(1, rounds + 1):
        e = np.zeros((n, longest, 2))
        e[:, :, 1] = (x @ w.astype(np.float32)).reshape(n, longest)
        e[~there] = 0
        ahead = np.zeros((n, longest, 2))
        behind = np.zeros((n, longest, 2))
        ahead[:, 0] = e[:, 0]
        for t in range(1, longest):
            step_on = np.logaddexp(ahead[:, t - 1, :1] + a[0], ahead[:, t - 1, 1:] + a[1]) + e[:, t]
            ahead[:, t] = np.where(there[:, t, None], step_on, ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            nxt = e[:, t + 1] + behind[:, t + 1]
            step_back = np.logaddexp(a[None, :, 0] + nxt[:, :1], a[None, :, 1] + nxt[:, 1:])
            behind[:, t] = np.where(there[:, t + 1, None], step_back, 0)
        total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        p = np.exp(ahead[:, :, 1] + behind[:, :, 1] - total[:, None]) * there
        pair = np.exp(ahead[:, :-1, :, None] + a + (e[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None]) * both[:, :, None, None]
        gw = (((y * there) - p).reshape(-1).astype(np.float32) @ x) / n - ridge * w / n
        ga = (seen - pair.sum(axis=(0, 1))) / n - ridge * a / n
        for k, (value, g) in enumerate(((w, gw), (a, ga))):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            value += rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return Chain({f: float(w[i]) for f, i in names.items()}, a)


# --- labelled pages ------------------------------------------------------------------------------


class PageMaker:
    """Seeded pages whose blocks are labelled as they are written."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        r = self.r
        return " ".join("".join(r.choice(("an", "re", "tio", "el", "ou", "stra", "de", "mi", "ß", "é", "que", "th", "en")) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high)))

    def sentence(self, low: int = 3, high: int = 30) -> str:
        s = self.words(low, high).capitalize()
        return s + self.r.choice((".", ".", ".", "!", "?"))

    def prose(self, most: int = 5) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(1, most)))

    def put(self, text: str, label: int) -> str:
        self.labels.append(label)
        return text

    def name(self, meaning: str) -> str:
        r = self.r
        word = r.choice([w for w in MEANINGS[meaning] if w[0] != ":"])
        word = r.choice((word, f"{word}-{r.choice(('box', 'wrap', 'item', 'list', 'area'))}", f"site-{word}"))
        return f'{r.choice(("class", "class", "id"))}="{word}"'

    def links(self, label: int = 0) -> str:
        r = self.r
        items = [f'<li><a href="/{i}">{self.put(self.words(1, 3), label)}</a>' + r.choice(("</li>", "</li>", "")) for i in range(r.randint(2, 8))]
        return "<ul>" + "".join(items) + "</ul>"

    def paragraphs(self, label: int, n: int) -> str:
        out = []
        for _ in range(n):
            kind = self.r.random()
            if kind < 0.08:
                out.append(f"<h2>{self.put(self.words(2, 8), label)}</h2>")
            elif kind < 0.13:
                out.append("<ul>" + "".join(f"<li>{self.put(self.sentence(2, 12), label)}</li>" for _ in range(self.r.randint(2, 4))) + "</ul>")
            elif kind < 0.17:
                out.append(f"<blockquote>{self.put(self.prose(2), label)}</blockquote>")
            elif kind < 0.2:
                out.append(f"<pre>{self.put(self.words(3, 20), label)}</pre>")
            else:
                body = self.prose()
                if self.r.random() < 0.2:
                    body = f'<b>{body}</b> <a href="#">{self.words(1, 4)}</a> {self.words(1, 9)}.'
                out.append(f"<p>{self.put(body, label)}" + self.r.choice(("</p>", "</p>", "</p>", "")))
        return "".join(out)

    def article_part(self) -> str:
        """What an article has besides its paragraphs: the author's line, captions, credits, tags."""
        r, put = self.r, self.put
        words = put(self.words(1, 8), 1)
        if r.random() < 0.25:
            return f"<figure><img src=x><figcaption>{words}</figcaption></figure>"
        tag = r.choice(("p", "div", "p", "address", "footer" if r.random() < 0.1 else "p"))
        return f"<{tag} {self.name('meta')}>{words}</{tag}>"

    def aside_part(self, inside: bool = False) -> str:
        """Any part of a page that isn't its main text; inside: one that can stand in an article."""
        r, put = self.r, self.put
        kind = r.choice([k for k in range(11) if k != 8 or not inside])
        if kind == 0:
            return r.choice(("<nav>{}</nav>", f"<div {self.name('menu')}>{{}}</div>")).format(self.links())
        if kind == 1:
            return f"<div {self.name('advert')}>" + r.choice(("{}", "<p>{}</p>", '<a href="#">{}</a>')).format(put(self.prose(3), 0)) + "</div>"
        if kind == 2:
            return f"<div {self.name('notice')}><p>{put(self.prose(2), 0)}</p><button>{put(self.words(1, 2), 0)}</button></div>"
        if kind == 3:
            tag, name = r.choice((("aside", ""), ("aside", self.name("side")), ("div", self.name("side"))))
            return f"<{tag} {name}><h3>{put(self.words(1, 4), 0)}</h3>" + r.choice((self.links, lambda: self.paragraphs(0, 2)))() + f"</{tag}>"
        if kind == 4:
            return f"<form {self.name('form')}><label>{put(self.words(1, 3), 0)}</label><input name=q><select><option>{put(self.words(1, 2), 0)}<option>{put(self.words(1, 2), 0)}</select><p>{put(self.sentence(), 0)}</p><button>{put(self.words(1, 1), 0)}</button></form>"
        if kind == 5:
            tag = r.choice(("div", "section", "ol"))
            inner, close = ("li", "</li>") if tag == "ol" else ("div", "</div>")
            notes = "".join(f"<{inner} {self.name('reader')}><p>{put(self.prose(4), 0)}</p>{close}" for _ in range(r.randint(1, 4)))
            return f"<{tag} {self.name('reader')}>{notes}</{tag}>"
        if kind == 6:
            return f"<div {self.name('social')}>" + "".join(f'<a href="#">{x}</a> ' for x in put(self.words(2, 5), 0).split()) + "</div>"
        if kind == 7:
            return f"<div {self.name('head')}>{put(self.words(1, 5), 0)}</div>"
        if kind == 8:
            return f"<div {self.name('meta')}>{put(self.words(2, 6), 0)}</div>"
        if kind == 9:
            return f"<script>var t='</p>';</script><!-- {self.words(1, 4)} --><style>p{{}}</style>"
        return f"<div style=\"display:none\">{put(self.sentence(), 0)}</div>"

    def page(self) -> tuple[str, list[int]]:
        r, self.labels = self.r, []
        put = self.put
        out = [f"<!DOCTYPE html><html><head><title>{put(self.words(3, 10), 0)}</title><style>p{{margin:0}}</style></head><body>"]
        if r.random() < 0.5:
            out.append(r.choice(("<header>{}</header>", "<div class=header>{}</div>")).format(r.choice(("<h1>{}</h1>", "{}")).format(put(self.words(1, 5), 0))))
        if r.random() < 0.7:
            out.append(f"<nav>{self.links()}</nav>")
        out += [self.aside_part() for _ in range(r.randint(0, 3))]
        start, close = r.choice((("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), (f"<div {self.name('main')}>", "</div>"), (f"<section {self.name('main')}>", "</section>"), ("<main><article>", "</article></main>"), ("<table><tr><td>", "</td></tr></table>"), ("<div>", "</div>"), ("", "")))
        out.append(start)
        if r.random() < 0.85:
            title = f"<h1>{put(self.words(2, 12), 1)}</h1>"
            named = start not in ("", "<div>") and not start.startswith("<table")
            if named and r.random() < 0.3:
                title += self.article_part()
            out.append(f"<header>{title}</header>" if named and r.random() < 0.1 else title)
        n = r.choice((0, 1, 2, 3, 6, 12))
        for _ in range(n):
            out.append(self.paragraphs(1, 1))
            if r.random() < 0.08:
                out.append(self.aside_part(inside=True))
            if start not in ("", "<div>") and not start.startswith("<table") and r.random() < 0.1:
                out.append(self.article_part())
        out.append(close)
        out += [self.aside_part() for _ in range(r.randint(0, 3))]
        if r.random() < 0.8:
            out.append(r.choice(("<footer>{}</footer>", "<div class=footer>{}</div>", "<footer><p>{}</p></footer>")).format(put(f"&copy; {self.words(1, 3)} &middot; {self.prose(2)}", 0)))
        return "".join(out), self.labels


_CHAINS: dict[tuple[int, int], Chain] = {}


def trained(n_pages: int = 500, seed: int = 7) -> Chain:
    """The chain trained on ``n_pages`` labelled pages; made once per process."""
    if (n_pages, seed) not in _CHAINS:
        maker = PageMaker(seed)
        _CHAINS[n_pages, seed] = train([maker.page() for _ in range(n_pages)])
    return _CHAINS[n_pages, seed]


def extract(df: DataFrame, chain: Chain, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Rows (keep..., text string, n_chars long) for every row of df."""
    if clash := {*keep} & {"text", "n_chars"}:
        raise ValueError(f"columns named as the result's own: {sorted(clash)}")
    weights, change = chain.weights, np.array(chain.change)  # a few hundred numbers, sent with the function

    def run(batches):
        mine = Chain(weights, change)
        for batch in batches:
            texts = [mine.main_text(h) for h in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*keep, "text", "n_chars"])

    small_batches(df.sparkSession)
    schema = T.StructType([*[df.schema[k] for k in keep], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return df.select(*keep, F.col(html).alias("_html")).mapInArrow(run, schema)


def op10_htmltext(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"), trained())


QUERIES = {"op10_htmltext": op10_htmltext}
