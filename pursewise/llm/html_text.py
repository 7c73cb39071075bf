"""Main text of web pages from flat text blocks (operator 3).

A page is cut into a flat list of text blocks at its block-level tags. Each block is described
by its number of words and its link density (share of words inside links), the same two
figures of the two blocks before and the two after it, the words and form controls of its own
parent element, and a few marks: in an article or main element, a heading, a list item, a
paragraph. Blocks in elements whose tag or class declares them furniture (nav, footer, form,
advert, comments, ...) are out, as scripts are. A decision tree trained on a small labelled
table of blocks (``labelled_pages``) tells content from furniture among all others; the content
blocks are joined in page order. Furniture whose names say nothing is in half of the labelled
pages: there the figures of a block and its neighbours decide.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pursewise.llm.common import batches

_BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table
tbody td tfoot th thead title tr ul""".split())
_SKIP = frozenset("script style noscript template svg math iframe object select textarea button title head canvas audio video".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_FURNITURE_TAGS = frozenset("nav footer aside form menu dialog".split())
_CONTENT_TAGS = frozenset(("article", "main"))
#: Words in class, id or role that name furniture.
_FURNITURE = frozenset("""ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent
cookie cookies copyright disclaimer disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice
pagination popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup social
sponsor sponsored subscribe tags toolbar widget""".split())
_CONTENT = frozenset("article content entry main post story".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Skipped elements that may hold their like, and those that the parser reads as raw text.
_NESTED = frozenset("noscript template svg math iframe object canvas audio video".split())
_RAW = frozenset("script style".split())
_UNFINISHED = re.compile(r"<[A-Za-z/!?][^<>]*\Z")

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after",
            "words_before_2", "links_before_2", "words_after_2", "links_after_2", "parent_words", "parent_controls",
            "in_content", "heading", "list_item", "paragraph")
#: Tags whose id is an anchor of the text and no name of a part of the page.
_ANCHORS = _HEADINGS | frozenset("p li dt dd tr td th pre blockquote figure figcaption".split())
#: Words of an id that name no part of their own.
_GENERIC = frozenset("area block box container content inner list section wrap wrapper".split())
_CONTROLS = frozenset("input button select textarea".split())


class _Blocks(HTMLParser):
    """Collects a page's blocks as (text, words, words in links, in_content, in_furniture,
    heading, list_item, paragraph) with the number of their parent element."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.html, self.lower = html, html.lower()
        self.lines = [0, *(m.end() for m in re.finditer("\n", html))]
        self.ends: dict[str, int] = {}  # skipped tag: its next end tag at or after the last place asked for
        self.blocks: list[tuple] = []
        self.parents: list[int] = []
        self.controls: dict[int, int] = {}  # by parent element
        self.open: list[tuple[str, bool, bool, int]] = []  # tag, content, furniture, number of the element
        self.elements = 0
        self.skip: list[str] = []
        self.closed = True  # the skipped element has an end tag of its own
        self.inside: list[str] = []  # block elements opened in the skipped one
        self.anchors = 0
        self.parts: list[tuple[str, bool]] = []
        self.mark = None
        self.marks: list = []

    def _parent(self) -> int:
        """The element around the innermost p, heading or list item, or the innermost one."""
        for tag, _, _, number in reversed(self.open):
            if tag not in _ANCHORS:
                return number
        return 0

    def flush(self):
        if self.parts:
            text = " ".join("".join(t for t, _ in self.parts).split())
            if text:
                inside = " ".join("".join(t for t, a in self.parts if a).split())
                tags = [o[0] for o in self.open[-3:]]
                _, content, furniture, _ = self.open[-1] if self.open else ("", False, False, 0)
                self.blocks.append((text, len(text.split()), len(inside.split()), content, furniture,
                                    bool(_HEADINGS.intersection(tags[-2:])), "li" in tags, "p" in tags[-1:]))
                self.parents.append(self._parent())
                self.marks.append(self.mark)
        self.parts = []

    def _has_end(self, tag: str) -> bool:
        """Whether an end tag follows before the next element of the name begins."""
        line, column = self.getpos()
        at = self.lines[line - 1] + column
        end = self.ends.get(tag, -1)
        if end < at and end != len(self.html):
            end = self.lower.find("</" + tag, at)
            end = self.ends[tag] = len(self.html) if end < 0 else end
        if end == len(self.html):
            return False
        return tag in _NESTED or self.lower.find("<" + tag, at + 1, end) < 0

    def handle_starttag(self, tag, attrs):
        if self.skip:
            if self.closed or tag not in _BLOCK:
                if tag == self.skip[0] and tag in _NESTED:
                    self.skip.append(tag)
                elif tag in _BLOCK and tag not in _VOID:
                    self.inside.append(tag)
                return
            self.skip.clear()  # it was never closed: the next block is outside of it
        number = self._parent() if tag in _CONTROLS else 0
        if number and not any(o[3] == number and o[0] in _CONTENT_TAGS for o in self.open):
            self.controls[number] = self.controls.get(number, 0) + 1
        if tag == "br" or tag == "wbr" or tag == "img":
            self.parts.append((" ", self.anchors > 0))
            return
        if tag in _SKIP and not (tag in ("title", "head") and self.open and self.open[-1][0] == "body"):
            if tag in _BLOCK:
                self.flush()
            if tag == "head":
                return  # its parts are skipped one by one: a missing end tag must not hide the body
            self.closed = tag in _RAW or self._has_end(tag)
            self.skip.append(tag)
            self.inside.clear()
            return
        if tag == "a":
            self.anchors += 1
        if tag not in _BLOCK:
            return
        self.flush()
        self.anchors = 0 if tag != "a" else self.anchors
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th") or tag in _HEADINGS:
            self._close_open(tag)
        if tag in _VOID:
            return
        self.mark = dict(attrs).get("data-label", self.mark if self.open else None)
        content, furniture = (self.open[-1][1], self.open[-1][2]) if self.open else (False, False)
        names, hidden = _names(tag, attrs)
        content = content or tag in _CONTENT_TAGS or (tag in ("div", "section") and bool(names & _CONTENT) and not names & _FURNITURE)
        furniture = (furniture or hidden or tag in _FURNITURE_TAGS or (tag == "header" and not content)
                     or (bool(names & _FURNITURE) and tag not in _CONTENT_TAGS and not (content and names & _FURNITURE <= {"header"})))
        self.elements += 1
        self.open.append((tag, content, furniture, self.elements))

    def _close_open(self, tag):
        """An unfinished p, li, cell or heading ends where its like begins."""
        like = {"p": ("p",), "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"),
                "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p")}.get(tag, ("p",))
        while self.open and self.open[-1][0] in like:
            self.open.pop()

    def handle_startendtag(self, tag, attrs):
        if tag in _VOID or tag not in _SKIP:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if self.skip:
            if tag == self.skip[0]:
                self.skip.pop()
                return
            if tag not in _BLOCK or tag in self.inside:
                if tag in self.inside:
                    del self.inside[self.inside.index(tag):]
                return
            if not any(o[0] == tag for o in self.open):
                return
            self.skip.clear()  # the element around the skipped one ends, and it with that
        if tag == "a":
            self.anchors = max(0, self.anchors - 1)
        if tag not in _BLOCK:
            return
        self.flush()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        if not self.skip:
            self.parts.append((data, self.anchors > 0))


def _names(tag: str, attrs) -> tuple[set[str], bool]:
    """The words in class, role and id of an element, and whether it is hidden.

    An id counts only where all its words name furniture: ``share-prices`` is an anchor of a
    text about prices, ``comments-list`` the comments. Ids of headings, paragraphs, items and
    cells and classes of headings say nothing about their place.
    """
    names: set[str] = set()
    hidden = False
    for k, v in attrs:
        hidden = hidden or k == "hidden" or (k == "style" and bool(v) and "display:none" in v.replace(" ", "").lower())
        if not v or k not in ("class", "id", "role") or tag in ("body", "html") or tag in _HEADINGS:
            continue
        words = re.findall(r"[a-z]+", v.lower())
        if k != "id":
            names.update(w for w, b in zip(words, ["", *words]) if b not in ("has", "no", "with"))
        elif tag not in _ANCHORS and (set(words) - _GENERIC <= _FURNITURE or set(words) <= _CONTENT):
            names.update(words if set(words) <= _CONTENT else set(words) - _GENERIC)
    return names, hidden


def parsed(html: str | None) -> _Blocks:
    html = _UNFINISHED.sub("", html or "")  # a tag cut off by the end of the page is no text
    p = _Blocks(html)
    p.feed(html)
    p.close()
    p.flush()
    return p


def features(page: _Blocks) -> np.ndarray:
    n = len(page.blocks)
    x = np.zeros((n, len(FEATURES)))
    if not n:
        return x
    raw = np.array([b[1:] for b in page.blocks], float)
    x[:, 0], x[:, 1] = raw[:, 0], raw[:, 1] / np.maximum(raw[:, 0], 1)
    x[1:, 2:4], x[:-1, 4:6], x[2:, 6:8], x[:-2, 8:10] = x[:-1, :2], x[1:, :2], x[:-2, :2], x[2:, :2]
    _, parent = np.unique(page.parents, return_inverse=True)
    x[:, 10] = np.bincount(parent, weights=raw[:, 0])[parent]
    x[:, 11] = [page.controls.get(number, 0) for number in page.parents]
    x[:, 12], x[:, 13:] = raw[:, 2], raw[:, 4:]
    return x


def named_furniture(page: _Blocks) -> np.ndarray:
    """Blocks that their own markup declares to be no text; the tree judges the others."""
    return np.array([b[4] for b in page.blocks], bool)


# ------------------------------------------------------------------ the labelled table

def labelled_pages(count: int = 400, seed: int = 11) -> list[str]:
    """Pages whose blocks carry ``data-label`` (content or furniture), made by rule.

    The layouts vary: with and without article or main elements, headers, menus, sidebars,
    adverts, notices, sign-up boxes, forms and comments, short and long paragraphs, links inside
    text. In every second page no tag and no class name tells furniture from content.
    """
    r = random.Random(seed)

    def words(lo, hi, link=0.0):
        out = []
        for _ in range(r.randint(lo, hi)):
            w = "".join(r.choice("aeiourstlnmdk") for _ in range(r.randint(2, 8)))
            out.append(f'<a href="/{w}">{w}</a>' if r.random() < link else w)
        return " ".join(out)

    def content(tag, lo, hi, link=0.0):
        start = words(1, 3) + " " if 0 < link < 1 else ""  # only headings are links as a whole
        return f'<{tag} data-label="content">{start}{words(lo, hi, link)}</{tag}>'

    pages = []
    for i in range(count):
        plain = i % 2 == 1

        def part(tag, name, body, named=not plain):
            tag, name = (tag, name) if named else ("div", "x" + words(1, 1))
            return f'<{tag} class="{name}" data-label="furniture">{body}</{tag}>'

        def box(lo, hi):  # a sign-up box: a line or two and a control
            control = r.choice(["<input name='q'>", "<input name='q'><button>ok</button>", "<button>ok</button>", "<select><option>a</select>"])
            return f"<p>{words(lo, hi)}</p>{control}" if r.random() < .6 else f"{words(lo, hi)}{control}"

        def comment():
            body = "".join(f"<p>{words(3, long)}</p>" for _ in range(1 if plain else r.randint(1, 3)))
            return body if not plain and r.random() < .5 else f"<div><div>{words(1, 2, r.choice([0, 1]))}</div>{body}</div>"

        long = 50 if plain else 120  # long furniture is told by its tag or name only
        menu = "<ul>" + "".join(f"<li><a href='/x'>{words(1, 2)}</a></li>" for _ in range(r.randint(2, 6))) + "</ul>"
        links = "<ul>" + "".join(f"<li><a href='/x'>{words(2, 9)}</a></li>" for _ in range(r.randint(2, 6))) + "</ul>"
        body = [content("h1", 1, 10, r.choice([0, 0, 1]))] if r.random() < .8 else [content("p", 1, 30)]
        for _ in range(r.randint(2, 9) if plain else r.choice([0, 1, 3, 5, 9])):  # an article may be tiny
            kind = r.random()
            if kind < .75:
                body.append(content("p", 1, r.choice([6, 20, 90, 90]), r.choice([0, 0, .1, .4])))
            elif kind < .85:
                body.append(content("h2", 1, 8, r.choice([0, 0, 1])))
            elif kind < .95:
                body.append("<ul>" + "".join(content("li", 1, 15, r.choice([0, 0, .2, .4])) for _ in range(3)) + "</ul>")
            else:
                body.append(content("blockquote", 3, 40))
            if r.random() < .15:
                body[-1] = f'<div class="x{words(1, 1)}">{body[-1]}</div>'
        if plain:  # some long paragraph tells where the article is
            body.insert(r.randint(1, len(body)), content("p", 30, 120))
        # inside the article links or controls tell what no name tells
        for name, inner in (("share", words(2, 5, 1)), ("ad", words(3, 15, 1)), ("newsletter", box(3, 20)), ("related", links)):
            if r.random() < .2:
                at = r.randint(1, len(body))
                body[at:at] = [part("div", name, inner, named=r.random() < .5)]
        if not plain and r.random() < .3:
            body.append(part("div", r.choice(["ad", "comments", "notice"]), comment()))
        text = "".join(body)
        style = i // 2 % 4 if not plain else 4 + i // 2 % 2
        article = (f"<article>{text}</article>", f"<main>{text}</main>", f'<div class="post-content">{text}</div>',
                   f"<main><article>{text}</article></main>", f'<div class="x{words(1, 1)}">{text}</div>', text)[style]
        extra = [
            part("div", "ad", words(3, long // 2, r.choice([0, .9]))),
            part("div", "cookie-notice", words(6, long - 10, .1) + (" <button>ok</button>" if r.random() < .5 else "")),
            part("aside", "sidebar", f"<p>{words(1, 4 if plain else long)}</p>{r.choice(['', links]) if not plain else links}"),
            part("form", "search", f"<label>{words(1, 5)}</label><input name='q'>"),
            part("div", "newsletter", box(4, 30)),
            part("div", "related", words(6, 20, .9)),
            part("div", "tags", words(1, 8, .9)),
            part("section", "comments", comment() + comment()),
        ]
        before = extra[:2] + extra[3:4]
        r.shuffle(before)
        after = extra[2:3] + extra[4:]
        r.shuffle(after)
        pages.append("<html><body>" + part("header", "header", words(1, 6, r.choice([0, 1]))) + part("nav", "menu", menu)
                     + "".join(before[:r.randint(0, 2)]) + article + "".join(after[:r.randint(0, 4)])
                     + part("footer", "footer", words(3, 30 if plain else long, r.choice([0, .4]))) + "</body></html>")
    return pages


def labelled_blocks(count: int = 400, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    xs, ys = [], []
    for page in labelled_pages(count, seed):
        p = parsed(page)
        judged = ~named_furniture(p)
        xs.append(features(p)[judged])
        ys += [m == "content" for m, k in zip(p.marks, judged) if k]
    return np.vstack(xs), np.array(ys)


# ------------------------------------------------------------------ the tree

def train(x: np.ndarray, y: np.ndarray, depth: int = 10, least: int = 5):
    """Binary decision tree by Gini impurity: (feature, threshold, left, right) or a class."""
    if depth == 0 or len(y) < 2 * least or y.all() or not y.any():
        return bool(2 * y.sum() >= len(y))
    best = None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, t = x[order, f], np.cumsum(y[order])
        n = np.arange(1, len(y) + 1)
        at = np.flatnonzero((v[:-1] < v[1:]) & (n[:-1] >= least) & (n[:-1] <= len(y) - least))
        if not len(at):
            continue
        a, b = t[at] / n[at], (t[-1] - t[at]) / (len(y) - n[at])
        gini = n[at] * a * (1 - a) + (len(y) - n[at]) * b * (1 - b)
        i = int(gini.argmin())
        if best is None or gini[i] < best[0] - 1e-12:
            best = (gini[i], f, float((v[at[i]] + v[at[i] + 1]) / 2))
    if best is None:
        return bool(2 * y.sum() >= len(y))
    _, f, cut = best
    low = x[:, f] <= cut
    return f, cut, train(x[low], y[low], depth - 1, least), train(x[~low], y[~low], depth - 1, least)


def is_content(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, bool):
        return np.full(len(x), tree)
    f, cut, left, right = tree
    low = x[:, f] <= cut
    out = np.empty(len(x), bool)
    out[low], out[~low] = is_content(left, x[low]), is_content(right, x[~low])
    return out


def main_text(html: str | None, tree) -> str:
    page = parsed(html)
    keep = is_content(tree, features(page)) & ~named_furniture(page)
    return "\n\n".join(b[0] for b, k in zip(page.blocks, keep) if k)


def extract(pages: DataFrame) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars (code points).

    A null or empty html gives an empty text. Repeated rows get a row each, null ids and urls
    stay null, an empty table gives no rows, other columns are ignored. Pages of any length
    and broken markup (unclosed, cut off, wrongly nested) are read to the end; a button, list,
    frame or the like without an end tag ends at the next block or with its parent.
    """
    tree = train(*labelled_blocks())
    kinds = [(c, pages.schema[c].dataType.simpleString()) for c in ("page_id", "url")]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(frames, 2):
            texts = [main_text(h, tree) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(
        run, ", ".join(f"{c} {k}" for c, k in kinds) + ", text string, n_chars long")
