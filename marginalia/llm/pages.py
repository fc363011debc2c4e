"""Main text of HTML pages: flat text blocks, classified by a small decision tree.

A page is cut into flat blocks at block-level tags. Each block is described by its word count and link
density, by those of its neighbours (the nearest blocks that are no lines of a list or table),
and by the element it lies in: main part of the page, menu-like parts, heading, list. A decision tree
trained on the small labelled table below tells main text from the rest. Class names are weak features among
these: whether one speaks of something beside the story, and the share of the page's words that its element
holds, from which the tree learns when a name says nothing, as on a wrapper around the story.

Null html counts as empty; a page without main text gives an empty text. Character references are
decoded, white space inside a block becomes one space, blocks are joined in page order by a blank
line. Malformed markup is read as far as it goes: what is not a tag is text, an element left open
lasts to the end of what encloses it; from a tag with a quote that never closes on, tags end at the next >.
Bytes that are not UTF-8 are read as U+FFFD. Time and memory are in proportion to a page's length. Rows are never dropped, repeated rows are treated each, other
columns are ignored, an empty table gives an empty table."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

#: Fixed sets of element names.
BLOCK = frozenset("address article aside blockquote body button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object select option button datalist canvas audio video head".split())
BOILER = frozenset("nav aside footer form menu dialog fieldset label button".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
ITEM = frozenset("li td th dt dd".split())
#: Parts of class names of what is not the story, of what is, and of what only speaks about a part.
HINT = frozenset("ad ads advert adverts advertisement adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar widget footer header masthead topbar cookie cookies consent notice notification alert popup modal overlay newsletter subscribe signup login search share sharing social related recommended recommendations trending popular comment comments reply replies disqus pagination pager copyright disclaimer skip toolbar tags".split())
BODY = frozenset("article post entry story content main body text prose page".split())
ABOUT = frozenset("has with without no show hide is".split())
#: Of these, those of readers' own words.
REPLIES = frozenset("comment comments reply replies disqus".split())
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
PLAIN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)([^>]*+)>", re.S)
TAG = re.compile(r"</?[A-Za-z]")
ATTR = re.compile(r"""(?i)\b(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "part", "in_boiler", "hinted", "share", "replies", "heading", "item")


class Block:
    __slots__ = ("text", "words", "linked", "article", "boiler", "hint", "replies", "heading", "item", "share")

    def __init__(self, text, words, linked, of):
        self.text, self.words, self.linked = text, words, linked
        _, self.article, self.boiler, self.hint, self.replies, self.heading, self.item = of
        self.share = 0.0


def _says(value: str) -> tuple[bool, bool, bool]:
    """(whether a class or id name speaks of something beside the story, of readers' words, of the story itself)."""
    beside = replies = story = False
    for name in value.lower().split():
        parts = re.split(r"[-_]+", name)
        story |= all(p in BODY for p in parts)
        if parts[0] not in ABOUT:
            beside |= any(p in HINT for p in parts)
            replies |= any(p in REPLIES for p in parts)
    return beside and not story, replies and not story, story


def blocks(page: str) -> tuple[list[Block], bool]:
    """(flat blocks in page order, whether the page has an article or main element)."""
    out: list[Block] = []
    top = ("", False, False, 0, False, False, 0)
    stack: list[tuple] = []  # name, article, boiler, outermost hinted element, readers' words, heading, number of the list: with what encloses it
    token, last = TOKEN, page.rfind(">") + 1  # behind the last > all is text
    parts: list[str] = []
    linked: list[str] = []
    link, has_article, at, n, lists, hinted = 0, False, 0, len(page), 0, 0
    opened: Counter = Counter()  # elements on the stack, by name
    endless: set[str] = set()  # raw elements without an end from here on

    def close(i: int) -> None:
        opened.subtract(x[0] for x in stack[i:])
        del stack[i:]

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                words = text.count(" ") + 1
                out.append(Block(text, words, min(1.0, len("".join(linked).split()) / words), stack[-1] if stack else top))
            parts.clear()
            linked.clear()

    def say(raw: str) -> None:
        if raw:
            text = entities.unescape(raw)
            parts.append(text)
            if link:
                linked.append(text)

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            say(page[at:])
            break
        m = token.match(page, lt) if lt < last or page.startswith(("<!", "<?"), lt) else None
        if m is None and lt < last and token is TOKEN and TAG.match(page, lt):
            token = PLAIN  # a quote that never closes
            m = token.match(page, lt)
        if m is None:
            say(page[at : lt + 1])
            at = lt + 1
            continue
        say(page[at:lt])
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        name = name.lower()
        if m.group(1):
            if name in BLOCK:
                flush()
            if name == "a":
                link = max(0, link - 1)
            elif name not in VOID and opened[name] > 0:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        close(i)
                        break
                    if stack[i][0] in BLOCK and name not in BLOCK:
                        break  # an inline end tag does not close what encloses it
            continue
        if name == "br":
            say(" ")
            continue
        if name in BLOCK:
            flush()
        closed = m.group(3).endswith("/")
        if name in RAW and not closed:
            if name == "head":  # up to its end or to the body
                e = re.compile(r"</head\s*>|<body\b", re.I).search(page, at)
                at = n if e is None else (e.end() if e.group().lower().startswith("</") else e.start())
            else:
                e = None if name in endless else re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                if e is None:
                    endless.add(name)
                at = n if e is None and name in ("script", "style", "textarea", "title", "iframe") else (e.end() if e else at)
            continue
        if name in VOID or closed:
            continue
        if name == "a":
            link += 1
            continue
        if name == "p":  # a paragraph ends where the next one begins
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] in BLOCK:
                    break
        elif name in ("li", "td", "th", "tr", "dt", "dd", "option") and stack and stack[-1][0] == name:
            close(len(stack) - 1)
        up = stack[-1] if stack else top
        article = up[1] or name in ("article", "main")
        has_article |= name in ("article", "main")
        boiler = up[2] or name in BOILER or name == "header" and not up[1]
        beside = replies = story = False
        for a in ATTR.finditer(m.group(3)) if m.group(3) else ():
            key, value = a.group(1).lower(), (a.group(2) or "").strip("\"'")
            if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden", value):
                boiler = True
            elif key == "role":
                boiler |= value.lower() in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert")
            elif key in ("class", "id"):
                said = _says(value)
                beside, replies, story = beside or said[0], replies or said[1], story or said[2]
        hint, told = up[3], not story and name not in ("html", "body", "main", "article")
        if beside and told and not hint:
            hinted += 1
            hint = hinted
        item = up[6]
        if name in ("ul", "ol", "dl", "table", "menu") and not item:
            lists += 1
            item = lists
        of = (name, article, boiler, hint, up[4] or replies and told, up[5] or name in HEADING, item)
        if name in BLOCK or of[1:] != up[1:]:
            stack.append(of)
            opened[name] += 1
    flush()
    inside: Counter = Counter()
    for x in out:
        if not (x.boiler or x.replies):
            inside[x.hint] += x.words
    plain = max(1, sum(inside.values()))
    for x in out:
        x.share = inside[x.hint] / plain if x.hint else 0.0
    return out, has_article


def table(found: list[Block], has_article: bool) -> np.ndarray:
    n = len(found)
    x = np.zeros((n, len(FEATURES)))
    for i, b in enumerate(found):
        x[i, :2] = b.words, b.linked
        # 1 in the page's main element, -1 outside it, 0 where the page has none
        x[i, 6:] = (1 if b.article else -1) if has_article else 0, b.boiler, b.hint > 0, b.share, b.replies, b.heading, b.item > 0
    # lines of lists are no neighbours: a block's are the nearest ones outside lists
    for side, order in ((2, range(n)), (4, range(n - 1, -1, -1))):
        last = (0.0, 0.0)
        for i in order:
            x[i, side : side + 2] = last
            if not found[i].item:
                last = (found[i].words, found[i].linked)
    return x


def _w(n: int) -> str:
    return " ".join(["word"] * n)


def _labelled() -> list[str]:
    """The labelled table: small pages; a block that begins with + is main text, one with - is not.

    Sizes of blocks run over a few values, so that the tree learns where they begin to tell."""
    menu = "".join(f"<li><a>-{_w(k)}</a></li>" for k in (1, 2, 1, 3))
    pages = [
        f"<nav><ul>{menu}</ul></nav><article><h1>+{_w(6)}</h1><p>+{_w(1)}</p><p>+{_w(40)}</p></article><footer>-{_w(9)}</footer>",
        f'<div class="ad">-{_w(14)}</div><article><p>+{_w(1)}</p><p>+{_w(9)} <a>{_w(2)}</a></p><div class="ad">-{_w(1)}</div><ul><li>+{_w(4)}</li><li>+{_w(1)}</li></ul></article>',
        f"<header><p>-{_w(3)}</p><a>-{_w(2)}</a></header><main><h2>+{_w(1)}</h2><p>+{_w(16)}</p><p><a>+{_w(6)}</a></p><p>+{_w(12)}</p></main><aside><p>-{_w(30)}</p></aside>",
        f'<article><header><h1>+{_w(4)}</h1></header><p>+{_w(60)}</p><section class="comments"><p>-{_w(30)}</p><p>-{_w(2)}</p></section></article>',
        f'<article><p>+{_w(30)}</p><p>+{_w(5)}</p><div class="related"><p><a>-{_w(7)}</a></p><p>-{_w(8)}</p></div><form><p>-{_w(11)}</p></form><p>+{_w(3)}</p></article>',
        f'<main><div class="notice">-{_w(16)}</div><p>+{_w(2)}</p><blockquote>+{_w(4)}</blockquote><aside>-{_w(8)}</aside><p>+{_w(2)}</p><table><tr><td>+{_w(1)}</td><td>+{_w(2)}</td></tr></table></main>',
        f"<p><a>-{_w(3)}</a></p><article><p>+{_w(25)}</p></article><p>-{_w(12)}</p><div>-{_w(40)}</div>",
        f"<div>-{_w(3)}</div><article><h1>+{_w(9)}</h1><p>+{_w(3)}</p><ul><li>+{_w(2)}</li></ul></article><div>-{_w(20)}</div><div>-{_w(2)}</div>",
        f'<div class="cookie-banner"><p>-{_w(12)}</p></div><div><h1>+{_w(5)}</h1><p>+{_w(28)}</p><p>+{_w(30)}</p></div><div class="sidebar"><p>-{_w(20)}</p></div><div id="comments"><p>-{_w(18)}</p><p>-{_w(45)}</p></div>',
        f"<form><p>-{_w(12)}</p></form><div><p>+{_w(19)}</p><p>+{_w(14)}</p></div><p><a>-{_w(1)}</a> <a>{_w(1)}</a></p>",
    ]
    # inside the main element blocks of all sizes are text, outside it none is
    sizes = (1, 2, 4, 7, 10, 13, 17, 25, 40, 60, 120)
    for u in sizes:
        pages.append(f"<header>-{_w(u)}</header><aside>-{_w(u)}</aside><h1>+{_w(4)}</h1><p>+{_w(30)}</p><footer><p>-{_w(u)}</p></footer>")
        for v in sizes:
            pages += [
                f"<div>-{_w(v)}</div><article><h1>+{_w(u)}</h1><p>+{_w(v)}</p><p>+{_w(u)}</p><p>+{_w(v)}</p></article><div>-{_w(u)}</div>",
                f'<nav><p>-{_w(u)}</p></nav><main><div class="ad">-{_w(v)}</div><p>+{_w(u)}</p><p>+{_w(v)}</p></main><footer>-{_w(v)}</footer>',
                f"<article><p>+{_w(u)}</p><aside><p>-{_w(v)}</p><p>-{_w(u)}</p></aside><p>+{_w(v)}</p><form>-{_w(u)}</form></article>",
            ]
    # pages without telling elements: only the neighbours decide about short blocks
    for long in (18, 35, 90):
        for short in (1, 3, 6, 9, 12):
            lines = "".join(f"<div>-{_w(k)}</div>" for k in (short, 2, short))
            items = "".join(f"<li>-{_w(k)}</li>" for k in (short, 1, 2, short, 3))
            points = "".join(f"<li>+{_w(k)}</li>" for k in (short, 2, short))
            body = f"<p>+{_w(long)}</p><p>+{_w(short)}</p><p>+{_w(long)}</p>"
            pages += [
                f"{lines}{body}{lines}",
                f"<ul>{items}</ul><h1>+{_w(4)}</h1>{body}<ul>{items}</ul>",
                f"<ul>{menu}</ul><p>+{_w(long)}</p><ul>{points}</ul><p>+{_w(long)}</p><p><a>-{_w(short)}</a></p><p><a>-{_w(2)}</a></p>",
                f"<p><a>-{_w(short)}</a></p><h2>+{_w(short + 1)}</h2>{body}<h3>+{_w(2)}</h3>{body}<ul>{menu}</ul>",
                f"<p>+{_w(long)}</p><blockquote>+{_w(short)}</blockquote><p>+{_w(long)}</p><div><a>-{_w(long)}</a></div><div><a>-{_w(short)}</a></div>",
                f"<nav>{lines}</nav><h1>+{_w(short)}</h1>{body}{body}<footer>-{_w(short)}</footer>",
                f"<ul>{items}</ul><h1>+{_w(short)}</h1><p>+{_w(long)}</p><p>+{_w(short)}</p><ul>{points}</ul><p>+{_w(long)}</p>",
                f"<ul>{menu}</ul><h2>+{_w(2)}</h2><p>+{_w(short)}</p><ul>{points}</ul><p>+{_w(long)}</p><ul>{items}</ul>",
                f'<div class="promo">-{_w(long)}</div>{body}<div class="comments"><p>-{_w(long)}</p><p>-{_w(short)}</p></div>',
            ]
    # names of elements: readers' words are never text, however many; of others, those that hold most of the page are
    for long in (18, 35, 90):
        body = f"<p>+{_w(long)}</p><p>+{_w(5)}</p><p>+{_w(long)}</p>"
        for name in ("notice", "banner", "search-popular", "promo"):
            for most in (1, 2, 4):
                pages += [
                    f'<div class="{name}"><h1>+{_w(4)}</h1>{body * most}</div><div class="promo-extra">-{_w(long // 3)}</div><p>-{_w(2)}</p>',
                    f'<div class="{name}">{body * most}</div><div class="widget">-{_w(long // 2)}</div><div>-{_w(3)}</div>',
                ]
            for k in (1, 2, 3):
                pages.append(f'<div class="{name}"><h1>+{_w(3)}</h1>{f"<p>+{_w(long)}</p>" * k}</div><div class="story-menu">-{_w(k)}</div><div class="comments">{f"<p>-{_w(long)}</p>" * 4 * k}</div>')
            pages.append(f'<div>{body}{body}</div><div class="{name}"><p>-{_w(long)}</p><p>-{_w(7)}</p></div>')
            pages.append(f'<div class="{name}"><p>-{_w(long)}</p><p>-{_w(long)}</p></div><div>{body}</div>')
        for k in (10, 14, 18, 22, 28, long):  # pages that end with their story
            pages += [f"<div><h2>+{_w(k + 2)}</h2><p>+{_w(k)}</p></div>", f"<h1>+{_w(4)}</h1><p>+{_w(k)}</p>", f"<p>+{_w(long)}</p><p>+{_w(k)}</p>", f"<div><p>+{_w(k)}</p><p>+{_w(long)}</p></div>"]
        for boiler in ("aside", "footer", "form", "nav"):  # however long, and wherever it stands
            for k in (8, long, 2 * long):
                pages += [f"<div>{body}</div><{boiler}><p>-{_w(k)}</p></{boiler}>", f"<{boiler}>-{_w(k)}</{boiler}><div>{body}<p>+{_w(k)}</p></div><{boiler}>-{_w(long)}</{boiler}>", f'<div>{body}<div class="comments"><p>-{_w(k)}</p></div></div><{boiler}>-{_w(k)}</{boiler}>']
        for most in (1, 3, 9):
            said = f"<p>-{_w(long)}</p><p>-{_w(4)}</p><h4>-{_w(2)}</h4>" * most
            pages += [f'<div>{body}</div><div class="comments"><h3>-{_w(2)}</h3>{said}</div>', f'<article>{body}</article><section id="replies"><h2>-{_w(3)}</h2>{said}</section>', f'<article>{body}<div class="comment-list">{said}</div></article>']
    return pages


class Tree:
    """A decision tree by Gini impurity."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 16, least: int = 4):
        self.least = least
        self.root = self._grow(x, y, depth)

    def used(self) -> set[str]:
        """Names of the features that the tree splits on."""
        out, todo = set(), [self.root]
        while todo:
            node = todo.pop()
            if not isinstance(node, bool):
                out.add(FEATURES[node[0]])
                todo += node[2:]
        return out

    def _grow(self, x, y, depth):
        p = float(y.mean())
        if depth == 0 or p in (0.0, 1.0):
            return p >= 0.5
        best = None
        for j in range(x.shape[1]):
            v = np.unique(x[:, j])
            for t in (v[1:] + v[:-1]) / 2:
                left = x[:, j] <= t
                a, b = y[left], y[~left]
                if min(len(a), len(b)) < self.least:
                    continue
                g = len(a) * a.mean() * (1 - a.mean()) + len(b) * b.mean() * (1 - b.mean())
                if best is None or g < best[0] - 1e-12:
                    best = (g, j, t, left)
        if best is None:
            return p >= 0.5
        _, j, t, left = best
        return (j, t, self._grow(x[left], y[left], depth - 1), self._grow(x[~left], y[~left], depth - 1))

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), bool)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if isinstance(node, bool):
                out[rows] = node
            else:
                j, t, a, b = node
                left = x[rows, j] <= t
                todo += [(a, rows[left]), (b, rows[~left])]
        return out


@cache
def tree() -> Tree:
    xs, ys = [], []
    for page in _labelled():
        found, has = blocks(page)
        xs.append(table(found, has))
        ys += [b.text[0] == "+" for b in found]
    return Tree(np.concatenate(xs), np.array(ys, float))


def main_text(page: str | None) -> str:
    found, has = blocks(page or "")
    if not found:
        return ""
    keep = tree().predict(table(found, has))
    return "\n\n".join(b.text for b, k in zip(found, keep) if k)


def extract(pages: DataFrame, html: str = "html", key: str = "page_id", url: str = "url") -> DataFrame:
    """One row per row of pages: key, url, text, n_chars. No shuffle."""
    src = pages.selectExpr(f"`{key}` AS key", f"CAST(`{url}` AS string) AS url", f"CAST(`{html}` AS string) AS html")
    kind = src.schema["key"].dataType.simpleString()

    def run(batches):
        for b in common.chunks(batches, "html"):
            text = [main_text(h) for h in common.readable(b.column(2)).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["key", "url", "text", "n_chars"])

    return common.map_arrow(src, run, f"key {kind}, url string, text string, n_chars long").withColumnRenamed("key", key).withColumnRenamed("url", url)
