"""Main text of web pages by minimum cut.

A page is cut into blocks. A classifier, a logistic regression on a block's tag, length, links and the tags and names of the
elements around it, gives each block the odds of being content; the costs of calling it boilerplate and content, the
negative logarithms of the two probabilities, are the capacities of its edges from the source and to the sink. Blocks that
follow each other, and the more so blocks that are near in the document tree, are joined by smoothness edges, whose weights
are the logarithms of the odds that such neighbours have one label. The minimum cut, found by maximum flow, is the
labelling of least total cost; the blocks on the source's side are the main text, so a block that is unlike content by
itself is kept among content, and the other way round. A page is independent of all others, so there is no shuffle.

Classifier and weights are fitted on TRAINING_PAGES pages made by a rule from a seed, whose blocks have known labels, not on
the pages of the input: their layouts needn't be those of one site, and each run on any input has the same model."""

from __future__ import annotations

import functools
import html
import math
import re
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fields_of, session_of, table, trimmed
from .quality import regression

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"""(?<![^\s=/"'<>])([^\s=/"'<>]++)\s*+=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is never text of the page.
SKIPPED = frozenset("script style noscript template svg math iframe object canvas audio video title head select textarea button datalist option".split())
RAW = frozenset("script style textarea title iframe noscript xmp".split())
BAD_TAGS = frozenset("nav footer aside form menu dialog search".split())
MAIN_TAGS = frozenset(("article", "main"))
#: Parts of class, id and role names that speak for boilerplate; those after which a name's part may go on.
BAD_NAMES = frozenset("ad ads adv adsense alert bar banner bottombar breadcrumb breadcrumbs byline captcha consent contentinfo cookie cookies copyright cta disclaimer disqus dropdown feedback foot footer form gdpr head header legal links login masthead menu menubar meta modal navbar nav navigation notice notification notifications outbrain overlay pager pagination paywall popup privacy promo promos promotion rating register related replies reply search share sharing shoutbox sidebar signup skip skyscraper social sponsor sponsored subscribe subscription taboola tags teaser toc toolbar topbar tracking trending widget widgets".split())
BAD_STARTS = ("advert", "comment", "cookie", "newsletter", "promo", "recommend", "sidebar", "sponsor", "subscri", "footer", "navig", "respond", "popular")
BAD_ENDS = ("nav", "menu", "sidebar", "footer", "toolbar", "navbar")
#: Names that speak for boilerplate even on an article, a paragraph or a heading; words after which a name is of the layout.
SURE = frozenset("ad ads related sponsored teaser promo discussion reactions guestbook".split())
LAYOUT = frozenset("has with no without is not hide show".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
GOOD_NAMES = frozenset("article articlebody body content entry hentry main post story text".split())
_FOOT = re.compile(r"\s*(?:©|\(c\)|copyright\b|all rights reserved)", re.I)

#: Pages that the model is fitted on, and their seed.
TRAINING_PAGES, SEED = 600, 20240103
#: The shares of the neighbours' odds that are tried as weights of the edges; the one with the fewest errors is taken.
SHARES = (0.1, 0.2, 0.3, 0.4, 0.5, 0.7)
#: So many times a page's length is read for tags with quotes that never end; then quotes in tags mean nothing.
READ_AGAIN = 8
#: Longer blocks are told alike.
LONG = 400
#: Neighbours further apart in the tree than this are told alike.
FARTHEST = 6


class Element:
    __slots__ = ("tag", "parent", "depth", "bad", "main", "skip", "block")

    def __init__(self, tag: str, attributes: str, parent: Element | None):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        #: The nearest element that makes blocks, itself among them.
        self.block = self if parent is None or tag in BLOCKS else parent.block
        self.main = bool(parent and parent.main) or tag in MAIN_TAGS
        self.skip = bool(parent and parent.skip) or tag in SKIPPED
        self.bad = parent.bad if parent else 0.0
        here = 0.0
        if tag in BAD_TAGS:
            here = 6.0
        elif tag == "header" and not self.main:
            here = 6.0
        if attributes:
            for name, a, b, c in _ATTRIBUTE.findall(attributes):
                name, value = name.lower(), a or b or c
                if name in ("class", "id", "role", "data-role", "data-component", "aria-label") and tag not in ("html", "body"):
                    here = max(here, self._names(value))
                elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                    self.skip = True
                elif name == "role" and value.lower() == "main" or name == "itemprop" and value.lower() == "articlebody":
                    self.main = True
                elif name == "aria-hidden" and value.lower() == "true":
                    self.skip = True
            if re.search(r"(?:^|\s)hidden(?:[\s/]|$)", re.sub(r"""=\s*(?:"[^"]*"|'[^']*'|\S+)""", "=", attributes)):
                self.skip = True
        # An article within a wrapper that has but a doubtful name is an article.
        self.bad = here if tag in MAIN_TAGS and self.bad < 6.0 else max(self.bad, here)

    def _names(self, value: str) -> float:
        """How surely a class, id or role name speaks for boilerplate."""
        parts = [p.lower() for p in _NAME.findall(value)]
        # has-sidebar and the like tell of a page's layout, not of the element.
        parts = [p for i, p in enumerate(parts) if not i or parts[i - 1] not in LAYOUT]
        if not parts:
            return 0.0
        whole = "".join(parts)
        sure = any(p.startswith(BAD_STARTS) or p in SURE for p in parts)
        if self.tag in MAIN_TAGS or self.tag in PROSE:
            return 6.0 if sure else 0.0
        if whole in GOOD_NAMES or parts[0] in ("article", "post", "entry", "main", "story") and len(parts) > 1 and parts[1] in ("article", "body", "content", "text", "title", "header", "headline", "main", "entry"):
            return 0.0
        if whole in BAD_NAMES or whole.startswith(BAD_STARTS):
            return 6.0
        return 5.0 if sure or any(p in BAD_NAMES or p.endswith(BAD_ENDS) for p in parts) else 0.0


class Block:
    __slots__ = ("element", "text", "chars", "linked")

    def __init__(self, element: Element, text: str, linked: int):
        self.element, self.text, self.chars, self.linked = element, text, len(text), linked


def blocks(page: str) -> Iterator[Block]:
    """The page's blocks of text in order, with character references decoded and white space folded.

    Time is in proportion to the page's length, whatever its markup: no tag is looked for where no > follows, quotes without
    an end are looked for READ_AGAIN times at most, and what is open is counted by tag."""
    root = Element("html", "", None)
    stack, parts, linked, links, at = [root], [], 0, 0, 0
    opened: dict[str, int] = {}
    close, left = 0, READ_AGAIN * len(page)

    def flush():
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            n, linked = linked, 0
            if text:
                return Block(stack[-1].block, text, min(n, len(text)))
        linked = 0
        return None

    def take(raw: str):
        nonlocal linked
        if raw and not stack[-1].skip:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if links:
                linked += len(text)

    def drop(depth: int):
        for e in stack[depth:]:
            opened[e.tag] -= 1
        del stack[depth:]

    while True:
        lt = page.find("<", at)
        if lt < 0:
            take(page[at:])
            break
        take(page[at:lt])
        if 0 <= close < lt:
            close = page.find(">", lt)
        m = None
        if close >= 0 or page.startswith(("<!", "<?"), lt):
            m = _TOKEN.match(page, lt) if left > 0 or page.startswith(("<!", "<?"), lt) else None
            if m is None and page[lt + 1 : lt + 2] not in ("", " "):
                left -= len(page) - lt if left > 0 and _LOOSE.match(page, lt) else 0
                m = _LOOSE.match(page, lt)
        if m is None:
            take("<")
            at = lt + 1
            continue
        at = m.end()
        if m.re is _TOKEN and m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            if opened.get(tag):
                if tag in BLOCKS and (b := flush()):
                    yield b
                depth = len(stack) - 1
                while stack[depth].tag != tag:
                    depth -= 1
                drop(depth)
            elif tag in BLOCKS and (b := flush()):
                yield b
            continue
        if tag in BLOCKS:
            if b := flush():
                yield b
            # A paragraph ends where a block begins, with all that is open in it; an item where the next item begins.
            opens = {"p": ("p",), "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p")}.get(tag, ("p",))
            if (nearest := stack[-1].block).tag in opens:
                drop(nearest.depth)
            links = 0
        if tag == "br":
            parts.append(" ")
            continue
        if tag in VOID:
            continue
        if tag == "a":
            links += 1
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            if end is None:
                at = len(page)
            else:
                close = page.find(">", end.start())
                at = close + 1 if close >= 0 else len(page)
            continue
        if tag in ("html", "body"):
            continue
        if tag != "head":
            stack.append(Element(tag, m[3], stack[-1]))
            opened[tag] = opened.get(tag, 0) + 1
    if b := flush():
        yield b


def features(b: Block, has_main: bool, headed: bool) -> list[float]:
    """What the classifier knows of a block: its tag, length and links, and the tags and names around it."""
    e, share = b.element, b.linked / b.chars
    return [
        float(e.tag in PROSE or e.tag in ("figcaption", "dd")), float(e.tag in ("li", "td", "th", "dt")),
        math.log1p(min(b.chars, LONG)) / 5, float(b.chars < 25), share, float(share > 0.5),
        float(e.bad >= 6.0), float(0 < e.bad < 6.0), float(e.main and not e.bad), float(e.main and e.bad > 0), float(has_main and not e.main), float(headed), float(bool(_FOOT.match(b.text)) and b.chars < 200),
    ]


def _described(found: list[Block]) -> np.ndarray:
    has_main = any(b.element.main and not b.element.bad for b in found)
    headed, rows = False, []
    for b in found:
        headed = headed or b.element.tag == "h1" and not b.element.bad
        rows.append(features(b, has_main, headed))
    return np.array(rows)


def _neighbours(found: list[Block]) -> Iterator[tuple[int, int, int]]:
    """Pairs of blocks with the kind of their edge: twice the steps between them in the tree for those in a row, 0 for the next one
    below the same parent; one more where both have the same signs of boilerplate and of an article around them."""
    last_of: dict[int, int] = {}
    alike = lambda i, j: int(found[i].element.bad == found[j].element.bad and found[i].element.main == found[j].element.main)
    for i, b in enumerate(found):
        if i:
            yield i - 1, i, 2 * max(1, min(FARTHEST, _distance(found[i - 1].element, b.element))) + alike(i - 1, i)
        parent = id(b.element.parent or b.element)
        if parent in last_of:
            yield last_of[parent], i, alike(last_of[parent], i)
        last_of[parent] = i


@dataclass(frozen=True)
class Cutter:
    """The classifier (mean, scale and weights of a logistic regression, the intercept last) and the weight of each kind of edge."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    smooth: tuple[float, ...]

    def odds(self, found: list[Block]) -> np.ndarray:
        """The logarithm of each block's odds of being content."""
        return np.c_[(_described(found) - self.mean) / self.scale, np.ones(len(found))] @ self.weights

    def labels(self, found: list[Block], smooth: bool = True) -> list[bool]:
        """Which blocks are content; without smoothness, by the classifier alone."""
        z = self.odds(found)
        if not smooth:
            return (z > 0).tolist()
        edges = [(i, j, self.smooth[kind]) for i, j, kind in _neighbours(found)]
        return minimum_cut(np.logaddexp(0, z).tolist(), np.logaddexp(0, -z).tolist(), edges)


def training_page(rng: np.random.Generator) -> str:
    """A made page; the text of each block begins with + if it is content, else with -."""
    word = lambda: "".join(rng.choice(list("abcdefghilmnoprstuv"), int(rng.integers(2, 9))))
    words = lambda n: " ".join(word() for _ in range(max(1, int(n))))
    often = lambda p: rng.random() < p
    pick = lambda *xs: xs[int(rng.integers(len(xs)))]
    prose = lambda: ". ".join(words(rng.integers(4, 16)) for _ in range(int(rng.integers(1, 9)))) + "."
    links = lambda n: "<ul>" + "".join(f'<li><a href="/{word()}">-{words(rng.integers(1, 4))}</a></li>' for _ in range(n)) + "</ul>"
    box = lambda tags, names, inside: f"<{(t := pick(*tags))}{pick(' class', ' id') + chr(61) + chr(34) + pick(*names) + chr(34) if t in ('div', 'section', 'ul') and often(0.85) else ''}>{inside}</{t}>"
    junk = lambda: pick(f"<p>-{words(rng.integers(2, 12))}</p>", f"-{words(rng.integers(2, 9))}", links(int(rng.integers(2, 6))), f'<a href="/x">-{words(rng.integers(1, 5))}</a>')
    advert = lambda: box(("div",), ("ad", "advert", "sponsored", "promo", "ads-box"), pick(f"-{words(rng.integers(2, 20))}", f"<p>-{prose()}</p>"))
    if often(0.1):
        return "".join(pick(f"<p>+{prose()}</p>", f"<div>+{prose()}</div>", f"+{words(rng.integers(1, 20))}<br>", f"<h1>+{words(4)}</h1>") for _ in range(int(rng.integers(1, 5))))
    around = [
        box(("header", "div"), ("header", "masthead", "topbar", "banner"), junk()) if often(0.7) else "",
        box(("nav", "nav", "div", "ul"), ("menu", "navbar", "navigation", "site-nav"), links(int(rng.integers(3, 9)))) if often(0.9) else "",
        box(("div",), ("cookie-banner", "notice", "consent", "popup"), f"<p>-{prose()}</p>") if often(0.3) else "",
        advert() if often(0.6) else "",
    ]
    body = [f"<h1>+{words(rng.integers(2, 10))}</h1>"] if often(0.85) else []
    for _ in range(int(rng.integers(1, 14))):
        kind = rng.random()
        if kind < 0.62:
            body.append(f"<p>+{prose()}</p>")
        elif kind < 0.72:
            body.append(pick(f"<p>+{words(rng.integers(1, 4))}</p>", f"<div>+{words(rng.integers(1, 4))}</div>", f'<p><a href="/y">+{words(rng.integers(1, 6))}</a></p>'))
        elif kind < 0.80:
            body.append(f"<h2>+{words(rng.integers(1, 7))}</h2>")
        elif kind < 0.86:
            body.append("<ul>" + "".join(f"<li>+{words(rng.integers(1, 14))}</li>" for _ in range(int(rng.integers(2, 6)))) + "</ul>")
        elif kind < 0.90:
            body.append(pick(f"<blockquote>+{prose()}</blockquote>", f"<pre>+{words(rng.integers(3, 20))}</pre>", f"<table><tr><td>+{words(2)}</td><td>+{words(3)}</td></tr></table>"))
        else:
            body.append(pick(advert(), box(("div", "ul"), ("related", "share", "social", "tags"), links(int(rng.integers(2, 5)))), f"<form>-{words(3)}</form>"))
    main = f"<{(t := pick('article', 'article', 'main', 'div', 'div'))}{pick('', ' class=content', ' class=post-body', ' id=story') if t == 'div' else ''}>{''.join(body)}</{t}>"
    comments = box(("section", "div"), ("comments", "respond", "discussion", "reader-comments"), "".join(f"<p>-{prose()}</p>" for _ in range(int(rng.integers(1, 5))))) if often(0.35) else ""
    side = box(("aside", "div"), ("sidebar", "widget", "related", "newsletter"), junk() + junk()) if often(0.5) else ""
    foot = box(("footer", "footer", "div"), ("footer", "copyright", "legal", "bottombar"), pick(f"-&copy; {words(3)}", f"<p>-{words(rng.integers(2, 12))}</p>", links(3))) if often(0.9) else ""
    return "<html><head><title>x</title></head><body>" + "".join(around) + (side + main if often(0.4) else main + side) + comments + foot + "</body></html>"


@functools.cache
def fitted(pages: int = TRAINING_PAGES, seed: int = SEED) -> Cutter:
    """The model of so many made pages."""
    rng = np.random.default_rng(seed)
    made: list[tuple[list[Block], list[bool]]] = []
    same, other = np.ones(2 * FARTHEST + 2), np.ones(2 * FARTHEST + 2)
    for _ in range(pages):
        found = list(blocks(training_page(rng)))
        own = [b.text.startswith("+") for b in found]
        for b in found:
            # What tells the label is no part of the text that is described.
            b.text = b.text[1:].lstrip()
            b.chars = max(1, len(b.text))
            b.linked = min(b.linked, b.chars)
        made.append((found, own))
        for i, j, kind in _neighbours(found):
            (same if own[i] == own[j] else other)[kind] += 1
    fit, judged = made[: pages * 2 // 3], made[pages * 2 // 3 :]
    model = regression(np.concatenate([_described(f) for f, _ in fit]), np.array([x for _, own in fit for x in own], float), ridge=1.0)
    odds = np.maximum(0.0, np.log(same / other))
    # What neighbours tell is partly in the classifier already; how much of it is left is seen on pages that it wasn't fitted on.
    cutters = [Cutter(*model, tuple((odds * share).tolist())) for share in SHARES]
    wrong = [sum(x != y for f, own in judged for x, y in zip(c.labels(f), own, strict=True)) for c in cutters]
    return cutters[int(np.argmin(wrong))]


def minimum_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are on the source's side of a least cut, by shortest augmenting paths from nodes with a rest to the source
    to nodes with a rest to the sink. Capacities are rounded to thousandths, so the result is exact for those. What a search
    without success has seen no source will ever reach, so no other search looks there."""
    rest = [round(1000 * (a - b)) for a, b in zip(source, sink, strict=True)]  # what is left after source-node-sink paths
    out: list[dict[int, int]] = [{} for _ in rest]
    for i, j, c in edges:
        c = round(1000 * c)
        out[i][j] = out[i].get(j, 0) + c
        out[j][i] = out[j].get(i, 0) + c
    dead: set[int] = set()
    for t in [i for i, r in enumerate(rest) if r < 0]:
        while rest[t] < 0 and t not in dead:
            # Backwards from the node that still drains to the nearest one that still is fed.
            after, todo, found = {t: -1}, deque([t]), -1
            while todo and found < 0:
                v = todo.popleft()
                for u in out[v]:
                    if u not in after and u not in dead and out[u][v] > 0:
                        after[u] = v
                        if rest[u] > 0:
                            found = u
                            break
                        todo.append(u)
            if found < 0:
                dead.update(after)
                break
            path = [found]
            while after[path[-1]] >= 0:
                path.append(after[path[-1]])
            flow = min(rest[found], -rest[t], *(out[u][v] for u, v in zip(path, path[1:], strict=False)))
            for u, v in zip(path, path[1:], strict=False):
                out[u][v] -= flow
                out[v][u] += flow
            rest[found] -= flow
            rest[t] += flow
    inside = [r > 0 for r in rest]
    todo = deque(i for i, x in enumerate(inside) if x)
    while todo:
        u = todo.popleft()
        for v, c in out[u].items():
            if c > 0 and not inside[v]:
                inside[v] = True
                todo.append(v)
    return inside


def _distance(a: Element, b: Element) -> int:
    """Steps between two elements of the tree."""
    n = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        n += 1
    return n


def main_text(page: str | None, cutter: Cutter | None = None) -> str:
    """The main text of a page: its content blocks in order, joined by newlines; empty for null, and where nothing is content."""
    found = list(blocks(page or ""))
    if not found:
        return ""
    inside = (cutter or fitted()).labels(found)
    return "\n".join(b.text for b, x in zip(found, inside, strict=True) if x)


def changed_by_cut(pages: Iterable[str | None]) -> tuple[int, int]:
    """(blocks, those of them whose label the cut changes against the classifier alone) of some pages."""
    n = changed = 0
    for page in pages:
        if found := list(blocks(page or "")):
            n += len(found)
            changed += sum(x != y for x, y in zip(fitted().labels(found), fitted().labels(found, smooth=False), strict=True))
    return n, changed


def extract(pages: DataFrame) -> DataFrame:
    """All columns of `pages` with text, the main text of html (null: empty), in place of any column of that name.

    Each row is read by itself: repeated rows have the same text, pages of any length and depth are read whole by one task,
    an empty table gives an empty one."""
    sent = session_of(pages).sparkContext.broadcast(fitted())
    kept = pages.drop("text")

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py(), sent.value) for x in b.column("html")]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, "text"])

    return kept.mapInArrow(trimmed(f), f"{fields_of(kept)}text string")


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return done.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
