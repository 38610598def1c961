"""Main text of web pages by scoring the trees of their elements."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
STOP = re.compile("[>\"']")
#: A quoted value in a tag is this long at most; else its quote is a character like others.
VALUE = 100_000
#: Elements nested deeper than this are read as part of the one they stand in.
DEPTH = 512
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

#: Elements whose content is no markup.
RAW = {"script", "style", "title", "textarea", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "col", "embed", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav noscript ol optgroup option p pre section select summary svg table tbody td template tfoot th thead tr ul iframe object audio video canvas button math map".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that never hold an article's text.
OUT = set("script style head nav footer aside form noscript template select button iframe object svg audio video canvas dialog menu textarea option math map input fieldset legend".split())
#: An element closes these when it opens, up to the nearest of the limits.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"})}
#: Parts of class and id names that tell what a container is for.
UNLIKELY = re.compile(r"(?:^|[^a-z])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|commentlist|consent|cookies?|disqus|foot|footer|gdpr|login|masthead|menu\w*|modal|nav|navbar|navigation|newsletter|notice|pager|pagination|popup|promo\w*|related|respond|search|share|sharing|sidebar\w*|signup|site-?header|page-?header|header|skip|social|sponsor\w*|subscribe|tags|toolbar|widgets?)(?:$|[^a-z])")
LIKELY = re.compile(r"(?:^|[^a-z])(?:article|body|content|entry|main|post|story|text|hentry)(?:$|[^a-z])")
STRICT = re.compile(r"(?:^|[^a-z])(?:ads?|advert\w*|comments?|commentlist|disqus|sidebar\w*|footer|navbar|navigation|newsletter|sponsor\w*|cookies?)(?:$|[^a-z])")
ROLES = {"alert", "alertdialog", "banner", "complementary", "contentinfo", "dialog", "menu", "menubar", "navigation", "search", "toolbar"}
#: What an element's own kind is worth as a container.
WORTH = {"article": 10, "main": 8, "section": 3, "div": 5, "pre": 3, "td": 3, "blockquote": 3, "ol": -3, "ul": -3, "dl": -3, "li": -3, "form": -3, "address": -3, "th": -5} | dict.fromkeys(HEADINGS, -5)


class Node:
    __slots__ = ("tag", "parent", "parts", "out", "weight", "length", "links", "anchors", "points")

    def __init__(self, tag: str, parent: Node | None, out: bool = False, weight: int = 0):
        self.tag, self.parent, self.out, self.weight = tag, parent, out, weight
        self.parts: list = []  # child nodes, and (text, inside a link)
        self.length = self.links = self.anchors = 0
        self.points: float | None = None


def _judge(tag: str, rest: str, inside: bool) -> tuple[bool, int]:
    """Whether an element is out, and what its class and id add to its worth."""
    out = tag in OUT or (tag == "header" and not inside)
    if "=" not in rest and "hidden" not in rest:
        return out, 0
    found = {k.lower(): unescape(a or b or c).lower() for k, a, b, c in ATTRIBUTE.findall(rest)}
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")) or found.get("role") in ROLES:
        return True, 0
    named = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", " ".join((found.get("class", ""), found.get("id", "")))).replace("_", "-")
    if not named.strip() or tag in ("html", "body"):
        return out, 0
    likely, unlikely = LIKELY.search(named), UNLIKELY.search(named)
    if STRICT.search(named) or (unlikely and not likely and tag not in ("article", "main") and tag not in HEADINGS):
        return True, 0
    return out, 25 * bool(likely) - 25 * bool(unlikely)


class Scanner:
    """Finds the tags of a page, each character looked at a few times at most however broken the page is."""

    def __init__(self, html: str):
        self.html = html
        self.gone: set[str] = set()  # what isn't to be found behind here
        self.quotes = True

    def _find(self, what: str, at: int, stop: int | None = None) -> int:
        if what in self.gone:
            return -1
        found = self.html.find(what, at) if stop is None else self.html.find(what, at, stop)
        if found < 0 and (stop is None or stop >= len(self.html)):
            self.gone.add(what)
        return found

    def _end(self, at: int) -> int:
        """The place of the tag's ``>``; those in quotes don't count, unless no other is left."""
        here = at
        while self.quotes:
            m = STOP.search(self.html, here)
            if m is None:
                self.quotes = False
            elif m[0] == ">":
                return m.start()
            else:
                close = self._find(m[0], m.end(), m.end() + VALUE)
                if close < 0:
                    break
                here = close + 1
        return self._find(">", at)

    def tags(self) -> Iterator[tuple[int, int, str | None, bool, str]]:
        """(start, end, name, whether it closes, attributes) of each tag; comments and the like have no name.

        A caller who sends a place makes it go on from there.
        """
        html, at = self.html, 0
        while (lt := html.find("<", at)) >= 0:
            first = html[lt + 1 : lt + 2]
            name, close, rest = None, first == "/", ""
            if html.startswith("<!--", lt):
                end = self._find("-->", lt + 4)
                end = len(html) if end < 0 else end + 3
            elif html.startswith("<![CDATA[", lt) and (end := self._find("]]>", lt)) >= 0:
                end += 3
            elif first in ("!", "?"):
                end = self._find(">", lt) + 1
            elif m := NAME.match(html, lt + 1 + close):
                end = self._end(m.end()) + 1
                name, rest = m[0].lower(), html[m.end() : end - 1]
            else:
                at = lt + 1
                continue
            if not end:  # no tag is closed any more
                return
            at = (yield lt, end, name, close, rest) or end


def parse(html: str) -> Node:
    """The tree of a page's block elements. Inline elements leave only their text."""
    root = here = Node("#", None)
    opened: Counter[str] = Counter()
    depth, at, in_link = 0, 0, False
    raw_end: dict[str, re.Pattern] = {}

    def leave(node: Node) -> None:
        """Makes the parent of ``node`` the present element."""
        nonlocal here, depth
        stop = node.parent
        while here is not stop:
            opened[here.tag] -= 1
            depth -= 1
            here = here.parent

    tags, go_on = Scanner(html).tags(), None
    while True:
        try:
            start, end, name, closes, rest = tags.send(go_on)
        except StopIteration:
            break
        go_on = None
        if start > at:
            here.parts.append((html[at:start], in_link))
        at = end
        if name is None:
            continue
        if name == "br" or name == "hr":
            here.parts.append((" " if name == "br" else None, False))
        elif name == "a":
            in_link = not closes
        elif name in RAW and not closes:
            pattern = raw_end.setdefault(name, re.compile(f"</{name}", re.I))
            m = pattern.search(html, at)
            at = go_on = len(html) if m is None else m.start()
        elif name in BLOCKS:
            in_link = in_link and not closes
            if closes:
                if opened[name]:
                    node = here
                    while node.tag != name:
                        node = node.parent
                    leave(node)
                continue
            shut, limits = CLOSES.get(name, (set(), set()))
            node, close = here, None
            if opened["p"] or any(opened[t] for t in shut):
                while node.parent is not None and node.tag not in limits:
                    if node.tag in shut or node.tag == "p":
                        close = node
                    if node.tag in ("table", "div", "section", "article", "main", "body", "li", "td", "blockquote") and node.tag not in shut:
                        break
                    node = node.parent
            if close is not None:
                leave(close)
            if here.tag in HEADINGS and name in HEADINGS | {"p", "div"}:
                leave(here)
            child = Node(name, here, *_judge(name, rest, bool(opened["article"] or opened["main"])))
            here.parts.append(child)
            if depth < DEPTH:
                here = child
                opened[name] += 1
                depth += 1
    if at < len(html):
        here.parts.append((html[at:], in_link))
    return root


def _measure(root: Node) -> list[Node]:
    """Sets text and link lengths from the leaves up; returns nodes that aren't out, parents first."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(p for p in reversed(node.parts) if isinstance(p, Node) and not p.out)
    for node in reversed(order):
        run = False
        for part in node.parts:
            if isinstance(part, Node):
                if not part.out:
                    node.length += part.length
                    node.links += part.links
                    node.anchors += part.anchors
                run = False
            elif part[0] is not None:
                n = len(part[0].strip())
                node.length += n
                if part[1]:
                    node.links += n
                    node.anchors += not run
                run = part[1]
    return order


def _density(node: Node) -> float:
    return node.links / node.length if node.length else 0.0


def _score(order: list[Node]) -> None:
    """Paragraphs pass points to their ancestors, which link density then discounts."""
    for node in order:
        own = "".join(p[0] or " " for p in node.parts if not isinstance(p, Node)).strip()
        if len(own) < 25 or node.parent is None or node.tag in HEADINGS:
            continue
        points = 1 + own.count(",") + min(len(own) / 100, 3)
        # Text that stands in a container itself counts for that container.
        up = node.parent if node.tag in ("p", "pre", "td", "blockquote", "li", "dd", "figcaption") else node
        for share in (1, 2, 3, 6):
            if up is None or up.parent is None:
                break
            if up.points is None:
                up.points = WORTH.get(up.tag, 0) + up.weight
            up.points += points / share
            up = up.parent
    for node in order:
        if node.points is not None:
            node.points *= 1 - _density(node)


def _blocks(node: Node, out: list[str], best: Node | None) -> None:
    """Appends the blocks of a subtree in page order."""
    stack: list = [iter([node])]
    run: list[str] = []

    def flush() -> None:
        # A reference ends with its piece of text: markup inside it cuts it off.
        text = " ".join("".join(map(unescape, run)).split())
        if text:
            out.append(text)
        run.clear()

    while stack:
        part = next(stack[-1], None)
        if part is None:
            flush()
            stack.pop()
        elif isinstance(part, Node):
            flush()
            menu = part is not best and part.tag in ("ul", "ol", "div", "section", "table", "dl") and part.anchors > 2 and _density(part) > 0.5
            if not part.out and not menu:
                stack.append(iter(part.parts))
        elif part[0] is None:
            flush()
        else:
            run.append(part[0])


def main_text(html: str | None) -> str:
    """The article's blocks, one a line; empty if the page has no text."""
    if not html:
        return ""
    order = _measure(parse(html))
    _score(order)
    scored = [n for n in order if n.points is not None]
    best = max(scored, key=lambda n: n.points, default=None)
    if best is None:  # nothing but short texts
        named = [n for n in order if n.tag in ("article", "main") and n.length]
        best = named[0] if named else next((n for n in order if n.tag == "body"), order[0])
    up = best
    while up is not None and up.tag != "article":
        up = up.parent
    best = best if up is None else up
    top, out = best.points or 0.0, []
    for part in best.parent.parts if best.parent is not None else [best]:
        if not isinstance(part, Node) or part.out:
            continue
        same = part.tag == best.tag and (part.points or 0) >= (0.2 * top if (part.points or 0) >= 10 else 0.5 * top) > 0
        prose = part.tag == "p" and (part.length > 80 and _density(part) < 0.25 or 0 < part.length <= 80 and not part.links)
        if part is best or same or prose or (part.tag in HEADINGS and _density(part) < 0.25):
            _blocks(part, out, best)
    return "\n".join(out)


def extract(pages: DataFrame) -> DataFrame:
    """The main text of each row of ``pages(page_id, url, html)``.

    Paragraphs pass points for their length and commas to their ancestors, less
    with each step; an ancestor's points are discounted by the share of its text
    that stands in links. The best container (or the article around it) and those
    of its siblings that score or read like it are kept, without menus, headers,
    footers, sidebars, notices, adverts, forms, scripts and comments inside.

    The time for a page grows with its length only, however broken its markup.
    Returns page_id, url, text, n_chars (code points). Null, empty and textless
    pages have an empty text; a page without long texts gives its article, main or
    body. All rows are kept, whatever their ids; other columns are not read.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(h) for h in batch["html"]]
            yield batch[["page_id", "url"]].assign(text=texts, n_chars=[len(t) for t in texts])

    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    kind = pages.schema["page_id"].dataType.simpleString()
    found = rows.mapInPandas(read, "page_id string, url string, text string, n_chars long")
    return found.withColumn("page_id", F.col("page_id").cast(kind))
