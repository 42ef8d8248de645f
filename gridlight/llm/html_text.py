"""Main text of web pages by composite text density over the whole document tree."""

from __future__ import annotations

import html
import math
import re
from collections import Counter

from pyspark.sql import DataFrame

from gridlight.llm.tables import map_columns

# Fixed values of the format.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CELLS = frozenset("td th".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
          "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPES = frozenset("ul ol dl table select body html article section div".split())
# Parts of a page that are not its article, by element and by the words of id, class and role.
NOT_TEXT = frozenset("head script style noscript template svg canvas iframe object audio video nav footer aside button select textarea dialog menu title".split())
NOT_ARTICLE = frozenset("""ad ads advert advertisement adverts advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs
    footer cookie cookies consent notice notices alert popup modal overlay comment comments disqus replies respond share sharing social related recommended newsletter
    subscribe subscription signup login search pagination pager masthead toolbar widget complementary contentinfo dialog skip""".split())
ARTICLE = frozenset(("article", "main"))
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|$)|<[!?][^>]*>?|<(?P<end>/)?(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)>?", re.S)
ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|$)|'([^']*)(?:'|$)|([^\s>]*)))?")
UNSEEN = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
# What stands behind these in a name is said about the element, not what it is: has-sidebar, no-comments.
ABOUT = frozenset("has have no not with without".split())


def hidden(attrs: dict[str, str]) -> bool:
    return "hidden" in attrs or attrs.get("aria-hidden", "").strip().lower() == "true" or bool(UNSEEN.search(attrs.get("style", "")))


def marked_as_other(attrs: dict[str, str]) -> bool:
    """Whether id, class or role name a part that is not the article."""
    for mark in " ".join(attrs.get(name, "") for name in ("id", "class", "role")).lower().split():
        for piece in re.split(r"[^a-z0-9]+", mark):
            if piece in ABOUT:
                break
            if piece in NOT_ARTICLE:
                return True
    return False


class Page:
    """The tree of a page: for every node its parent, tag, counts of characters and tags and of those in links; and the
    blocks of text in page order.

    Elements without text of the page are dropped as they come.  Forms, and elements that id, class or role mark as another
    part, are dropped at the end, unless they hold an article or main element or, where no such element stands outside all
    marked ones, more than half of the text."""

    def __init__(self, source: str):
        self.parent, self.tag, self.dropped, self.linked, self.doubtful = [-1], ["#root"], [False], [False], [False]
        self.chars, self.tags, self.link_chars, self.link_tags = [0], [0], [0], [0]
        self.parts: list[tuple[int, list[tuple[int, str]]]] = []
        self.stack, self.open, self.held, self.block = [0], Counter(), [], 0
        self.read(source)
        self.flush()
        self.drop_doubtful()
        shown = ((block, " ".join("".join(x for node, x in held if not self.dropped[node]).split())) for block, held in self.parts)
        self.blocks = [(block, text) for block, text in shown if text]
        for i in range(len(self.tag) - 1, 0, -1):
            p = self.parent[i]
            if not self.dropped[i]:
                self.chars[p] += self.chars[i]
                self.tags[p] += self.tags[i] + 1
                self.link_chars[p] += self.link_chars[i]
                self.link_tags[p] += self.link_tags[i] + (self.tag[i] == "a")

    def flush(self) -> None:
        """End the current block of text."""
        if self.held:
            self.parts.append((self.block, self.held))
        self.held = []

    def drop_doubtful(self) -> None:
        if True not in self.doubtful:
            return
        chars, articles = self.chars[:], [not d and t in ARTICLE for d, t in zip(self.dropped, self.tag)]
        for i in range(len(self.tag) - 1, 0, -1):
            if not self.dropped[i]:
                chars[self.parent[i]] += chars[i]
                articles[self.parent[i]] |= articles[i]
        marked, free = [False] * len(self.tag), False
        for i in range(1, len(self.tag)):
            marked[i] = marked[self.parent[i]] or self.doubtful[i] and self.tag[i] != "form"
            free |= self.tag[i] in ARTICLE and not marked[i] and not self.dropped[i]
        for i in range(1, len(self.tag)):
            p = self.parent[i]
            if not self.dropped[i] and (self.dropped[p] or self.doubtful[i] and not articles[i] and (free or 2 * chars[i] <= chars[0])):
                self.dropped[i] = True

    def text(self, raw: str, decode: bool = True) -> None:
        at = self.stack[-1]
        if not raw or self.dropped[at]:
            return
        decoded = html.unescape(raw) if decode and "&" in raw else raw
        self.held.append((at, decoded))
        n = len(decoded) if not decoded[:1].isspace() and not decoded[-1:].isspace() else len(decoded.strip())
        self.chars[at] += n
        if self.linked[at]:
            self.link_chars[at] += n

    def push(self, tag: str, attrs: str) -> int:
        at, node = self.stack[-1], len(self.tag)
        drop, doubt = self.dropped[at] or tag in NOT_TEXT, tag == "form"
        if not drop and tag == "header" and not any(self.open[t] for t in ARTICLE):
            drop = True
        if not drop and attrs and tag not in ("html", "body"):
            given: dict[str, str] = {}
            for name, a, b, c in ATTR.findall(attrs):    # the first of equal names counts
                given.setdefault(name.lower(), a or b or c)
            drop = hidden(given)
            doubt |= tag not in ARTICLE and marked_as_other(given)
        self.parent.append(at)
        self.tag.append(tag)
        self.dropped.append(drop)
        self.doubtful.append(doubt)
        self.linked.append(self.linked[at] or tag == "a")
        for counts in (self.chars, self.tags, self.link_chars, self.link_tags):
            counts.append(0)
        return node

    def pop_to(self, depth: int) -> None:
        """Close all elements above ``depth``; leaving a block ends the text in it."""
        for node in self.stack[depth:]:
            self.open[self.tag[node]] -= 1
            if self.tag[node] not in INLINE:
                self.flush()
        del self.stack[depth:]
        for node in reversed(self.stack):
            if self.tag[node] not in INLINE:
                self.block = node
                break

    def close_before(self, tag: str) -> None:
        """Elements that end where ``tag`` begins although their end tags are missing."""
        if tag not in INLINE and self.open["p"]:
            for depth in range(len(self.stack) - 1, 0, -1):
                name = self.tag[self.stack[depth]]
                if name == "p":
                    self.pop_to(depth)
                    break
                if name not in INLINE:
                    break
        if (ends := CLOSES.get(tag)) and any(self.open[t] for t in ends):
            for depth in range(len(self.stack) - 1, 0, -1):
                name = self.tag[self.stack[depth]]
                if name in ends:
                    self.pop_to(depth)
                    if tag not in ("tr", "tbody", "tfoot"):
                        break
                elif name in SCOPES:
                    break

    def read(self, source: str) -> None:
        at, size = 0, len(source)
        lower = None
        while at < size:
            found = TOKEN.search(source, at)
            if found is None:
                self.text(source[at:])
                return
            self.text(source[at:found.start()])
            at = found.end()
            if (data := found["cdata"]) is not None:
                self.text(data, decode=False)
            if (name := found["name"]) is None:
                continue
            tag = name.lower()
            if found["end"]:
                if tag in ("br", "p") and not self.open[tag]:
                    self.flush() if tag == "p" else self.text(" ")
                elif self.open[tag]:
                    depth = len(self.stack) - 1
                    while self.tag[self.stack[depth]] != tag:
                        depth -= 1
                    self.pop_to(depth)
                continue
            self.close_before(tag)
            if tag in CELLS or tag in ("br", "wbr", "img") and tag != "wbr":
                self.text(" ")
            if tag not in INLINE and tag not in CELLS:
                self.flush()
            node = self.push(tag, found["attrs"])
            if tag in VOID:
                continue
            if tag in RAW:
                lower = lower if lower is not None else source.lower()
                end = lower.find(f"</{tag}", at)
                if not self.dropped[node]:
                    self.stack.append(node)
                    self.text(source[at:end if end >= 0 else size])
                    self.stack.pop()
                stop = source.find(">", end) if end >= 0 else -1
                at = stop + 1 if stop >= 0 else size
                continue
            self.stack.append(node)
            self.open[tag] += 1
            if tag not in INLINE and tag not in CELLS:
                self.block = node


def densities(page: Page) -> list[float]:
    """Composite text density of every node: characters per tag, lowered by the share of links."""
    body = next((i for i, t in enumerate(page.tag) if t == "body"), 0)
    share = page.link_chars[body] / max(1, page.chars[body])
    out = []
    for c, t, lc, lt in zip(page.chars, page.tags, page.link_chars, page.link_tags):
        if not c:
            out.append(0.0)
            continue
        t, links, link_tags = max(1, t), max(1, lc), max(1, lt)
        base = math.log(c / max(1, c - lc) * links + share * c + math.e)
        out.append(c / t * math.log(max(c / links * t / link_tags, 1e-9)) / math.log(base))
    return out


def main_text(source: str | None) -> str:
    """The article of a page as blocks joined by two line ends; empty if there is none.

    The node whose children have the largest sum of densities is the heart of the article; an enclosing article or main
    element counts as a whole.  The smallest density on its path to the body is the threshold: blocks elsewhere whose own
    node or an ancestor outside that path reaches it belong to the article too, unless the page marks its article."""
    page = Page(source or "")
    if not page.blocks:
        return ""
    density = densities(page)
    sums = [0.0] * len(density)
    for i in range(1, len(density)):
        if not page.dropped[i] and page.tag[i] not in INLINE:
            sums[page.parent[i]] += density[i]
    owners = {b for b, _ in page.blocks}
    for b in owners:    # a block with text of its own and no child blocks is its only part
        sums[b] = max(sums[b], density[b])
    best = max((i for i in range(len(sums)) if not page.dropped[i] and page.tag[i] not in INLINE), key=lambda i: (sums[i], -i))
    path, marked, i = [best], None, best
    while i > 0:
        if page.tag[i] in ARTICLE:
            marked = i
        i = page.parent[i]
        path.append(i)
    heart = marked if marked is not None else best
    threshold = min((density[i] for i in path if page.tag[i] not in ("#root", "html", "body") and density[i] > 0), default=math.inf)
    inside, above = {heart: True}, set(path)

    def belongs(node: int) -> bool:
        trail = []
        while node not in inside and node >= 0:
            trail.append(node)
            if marked is None and node not in above and density[node] >= threshold:
                inside[node] = True
                break
            node = page.parent[node]
        known = inside.get(node, False)
        inside.update(dict.fromkeys(trail, known))
        return known

    return "\n\n".join(text for block, text in page.blocks if belongs(block))


def extract(pages: DataFrame, id_cols: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page from its whole html.

    A null or empty page has an empty text.  Rows are independent, so nulls in other columns, ties and repeated rows stay
    as they are; further columns are left out."""
    def run(sources):
        texts = [main_text(x) for x in sources]
        return [texts, [len(x) for x in texts]]
    return map_columns(pages, [html_col], run, "text string, n_chars bigint", list(id_cols))
