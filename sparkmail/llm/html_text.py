"""Main text of web pages by consensus container paths per host.

Each page is cut into text blocks with the path of containers around them (tag
and class names, generalised so that pages of one template agree). A page
scores its containers by how much of the page's running text they hold and
how little else. The scores are summed per host in Spark, every page is read
again, and its text is taken from the container path that won on its host.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmail.llm.common import if_small, python_ready
from sparkmail.session import stage_table

# HTML element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|title|textarea|iframe|svg|math|canvas|object|audio|video|select|button"
CONTAINERS = frozenset("html body main article section div aside nav header footer form table td th ul ol dl menu "
                       "blockquote figure details dialog fieldset center".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre tr thead tbody tfoot caption figcaption address summary "
                                "legend head hr".split())
#: Elements that an opening tag of the key closes if they are open inside the nearest of the stops.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
          "body": ({"head"}, {"html"})}
#: Elements, roles and class words of what surrounds an article.
ASIDE_TAGS = frozenset("nav aside footer form menu dialog".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
ASIDE_WORDS = re.compile(
    r"(?:^|[\s_-])(?:nav(?:bar|igation)?|menus?|breadcrumbs?|masthead|header|footer|sidebar|aside|widgets?|ads?|adv|advert\w*|banner|"
    r"sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alerts?|newsletter|subscribe|signup|login|share|sharing|social|related|"
    r"recommend\w*|comments?|disqus|reply|replies|respond|pagination|pager|toolbar|popup|modal|overlay|hidden|copyright|legal|form)"
    r"(?=$|[\s_-])")
#: A tag ends before the next < outside quotes, so that pages without closing > or quotes take time in
#: proportion to their length.
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/<>]*+)(?P<rest>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^<>]*+>|(?P<text>[^<]+)|<", re.S | re.I)
ATTRIBUTE = re.compile(r"""(?<![a-z-])([a-z-]++)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|\b(hidden)\b""", re.I)


@dataclass
class Place:
    """A node of the tree of container paths of one page."""

    parent: int
    label: str
    aside: bool
    running: int = 0
    other: int = 0


@dataclass
class Page:
    """``blocks``: (text, place, whether it is running text)."""

    places: list[Place] = field(default_factory=lambda: [Place(-1, "", False)])
    blocks: list[tuple[str, int, bool]] = field(default_factory=list)

    def path(self, place: int) -> str:
        labels = []
        while place > 0:
            labels.append(self.places[place].label)
            place = self.places[place].parent
        return ">".join(reversed(labels))


def label_of(tag: str, attributes: dict[str, str]) -> str:
    """Tag and sorted class words; digits become #, long words (mostly generated) are left out."""
    words = sorted({re.sub(r"\d+", "#", w) for w in attributes.get("class", "").lower().split() if len(w) <= 30})
    return ".".join([tag, *words]).replace(">", "")


def is_aside(tag: str, attributes: dict[str, str]) -> bool:
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}".lower()
    return tag in ASIDE_TAGS or attributes.get("role", "").lower() in ASIDE_ROLES or "hidden" in attributes \
        or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower() \
        or bool(ASIDE_WORDS.search(names))


def parse(html: str) -> Page:
    """The text blocks of a page in order. Never fails: what is not markup is text, open elements end with the page."""
    page = Page()
    known: dict[tuple[int, str, bool], int] = {}
    stack: list[tuple[str, int]] = []
    opened: dict[str, int] = defaultdict(int)
    parts: list[str] = []
    linked = size = 0
    in_link = False

    def here() -> int:
        return stack[-1][1] if stack else 0

    def flush():
        nonlocal parts, linked, size
        if parts:
            text = " ".join("".join(parts).split())
            if text and not opened["head"]:
                at = here()
                running = not page.places[at].aside and 2 * linked <= size
                page.blocks.append((text, at, running))
                if running:
                    page.places[at].running += len(text)
                else:
                    page.places[at].other += len(text)
            parts, linked, size = [], 0, 0

    def close(tag: str):
        while stack:
            name, _ = stack.pop()
            opened[name] -= 1
            if name == tag:
                return

    for m in TOKEN.finditer(html):
        if (text := m["text"]) is not None or m[0] == "<":
            text = unescape(text or "<")
            parts.append(text)
            n = len(text.strip())
            size += n
            linked += n * in_link
            continue
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag == "a":
            in_link = not m["end"]
        elif tag == "br":
            parts.append(" ")
        elif tag in BLOCKS:
            flush()
            in_link = False
            if m["end"]:
                if opened[tag]:
                    close(tag)
                continue
            if opened["p"]:
                close("p")
            if tag in CLOSES:
                mine, stops = CLOSES[tag]
                for name, _ in reversed(stack[-8:]):
                    if name in stops:
                        break
                    if name in mine:
                        close(name)
                        break
            if tag in VOID:
                continue
            at = here()
            if tag in CONTAINERS:
                attributes = {}
                for k, a, b, c, bare in ATTRIBUTE.findall(m["rest"]):
                    attributes[(k or bare).lower()] = a or b or c
                label = label_of(tag, attributes)
                aside = page.places[at].aside or is_aside(tag, attributes) or tag == "header" and not opened["article"] and not opened["main"]
                if label != page.places[at].label or aside != page.places[at].aside:  # nested alike: one place
                    key = (at, label, aside)
                    if key not in known:
                        known[key] = len(page.places)
                        page.places.append(Place(at, label, aside))
                    at = known[key]
            stack.append((tag, at))
            opened[tag] += 1
    flush()
    return page


def scores(page: Page) -> dict[int, float]:
    """place -> F-measure of its text (with all that is inside it) against the page's running text; the
    innermost of places with the same text, within a tenth of the page's best."""
    running, other = [p.running for p in page.places], [p.other for p in page.places]
    for i in range(len(page.places) - 1, 0, -1):  # a place comes after its parent
        running[page.places[i].parent] += running[i]
        # What is marked as an aside can be left out below any container.
        other[page.places[i].parent] += other[i]
    if not running[0]:
        return {}
    around = {p.parent for i, p in enumerate(page.places) if i and running[i] == running[p.parent]}  # a place inside has it all
    found = {i: 2 * running[i] / (running[i] + other[i] + running[0]) for i in range(1, len(page.places)) if running[i] and i not in around}
    best = max(found.values(), default=0.0)
    return {i: s for i, s in found.items() if s >= 0.9 * best}


def text_at(page: Page, path: str | None) -> str:
    """The running text in the containers at ``path``, without asides inside them; if the page has no text there,
    that of the page's own best container."""
    def inside(roots: set[int]) -> list[str]:
        root_of = [-1] * len(page.places)
        for i, p in enumerate(page.places):
            root_of[i] = i if i in roots else root_of[p.parent] if i else -1
        # Only what is an aside by itself below the container is left out.
        return [t for t, at, _ in page.blocks if root_of[at] >= 0 and page.places[at].aside == page.places[root_of[at]].aside]

    if path:
        labels = path.split(">")
        depth = [0] * len(page.places)  # how many labels of the path lead to a place; -1: it is elsewhere
        for i, p in enumerate(page.places[1:], 1):
            d = depth[p.parent]
            depth[i] = d + 1 if 0 <= d < len(labels) and labels[d] == p.label else -1
        blocks = inside({i for i, d in enumerate(depth) if d == len(labels)})
        if blocks:
            return "\n\n".join(blocks)
    own = scores(page)
    if not own:  # no container, or no running text
        return "\n\n".join(t for t, _, running in page.blocks if running)
    return "\n\n".join(inside({max(own, key=lambda i: (own[i], i))}))


def host(url: str | None) -> str:
    _, found, rest = (url or "").partition("://")
    return re.split(r"[/?#]", rest, maxsplit=1)[0].lower() if found else ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for each row: the article of the page, its blocks joined by a blank line.

    A null or empty page has the text ''; a page whose host has no winner, or none of the winner's
    containers, is judged alone. A null url, or one without ``://``, belongs to the host ''. Repeated
    rows each vote and each have a result; an empty table gives an empty result; other columns are not read.
    """
    def vote(batches):
        for batch in batches:
            got: dict[tuple[str, str], float] = defaultdict(float)
            for url, html in zip(*(c.to_pylist() for c in batch.columns)):
                page = parse(html or "")
                for place, score in scores(page).items():
                    got[host(url), page.path(place)] += score
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in got], pa.string()), pa.array([k[1] for k in got], pa.string()),
                                              pa.array(list(got.values()), pa.float64())], names=["host", "path", "score"])

    def read(batches):
        for batch in batches:
            ids, urls, htmls, paths = (c.to_pylist() for c in batch.columns)
            texts = [text_at(parse(h or ""), p) for h, p in zip(htmls, paths)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    python_ready(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    votes = rows.select("url", "html").mapInArrow(vote, "host string, path string, score double") \
        .groupBy("host", "path").agg(F.sum("score").alias("score"))
    # Rounded, so that the order of addition cannot decide; the longer path wins a tie.
    won = votes.groupBy("host").agg(F.max_by("path", F.struct(F.round("score", 6), F.length("path"), "path")).alias("path"))
    won = stage_table(won, "host-paths")
    at_host = F.coalesce(F.lower(F.regexp_extract("url", r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))
    return rows.withColumn("host", at_host).join(if_small(won, 200_000), "host", "left") \
        .select("page_id", "url", "html", "path").mapInArrow(read, "page_id long, url string, text string, n_chars long")
