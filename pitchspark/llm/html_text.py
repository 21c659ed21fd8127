"""Main text of HTML pages by composite text density.

The block elements of a page make the nodes of its tree; inline elements only count as tags. Elements that hold no article
text by their kind (scripts, styles, navigation ...), role or class are left out with all they hold. A class or id speaks
against an element only if all its words do (``cookie-notice``, not ``notice-board-story``), and never on headings,
paragraphs and the like, whose ids are slugs of their text; below ``article`` and ``main`` only adverts and lists of
comments go by their class. Attributes are read one by one, and only whole names count. A form goes if it holds less than
half of the page's text, since some pages lie in one form. Comments without a mark go by their structure, in any language:
siblings of one tag and class that all have a date and share the label of a link or button (to reply), after prose.

For every other node the density is its characters per tag,
adjusted by how many of its characters and tags belong to links, against the share of the whole body. A node's sum is that
of its children's densities and of its own text's. The node with the greatest sum is the centre of the article and belongs
to it whole. The threshold is ``SLACK`` times the smallest density on the path from the centre to the body: along that path
every sibling that reaches it belongs to the article too, and so do paragraphs, headings and lists of text beside the
centre (but for those right under the body, of which only the headings before a chosen node count), and blocks of paragraphs
with the same tag and attributes as the path's node.

Inside the result only two things go: a ``header`` if the body itself is the centre and holds it, and, outside ``article``
and ``main``, lists of nothing but links (menus without a mark).

Defined cases: null and empty pages, and pages without text, give the empty string. Broken markup (unclosed or crossed
elements, pages that end anywhere) is read like browsers do in simple cases: open paragraphs, list items and table parts
end where the next begins. Elements deeper than ``DEPTH`` become siblings, as in browsers; their text stays. Nothing is
dropped for its length, and time is linear in it. Rows that repeat each get their text. An empty table gives an empty
result. Only the named columns are read.
"""

from __future__ import annotations

import html as entities
import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchspark.llm.common import text_batches

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?|<([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*'|[\"'])*)>?", re.S
)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: A date in a text, by its form alone.
_DATE = re.compile(r"\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}[./]\d{1,2}[./]\d{2,4}\b|\b\d{1,2}\.?\s+[^\W\d]{3,}\.?\s+\d{4}\b|\b[^\W\d]{3,}\.?\s+\d{1,2},?\s+\d{4}\b")
_WHITE = re.compile(r"[\x20\x09-\x0D]+")

# Elements of HTML by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr "
    "math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mspace mstyle mtable mtr mtd semantics annotation svg".split()
)
DROPPED = frozenset(
    "head script style noscript template title textarea iframe object embed svg annotation canvas audio video map nav aside footer "
    "button select option input datalist dialog menu noembed noframes xmp".split()
)
#: Left out unless they hold half of the page's text.
FORMS = frozenset("form fieldset".split())
LISTS = frozenset("ul ol dl td div section".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements of running text: beside the centre they belong to the article unless they are mostly links.
PROSE = HEADINGS | frozenset("p ul ol dl blockquote pre table figure hr address details".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
# Words of class names and ids of what isn't the article, and words that say nothing beside them.
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion banner "
    "banners cookie cookies consent gdpr notice notices alert alerts popup popups modal overlay newsletter subscribe subscription "
    "signup login sidebar sidebars aside menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar comment "
    "comments commentlist respond replies disqus share sharing social related recommended recommendations widget widgets pagination "
    "pager skip skiplink".split()
)
NEUTRAL = frozenset(
    "site page main global top bottom left right side bar header box block list container wrapper wrap area inner outer section slot "
    "zone unit panel item items row col column group link links button buttons icons form thread reader user post posts".split()
)
# Words of class names and ids that speak against an element below an article too.
ADVERTS = frozenset("ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors".split())
COMMENT_LISTS = frozenset("comments commentlist respond replies disqus".split())
_WORDS = re.compile(r"[A-Za-z]+|[0-9]+")
#: Elements whose class and id are never looked at.
UNMARKED = HEADINGS | frozenset("body html main article p li td th tr tbody thead pre blockquote figure".split())
#: A node beside the path belongs to the article from this part of the path's least density on.
SLACK = 0.5
#: Depth of the tree, as in browsers.
DEPTH = 512
#: Open elements that a start tag ends, up to the nearest of the elements after them.
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}


class _Page:
    """Block nodes of a page, in page order, as lists: parent, tag, own and total counts, and the pieces of text."""

    def __init__(self) -> None:
        self.tag, self.parent, self.marks = ["body"], [-1], [""]  # marks: the attributes as they stand
        self.chars, self.link_chars, self.tags, self.link_tags = [0], [0], [0], [0]
        self.pieces: list[tuple[int, str]] = []
        self.dated: list[int] = []  # nodes with a date, in page order
        self.labels: dict[str, list[int]] = {}  # nodes with a link or button of a short text, in page order

    def add(self, tag: str, parent: int, marks: str) -> int:
        for values, value in ((self.tag, tag), (self.parent, parent), (self.marks, marks), (self.chars, 0), (self.link_chars, 0), (self.tags, 1), (self.link_tags, 0)):
            values.append(value)
        return len(self.tag) - 1


def _is_boilerplate(name: str, inside: bool) -> bool:
    """Whether a class or id has a word of boilerplate and no word besides that means something."""
    words = [w.lower() for w in _WORDS.findall(name)]
    against = ADVERTS | COMMENT_LISTS if inside else BOILERPLATE
    return any(w in against for w in words) and all(w in BOILERPLATE or w in NEUTRAL or w.isdigit() for w in words)


def _attributes(text: str) -> list[tuple[str, str]]:
    """Names in lower case and values of attributes as they stand; of a name given twice the first counts."""
    found: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), entities.unescape("".join(values)))
    return list(found.items())


def _left_out(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element goes by its kind or attributes; ``inside``: below an article or main element."""
    if tag in DROPPED:
        return True
    if not attributes or tag in ("body", "html"):
        return False
    for name, value in _attributes(attributes):
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" and tag not in INLINE:
            return True
        if name == "role" and value.lower() in ROLES:
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if name in ("class", "id") and (tag not in UNMARKED or name == "class" and tag in ("p", "li")) and any(_is_boilerplate(x, inside) for x in value.split()):
            return True
    return False


def parse(page: str) -> _Page:
    """The tree of ``page`` without the elements that are left out."""
    out = _Page()
    # open elements: tag, node it writes to, whether left out, whether in a link, whether below an article
    stack: list[tuple[str, int, int, bool, bool]] = [("body", 0, 0, False, False)]
    at, size = 0, len(page)
    opened: dict[str, int] = {}  # open elements by tag, so that a search for one that isn't open takes no time
    over = 0  # open elements beyond DEPTH, which aren't on the stack

    def text(piece: str) -> None:
        tag, node, gone, link, _ = stack[-1]
        if gone and tag != "button":
            return
        piece = entities.unescape(piece)
        label = _WHITE.sub(" ", piece).strip(" ").lower() if (link or gone) and len(piece) < 200 else ""
        if 0 < len(label) <= 40:
            out.labels.setdefault(label, []).append(node)
        if gone:
            return
        if _DATE.search(piece):
            out.dated.append(node)
        n = len(_WHITE.sub(" ", piece).strip(" "))
        out.pieces.append((node, piece))
        out.chars[node] += n
        if link:
            out.link_chars[node] += n

    def close(tags: tuple[str, ...], fence: tuple[str, ...]) -> None:
        if not any(opened.get(t) for t in tags):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in tags:
                end(k)
                return
            if stack[k][0] in fence:
                return

    def end(k: int) -> None:
        closed = any(stack[i][0] not in INLINE and not stack[i - 1][2] for i in range(k, len(stack)))  # not within what is left out
        for x in stack[k:]:
            opened[x[0]] -= 1
        del stack[k:]
        if closed:  # text after a block doesn't go on with the text before it
            out.pieces.append((stack[-1][1], "\0"))

    while at < size:
        found = _TOKEN.search(page, at)
        if not found:
            text(page[at:])
            break
        if found.start() > at:
            text(page[at : found.start()])
        at = found.end()
        if found[1]:
            tag = found[1].lower()
            if over and tag not in VOID:
                over -= 1
                if tag not in INLINE:
                    out.pieces.append((stack[-1][1], "\0"))
                continue
            if not opened.get(tag):
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    end(k)
                    break
                if tag in INLINE and stack[k][0] not in INLINE:
                    break  # an inline end tag closes nothing outside its block
        elif found[2]:
            tag, attributes = found[2].lower(), found[3] or ""
            if tag in ("html", "body"):
                close(("head",), ())
                continue
            if tag not in INLINE:
                close(("p",), ("table", "button", "object", "td", "th", "caption", "svg", "annotation"))
                if tag in HEADINGS:
                    close(tuple(HEADINGS), ("section", "div", "article", "main"))
                if tag in _ENDS:
                    close(*_ENDS[tag])
                if stack[-1][0] == "head" and tag not in ("meta", "link", "base", "title", "script", "style", "noscript", "template"):
                    end(len(stack) - 1)
            _, node, gone, link, inside = stack[-1]
            dropped = bool(gone) or _left_out(tag, attributes, inside)
            deep = len(stack) > DEPTH and tag not in VOID and tag not in RAW
            if tag == "br" and not gone:
                text(" ")
            if not dropped:
                if tag == "time":
                    out.dated.append(node)
                if tag in INLINE or deep:
                    out.tags[node] += 1
                    out.link_tags[node] += tag == "a"
                    if tag not in INLINE:
                        out.pieces.append((node, "\0"))
                elif tag not in VOID:
                    out.pieces.append((node, "\0"))
                    node = out.add(tag, node, attributes.strip())
                else:
                    out.tags[node] += 1
                    out.pieces.append((node, "\0"))
            if tag in RAW:
                stop = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
                if not dropped:
                    text(page[at : stop.start() if stop else size])
                at = size if not stop else (page.find(">", stop.start()) + 1 or size)
            elif deep and not dropped:
                over += 1
            elif tag not in VOID:
                opened[tag] = opened.get(tag, 0) + 1
                stack.append((tag, node, int(dropped), link or tag == "a", inside or tag in ("article", "main")))
    _prune(out)
    return out


def _last_descendants(page: _Page) -> list[int]:
    """Of each node its last descendant: nodes are in page order, so a subtree is a range."""
    last = list(range(len(page.tag)))
    for k in range(len(last) - 1, 0, -1):
        last[page.parent[k]] = max(last[page.parent[k]], last[k])
    return last


def _prune(page: _Page) -> None:
    """Take forms with little of the page's text, and lists of comments, out of the tree: their counts and pieces go."""
    n, last = len(page.tag), _last_descendants(page)
    chars = list(page.chars)
    for k in range(n - 1, 0, -1):
        chars[page.parent[k]] += chars[k]
    gone = [False] * n

    def drop(k: int) -> None:
        gone[k : last[k] + 1] = [True] * (last[k] + 1 - k)

    for k in range(1, n):
        if page.tag[k] in FORMS and not gone[k] and 2 * chars[k] < chars[0]:
            drop(k)
    for k in _comments(page, last, chars):
        drop(k)
    if any(gone):
        for k in range(n):
            if gone[k]:
                page.chars[k] = page.link_chars[k] = page.tags[k] = page.link_tags[k] = 0
        page.pieces = [(k, "\0" if gone[k] else piece) for k, piece in page.pieces]


def _comments(page: _Page, last: list[int], chars: list[int]) -> list[int]:
    """Roots of lists of comments: siblings of one tag and class, after prose, that all have a date and a label in common.
    Their parent goes with them if it holds little else, and else the heading before them."""
    groups: dict[tuple, list[int]] = {}
    for k in range(1, len(page.tag)):
        if chars[k] and page.tag[k] not in PROSE | {"article", "main"} | HEADINGS:
            name = next((v for a, v in _attributes(page.marks[k]) if a == "class"), "")
            groups.setdefault((page.parent[k], page.tag[k], name), []).append(k)
    before = [0]  # characters of prose in nodes before each
    for k in range(len(page.tag)):
        before.append(before[-1] + (page.chars[k] if page.tag[k] in PROSE else 0))

    def within(nodes: list[int], k: int) -> bool:
        at = bisect_left(nodes, k)
        return at < len(nodes) and nodes[at] <= last[k]

    out = []
    dated = sorted(page.dated)
    labels = {label: sorted(nodes) for label, nodes in page.labels.items()}
    for (parent, _, _), members in groups.items():
        if len(members) < 2 or not all(within(dated, k) for k in members):
            continue
        if not any(len(nodes) >= len(members) and all(within(nodes, k) for k in members) for nodes in labels.values()):
            continue
        held = sum(chars[k] for k in members)
        if before[members[0]] * len(members) < held or not before[members[0]]:
            continue  # nothing to comment on stands before: a list of posts
        if parent and before[parent] and 10 * held >= 7 * chars[parent]:
            out.append(parent)
            continue
        out += members
        kids = [k for k in range(parent + 1, members[0]) if page.parent[k] == parent and chars[k]]
        if kids and page.tag[kids[-1]] in HEADINGS:
            out.append(kids[-1])
    return out


def _density(chars: int, link_chars: int, tags: int, link_tags: int, share: float) -> float:
    """Composite text density; ``share`` is the part of link characters in the whole body."""
    if not chars:
        return 0.0
    links, marks, anchors = max(1, link_chars), max(1, tags), max(1, link_tags)
    base = math.log(chars / max(1, chars - link_chars) * link_chars + share * chars + math.e)
    return chars / marks * math.log(max(1.0, chars / links * marks / anchors)) / math.log(max(base, math.e))


def densities(page: _Page) -> tuple[list[float], list[float], list[int], list[int], list[int]]:
    """Of every node: density, sum of its children's densities and its own text's, and the characters, link characters and
    link tags of its whole subtree."""
    chars, link_chars, tags, link_tags = (list(x) for x in (page.chars, page.link_chars, page.tags, page.link_tags))
    for k in range(len(chars) - 1, 0, -1):
        up = page.parent[k]
        for values in (chars, link_chars, tags, link_tags):
            values[up] += values[k]
    share = link_chars[0] / chars[0] if chars[0] else 0.0
    density = [_density(*x, share) for x in zip(chars, link_chars, tags, link_tags)]
    total = [_density(*x, share) for x in zip(page.chars, page.link_chars, page.tags, page.link_tags)]
    for k in range(1, len(chars)):
        total[page.parent[k]] += density[k]
    return density, total, chars, link_chars, link_tags


def chosen_nodes(page: _Page) -> list[bool]:
    """Whether each node belongs to the article."""
    density, total, chars, links, anchors = densities(page)
    n = len(density)
    kids: list[list[int]] = [[] for _ in range(n)]
    last = _last_descendants(page)
    inside = [False] * n  # an article or main element, or below one
    for k in range(1, n):
        kids[page.parent[k]].append(k)
        inside[k] = inside[page.parent[k]] or page.tag[k] in ("article", "main")
    centre = max(range(n), key=lambda k: (total[k], -k))
    path = [centre]
    while path[-1]:
        path.append(page.parent[path[-1]])
    threshold = SLACK * min(density[k] for k in path)
    chosen = [False] * n

    def take(k: int, value: bool = True) -> None:
        chosen[k : last[k] + 1] = [value] * (last[k] + 1 - k)

    take(centre)
    for below, up in zip(path, path[1:]):
        chosen[up] = up != 0  # bare text beside the path; that of the body itself is no article
        for k in kids[up]:
            if k != below and chars[k]:
                twin = (page.tag[k], page.marks[k]) == (page.tag[below], page.marks[below]) and any(page.tag[x] in PROSE for x in kids[k])
                prose = (twin or up and page.tag[k] in PROSE) and 2 * links[k] < chars[k]
                if page.tag[k] != "header" and (prose or density[k] >= threshold > 0):
                    take(k)
        for k, following in reversed(list(zip(kids[up], kids[up][1:]))):
            if page.tag[k] in HEADINGS and (following == below or chosen[following]):
                take(k)
    for k in range(1, n):
        if chosen[k] and page.tag[k] == "header" and not inside[k] and page.parent[k] == centre == 0:
            take(k, False)
        elif chosen[k] and not inside[k] and page.tag[k] in LISTS and anchors[k] > 1 and links[k] >= 0.9 * chars[k] > 0:
            take(k, False)
    return chosen


def main_text(page: str | None) -> str:
    """The blocks of the article in page order, joined by an empty line."""
    if not page:
        return ""
    tree = parse(page)
    chosen = chosen_nodes(tree)
    blocks: list[str] = []
    held: list[str] = []
    node = -1

    def flush() -> None:
        block = _WHITE.sub(" ", "".join(held)).strip(" ")
        if block:
            blocks.append(block)
        held.clear()

    for k, piece in tree.pieces:
        if k != node or piece == "\0":
            flush()
            node = k
        if chosen[k] and piece != "\0":
            held.append(piece)
    flush()
    return "\n\n".join(blocks)


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The ``keep`` columns, text (empty if there is none) and n_chars (its code points), one row per page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, column=0):
            texts = [main_text(x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], [*keep, "text", "n_chars"]
            )

    rows = pages.select(F.col(html_col).alias("__html"), *keep)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:]]
    return rows.mapInArrow(run, ", ".join([*kinds, "text string", "n_chars long"]))
