"""Main text of web pages by line-block distribution.

A page is stripped of its markup into lines, one per block element, in page order. Menus, headers, footers, sidebars, notices,
adverts, forms, comments of readers, scripts and styles become empty lines. The distribution is the sum of the line lengths, without
lines that are mostly links, over a sliding window: a stretch of text begins where it surges over the threshold and ends where it
dives to zero. The stretches tell where the content is: it lies in the smallest container that holds most of their text, whatever
elements the page is built of, and what surges elsewhere goes. To the stretches of that container come the lines of text that adjoin
them there and, where a stretch lies in an article or main element, the rest of that element, such as a last short line behind an
advert. So an element's name widens what the distribution has found and finds nothing by itself. All lines of what is chosen are kept,
headings and short ones included.

White space within a line becomes one blank, character references are decoded, lines are joined by a newline. Null, empty and
text-free pages give an empty text. Broken markup never raises: unclosed elements end with what holds them.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from tamis.llm.textbytes import by_bytes

WINDOW = 3
#: A stretch begins where the window holds more than so many characters, or this share of what the fullest window holds, if that is less.
SURGE = 40
SURGE_SHARE = 0.5
#: A line with this share of link text counts nothing.
LINK_SHARE = 0.6
#: The content's container holds at least this share of the text of all stretches.
HOME_SHARE = 2 / 3

BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
DROPPED = frozenset("""head script style noscript template textarea title iframe object svg math canvas audio video map nav aside footer form button
select option datalist dialog menu search input label fieldset xmp noembed noframes plaintext""".split())
DROPPED_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar".split())
#: Parts of class and id names.
DROPPED_NAMES = frozenset("""ad ads adv advert advertisement advertisements adverts adsense banner breadcrumb breadcrumbs comment comments consent cookie
cookies disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager
pagination popup promo promoted promotion recommended related share sharing sidebar signup skip social sponsor sponsored subscribe teaser
toolbar widget widgets""".split())
#: Names that tell of something beside the element itself, as in ``has-sidebar``.
ABOUT = frozenset("has no with without is not".split())
#: The article element itself is dropped only if its name says that it is none.
NO_ARTICLE = frozenset("ad advert comment comments promo related sponsored teaser".split())
#: Inside an article, a header holds its title.
ARTICLE_KEEPS = frozenset(["header"])

TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""(class|id|role|aria-hidden|hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/>]|$)""", re.I)
NAME_PARTS = re.compile(r"[a-z]+|[0-9]+")
CAMEL = re.compile(r"([a-z0-9])([A-Z])")


def _dropped(name: str, attributes: str, in_article: bool) -> bool:
    """Whether an element is boilerplate, by its name, role, class or id."""
    if name in ("html", "body", "main"):
        return False
    if name in DROPPED or (name == "header" and not in_article):
        return True
    if "=" not in attributes and "hidden" not in attributes.lower():
        return False
    for key, a, b, c in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), a or b or c
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            return True
        if key == "role" and value.lower() in DROPPED_ROLES:
            return True
        if key in ("class", "id"):
            for word in value.split():
                parts = NAME_PARTS.findall(CAMEL.sub(r"\1 \2", word).lower())
                names = NO_ARTICLE if name == "article" else DROPPED_NAMES
                if parts and parts[0] not in ABOUT and any(p in names and not (in_article and p in ARTICLE_KEEPS) for p in parts):
                    return True
    return False


class _Line:
    __slots__ = ("article", "box", "links", "text")

    def __init__(self, text: str, links: int, article: int, box: tuple[int, ...]):
        self.text, self.links, self.article, self.box = text, links, article, box


def lines_of(page: str) -> list[_Line | None]:
    """The lines of a page; None is an empty line that boilerplate leaves."""
    out: list[_Line | None] = []
    parts: list[str] = []
    links = 0  # characters inside links of the current line
    in_link = 0
    stack: list[tuple[str, bool, bool]] = []  # name, boilerplate, article
    open_names: dict[str, int] = {}
    boxes: list[int] = [0]
    next_box = 1
    dropped = articles = 0
    article = 0  # number of the outermost open article
    at, n = 0, len(page)
    no_quote = {'"': n + 1, "'": n + 1}  # from where on there is none

    def flush() -> None:
        nonlocal links
        text = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        parts.clear()
        if text and not dropped:
            out.append(_Line(text, links, article, tuple(boxes)))
        links = 0

    def pop() -> None:
        nonlocal dropped, articles, article, in_link
        name, bad, is_article = stack.pop()
        open_names[name] -= 1
        if name in BLOCKS:
            flush()
            boxes.pop()
        if name == "a":
            in_link -= 1
        if bad:
            flush()
            dropped -= 1
            if not dropped:
                out.extend([None] * WINDOW)
        if is_article:
            articles -= 1
            if not articles:
                article = 0

    while at < n:
        open_at = page.find("<", at)
        if open_at < 0:
            open_at = n
        if open_at > at and not dropped:
            parts.append(page[at:open_at])
            if in_link:
                links += open_at - at
        if open_at == n:
            break
        if page.startswith("<!--", open_at):
            end = page.find("-->", open_at + 4)
            at = n if end < 0 else end + 3
            continue
        tag = TAG.match(page, open_at)
        if tag is None:
            if page[open_at + 1:open_at + 2] in ("!", "?", "/"):
                end = page.find(">", open_at)
                at = n if end < 0 else end + 1
            else:  # a bare less-than sign is text
                if not dropped:
                    parts.append("<")
                at = open_at + 1
            continue
        name = tag[1].lower()
        # the end of the tag: a > outside quotes
        end = at_attribute = tag.end()
        while True:
            close = page.find(">", end)
            if close < 0:
                close = n
            quotes = [(page.find(q, end, close), q) for q in "\"'"]
            first = min(((i, q) for i, q in quotes if i >= 0), default=None)
            if first is None or first[0] >= no_quote[first[1]] or page[first[0] - 1] not in "= \t\n\r":
                break
            other = page.find(first[1], first[0] + 1)
            if other < 0:
                no_quote[first[1]] = first[0]
                break
            end = other + 1
        attributes, at = page[at_attribute:close], close + 1
        if page[open_at + 1] == "/":
            if open_names.get(name):
                while stack[-1][0] != name:
                    pop()
                pop()
            elif name in ("p", "br"):
                flush() if name == "p" else parts.append(" ")
            continue
        if name == "br" or name == "wbr":
            if not dropped:
                parts.append(" " if name == "br" else "")
            continue
        if name in VOID:
            if name == "hr":
                flush()
            continue
        if name in RAW:
            found = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.I).search(page, at)
            close = -1 if found is None else page.find(">", found.end())
            at = n if close < 0 else close + 1
            continue
        if attributes.endswith("/") and name not in BLOCKS:
            continue
        # elements that end by the start of the next
        if name in BLOCKS:
            above = len(stack)
            while above and stack[above - 1][0] not in BLOCKS:  # what is open inside the innermost block goes with it
                above -= 1
            ends = (name, "p") if name in ("p", "li", "dt", "dd", "tr", "td", "th") else ("p",)
            if above and stack[above - 1][0] in ends:
                while len(stack) >= above:
                    pop()
        elif name == "option" and stack and stack[-1][0] == name:
            pop()
        is_article = name in ("article", "main")
        bad = _dropped(name, attributes, articles > 0 or is_article)
        if name in BLOCKS or bad:
            flush()
        if bad:
            if not dropped:
                out.extend([None] * WINDOW)
            dropped += 1
        is_article = is_article and not bad and not dropped
        if is_article:
            if not articles:
                article = next_box
            articles += 1
        if name in BLOCKS:
            boxes.append(next_box)
            next_box += 1
        if name == "a":
            in_link += 1
        stack.append((name, bad, is_article))
        open_names[name] = open_names.get(name, 0) + 1
    while stack:
        pop()
    flush()
    return out


def stretches_of(length: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) line of every stretch between a surge and a dive of the window sums."""
    total = np.concatenate([[0], np.cumsum(np.append(length, np.zeros(WINDOW, dtype=np.int64)))])
    sums = total[WINDOW:] - total[:-WINDOW]  # sums[i]: lines i to i + WINDOW - 1
    surge = min(SURGE, sums.max() * SURGE_SHARE)
    out = []
    i = 0
    while i < len(length):
        if length[i] and sums[i] > surge:
            end = i
            while end < len(length) and sums[end]:
                end += 1
            out.append((i, end - 1))
            i = end
        i += 1
    return out


def home_of(lines: list[_Line | None], length: np.ndarray, stretches: list[tuple[int, int]]) -> int:
    """The smallest container with ``HOME_SHARE`` of the stretches' text."""
    weight: dict[int, int] = {}
    for a, b in stretches:
        for i in range(a, b + 1):
            if length[i]:
                for box in lines[i].box[:-1] or (0,):  # the last box is the line's own block
                    weight[box] = weight.get(box, 0) + int(length[i])
    # boxes are numbered as they open, so of those that hold each other the smallest has the largest number
    return max(box for box, n in weight.items() if n >= HOME_SHARE * weight[0])


def extract(page: str | None) -> str:
    """The main text of one page."""
    lines = lines_of(page) if page else []
    whole = np.array([0 if line is None else len(line.text) for line in lines], dtype=np.int64)
    if not whole.any():
        return ""
    length = np.where([line is None or line.links >= LINK_SHARE * len(line.text) for line in lines], 0, whole)
    if not length.any():  # nothing but links
        length = whole
    stretches = stretches_of(length)
    if not stretches:
        return ""
    home = home_of(lines, length, stretches)
    inside = np.array([line is not None and home in line.box for line in lines])
    kept = np.zeros(len(lines), dtype=bool)
    for a, b in stretches:
        while a > 0 and length[a - 1] and inside[a - 1]:
            a -= 1
        while b + 1 < len(lines) and length[b + 1] and inside[b + 1]:
            b += 1
        kept[a:b + 1] |= inside[a:b + 1]
    articles = {lines[i].article for i in np.flatnonzero(kept)} - {0}
    return "\n".join(line.text for i, line in enumerate(lines) if line is not None and (kept[i] or line.article in articles))


def main_text(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` with ``text`` instead of the markup column, and ``n_chars``; all rows and other columns stay, columns of these
    names that are already there are replaced."""
    kept = [c for c in pages.columns if c not in (column, "text", "n_chars")]
    frame = pages.select(*kept, column)
    schema = StructType([f for f in frame.schema.fields if f.name != column] + StructType.fromDDL("text string, n_chars bigint").fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, column, 8 << 20):
                texts = [extract(p) for p in part.column(column).to_pylist()]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                                 [*kept, "text", "n_chars"])

    return frame.mapInArrow(run, schema)
