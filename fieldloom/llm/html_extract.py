"""Main-text extraction by line-block distribution.

Markup is stripped to lines: a line is the text of one block.  Elements that
never hold the article (menus, headers, footers, sidebars, notices, adverts,
forms, comments, scripts, styles) leave no line; those whose name only hints at
that leave none if they are short or mostly links.  What counts of a line is its
length outside links, or nothing if most of it is links.

The counts are summed over windows of ``WINDOW`` lines.  A surge is where the
sums rise from zero in a stretch that reaches ``LEVEL``, a dive is where they
fall back to zero.  The article goes from the first surge to the last dive, and
all lines with text between them are kept, however short and whatever their
links.  If no sum reaches ``LEVEL``, the level is one character.

A tag that marks the article is evidence on its lines: each counts
``TAG_WEIGHT`` more, and the others count nothing and are left out, unless they
hold more than twice as much text as the tagged ones with that weight.

Edge cases: a null or empty page gives an empty text; unclosed elements end
where their parent or the next block does, comments and scripts at the page's
end; after a tag whose quotation never ends, tags end at the next ``>``; a page
of repeated or equal blocks keeps them all; repeated rows are extracted alike;
other columns are ignored.  A page is read once from its start to its end.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
LEVEL = 80
TAG_WEIGHT = 100

# Element names and words of class, id and role attributes.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
NEVER_MAIN = frozenset("aside button canvas datalist dialog embed footer form head iframe input menu nav noscript object option select svg template textarea".split())
OPTIONAL_END = frozenset("p li dt dd tr td th option thead tbody tfoot".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOISE_WORDS = frozenset(
    "ad ads adsense advert advertisement adverts banner breadcrumb breadcrumbs comment commentlist comments consent cookie cookies disclaimer disqus footer login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion respond sidebar signup sponsor sponsored subscribe toolbar widget widgets".split()
)
HINT_WORDS = frozenset("recommended related replies share sharing skip social".split())
HEADER_WORDS = frozenset("header topbar".split())
NOISE_ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())

RAW = frozenset("script style xmp noembed noframes".split())
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_ATTRS = re.compile(r"(?:\"[^\"]*\"|'[^']*'|[^'\">])*+")
_ATTR = re.compile(r"([a-zA-Z_:-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[a-z0-9]+")


def _noise(name: str, attrs: str, in_article: bool) -> int:
    """2 if the element never holds the article, 1 if its name only hints at that."""
    if name in NEVER_MAIN:
        return 2
    if name == "header":
        return 0 if in_article else 2
    if not attrs or name in ("html", "body", "article", "main", "br", "img"):
        return 0
    found = 0
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or key == "style" and re.search(r"display\s*:\s*none", value) or key == "aria-hidden" and value == "true":
            return 2
        if key == "role" and value in NOISE_ROLES:
            return 2
        if key in ("class", "id"):
            words = set(_WORD.findall(value))
            if words & NOISE_WORDS or words & HEADER_WORDS and not in_article:
                return 2
            found |= bool(words & HINT_WORDS)
    return found


def tags_of(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """(text before, name, whether it ends an element, attributes) of each tag; no name after the last text."""
    at, text, quotes = 0, 0, True
    size = len(page)
    while (at := page.find("<", at)) >= 0:
        begin = at
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            stop, name, inside = (size if end < 0 else end + 3), "", ""
        elif page.startswith("<![CDATA[", at):
            end = page.find("]]>", at)
            stop, name, inside = (size if end < 0 else end + 3), "", page[at + 9 : size if end < 0 else end]
        elif page.startswith(("<!", "<?"), at):
            end = page.find(">", at)
            stop, name, inside = (size if end < 0 else end + 1), "", ""
        elif m := _NAME.match(page, at):
            name, inside = m[2].lower(), ""
            end = _ATTRS.match(page, m.end()).end() if quotes else -1
            if end < 0 or not page.startswith(">", end):
                quotes = False  # one that never ends: no other tag is searched to the page's end
                end = page.find(">", m.end())
                if end < 0:
                    break
            stop = end + 1
            if name in RAW and not m[1]:
                close = re.compile(rf"</{name}\s*>", re.IGNORECASE).search(page, stop)
                stop, name = (close.end() if close else size), ""
        else:
            at += 1
            continue
        yield page[text:begin], name, bool(name and m[1]), page[m.end() : end] if name else inside
        at = text = stop
    yield page[text:], "", False, ""


def lines_of(page: str) -> list[tuple[str, int, bool]]:
    """(text, characters outside links, inside an article) of each line."""
    lines: list[tuple[str, int, bool]] = []
    parts: list[str] = []
    linked, link, article = 0, 0, 0
    skip, depth = "", 0
    hinted, hint_depth, hint_from = "", 0, 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            lines.append((text, max(0, len(text) - linked), article > 0))
        parts.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw and not skip:
            text = _html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if link:
                linked += len(" ".join(text.split()))

    def end_hinted() -> None:
        """Drops the lines of an element that its name hints against, if they are no prose."""
        nonlocal hinted
        flush()
        whole, own = sum(len(x[0]) for x in lines[hint_from:]), sum(x[1] for x in lines[hint_from:])
        if own < LEVEL or 2 * own < whole:
            del lines[hint_from:]
        hinted = ""

    for text, name, ending, attrs in tags_of(page):
        say(text)
        if not name:
            say(attrs)  # of a CDATA section
            continue
        if skip:
            if name == skip:
                depth += -1 if ending else 1 if skip not in OPTIONAL_END else 0
            over = depth <= 0 or not ending and name in ("article", "main", "body") and skip not in ("article", "main")
            if over or skip in OPTIONAL_END and name in BLOCKS and name != skip:
                closed = over and ending
                skip, depth = "", 0
                if closed:
                    continue
            else:
                continue
        if name in BLOCKS or name in ("br", "head"):
            flush()
        if hinted:
            if name == hinted:
                hint_depth += -1 if ending else 1
            if hint_depth <= 0 or not ending and name in ("article", "main"):
                end_hinted()
        if ending:
            if name in ("article", "main"):
                article = max(0, article - 1)
            elif name == "a":
                link = max(0, link - 1)
            continue
        against = _noise(name, attrs, article > 0)
        opened = name not in VOID and not attrs.rstrip().endswith("/")
        if against == 2:
            if opened:
                skip, depth = name, 1
        elif against == 1 and opened and not hinted and name in BLOCKS:
            hinted, hint_depth, hint_from = name, 1, len(lines)
        elif name in ("article", "main"):
            article += 1
        elif name == "a":
            link = 1
    flush()
    if hinted:
        end_hinted()
    return lines


def surge_and_dive(counts: np.ndarray, window: int = WINDOW, level: int = LEVEL) -> tuple[int, int]:
    """The first line of the first surge, and the line after the last dive.

    Window ``i`` sums the lines from ``i - window + 1`` to ``i``.  Both places
    are those of lines that count; without any, both are 0.
    """
    if not counts.any():
        return 0, 0
    upto = np.concatenate([np.zeros(window, dtype=np.int64), np.cumsum(counts), np.full(window - 1, counts.sum())])
    sums = upto[window:] - upto[:-window]
    borders = np.flatnonzero(np.diff(sums > 0, prepend=False, append=False)).reshape(-1, 2)
    tall = np.maximum.reduceat(sums, borders[:, 0]) >= min(level, sums.max())
    if sums.max() < level:
        tall[:] = True
    first, last = borders[tall][0, 0], borders[tall][-1, 1]  # the last sum is zero ``window - 1`` lines after the last that counts
    return int(first), int(last) - window + 1


def main_text(page: str | None) -> str:
    """The article of one page; an empty string if there is none."""
    if not page:
        return ""
    lines = lines_of(page)
    if not lines:
        return ""
    size, own, tagged = (np.array(x) for x in zip(*((len(t), o, i) for t, o, i in lines), strict=True))
    marked = bool(tagged.any()) and own[~tagged].sum() <= 2 * (own[tagged] + TAG_WEIGHT).sum()
    if marked:
        counts = np.where(tagged, own + TAG_WEIGHT, 0)
    else:
        counts = np.where(2 * own >= size, own, 0)
    surge, dive = surge_and_dive(counts)
    return "\n".join(text for text, _, inside in lines[surge:dive] if inside or not marked)


def extract_main_text(pages: DataFrame, id_column: str = "page_id") -> DataFrame:
    """Returns the id, url, text and n_chars of every page."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [id_column, "url", "text", "n_chars"])

    kind = pages.schema[id_column].dataType.simpleString()
    return pages.select(id_column, F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(extract, f"`{id_column}` {kind}, url string, text string, n_chars long")
