"""Main text of HTML pages by line-block distribution.

Markup is stripped into lines (blocks). A line's length counts only text that can belong to the article: none inside
menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles or reader comments, none outside the
page's article (or else its main element) if one has text, and none of links in a page without. Lengths are summed
over sliding windows of lines; where the sum rises over the threshold is a surge, where it falls to nothing a dive.
Every line from the first stretch with a surge to the dive of the last such stretch is kept, short and linked ones too;
what lies before or after, such as a byline or tags behind blocks that are not the article's, goes. Tags are hints only:
in a named article the short lines that lead up to a surge belong to it, and a heading is as good as a surge.

Classes, ids and roles count as whole names only, and those around an article never drop it; headings are not dropped
by their ids. Text in formulas, drawings, objects and noscript is kept.

Defined results: null or empty html, or a page without main text, gives an empty text; unclosed and misnested tags
are closed by their neighbours; a tag without an end is text; repeated rows are extracted each for itself; a null url
stays; an empty table gives no rows; a very long page is read once from front to end, as a whole; columns besides
page_id, url and html, of whatever name, are never read.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..runtime import ship, table
from .words import small_batches, tidy

#: Lines in a window; length that a window must reach.
WINDOW, SURGE = 3, 60

_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_TAG_END = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>")
#: Elements whose content is no markup.
RAW = frozenset("script style template textarea title iframe select".split())
_ATTR = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
#: Fixed names of HTML and of what is not main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
DROP = frozenset("head nav header footer aside form button label input fieldset dialog menu canvas audio video option annotation annotation-xml desc metadata".split())
#: Whole class names; the same as ids, but for those that are as well anchors of an article's sections; roles of ARIA.
DROP_CLASSES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead cookie cookies consent notice notices banner comment comments disqus respond share sharing social related recommended newsletter subscribe subscription signup login popup modal toolbar pagination pager widget gdpr"
    " cookie-notice cookie-banner cookie-bar cookie-consent site-header site-footer site-nav main-nav nav-menu main-menu comment-list comments-area comment-respond share-buttons social-share social-links related-posts related-articles newsletter-signup".split()
)
DROP_IDS = frozenset("sidebar nav navbar breadcrumb breadcrumbs footer masthead comments disqus disqus_thread respond cookie-notice cookie-banner cookie-bar cookie-consent site-header site-footer site-nav main-nav nav-menu main-menu comment-list newsletter-signup".split())
OUTER_IDS = DROP_IDS | frozenset("header menu navigation banner".split())
DROP_ROLES = frozenset("navigation menu menubar banner complementary contentinfo search alert alertdialog dialog toolbar".split())
ARTICLE_CLASSES = frozenset("comment comments ad ads advert promo sponsored related".split())
SPACED = frozenset("text mtd".split())
NEVER_BY_WORD = frozenset("html body main".split())
CLOSES = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def dropped(name: str, attrs: str, inside: bool, around: bool) -> int:
    """1: the element's text is not the article's; 2: only its headings are; 0: it can be.

    inside: within the named article; around: outside of it, so that only what hides the article itself counts.
    """
    if name in DROP and not (name == "form" and not inside):
        return 2 if name == "header" else 1
    if not attrs:
        return 0
    drop = 0
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return 1
        if key == "style":
            if re.search(r"display\s*:\s*none", value, re.I):
                return 1
        elif name not in NEVER_BY_WORD and not (around and name != "article"):
            words = set(value.lower().split())
            if name == "article":
                found = words & ARTICLE_CLASSES if key == "class" else None
            elif key == "id":
                found = words & (DROP_IDS if inside else OUTER_IDS) if name not in HEADINGS else None
            else:
                found = words & (DROP_CLASSES if key == "class" else DROP_ROLES)
            if found:
                if found != {"header"}:
                    return 1
                drop = 2
    return drop


def tags(page: str):
    """(end of the text before it, end of the tag, whether it closes, name, attributes) of each tag, in one pass.

    Comments, declarations and elements that hold no markup come as tags without a name. A tag without an end is text;
    after one whose quotes don't close, quotes no longer hide a tag's end.
    """
    low = page.lower()
    if len(low) != len(page):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in page)
    at, n, quotes = 0, len(page), True
    while (a := page.find("<", at)) >= 0:
        after = page[a + 1 : a + 2]
        if page.startswith("<!--", a):
            z = page.find("-->", a + 4)
            at = n if z < 0 else z + 3
            yield a, at, False, "", ""
        elif page.startswith("<![CDATA[", a) and (z := page.find("]]>", a)) >= 0:
            at = z + 3
            yield a, at, False, "", ""
        elif after and after in "!?/" or after.isalpha() and after.isascii():
            name = _NAME.match(page, a + 1 + (after == "/"))
            plain = page.find(">", a)
            if plain < 0:
                return
            z = plain + 1
            if quotes and name and after != "/":
                m = _TAG_END.match(page, name.end())
                quotes, z = m is not None, m.end() if m else z
            at, kind = z, name[0].lower() if name and after not in "!?" else ""
            if kind in RAW and after != "/":
                close = low.find("</" + kind, z)
                end = page.find(">", close) if close >= 0 else -1
                at, kind = n if end < 0 else end + 1, ""
            yield a, at, after == "/", kind, page[name.end() : z - 1] if kind else ""
        else:
            at = a + 1
            yield None, at, False, "", ""


def lines(page: str, prefer: str | None) -> list[tuple[str, int, int, bool]]:
    """(text, characters that count, characters outside links, whether a heading) of each line; prefer: the element of
    the article, if any."""
    stack: list[tuple[str, int]] = []  # (element, whether it drops its text)
    blocks: list[int] = []  # places of blocks in the stack
    open_: dict[str, int] = {}  # elements in the stack
    out: list[tuple[str, int, int, bool]] = []
    parts: list[tuple[str, bool, bool]] = []  # (text, counts, in a link)
    drops = hard = headings = 0
    heading = False

    def flush():
        nonlocal heading
        if parts:
            text = " ".join("".join([t for t, ok, _ in parts if ok]).split())
            free = " ".join("".join([t for t, ok, link in parts if ok and not link]).split())
            out.append((text, len(text), len(free), heading and bool(text)))
            parts.clear()
        heading = False

    def pop_to(i: int):
        nonlocal drops, hard, headings
        while len(stack) > i:
            name, drop = stack.pop()
            drops -= drop > 0
            hard -= drop == 1
            headings -= name in HEADINGS
            open_[name] -= 1
        while blocks and blocks[-1] >= i:
            blocks.pop()

    def text(t: str):
        nonlocal heading
        if t and (t.strip() or parts):
            named = prefer is None or open_.get(prefer, 0) > 0
            keep_heading = headings and prefer is not None and named and drops and not hard
            heading |= headings > 0
            parts.append((html.unescape(t), bool(named and (not drops or keep_heading)), open_.get("a", 0) > 0))

    at = start = 0
    for before, end, closes, name, attrs in tags(page):
        if before is None:  # a bare "<" is text
            continue
        text(page[start:before])
        at = start = end
        if not name:
            continue
        if name in BLOCK:
            flush()
        elif name in SPACED:
            text(" ")
        if closes:
            if open_.get(name):
                pop_to(next(i for i in reversed(range(len(stack))) if stack[i][0] == name))
            continue
        if name in BLOCK and name != "br" and blocks:  # a block ends an open paragraph, an item the item before it
            last = stack[blocks[-1]][0]
            if last == "p" or last in CLOSES.get(name, ()):
                pop_to(blocks[-1])
        if name in VOID or attrs.rstrip().endswith("/") and name not in BLOCK:
            continue
        inside = prefer is not None and open_.get(prefer, 0) > 0
        drop = dropped(name, attrs, inside, prefer is not None and not inside)
        if name in BLOCK:
            blocks.append(len(stack))
        stack.append((name, drop))
        open_[name] = open_.get(name, 0) + 1
        drops += drop > 0
        hard += drop == 1
        headings += name in HEADINGS
    text(page[at:])
    flush()
    return out


def regions(size: list[int], hint: list[bool] | None) -> list[tuple[int, int]]:
    """(first line, last line + 1) of the stretches of text by the distribution of lengths over sliding windows.

    A stretch ends at the dive, where the lengths of a window of lines sum to nothing, and counts only with a surge,
    where they sum to SURGE. Without a hint it begins at its surge. In a named article it begins after the dive before
    it, as the article's own short lines lead up to the surge, and a heading in it is as good as a surge.
    """
    total = [sum(size[i : i + WINDOW]) for i in range(len(size))]
    out: list[tuple[int, int]] = []
    i = 0
    while i < len(size):
        if not size[i]:
            i += 1
            continue
        j = i
        while j < len(size) and total[j]:
            j += 1
        surge = next((k for k in range(i, j) if size[k] and (total[k] >= SURGE or hint and hint[k])), None)
        if surge is not None:
            out.append((surge if hint is None else i, j))
        i = j
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    for prefer in ("article", "main", None):
        if prefer is None or re.search(rf"<{prefer}\b", page, re.I):
            rows = lines(page, prefer)
            if any(n for _, n, _, _ in rows):
                break
    found = regions([n for _, n, _, _ in rows], [h for *_, h in rows]) if prefer else regions([free for _, _, free, _ in rows], None)
    if not found:  # a page of short lines
        found = [(0, len(rows))]
    return "\n".join(text for text, n, _, _ in rows[found[0][0] : found[-1][1]] if n)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each page."""
    ship(pages.sparkSession)
    kinds = dict(pages.dtypes)

    @tidy
    def run(batches):
        for b in batches:
            texts = [main_text(p) for p in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return small_batches(pages.select("page_id", "url", "html")).mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: every page from its whole html."""
    return extract(table(spark, sf_dir, "pages"))
