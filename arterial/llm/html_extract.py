"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. What browsers don't show as text (scripts, styles, markup, comments, hidden
elements, fallback content of media) and what pages mark as something else than content goes with all it holds: landmark
elements and roles (navigation, header outside an article, footer, aside, form, ...) and elements of which a whole name in
class or id says so (`sidebar`, `cookie-notice`, `ad-slot`; not `has-sidebar` or `overflow-hidden`: a name counts only if
each of its parts is such a word or a neutral one).

First pass: length, link density and stop-word density decide each block that is left: good, bad, or open (short, or in
between). Inside the page's article or main element the same figures are read more kindly: shorter prose is good too, and
a block isn't bad for few stop words, nor for links unless three or more blocks of links follow each other (a list of
links). Second pass: prose that is only too short becomes good, unless the nearest decided blocks on both sides are bad;
another open block takes the label that those agree on; where they differ, the nearer one's, good at equal distance. Neighbours are looked for on the same side of the article's border. Of
an article without a good block all is good but lists of links; elsewhere an open block without neighbours is bad. On a
page whose article holds good text, blocks outside are bad.

Text inside a block: character references decoded, white space made one space, trimmed. Blocks are joined by \\n.

Edge cases: null, empty or text-free html gives empty text; a page that breaks off inside a comment, script or tag keeps
what came before; unclosed elements end with the element around them; rows are independent: repeated rows, a null page_id
or url and pages of any length are taken as they are; extra columns are ignored, whatever their names; an empty table
gives no rows.
"""

from __future__ import annotations

import html as _html
import re
from functools import partial

from arterial.llm.common import bound_batches, quiet_worker

SHORT, LONG = 70, 140
MOST_LINKS = 0.2
#: In an article: the link density of a block of links, and how many of them in a row make a list of links.
ARTICLE_LINKS, LINK_LIST = 0.5, 3
FEW_STOPS, MANY_STOPS = 0.1, 0.2
SCHEMA = "page_id long, url string, text string, n_chars long"

BLOCK_TAGS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td"
    " tfoot th thead title tr ul".split())
VOID_TAGS = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements without text of the page itself, and landmarks that aren't its content.
DROP_TAGS = set("head nav footer aside form button select menu dialog iframe object noscript template svg canvas audio video".split())
DROP_ROLES = set("alert alertdialog banner complementary contentinfo dialog menu menubar navigation search toolbar tooltip".split())
#: Words by which pages name what isn't content, and words that say nothing beside them.
DROP_NAMES = set(
    "ad ads advert adverts advertisement advertisements adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb"
    " breadcrumbs sidebar aside footer masthead header topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay"
    " subscribe newsletter signup login search share sharing social related recommended comment comments disqus respond replies pagination"
    " pager copyright".split())
NEUTRAL_NAMES = set(
    "a area articles bar block bottom box btn buttons container content fixed form global group horizontal icons inner items js left links list main"
    " media message module news outer panel posts primary reader readers right secondary section site slot small sticky stories text the thread"
    " top unit user users vertical widget wrap wrapper".split())
#: Of the names of headings, and of an article's ids that are often anchors, only these count.
COMMENT_NAMES = set("comment comments disqus respond replies".split())
STOPS = set(
    "a about after all also an and are as at be been but by can could did do for from had has have he her him his how i if in into is it its me"
    " more my no not of on one or our out she so than that the their them then there these they this to up was we were what when which who will"
    " with would you your"
    " au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais me nous on ou par pas pour qu que qui sa se ses"
    " son sur un une vous y"
    " aber als auch auf aus bei bin das dass dem den der des die du ein eine einem einen einer er es für hat ich ihr im in ist mit nach nicht"
    " noch nur oder sich sie sind so über um und uns von vor war was wie wir zu zum zur"
    " al como con del el ella en era es esta este la las lo los más no nos para pero por que se si sin sobre su sus un una y ya".split())

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<!\[CDATA\[(?:.*?\]\]>|.*)|<(script|style|textarea|xmp)\b[^>]*>(?:.*?</\1\s*>|.*)|<(/?)([a-zA-Z][\w:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|<(?:/?[a-zA-Z][^<>]*$)?|[^<]+",
    re.S | re.I)
_ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORD = re.compile(r"[^\W\d_]+")


def _named(value: str, names: set) -> bool:
    """Whether one of the space-separated names consists of such words, neutral ones and numbers."""
    for name in value.lower().split():
        parts = [p for p in re.split(r"[^a-z0-9]+", name) if p and not p[0].isdigit()]
        if any(p in names for p in parts) and all(p in names or p in DROP_NAMES or p in NEUTRAL_NAMES for p in parts):
            return True
    return False


def _dropped(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in DROP_TAGS or (tag == "header" and not in_article):
        return True
    if not attributes or tag in ("html", "body"):
        return False
    found: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(attributes):
        found.setdefault(name.lower(), value.strip("\"'"))
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"(display\s*:\s*none|visibility\s*:\s*hidden)", found.get("style", ""), re.I):
        return True
    if tag in ("article", "main"):
        return False
    if found.get("role", "").lower() in DROP_ROLES:
        return True
    heading = len(tag) == 2 and tag[0] == "h"
    anchor = heading or (in_article and tag not in ("div", "ul", "ol", "dl", "table", "ins"))
    return _named(found.get("class", ""), COMMENT_NAMES if heading else DROP_NAMES) or _named(found.get("id", ""), COMMENT_NAMES if anchor else DROP_NAMES)


def blocks(page: str) -> list[tuple[str, int, bool]]:
    """(text, characters in links, inside article or main) of each block that isn't dropped, in page order."""
    out: list[tuple[str, int, bool]] = []
    stack: list[tuple[str, bool]] = []  # open elements, and whether each drops what it holds
    dropping = links = articles = 0
    text: list[str] = []
    linked = [0]

    def end_block() -> None:
        whole = " ".join("".join(text).split())
        if whole:
            out.append((whole, linked[0], articles > 0))
        text.clear()
        linked[0] = 0

    def pop() -> None:
        nonlocal dropping, links, articles
        tag, drops = stack.pop()
        dropping -= drops
        links -= tag == "a"
        articles -= tag in ("article", "main")

    open_tags: dict[str, int] = {}
    for m in _TOKEN.finditer(page):
        tag = m[3]
        if tag is None:
            piece = m[0]
            if m[1] is None and (piece[0] != "<" or piece == "<") and not dropping:
                piece = _html.unescape(piece)
                text.append(piece)
                if links:
                    linked[0] += len(piece.strip())
            continue
        tag = tag.lower()
        if tag in BLOCK_TAGS:
            end_block()
        elif tag == "br":
            text.append(" ")
        if tag in VOID_TAGS:
            continue
        if m[2]:
            if open_tags.get(tag):
                while True:
                    last = stack[-1][0]
                    pop()
                    open_tags[last] -= 1
                    if last == tag:
                        break
            continue
        if tag in BLOCK_TAGS and stack and stack[-1][0] == "p":
            pop()
            open_tags["p"] -= 1
        if m[4].rstrip().endswith("/") and tag not in BLOCK_TAGS:
            continue
        drops = _dropped(tag, m[4], articles > 0)
        stack.append((tag, drops))
        open_tags[tag] = open_tags.get(tag, 0) + 1
        dropping += drops
        links += tag == "a"
        articles += tag in ("article", "main")
    end_block()
    return out


#: The label of prose that is too short to be good by itself.
NEAR = "near"


def classify(text: str, linked: int, in_article: bool) -> bool | str | None:
    """First pass: good, bad, near, or open (None)."""
    density = linked / len(text)
    if in_article and density > ARTICLE_LINKS:
        return None  # label_links() looks at its neighbours
    if not in_article and density > MOST_LINKS:
        return False
    if len(text) < SHORT:
        return False if linked and not in_article else None
    words = _WORD.findall(text.lower())
    stops = sum(w in STOPS for w in words) / max(1, len(words))
    if stops >= MANY_STOPS:
        return True if in_article or len(text) > LONG else NEAR
    return None if in_article or stops >= FEW_STOPS else False


def label_links(found: list[tuple[str, int, bool]], labels: list[bool | None]) -> None:
    """Marks lists of links inside an article as bad."""
    first = 0
    for k in range(len(found) + 1):
        if k < len(found) and found[k][2] and found[k][1] > ARTICLE_LINKS * len(found[k][0]):
            continue
        if k - first >= LINK_LIST:
            labels[first:k] = [False] * (k - first)
        first = k + 1


def _decided(labels: list) -> list[tuple]:
    """By block, the nearest decided one before it and after it, as (place, label) or None."""
    sides = []
    for order in (range(len(labels)), range(len(labels) - 1, -1, -1)):
        near, last = [None] * len(labels), None
        for k in order:
            near[k] = last
            if labels[k] is True or labels[k] is False:
                last = (k, labels[k])
        sides.append(near)
    return list(zip(*sides, strict=True))


def inherit(labels: list) -> list[bool]:
    """Second pass: prose that is near good is bad only between bad ones; then open blocks take their nearest decided
    neighbours' label, the nearer one's where they differ, good at equal distance. Without any they are bad."""
    labels = [not all(n and not n[1] for n in near) if x == NEAR else x for x, near in zip(labels, _decided(labels), strict=True)]
    out = []
    for k, (x, near) in enumerate(zip(labels, _decided(labels), strict=True)):
        if x is None:
            far = {True: len(labels), False: len(labels)}
            for n in near:
                if n:
                    far[n[1]] = min(far[n[1]], abs(n[0] - k))
            x = far[True] <= far[False] and far[True] < len(labels)
        out.append(x)
    return out


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    labels = [classify(*x) for x in found]
    label_links(found, labels)
    good = [False] * len(found)
    for side in (True, False):
        if not side and any(good):
            break  # the article holds the text
        at = [k for k, x in enumerate(found) if x[2] == side]
        seen = [labels[k] for k in at]
        if side and True not in seen:  # no prose in a known language: the article's tag decides all but lists of links
            seen = [label is not False for label in seen]
        for k, label in zip(at, inherit(seen), strict=True):
            good[k] = label
    return "\n".join(x[0] for x, keep in zip(found, good, strict=True) if keep)


def _extract(batches):
    import pyarrow as pa

    quiet_worker()
    for batch in batches:
        ids, urls = batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string())
        for first in range(0, len(ids), 256):
            texts = [main_text(x.as_py()) for x in batch.column(2)[first : first + 256]]
            yield pa.RecordBatch.from_arrays(
                [ids[first : first + 256], urls[first : first + 256], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])


def extract(pages, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"):
    """One row per page with its main text."""
    bound_batches(pages.sparkSession)
    from pyspark.sql import functions as F

    three = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string"))
    return three.mapInArrow(partial(_extract), SCHEMA)
