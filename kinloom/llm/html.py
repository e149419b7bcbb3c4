"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped to lines, one for each block of text. Lines of menus, notices
and the like are left out. The lengths outside links summed over a sliding
window of lines rise at a surge point and fall to nothing at a dive point; all
text between the first surge and the last dive is kept, short lines included,
but for menus: windows of lines that are links only. Lines outside an
``article`` or ``main`` element, where a page has one, count as length 0; surge and dive points aren't used there,
as the container marks start and end: all its lines are kept but for menus. A list of links under a heading or after a colon
is no menu there.

An element is left out for its kind (``nav``, ``footer``, ...) or for what its class, id or role calls it, with all
it holds, an ``article`` too; so is an ``article`` in an ``article``, which HTML has for comments. What a name says is weighed
against the text: an element with the page's heading or ``main`` stays, whatever it is called, and so does one with most of the
text if nothing else were left. Names that may well stand at an article too (``form``, ``search``, ...) leave an element
out only if it holds less than half of the text. A name with a word of its own before it (``lead-ad``) doesn't
leave out a paragraph, nor a box whose lines are text rather than links.

Defined results: a null or empty page has an empty text; broken or truncated
markup is read as far as it goes; repeated rows are extracted alike; an empty
table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bound_batches

#: Lines in a window, and the text that a window must hold to start a surge (less on short pages).
WINDOW, SURGE_CHARS = 3, 80

# Raw text runs to the end of the page if it isn't closed; other elements that hold no text go only if they are.
_RAW = re.compile(r"<!--|<(script|style|textarea|title|head|template|noscript|iframe|svg|select|object|canvas)\b", re.I)
_TO_THE_END = frozenset("script style textarea title".split())
_BODY = re.compile(r"<body\b", re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][\w:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/a-zA-Z][^>]*(?:>|\Z)")
_ATTRIBUTE = re.compile(r"\b(class|id|role|style|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_NAME = re.compile(r"[a-z]+")

# Elements of HTML by their part in a page.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ASIDE = frozenset("nav aside footer button menu dialog".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote li dd td pre".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN = frozenset("article main".split())
# Words in class, id and role that name what is no main text, by experience.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr newsletter signup signin sidebar "
    "menu nav navbar navigation breadcrumb breadcrumbs footer comment comments commentlist disqus respond toolbar pagination pager contentinfo".split())
# The same where they may also speak of an article or its frame.
DOUBTFUL = frozenset(
    "promo promotion banner notice notices notification alert popup modal overlay subscribe subscription login widget widgets copyright legal "
    "disclaimer reply replies discussion share sharing social related recommended recommendations search complementary dialog form".split())
# Words after a name that only say what shape it has.
SHAPES = frozenset("area bar block box button buttons container content group holder inner item items left link links list outer panel posts right row section top bottom wrap wrapper".split())
# Words before a name that only say where it is or whose.
PLACES = frozenset(
    "site page post entry main top bottom left right header head mobile desktop sticky inline primary secondary global local user users reader readers "
    "google text blog web app sub side js is the my all new big small".split())
NEGATIONS = frozenset("has with no without".split())
HEADS = frozenset("header masthead topbar".split())


#: What an element may be, by its kind or name.
TEXT, DOUBT, SURE, COMPOUND = 0, 1, 2, 3


def _called(value: str, in_main: bool) -> int:
    """What a class, id or role calls its element: by the last word of a token that isn't a shape. With a word of its own
    before that one it is a ``COMPOUND``."""
    found = set()
    for token in value.split():
        words = _NAME.findall(token)
        if NEGATIONS.intersection(words):  # "has-sidebar" says what is elsewhere
            continue
        while len(words) > 1 and words[-1] in SHAPES:
            words.pop()
        last = words[-1] if words else ""
        if last in NAMES or not in_main and last in HEADS:
            found.add(SURE if all(w in PLACES or w in NAMES or w in DOUBTFUL or w in SHAPES or w in HEADS or len(w) < 3 for w in words[:-1]) else COMPOUND)
        elif last in DOUBTFUL:
            found.add(DOUBT)
    return next((k for k in (SURE, COMPOUND, DOUBT) if k in found), TEXT)


def _kind(name: str, attributes: str, in_main: bool) -> int:
    """What an element is; negative if it is so whatever it holds."""
    if name in ASIDE or name == "header" and not in_main:
        return -SURE
    if name in ("html", "body"):
        return TEXT
    found = DOUBT if name == "form" else TEXT
    for key, a, b, c in _ATTRIBUTE.findall(attributes) if attributes and attributes.strip() else ():
        key, value = key.lower(), (a or b or c).lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return -SURE
        if key in ("class", "id", "role") and (called := _called(value, in_main)):
            found = called if found in (TEXT, DOUBT) or called == SURE else found
    return TEXT if found == COMPOUND and name in PROSE else found


def without_raw(page: str) -> str:
    """The page without comments and elements that hold no text, in one pass: what closes an element is searched for once."""
    out, at, start = [], 0, 0
    closing: dict[str, int | None] = {}
    pattern: dict[str, re.Pattern] = {}

    def end_of(name: str, place: int) -> tuple[int, int] | None:
        """Where the next closing tag of the name is."""
        if name not in pattern:
            pattern[name] = re.compile("-->" if name == "!" else ">" if name == ">" else rf"</{name}\s*>", re.I)
        known = closing.get(name, -1)
        if known is not None and known < place:
            m = pattern[name].search(page, place)
            closing[name] = known = m.start() if m else None
        return None if known is None else (known, pattern[name].match(page, known).end())

    while m := _RAW.search(page, at):
        name = (m[1] or "!").lower()
        after = end_of(">", m.end()) if m[1] else (0, m.end())
        if after is None:  # a tag that isn't closed: the tags' pattern takes the rest
            break
        close = end_of(name, after[1])
        if name == "head":
            body = end_of_body = _BODY.search(page, after[1]) if "body" not in closing else closing["body"]
            closing["body"] = end_of_body
            to = close[1] if close else None
            if body and body.start() >= after[1] and (to is None or body.start() < to):
                to = body.start()
        elif close:
            to = close[1]
        else:
            to = len(page) if name in _TO_THE_END or name == "!" else None
        if to is None:
            at = m.end()
            continue
        out.append(page[start:m.start()])
        start = at = to
    out.append(page[start:])
    return "".join(out)


def ends_of(tags: list[re.Match]) -> dict[int, int]:
    """Where the element that opens at a place ends: at its own closing tag, or where an element around it
    closes or a paragraph or item gives way to the next. Elements that stay open to the end of the page have none."""
    ends: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    depth: dict[str, int] = {}

    def pop(end: int) -> str:
        name, place = stack.pop()
        depth[name] -= 1
        ends[place] = end
        return name

    for m in tags:
        if not m[2]:
            continue
        name = m[2].lower()
        if name in VOID or name == "a":
            continue
        if m[1]:
            if depth.get(name):
                while stack[-1][0] != name:
                    pop(m.start())
                pop(m.end())
        elif not m[3].endswith("/"):
            if stack and (stack[-1][0] == "p" and name not in INLINE or stack[-1][0] == name == "li"):
                pop(m.start())
            stack.append((name, m.start()))
            depth[name] = depth.get(name, 0) + 1
    return ends


def lines_of(page: str) -> list[tuple[str, int, bool, str]]:
    """``(text, characters outside links, inside article or main, element)`` of each block; marks alone
    between links don't count. Which named elements stay is decided by what they hold."""
    page = without_raw(page)
    tags = list(_TAG.finditer(page))
    ends = ends_of(tags)
    lines, named, heads = _lines(page, tags, ends, None)
    return _lines(page, tags, ends, _staying(named, heads))[0] if named else lines


def _staying(named: list[tuple[int, int, int, int, int, int]], heads: list[int]) -> frozenset:
    """The places of the named elements that stay. ``named`` has ``(place, end, kind, text, plain text, all text)``."""
    named = sorted(named)
    total = named[0][5]
    headed = lambda e: bisect_left(heads, e[0] + 1) < bisect_left(heads, e[1])
    rest, upto = total, -1
    for e in named:  # the outermost ones that go for sure
        if e[2] == SURE and e[0] >= upto and not headed(e):
            rest -= e[3]
            upto = e[1]
    if rest < min(SURGE_CHARS, total):  # nothing else would be left
        rest = total
    stay = set()
    for e in named:
        most = 2 * e[3] >= rest and e[3] > 0
        if headed(e) or most and (e[2] != SURE or rest == total) or e[2] == COMPOUND and e[4] >= SURGE_CHARS and 2 * e[4] >= e[3]:
            stay.add(e[0])
    return frozenset(stay)


def _lines(page: str, tags: list[re.Match], ends: dict[int, int], stay: frozenset | None) -> tuple[list[tuple[str, int, bool, str]], list, list[int]]:
    """The lines without named elements but those at the places ``stay``. With None all of them
    stay, and what they hold is returned, with the places of the headings and of ``main``."""
    lines: list[tuple[str, int, bool, str]] = []
    block = ""
    named: list[tuple[int, int, int, int, int, int]] = []
    heads: list[int] = []
    text: list[str] = []
    plain = seen = told = 0  # of the line; of all lines, and of that outside links
    link = main = articles = 0
    skip, until = "", 0
    open_ones: list[tuple[int, int, int, int, int]] = []  # place, end, kind, characters and plain ones before

    def flush() -> None:
        nonlocal plain
        if text:
            line = " ".join(entities.unescape("".join(text)).split())
            if line:
                lines.append((line, plain, main > 0, block))
            text.clear()
            plain = 0

    def take(part: str) -> None:
        nonlocal plain, seen, told
        if part and not skip:
            text.append(part)
            n = len(part.strip())
            seen += n
            if not link and any(map(str.isalnum, part)):
                plain += n
                told += n

    def close(upto: int) -> None:
        while open_ones and open_ones[-1][1] <= upto:
            place, end, kind, before, plain_before = open_ones.pop()
            named.append((place, end, kind, seen - before, told - plain_before, 0))

    at = 0
    for m in tags:
        if skip and until and m.start() < until:
            continue
        if skip and until:
            skip, at = "", until
        take(page[at:m.start()])
        at = m.end()
        close(m.start())
        if not m[2]:
            continue
        name, closes = m[2].lower(), bool(m[1])
        if skip:  # an element that stays open to the end
            if closes or not (name in MAIN or skip == "p" and name not in INLINE):
                continue
            skip = ""
        if not closes and name not in VOID:
            kind = _kind(name, m[3], main > 0)
            if name == "article" and articles and not kind:
                kind = DOUBT  # an article in an article is a comment
            if abs(kind):
                place, end = m.start(), ends.get(m.start(), 0)
                if kind < 0 or stay is not None and place not in stay:
                    if name not in INLINE:
                        flush()
                    if not m[3].endswith("/"):
                        skip, until = name, end
                    continue
                if stay is None and not m[3].endswith("/"):
                    open_ones.append((place, end or len(page) + 1, kind, seen, told))
            if name == "h1" or name == "main":
                heads.append(m.start())
        if name == "br" or name == "img":
            take(" ")
        elif name not in INLINE:
            if name in ("td", "th"):
                take(" ")
                continue
            flush()
            link, block = 0, "" if closes else name
            if name in MAIN:
                main = max(0, main + (-1 if closes else 1))
                if name == "article":
                    articles = max(0, articles + (-1 if closes else 1))
        elif name == "a":
            link = 0 if closes else 1
    if skip and until:
        skip, at = "", until
    take(page[at:])
    close(len(page) + 1)
    flush()
    return lines, [(*e[:5], seen) for e in named], heads


def without_menus(lines: list[tuple[str, int, str]], introduced: bool = False) -> list[str]:
    """The texts but for windows of lines that are links only, each in an element of one kind; with ``introduced``
    those after a heading or a colon stay."""
    out, k, n = [], 0, len(lines)
    while k < n:
        to = k
        while to < n and not lines[to][1] and lines[to][2] == lines[k][2]:
            to += 1
        if to - k < WINDOW or introduced and k and (lines[k - 1][2] in HEADINGS or lines[k - 1][0].endswith(":")):  # else a menu
            to = max(to, k + 1)
            out += [lines[x][0] for x in range(k, to)]
        k = to
    return out


def main_lines(lines: list[tuple[str, int, bool]]) -> list[str]:
    """The lines between surge and dive points, or those of a container."""
    inside = [(t, k, e) for t, k, m, e in lines if m]
    if inside:
        # marks without a letter or digit count as text where no link is near
        return without_menus([(t, k or not any(map(str.isalnum, t)), e) for t, k, e in inside], introduced=True)
    lengths = [n for _, n, _, _ in lines]
    n = len(lengths)
    sums = [sum(lengths[i:i + WINDOW]) for i in range(n)]
    top = max(sums, default=0)
    if not top:
        return []
    surge = min(SURGE_CHARS, top)
    start, end, i = None, 0, 0
    while i < n:
        if sums[i] < surge:
            i += 1
            continue
        if start is None:
            start = i
            while start and lengths[start - 1]:
                start -= 1
        end = i
        while end < n and sums[end]:
            end += 1
        i = end + 1
    return without_menus([(t, k, "") for t, k, _, _ in lines[start:end]])  # a linked title right beside a menu goes with it


def main_text(page: str | None) -> str:
    return "\n".join(main_lines(lines_of(page))) if page else ""


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of ``pages(page_id, url, html)``."""
    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))

    bound_batches(pages.sparkSession)

    def run(batches):
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"{kinds}, text string, n_chars bigint")
