"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. The first pass decides blocks by what surrounds
them (menus, footers, adverts and the like), by link density, by length and by the density of
stop words. Blocks too short to tell stay ambiguous; in the second pass they take the label of the
nearest decided neighbour in the same article. Pages are scanned once with one pattern for tags;
nothing is shuffled.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import no_clash, ship, utf8

# Frequent words of English, German, French and Spanish; element names of HTML; words in class and id names.
STOP_WORDS = frozenset(
    """the of and to a in is that it for was on are as with his they be at one have this from or had by but not what all were we when your can
    der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei
    de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec son ou
    el los las por con para no su al lo como más pero sus le ya o este sí porque esta entre cuando""".split()
)
RAW = ("script", "style", "noscript", "template", "title", "textarea", "select", "button", "option", "svg", "math", "iframe", "object", "canvas", "video", "audio")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head
    header hr html legend li main menu nav ol optgroup p pre search section summary table tbody td tfoot th thead tr ul""".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BAD_ELEMENTS = frozenset("head nav footer aside form menu dialog fieldset search".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary dialog alertdialog alert form search menu menubar".split())
BAD_NAMES = frozenset(
    """ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner sidebar nav navbar navigation menu submenu breadcrumb
    breadcrumbs footer cookie cookies consent gdpr notice popup modal overlay newsletter subscribe signup login form comment comments disqus reply replies respond share
    sharing social related recommended pagination pager toolbar""".split()
)

#: Quotes in a tag are heeded up to about 200 attributes, beyond that it ends at its first angle bracket: each try is short, even in a page full of open quotes.
_TAG = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{'|'.join(RAW)})\b[^<>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"""|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/<>]*)(?P<rest>(?:[^"'<>]++|"[^"]{0,2000}"|'[^']{0,2000}'){0,400}+)>|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/<>]*)(?P<rest2>[^<>]*)>|<[!?/][^<>]*>""",
    re.S | re.I,
)
_UNENDED = re.compile(r"<[a-zA-Z/!?][^>]*+\Z")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_NAME_PARTS = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_LETTERS = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Rules:
    """short: characters below which a block alone decides nothing; links: share of characters in links from which it is a menu;
    stops: share of stop words among words from which a longer block is text."""

    short: int = 70
    links: float = 0.33
    stops: float = 0.1
    stop_words: frozenset[str] = STOP_WORDS


@dataclass
class Block:
    text: str
    link_chars: int
    bad: bool  # inside a menu, a footer, an advert or the like
    scope: int  # the innermost article or main element, 0 for none
    container: int  # the innermost element that is no paragraph, cell or the like, 0 for the page's body
    heading: bool
    good: bool | None = field(default=None)


@dataclass
class _Open:
    name: str
    bad: bool
    scope: int
    container: int


def _is_bad(name: str, rest: str, scope: int) -> bool:
    """Do the element's name or attributes say that it holds no main text?"""
    if name in BAD_ELEMENTS or name == "header" and not scope:
        return True
    if name in ("html", "body", "main") or not rest:
        return False
    for key, value in _ATTRIBUTE.findall(rest):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value in BAD_ROLES or key == "style" and _HIDDEN.search(value):
            return True
        if key in ("class", "id") and not BAD_NAMES.isdisjoint(_NAME_PARTS.findall(value)):
            return True
        if key in ("class", "id") and not scope and {"header", "masthead"} & {*_NAME_PARTS.findall(value)}:
            return True
    return False


def page_blocks(page: str) -> list[Block]:
    """The blocks of a page that hold any text, in page order."""
    blocks: list[Block] = []
    open_: list[_Open] = []
    pieces: list[str] = []
    state = {"links": 0, "breaks": 0, "heading": False, "own": False, "elements": 0}
    in_link = 0

    def flush() -> None:
        text = " ".join(html.unescape("".join(pieces)).split())
        if text:
            top = open_[-1] if open_ else _Open("", False, 0, 0)
            blocks.append(Block(text, min(state["links"], len(text)), top.bad or state["own"], top.scope, top.container, state["heading"]))
        pieces.clear()
        state["links"] = 0

    def add(text: str) -> None:
        pieces.append(text)
        if in_link:
            state["links"] += len(" ".join(html.unescape(text).split()))

    at = 0
    for tag in _TAG.finditer(page):
        if tag.start() > at:
            add(page[at : tag.start()])
            if not page[at : tag.start()].isspace():
                state["breaks"] = 0
        at = tag.end()
        name = (tag["name"] or tag["name2"] or "").lower()
        if not name:
            if tag["raw"] and tag["raw"].lower() != "title":
                pieces.append(" ")
            continue
        rest, ends = tag["rest"] or tag["rest2"] or "", bool(tag["end"] or tag["end2"])
        if name == "a":
            in_link = 0 if ends else 1
        if name == "br":
            state["breaks"] += 1
            pieces.append(" ")
            if state["breaks"] == 2:  # as good as a new paragraph
                flush()
            continue
        if name in VOID and name != "hr":
            continue
        if name in BLOCK:
            flush()
            state.update(breaks=0, heading=name in HEADINGS and not ends, own=False)
            in_link = in_link if name != "body" else 0
        if name in ("p", "li", "dt", "dd", "tr", "td", "th") or name in HEADINGS:
            # These end with the next block at the latest, so they are no containers.
            state["own"] = not ends and _is_bad(name, rest, open_[-1].scope if open_ else 0)
            continue
        if ends:
            for k in range(len(open_) - 1, -1, -1):
                if open_[k].name == name:
                    if name not in BLOCK and open_[k].bad != (open_[k - 1].bad if k else False):
                        flush()  # a marked inline element is a block of its own
                    del open_[k:]
                    break
            continue
        if name == "body":  # the head ends here, whether it was closed or not
            open_[:] = [o for o in open_ if o.name != "head"]
        outer = open_[-1] if open_ else _Open("", False, 0, 0)
        bad = _is_bad(name, rest, outer.scope)
        if name in BLOCK:
            if rest.rstrip().endswith("/"):
                continue
            state["elements"] += name not in ("html", "body")
            number = state["elements"] if name not in ("html", "body") else 0
            open_.append(_Open(name, outer.bad or bad, number if name in ("article", "main") else outer.scope, number))
        elif bad:
            flush()
            open_.append(_Open(name, True, outer.scope, outer.container))
        elif any(o.name == name for o in open_):  # its end must not close the marked one
            open_.append(_Open(name, outer.bad, outer.scope, outer.container))
    # A tag that never ends takes the rest of the page; it can only begin after the last closing bracket.
    safe = max(at, page.rfind(">") + 1)
    add(page[at:safe] + _UNENDED.sub("", page[safe:], count=1))
    flush()
    return blocks


def _stop_words(text: str, stop_words: frozenset[str]) -> tuple[int, int]:
    """Number of words of a text, and of stop words among them."""
    words = _LETTERS.findall(text.lower())
    return len(words), sum(map(stop_words.__contains__, words))


def decide(blocks: list[Block], rules: Rules) -> None:
    """First pass: label the blocks that can be decided by themselves."""
    rest = []
    for b in blocks:
        if b.bad or b.link_chars > rules.links * len(b.text):
            b.good = False
        elif len(b.text) >= rules.short:
            rest.append((b, *_stop_words(b.text, rules.stop_words)))
    # Where a page as a whole has no stop words it is in another language, and length and links alone decide.
    foreign = sum(stops for _, _, stops in rest) < rules.stops / 5 * sum(words for _, words, _ in rest)
    for b, words, stops in rest:
        if foreign or words and stops >= rules.stops * words:
            b.good = True
        elif not b.scope:
            b.good = False


def _nearest(blocks: list[Block], part: str) -> list[tuple[int | None, int | None]]:
    """For each block the nearest decided ones before and after it of the same scope or container, marked ones left out."""
    found: list[list[int | None]] = []
    for order in (range(len(blocks)), range(len(blocks) - 1, -1, -1)):
        seen: list[int | None] = [None] * len(blocks)
        last: dict[int, int] = {}
        for k in order:
            key = getattr(blocks[k], part)
            seen[k] = last.get(key)
            if blocks[k].good is not None and not (key and blocks[k].bad):
                last[key] = k
        found.append(seen)
    return list(zip(*found, strict=True))


def inherit(blocks: list[Block]) -> None:
    """Second pass: an ambiguous block takes the label of the nearest decided neighbour.

    That is looked for in the element that holds the block, then in its article element or, outside any, in the page.
    Of two equally near ones that differ a heading takes the following, other blocks the one that
    is no text. Without a decided neighbour a block is text if it stands in an article element.
    """
    labels = []
    for k, (b, near, far) in enumerate(zip(blocks, _nearest(blocks, "container"), _nearest(blocks, "scope"), strict=True)):
        left, right = near if near != (None, None) else far
        if b.good is not None:
            labels.append(b.good)
        elif left is None and right is None:
            labels.append(bool(b.scope))
        elif left is None or right is None:
            labels.append(bool(blocks[right if left is None else left].good))
        elif k - left != right - k:
            labels.append(bool(blocks[left if k - left < right - k else right].good))
        else:
            labels.append(bool(blocks[right].good) if b.heading else bool(blocks[left].good and blocks[right].good))
    for b, label in zip(blocks, labels, strict=True):
        b.good = label


def main_text(page: str, rules: Rules = Rules()) -> str:
    """The main text of a page: its good blocks, joined by one space."""
    blocks = page_blocks(page)
    decide(blocks, rules)
    inherit(blocks)
    return " ".join(b.text for b in blocks if b.good)


OUTPUTS = ("text", "n_chars")


def extract_pages(df: DataFrame, rules: Rules = Rules(), id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for every row of df: the main text of the whole page and its code points.

    Null and empty pages and pages without main text have an empty text; ids and addresses may be
    null or repeat, repeated rows give equal rows; pages of any length are read whole, a tag or comment
    that never ends runs to the end of the page. Further columns are left out; id_col and url_col must not be
    named like an output. An empty table gives an empty result.
    """
    no_clash(id_col, url_col, *OUTPUTS)
    no_clash(url_col, *OUTPUTS)
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(cell.as_py().decode("utf-8", "replace"), rules) for cell in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, *OUTPUTS])

    kinds = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (id_col, url_col)]
    return df.select(F.col(id_col), F.col(url_col), utf8(html_col).alias("__utf8")).mapInArrow(run, f"{', '.join(kinds)}, text string, n_chars long")
