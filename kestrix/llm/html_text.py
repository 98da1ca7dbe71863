"""Main text of web pages by two-pass block rules.

A page is cut into blocks of text.  The first pass decides blocks from their
stop-word density, length and link density; short and undecided blocks then
inherit the label of their nearest decided neighbours.

What elements and class words say is one more feature of the first pass.
Blocks inside what is marked as a page's frame are bad; a mark counts for
nothing where it would take the page's text away (on html and body, and on an
element that holds most of the text, if it holds the headline, is the article,
or nothing outside of it reads like text; navigation, headers and footers by
their names are always frame).  Where an article element holds
most of the unmarked text, blocks outside of it are bad, and a low density
inside of it leaves a block undecided.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

# Frequent function words of four languages.
STOP_WORDS = {
    "en": "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was we were which will with you",
    "fr": "a au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour qu que qui sa se ses son sont sur un une vous",
    "de": "als am an auch auf aus bei das dem den der des die ein eine einem einen einer er es für hat ich im in ist mit nach nicht noch oder sich sie sind so um und von war werden wie wir zu zum zur",
    "es": "a al como con de del el en es esta este fue ha la las le lo los más me mi no o para pero por que se ser si sin sobre son su sus un una y ya",
}
#: Elements whose content is no text; that of the first ones is not even markup.
RAW = frozenset("script style title textarea iframe".split())
SKIPPED = RAW | frozenset("noscript template svg math object canvas audio video select button option datalist".split())
#: Elements that end a block.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
#: Elements that an element of the same kind ends, and the ones that keep it from doing so.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr",), ("table",)),
    "tbody": (("thead", "tbody", "tfoot"), ("table",)), "tfoot": (("thead", "tbody", "tfoot"), ("table",)),
}
#: Elements whose text belongs to the frame of a page.
FRAME = frozenset("nav footer aside form menu dialog fieldset".split())
#: Those of them that some pages put around everything.
WRAPPERS = frozenset("aside form fieldset".split())
#: Words of class, id and role attributes that mark the frame.
FRAME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising alert author banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disclaimer discussion disqus "
    "footer form hidden login masthead menu menubar modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted promotion related reply replies respond "
    "search share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar widget widgets".split()
)
LOW_DENSITY, HIGH_DENSITY = 0.15, 0.28
SHORT, LONG, LINKS = 70, 200, 0.4
_WORD = re.compile(r"[^\W\d_]+")
_MARKUP = re.compile(r"<(?=[A-Za-z/!?])")
#: A whole tag: names, and values in either quotes or none.  A quote that nothing closes is a plain character.
_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s>]*+)"""
_TAG = re.compile(rf"<(/?)([A-Za-z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+{_VALUE})?+)*+)>")
_ATTRIBUTE = re.compile(rf"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+({_VALUE}))?+")
_TELLING = re.compile(r"class|id|role|hidden|style", re.IGNORECASE)
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none", re.IGNORECASE)
_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")
_STOPS = [frozenset(words.split()) for words in STOP_WORDS.values()]


@dataclass
class Block:
    """A block of text; mark is the number of the innermost marked element around it, or -1."""

    text: str
    linked: int = 0
    mark: int = -1
    article: bool = False
    heading: bool = False
    frame: bool = False
    label: str = "short"


@dataclass
class Mark:
    """An element that is marked as frame: the marked one around it, and what it is and holds."""

    outer: int
    surely: bool  # by a name that never stands around a page's text
    element: bool  # by its own name, not by an attribute
    article: bool
    headline: bool = False
    chars: int = 0
    readable: int = 0


def _marked(name: str, attributes: str, inside_article: bool) -> tuple[bool, bool]:
    """Whether an element's name marks it as frame, and whether its attributes do."""
    by_name = name in FRAME or name == "header" and not inside_article
    if attributes and _TELLING.search(attributes):
        for key, value in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'")
            if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _HIDDEN_STYLE.search(value):
                return by_name, True
            if key in ("class", "id", "role"):
                words = {w.lower() for w in _PARTS.findall(value)}
                if words & FRAME_WORDS or "header" in words and not inside_article:
                    return by_name, True
    return by_name, False


class _Page:
    """Blocks and marks of a page in order; broken markup is taken as far as it goes, in time linear in its length."""

    def __init__(self, page: str):
        self.blocks: list[Block] = []
        self.marks: list[Mark] = []
        self.stack: list[tuple[str, int, bool]] = []  # name, innermost mark, inside an article
        self.open: dict[str, int] = {}  # how many of a name are on the stack
        self.pieces: list[str] = []
        self.linked = 0
        self.heading = self.link = False
        self._scan(page)

    def _end_block(self) -> None:
        text = " ".join(html.unescape("".join(self.pieces)).split())
        if text:
            _, mark, article = self.stack[-1] if self.stack else ("", -1, False)
            self.blocks.append(Block(text, min(self.linked, len(text)), mark, article, self.heading))
        self.pieces.clear()
        self.linked = 0

    def _pop(self, size: int) -> None:
        for name, *_ in self.stack[size:]:
            self.open[name] -= 1
        del self.stack[size:]

    def _close(self, names: tuple[str, ...], within: tuple[str, ...] = ()) -> None:
        """Close the innermost open element of these names and all inside of it, unless one of ``within`` is further in."""
        if any(self.open.get(n) for n in names):
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] in names:
                    return self._pop(i)
                if self.stack[i][0] in within:
                    return None
        return None

    def _push(self, name: str, attributes: str) -> None:
        if self.stack and self.stack[-1][0] == "p":  # a block start closes an open paragraph
            self._pop(len(self.stack) - 1)
        if name in IMPLIED:
            self._close(*IMPLIED[name])
        _, mark, article = self.stack[-1] if self.stack else ("", -1, False)
        by_name, by_attribute = (False, False) if name in ("html", "body") else _marked(name, attributes, article)
        if by_name or by_attribute:
            self.marks.append(Mark(mark, by_name and name not in WRAPPERS, by_name, name in ("article", "main")))
            mark = len(self.marks) - 1
        if name in ("h1", "main") and mark >= 0:
            self.marks[mark].headline = True
        self.stack.append((name, mark, article or name in ("article", "main")))
        self.open[name] = self.open.get(name, 0) + 1

    def _scan(self, page: str) -> None:
        at, size, endless = 0, len(page), set()
        while at < size:
            m = _MARKUP.search(page, at)
            text = page[at : m.start() if m else size]
            if text:
                self.pieces.append(text)
                if self.link:
                    self.linked += len(text.strip())
            if not m:
                break
            at = m.start()
            if page[at + 1] in "!?":
                start, mark = (at + 4, "-->") if page.startswith("<!--", at) else (at, ">")
                end = page.find(mark, start)
                at = size if end < 0 else end + len(mark)
                continue
            tag = _TAG.match(page, at)
            if not tag:  # "</" and no name, or the page ends inside the tag
                end = -1 if page[at + 1].isalpha() else page.find(">", at)
                at = size if end < 0 else end + 1
                continue
            at = tag.end()
            shut, name, attributes = tag[1], tag[2].lower(), tag[3]
            if name in SKIPPED:
                if not shut and not attributes.endswith("/"):
                    if name not in endless:
                        end = _skipped(page, at, name)
                        if end < 0:
                            endless.add(name)
                        at = max(at, end)
                    if name in endless and name in RAW:
                        at = size
            elif name == "a":
                self.link = not shut
            elif name == "br":
                self.pieces.append(" ")
            elif name in BLOCKS or name == "menu":
                self._end_block()
                self.heading = not shut and len(name) == 2 and name[0] == "h" and name[1].isdigit()
                if shut:
                    self._close((name,))
                elif name == "hr":
                    self._close(("p",), tuple(BLOCKS - {"p"}))
                else:
                    self._push(name, attributes)
        self._end_block()


def _skipped(page: str, at: int, name: str) -> int:
    """End of the skipped element whose start tag ends at ``at``, or -1; elements other than raw ones may hold their like."""
    depth = 1
    for m in re.compile(rf"<(/?){re.escape(name)}(?=[\s/>])[^>]*>", re.IGNORECASE).finditer(page, at):
        if m[1]:
            depth -= 1
        elif name not in RAW:
            depth += 1
        if not depth:
            return m.end()
    return -1


def _readable(b: Block) -> bool:
    """Long enough for its text to speak for itself, and no list of links."""
    return len(b.text) >= SHORT and b.linked <= LINKS * len(b.text)


def blocks(page: str) -> list[Block]:
    """Blocks of a page in order, with frame set where a mark around them counts."""
    parsed = _Page(page)
    found, marks = parsed.blocks, parsed.marks
    framed = [m.element for m in marks]  # inside an element that is frame by its name
    for i, m in enumerate(marks):
        framed[i] |= m.outer >= 0 and framed[m.outer]
    total, free, outside = 0, 0, 0
    for b in found:
        chars = len(b.text) - b.linked
        total += chars
        if b.mark < 0:
            free += chars
            outside += b.article or _readable(b)
            continue
        free += 0 if framed[b.mark] else chars
        marks[b.mark].readable += _readable(b)
        if marks[b.mark].element or not framed[b.mark]:  # what nested frames hold says nothing about a class word around them
            marks[b.mark].chars += chars
    for m in reversed(marks):
        if m.outer >= 0:
            marks[m.outer].headline |= m.headline
            if marks[m.outer].element or not m.element:
                marks[m.outer].chars += m.chars
    counts = [True] * len(marks)
    around = [0] * len(marks)  # readable blocks in elements around a mark, none of which count
    for i, m in enumerate(marks):
        around[i] = (around[m.outer] + marks[m.outer].readable) if m.outer >= 0 else outside
        if m.outer >= 0 and counts[m.outer]:
            continue
        counts[i] = m.surely or m.chars * 2 <= (total if m.element else free) or not (m.headline or m.article or not around[i])
    for b in found:
        b.frame = b.mark >= 0 and counts[b.mark]
    return found


def density(text: str) -> float:
    """Largest share of stop words that any language's list finds."""
    words = [w.lower() for w in _WORD.findall(text)]
    return max(sum(map(s.__contains__, words)) for s in _STOPS) / len(words) if words else 0.0


def classify(found: list[Block]) -> list[Block]:
    """Label blocks good or bad; the two passes."""
    plain = [(len(b.text) - b.linked, b.article) for b in found if not b.frame and b.linked <= LINKS * len(b.text)]
    has_article = 2 * sum(n for n, inside in plain if inside) > sum(n for n, _ in plain)
    for b in found:
        length, inside = len(b.text), has_article and b.article
        if b.frame or has_article and not inside or b.linked > LINKS * length:
            b.label = "bad"
        elif length < SHORT:
            b.label = "bad" if b.linked and not inside else "short"
        else:
            d = density(b.text)
            if d >= HIGH_DENSITY:
                b.label = "good" if length > LONG else "near"
            elif d >= LOW_DENSITY:
                b.label = "near"
            else:
                b.label = "undecided" if inside else "bad"
    # blocks that elements decided say nothing about the text beside them
    says = [b.label in ("good", "bad") and not b.frame and (b.article or not has_article) for b in found]
    for b, label in zip(found, inherited([b.label if s else None for b, s in zip(found, says)], found, has_article)):
        b.label = label
    return found


def inherited(decided: list[str | None], found: list[Block], has_article: bool) -> list[str]:
    """Labels of all blocks: their own if it is good or bad, else that of the nearest decided neighbour.

    Between a good and a bad one that are equally near, a heading goes with
    what follows, and a block that may well be text is good.  A block of high
    density between bad ones stays good.  Without a decided neighbour, blocks
    of the article and those that may well be text are good.
    """
    before, last = [], None
    for i, x in enumerate(decided):
        before.append(last)
        last = i if x else last
    after, last = [], None
    for i in range(len(decided) - 1, -1, -1):
        after.append(last)
        last = i if decided[i] else last
    out = []
    for i, (b, p, q) in enumerate(zip(found, before, reversed(after))):
        if b.label in ("good", "bad"):
            out.append(b.label)
            continue
        labels = {decided[j] for j in (p, q) if j is not None}
        if not labels:
            out.append("good" if b.label == "near" or has_article and b.article else "bad")
        elif len(labels) == 1:
            dense = b.label == "near" and density(b.text) >= HIGH_DENSITY
            out.append("good" if dense else labels.pop())
        elif b.heading:
            out.append(decided[q])
        elif i - p != q - i:
            out.append(decided[p if i - p < q - i else q])
        else:
            out.append("good" if b.label == "near" else "bad")
    return out


def main_text(page: str | None) -> str:
    return "\n\n".join(b.text for b in classify(blocks(page or "")) if b.label == "good")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages.

    Null or empty html, and pages without main text, give an empty text.
    Character references are decoded, white space inside a block is one space,
    blocks are joined by an empty line.  Repeated rows give repeated results,
    other columns are ignored, an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            clean = [t.encode("utf-8", "replace").decode() for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(clean, pa.string()), pa.array([len(t) for t in clean], pa.int64())], ["page_id", "url", "text", "n_chars"])

    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return slim.mapInArrow(tidy(run), "page_id long, url string, text string, n_chars long")
