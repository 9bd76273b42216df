"""Main text of HTML by two-pass block rules.

The page is cut into blocks at block tags (and at two line breaks in a row).
First pass: each block is classed by itself, from its length, its share of stop
words and the share of its characters in links (a link may span blocks): good, bad,
or, where the text is too short to tell, open. What stands in an element for menus,
asides, footers or the page's header, in a hidden one, in one of a class like ``ad``, or
among readers' comments, is bad; an article or main element lowers the limits. A word of a container's class or
id (``promo``, ``sidebar``), and a form, are no more than a suspicion, which density
decides: of the dense text around, where the container stands, it has to hold more
than half, and what is outside of such containers at most a quarter as much, none of
it in an article element; then it is a page's frame and no promotion. A marked
paragraph that is short or has few stop words is bad, another is judged as any. Where
no block is good, dense ones that are too short for it are.

Stop words are known for four languages. Where hardly any word of a page's
unlinked text is one, the page is in another language or script, and stop words
say nothing: length and links decide. Second pass:
open blocks take the label of the nearest decided blocks before and after: alike
if both agree, else of the nearer one (by characters between), the bad one if
they are as near. Blocks in an article element look at such blocks only; blocks
that are out by where they stand are nobody's neighbours.

Texts are decoded (character references), white space inside a block becomes one
blank, blocks are joined by a line feed. Scripts, styles, templates, comments
and markup never count.

Defined results: null or empty HTML, or a page without a good block, gives an
empty text; broken HTML is read as far as it goes (an unknown end tag is
ignored, an open element ends with its parent or the page); a very long page is
read in time in proportion to its length; repeated rows are read each; an empty
table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm._io import per_batch

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "a about after all also an and any are as at be been but by can could for from had has have he her his how if in into is it its "
    "more my no not of on one or our out she so some than that the their them then there they this to up was we were what when which "
    "who will with would you your "
    "aber als am an auch auf aus bei bin bis das dass dem den der des die doch du durch ein eine einem einen einer es für hat haben "
    "ich ihr im in ist ja kann mit nach nicht noch nur oder ohne sein sich sie sind so über um und uns von vor war was wenn wer wie "
    "wir wird zu zum zur "
    "au aux avec ce ces cette comme dans de des deux du elle elles en est et eux il ils je la le les leur lui mais me même mes mon "
    "ne nous on ou où par pas plus pour qu que qui sa se ses son sont sur ta te tout tu un une vos votre vous y à été "
    "al algo ante como con cual cuando de del desde donde el ella ellos en entre era es esa ese eso esta este esto está fue ha hay la "
    "las le les lo los me mi mucho muy más nada ni no nos o para pero por porque que quien se si sin sobre son su sus también te "
    "tiene un una uno unos y ya él".split()
)
# Words of classes, ids and roles that mark what is not the text.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising alert banner breadcrumb breadcrumbs consent cookie "
    "cookies disclaimer dialog footer gdpr hidden infobar login masthead menu modal nav navbar navigation newsletter notice "
    "notification notifications outbrain paywall pager pagination popup promo promoted promotion recommended related "
    "search share sharing sidebar signup skip social sponsor sponsored subscribe subscription taboola teaser toast toolbar tooltip topbar "
    "tracking widget widgets contentinfo complementary".split()
)
# Those that, as a whole class, no page's frame has.
SURE = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs consent cookie cookies footer gdpr menu nav navbar navigation newsletter outbrain pager pagination sidebar taboola".split())
# Words that mark readers' comments; the second line only outside of articles, which have such sections.
COMMENTS = frozenset("comment comments commentlist commentary commenters disqus kommentar kommentare commentaires comentarios replies reply respond responses talkback".split())
TALK = frozenset("discussion discussions feedback forum thread threads conversation".split())
# A class with such a word says what a page has, or lacks.
SAYING = frozenset("has have with without no not hide open enabled disabled".split())
ARTICLE_MARKS = frozenset("articlebody article-body article-content post-body post-content entry-content story-body main-content".split())
OUT = frozenset("nav aside footer menu dialog fieldset select button noscript template iframe object svg".split())
RAW = frozenset("script style noscript template iframe object svg math textarea select button canvas audio video title".split())
HOLDERS = frozenset("body div section article main nav aside header footer form ul ol dl menu table tbody thead tfoot figure details dialog fieldset blockquote center".split())
BLOCKS = HOLDERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr caption figcaption pre address hr html head summary legend option".split())
VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:\"[^\"]*+\"|'[^']*+'|[^'\">]++)*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>", re.S
)
_OPEN = re.compile(r"<[!?]")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|style|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORD = re.compile(r"\w+")
GOOD, BAD, OPEN = "good", "bad", "open"
#: Suspect containers in one another that are told apart; further ones count as the last.
MOST = 6


@dataclass(frozen=True)
class Rules:
    """Limits of the first pass: characters, share of stop words, share of characters in links."""

    short: int = 60
    long: int = 160
    stop_low: float = 0.10
    stop_high: float = 0.22
    links: float = 0.34
    links_inside: float = 0.6
    known: float = 0.05  #: share of stop words in unlinked text from which the page's language is known


@dataclass
class Block:
    text: str
    links: int  #: characters in links
    place: str  #: "out", "in" (an article or main element) or ""
    heading: bool
    marked: bool = False  #: by a word of its own class or id
    suspects: tuple[int, ...] = ()  #: containers around that a word or a form makes suspect, from the outside in


def _place(attributes: str, tag: str) -> str:
    """What an element's attributes say: hidden, comments, talk, suspect, in or nothing."""
    said = ""
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next(filter(None, values), "").lower()
        if name == "hidden" and value in ("", "hidden", "true") or name == "aria-hidden" and value == "true" or name == "style" and _HIDING.search(value):
            return "hidden"
        if name in ("class", "id", "role", "itemprop"):
            for word in value.split():
                if word in ARTICLE_MARKS or name == "role" and word in ("main", "article"):
                    said = said or "in"
                elif tag not in ("html", "body") and not SAYING.intersection(pieces := re.split(r"[-_]+", word)):
                    ends = {word, pieces[0], pieces[-1]}
                    if ends & COMMENTS:
                        return "comments"
                    if word in SURE:
                        return "hidden"
                    if ends & TALK:
                        said = "talk" if said != "in" else said
                    elif ends & MARKS and said != "in":
                        said = "suspect" if said != "talk" else said
    return said


def blocks(page: str) -> list[Block]:
    """The page's blocks with text, in order."""
    out: list[Block] = []
    held: list[str] = []
    stack: list[tuple[str, str, tuple[int, ...]]] = []  # open holders: tag, place, suspects
    open_tags: Counter[str] = Counter()
    place = ""
    suspects: tuple[int, ...] = ()
    n_suspects = 0
    marked = hidden = False
    in_link = in_link_chars = breaks = 0
    link_depth = 0  # open holders where the link began
    in_block = inline = False  # in a paragraph or the like; if the link began there
    heading = False

    def flush() -> None:
        nonlocal in_link_chars, breaks
        if held:
            raw = "".join(held)
            text = " ".join((entities.unescape(raw) if "&" in raw else raw).split())
            if text:
                out.append(Block(text, min(in_link_chars, len(text)), "out" if hidden else place, heading, marked, suspects))
            held.clear()
        in_link_chars = breaks = 0

    at, n, last = 0, len(page), page.rfind(">")
    while at <= last and (m := _TOKEN.search(page, at)):
        if m.start() > at:
            piece = page[at : m.start()]
            held.append(piece)
            if in_link:
                in_link_chars += len(piece.strip())
            if breaks and piece.strip():
                breaks = 0
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing, attributes = tag.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in RAW and not closing:
            if not attributes.endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if tag == "a":
            in_link, link_depth, inline = int(not closing and "href" in attributes.lower()), len(stack), in_block
            continue
        if tag == "br":
            held.append(" ")
            breaks += 1
            if breaks > 1:
                flush()
            continue
        if tag in ("td", "th"):
            held.append(" ")
            continue
        if tag not in BLOCKS:
            continue
        flush()
        if inline and (closing or tag not in HOLDERS):  # a link that began inside a paragraph ends with it
            in_link = 0
        in_block = tag not in HOLDERS and not closing
        marked, hidden, heading = False, False, False
        if tag in HOLDERS:
            if closing:
                while open_tags[tag]:  # what is open inside ends too
                    ended, _, _ = stack.pop()
                    open_tags[ended] -= 1
                    if ended == tag:
                        break
                if len(stack) < link_depth:
                    in_link = 0
            elif not attributes.endswith("/"):
                said = _place(attributes, tag)
                _, up, around = stack[-1] if stack else ("", "", ())
                if up == "comments" or said == "comments" or said == "talk" and up != "in":
                    own = "comments"
                elif tag in OUT or said == "hidden":
                    own = "out"
                elif tag in ("article", "main") or said == "in":
                    own = "in"
                elif tag == "header":
                    own = "head" if up == "in" else "out"
                else:
                    own = up
                if own == up and (said == "suspect" or tag == "form") and len(around) < MOST:
                    n_suspects += 1
                    around = (*around, n_suspects)
                elif own == "in" and up != "in":
                    around = ()
                stack.append((tag, own, around))
                open_tags[tag] += 1
            place, suspects = stack[-1][1:] if stack else ("", ())
            place = "out" if place == "comments" else place
        elif not closing:
            heading = tag in ("h1", "h2", "h3", "h4", "h5", "h6")
            said = _place(attributes, tag) if attributes else ""
            marked, hidden = said in ("suspect", "comments", "talk"), said == "hidden"
    if at < n:  # no tag ends here any more; an open comment or declaration is none of the text
        rest = _OPEN.split(page[at:], maxsplit=1)[0]
        held.append(rest)
        if in_link:
            in_link_chars += len(rest)
    flush()
    return out


def stop_words(text: str) -> tuple[int, int]:
    """Stop words and words of a text."""
    words = _WORD.findall(text.lower())
    return sum(map(STOP_WORDS.__contains__, words)), len(words)


def first_pass(b: Block, rules: Rules, stop: float | None) -> str:
    """``stop``: the share of stop words; None if those of the page's language are not known."""
    size = len(b.text)
    links = b.links / size
    if b.place == "out":
        return BAD
    if b.place == "head" and (b.heading or size < rules.short):  # an article's own header: its title and lead, not its by-lines
        return GOOD if b.heading else BAD
    if links > (rules.links_inside if b.place == "in" else rules.links):
        return BAD
    if stop is None:
        stop = rules.stop_high if size >= rules.short else 0.0
    if b.marked and (size < rules.short or stop < rules.stop_high):
        return BAD
    if b.place == "head":
        return GOOD if stop >= rules.stop_low else BAD
    if b.place == "in":
        return GOOD if size >= rules.short or stop >= rules.stop_low or b.heading else OPEN
    if size < rules.short or b.heading:
        return BAD if b.links else OPEN
    if stop >= rules.stop_high:
        return GOOD if size >= rules.long else OPEN
    if stop >= rules.stop_low:
        return GOOD if size >= 2 * rules.long else OPEN
    return BAD if size >= rules.long else OPEN


def _nearest(found: list[Block], labels: list[str], backwards: bool) -> list[dict[bool, tuple[str, int]]]:
    """For each block the nearest decided one on one side: label and characters between.

    Two answers: among the blocks of article elements, and among all. Blocks that
    are out by where they stand say nothing about text that stands elsewhere.
    """
    out: list[dict[bool, tuple[str, int]]] = [{} for _ in found]
    now: dict[bool, tuple[str, int]] = {}
    for k in range(len(found) - 1, -1, -1) if backwards else range(len(found)):
        out[k] = dict(now)
        b, label = found[k], labels[k]
        for inside in (True, False):
            if label != OPEN and b.place != "out" and (b.place == "in" or not inside):
                now[inside] = (label, 0)
            elif inside in now:
                now[inside] = (now[inside][0], now[inside][1] + len(b.text))
    return out


def second_pass(found: list[Block], labels: list[str]) -> list[bool]:
    """Whether each block is part of the text."""
    before, after = _nearest(found, labels, False), _nearest(found, labels, True)
    out = []
    for k, (b, label) in enumerate(zip(found, labels, strict=True)):
        if label == OPEN:
            inside = b.place == "in"
            left, right = before[k].get(inside), after[k].get(inside)
            if b.heading and not inside:  # a heading belongs to what follows
                label = right[0] if right and right[1] < 200 else BAD
            elif left and right and left[0] != right[0]:
                label = BAD if left[1] == right[1] else min(left, right, key=lambda x: x[1])[0]
            else:  # none is decided: an article element's own text stays
                label = (left or right or (GOOD if inside else BAD,))[0]
        out.append(label == GOOD)
    return out


def cleared(found: list[Block], dense: list[bool], least: int) -> list[bool]:
    """Whether each block stands only in suspect containers that hold the text of their surroundings."""
    clear: dict[int, bool] = {}
    sizes = [len(b.text) * d for b, d in zip(found, dense, strict=True)]
    for depth in range(max((len(b.suspects) for b in found), default=0)):
        # Dense text by what is around: all, and that in no further suspect; blocks of articles; dense text by suspect.
        every, plain, article, held = (Counter() for _ in range(4))
        for b, n in zip(found, sizes, strict=True):
            around = b.suspects[:depth]
            every[around] += n
            if len(b.suspects) > depth:
                held[b.suspects[depth]] += n
            elif len(b.suspects) == depth:
                plain[around] += n
                article[around] += b.place == "in"
        for b in found:
            if len(b.suspects) > depth and (own := b.suspects[depth]) not in clear:
                around = b.suspects[:depth]
                clear[own] = held[own] >= least and 2 * held[own] > every[around] and 4 * plain[around] <= held[own] and (b.place == "in" or not article[around])
    return [all(clear[x] for x in b.suspects) for b in found]


def main_text(page: str | None, rules: Rules = Rules()) -> str:
    found = blocks(page or "")
    counts = [(0, 0) if b.place == "out" else stop_words(b.text) for b in found]
    unlinked = [c for b, c in zip(found, counts, strict=True) if b.links < rules.links * len(b.text)]
    known = sum(s for s, _ in unlinked) >= rules.known * max(1, sum(n for _, n in unlinked))
    shares = [s / max(1, n) if known else None for s, n in counts]
    dense = [
        b.place != "out" and b.links <= rules.links * len(b.text) and len(b.text) >= rules.short and not b.heading and (x is None or x >= rules.stop_high)
        for b, x in zip(found, shares, strict=True)
    ]
    clear = cleared(found, dense, rules.long)
    for b, x in zip(found, clear, strict=True):
        b.place = b.place if x else "out"
    labels = [first_pass(b, rules, x) for b, x in zip(found, shares, strict=True)]
    if GOOD not in labels:
        labels = [GOOD if x == OPEN and d else x for x, d in zip(labels, dense, strict=True)]
    return "\n".join(b.text for b, stays in zip(found, second_pass(found, labels), strict=True) if stays)


SCHEMA = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame, rules: Rules = Rules(), *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(x.as_py(), rules) for x in batch.column(2)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return per_batch(pages.select(F.col(id_col).cast("long").alias("i"), F.col(url_col).cast("string").alias("u"), F.col(html_col).cast("string").alias("h")), run, SCHEMA)
