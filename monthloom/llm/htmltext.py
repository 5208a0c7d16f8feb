"""Main text of web pages by block rules in two passes.

A page is cut into blocks.  The first pass decides blocks on their own: by stop-word density,
length and link density, and by the containers they stand in (a menu is a menu whatever it
says).  The second gives blocks that are too short or too plain to decide the label of
their nearest decided neighbours.
"""

from __future__ import annotations

import heapq
import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SCHEMA = "page_id long, url string, text string, n_chars long"

# Frequent function words of the languages the pages are in.
STOP_WORDS = frozenset(
    """the of and to a in is that it for was on are as with be by this from at or an not but have
    der die das und in zu den mit von ist des im dem nicht ein eine auch auf für sich als
    le la les de des du et un une en que qui dans pour pas sur au est avec par il elle ce
    el los las y del se no por para con su lo como más una o pero""".split()
)
# The same of further languages, each judged for itself.
MORE_STOP_WORDS = {
    "it": "il lo la i gli le di del della dei che e è un una in per non con si da al sono come ma anche nel più questo alla dal",
    "pt": "o a os as de do da dos das que e é um uma em no na para não com se por mais como mas foi ao pelo pela são ser também",
    "nl": "de het een en van in is dat op te zijn met voor niet aan er om ook als maar bij door naar dan uit die worden werd heeft",
    "sv": "och i att det som en på är av för med den till inte om ett har de var men så från kan vid eller efter hade sin",
    "da": "og i at det som en på er af for med den til ikke om et har de var men så fra kan ved eller efter havde sin der blev",
    "no": "og i å at det som en på er av for med den til ikke om et har de var men så fra kan ved eller etter hadde sin ble",
    "fi": "ja on ei se että oli hän mutta ovat kun joka myös sen mukaan tai kuin vuonna sekä niin ole jo hänen vain nyt olla",
    "pl": "i w na z do nie że się to jest o jak po co ale od przez za dla był są oraz tym przy jego który która ma już lub",
    "cs": "a v na se je že s z do o to i ve k za jako by pro ale po byl jeho které který si od jsou při nebo také už",
    "sk": "a v na sa je že s z do o to i vo k za ako by pre ale po bol jeho ktoré ktorý si od sú pri alebo tiež už",
    "hu": "a az és hogy nem is egy ez volt meg de ha csak mint vagy már még el ki azt amely lehet után minden között majd",
    "ro": "și în de la a cu pe nu că o un este din care se pentru mai fi ca sau dar au fost al ale prin lui sunt după",
    "hr": "i u je na se da su za od s a o kao što koji nije ne bi ili iz do koja ali te biti bio po sa kako to",
    "lt": "ir į yra kad su iš o tai bet ar buvo kaip ne už nuo jis apie jo per dėl po prie taip tik šis",
    "lv": "un ir no ar uz ka par bet kā tas bija pēc vai gada lai to pie kas arī tika ko nav līdz savu",
    "et": "ja on ei et see oli ka aga kui ning oma ta mis või seda nii ole välja kes pärast mille sest üle",
    "tr": "ve bir bu da de için ile olarak daha çok olan gibi en ne kadar sonra ki ya ama o her olduğu değil veya ise",
    "id": "yang dan di ini itu dengan untuk dari pada dalam tidak adalah ke akan oleh juga sebagai atau ada telah mereka bisa karena",
    "vi": "và của là có trong được cho không với các một những này để người khi đã từ đến như cũng về ra tại năm",
    "sw": "na ya wa kwa ni katika la za cha kuwa hii au kama lakini yake huo wake pia hiyo alikuwa hivyo moja sana",
    "tl": "ang ng sa na at mga ay ito si para hindi ni kung may isang siya nang ko mo kay o rin dahil",
    "ca": "el la els les de del que i en un una per amb no és al es com més són va ser o dels se",
    "eu": "eta da ez bat du izan zen dira baina hau ere edo den dute bere egin ditu zuen horrek arte",
    "ru": "и в не на что с по а как это он к из но за у от о для то же его так был все бы или при только мы они",
    "uk": "і в не на що з до як це та у за але від для про він був його або при які так також є",
    "bg": "и на в за да се от е не с по като са това но че или при до ще има което само след",
    "sr": "и у је на се да су за од с а о као што који није не би или из до која али",
    "el": "και το η ο να του της την τα με για από που είναι στο σε δεν οι των τον ένα στην μια αλλά ότι θα ή",
    "he": "של את על לא זה הוא עם כי גם היא או אל אם כל היה אני מה יש רק אך בין לפי אשר",
    "ar": "في من على إلى أن هذا التي ما لا مع عن كان هذه الذي أو بعد قد كما هو كل بين ثم لم و",
    "fa": "و در به از که این را با است برای آن یک تا بود شد می خود هم نیز بر یا اما",
    "ko": "이 그 저 수 것 등 및 더 또 한 있다 있는 그는 대한 위해 했다 하는 그리고 있었다 통해 때 할",
}
_LANGUAGES_OF: dict[str, list[str]] = {}
for _language, _words in MORE_STOP_WORDS.items():
    for _word in set(_words.split()):
        _LANGUAGES_OF.setdefault(_word, []).append(_language)

_BLOCK = frozenset(
    """address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset
    figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section
    select summary table tbody td tfoot th thead tr ul""".split()
)
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NOT_TEXT = frozenset("head script style template noscript svg annotation annotation-xml object canvas audio video map title textarea iframe".split())
_NOT_MAIN = frozenset("nav footer aside menu select button dialog label input datalist".split())
# Often not the article, but some sites put a whole page into one
_MAYBE_NOT_MAIN = frozenset("form fieldset".split())
_NOT_MAIN_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
# Words in class or id that name something other than the article
_NOT_MAIN_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion
    cookie cookies consent gdpr notice notices alert popup modal overlay
    nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar skip
    sidebar aside widget widgets related recommended recommendations trending
    share sharing social follow subscribe subscription newsletter signup login search
    comment comments commentlist disqus reply replies respond discussion
    footer copyright masthead topbar""".split()
)
# Those of them that are no part of the article however much they hold
_NEVER_MAIN_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion
    cookie cookies consent gdpr popup modal related recommended recommendations trending
    comment comments commentlist disqus reply replies respond discussion""".split()
)
# Words that may stand beside those in a compound name, which then still names the same thing
_PLAIN_PARTS = frozenset(
    """area bar block body bottom box button buttons card container content entries feed form footer header heading
    holder icon icons inner item items left link links list main message navigation outer panel post posts article articles
    region right row section slot space story stories text thread title top unit wrap wrapper""".split()
)
# Elements that are text of an article whatever their class is
_QUOTED = frozenset("blockquote pre code figure q table math".split())
# Class names that say something about an element's neighbours or state, not what it is
_MODIFIER = re.compile(r"(?:has|have|no|not|non|with|without|is|hide|show)(?:[-_]|$)")
_MAIN = frozenset(("article", "main"))
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|([^\s=/"'>]+)""")
_WORDS = re.compile(r"[^\W_]+")
_CLASS_WORDS = re.compile(r"[a-z]+")
# scripts that write a syllable or a word per character
_WIDE = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\uf900-\ufaff]")


class _Maybe:
    """An element whose class, id or kind says that it is not part of the article, which its contents may refute."""

    __slots__ = ("children", "holds_main", "main", "never", "own", "parent", "refuted", "whole")

    def __init__(self, never: bool, parent: _Maybe | None):
        self.never, self.parent, self.holds_main, self.refuted = never, parent, False, False


class _Block:
    __slots__ = ("heading", "linked", "main", "maybe", "out", "parts")

    def __init__(self, main: bool, out: bool, heading: bool, maybe: _Maybe | None = None):
        self.parts, self.linked, self.main, self.out, self.heading, self.maybe = [], 0, main, out, heading, maybe


def _events(html: str):
    """(kind, name, rest) of a page: "text" stretches, "open" and "close" tags; comments are dropped."""
    at, end = 0, len(html)
    while at < end:
        lt = html.find("<", at)
        if lt < 0:
            yield "text", "", html[at:]
            return
        if lt > at:
            yield "text", "", html[at:lt]
        if html.startswith("<!--", lt):
            stop = html.find("-->", lt + 2)
            at = end if stop < 0 else stop + 3
            continue
        if html.startswith(("<!", "<?"), lt):
            stop = html.find(">", lt)
            at = end if stop < 0 else stop + 1
            continue
        found = _TAG.match(html, lt)
        if found is None:
            rest = html[lt + 1 : lt + 2]
            if rest.isalpha() or rest == "/":  # a broken tag: up to the next bracket, or the end
                stop = html.find(">", lt)
                at = end if stop < 0 else stop + 1
            else:
                yield "text", "", "<"
                at = lt + 1
            continue
        at, name = found.end(), found[2].lower()
        if found[1]:
            yield "close", name, ""
            continue
        yield "open", name, found[3]
        if name in _RAW:
            stop = re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE).search(html, at)
            at = end if stop is None else stop.start()


def _names_other(attributes: str, name: str, inside: bool = False) -> tuple[bool, frozenset[str]]:
    """Whether role or visibility say that an element is not part of the article, and words of its class and id that do.

    Inside the article a compound name counts only if all its parts are such words or plain ones: ``related-posts``
    names other pages, ``related-work`` does not.
    """
    words: set[str] = set()
    if not attributes.strip():
        return False, frozenset()
    for found in _ATTRIBUTE.finditer(attributes):
        key = (found[1] or found[5] or "").lower()
        value = (found[2] or found[3] or found[4] or "").lower()
        if key in ("class", "id") and name not in ("html", "body"):
            for token in value.split():
                if not _MODIFIER.match(token):
                    # of an article's compound names, as comment-status-open, no part says what it is
                    parts = [token] if name in _MAIN else _CLASS_WORDS.findall(token)
                    if inside and (name in _QUOTED or not _NOT_MAIN_WORDS.union(_PLAIN_PARTS).issuperset(parts)):
                        continue
                    words.update(_NOT_MAIN_WORDS.intersection(parts))
        elif (key == "role" and value in _NOT_MAIN_ROLES) or key == "hidden" or (key == "aria-hidden" and value == "true"):
            return True, frozenset()
        elif key == "style" and "display:none" in value.replace(" ", ""):
            return True, frozenset()
    return False, frozenset(words)


def blocks_of(html: str) -> list[_Block]:
    """Blocks of a page in order, with their text so far undecoded."""
    blocks: list[_Block] = []
    # of every open element: name, whether it holds no text, is not part of the article, is the article, may not be part of it
    stack: list[tuple[str, bool, bool, bool, _Maybe | None]] = []
    inner: _Maybe | None = None  # the innermost of them that is open
    open_names: dict[str, int] = {}
    silent = out = main = links = breaks = headings = 0
    block = None

    def leave(k):
        nonlocal silent, out, main, links, headings, inner
        for name, s, o, m, x in reversed(stack[k:]):
            silent, out, main, links = silent - s, out - o, main - m, links - (name == "a")
            headings -= name in _HEADINGS
            open_names[name] -= 1
            if x is not None:
                inner = x.parent
        del stack[k:]

    for kind, name, rest in _events(html):
        if kind == "text":
            if silent:
                continue
            if block is None:
                if not rest.strip():
                    continue
                block = _Block(main > 0, out > 0, headings > 0, inner)
                blocks.append(block)
            block.parts.append(rest)
            if links:
                block.linked += len(rest.strip())
            if rest.strip():
                breaks = 0
            continue
        if kind == "open":
            if name == "br":
                breaks += 1
                if breaks >= 2:
                    block = None
                elif block is not None:
                    block.parts.append(" ")
                continue
            if name in _BLOCK:
                block, breaks = None, 0
                if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):  # a new one ends the last
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] == name:
                            leave(k)
                            break
                        if stack[k][0] in _BLOCK and not (name == "tr" and stack[k][0] in ("td", "th")):
                            break
            if name in _VOID:
                if name in ("img", "input"):
                    continue
                if block is not None:
                    block.parts.append(" " if name == "wbr" else "")
                continue
            if rest.rstrip().endswith("/") and name in ("svg", "path"):
                continue
            s = name in _NOT_TEXT
            other, words = _names_other(rest, name, main > 0)
            o = name in _NOT_MAIN or (name == "header" and not main) or other
            m = name in _MAIN and not out and not o
            x = _Maybe(not _NEVER_MAIN_WORDS.isdisjoint(words), inner) if not o and (words or name in _MAYBE_NOT_MAIN) else None
            if x is not None:
                inner = x
            if m and not main:
                y = inner
                while y is not None and not y.holds_main:  # beyond one that is known all are
                    y.holds_main, y = True, y.parent
            if (o or x is not None) and block is not None and not out:
                block = None
            stack.append((name, s, o, m, x))
            open_names[name] = open_names.get(name, 0) + 1
            headings += name in _HEADINGS
            silent, out, main, links = silent + s, out + o, main + m, links + (name == "a")
        else:
            for k in range(len(stack) - 1, -1, -1) if open_names.get(name) else ():
                if stack[k][0] == name:
                    if any(x[2] or x[4] is not None for x in stack[k:]):
                        block = None
                    leave(k)
                    break
                # an inline end tag does not close blocks
                if name not in _BLOCK and name not in _NOT_TEXT and stack[k][0] in _BLOCK:
                    break
            if name in _BLOCK:
                block, breaks = None, 0
    return blocks


def refute(blocks: list[_Block], texts: list[str], short: int, link_share: float) -> None:
    """Marks blocks ``out`` that stand in elements named as something else, but for elements that hold the article.

    An element holds it if it is or contains the page's only ``article`` or ``main`` and at least as much
    text as stands outside of all such elements, or more text than stands there (words for advertising,
    comments and the like excepted).  From the outside in, the largest first.
    """
    if not any(b.maybe for b in blocks):
        return
    seen: dict[_Maybe, int] = {}  # every such element around some block, outer ones first
    rest, marked = 0, False
    for t, b in zip(texts, blocks, strict=True):
        x, chain = b.maybe, []
        while x is not None and x not in seen:
            chain.append(x)
            x = x.parent
        for x in reversed(chain):
            seen[x] = len(seen)
            x.own = x.whole = 0
            x.main, x.children = False, []
            if x.parent is not None:
                x.parent.children.append(x)
        w = 0 if b.out or size_of(t) < short or b.linked > link_share * len(t) else size_of(t)
        if b.maybe is None:
            rest += w
            marked |= b.main and not b.out
        else:
            b.maybe.own += w
            b.maybe.main |= b.main and not b.out
    for x in reversed(seen):
        x.whole += x.own
        if x.parent is not None:
            x.parent.whole += x.whole
    # What stands outside only grows, so an element that does not outweigh it once never will.
    waiting = [(not x.holds_main, -x.whole, k, x) for x, k in seen.items() if x.parent is None]
    heapq.heapify(waiting)
    while waiting:
        _, _, _, x = heapq.heappop(waiting)
        if (x.holds_main and not marked and x.whole >= rest) or (x.whole > rest and not x.never):
            x.refuted = True
            rest += x.own
            marked |= x.main
            for y in x.children:
                heapq.heappush(waiting, (not y.holds_main, -y.whole, seen[y], y))
    for x in seen:  # refuted only if all around it are
        x.refuted = x.refuted and (x.parent is None or x.parent.refuted)
    for b in blocks:
        b.out = b.out or (b.maybe is not None and not b.maybe.refuted)


GOOD, BAD, OPEN = 1, 0, -1


def size_of(text: str) -> int:
    """Length in letters; a character of a script that writes syllables or words counts as three."""
    return len(text) if text.isascii() else len(text) + 2 * len(_WIDE.findall(text))


def stop_share_of(words: list[str], enough: float) -> float:
    """The largest share of stop words that some language's list gives; no further list is asked once one gives enough."""
    share = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if share < enough and words:
        counts: dict[str, int] = {}
        for w in words:
            for language in _LANGUAGES_OF.get(w, ()):
                counts[language] = counts.get(language, 0) + 1
        share = max([share, *(n / len(words) for n in counts.values())])
    return share


def is_prose(words: list[str], text: str) -> bool:
    """Whether a text is mostly letters and digits, in whatever language."""
    return sum(map(len, words)) >= 0.4 * len(text)


def first_pass(text: str, linked: int, block: _Block, has_main: bool, short: int, long: int, stop_share: float, link_share: float) -> int:
    """A block by itself: GOOD, BAD, or OPEN where it is too short or too plain to say.

    Long text that is explained by no list of stop words is GOOD without links and OPEN with some.
    """
    if block.out or (has_main and not block.main):
        return BAD
    if not block.main and linked / max(1, len(text)) > link_share:
        return BAD
    size = size_of(text)
    if size < short:
        return OPEN
    words = _WORDS.findall(text.lower())
    if stop_share_of(words, stop_share) >= stop_share:
        return GOOD
    if block.main or size < long:
        return OPEN
    # no list explains it: another language, code, a table
    if not is_prose(words, text):
        return BAD
    return OPEN if block.linked else GOOD


def second_pass(labels: list[int], blocks: list[_Block]) -> list[int]:
    """Open blocks take the label of the nearest decided block.

    A heading takes that of what follows.  Between two as near, a neighbour that is bad by its own
    text counts more than a good one, and a good one more than one that is bad by its container, as
    that says nothing about what stands beside it.  Open blocks of a marked article belong to it.
    """
    before, after, last = [], [None] * len(labels), None
    for i, x in enumerate(labels):
        before.append(last)
        last = i if x != OPEN else last
    last = None
    for i in range(len(labels) - 1, -1, -1):
        after[i] = last
        last = i if labels[i] != OPEN else last
    out = list(labels)
    for i, x in enumerate(labels):
        if x != OPEN:
            continue
        a, b = before[i], after[i]
        if blocks[i].main:
            out[i] = GOOD
        elif blocks[i].heading and b is not None:
            out[i] = labels[b]
        elif a is not None and b is not None and labels[a] != labels[b]:
            bad = a if labels[a] == BAD else b
            tie = GOOD if blocks[bad].out else BAD
            out[i] = tie if i - a == b - i else labels[a] if i - a < b - i else labels[b]
        else:
            near = a if a is not None else b
            out[i] = BAD if near is None else labels[near]
    return out


def main_text(
    html: str | None, short: int = 70, long: int = 200, stop_share: float = 0.2, link_share: float = 0.3
) -> str:
    """The article of a page: its blocks in order, joined by line feeds; empty if there is none."""
    if not html:
        return ""
    blocks, texts = [], []
    for block in blocks_of(html):
        text = " ".join(unescape("".join(block.parts)).split())
        if text:
            blocks.append(block)
            texts.append(text)
    refute(blocks, texts, short, link_share)
    has_main = any(b.main and not b.out for b in blocks)
    labels = [
        first_pass(t, b.linked, b, has_main, short, long, stop_share, link_share) for t, b in zip(texts, blocks, strict=True)
    ]
    if GOOD not in labels and not has_main:  # nothing is sure: paragraphs without links are the text
        for i, (t, b) in enumerate(zip(texts, blocks, strict=True)):
            if labels[i] == OPEN and not b.linked and size_of(t) >= short and is_prose(_WORDS.findall(t), t):
                labels[i] = GOOD
    final = second_pass(labels, blocks)
    return "\n".join(t for t, x in zip(texts, final, strict=True) if x == GOOD)


def extract(pages: DataFrame, **rules) -> DataFrame:
    """Per page ``page_id``, ``url``, ``text`` (the article, empty if none) and ``n_chars`` (code points).

    The whole html is read, broken or not: unclosed elements end with their container, a page cut
    off in the middle ends there.  Character references are decoded, white space inside a
    block becomes one space, blocks are joined by one line feed.  Null or empty html has no text.
    Where a page marks its article (``article``, ``main``), blocks outside are not part of it, and
    blocks inside are kept, linked or not, unless they stand in a container for something else.  A
    class, an id or a form makes no such container of an element that holds the article, see ``refute``.
    Elsewhere stop words of some 36 languages tell prose; in other languages, and for code and tables,
    length and links decide alone, so that long boilerplate outside of any container is kept there.
    Nothing is shuffled.  ``rules`` are the limits of ``main_text``.
    """

    def run(batches):
        for batch in batches:
            texts = [main_text(h, **rules) for h in batch.column("html").to_pylist()]
            yield pa.record_batch(
                [
                    batch.column("page_id"),
                    batch.column("url"),
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                names=["page_id", "url", "text", "n_chars"],
            )

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, _SCHEMA)
