"""Main text of web pages: blocks of the page, judged by its structure and by a suffix array for each host.

A page is cut into blocks (text between block-level tags). What stands in
menus, headers, footers, sidebars, notices, adverts, forms or comments (by
element, role, class or id) is dropped. The other blocks of every page are
judged by repetition on the host: those of its article, if the page marks one
(``article``, ``main``, ``role=main``), else all that structure leaves open.

A container around the article does not take it away. State classes
(``has-sidebar``, ``comments-open``, ``category-social``) and ids that are only
anchors (of headings, of sections inside an article) mark nothing. An article
inside a form or a container named by a compound (``search-layout``) is an
article; one inside a container that is named a sidebar, widget or the like, and
one that is itself named an advert or related, counts if the page marks no other
article and its open blocks hold less text. Articles in comments, ``nav``,
``aside`` or ``footer`` are no main text. A form that holds landmarks or the
page's heading is the page, and its blocks are as open as those around it.

The token streams of a host's pages are concatenated into one suffix array:
each suffix is a row, dealt by its host and first tokens and sorted there, so
no host has to fit into one task and a run of equal suffixes streams by.

* Outside articles every token starts a suffix. Neighbours that agree in
  MIN_RUN tokens and come from distinct pages are a repeated substring; longer
  ones are unions of such windows, so this depth is enough. Of each open block
  the covered runs of MIN_RUN tokens or of the whole block are removed; the
  unique runs stay.
* What an article does not want is a block of its own, so in articles every
  block starts a suffix, compared in all its tokens (at least MIN_RUN). A block
  that more than half of the host's articles share, MIN_ARTICLES at least, is
  the host's and no part of the article; copies of an article count once.
  Fewer share what articles cite or repeat, and an article that a host prints
  twice or in versions is still an article: if shared blocks are more than half
  of it, all of it stays.

Defined results: null or empty html gives the empty text; broken markup (open
quotes, unclosed elements, cut pages) is read as far as it goes; identical
rows count as one page for repetition and each gets its result; pages with a
null URL or none with ``://`` share the empty host. The places that repetition
covers are written to the checkpoint folder when the DataFrame is built.
"""

from __future__ import annotations

import html as entities
import re
import uuid
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import blake2b
from itertools import groupby, islice
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelens.llm.common import add_columns, shuffles_removed, table
from codelens.llm.url_filter import url_parts
from codelens.session import ensure_checkpoint_dir

#: Tokens that a substring must have to count as repeated.
MIN_RUN = 8
#: Articles of a host that must share a block before it can be the host's.
MIN_ARTICLES = 8
#: Groups that count the articles of one host, so that no task gets all its pages.
COUNTERS = 256
SEPARATOR = "\n\n"

#: Quantifiers that never give back (``*+``): a tag without an end costs one pass, not one for each length of its name.
_ATTRS = r"""[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+"""
_RAW = "script|style|template|noscript|noembed|noframes|iframe|object|canvas|audio|video|svg|annotation-xml|annotation|textarea|select|title|xmp"
_MARKUP = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?:{_RAW})\b.*?(?:</(?:{_RAW})\s*>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)({_ATTRS})>|</?[a-zA-Z][^>]*+(?:>|\Z)",
    re.DOTALL | re.IGNORECASE)
_RAW_START = re.compile(rf"<({_RAW})\b{_ATTRS}>", re.DOTALL | re.IGNORECASE)
_NAMED = re.compile(r"""\b(class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = set("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Formulas are text; only their annotations (the same formula once more, as TeX or data) are not.
_INLINE |= set(
    "math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle "
    "msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split())
_SPACED = {"br", "mtr", "mtd"}
_CHROME = set("nav footer aside menu dialog button".split())
_NEVER = {"html", "body", "main"}
#: Words of a class, id or role that mark what is not main text.
_CHROME_WORDS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments reply replies respond disqus "
    "share sharing social related recommended newsletter subscribe subscription widget toolbar pagination pager complementary contentinfo "
    "search login signup".split())
_HEADER_WORDS = {"header", "masthead", "topbar"}
_COMMENT_WORDS = set("comment comments reply replies respond disqus".split())
#: Words that name what stands beside an article even if they do not end the name (related-posts, ad-slot).
_BESIDE_WORDS = set("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion related recommended".split())
#: A class that starts or ends so tells a state of the page or a topic of the post, not what the element is.
_STATE_FIRST = set("has have no not with without is are hide show".split())
_STATE_LAST = set("open opened closed enabled disabled hidden visible active inactive on off free".split())
_TOPIC_FIRST = set("category cat tag topic type format status".split())
_LAYOUT_WORDS = set("menu nav navbar navigation sidebar widget toolbar pagination pager".split())
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements whose id inside an article is an anchor.
_ANCHORED = _HEADINGS | set("section p a span li dt dd tr td th figure table pre code".split())
#: Elements that only a form around a whole page holds.
_LANDMARKS = {"article", "main", "nav", "header", "footer", "aside", "h1"}
_ENDS_P = {"p", "div", "ul", "ol", "dl", "table", "section", "article", "main", "header", "footer", "nav", "aside", "form", "blockquote", "pre",
           "figure", "address", "hr", "h1", "h2", "h3", "h4", "h5", "h6", "fieldset", "details", "menu"}
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

OPEN, CHROME, ARTICLE = 0, 1, 2
#: While a page is read: chrome that an article ends (SOFT) or may end (NAMED), comments, an article that counts
#: if there is no better one (LIKELY), what ends all of them (MAIN); from FORM on one zone for each form.
SOFT, NAMED, COMMENTS, LIKELY, MAIN, FORM = 3, 4, 5, 6, 7, 8


@lru_cache(100_000)
def _says(name: str, in_article: bool) -> int:
    """What one class, id or role says of its element: SOFT, NAMED, COMMENTS or OPEN for nothing."""
    words = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if w]
    known = _CHROME_WORDS if in_article else _CHROME_WORDS | _HEADER_WORDS
    if known.isdisjoint(words) or words[0] in _STATE_FIRST or words[-1] in _STATE_LAST or words[0] in _TOPIC_FIRST and words[-1] not in _LAYOUT_WORDS:
        return OPEN
    if not _COMMENT_WORDS.isdisjoint(words):
        return COMMENTS
    return NAMED if words[-1] in known or not _BESIDE_WORDS.isdisjoint(words) else SOFT


def _marks(name: str, attrs: str, in_article: bool) -> int:
    """What an element says of its content: a kind of chrome or of article, or OPEN for nothing."""
    if name in _CHROME:
        zone = CHROME
    elif name == "form":
        zone = FORM
    elif name in ("head", "fieldset") or name == "header" and not in_article:
        zone = SOFT
    else:
        zone = MAIN if name == "main" else ARTICLE if name == "article" else OPEN
    if "=" not in attrs:
        return zone
    named = [(kind.lower(), v) for kind, *values in _NAMED.findall(attrs) for v in "".join(values).split()]
    anchored = in_article and (name in _ANCHORED or ("class", "section") in named)
    said = OPEN
    for kind, value in named:
        if kind == "itemprop":
            zone = ARTICLE if zone == OPEN and value.lower() == "articlebody" else zone
        elif kind == "role" and value.lower() == "main":
            zone = MAIN
        elif kind != "aria-label" and not (kind == "id" and name in _HEADINGS):
            found = _says(value, in_article)
            said = max(said, OPEN if kind == "id" and anchored and found != COMMENTS else found)
    if said == OPEN or zone in (CHROME, MAIN) or name in _NEVER:
        return zone
    if zone == ARTICLE:
        return _article_named([v for kind, v in named if kind == "class" or kind == "id" and _says(v, in_article) == COMMENTS])
    return said


def _article_named(names: list[str]) -> int:
    """An element that marks an article and has a telling name: a reader's comment, an article beside the main one, or just an article."""
    for name in names:
        words = [w for w in re.split(r"[^a-z]+", name.lower()) if w]
        if _says(name, True) != OPEN and words[0] in _COMMENT_WORDS:
            return COMMENTS
        if _says(name, True) != OPEN and (words[0] in _BESIDE_WORDS or words[-1] in _LAYOUT_WORDS):
            return LIKELY
    return ARTICLE


def _inside(zone: int, mark: int) -> int:
    """The zone inside an element with this mark (no form) that stands in ``zone``."""
    if mark == MAIN:
        return ARTICLE
    if mark == OPEN or zone == COMMENTS:
        return zone
    if mark == ARTICLE:
        return zone if zone == CHROME else LIKELY if zone in (NAMED, LIKELY) else ARTICLE
    if zone == CHROME:
        return COMMENTS if mark == COMMENTS else CHROME
    return NAMED if zone == NAMED and mark == SOFT else mark


def _settled(found: list[tuple[int, str]], forms: list[list[int]]) -> list[tuple[int, str]]:
    """Blocks with the zones OPEN, CHROME and ARTICLE, once the whole page is known."""
    def known(zone: int) -> int:
        while zone >= FORM:
            outer, wraps = forms[zone - FORM]
            zone = outer if wraps else CHROME
        return zone

    found = [(known(zone), text) for zone, text in found]
    size = {k: sum(len(text) for zone, text in found if zone == k) for k in (OPEN, ARTICLE, LIKELY)}
    likely = ARTICLE if not size[ARTICLE] and size[LIKELY] > size[OPEN] else CHROME
    return [(likely if zone == LIKELY else CHROME if zone > ARTICLE else zone, text) for zone, text in found]


def blocks(page: str) -> list[tuple[int, str]]:
    """(zone, text) of the non-empty blocks of a page, in order; white space collapsed, references decoded."""
    out: list[tuple[int, str]] = []
    text: list[str] = []
    stack: list[tuple[str, int]] = []  # open elements and the zone inside each
    opened: Counter[str] = Counter()  # how many elements of each name are open
    forms: list[list[int]] = []  # the zone around each form, and whether it holds a page
    zone = OPEN

    def end_block() -> None:
        nonlocal text
        joined = " ".join("".join(text).split())
        if joined:
            out.append((zone, joined))
        text = []

    def close(name: str) -> bool:
        nonlocal zone
        if not opened[name]:
            return False
        if name not in _INLINE:
            end_block()
        while True:
            last, _ = stack.pop()
            opened[last] -= 1
            if last == name:
                break
        new = stack[-1][1] if stack else OPEN
        if new != zone:
            end_block()
            zone = new
        return True

    def enter(name: str) -> None:
        stack.append((name, zone))
        opened[name] += 1

    at = 0
    while (m := _MARKUP.search(page, at)) is not None:
        if m.start() > at:
            piece = page[at: m.start()]
            text.append(entities.unescape(piece) if "&" in piece else piece)
        at = m.end()
        name = m.group(2)
        if name is None:
            raw = _RAW_START.match(page, m.start())
            if raw:  # up to its own end tag, whatever stands inside
                end = re.compile(rf"</{raw.group(1)}\s*>", re.IGNORECASE).search(page, raw.end())
                at = end.end() if end else len(page)
            elif m.group(0)[:9].upper() == "<![CDATA[":
                text.append(m.group(0)[9:].removesuffix("]]>"))
            continue
        name = name.lower()
        if name in _SPACED:
            text.append(" ")
        if name == "br":
            continue
        if m.group(1):
            if not close(name) and name not in _INLINE:
                end_block()
        elif name in _VOID:
            if name == "hr":
                end_block()
        else:
            around = zone
            while around >= FORM:
                around = forms[around - FORM][0]
            mark = _marks(name, m.group(3), around in (ARTICLE, LIKELY))
            if name in _INLINE:
                chrome = mark in (SOFT, NAMED, COMMENTS)
                if chrome or opened[name]:
                    new = _inside(zone, mark) if chrome else zone
                    if new != zone:
                        end_block()
                        zone = new
                    enter(name)
                continue
            end_block()
            if name in _ENDS_P and opened["p"]:
                close("p")
            for sibling in _SIBLINGS.get(name, ()):
                if stack and stack[-1][0] == sibling:
                    close(sibling)
            if zone >= FORM and name in _LANDMARKS:
                forms[zone - FORM][1] = 1
            if mark != FORM:
                zone = _inside(zone, mark)
            elif zone in (OPEN, ARTICLE, LIKELY):
                forms.append([zone, 0])
                zone = FORM + len(forms) - 1
            enter(name)
    if at < len(page):
        piece = page[at:]
        text.append(entities.unescape(piece) if "&" in piece else piece)
    end_block()
    return _settled(out, forms)


#: Kinds of suffixes: outside articles, blocks of articles, and no suffixes but what counts the articles of a host.
TOKEN, BLOCK, COUNT = 0, 1, 2
_SUFFIX = [("host", pa.string()), ("kind", pa.int8()), ("lead", pa.string()), ("article", pa.int64()), ("uid", pa.int64()), ("pos", pa.int32()),
           ("asks", pa.bool_())]
_FOUND = [("host", pa.string()), ("lead", pa.int64()), ("articles", pa.int64()), ("uid", pa.int64()), ("pos", pa.int64())]
#: Rows of one batch of places.
_BATCH = 10_000


def _hash64(text: str) -> int:
    return int.from_bytes(blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


def _parse(page: str | None) -> tuple[list[str], list[tuple[bool, str]]]:
    """The blocks of the marked article (none: no article is marked, or it is empty) and those outside it, each with whether it is open."""
    found = blocks(page or "")
    return [t for z, t in found if z == ARTICLE], [(z == OPEN, t) for z, t in found if z != ARTICLE]


def _block_leads(article: list[str]) -> Iterator[tuple[int, str]]:
    """(block, what its suffix is compared by): the first MIN_RUN tokens from its start on, and a digest of the block if it is longer."""
    words = [t.split() for t in article]
    tokens = [w for own in words for w in own]
    at = 0
    for i, own in enumerate(words):
        lead = tokens[at: at + MIN_RUN]
        if len(lead) == MIN_RUN:
            yield i, " ".join(lead) + ("\n" + blake2b(article[i].encode(), digest_size=16).hexdigest() if len(own) > MIN_RUN else "")
        at += len(own)


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The suffixes of each page, at every token outside its article and every block of it, and where they start; a row that counts the article."""
    for batch in batches:
        out: list[list] = [[] for _ in _SUFFIX]
        for host, uid, page in zip(*(batch.column(c).to_pylist() for c in ("host", "uid", "html")), strict=True):
            article, rest = _parse(page)
            tokens = " ".join(t for _, t in rest).split()
            starts = [(TOKEN, " ".join(tokens[i: i + MIN_RUN]), i) for i in range(len(tokens) - MIN_RUN + 1)]
            outside, own = len(starts), None
            if article:
                own = _hash64(SEPARATOR.join(article))
                starts += [(BLOCK, lead, i) for i, lead in _block_leads(article)]
                starts.append((COUNT, str(own % COUNTERS), 0))
            if starts:
                kinds, leads, places = zip(*starts, strict=True)
                n = len(starts)
                ids = [None] * outside + [own] * (n - outside)
                for column, values in zip(out, ([host] * n, kinds, leads, ids, [uid] * n, places, [not article] * n), strict=True):
                    column += values
        yield _batch(_SUFFIX, out)


def _batch(fields: list[tuple[str, pa.DataType]], columns: Iterable[Iterable]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _shared_tokens(run: Iterator[tuple]) -> Iterator[tuple]:
    """The places (of pages that ask) of one suffix outside articles, if a neighbour of another page agrees."""
    first, waiting, shared = None, [], False
    for *_, uid, pos, asks in run:
        first = uid if first is None else first
        if not shared and uid != first:
            shared = True
            yield from waiting
        if asks and shared:
            yield None, None, None, uid, pos
        elif asks:
            waiting.append((None, None, None, uid, pos))


def _shared_block(host: str, lead: str, run: Iterator[tuple]) -> Iterator[tuple]:
    """The places of one block that MIN_ARTICLES articles share, and how many articles do."""
    last, articles, mark = None, 0, _hash64(lead)
    waiting = array("q")
    for *_, article, uid, pos, _asks in run:
        if article != last:
            articles, last = articles + 1, article
        waiting.extend((uid, pos))
        if articles >= MIN_ARTICLES:
            yield from ((host, mark, None, u, p) for u, p in zip(waiting[::2], waiting[1::2], strict=True))
            del waiting[:]
    if articles >= MIN_ARTICLES:
        yield host, mark, articles, None, None


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From suffixes in order what neighbours share: places with the hash of their block (none outside articles), and counts of articles."""
    def found() -> Iterator[tuple]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for (host, kind, lead), run in groupby(rows, itemgetter(0, 1, 2)):
            if kind == TOKEN:
                yield from _shared_tokens(run)
            elif kind == BLOCK:
                yield from _shared_block(host, lead, run)
            else:  # rows come ordered by article
                yield host, None, sum(1 for _ in groupby(run, itemgetter(3))), None, None

    rows = found()
    while some := list(islice(rows, _BATCH)):
        yield _batch(_FOUND, zip(*some, strict=True))


def _covered(found: DataFrame) -> DataFrame:
    """(uid, places): the tokens outside an article, or the blocks of it, that are the host's."""
    total = found.filter("lead is null and articles is not null").groupBy("host").agg(F.sum("articles").alias("total"))
    common = found.filter("lead is not null and articles is not null").join(total, "host").filter("2 * articles > total").select("host", "lead")
    inside = found.filter("lead is not null and uid is not null").join(common, ["host", "lead"], "left_semi").select("uid", "pos")
    outside = found.filter("lead is null and uid is not null").select("uid", "pos")
    return inside.union(outside).groupBy("uid").agg(F.collect_set("pos").alias("places"))


def _own_blocks(article: list[str], covered: set[int]) -> list[str]:
    """The blocks of an article without the host's; all of them if these are most of it."""
    size = [len(t.split()) for t in article]
    if 2 * sum(size[i] for i in covered) > sum(size):
        return article
    return [t for i, t in enumerate(article) if i not in covered]


def _unique_runs(found: list[tuple[bool, str]], covered: set[int]) -> list[str]:
    """The open blocks without the tokens that repeated substrings cover."""
    gone = {i + k for i in covered for k in range(MIN_RUN)}
    at, kept = 0, []
    for is_open, text in found:
        tokens = text.split()
        if is_open:
            left: list[str] = []
            for covered_run, run in groupby(enumerate(tokens, at), lambda x: x[0] in gone):
                words = [t for _, t in run]
                # a few words at the edge of a block, covered from the block next to it, are chance
                left += words if not covered_run or len(words) < min(MIN_RUN, len(tokens)) else []
            kept += [" ".join(left)] if left else []
        at += len(tokens)
    return kept


def _texts(pages: pa.Array, places: pa.Array) -> list[pa.Array]:
    """What repetition leaves of each page: of its article, or of its open blocks if it marks none."""
    out = []
    for page, covered in zip(pages.to_pylist(), places.to_pylist(), strict=True):
        article, rest = _parse(page)
        out.append(SEPARATOR.join((_own_blocks if article else _unique_runs)(article or rest, set(covered or ()))))
    return [pa.array(out, pa.string())]


def _written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the checkpoint folder: what reads it knows its size."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text) of every page."""
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).alias("html"))
    rows = rows.select("key", "url", "html", url_parts(F.col("url"))[0].alias("host"), F.xxhash64("key", "url", "html").alias("uid"))
    suffixes = rows.select("host", "uid", "html").mapInArrow(_suffixes, "host string, kind byte, lead string, article long, uid long, pos int, asks boolean")
    dealt = ["host", "kind", "lead"]
    order = suffixes.repartition(*dealt).sortWithinPartitions(*dealt, "article", "uid", "pos")
    found = _written(order.mapInArrow(_repeated, "host string, lead long, articles long, uid long, pos long"), "repeated")
    covered = _written(_covered(found), "covered")
    decided = add_columns(rows.select("key", "url", "html", "uid").join(covered, "uid", "left"), ["html", "places"], _texts, [("text", "string")])
    return decided.select(F.col("key").alias(key), F.col("url").alias(url), "text")


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
