"""Main text of web pages: structure of the page, and runs repeated across a host's pages.

A page is parsed into blocks of text.  Blocks of navigation, headers, footers, sidebars, notices, adverts,
forms, scripts, styles and reader comments are noise.  The text outside articles is the page's token
stream; the streams of a host are suffix-sorted together (regions.repeated_ranges with the host in the
anchors, so that a host of any size is spread over tasks), and what other pages of the host have too is
boilerplate.  Pages with an article element give the article; blocks in it whose names have a word of
noise among others stand in the stream too and go if boilerplate covers half of them or more.  On pages without an article, the
blocks that are not noise and are not covered so are the main text.  Nothing else of an article
is removed for being repeated: copies of an article would lose their text (figures: README).
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import regions as R
from .memory import lean
from .store import saved
from .substring_suffix import classes_by_suffix_order, cover_lists, ranges_of

#: Bytes of a run that counts as long, and of the anchors.
RUN, ANCHOR = 48, 16

#: Elements by what they do to text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NOISE = frozenset(
    "nav header footer aside form script style noscript template iframe svg math button select option "
    "dialog menu canvas object audio video textarea head title datalist fieldset noembed noframes xmp".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "section summary table tbody td tfoot th thead title tr ul".split()
)
ARTICLES = frozenset(("article", "main"))
#: A start of one of these ends an open paragraph or an open element of its kind.
SELF_CLOSING = frozenset("p li dt dd tr td th option thead tbody tfoot".split())
SCOPES = frozenset("ul ol dl table article section div main body html nav aside header footer form blockquote td th figure".split())
#: Words of classes and ids. The first mark noise wherever they stand, the second only in names made of such words
#: and of CONTAINERS, as in related-posts, but not in related-work.
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored nav navbar navigation menu sidebar aside footer "
    "masthead topbar toolbar breadcrumb breadcrumbs cookie cookies consent gdpr popup modal newsletter comment comments "
    "disqus pagination pager".split()
)
WEAK_WORDS = frozenset(
    "banner promo promotion notice overlay subscribe signup reply replies respond related recommended share sharing social "
    "widget hidden skip".split()
)
CONTAINERS = frozenset(
    "area article articles bar block bottom box button buttons container content fixed form group header icons inner item items "
    "label left line link links list main media outer page panel post posts right row section site slot sticky stories top unit wrap wrapper".split()
)
#: An article is noise itself only by these.
ARTICLE_WORDS = frozenset("ad ads advert adverts advertisement sponsored promo promotion comment comments reply replies".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar alert".split())

_TAG = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|"
    r"<(/?)([a-zA-Z][^\s/>]*+)([^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))|\b(hidden)\b""")
_HOST = re.compile(r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)")
_WORD = re.compile(r"[a-z]+")


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


#: How sure it is that an element is noise: a form, a name with a word of noise in it, or an element of noise and a whole
#: name of such words. An article inside it clears all but the last.
CLEAN, FORM, NAMED, SURE = range(4)


def _name_noise(words: list[str], article: bool) -> int:
    """How sure a class or an id of these words marks noise."""
    whole = lambda noise: all(w in noise or w in CONTAINERS for w in words)
    if article:
        return SURE if not ARTICLE_WORDS.isdisjoint(words) and whole(ARTICLE_WORDS) else CLEAN
    if not NOISE_WORDS.isdisjoint(words):
        return SURE if whole(NOISE_WORDS | WEAK_WORDS) else NAMED
    return SURE if not WEAK_WORDS.isdisjoint(words) and whole(WEAK_WORDS) else CLEAN


def _noise(tag: str, attributes: str, in_article: bool) -> int:
    """How sure an element is noise by itself."""
    found = CLEAN
    if tag == "form":
        found = FORM
    elif tag in NOISE and not (tag == "header" and in_article):
        return SURE
    if not attributes or tag in ("body", "html", "main"):
        return found
    for m in _ATTRIBUTE.finditer(attributes):
        if m[5]:
            return SURE
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id"):
            for n in value.split():
                found = max(found, _name_noise(_WORD.findall(n), tag == "article"))
        elif name == "role" and value == "form":
            found = max(found, FORM)
        elif name == "role" and value in NOISE_ROLES:
            return SURE
        elif name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return SURE
    return found


#: UNSURE is in an article, in an element with a word of noise in its name.
OPEN, ARTICLE, NOISY, _IN_FORM, UNSURE = range(5)


def _settled(blocks: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """Blocks of forms are noise, unless forms hold most of the page's text."""
    size = Counter()
    for kind, text in blocks:
        size[kind] += len(text)
    kind = OPEN if size[_IN_FORM] > size[OPEN] + size[ARTICLE] + size[UNSURE] else NOISY
    return [(kind if k == _IN_FORM else k, t) for k, t in blocks]


def blocks_of(page: str | None) -> list[tuple[int, str]]:
    """Blocks of text in page order with their kinds: in no article, in an article (surely or not), noise."""
    page = page or ""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int, bool]] = []  # tag, how sure it is noise, in an article
    parts: list[str] = []
    noisy, article = CLEAN, False
    at, find = 0, _TAG.search
    lower = None

    def flush() -> None:
        if parts:
            text = "".join(parts)
            if "&" in text:
                text = html.unescape(text)
            text = " ".join(text.split())
            if text:
                clean = ARTICLE if article else OPEN
                out.append((clean if noisy == CLEAN else _IN_FORM if noisy == FORM and not article else UNSURE if noisy == NAMED and article else NOISY, text))
            parts.clear()

    while True:
        m = find(page, at)
        if m is None:
            parts.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        tag = name.lower()
        block = tag in BLOCKS
        closing = m[1] or m[4]
        if closing:
            if tag == "br":
                parts.append(" ")
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    if block or stack[depth][1] != (stack[depth - 1][1] if depth else CLEAN) or any(x[0] in BLOCKS for x in stack[depth:]):
                        flush()
                    del stack[depth:]
                    noisy, article = stack[-1][1:] if stack else (CLEAN, False)
                    break
                if not block and stack[depth][0] in BLOCKS:
                    break  # a stray end of an inline element
            else:
                if block:
                    flush()
            continue
        attributes = m[3] if m[2] else m[6]
        if tag == "br":
            parts.append(" ")
            continue
        if block:
            flush()
            if tag in SELF_CLOSING or stack and stack[-1][0] == "p":
                for depth in range(len(stack) - 1, -1, -1):
                    other = stack[depth][0]
                    if other == "p" or other == tag and tag in SELF_CLOSING:
                        del stack[depth:]
                        noisy, article = stack[-1][1:] if stack else (CLEAN, False)
                        break
                    if other in SCOPES:
                        break
        if tag in VOID:
            continue
        if tag in RAW:
            if lower is None:
                lower = page.lower()
                if len(lower) != len(page):  # case changes the length of a few letters
                    lower = "".join(c.lower() if c.isascii() else c for c in page)
            end = lower.find(f"</{tag}", at)
            if end < 0:
                at = len(page)
            else:
                at = page.find(">", end) + 1 or len(page)
            continue
        inside = article or tag in ARTICLES
        above = CLEAN if inside and not article and noisy < SURE else noisy  # of an article, only what is sure
        own = _noise(tag, attributes, article)
        noise = max(above, SURE if inside and own == FORM else own)
        if noise != noisy or inside != article:
            flush()
        noisy, article = noise, inside
        if not attributes.endswith("/") or tag not in ("svg", "path", "g"):
            stack.append((tag, noisy, article))
    flush()
    return _settled(out) if any(k == _IN_FORM for k, _ in out) else out


def _article(blocks: list[tuple[int, str]]) -> list[str] | None:
    """What surely belongs to the article before, between and after its unsure blocks; null without an article."""
    parts: list[list[str]] = [[]]
    for k, t in blocks:
        if k == ARTICLE:
            parts[-1].append(t)
        elif k == UNSURE:
            parts.append([])
    return ["\n\n".join(p) for p in parts] if len(parts) > 1 or parts[0] else None


def _chosen(blocks: list[tuple[int, str, bool]], article: list[str] | None) -> str:
    """The main text from blocks of a stream (kind, text, whether it is covered) and the parts of the article."""
    if article is None:
        return "\n\n".join(t for k, t, covered in blocks if k == OPEN and not covered)
    unsure = [(t, covered) for k, t, covered in blocks if k == UNSURE]
    if not any(article) and all(covered for _, covered in unsure):  # an article isn't emptied
        unsure = [(t, False) for t, _ in unsure]
    own = article[:1]
    for (t, covered), part in zip(unsure, article[1:]):
        own += ["" if covered else t, part]
    return "\n\n".join(t for t in own if t)


def extract(pages: DataFrame) -> DataFrame:
    """pages: page_id, url, html. Per page: page_id, url, text (blocks of the main text, joined by a blank line)
    and n_chars.

    Character references are decoded and white space inside a block becomes one space. A null or empty
    html, or one without main text, has the text "". A null url has the host "". Rows that repeat a page_id
    count as one page of their host and each get their own text; a null page_id counts as an id. An empty
    table gives an empty table. Nothing else is dropped or cut.
    """
    source = pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(R.NULL_ID)).alias("key"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))

    def streams(batches):
        for batch in batches:
            rows = []
            for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()):
                blocks = blocks_of(page)
                outside = [(k, t) for k, t in blocks if k != ARTICLE]
                rows.append((host_of(url), _article(blocks), " ".join(t for _, t in outside), [len(t.encode()) for _, t in outside], [k for k, _ in outside]))
            kinds = (pa.string(), pa.list_(pa.string()), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            made = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("url"), *made], names=["key", "url", "host", "article", "text", "sizes", "kinds"])

    made = saved(source.mapInArrow(lean(streams), "key long, url string, host string, article array<string>, text string, sizes array<int>, kinds array<int>"), "streams")
    # pages of a host with the same stream are copies of one page, which is the one with the smallest id
    same = [F.xxhash64("host").alias("grp"), F.sha2("text", 256).alias("stream")]
    first = saved(made.groupBy(*same).agg(F.min("key").alias("first")), "copies")
    own = made.select("key", "text", *same).join(first.select(F.col("first").alias("key"), "grp", "stream"), ["key", "grp", "stream"], "left_semi").dropDuplicates(["key", "grp", "stream"])
    cover = saved(cover_lists(R.repeated_ranges(own.select("key", "text", "grp"), R.Plan(RUN, ANCHOR, "byte", "docs"), classes_by_suffix_order)), "cover")

    def unique_runs(batches):
        for batch in batches:
            texts = []
            for k, (text, sizes, kinds, article) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("text", "sizes", "kinds", "article")))):
                raw = text.encode()
                mask = np.zeros(len(raw) + 1, np.int32)
                begin, end = ranges_of(batch.column("ranges"), k, k + 1)[0]
                np.add.at(mask, np.minimum(begin, len(raw)), 1)
                np.add.at(mask, np.minimum(end, len(raw)), -1)
                covered = np.append(0, np.cumsum(np.cumsum(mask[:-1]) > 0))
                at, own = 0, []
                for n, kind in zip(sizes, kinds):
                    own.append((kind, raw[at : at + n].decode(), 2 * (covered[at + n] - covered[at]) >= n))
                    at += n + 1
                texts.append(_chosen(own, article))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("url"), pa.array(texts, pa.string())], names=["key", "url", "text"])

    # an article without unsure blocks has nothing that the cover could decide
    settled = F.coalesce(F.size("article") == 1, F.lit(False))
    whole = made.filter(settled).select("key", "url", F.col("article")[0].alias("text"))
    copies = made.filter(~settled).withColumns({c: e for c, e in zip(("grp", "stream"), same)}).join(first, ["grp", "stream"])
    rest = copies.join(cover, F.col("first") == F.col("doc"), "left").select("key", "url", "text", "sizes", "kinds", "article", "ranges")
    return _named(whole.unionByName(rest.mapInArrow(lean(unique_runs), "key long, url string, text string")))


def _named(found: DataFrame) -> DataFrame:
    return found.select(F.when(F.col("key") != R.NULL_ID, F.col("key")).alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
