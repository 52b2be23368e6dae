"""Main text of web pages by markup zones and suffix arrays over hosts.

A page is read as blocks of text in page order, each in a zone: *boilerplate*
where its element says so (nav, footer, aside, form controls, ...) or a word of its
class, id or role does beside other text, *article* inside ``article`` or ``main``,
*open* elsewhere.  A form may wrap a whole page: an article inside it counts, and
on a page without one a form that holds by far the most text is open.  Inside an
article a class counts only if all words of a name speak of boilerplate.  Blocks
outside articles form the page's token stream.

The streams of a host's pages are concatenated, a suffix array with the lengths of
common prefixes is built over them, and runs of at least ``MIN_RUN`` tokens that
stand on two pages of different content are *covered*.  A task builds the array
over the pages it reads, up to ``ARRAY_TOKENS`` tokens at a time; for each
distinct run of ``MIN_RUN`` tokens (one group of the array) it tells a 128-bit hash
and the least and largest content hash, which are aggregated over all tasks.
A longer run is covered exactly if each run of ``MIN_RUN`` tokens in it is, so the
outcome does not depend on how pages are dealt over tasks, and a host of any size
is never held in one.  Runs that repeat within an array are decided there; the
others of a page are looked up among those that repeat over all tasks.

Boilerplate goes; an open block goes if most of its tokens are covered, beside an
article too, and stays whole otherwise.  Article blocks stay, repeated or not.  A
page never loses all its text to repeats.
"""

from __future__ import annotations

import hashlib
import html as entities
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_rows

MIN_RUN = 6
ARRAY_TOKENS = 400_000  # of one suffix array, about

BOILER, OPEN, ARTICLE, SOFT, FORM = 0, 1, 2, 3, 4

#: Elements of HTML by what they mean for the main text.
BOILER_TAGS = frozenset("nav footer aside button select dialog menu noscript template svg iframe object canvas audio video head map datalist".split())
RAW_TAGS = frozenset("script style title textarea xmp noembed noframes".split())
INLINE_TAGS = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of a class, id or role that mark what is not the article.
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentary complementary consent contentinfo cookie cookies dialog disqus disclaimer flash footer "
    "form gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promotion recommended related replies reply search share sharing sidebar "
    "signup skip social sponsor sponsored subscribe teaser toolbar topbar widget alert".split()
)
HEADER_WORDS = frozenset({"header"})
#: Words that go with those: inside an article a name of other words besides says nothing.
COMPANION_WORDS = frozenset(
    "area bar block bottom box button buttons card container content count counter grid group icon icons inner item items label left link links list main media module new outer panel post posts right row "
    "section slot story stories text thread title tool tools top unit user wrap wrapper".split()
)
#: Words before one of those that turn its meaning: ``has-sidebar`` is no sidebar.
TURNING_WORDS = frozenset("has have no not non with without hide hides show shows is".split())

_START = re.compile(r"""<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))""")
_QUOTED = re.compile(r"""((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW_TAGS}


def _class_words(value: str, in_article: bool) -> bool:
    """Whether a class, id or role marks what is not the article."""
    for name in value.split():
        words = list(map(str.lower, _WORDS.findall(name)))
        marks = [w in BOILER_WORDS or not in_article and w in HEADER_WORDS for w in words]
        if in_article and not all(m or w in COMPANION_WORDS for m, w in zip(marks, words, strict=True)):
            continue
        if any(m and (not k or words[k - 1] not in TURNING_WORDS) for k, m in enumerate(marks)):
            return True
    return False


def _zone_inside(tag: str, attributes: str, zone: int) -> int:
    """The zone inside an element that stands in ``zone``."""
    if zone in (BOILER, SOFT):
        return zone
    if tag in BOILER_TAGS or tag == "header" and zone != ARTICLE:
        return BOILER
    own = ARTICLE if tag in ("article", "main") else zone
    if tag == "form":
        own = SOFT if zone == ARTICLE else FORM
    if not attributes or tag in ("html", "body"):
        return own
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return BOILER
        if name in ("class", "id", "role") and _class_words(value, own == ARTICLE):
            return SOFT
    return own


def _tags(source: str):
    """(start, end, closes, name, attributes) of the tags in order; the name is ''
    for comments and declarations.  Time is linear: a page whose quotes do not
    close is read without regard to quotes from there on."""
    at, quotes = 0, True
    while m := _START.search(source, at):
        begin = m.start()
        if m.group(2) is None:
            comment = source.startswith("<!--", begin)
            end = source.find("-->" if comment else ">", m.end())
            at = len(source) if end < 0 else end + (3 if comment else 1)
            yield begin, at, "", "", ""
            continue
        body = _QUOTED.match(source, m.end()) if quotes else None
        if body is None:
            quotes, end = False, source.find(">", m.end())
            if end < 0:  # a tag cut off by the page's end
                yield begin, len(source), "", "", ""
                return
            attributes, at = source[m.end() : end], end + 1
        else:
            attributes, at = body.group(1), body.end()
        tag = m.group(2).lower()
        if tag in RAW_TAGS and not m.group(1) and not attributes.endswith("/"):
            end = _RAW_END[tag].search(source, at)
            at = end.end() if end else len(source)
        yield begin, at, m.group(1), tag, attributes


def page_blocks(source: str) -> list[tuple[int, str]]:
    """(zone, text) of a page's blocks in order; references decoded, white space
    made single spaces.  Markup that is never closed lasts to the page's end."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []  # open elements that are not inline, with the zone around
    opened: dict[str, int] = {}
    zone, parts, at = OPEN, [], 0

    def flush():
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append((zone, text))
            parts.clear()

    def push(tag: str, inside: int):
        nonlocal zone
        stack.append((tag, zone))
        opened[tag] = opened.get(tag, 0) + 1
        zone = inside

    def pop():
        nonlocal zone
        tag, zone = stack.pop()
        opened[tag] -= 1
        return tag

    for begin, end, closes, tag, attributes in _tags(source):
        if begin > at:
            parts.append(source[at:begin])
        at = end
        if not tag or tag in RAW_TAGS:
            continue
        if tag in INLINE_TAGS:
            if not closes and tag not in VOID_TAGS and attributes and (inside := _zone_inside(tag, attributes, zone)) != zone:
                flush()
                push(tag, inside)
            elif closes and stack and stack[-1][0] == tag:
                flush()
                pop()
            continue
        flush()
        if tag in VOID_TAGS:
            continue
        if closes:
            if opened.get(tag):
                while pop() != tag:
                    pass
        else:
            if tag == "p" and stack and stack[-1][0] == "p":
                pop()
            if not attributes.endswith("/"):
                push(tag, _zone_inside(tag, attributes, zone))
    if at < len(source):
        parts.append(source[at:])
    flush()
    return _settled(out)


def _settled(blocks: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """Class words and forms count beside other text only: on a page without
    article they never take what is by far the largest part of its text."""
    size = [0] * 5
    for zone, text in blocks:
        size[zone] += len(text)
    form = OPEN if not size[ARTICLE] and size[FORM] > 4 * size[OPEN] else BOILER
    free = size[OPEN] + size[FORM] * (form == OPEN)
    soft = OPEN if not size[ARTICLE] and size[SOFT] > 4 * free else BOILER
    now = {SOFT: soft, FORM: form}
    return [(now.get(zone, zone), text) for zone, text in blocks]


def suffix_array(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the suffixes in order, and for each the length of the common
    prefix with the one before it (0 for the first), by prefix doubling."""
    n = len(tokens)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    levels = [np.unique(tokens, return_inverse=True)[1].astype(np.int64)]
    while int(levels[-1].max()) + 1 < n:
        rank, step = levels[-1], 1 << len(levels) - 1
        later = np.zeros(n, np.int64)
        later[: max(0, n - step)] = rank[step:] + 1
        levels.append(np.unique(rank * (n + 1) + later, return_inverse=True)[1].astype(np.int64))
    order = np.argsort(levels[-1])
    a, b, common = order[:-1].copy(), order[1:].copy(), np.zeros(n, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        both = np.flatnonzero(np.maximum(a, b) < n)
        same = both[levels[k][a[both]] == levels[k][b[both]]]
        common[1 + same] += 1 << k
        a[same] += 1 << k
        b[same] += 1 << k
    return order, common


def _mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _number(text: str, size: int = 16) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=size).digest(), "little")


def content_number(blocks: list[tuple[int, str]]) -> int:
    """A page's content as a signed 64-bit number: equal for equal blocks."""
    return _number("\n".join(f"{zone} {text}" for zone, text in blocks), 8) - (1 << 63)


class HostRuns:
    """The runs of ``MIN_RUN`` tokens on some pages, by one suffix array.

    ``pages``: (host, content, tokens).  ``runs``: for each distinct run two hash
    numbers, and the least and the largest content it stands on.  ``covered[k]``
    marks page k's tokens in runs on two contents; ``asks[k]`` are (place, hash,
    hash) of its other runs.
    """

    def __init__(self, pages: list[tuple[str, int, list[str]]], length: int = MIN_RUN):
        ids: dict[tuple[str, str], int] = {}
        flat: list[int] = []
        for k, (host, _, tokens) in enumerate(pages):
            flat += [ids.setdefault((host, t), len(ids)) for t in tokens]
            flat.append(-1 - k)  # a token of no other page ends each stream
        sizes = np.array([len(t) for _, _, t in pages], np.int64)
        firsts = np.cumsum(sizes + 1) - sizes - 1
        page = np.repeat(np.arange(len(pages)), sizes + 1)
        content = np.array([c for _, c, _ in pages], np.int64)[page]
        tokens = np.array(flat, np.int64)
        whole = np.arange(len(tokens)) + length <= (firsts + sizes)[page] if len(tokens) else np.zeros(0, bool)
        order, common = suffix_array(tokens)
        begins = np.flatnonzero(common < length)  # each group of suffixes with one beginning of that length
        begins = begins[whole[order[begins]]]
        ends = np.append(np.flatnonzero(common < length), len(order))
        ends = ends[np.searchsorted(ends, begins, "right")]
        members = order[_spans(begins, ends - begins)]
        group = np.repeat(np.arange(len(begins)), ends - begins)
        at = np.concatenate(([0], np.cumsum(ends - begins)[:-1])).astype(np.int64) if len(begins) else np.zeros(0, np.int64)
        low, high = (f.reduceat(content[members], at) if len(begins) else np.zeros(0, np.int64) for f in (np.minimum, np.maximum))
        parts = [(_number(h), _number(t)) for h, t in ids]
        halves = []
        for shift in (0, 64):
            own = np.array([(t >> shift) & (2**64 - 1) for _, t in parts], np.uint64)
            value = np.array([(h >> shift) & (2**64 - 1) for h, _ in parts], np.uint64)[tokens[order[begins]]] if len(begins) else np.zeros(0, np.uint64)
            for k in range(length):
                value = _mixed((value ^ own[tokens[order[begins] + k]]) + np.uint64(0x9E3779B97F4A7C15))
            halves.append(value.view(np.int64))
        self.runs = np.stack([*halves, low, high], axis=1) if len(begins) else np.zeros((0, 4), np.int64)
        several = (low < high)[group] if len(begins) else np.zeros(0, bool)
        cover = np.zeros(len(tokens) + 1, np.int64)
        np.add.at(cover, members[several], 1)
        np.add.at(cover, members[several] + length, -1)
        covered = np.cumsum(cover[:-1]) > 0
        self.covered = [covered[f : f + n] for f, n in zip(firsts, sizes)]
        alone, its = members[~several], group[~several]
        by = np.argsort(alone)
        alone, its = alone[by], its[by]
        cut = np.searchsorted(alone, np.append(firsts, len(tokens)))
        self.asks = [np.stack((alone[a:b] - f, self.runs[its[a:b], 0], self.runs[its[a:b], 1]), axis=1) for f, a, b in zip(firsts, cut[:-1], cut[1:])]


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def outer_tokens(blocks: list[tuple[int, str]]) -> list[str]:
    """The tokens of a page that stand outside articles."""
    return [t for zone, text in blocks if zone != ARTICLE for t in text.split(" ")]


def main_text(blocks: list[tuple[int, str]], covered: np.ndarray | None = None) -> str:
    """A page's main text.  ``covered``: for each token outside articles whether
    it lies in a repeated run; repeats go only where some text is left."""
    kept, at, gone = [], 0, False
    for zone, text in blocks:
        if zone == ARTICLE:
            kept.append(text)
            continue
        n = text.count(" ") + 1
        own = covered[at : at + n] if covered is not None else ()
        at += n
        if zone == OPEN:
            if 2 * int(np.sum(own)) > n:
                gone = True
            else:
                kept.append(text)
    if gone and not kept:
        kept = [text for zone, text in blocks if zone == OPEN]
    return "\n".join(kept)


def page_host(url):
    """The host of a URL, lower case ('' if there is none)."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


RUN_SCHEMA = (
    "a long, b long, low long, high long, "  # a run
    "key binary, page_id long, url string, zones array<int>, texts array<string>, covered array<int>, ask_at array<int>, ask_a array<long>, ask_b array<long>"  # a page with open text
)


def extract_main_text(pages: DataFrame, array_tokens: int = ARRAY_TOKENS) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page.

    Null html counts as empty and gives an empty text; a null page_id or url is
    kept; pages without a host form one host; repeated rows are pages each, and
    count as one content where repeats are sought; an empty table gives no row.
    Markup cut off lasts to the page's end, and a very long page is read in linear
    time by the task that holds it.
    Runs count as equal by 128 bits of hash between arrays, by their tokens inside
    one.  Columns besides page_id, url and html are ignored.
    """
    scratch = Scratch(pages.sparkSession)
    html = F.coalesce("html", F.lit(""))
    key = F.unhex(F.md5(F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), F.coalesce("url", F.lit("-")), html)))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), page_host(F.col("url")).alias("host")).withColumn("key", key)
    columns = ["key", "page_id", "url", "host", "html"]
    nothing = (None,) * 9

    def reading():
        def work(rows):
            held, tokens = [], 0

            def array():
                runs = HostRuns([one for _, one, _ in held])
                for a, b, low, high in runs.runs.tolist():
                    yield (a, b, low, high, *nothing)
                for (page, _, blocks), covered, asks in zip(held, runs.covered, runs.asks, strict=True):
                    if page is not None:  # a page with open text
                        at, a, b = asks.T.tolist() if len(asks) else ([], [], [])
                        yield (None,) * 4 + (*page, [z for z, _ in blocks], [t for _, t in blocks], np.flatnonzero(covered).tolist(), at, a, b)

            for key_, page, url, host, source in rows:
                blocks = page_blocks(source)
                is_open = any(zone == OPEN for zone, _ in blocks)
                outer = outer_tokens(blocks)
                held.append(((key_, page, url) if is_open else None, (host, content_number(blocks), outer), blocks if is_open else ()))
                tokens += len(outer)
                if tokens >= array_tokens or len(held) >= 20_000:
                    yield from array()
                    held, tokens = [], 0
            yield from array()

        return work

    seen = scratch.save(arrow_rows(own, columns, RUN_SCHEMA, reading, 4096), "runs")
    # Runs on two contents over all arrays, and what pages with open text ask of them.
    repeated = seen.where("a IS NOT NULL").groupBy("a", "b").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("a", "b")
    open_pages = seen.where("key IS NOT NULL").drop("a", "b", "low", "high")
    asked = open_pages.select("key", F.explode(F.arrays_zip("ask_at", "ask_a", "ask_b")).alias("q")).select("key", F.col("q.ask_at").alias("at"), F.col("q.ask_a").alias("a"), F.col("q.ask_b").alias("b"))
    answers = asked.join(repeated, ["a", "b"]).groupBy("key").agg(F.collect_set("at").alias("elsewhere"))  # of one page's own tokens

    def closed():
        def work(rows):
            for page, url, source in rows:
                blocks = page_blocks(source)
                if not any(zone == OPEN for zone, _ in blocks):
                    text = main_text(blocks)
                    yield page, url, text, len(text)

        return work

    def opened():
        def work(rows):
            for page, url, zones, texts, covered, elsewhere in rows:
                blocks = list(zip(zones, texts, strict=True))
                marks = np.zeros(sum(t.count(" ") + 1 for z, t in blocks if z != ARTICLE), bool)
                marks[covered] = True
                for at in elsewhere or ():
                    marks[at : at + MIN_RUN] = True
                text = main_text(blocks, marks)
                yield page, url, text, len(text)

        return work

    result = "page_id long, url string, text string, n_chars long"
    first = arrow_rows(own, ["page_id", "url", "html"], result, closed, 512)
    second = arrow_rows(open_pages.join(answers, "key", "left"), ["page_id", "url", "zones", "texts", "covered", "elsewhere"], result, opened, 512)
    return first.unionByName(second)
