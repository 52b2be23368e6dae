import hashlib
import os
import random
import struct
import time
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import chat, gif, html_text, topk


def plain_lzw(data, size):
    clear, end = 1 << size, (1 << size) + 1
    out, bits, have, width, table, last, free = bytearray(), 0, 0, size + 1, {}, None, end + 1
    for byte in data:
        bits |= byte << have
        have += 8
        while have >= width:
            code, bits, have = bits & ((1 << width) - 1), bits >> width, have - width
            if code == clear:
                table, free, width, last = {}, end + 1, size + 1, None
                continue
            if code == end:
                return bytes(out)
            word = bytes([code]) if code < clear else table[code] if code in table else last + last[:1]
            out += word
            if last is not None and free < 4096:
                table[free] = last + word[:1]
                free += 1
                if free == 1 << width and width < 12:
                    width += 1
            last = word
    return bytes(out)


@pytest.mark.parametrize("n", [0, 1, 2, 192, 5000, 24576])
@pytest.mark.parametrize("levels", [1, 2, 60, 256])
def test_lzw_against_a_plain_decoder(n, levels):
    rng = random.Random(n + levels)
    samples = bytes(rng.randrange(levels) for _ in range(n))
    stream = gif.lzw_encode(samples)
    assert plain_lzw(stream, 8) == samples == gif.lzw_decode(stream, 8, n).tobytes()


def pack(codes, size):
    """A code stream by the plain rules, widths growing as a decoder's do."""
    clear, width, free, bits, have, out, first = 1 << size, size + 1, (1 << size) + 2, 0, 0, bytearray(), True
    for c in codes:
        bits |= c << have
        have += width
        while have >= 8:
            out.append(bits & 255)
            bits, have = bits >> 8, have - 8
        if c == clear:
            width, free, first = size + 1, clear + 2, True
        else:
            free += not first and free < 4096
            first = False
            if free == 1 << width and width < 12:
                width += 1
    return bytes(out) + bytes([bits & 255])


def picture(frames, screen=(4, 4), palette=((0, 0, 0), (255, 0, 0), (0, 255, 0), (0, 0, 255))):
    out = [b"GIF89a", struct.pack("<HHBBB", *screen, 0xF1, 0, 0), bytes(v for c in palette for v in c)]
    for f in frames:
        left, top, w, h = f["box"]
        out.append(b"\x21\xf9\x04" + struct.pack("<BHBB", f.get("disposal", 0) << 2 | ("clear" in f), f.get("delay", 5), f.get("clear", 0), 0))
        out.append(b"\x2c" + struct.pack("<HHHHB", left, top, w, h, 0x40 * f.get("interlaced", 0)) + b"\x02")
        stream = pack([4, *[x for k, v in enumerate(f["samples"]) for x in ([v] if (k + 1) % 3 else [v, 4])], 5], 2)
        out += [bytes([len(stream)]) + stream, b"\0"]
    return b"".join([*out, b"\x3b"])


def test_composition_by_hand():
    red, green, black = [255, 0, 0], [0, 255, 0], [0, 0, 0]
    frames = gif.decode(picture([
        {"box": (0, 0, 4, 4), "samples": [1] * 16, "disposal": 1},
        {"box": (1, 1, 2, 2), "samples": [2, 0, 0, 2], "clear": 0, "disposal": 2, "delay": 7},
        {"box": (0, 0, 1, 1), "samples": [2], "disposal": 3},
        {"box": (3, 3, 1, 1), "samples": [2]},
    ]))
    assert [f.start_ms for f in frames] == [0, 50, 120, 170] and frames[1].duration_ms == 70
    assert frames[0].rgb[0, 0].tolist() == red
    assert frames[1].rgb[1, 1].tolist() == green and frames[1].rgb[1, 2].tolist() == red, "transparent samples show what is below"
    assert frames[2].rgb[1, 1].tolist() == black and frames[2].rgb[0, 0].tolist() == green, "the area went back to the background"
    assert frames[3].rgb[0, 0].tolist() == red and frames[3].rgb[3, 3].tolist() == green, "the canvas before came back"
    inter = gif.decode(picture([{"box": (0, 0, 1, 8), "samples": [0, 1, 2, 3, 0, 1, 2, 3], "interlaced": 1}], (1, 8)))[0]
    assert inter.indices[:, 0].tolist() == [0, 0, 2, 1, 1, 2, 3, 3]
    assert gif.colour_histogram(frames[0].rgb).sum() == 16


def test_damaged_files_do_not_crash(spark):
    data = gif.encode(gif.padded("some text " * 500)[1])
    small = gif.encode(gif.padded("some text " * 50)[1])
    for file, places in ((data, range(13, len(data), 97)), (small, range(13, len(small)))):
        for k in places:
            gif.decode(file[:k])
            bad = bytearray(file)
            bad[k] ^= 0x55
            try:
                gif.decode(bytes(bad))
            except ValueError:
                pass
    huge = b"GIF89a" + struct.pack("<HHBBB", 65535, 65535, 0, 0, 0)
    with pytest.raises(ValueError, match="too large"):
        gif.decode(huge)
    with pytest.raises(ValueError, match="too large"):
        gif.decode(b"GIF89a" + struct.pack("<HHBBB", 4, 4, 0, 0, 0) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 65535, 65535, 0) + b"\x08\0\0")
    with pytest.raises(ValueError, match="GIF"):
        gif.decode(b"PNG")
    media = spark.createDataFrame([(1, bytearray(data)), (2, None), (3, bytearray(b"no")), (4, bytearray(huge)), (5, bytearray(data[:14]))], "doc_id long, media binary")
    got = gif.decode_frames(media).collect()
    assert {r.media_id for r in got} == {1} and sum(len(r.rgb) for r in got) > 0 and all(sum(r.histogram) == r.width * r.height for r in got)


def test_media_digests(spark):
    texts = [None, "", "a", "é" * 96, "é" * 97, "same", "same", "long text " * 6000]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, media string")
    got = {r.doc_id: r for r in gif.media_digests(docs).collect()}
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192, b" ")
        assert (got[k].n_bytes, got[k].payload_bytes, got[k].payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert sum(map(int, got[k].feature.split(","))) >= len(payload)
    assert got[5].media_sha256 == got[6].media_sha256 and got[0].payload_bytes == 192 and got[7].n_frames == 3
    assert gif.media_digests(docs.limit(0)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="ad">
<nav><ul><li><a href="/">Home</a></li></ul></nav><!-- x --><div class="ad">Buy</div><div class="cookie-notice">Cookies</div><article><header><h1>Title &amp; more</h1></header>
<p>One  <b>bold</b> word &lt;tag&gt; a < b&nbsp;c.<br>Next<p>Unclosed <i>text <div class="share">Share</div><aside>Side</aside><form>Name<input></form>
<section><h2>Part</h2><ul><li>First<li>Second</ul></section><div class="comments"><article><p>Reader</p></article></div></article>
<section id="comments"><p>Comment</p></section><footer>&copy; Foot</footer></body></html>"""
MAIN = "Title & more\nOne bold word <tag> a < b c.\nNext\nUnclosed text\nPart\nFirst\nSecond"


def test_article_text():
    assert html_text.main_text(html_text.page_blocks(PAGE)) == MAIN
    for k in range(0, len(PAGE), 7):
        html_text.main_text(html_text.page_blocks(PAGE[:k]))


def test_class_words_never_take_the_article():
    read = lambda page: html_text.main_text(html_text.page_blocks(page))
    text = "<p>real article text that goes on for some time</p>"
    want = "real article text that goes on for some time"
    for page in (f'<div class="content has-sidebar">{text}</div>', f'<main class="no-ads">{text}</main>', f'<div class="sidebar">{text}</div>', f'<article class="ad-supported">{text}</article><p>ok</p>'):
        assert want in read(page), page
    assert read(f'<nav>Menu</nav><article>{text}<div class="ad">Buy now</div></article><div class="comment">No!</div>') == want
    assert read(f'<main>{text}</main><article class="comment"><p>Reader</p></article>') == want


def test_broken_markup_takes_linear_time():
    for page in ("<a " * 300_000, "<div>" * 100_000 + "</span>" * 100_000 + "</p>" * 100_000, '<a title="' * 100_001, "<!-- " * 200_000, "<p>" * 300_000 + "x", "<script>" * 100_000, '<div class="' + "ad " * 300_000, "&amp" * 200_000):
        began = time.perf_counter()
        html_text.page_blocks(page)
        assert time.perf_counter() - began < 10, page[:20]
    assert html_text.page_blocks('<p>one</p><a title="open>two</a><p>three "quoted" </p>')[0] == (html_text.OPEN, "one")


def test_suffix_array_by_sorting():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 50, 300):
        tokens = rng.integers(0, 3, n)
        order, common = html_text.suffix_array(tokens)
        suffixes = [tokens[k:].tolist() for k in range(n)]
        assert order.tolist() == sorted(range(n), key=suffixes.__getitem__)
        for k in range(1, n):
            a, b = suffixes[order[k - 1]], suffixes[order[k]]
            assert common[k] == next((j for j, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def brute_cover(pages, length=6):
    """For each (host, content, tokens): whether each token lies in a run that
    stands on a page of other content of the host."""
    out = []
    for host, content, tokens in pages:
        others = [o for h, c, o in pages if h == host and c != content]
        marks = [False] * len(tokens)
        for s in range(len(tokens) - length + 1):
            run = tokens[s : s + length]
            if any(o[k : k + length] == run for o in others for k in range(len(o) - length + 1)):
                marks[s : s + length] = [True] * length
        out.append(marks)
    return out


def test_suffix_array_finds_what_pages_share():
    rng = random.Random(1)
    shared = [f"s{k}" for k in range(9)]
    streams = [[f"u{p}-{k}" for k in range(rng.randint(0, 5))] + (shared if p % 2 else shared[:5]) + [f"v{p}-{k}" for k in range(4)] for p in range(6)]
    streams += [[*["again"] * 20], [], shared, shared]
    pages = [("h" if k != 1 else "g", min(k, 8), s) for k, s in enumerate(streams)]  # the last two are of one content
    runs = html_text.HostRuns(pages)
    assert [c.tolist() for c in runs.covered] == brute_cover(pages)
    told = {tuple(r) for r in runs.runs[:, :2].tolist()}
    assert len(told) == len({(h, *s[k : k + 6]) for h, _, s in pages for k in range(len(s) - 5)}) and all(tuple(q[1:]) in told for a in runs.asks for q in a.tolist())


class Articles(HTMLParser):
    """A plain reader of the test pages: the blocks inside ``article``."""

    def __init__(self):
        super().__init__()
        self.depth, self.blocks = 0, [""]

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        if tag not in ("a", "b", "i", "em", "strong", "span", "code"):
            self.blocks.append("")

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        if tag not in ("a", "b", "i", "em", "strong", "span", "code"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.depth > 0:
            self.blocks[-1] += data


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the test tables")
def test_whole_table_against_a_plain_reader(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract_main_text(pages).collect()}
    for r in pages.collect():
        reader = Articles()
        reader.feed(r.html)
        assert got[r.page_id] == "\n".join(t for b in reader.blocks if (t := " ".join(b.split()))), r.page_id


def plain_texts(rows):
    """Main texts of pages without article whose blocks are all open."""
    blocks = [html_text.page_blocks(html or "") for _, _, html in rows]
    covers = brute_cover([((url or "").split("/")[2] if "//" in (url or "") else "", str(b), html_text.outer_tokens(b)) for (_, url, _), b in zip(rows, blocks)])
    out = []
    for own, cover in zip(blocks, covers):
        kept, at = [], 0
        for _, text in own:
            n = len(text.split(" "))
            if 2 * sum(cover[at : at + n]) <= n:
                kept.append(text)
            at += n
        out.append("\n".join(kept or [t for _, t in own]))
    return out


def test_pages_without_an_article_lose_what_repeats(spark):
    chrome = "<div>Welcome to our little site about many things</div>"
    rows = [(k, f"http://h.example/{k}", f"<body>{chrome}<p>p{k}a p{k}b p{k}c only</p><p>{'x' if k else ''}</p></body>") for k in range(5)]
    rows += [(9, None, None), (10, "no url", ""), (0, "http://h.example/0", rows[0][2]), (11, "http://big.example/", PAGE), (None, "http://n.example/", "<p>null id</p>")]
    pages = spark.createDataFrame([(*r, "clash", 7) for r in rows], "page_id long, url string, html string, text string, host_number int")
    for tokens in (400_000, 20):
        got = sorted(((r.page_id or -1, r.text, r.n_chars) for r in html_text.extract_main_text(pages, tokens).collect()))
        assert (11, MAIN, len(MAIN)) in got and (9, "", 0) in got and (-1, "null id", 7) in got and len(got) == 10
        assert (3, "p3a p3b p3c only\nx", 18) in got
    assert html_text.extract_main_text(pages.limit(0)).count() == 0


def test_mirrors_keep_their_text(spark):
    body = "<p>This is one whole article that stands on two pages.</p><p>It has a second paragraph of seven words.</p>"
    rows = [(1, "http://m.example/1", body), (2, "http://m.example/2", body), (3, "http://m.example/3", body + "<p>And more.</p>"), (4, "http://m.example/4", f"<article>{body}</article>"), (5, "http://m.example/5", f"<article>{body}</article>")]
    got = {r.page_id: r.text for r in html_text.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    whole = "This is one whole article that stands on two pages.\nIt has a second paragraph of seven words."
    assert got[1] == got[2] == got[4] == got[5] == whole and got[3] == "And more."  # what two contents share, a third tells from its own


@pytest.mark.parametrize("tokens", [400_000, 1])
def test_repeats_are_found_over_the_whole_of_a_large_host(spark, tokens):
    rng = random.Random(2)
    passages = [" ".join(f"s{j}-{t}" for t in range(rng.randint(4, 9))) for j in range(40)]
    rows = []
    for k in range(60):
        own = " ".join(f"p{k}-{t}" for t in range(5))
        rows.append((k, f"http://large.example/{k}", f"<div>{passages[k % 40]}</div><p>{own}</p><div>{passages[rng.randrange(40)]}</div>"))
    rows += [rows[3], (99, "http://small.example/", f"<p>{passages[0]}</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = sorted((r.page_id, r.text) for r in html_text.extract_main_text(pages, tokens).collect())
    assert got == sorted(zip([r[0] for r in rows], plain_texts(rows)))


def test_what_repeats_decides_beside_an_article_too(spark):
    page = lambda k: f"<div>Note {k} stands {k} outside {k} alone{k}</div><div>Our shop has many good things for you</div><article><p>Text {k} of its own.</p><p>Write to us today!</p><p>{'Quoted words' if k < 4 else k}</p></article>"
    rows = [(k, f"http://h.example/{k}", page(k)) for k in range(9)]
    rows += [(20 + k, f"http://copies.example/{k}", "<article><p>One text</p></article>") for k in range(10)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for tokens in (30, 400_000):
        got = {r.page_id: r.text for r in html_text.extract_main_text(pages, tokens).collect()}
        assert got[3] == "Note 3 stands 3 outside 3 alone3\nText 3 of its own.\nWrite to us today!\nQuoted words" and got[8].endswith("own.\nWrite to us today!\n8")
        assert got[20] == "One text"


@pytest.mark.parametrize("n", [1, 7, 8, 40])
def test_headings_of_all_articles_stay_however_many_pages(spark, n):
    rows = [(k, f"http://cook.example/{k}", f"<nav>Home</nav><article><h1>Cake {k}</h1><h2>Ingredients</h2><p>Flour {k}</p><h2>Method of work</h2><p>Bake {k}</p></article>") for k in range(n)]
    for r in html_text.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        assert r.text == f"Cake {r.page_id}\nIngredients\nFlour {r.page_id}\nMethod of work\nBake {r.page_id}"


def text_of(source):
    return html_text.main_text(html_text.page_blocks(source))


def test_forms_around_pages_keep_their_articles():
    body = "<p>One long text of the page, as written.</p><p>And more.</p>"
    whole = "One long text of the page, as written.\nAnd more."
    assert text_of(f'<form id="aspnetForm"><div id="content">{body}</div></form>') == whole
    assert text_of(f"<form><article>{body}</article><button>Send</button></form>") == whole
    assert text_of(f'<form action="/"><nav>Home</nav><div class="sidebar">Side</div>{body}<input value="x"></form>') == whole
    assert text_of(f"<article>{body}<form>Your name <input></form></article>") == whole
    assert text_of(f"<div>{body}</div><form>Search <input></form>") == whole
    assert text_of(f'<main>{body}</main><section class="comments"><article>A reader wrote.</article></section>') == whole


def test_classes_inside_articles_count_as_whole_names():
    for name in ("social-history", "search-and-rescue", "fed-commentary", "noticed", "alert-levels-of-1990"):
        assert text_of(f'<article><p>One.</p><p class="{name}">Two.</p></article>') == "One.\nTwo."
        assert text_of(f'<article><p>One.</p><section id="{name}">Two.</section></article>') == "One.\nTwo."
    for name in ("comments", "comment-list", "shareButtons", "related_posts", "ad-slot", "x newsletter-signup", "cookie-notice"):
        assert text_of(f'<article><p>One.</p><div class="{name}">Two.</div></article>') == "One."


def vectors(spark, n=300, dim=8, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(k, [float(x) for x in rng.normal(0, 0.3, dim)]) for k in range(n)]
    rows += [(400 + k, rows[7][1]) for k in range(40)]  # ties
    rows += [(500, None), (520, [None] * dim), (540, [float("nan")] * dim), (560, [float("inf")] * dim), (580, [0.5] * 3), (600, []), (None, [0.1] * dim)]
    return rows


def brute_top(rows, by, k):
    import math

    sound = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in sound:
        if q % by == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, c, strict=True)), i) for i, c in sound if i != q and len(c) == len(v))
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def test_top_k_by_brute_force(spark, monkeypatch):
    rows = vectors(spark)
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int").repartition(5)
    monkeypatch.setattr(topk, "DEPTHS", (0.1, 0.3, 0.6, 0.9))
    got = sorted(tuple(r) for r in topk.divisible_queries(df, 20, 7).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute_top(rows, 20, 7)
    assert topk.divisible_queries(df.limit(0), 20).count() == 0


def test_a_repeated_query_id_takes_no_places(spark):
    rows = vectors(spark)
    rows += [(20, [4 * x for x in rows[20][1]])] * 30 + [(40, rows[40][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    got = sorted((r.query_id, r.rank, r.score) for r in topk.divisible_queries(df, 20, 20).where("query_id = 20 OR query_id = 40").collect())
    sound = {i: np.floor(64 * np.array(v)) for i, v in rows if i is not None and i < 500}
    for q in (20, 40):
        q_vector = min(tuple(np.floor(64 * np.array(v))) for i, v in rows if i == q)
        scores = [int(np.dot(q_vector, np.floor(64 * np.array(v)))) for i, v in rows if i in sound and i != q]
        assert [(r, s) for i, r, s in got if i == q] == list(enumerate(sorted(scores, reverse=True)[:20], 1))


def test_components_of_any_finite_size_count(spark):
    df = spark.createDataFrame([(20, [1 / 64, 0.0]), (1, [2.0**50, 1.0]), (2, [2.0**40, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in topk.divisible_queries(df, 20).orderBy("rank").collect()] == [(1, 2**56), (2, 2**46)]
    rng = np.random.default_rng(8)
    rows = [(k, [float(np.float32(x)) for x in rng.normal(0, 1, 4) * 10.0 ** rng.choice([0, 3, 12, 20, 30])]) for k in range(120)]
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.divisible_queries(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 20, 10).collect()}
    want = brute_top(rows, 20, 10)
    assert len(got) == len(want) == 60 and any(abs(s) >= 2**63 for *_, s in want)
    for q, r, v, s in want:
        assert got[q, r] == (v, s if -(2**63) <= s < 2**63 else None)


def test_thresholds_pass_from_block_to_block(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 32)
    rows = vectors(spark, 380, 8, 4)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    monkeypatch.setattr(topk, "plan_width", lambda *_: 2)
    got = sorted(tuple(r) for r in topk.divisible_queries(df, 20, 7).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute_top(rows, 20, 7)


def test_bounds_never_lose_a_winner():
    rng = np.random.default_rng(3)
    for large in (8, 30_000, 2**28, 2**31):
        q, c = rng.integers(-large, large, (20, 6)), rng.integers(-large, large, (500, 6))
        for row, (at, scores) in zip(q, topk.nra_block(q, c, 5), strict=True):
            whole = [sum(int(a) * int(b) for a, b in zip(row, x, strict=True)) for x in c]
            worst = sorted(whole)[-5]
            assert sorted(at.tolist()) == [k for k, s in enumerate(whole) if s >= worst] and list(scores) == [whole[k] for k in at]
        least = np.array([float(sorted((c.astype(object) @ row.astype(object)).tolist())[-2]) for row in q])
        for row, low, (at, scores) in zip(q, least, topk.nra_block(q, c, 5, least.copy()), strict=True):
            assert sum(s >= low for s in scores) >= 2


TURNS = [
    (1, 0, "system", "Be <|im_end|> kind\\"), (1, 1, "user", None), (1, 2, "assistant", "a\\<|b"), (1, 3, "user", "<\\|x"), (1, 4, "assistant", "é😀\n"),
    (2, 0, "assistant", "first"), (3, 0, "user", "x"), (3, 0, "user", "x"), (4, None, None, "no role"), (4, 1, "us\ner<\\n>", "odd"), (None, 0, "user", "null id"), (5, 0, "user", ""),
]


def test_chat_reads_back_exactly(spark):
    df = spark.createDataFrame([(*t, "clash") for t in TURNS], "conv_id long, turn long, role string, text string, segment string")
    got = {r.conv_id: r for r in chat.chat_digests(df).collect()}
    assert set(got) == {1, 2, 3, 4, 5, None}
    for conv, r in got.items():
        turns = [(role or "", text or "") for c, _, role, text in TURNS if c == conv]
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest() and r.n_turns == len(turns)
        loss = "".join(b for a, b in turns if a == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert {c: r.valid for c, r in got.items()} == {1: True, 2: False, 3: False, 4: False, 5: True, None: True}
    done = chat.format_conversations(df)
    one = done.where("conv_id = 2").head()
    assert one.formatted == "<|im_start|>assistant\nfirst<|im_end|>\n" and one.loss_spans[0] == (len("<|im_start|>assistant\n"), 5)
    plan = chat.chat_digests(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert chat.chat_digests(df.limit(0)).count() == 0


def test_another_template(spark):
    t = chat.Template(begin="<|turn|>", end="<|done|>", trains=("bot", "tool"), follows={chat.START: ("human",), "human": ("bot",), "bot": ("tool",), "tool": ("bot",)})
    df = spark.createDataFrame([(1, 0, "human", "a<|done|>"), (1, 1, "bot", "b"), (1, 2, "tool", "c")], "conv_id long, turn long, role string, text string")
    got = chat.format_conversations(df, t).select("*", chat.read_turns(F.col("formatted"), t).alias("back"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).head()
    assert got.valid and [tuple(x) for x in got.back] == [("human", "a<|done|>"), ("bot", "b"), ("tool", "c")] and got.loss == "bc"


def test_chat_with_long_texts_and_refused_marks(spark):
    long = "<|im_end|>\\ long text é " * 40_000
    df = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long), (-1, 0, "user", "own")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.chat_digests(df).collect()}
    assert got[1].loss_chars == len(long) and got[1].loss_sha256 == hashlib.sha256(long.encode()).hexdigest() and got[-1].n_turns == 1
    for marks in ({"begin": "[T]"}, {"end": "\n"}, {"end": "<|im_start|>"}):
        with pytest.raises(ValueError, match="marks"):
            chat.Template(**marks)


def test_top_k_of_few_rows_with_repeated_ids(spark):
    df = spark.createDataFrame([(20, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [0.5, 1.0]), (3, [0.5, 1.0])], "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.divisible_queries(df, 20, 20).collect())
    assert got == [(20, 1, 3, 2048), (20, 2, 3, 2048)]
