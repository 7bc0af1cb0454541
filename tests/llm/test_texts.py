import gzip
import hashlib
import random
import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from weftline.llm import transcripts as X
from weftline.llm.html_text import extract, main_text, surge_and_dive
from weftline.llm.token_counts import PrefixCounter, fitting, prefix_tables, running, token_counts
from weftline.llm.warc import read_archives, resolve, round_trip, write_archives

tokenizers = pytest.importorskip("public_tokenizers")
PATH = tokenizers.path("byte_bpe_50k.json")


def test_every_prefix_is_exact():
    counter, draw = PrefixCounter(PATH), random.Random(1)
    letters = [*"ab '’sltve.!  \n\t\x1c\x0b1é日\xa0\u2003", "<|endoftext|>", "<|end", "oftext|>", "'ll", "'re", "the", " and", "aaa", "   "]
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 25))) for _ in range(1500)]
    for text in [*texts, "x" * 700, "é" * 300 + " " * 300 + "!?" * 150, "ab" * 100 + "<|endoftext|>" * 3]:
        want = [0, *counter.encoded([text[:i] for i in range(1, len(text) + 1)])]
        have = running(*counter.steps(text))
        assert have.tolist() == want
        budget = draw.randint(0, 8)
        assert fitting(have, budget) == max(i for i, n in enumerate(want) if n <= budget)


def test_token_counts(spark):
    rows = [(1, None), (2, ""), (3, "Hello  world<|endoftext|>\n"), (4, "word " * 5000), (5, "x" * 30_000), (3, "Hello  world<|endoftext|>\n"), (None, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_tokens": F.lit("clash"), "steps": F.lit(1)})
    got = token_counts(df, PATH).collect()
    direct = PrefixCounter(PATH)
    texts = dict(rows)
    assert len(got) == 7
    for r in got:
        text = texts[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), direct.encoded([text])[0], direct.encoded([text])[0] > 512)
        assert direct.encoded([text[: r.fit_chars]])[0] <= 512 and (r.fit_chars == len(text) or all(n > 512 for n in direct.encoded([text[: r.fit_chars + i] for i in range(1, 40)])))
    assert token_counts(df.limit(0), PATH).count() == 0
    assert [len(running(r.width, r.steps)) for r in prefix_tables(df.where("doc_id < 4"), PATH).orderBy("doc_id").collect()] == [1, 1, 27, 27]


def test_counts_of_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    direct = PrefixCounter(PATH)
    for r in token_counts(docs, PATH).collect():
        assert r.n_tokens == direct.encoded([texts[r.doc_id] or ""])[0]


def test_warc_round_trip(spark, tmp_path):
    big, other = "é<p>" * 400, "z" * 999
    rows = [(1, "http://a/ b", big), (2, None, big), (9, "http://c", big), (3, "u", other), (4, "u", other), (5, "u", None), (6, "u", ""), (7, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n" * 60), (9, "http://c", big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload_digest", F.lit("clash"))
    got = sorted((tuple(r) for r in round_trip(df, f"file://{tmp_path}/a").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        again = html == big and i < 9
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", 9 if again else None))
    assert got == sorted(want, key=str)
    raw = read_archives(spark, f"file://{tmp_path}/a")
    assert raw.where("record_type = 'revisit'").where("bytes IS NOT NULL").count() == 0
    lost = resolve(raw.where("page_id <> 9")).where("record_type = 'revisit'").collect()
    assert len(lost) == 2 and all(r.payload_bytes is None and r.refers_to == 9 for r in lost)
    write_archives(df.limit(0), f"file://{tmp_path}/b")
    assert round_trip(df.limit(0), f"file://{tmp_path}/c").count() == 0


def test_archives_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    from weftline.llm import warc

    monkeypatch.setattr(warc, "FILE_BYTES", 10_000)
    rows = [(i, "u", f"{i} " + "x" * (4_000 if i else 60_000)) for i in range(9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    write_archives(df, f"file://{tmp_path}/a")
    files = [gzip.decompress(f.read_bytes()) for f in (tmp_path / "a/responses").rglob("*.gz")]
    assert sorted(f.count(b"WARC/1.1") for f in files) == [1, 2, 2, 2, 2], "the large one alone, then two a file"
    assert read_archives(spark, f"file://{tmp_path}/a").agg(F.sum("bytes")).first()[0] == sum(len(h) for _, _, h in rows)
    assert re.search(r"WARC-Date: 20[0-9-]{8}T[0-9:]{8}Z", files[0].decode())


def test_one_large_page_makes_no_more_archives(spark, tmp_path):
    pages = spark.range(300).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") == 150, F.repeat(F.lit("large page "), 7_000_000)).otherwise(F.concat(F.lit("small "), F.col("id").cast("string"))).alias("html"))
    write_archives(pages.coalesce(2), f"file://{tmp_path}/a")
    assert len(list((tmp_path / "a").rglob("*.gz"))) <= 8
    assert read_archives(spark, f"file://{tmp_path}/a").agg(F.count("*"), F.max("bytes")).first() == (300, 77_000_000)


def test_pages_without_an_id(spark, tmp_path):
    same, other = "s" * 1500, "o" * 1500
    rows = [(None, "a", same), (4, "b", same), (None, "c", same), (None, "d", other), (None, "e", other), (None, "f", None)]
    got = round_trip(spark.createDataFrame(rows, "page_id long, url string, html string"), f"file://{tmp_path}/a").collect()
    kinds = sorted((r.record_type, r.page_id, r.refers_to, r.payload_bytes) for r in got if r.page_id or r.refers_to)
    assert kinds == [("response", 4, None, 1500), ("revisit", None, 4, 1500), ("revisit", None, 4, 1500)]
    assert sorted(r.payload_bytes for r in got) == [0, 1500, 1500, 1500, 1500, 1500]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="no-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-banner">We use cookies</div><article><h1>Head &amp;  line</h1><p>First <b>bold</b>
part.<br>Next<p>To.</p><div class='ad'>Buy <p>now</p></div><script>var x="</p>";</script><form><input><button>Go</button></form><table><tr><td>a</td><td>b &lt; c</td></tr></table>
<section id="comments"><p>Nice post</p></section><aside>More</aside></article><footer>&copy; me</footer></body></html>"""


def test_main_text():
    assert main_text(PAGE) == "Head & line First bold part. Next To. a b < c"
    assert main_text(None) == main_text("") == main_text("<p></p>") == ""
    words = "Some longer prose that goes on, with commas and clauses, for quite a while. " * 2
    bare = f"<body><div class=menu><a href=x>One</a></div><ul><li><a href=a>Two</a></li></ul><div><h2>Title here</h2><p>{words}</p><p>Short.</p><p>{words}</p></div><div id=footer>end</div></body>"
    assert main_text(bare) == f"Title here {words.strip()} Short. {words.strip()}"
    assert main_text("<p>" + "x " * 200_000) == ("x " * 200_000).strip()
    assert main_text('<article><p class="a>b">t</p><a title=">">u</a></article>') == "t u"


LONG = "Some longer prose that goes on, with commas and clauses, for quite a while, and then on."
AD = "<div class=ad>Buy now, buy more, and buy it all again before the end of this long day</div>"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<article><p>Teaser.</p></article><div><p>{LONG}</p><p>Body.</p></div>", f"Teaser. {LONG} Body."),
        (f"<div><p>{LONG}</p></div><article><p>Teaser.</p></article>", f"{LONG} Teaser."),
        (f"<div>My site</div><article><p>Head</p><p>{LONG}</p></article>", f"Head {LONG}"),
        ("<div><p>A short page.</p><p>It ends.</p></div>", "A short page. It ends."),
        (f"<h2>Heading</h2>{AD * 4}<p>{LONG}</p>", f"Heading {LONG}"),
        (f"<p>{LONG}</p>{AD * 4}<p>The end.</p>", f"{LONG} The end."),
        (f"<p>{LONG}</p><ul><li><a href=a>First source</a></li><li><a href=b>Second source</a>, 1999</li></ul><p><a href=c>{LONG}</a></p>", f"{LONG} First source Second source, 1999 {LONG}"),
        (f"<p><a href=c>{LONG}</a></p><p>Short.</p>", f"{LONG} Short."),
        ("<ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul>", "One Two"),
        (f"<ul><li><a href=a>One</a></li></ul><div>My site</div><p>{LONG}</p><p>The end.</p><ul><li><a href=a>More</a></li><li><a href=b>Top</a></li></ul>", f"My site {LONG} The end."),
        (f"<div>My site</div><p>Since 1999</p><p>Call us</p><p>Today</p><p>{LONG}</p><p>Bye.</p><p><a href=x>Back</a></p>", f"Call us Today {LONG} Bye."),
    ],
)
def test_only_chrome_is_dropped(page, want):
    assert main_text(f"<body><nav>Menu</nav>{page}<footer>Foot</footer></body>") == want


class Blocks(HTMLParser):
    """Blocks of a page and whether each stands in an article, by a stack of open elements: the plain way, for pages whose elements are closed."""

    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
    INLINE = frozenset("a b i em strong span u small sub sup code abbr img".split())
    CHROME = re.compile(r"(nav|footer|aside|form|button|select|menu|dialog|head|script|style|noscript|iframe|template|textarea|title|svg)$")
    NAMES = re.compile(r"(.*[-_])?(ad|ads|advert|banner|breadcrumbs?|comments?|comment-list|consent|cookies?|footer|header|menu|nav|newsletter|notice|popup|promo|related|search|share|sidebar|social|sponsor|sponsored|subscribe|widget)([-_].*)?$")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.blocks, self.text = [], [], []

    def flush(self):
        if text := " ".join("".join(self.text).split()):
            self.blocks.append((text, any(t in ("article", "main") for t, _ in self.open)))
        self.text = []

    def handle_starttag(self, tag, attrs):
        inside = any(t in ("article", "main") for t, _ in self.open)
        names = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role")).split()
        bad = bool(self.CHROME.match(tag)) or (tag == "header" and not inside) or (tag not in ("html", "body", "article", "main") and any(self.NAMES.match(n) for n in names)) or (tag == "article" and inside and any(self.NAMES.match(n) for n in names))
        if tag not in self.INLINE:
            self.flush()
        if tag not in self.VOID:
            self.open.append((tag, bad))

    def handle_endtag(self, tag):
        if tag not in self.INLINE:
            self.flush()
        while tag in [t for t, _ in self.open]:
            if self.open.pop()[0] == tag:
                break

    def handle_data(self, data):
        if not any(bad for _, bad in self.open):
            self.text.append(data)


def test_pages_against_a_plain_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in extract(pages).collect()}
    for r in pages.collect():
        parser = Blocks()
        parser.feed(r.html or "")
        parser.close()
        parser.flush()
        assert got[r.page_id] == " ".join(t for t, inside in parser.blocks if inside), r.page_id


def test_surge_and_dive_by_all_windows():
    draw = random.Random(7)
    for _ in range(500):
        n = draw.randint(1, 14)
        weight = [draw.choice([0, 0, 0, 10, 30, 60, 200]) for _ in range(n)]
        windows = [(a, sum(weight[a : a + 3])) for a in range(n - 2)]
        dives = {a for a, total in windows if not total}
        # stretches: lines with weight that no dive parts
        want, now = [], []
        for i in (i for i in range(n) if weight[i]):
            if now and any(now[-1] < a and a + 2 < i for a in dives):
                want.append(now)
                now = []
            now.append(i)
        want += [now] * bool(now)
        have = surge_and_dive(weight)
        assert [(a, b) for a, _, b in have] == [(own[0], own[-1] + 1) for own in want]
        for own, (a, surge, b) in zip(want, have, strict=True):
            padded = [0, 0, *weight[a:b], 0, 0]
            begins = [i for i in own if sum(padded[i - a + 2 : i - a + 5]) >= 80 or sum(padded[i - a : i - a + 3]) >= 80]
            assert surge == (begins[0] if begins else None)


PROSE = "Some longer prose that goes on, with commas and clauses, for quite a while. " * 2
ARTICLE, TEXT = f"<article><h1>Head line</h1><p>{PROSE}</p><p>Short.</p></article>", f"Head line {PROSE.strip()} Short."
SLOGAN = "We are a site about many things and this slogan has more than eighty characters in all."


@pytest.mark.parametrize(
    ("page", "bare"),
    [
        (f'<div class="overflow-hidden">{ARTICLE}</div>', True),
        (f'<div style="overflow:hidden">{ARTICLE}</div>', True),
        (f'<div class="elementor-widget elementor-widget-text-editor">{ARTICLE}</div>', True),
        (f'<div class="content-sidebar-wrap">{ARTICLE}</div>', True),
        (f'<div class="layout-sidebar-right">{ARTICLE}</div>', True),
        (f'<section id="market-share">{ARTICLE}</section>', True),
        (f'<div class="widget">{ARTICLE}</div>', True),
        (f'<form id="page"><input type="hidden" value="x">{ARTICLE}</form>', True),
        (f"<div hidden>Not yet</div>{ARTICLE}<div style='display: none'>Nor this</div>", True),
        (f'<div class="site-header"><a href=x>Home</a> Site</div>{ARTICLE}<div class="comment-list"><article><p>{PROSE * 3}</p></article></div><div class="cookie-notice">We use cookies</div>', True),
        (ARTICLE.replace("<h1>", '<div class="article-header"><h1>').replace("</h1>", "</h1></div>"), True),
        (ARTICLE.replace("<p>Short.", '<div class="ad-slot"><p>Buy</p></div><ul class="share-links"><li>Share<li>Send</ul><p>Short.'), True),
        (f"<ul><li><a href=a>One</a><li><a href=b>Two</a><li><a href=c>Three</a></ul>{ARTICLE}<ul><li><a href=a>One</a><li><a href=b>Two</a><li><a href=c>Three</a></ul><p>Since 1999, all year</p>", True),
        (f"{ARTICLE}<p>Copyright 2020 Example. All rights reserved</p>", False),
        (f"<p>{SLOGAN}</p>{ARTICLE}", False),
    ],
)
def test_whole_articles(page, bare):
    whole = f"<html><body><nav>Menu</nav>{page}<footer>Foot</footer></body></html>"
    assert main_text(whole) == TEXT
    if bare:  # where something else than the tag parts the article from the rest
        assert main_text(whole.replace("<article>", "<div>").replace("</article>", "</div>")) == TEXT


def test_formulas_and_open_elements():
    assert main_text("<article><p>Let <math><mi>x</mi></math> be a number</p></article>") == "Let x be a number"
    assert main_text(f"<p>{PROSE}<p class=ad>Buy<p>More {PROSE}<ul><li>a<li class=ad>b<li>c</ul><div class=ad>never closed") == f"{PROSE.strip()} More {PROSE.strip()} a c never closed"


def test_pages_without_article_tags(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect() if r.html]
    assert len(pages) > 200
    for page in pages:
        assert main_text(page.replace("<article>", "<div>").replace("</article>", "</div>")) == main_text(page)


def test_extract(spark):
    df = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (2, None, None)], "page_id long, url string, html string").withColumn("text", F.lit(0))
    assert [(r.page_id, r.n_chars) for r in extract(df).orderBy("page_id").collect()] == [(1, 45), (2, 0), (2, 0)]
    assert extract(df.limit(0)).count() == 0


def best_path(start, move, emit, symbols):
    score = [(start[s] + emit[s][symbols[0]], (s,)) for s in range(X.STATES)]
    for o in symbols[1:]:
        score = [max(((v + move[p[-1]][s] + emit[s][o], (*p, s)) for v, p in score), key=lambda x: x[0]) for s in range(X.STATES)]
    return max(score, key=lambda x: x[0])[1]


def test_roles_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(X, "CHUNK", 2)
    rows = [(1, t, r, x) for t, (r, x) in enumerate([("system", "Be kind."), ("user", "How?\nTell me"), ("assistant", "Like so.\n- a\n- b"), ("user", "Why?"), ("assistant", "Because.")])] * 1 + [(2, 0, "user", None), (2, 1, "assistant", ""), (None, 0, "user", "x"), (3, None, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("state", F.lit(9))
    conv = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    known = X.transcript_lines(conv).select("conv_id", (F.col("turn") / 2).cast("long").alias("chunk"), "turn", "line", "state", X.symbol(F.col("text")).alias("symbol"))
    model = X.estimate(known)
    lines = X.transcript_lines(df)
    got = X.parse(lines, model).orderBy("conv_id", "turn", "line").collect()
    for c in (1, 2):
        own = [r for r in got if r.conv_id == c]
        symbols = [r.s for r in lines.where(f"conv_id = {c}").orderBy("turn", "line").select(X.symbol(F.col("text")).alias("s")).collect()]
        score = lambda p: model[0][p[0]] + model[2][p[0]][symbols[0]] + sum(model[1][a][b] + model[2][b][o] for a, b, o in zip(p, p[1:], symbols[1:], strict=False))  # noqa: E731, B023
        assert abs(score(tuple(r.state for r in own)) - score(best_path(*model, symbols))) < 1e-9
    assert X.parse(lines.limit(0), model).count() == 0


def turns_by_hand(lines, model):
    """Rendered turns of lines (conv_id, turn, line, text, symbol) by the plain best path over whole transcripts."""
    marks = {r: re.compile(p.replace("(?i)", ""), re.I) for r, p in X.MARKERS}
    out, convs = [], {}
    for r in lines:
        convs.setdefault(r.conv_id, []).append(r)
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r.turn, r.line, r.tie))
        before, turns = None, []
        for r, s in zip(rows, best_path(*model, [r.symbol for r in rows]), strict=True):
            role, text = X.ROLES[s // 2], r.text
            if s % 2 == 0 or before is None or before // 2 != s // 2:
                m = marks[role].match(text) or marks["switch"].match(text)
                turns.append([r.turn, r.line, role, []])
                text = text[m.end() :] if m else text
            turns[-1][3].append(text)
            before = s
        out += [(conv, t, i, role, len(x), f"<|{role}|>\n" + "\n".join(x).strip(" ") + "\n<|end|>\n") for t, i, role, x in turns]
    return out


@pytest.mark.parametrize("chunk", [2, 256])
def test_query_against_whole_transcripts(spark, monkeypatch, chunk):
    monkeypatch.setattr(X, "CHUNK", chunk)
    kept, estimate = {}, X.estimate
    monkeypatch.setattr(X, "estimate", lambda lines: kept.setdefault("model", estimate(lines)))
    conv = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text")
    more = [(901, 0, "assistant", "Answer: 42 is it\nUser: not me"), (901, 1, "user", None), (901, 1, "user", None), (902, 0, "assistant", "\n".join(f"line {i}" for i in range(700))), (902, 1, None, "x"), (None, 1, "user", "x"), (903, None, "user", "x")]
    df = conv.unionByName(spark.createDataFrame(more, conv.schema)).withColumns({"line": F.lit(1), "place": F.lit("x"), "chunk": F.lit(2)})
    got = [tuple(r) for r in X.recovered_turns(df).collect()]
    lines = X.transcript_lines(df).where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", "line", "text", F.xxhash64("text").alias("tie"), X.symbol(F.col("text")).alias("symbol"))
    assert sorted(got) == sorted(turns_by_hand(lines.collect(), kept["model"]))
    assert X.recovered_turns(df.limit(0)).count() == 0


def test_recovered_roles(spark):
    conv = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    lines = X.transcript_lines(conv)
    out = X.parse(lines, X.estimate(lines.where("conv_id % 2 = 0").select("conv_id", (F.col("turn") / X.CHUNK).cast("long").alias("chunk"), "turn", "line", "state", X.symbol(F.col("text")).alias("symbol"))))
    joined = out.join(lines.select("conv_id", "turn", "line", F.col("role").alias("true")), ["conv_id", "turn", "line"]).where("conv_id % 2 = 1")
    right, total = joined.agg(F.count_if(F.col("role") == F.col("true")), F.count("*")).first()
    assert right / total > 0.85
    turns = X.render(out)
    assert turns.agg(F.sum("n_lines")).first()[0] == out.count()
    assert turns.first().rendered.startswith("<|") and turns.first().rendered.endswith("\n<|end|>\n")
