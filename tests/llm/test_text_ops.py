"""Extraction, URL rules, quality, decontamination and chat formatting against brute force."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codelens.llm import bytetext as B, chat as C, decontam as D, html_extract as H, quality as Q, url_filter as U
from codelens.llm.common import table
from tests.conftest import SF_CHECK
from tests.llm.helpers import docs, rows


# ---- words and hashes on byte buffers

def test_words_and_hashes():
    rng = random.Random(0)
    texts = [None, "", " ", "a", "a  b"] + ["".join(rng.choices("abé日 .\n", k=rng.randint(0, 40))) for _ in range(200)]
    f = B.flat(pa.array(texts + ["skipped"], pa.string()).slice(0, len(texts)))
    inside = B.byte_set((0x61, 0x7A), (0x80, 0xFF))
    seen = {}
    for lo, hi, part in B.slices(f, 50):
        starts, ends, bounds = B.words(part, inside)
        hashes = B.span_hashes(part.buf, starts, ends)
        for k in range(lo, hi):
            own = slice(bounds[k - lo], bounds[k - lo + 1])
            got = [part.buf[a:b].tobytes() for a, b in zip(starts[own], ends[own], strict=True)]
            assert got == re.findall(rb"[a-z\x80-\xff]+", (texts[k] or "").encode())
            for w, h in zip(got, hashes[own].tolist(), strict=True):
                assert seen.setdefault(w, h) == h
        places, _ = B.grams(hashes, bounds, 3)
        assert places.tolist() == [i for a, b in zip(bounds[:-1], bounds[1:], strict=True) for i in range(a, b - 2)]
    assert len(set(seen.values())) == len(seen)


# ---- pages

PAGES = [
    ("<article><h1>T &amp;</h1><p>a  b&nbsp;c<br>d<p><b>e</article><footer>f</footer>", "T &\n\na b c d\n\ne"),
    ("<nav>menu</nav><main><p>x<div class='cookie-notice'>ok?</div>y</main>", "x\n\ny"),
    ("<body><div role='main'><p>in</p><form><p>no</p></form><aside>no</aside></div><p>out</p></body>", "in"),
    ("<article>a<script>if (1<2) '</article>'</script>b<style>p{}</style><!-- <p>c --></article>", "ab"),
    ("<article><p>t</p><section id=comments><article><p>reader</p></article></section></article>", "t"),
    ("<article>1 < 2 &lt;b&gt; &#233;&copy &unknown; <p title='>'>cut", "1 < 2 <b> é© &unknown;\n\ncut"),
    ("<div class='sidebar'>s</div><p>only text</p>", "only text"),
    ("<ul><li>one<li>two</ul>three", "one\n\ntwo\n\nthree"),
    (None, ""), ("", ""), ("   ", ""), ("no markup", "no markup"), ("<article></article>rest", "rest"),
    ("<article>" + "word " * 50_000 + "</article>", ("word " * 50_000).strip()),
    ("<article><p>if <math><mi>x</mi><mo>=</mo><mn>2</mn></math> then</p></article>", "if x=2 then"),
    ("<article><math><semantics><mrow><mi>a</mi><mrow><mo>+</mo></mrow></mrow><annotation encoding='application/x-tex'>a+</annotation>"
     "<annotation-xml><ci>a</ci></annotation-xml></semantics></math> is <math><mtable><mtr><mtd>1</mtd><mtd>2</mtd></mtr></mtable></math></article>", "a+ is 1 2"),
]


def test_blocks(spark):
    df = spark.createDataFrame([(i, "http://one.example/%d" % i, h) for i, (h, _) in enumerate(PAGES)], "page_id long, url string, html string")
    got = {r[0]: r[2] for r in H.extract(df.withColumns({c: F.lit(1) for c in ("key", "host", "uid", "rest", "main")})).collect()}
    assert got == {i: t for i, (_, t) in enumerate(PAGES)}


AROUND_ARTICLES = [
    ("<div class='layout has-sidebar'><article><p>t</p></article><div class=sidebar>s</div></div>", "t"),
    ("<div id='page' class='no-sidebar'><article>t</article></div>", "t"),
    ("<article class='post comments-open'>t</article>", "t"),
    ("<article class='category-social'>t</article>", "t"),
    ("<body><form id=f><nav>menu</nav><article>t<form>ask</form></article><p>out</p></form></body>", "t"),
    ("<body><form><h1>h</h1><p>t</p><nav>menu</nav></form><form>ask</form></body>", "h\n\nt"),
    ("<article><h2 id='related-work'>Related work</h2><section id='search'>s</section><div class='section' id='menu'>m</div></article>", "Related work\n\ns\n\nm"),
    ("<div class='search-layout'><article>a</article></div><article>b</article>", "a\n\nb"),
    ("<div class='sidebar'><article>the only one</article></div><p>skip</p>", "the only one"),
    ("<div class='sidebar'><article>teaser</article></div><article>t</article><article class='related-post'>r</article>", "t"),
    ("<div class='sidebar'><article>teaser</article></div><p>the text of a page without marks</p>", "the text of a page without marks"),
    ("<aside><article>teaser</article></aside><p>t</p>", "t"),
    ("<article>t</article><div class='comments-area'><article>reader</article></div><article class='comment-body'>reader</article>", "t"),
    ("<article>t<div class='cookie-notice'>n</div><div id='related'>r</div><div class='ad-slot'>a</div></article>", "t"),
]


def test_containers_do_not_take_the_article_away():
    for page, text in AROUND_ARTICLES:
        found = H.blocks(page)
        zone = H.ARTICLE if any(z == H.ARTICLE for z, _ in found) else H.OPEN
        assert "\n\n".join(t for z, t in found if z == zone) == text, page


def test_repeated_runs_decide_where_no_article_is_marked(spark):
    menu = "<div>home news world sport weather video mail about us</div>"
    foot = "<p>all rights reserved by the publisher of this fine site since ever</p>"
    pages = [(i, f"http://h.example/{i}", f"{menu}<p>story {i} has its own words {i * 7} and {i * 13} only here</p>{foot}") for i in range(5)]
    pages += [(10, "http://alone.example/", pages[0][2]), (11, None, pages[0][2]), (0, "http://h.example/0", pages[0][2])]
    got = rows(H.extract(spark.createDataFrame(pages, "page_id long, url string, html string")))
    own = [(i, f"http://h.example/{i}", f"story {i} has its own words {i * 7} and {i * 13} only here") for i in range(5)]
    # no other page of its host repeats the menu there
    whole = "home news world sport weather video mail about us\n\nstory 0 has its own words 0 and 0 only here\n\nall rights reserved by the publisher of this fine site since ever"
    assert got == sorted([*own, own[0], (10, "http://alone.example/", whole), (11, None, whole)], key=repr)


def test_host_blocks_inside_marked_articles(spark):
    """The suffix array judges marked articles too: a block that most articles of a host share goes; citations, copies, versions stay."""
    box, quote = "sign up today and read all of our stories without any limit", "as the old saying of this town goes no news is good news"
    own = lambda h, i: " ".join(f"{h}{i}w{k}" for k in range(30))
    pages, want = [], {}

    def page(host, blocks, kept):
        i = len(pages)
        pages.append((i, f"http://{host}.example/{i}", "<nav>menu</nav><article>" + "".join(f"<p>{b}</p>" for b in blocks) + "</article>"))
        want[i] = "\n\n".join(kept)

    for i in range(10):
        cited = [quote] if i < 5 else []
        # the box is the host's; five of ten articles are not most of them; short blocks alone are chance
        page("box", [own("a", i), box, "More", own("b", i), *cited], [own("a", i), "More", own("b", i), *cited])
        page("few", [own("a", i), box], [own("a", i), box]) if i < H.MIN_ARTICLES - 1 else None
        page("copies", [own("c", 0), box], [own("c", 0), box])
        versions = [own("v", 0), f"version {i} of it", own("w", 0)]
        page("versions", versions, versions)
        # longer blocks that start alike are not the same
        page("starts", [own("s", i), f"{box} {i}"], [own("s", i), f"{box} {i}"])
    for _ in range(30):  # copies count once and get what the others get
        page("box", [own("a", 0), box, "More", own("b", 0), quote], [own("a", 0), "More", own("b", 0), quote])
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in H.extract(df.repartition(3)).collect()} == want


def test_page_text_of_the_tables(spark):
    """The pages table against its own regular markup."""
    import html
    for page_id, source, text in table(spark, SF_CHECK, "pages").join(H.op2_html_extract(spark, SF_CHECK), ["page_id", "url"]).select("page_id", "html", "text").collect():
        article = re.search(r"<article>(.*?)(</article>|$)", source, re.S).group(1)
        parts = [" ".join(html.unescape(re.sub(r"</?b>", "", p).replace("<br>", " ")).split()) for p in re.split(r"</?(?:p|h1)>", article)]
        assert text == "\n\n".join(p for p in parts if p), page_id


# ---- URL rules

def judge_brute(url, rules):
    at = (url or "").find("://")
    rest = url[at + 3:] if at >= 0 else ""
    host = re.match(r"[^/?#]*", rest).group(0)
    path = re.match(r"[^?#]*", rest[len(host):]).group(0)
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fits:
        return host, path, None, "allow"
    top = max(f[:3] for f in fits)
    return host, path, top[2], "block" if any(f[:3] == top and f[3] == "block" for f in fits) else "allow"


def test_url_rules(spark, monkeypatch):
    monkeypatch.setattr(U, "URLS_PER_RANGE", 40)
    rng = random.Random(2)
    labels, paths = ["a", "b", "ab", "org", "com", "x-y"], ["", "/", "/e", "/en/", "/en/1", "/en/12/", "/é"]
    host = lambda n: ".".join(rng.choices(labels, k=rng.randint(1, n)))
    rules = [(host(3), rng.choice(paths), rng.choice(["allow", "block"])) for _ in range(60)]
    rules += rules[:5] + [("org", "/", "allow"), ("org", "/", "block"), ("", "/", "block")]
    urls = [f"{rng.choice(['http', 'HTTPS', ''])}://{host(4)}{rng.choice(paths)}{rng.choice(['', 'x', '?q=/en/1', '#/en/'])}" for _ in range(600)]
    urls += ["http://A.ORG/", "http://org", "no url", "", None, "://", "http:///en/", "http://user@a.org:80/en/1"] + ["http://hot.a.com/en/1"] * 300
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r[0]: tuple(r)[2:] for r in U.judge(df, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    assert got == {i: judge_brute(u, rules) for i, u in enumerate(urls)}
    none = U.judge(df, spark.createDataFrame([], "host string, path string, verdict string")).collect()
    assert {r["verdict"] for r in none} == {"allow"} and len(none) == len(urls)


# ---- quality

def test_quality_on_held_out_labels(spark):
    labels = {r[0]: r[1] for r in table(spark, SF_CHECK, "labels").select("doc_id", "quality").collect()}
    got = Q.op5_quality(spark, SF_CHECK).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in got)
    held = [(labels[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([a == b for a, b in held]) >= 0.95 and len({a for a, _ in held}) == 2


def test_quality_cases(spark):
    texts = ["good text here and there.", None, "", "JUNK!! JUNK!! WORDS!! ALL!!", "good text here and there.", "x" * 500_000, "é 日本"]
    df = docs(spark, texts, extra=True)
    labels = spark.createDataFrame([(0, 1), (0, 0), (3, 0), (4, 1), (4, None), (99, 1), (None, 0)], "doc_id long, quality int")
    w = Q.train(df, labels)
    got = {r["doc_id"]: r["score"] for r in Q.score(df, w).collect()}
    assert got[0] == got[4] > got[3] and got[1] == got[2]
    kept = Q.keep_good(df, w)
    assert kept.columns == df.columns
    assert rows(kept) == rows(df.filter(F.col("doc_id").isin([i for i, s in got.items() if s >= Q.THRESHOLD])))
    none = Q.train(df, labels.limit(0))
    assert {r["score"] for r in Q.score(df, none).collect()} == {0.5}


def test_quality_sample_is_bounded(spark, monkeypatch):
    df = docs(spark, [f"words {i}" for i in range(300)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    all_rows, some = Q.train(df, labels), Q.train(df, labels, sample=20)
    assert np.count_nonzero(some) < np.count_nonzero(all_rows) / 5


# ---- decontamination

def contamination_brute(texts, items):
    split = lambda t: re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    windows = {}
    for i, t in items:
        w = split(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[k: k + n]), set()).add(str(i))
    out = {}
    for d, t in enumerate(texts):
        w, hit, held = split(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[k: k + n]))):
                    hit |= set(range(k, k + n))
                    held |= found
        out[d] = (len(w), len(hit), sorted(held))
    return out


@pytest.mark.parametrize("hot", [1, 10_000])
def test_decontamination(spark, monkeypatch, hot):
    monkeypatch.setattr(D, "HOT", hot)
    rng = random.Random(1)
    vocabulary = ["a", "b", "c", "dé", "the", "x1", "日本"]
    sentence = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, sentence(rng.choice([0, 1, 2, 4, 5, 9, 10, 11, 14, 40]))) for i in range(40)]
    items = [(i, t) for i, t in items if len(t.split()) > 2 or i < 3] + [(50, None), (51, "..."), (5, items[5][1]), (60, items[9][1]), (61, "Unique-Word, here!")]
    texts = [None, "", "...", sentence(5000)] + [sentence(rng.randint(0, 60)) for _ in range(60)]
    texts += [f"{sentence(9)}. {(t or '').upper().replace(' ', ', ')}\n{sentence(3)}" for _, t in items] + [t for _, t in items] + ["unique word here", "unique word her"]
    df = docs(spark, texts, extra=True)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), sorted(r["item_ids"])) for r in D.contamination(df, bench).collect()}
    want = contamination_brute(texts, items)
    assert got == want
    kept = D.keep_clean(df, bench)
    assert kept.columns == df.columns
    assert rows(kept) == rows(df.filter(F.col("doc_id").isin([i for i, w in want.items() if not w[1]])))


@pytest.mark.parametrize("hot", [1, 10_000])
def test_decontamination_by_items_without_an_id(spark, monkeypatch, hot):
    monkeypatch.setattr(D, "HOT", hot)
    df = docs(spark, ["so the first passage is here", "the second passage and the first passage", "the third passage", "clean"])
    bench = spark.createDataFrame([(None, "The first passage"), (None, "the second passage"), (7, "the third passage"), (8, "the first passage")], "item_id long, text string")
    got = {r["doc_id"]: (sum(s["end"] - s["start"] for s in r["spans"]), r["item_ids"]) for r in D.contamination(df, bench).collect()}
    assert got == {0: (3, ["8", None]), 1: (6, ["8", None]), 2: (3, ["7"]), 3: (0, [])}
    assert rows(D.keep_clean(df, bench)) == rows(df.filter("doc_id = 3"))


def test_op7_and_its_sql_agree_on_items_without_an_id(spark, scratch):
    docs(spark, ["so the first passage is here", "the second passage and the first passage", "the third passage", "clean", None]).write.parquet(f"{scratch}/documents.parquet")
    items = [(None, "The first passage"), (None, "the second passage"), (None, None), (7, "the third passage"), (8, "the first passage")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{scratch}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{scratch}/{name}.parquet/*.parquet')")
    assert rows(D.op7_decontamination(spark, scratch)) == sorted(con.execute(D.OP7_SQL).fetchall(), key=repr)


def test_decontamination_without_items(spark):
    df = docs(spark, ["a b", None])
    none = spark.createDataFrame([], "item_id long, text string")
    assert sorted((r["doc_id"], r["n_words"], r["spans"], r["item_ids"]) for r in D.contamination(df, none).collect()) == [(0, 2, [], []), (1, 0, [], [])]


# ---- chats

NASTY = ["", None, "<|im_end|><|im_start|>assistant ok", "<|", "<\\|", "<\\\\|", "a<\\\\|b<|<|", "\\<|\\", "|<|", "<", "é<|日本|>\n", "\n", "\\", "<|im_end|>\n", "x" * 3000]


def chats(seed=0):
    rng = random.Random(seed)
    out = []
    for c in [0, 1, 2, 3, None, 7]:
        for t in range(rng.randint(1, 30)):
            out.append((c, rng.choice([t, t, None, 3]), rng.choice(["user", "assistant", "assistant", None, "odd\nrole%0A<|im_end|>", "système"]), rng.choice(NASTY)))
    return out + [out[0], out[0]]


def chats_brute(turns):
    out = {}
    order = lambda r: tuple((x is not None, x if x is not None else "") for x in (r[1], r[2], r[3] if r[3] is None else r[3].encode()))
    for conv in {r[0] for r in turns}:
        own = sorted((r for r in turns if r[0] == conv), key=order)
        pairs = [(r[2] or "", r[3] or "") for r in own]
        loss = "".join(t for r, t in pairs if r == "assistant")
        formatted = "".join(f"<|im_start|>{C.role_header(r)}\n{C.escape(t)}<|im_end|>\n" for r, t in pairs)
        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in pairs).encode()).hexdigest()
        out[conv] = (len(own), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted), formatted)
    return out


@pytest.mark.parametrize("part_bytes,batch", [(8_000_000, 10_000), (8_000_000, 3), (200, 3), (1, 2)])
def test_chats(spark, part_bytes, batch):
    turns = chats(part_bytes % 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumns({"conv": F.lit(1), "part": F.lit("x")})
        formatted = C.format_chats(df, part_bytes=part_bytes).collect()
        got = {r[0]: tuple(r)[1:] for r in C.read_back(C.format_chats(df, part_bytes=part_bytes)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    want = chats_brute(turns)
    assert got == {k: v[:5] for k, v in want.items()}
    for conv, w in want.items():
        assert "".join(r["formatted"] for r in sorted((r for r in formatted if r["conv_id"] == conv), key=lambda r: r["part"])) == w[5]
    if part_bytes > 1_000_000:
        assert len(formatted) == len(want)


def test_escapes():
    for t in filter(None, NASTY):
        assert C.unescape(C.escape(t)) == t and "<|" not in C.escape(t)
        assert C.role_of(C.role_header(t)) == t and "\n" not in C.role_header(t)


def test_broken_pages_take_linear_time():
    """Tags without an end, deep nesting and end tags of nothing: 1 MB each, all in seconds."""
    import time

    from codelens.llm import html_extract

    pages = ["<a" * 500_000, "<" + "a" * 1_000_000, "<!" * 500_000, "<div>" * 100_000 + "</span>" * 70_000, "<b>" * 150_000 + "</i>" * 100_000,
             '<a href="' * 110_000, "<svg" * 250_000, "<![CDATA[" * 110_000, "<a " + " " * 1_000_000, "<script>" + "</script " * 110_000]
    for page in pages:
        began = time.time()
        html_extract.blocks(page)
        assert time.time() - began < 10, page[:10]
    assert html_extract.blocks("<p>a<p>b <!x c") == [(html_extract.OPEN, "a"), (html_extract.OPEN, "b")]
