import base64
import json

from fedrank.sources import html, payloads


def frame(spark, data, status=200):
    return spark.createDataFrame([(1, "rust api", json.dumps(data), status)], "query_id long, query string, payload string, status int")


def test_reddit(spark):
    posts = [
        {"url": "https://ex.com/a", "permalink": "/r/x/1", "is_self": False, "title": "A", "selftext": "", "subreddit": "x", "score": 3},
        {"url": "https://ex.com/a", "permalink": "/r/x/2", "is_self": False, "title": "again"},
        {"url": "/r/x/3", "permalink": "/r/x/3", "is_self": True, "title": None, "selftext": "s" * 250},
    ]
    rows = payloads.from_reddit(frame(spark, {"data": {"children": [{"data": p} for p in posts]}})).orderBy("pos").collect()
    assert [(r.title, r.url, r.snippet) for r in rows] == [("A", "https://ex.com/a", "r/x · 3 points"), ("", "https://www.reddit.com/r/x/3", "s" * 200)]


def test_github(spark):
    items = [
        {"html_url": "https://github.com/a/b", "full_name": "a/b", "description": "d", "topics": ["x", "y"], "stargazers_count": 999, "fork": False},
        {"html_url": "https://github.com/a/b", "full_name": "again"},
        {"html_url": "https://github.com/c/d", "name": "d", "stargazers_count": 0, "fork": True},
        {"html_url": None},
    ]
    rows = payloads.from_github(frame(spark, {"items": items})).orderBy("pos").collect()
    assert [(r.title, r.snippet) for r in rows] == [("a/b", "d · Topics: x, y · ★ 999"), ("d", "★ 0")]
    assert rows[0].score - rows[1].score == 3 + 3


def test_wikipedia(spark):
    found = frame(spark, {"query": {"search": [{"pageid": 1, "title": "One"}, {"pageid": 2, "title": "Two"}, {"pageid": 3, "title": "Three"}, {"pageid": 4, "title": "Four"}, {"pageid": 9, "title": "None"}]}})
    pages = {
        "1": {"title": "One way", "extract": "<b>Text</b>  here"}, "2": {"title": "Two", "extract": "Two may refer to: x"},
        "3": {"title": "Three (disambiguation)", "extract": "y"}, "4": {"title": "Four", "extract": "x" * 600 + " may refer to:", "fullurl": "https://en.wikipedia.org/wiki/4"},
    }
    rows = payloads.from_wikipedia(found, frame(spark, {"query": {"pages": pages}})).orderBy("pos").collect()
    assert [(r.url, r.snippet[:9]) for r in rows] == [("https://en.wikipedia.org/wiki/One%20way", "Text here"), ("https://en.wikipedia.org/wiki/4", "x" * 9)]


def test_brave_and_errors(spark):
    df = frame(spark, {"web": {"results": [{"title": "A", "url": "https://a.b", "description": "d"}, {"title": "", "url": "https://c.d"}]}})
    assert [r.title for r in payloads.from_brave(df).collect()] == ["A"]
    from pyspark.sql import functions as F

    check = lambda e, d: d.select(payloads.shape_error(e, F.col("payload"), F.col("status"))).collect()[0][0]
    assert check("brave", df) is None and check("github", df) == "GitHub API: unexpected response shape"
    assert check("reddit", frame(spark, {}, 429)) == "Reddit API: HTTP 429" and check("brave", frame(spark, {}, 401)) == "Brave API: authentication failed (401)"
    assert payloads.request_size("reddit", 30) == 25 and payloads.request_size("ddg", 10) == 15
    assert payloads.uses_brave_api("auto", "k") and not payloads.uses_brave_api("scrape", "k")


DDG = """<div class="result"><h2 class="result__title"><a href="//duckduckgo.com/l/?uddg=https%3A%2F%2Fex.com%2F1">One <b>1</b></a></h2><a class="result__snippet">text &amp; more</a></div>
<div class="result result--ad"><a class="result__a" href="https://ad.com">Ad</a></div><div class="web-result"><a class="result__a" href="https://ex.com/2">Two</a></div>"""
GOOGLE = """<div id="search"><div class="g"><a href="https://ex.com/1"><h3>One</h3></a><div class="VwiC3b">note</div></div><div class="g" data-text-ad><a href="https://ad.com"><h3>Ad</h3></a></div>
<div class="g"><a href="https://ex.com/1"><h3>again</h3></a></div></div>"""
BRAVE = """<div data-type="web"><a href="https://ex.com/1"><div class="title">One</div></a><p>note</p></div><div id="summarizer"><div data-type="web"><a href="https://no.com"><h2>no</h2></a></div></div>"""


def test_search_pages(spark):
    read = lambda engine, page: [r[:2] for r in html.READERS[engine](html.parse(page)).rows]
    assert read("ddg", DDG) == [("One 1", "https://ex.com/1"), ("Two", "https://ex.com/2")]
    assert read("google", GOOGLE) == [("One", "https://ex.com/1")]
    assert read("google", "<a href='https://ex.com/3'><h3>Bare</h3></a>") == [("Bare", "https://ex.com/3")]
    assert read("brave", BRAVE) == [("One", "https://ex.com/1")]
    assert read("brave", "<main><li><a href='https://ex.com/9'>Link text</a><p>n</p></li><a href='https://search.brave.com/x'>own</a></main>") == [("Link text", "https://ex.com/9")]
    df = spark.createDataFrame([(1, "rust", DDG)], "query_id long, query string, html string")
    assert [r.snippet for r in html.from_search_pages(df, "ddg").orderBy("pos").collect()] == ["text & more", ""]
    assert html.challenge("ddg", "<p>Checking your browser</p>") and html.challenge("google", "<form id='captcha-form'></form>") and not html.challenge("ddg", DDG)


def test_extract():
    page = "<html><head><title> A  title </title></head><body><nav>menu</nav><main><header>head</header><h1>Big</h1><p>one<br>two</p><div class='my-sidebar'>no</div><p>three</p></main></body></html>"
    title, text, words = html.extract(page)
    assert (title, words) == ("A title", 4) and text.split() == ["Big", "one", "two", "three"] and "menu" not in text
    assert html.extract("<p>a<p>b") == ("", "a\n\nb", 2) and html.extract("") == ("", "", 0) and html.extract("<body>" + "x" * 99, 5)[1] == "xxxxx"


def test_references_without_semicolon():
    """A title that was cut within a reference stays as it is, as in SQL."""
    page = "<title>R&amp;D &copy &am</title><article><h1>R&amp;D &amp</h1><p>&amp;amp; &notit; &#65; &#66 a&b</p></article>"
    assert html.extract(page) == ("R&D &copy &am", "R&D &amp\n\n&amp; &notit; A &#66 a&b", 7)


def test_search_page_references_without_semicolon():
    box = "<li class='b_algo'><h2><a href='https://ex.com/?a=1&copy=2&amp;b=3'>x &amp</a></h2><div class='b_caption'><p>y &quot</p></div></li>"
    assert html.bing(html.parse(box)).rows == [("x &amp", "https://ex.com/?a=1&copy=2&b=3", "y &quot")]


def test_search_page_white_space():
    """No-break and other wide spaces stay, as in SQL."""
    import duckdb

    from fedrank.plans import oracle

    for text in ("\u00a0a\u00a0 b\t\n c\u2003", "x\x0by", " \u3000 z"):
        box = f"<li class='b_algo'><h2><a href='https://ex.com/'>{text}</a></h2><div class='b_caption'><p>{text}</p></div></li>"
        want = duckdb.execute(f"SELECT {oracle.FLAT('t')} FROM (SELECT ? AS t)", [text]).fetchone()[0]
        assert html.bing(html.parse(box)).rows == [(want, "https://ex.com/", want)]


def test_urls(spark):
    from pyspark.sql import functions as F

    from fedrank.functions import text, urls

    read = lambda c: spark.range(1).select(c).collect()[0][0]
    key = lambda u: read(urls.dedup_key(F.lit(u)))
    assert key("https://ex.com/a?q=a%20b") == key("https://ex.com/a?q=a+b&utm_source=x") == "https://ex.com/a?q=a+b"
    assert key("https://ex.com/?x&ref=1&y=é*") == "https://ex.com/?x=&y=%c3%a9*" and key("https://ex.com/?%72ef=1") == "https://ex.com"
    assert key("https://ex.com/?a=%zz") == "https://ex.com/?a=%25zz"
    link = "https://www.bing.com/ck/a?u=a1" + base64.urlsafe_b64encode("https://example.com/café".encode()).decode().rstrip("=")
    assert read(urls.unwrap_bing(F.lit(link))) == html.unwrap_bing(link) == "https://example.com/cafÃ©"
    assert read(text.decode_entities(F.lit("a&#x200b;b &AMP;lt;"))) == "ab <"
