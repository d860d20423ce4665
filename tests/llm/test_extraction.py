import html
import re
from collections import Counter

from clientlens.llm import extraction

PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>if (a<b) "</p>"</script></head><body>
<header class="site"><h1>Site</h1></header><nav><ul><li><a href="/">Home</a><li><a href='/x>y'>More</a></ul></nav>
<div class="cookie-notice">We use cookies</div><div class="ad">Buy now</div><!-- note <p>hidden</p> -->
<article class="post-%d"><h1>Title &amp; more</h1><p>First   <b>bold</b>
line &lt;tag&gt; &eacute;&#233;&nbsp;end<p>Second<br>part %d <a href="#">link</a></p><form><button>Send</button></form>
<div class="related">See also</div><noscript>no</noscript></article>
<aside>Side</aside><div id="comments"><p>Nice!</p></div><footer>&copy; us</footer></body></html>"""
TEXT = "Title & more\nFirst bold line <tag> éé end\nSecond part %d link"


def test_article_among_other_parts(spark):
    pages = spark.createDataFrame([(i, f"https://user@Example.com:80/{i}", PAGE % (i, i), "t") for i in range(8)],
                                  "page_id long, url string, html string, text string")
    for r in extraction.extract(pages).collect():
        assert r.text == TEXT % r.page_id and r.n_chars == len(r.text)
    classes = extraction.templates(pages).where("host = 'example.com'").collect()
    of = {r.path: r for r in classes}
    article = of["html/body/article.post-9"]
    assert article.pages == 8 and article.role == extraction.MAIN
    # Tokens that every page has once are one class; the two paragraphs are another, nested in it.
    assert article["class"] == of["html/body"]["class"] != of["html/body/article.post-9/p"]["class"]
    assert of["html/body/article.post-9/p"].parent == article["class"]


def test_pages_without_article_elements_keep_dense_slots(spark):
    page = "<html><body><div class='links'>{}</div><div class='body'><p>{}</p></div></body></html>"
    links = "".join(f"<a href='/{i}'>go to {i}</a> " for i in range(9))
    pages = spark.createDataFrame([(i, "http://h/", page.format(links, f"words of page {i} " * 9)) for i in range(5)],
                                  "page_id long, url string, html string")
    assert {r.text for r in extraction.extract(pages).collect()} == {(f"words of page {i} " * 9).strip() for i in range(5)}


def test_pages_of_the_table(spark, sf_dir):
    from clientlens.llm.queries import op3

    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    found = op3(spark, sf_dir).collect()
    assert len(found) == len(pages)
    for r in found:
        inner = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id].html, re.S).group(1)
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner))
        assert r.text == "\n".join(p for p in parts if p) and r.url == pages[r.page_id].url


def test_odd_pages(spark):
    odd = [None, "", "   ", "no markup at all", "<", "<p", "a < b & c", "<article><p>open", "<!-- open <p>x", "<script>var x",
           "<article><p>" + "long words " * 50000, "<article><p>a</article></div></p>b", '<p title="a>b">quoted</p>', "<p title='open>text"]
    rows = [(i, None if i % 3 else f"http://host{i}/", p) for i, p in enumerate(odd)] + [(None, None, None), (3, None, odd[3])]
    found = extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(found) == len(rows) and all(r.n_chars == len(r.text) for r in found)
    by = {r.page_id: r.text for r in found}
    assert by[0] == by[1] == by[2] == by[8] == by[9] == by[None] == ""
    assert by[7] == "open" and by[10] == ("long words " * 50000).strip()
    assert extraction.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_names_of_wrappers_and_parts_of_names_lose_no_article(spark):
    bodies = ('<body class="has-sidebar"><article>{}</article>', '<body class="sidebar"><div class="no-sidebar"><article>{}</article></div>',
              '<body><article class="post share">{}</article>', '<body class="comments-open"><div class="share"><main id="nav">{}</main></div>',
              '<body><div class="comments-open">{}</div>', '<body><article>{}<div class="share-buttons"><p>Share this</p></div></article>')
    rows = [(10 * i + j, f"http://host{i}/", f"<html>{body.format(f'<p>Words of page {j}</p>')}<aside>x</aside></body></html>")
            for i, body in enumerate(bodies) for j in range(4)]
    found = extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in found} == {key: f"Words of page {key % 10}" for key, _, _ in rows}


def test_every_page_is_read_by_its_own_layout(spark):
    layouts = "<article><p>One {}</p></article><div>Below</div>", "<div class='content'><p>Two {}</p></div>"
    for host in ("http://mixed/", None):  # pages without a url have one host
        rows = [(i, host, f"<html><body>{layouts[i % 2].format(i)}</body></html>") for i in range(10)]
        found = extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
        assert {r.page_id: r.text for r in found} == {i: f"{('One', 'Two')[i % 2]} {i}" for i in range(10)}


def test_text_that_most_pages_repeat_is_template(spark):
    def own(i, j):
        return " ".join(f"word{i * j % 7} the {i}x{k * j} of" for k in range(20))

    notice = "We may earn a fee if you buy by the links on this page, at no cost to you."
    layouts = {"a": "<article><p>{0}</p><div><p>Written by {1} on day {1} for the readers of this paper</p></div><p>" + notice + "</p><p>{2}</p></article>",
               "b": "<div class='x1'><p>" + notice + "</p></div><div class='x2'><p>{0}</p><p>{2}</p></div>"}
    rows = [(100 * (h == "b") + i, f"http://{h}/{i}", "<html><body>" + layout.format(own(i, 1), i, own(i, 3)) + "</body></html>")
            for h, layout in layouts.items() for i in range(12)]
    rows += [(200 + i, "http://copies/", "<article><p>The same text on all of the pages</p></article>") for i in range(9)]
    found = extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    for r in found:
        i = r.page_id % 100
        assert r.text == ("The same text on all of the pages" if r.page_id >= 200 else f"{own(i, 1)}\n{own(i, 3)}")


def _parts(spark, parts):
    """Pages (host, text of html) of several partitions, in this order."""
    rows = [(1000 * at + i, f"http://{host}/{i}", page) for at, part in enumerate(parts) for i, (host, page) in enumerate(part)]
    bounds = [0]
    for part in parts:
        bounds.append(bounds[-1] + len(part))
    data = spark.sparkContext.parallelize(list(zip(bounds, bounds[1:])), len(parts)).flatMap(lambda b: rows[b[0]:b[1]])
    return spark.createDataFrame(data, "page_id long, url string, html string"), rows


def _shared(rows):
    """Tokens on half of the pages of their host, and on how many, by a plain count."""
    words, paths = Counter(), Counter()
    for _, url, page in rows:
        host, found = extraction.host_of(url), list(extraction.blocks(page))
        paths.update({(host, path) for path, _, _ in found})
        words.update({(host, int(t)) for t in extraction.word_tokens([(p, x) for p, x, _ in found if x])[0]})
    most = Counter()
    for (host, _), n in paths.items():
        most[host] = max(most[host], n)
    return {(*key, n) for key, n in words.items() if most[key[0]] >= extraction.LEAST_PAGES and n >= extraction.MOST * most[key[0]]}


def test_words_that_some_or_all_parts_leave_out_are_counted_whole(spark):
    # "seldom" is on 18 of 24 pages in three parts and on one in the fourth: 55 of 96. "own" words are on one page each.
    often = [[("a", f"<html><p>every page has this {'seldom' if i < (18 if at < 3 else 1) else 'not'} own{at}x{i}</p></html>")
              for i in range(24)] for at in range(4)]
    # Each part has its own layout of 40 pages; the paragraph is on 4 pages of each part only, which is half of 40 in all.
    mixed = [[("b", f"<h{at}>title</h{at}>" + "<p>we use cookies here</p>" * (i < 4)) for i in range(40)] for at in range(1, 7)]
    few = [[("c", f"<p>short {i % 2}</p>") for i in range(n)] for n in (1, 9, 1)]
    pages, rows = _parts(spark, often + mixed + few)
    tokens = extraction._tokens(pages).cache()
    got = {(r.host, r.token, r.pages) for r in extraction.shared_words(pages, tokens).collect()}
    assert got == _shared(rows) and {n for host, _, n in got if host == "a"} >= {96, 55} and {n for host, _, n in got if host == "b"} >= {24}
    # The vectors are whole too: words of the same pages have the same.
    together = {(r.host, r.pages, r.vector) for r in extraction.shared_words(pages, tokens).where("host = 'b' AND pages = 24").collect()}
    assert len(together) == 1


def test_words_on_few_pages_are_not_sent(spark):
    """They took most of the shuffle: a word on one or two pages of a host with many pages is no template text."""
    page = "<html><p>every page has this</p><p>{}</p></html>"
    pages, _ = _parts(spark, [[("a", page.format(" ".join(f"w{(i + k) // 2}x{k}" for k in range(50)))) for i in range(60)]])
    words = extraction._tokens(pages).where("path IS NULL AND token IS NOT NULL")
    assert words.count() == 4
