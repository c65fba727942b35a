import itertools
import random

from sessionlogs.llm import html_text

PAGE = """<!DOCTYPE html><html><head><title>Title</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy <b>now</b></div>
<div class="cookie-notice">We use cookies here</div>
<article><h1>Head &amp; more</h1><p><b>One</b> two&nbsp;three &lt;x&gt;<br><p>Four
 five.</p><aside>Side</aside><div class="adBox">ad text</div><ul><li>a</li><li>b</li></ul><p>End.</p>
<section id="comments"><p>great post</p></section></article>
<form><p>Mail</p></form><footer>&copy; foot</footer></body></html>"""
TEXT = "Head & more\nOne two three <x>\nFour five.\na\nb\nEnd."


def test_main_text():
    learned = html_text.weigh(html_text.tally(html_text.tokens(PAGE)))
    for weights in (learned, html_text.weigh({})):
        assert html_text.extract(PAGE, weights) == TEXT


def test_unmarked_pages_use_learned_weights():
    page = PAGE.replace("<article>", '<div class="story">').replace("</article>", "</div>")
    learned = html_text.weigh(html_text.tally(html_text.tokens(PAGE)))
    assert html_text.extract(page, learned) == TEXT


def test_odd_markup():
    w = html_text.weigh({})
    cases = {
        None: "", "": "", "  \n ": "", "plain  text": "plain text", "<p>a<p>b": "a\nb", "a < b & c": "a < b & c", "<!-- x": "", "<script>x": "",
        "<div class=ad>open<p>text": "text", '<p title="a > b">x</p>': "x", "<p>a<b>b</b>c</p>": "abc", "<p>&#x41;&#66;</p>": "AB", "<a": "<a", "<p hidden>h</p><p>v</p>": "v",
    }
    for page, text in cases.items():
        assert html_text.extract(page, w) == text, page


def test_names_with_such_words_do_not_drop_the_article():
    w = html_text.weigh({})
    body = "<p>" + "the story goes on " * 30 + "</p>"
    story = ("the story goes on " * 30).strip()
    for name in ("content has-sidebar", "post category-social tag-search", "no-footer", "entry-content with-ads"):
        assert html_text.extract(f'<p>x</p><p>{"y " * 99}</p><div class="{name}">{body}</div>', w).endswith(story), name
    assert html_text.extract(f'<section class="legal">{body}</section>', w) == story
    assert html_text.extract(f'<form id="aspnet">{body}</form>', w) == story
    assert html_text.extract(f'<div class="article-header"><h1>Head of the story</h1></div>{body}', w) == f"Head of the story\n{story}"
    for name in ("sidebar", "site-footer", "widget-area", "adBox", "main-nav", "post-comments"):
        assert html_text.extract(f'<div class="{name}"><p>no</p></div>{body}', w) == story, name
    for tag in ("button", "select", "svg", "object", "template"):
        assert html_text.extract(f"<p>a<{tag}>x{body}", w) == f"a\n{story}", tag
        assert html_text.extract(f"<p>a <{tag}><b>x</b><option>y</{tag}> b</p>", w) == "a b", tag
    assert html_text.extract(f"<select><option>x<option>y{body}", w) == story


def test_best_run_equals_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        s = [rng.choice([-3, -2, -1, -0.5, 0, 1, 2]) for _ in range(rng.randint(0, 12))]
        start, end = html_text.best_run(s)
        best = max((sum(s[a:b]) for a, b in itertools.combinations(range(len(s) + 1), 2)), default=0)
        assert sum(s[start:end]) == max(0, best)


def test_long_pages_take_linear_time():
    page = "<p>" + "<a 'x " * 60_000 + "</p>" + '<p>word "' * 60_000
    assert html_text.extract(page, html_text.weigh({})).count("word") == 60_000


def test_tables(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "", ""), (3, "x", "<p>hi")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'clash' AS text", "1 AS extra")
    weights = html_text.fit(df)
    got = sorted((r.page_id or 0, r.text, r.extra) for r in html_text.add_text(df, weights).collect())
    assert got == sorted([(1, TEXT, 1), (1, TEXT, 1), (2, "", 1), (0, "", 1), (3, "hi", 1)])
    empty = df.limit(0)
    assert html_text.add_text(empty, html_text.fit(empty)).count() == 0
