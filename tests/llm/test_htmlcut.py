import random
from itertools import product

import pytest
from kbforge.functions.storage import read_table
from kbforge.llm import htmlcut

START = list(htmlcut.START)
ART = (
    "<h1>Title of the piece</h1><p>First para &amp; more text, with words and a full stop.</p><p>Short.</p><ul><li>Item one</li><li>Item <b>two</b> is here</li></ul>"
    "<blockquote>Quoted words of\n   somebody.</blockquote><table><tr><td>a<td>b</table><p>Last para with <a href=x>a link</a> in it,<br>and then some more words to close."
)
WANT = "Title of the piece\nFirst para & more text, with words and a full stop.\nShort.\nItem one\nItem two is here\nQuoted words of somebody.\na\nb\nLast para with a link in it, and then some more words to close."
MORE = "<p>More words to read here, in other places. Yes, many.</p>"
PAGES = {
    "named parts": f"<html><head><title>T</title></head><body><header><h2>Site name</h2></header><nav><a>x</a></nav><main><article>{ART}</article><aside>{MORE}</aside></main><footer>foot</footer></body></html>",
    "classes": f'<div id="header">My site</div><div class="menu"><a>One</a> <a>Two</a></div><div class="content">{ART}</div><div class="sidebar"><h3>Recent</h3>{MORE}</div><div id="comments"><h3>3 comments</h3>{MORE}<form><label>Name</label><input><textarea>x</textarea><button>Send</button></form></div><div id=footer>© 2020</div>',
    "many comments": f'<body><article class="post"><header class="entry-header"></header>{ART}<div class="notice">{MORE}</div><section class="comments"><article class="comment">{MORE * 40}</article><article>{MORE * 9}</article></section></article></body>',
    "no names": f"<body><ul><li><a href=1>Home</a></li><li><a href=2>About us</a></li><li><a href=3>Contact</a></li></ul><div>{ART}</div><div>© 2021 Somebody</div></body>",
    "roles": f'<body class="has-sidebar"><div class="cookieNotice">{MORE}</div><div role="main">{ART}</div><div role="contentinfo">Foot words.</div></body>',
    "a form around": f'<body><form id="f"><div class="nav">x y</div><div id="main">{ART}</div></form></body>',
    "a class around": f'<body><div class="page-with-sidebar"><div class="primary">{ART}</div><div class="sidebar">{MORE}</div></div></body>',
    "advert inside": f"<article>{ART.replace('<p>Short.', '<p>Short.<div class=advert>' + MORE + '</div><aside>' + MORE + '</aside>')}</article><script>if (a < b) '</p>'</script><style>p{{}}</style><noscript>Enable</noscript>",
    "hidden": f'<body><p hidden>secret</p><div style="display: none">{MORE}<div>deep</div></div>{ART}<template>{MORE}</template><select><option>o</select></body>',
    "cut short": f"<body><nav><a>x</a></nav><article>{ART}",
}


@pytest.mark.parametrize("name", PAGES)
def test_layouts(name):
    assert htmlcut.text_of(PAGES[name], START) == WANT


def test_odd_pages():
    cases = {
        None: "", "": "", "   ": "", "plain text": "plain text", "<p>a<p>b": "a\nb", "<!-- x": "", "a&nbsp;&nbsp;b &lt;c&gt;<br>d &am": "a b <c> d &am", "x<script>never": "x", "<div>" * 20_000 + "x": "x",
        "<b>" * 20_000 + "<p>x": "x", "</p></div></b>x": "x", "1 < 2 > 1 <3": "1 < 2 > 1 <3", "<p title='a>b'>x</p>": "x", "fo<b>o</b>b<i>ar": "foobar", "a<b": "a", "<P>UP</P><BR/>down": "UP\ndown",
    }
    for html, want in cases.items():
        assert htmlcut.text_of(html, START) == want, html


def test_a_very_long_page():
    page = "<body>" + "<p>hi there <a>x</a></p><div class=ad>ad</div>" * 20_000
    assert htmlcut.text_of(page, START) == "\n".join(["hi there x"] * 20_000)


def test_the_cut_against_all_labellings():
    rnd = random.Random(3)
    for _ in range(400):
        n = rnd.randrange(1, 10)
        excess = [rnd.randrange(-20, 21) * rnd.randrange(2) for _ in range(n)]
        edges = [(rnd.randrange(n), rnd.randrange(n), rnd.randrange(12)) for _ in range(rnd.randrange(2 * n + 1))]

        def cost(kept):
            return sum(abs(x) for x, k in zip(excess, kept) if (x > 0) != k and x) + sum(w for a, b, w in edges if kept[a] != kept[b])

        ways = list(product([False, True], repeat=n))
        least = min(map(cost, ways))
        got = htmlcut.minimum_cut(excess, edges)
        assert cost(got) == least
        assert sum(got) == max(sum(w) for w in ways if cost(w) == least)


def test_the_model_is_fitted_on_a_bounded_sample(spark, monkeypatch):
    pages = read_table(spark, "/root/testdata/sf0.001", "pages")
    weights = htmlcut.fit(pages)
    assert weights != START and weights[2] < -1 < 0 < weights[1]
    assert htmlcut.fit(pages.limit(0)) == START
    monkeypatch.setattr(htmlcut, "SAMPLE_BLOCKS", 50)
    seen = []
    monkeypatch.setattr(htmlcut, "fitted", lambda x, y: seen.append(len(y)) or START)
    htmlcut.fit(pages.union(pages))
    assert seen == [50]


def test_the_query_on_odd_rows(spark):
    rows = [(k if k else None, "u", html, "x") for k, html in enumerate(PAGES.values())] + [(50, None, None, "x"), (50, None, None, "x"), (51, "v", "", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(3)
    got = sorted((tuple(r) for r in htmlcut.main_text(pages).collect()), key=str)
    want = [(i, u, WANT if h else "", len(WANT) if h else 0) for i, u, h, _ in rows]
    assert got == sorted(want, key=str)
    assert htmlcut.main_text(pages.limit(0)).count() == 0
