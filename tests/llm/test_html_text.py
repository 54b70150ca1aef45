import pytest

from ordermill.llm import html_text


@pytest.fixture
def pages(spark):
    return lambda rows: spark.createDataFrame(
        [(i, u, h, "p", 1) for i, (u, h) in enumerate(rows)], "page_id bigint, url string, html string, path string, row int"
    ).repartition(3)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy</div>
<div class="cookie-notice">We use cookies</div><article><h1>Head &amp; more</h1><p>One  <b>two</b>
three<br>four<p>Five &lt;6&gt; &eacute;&#233;<ul><li>x<li>y</ul><form>Name <input></form><div class="comments"><p>Nice</p></div></article>
<aside>Side</aside><footer>&copy; site</footer></body></html>"""


def texts(result):
    return {r.page_id: r.text for r in result.collect()}


def test_main_text_of_one_page(pages):
    row = html_text.main_texts(pages([("http://a.example/x", PAGE)])).first()
    assert row.text == "Head & more\nOne two three four\nFive <6> éé\nx\ny"
    assert row.n_chars == len(row.text) and row.url == "http://a.example/x"


def test_low_importance_nodes_go(pages):
    """Nodes without a telling name: what recurs over the host's pages goes, the rest stays."""
    rows = [
        (f"http://h{i % 2}.example/{i}", f"<body><div class=top>Welcome back</div><div class=x><p>Own text {i}</p><p>More {i * 7}</p></div><div class=low>Legal</div>")
        for i in range(40)
    ]
    got = texts(html_text.main_texts(pages(rows)))
    assert got == {i: f"Own text {i}\nMore {i * 7}" for i in range(40)}
    few = texts(html_text.main_texts(pages(rows[:2])))
    assert few[0] == "Welcome back\nOwn text 0\nMore 0\nLegal"


def test_copies_of_an_article_keep_it(pages):
    rows = [("http://a.example/x", PAGE)] * 30
    assert set(texts(html_text.main_texts(pages(rows))).values()) == {"Head & more\nOne two three four\nFive <6> éé\nx\ny"}


def numbered(i, words=3):
    return " ".join(f"w{i * 31 + k}" for k in range(words))


def test_odd_pages(pages):
    odd = [
        (None, None), ("http://a.example", ""), (None, "plain text"), ("u", "<article><p>cut off &am"), ("u", "<p><b>a<br><p>b</b>c</p>"),
        ("u", "<article><script>never closed <p>x"), ("u", "</div></p>x<unknown>y</unknown>"), ("u", "<nav>only</nav>"),
        ("u", "<article>" + "<p>long words</p>" * 50_000 + "</article>"), ("u", "a < b <3 && <!-- open"),
    ]
    got = texts(html_text.main_texts(pages(odd)))
    assert len(got) == len(odd)
    assert got[0] == got[1] == got[5] == got[7] == ""
    assert got[2] == "plain text" and got[3] == "cut off &am" and got[4] == "a\nbc" and got[6] == "xy"
    assert got[8] == "\n".join(["long words"] * 50_000)
    assert html_text.main_texts(pages([])).collect() == []


def numbered(i, words=3):
    return " ".join(f"w{i * 31 + k}" for k in range(words))


SIZES = [1, 3, 4, 200]


def test_lines_that_recur_in_articles_stay(pages):
    shared = "<h2>Ingredients</h2><p>The same long paragraph of every edition, word by word.</p><ul><li>Salt<li>Pepper</ul>"
    shared_text = "Ingredients\nThe same long paragraph of every edition, word by word.\nSalt\nPepper"
    rows, expected = [], []
    for k, (opened, closed) in enumerate([("<article>", "</article>"), ("<div class=c7>", "</div>"), ("<div><section>", "</section></div>")]):
        for size in SIZES:
            for i in range(size):
                rows.append((f"http://a{k}-{size}.example/x", f"<nav>Menu</nav>{opened}{shared}<p>Edition {i}</p>{closed}<footer>Imprint</footer>"))
                expected.append(f"{shared_text}\nEdition {i}")
    assert texts(html_text.main_texts(pages(rows))) == dict(enumerate(expected))


def test_comments_and_sidebars_go_at_any_size(pages):
    """Their texts are their own on each page, and their structure varies."""
    rows, expected = [], []
    for size in SIZES:
        for i in range(size):
            own = f"<p>{numbered(i * 3)}</p>" if i % 2 else f"<ul><li>{numbered(i * 3)}</ul><p>x{i}</p>"
            rows.append((f"http://a{size}.example/x", f"<article><p>Text {i}</p><div class='comments'>{own}</div></article><aside>{own}</aside><div class=widget>{own}</div>"))
            expected.append(f"Text {i}")
    assert texts(html_text.main_texts(pages(rows))) == dict(enumerate(expected))


def unnamed(i, host="h"):
    adverts = ["Buy two for one", "Now even cheaper", "The best of all"]
    return (
        f"http://{host}.example/{i}",
        f"<div><div><ul><li>Home<li>News<li>About</ul></div><div>{adverts[i % 3]}</div>"
        f"<div><h1>Title {i}</h1><p>{numbered(i, 9)}</p><p>As ever.</p><blockquote>{numbered(i + 500, 4)}</blockquote></div>"
        "<div><p>All rights reserved by the very long name of the publisher of this site</p></div></div>",
    )


def article(i):
    return f"Title {i}\n{numbered(i, 9)}\nAs ever.\n{numbered(i + 500, 4)}"


def test_trees_alone_find_the_article(pages):
    """No name, no class: menus, adverts and notices recur, articles do not."""
    rows = [unnamed(i) for i in range(200)] + [unnamed(i, "small") for i in range(12)]
    got = texts(html_text.main_texts(pages(rows)))
    assert got == {i: article(i) for i in range(200)} | {200 + i: article(i) for i in range(12)}


def test_near_copies_of_an_article_count_once(pages):
    """A third of the host's pages holds one article, with a line of its own on some."""
    rows = [unnamed(i) for i in range(40)]
    body = "<div><p>One long article that many pages of the host show again and again in full.</p><p>Its second paragraph.</p>{}</div>"
    rows += [("http://h.example/c", "<div><div><ul><li>Home<li>News<li>About</ul></div>" + body.format(f"<p>Seen {i}</p>" if i % 2 else "") + "</div>") for i in range(20)]
    got = texts(html_text.main_texts(pages(rows)))
    long = "One long article that many pages of the host show again and again in full.\nIts second paragraph."
    assert got == {i: article(i) for i in range(40)} | {40 + i: long + (f"\nSeen {i}" if i % 2 else "") for i in range(20)}


def test_parts_of_an_article_stay(pages):
    """Paragraphs in elements of their own: those that recur stay beside those that do not, or inside an article's text."""
    rows = [
        ("http://a.example/x", f"<div class=menu1><ul><li>Home</ul></div><div class=c><div class=p>{numbered(i)}</div><div class=p>Shared part</div><div class=p>{numbered(i + 90)}</div></div>")
        for i in range(30)
    ] + [
        ("http://b.example/x", f"<div class=menu1><ul><li>Home</ul></div><div class=c><p>{numbered(i, 8)}</p><div class=box>A box that recurs</div></div>")
        for i in range(30)
    ]
    got = texts(html_text.main_texts(pages(rows)))
    for i in range(30):
        assert got[i] == f"{numbered(i)}\nShared part\n{numbered(i + 90)}"
        assert got[30 + i] == f"{numbered(i, 8)}\nA box that recurs"


def test_importance_equals_brute_force(pages):
    import math
    from collections import defaultdict

    rows = [unnamed(i, f"h{i % 2}") for i in range(30)] + [("http://h0.example/v", f"<div><p>Text {i % 4}</p>{'<p>More</p><ul><li>x</ul>' * (i % 3)}</div>") for i in range(20)]
    seen = {}
    for url, html in sorted(rows):
        host = url.split("/")[2].encode()
        copy, found, styles, _, _ = html_text.parsed_page(host, html)
        seen.setdefault(copy, []).append((found, styles))
    given = html_text._given(pages(rows))
    got = {r.key: (r.holders, round(r.importance, 9)) for r in html_text.judged_texts(html_text.once(given)).collect()}
    # Copies here have the same text, but may differ in style: any of them may stand for all.
    first = {r.copy: r for r in given.groupBy("copy").agg(html_text.F.min_by(html_text.F.struct("texts", "styles"), "page").alias("f")).collect()}
    assert set(first) == set(seen)
    holders, styles = defaultdict(int), defaultdict(lambda: defaultdict(int))
    pages_of = defaultdict(int)
    node_of = {}
    for row in first.values():
        for text in row.f.texts:
            holders[text.key] += 1
            node_of[text.key] = text.node
        for node in {s.node for s in row.f.styles}:
            pages_of[node] += 1
        for s in row.f.styles:
            styles[s.node][s.style] += 1
    expected = {}
    for key, n in holders.items():
        node = node_of[key]
        if n < 2:
            continue
        total = sum(styles[node].values())
        entropy = -sum(c / total * math.log(c / total) for c in styles[node].values()) / math.log(total)
        content = 1 - math.log(n) / math.log(pages_of[node] + html_text.SMOOTHING)
        expected[key] = (n, round(content * (1 - html_text.STYLE_SHARE * (1 - entropy)), 9))
    assert got == expected and len(got) > 10


def test_verdicts_count_blocks(pages):
    rows = [(f"http://a.example/{i}", f"<nav>Menu</nav><article><p>Text {i}</p></article><div>Legal</div><div>Own {i}</div>") for i in range(20)]
    got = {(r.role, r.important): r.blocks for r in html_text.verdicts(pages(rows)).collect()}
    assert got == {(html_text.DROP, False): 20, (html_text.KEEP, True): 20, (html_text.OPEN, False): 20, (html_text.OPEN, True): 20}


def test_deep_pages(pages):
    opened = ["<div class='post-body'>x", "<b>x", "<b><p>x", "</q><i>x", "<section><article>x"]
    got = texts(html_text.main_texts(pages([("http://a.example", start * 100_000) for start in opened])))
    assert {text.replace("\n", "") for text in got.values()} == {"x" * 100_000}


def test_a_word_drops_no_article(pages):
    around = [
        ("<body class='single has-sidebar'><article>", "</article></body>"), ("<div id='page' class='no-ads'>", "</div>"),
        ("<article class='post comments-open'>", "</article>"), ("<main class='related-layout'>", "</main>"),
        ("<body class='sidebar'><main class=widget>", "</main></body>"), ("<div class=sidebar><article>", "</article></div>"),
        ("<form id=aspnetForm><article>", "</article></form>"), ("<header><main>", "</main></header>"),
    ]
    rows = [(f"http://a{i}.example", f"{opened}<p>Own text</p>{closed}") for i, (opened, closed) in enumerate(around)]
    assert texts(html_text.main_texts(pages(rows))) == {i: "Own text" for i in range(len(rows))}


def test_articles_in_furniture_of_an_article_go(pages):
    html = "<article><p>Text</p><div class=comments><article class=comment>Nice</article></div></article><aside><article>Card</article></aside>"
    assert html_text.main_texts(pages([("http://a.example", html)])).first().text == "Text"


def test_copies_of_a_page_count_once(pages):
    copy = "<div class=content><p>Copied</p></div>"
    rows = [("http://a.example/c", f"<div class=ad>Ad {i}</div>{copy}") for i in range(70)]
    rows += [("http://a.example/o", f"<div class=content><p>{numbered(i)}</p></div>") for i in range(30)]
    rows += [
        ("http://b.example/o", "<div class=content>" + "".join(f"<p>{numbered(i * 10 + k)}</p>" for k in range(10)) + "<p>Sign in to reply</p></div>")
        for i in range(30)
    ]
    got = texts(html_text.main_texts(pages(rows)))
    assert {got[i] for i in range(70)} == {"Copied"}
    for i in range(30):
        assert got[70 + i] == numbered(i)
        assert got[100 + i] == "\n".join([*(numbered(i * 10 + k) for k in range(10)), "Sign in to reply"])
