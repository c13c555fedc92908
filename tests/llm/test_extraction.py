import html
import math
import random
import re
import time

from mergetide.llm import extraction as X

from .conftest import DATA


def text(source):
    return X.Page(source).text()


def test_article_alone():
    page = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a="</p>";</script></head><body><header><h1>Site</h1></header>
    <nav><ul><li><a href="/x">menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div><!-- <p>no</p> -->
    <main><article><header><h1>The&nbsp;Title</h1></header><p>One <b>bold</b>
      word &lt;x&gt; &#233;<br>next<p>Two<aside>side</aside><form><input>f</form><div class="ad">buy</div><ul><li>a<li>b</ul>
    <section id="comments"><p>first!</p></section><footer>by me</footer></article></main><div id="sidebar">links</div><footer>&copy; x</footer></body></html>"""
    assert text(page) == "The Title\n\nOne bold word <x> é next\n\nTwo\n\na\n\nb"


def test_without_article():
    assert text("<body><div class='nav-menu'>m</div><p>A<p>B <span class=ad>no <i>x</i></span> c<div hidden>h</div></body>") == "A\n\nB c"
    assert text("plain &amp; simple") == "plain & simple" and text("") == "" and text("<p>1 < 2 and 3 > 2") == "1 < 2 and 3 > 2"


def test_broken_markup():
    assert text("<article><p>cut off &am") == "cut off &am" and text("<article><p>a</div>b</article>c") == "a\n\nb"
    assert text('<p title="a>b">x</p><p title="open>y') in ("x\n\ny", "x") and text("<script>never ends") == "" and text("a<!-- never ends") == "a"
    assert text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"


def test_pages_of_the_tables(spark):
    """The tables' pages, whose articles a few patterns find as well."""
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    rows = X.extract(pages).collect()
    assert len(rows) == len(source)
    for r in rows:
        body = re.search(r"<article>(.*?)(</article>|<footer>|$)", source[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub("</?b>", "", x))).split()) for x in re.split("</?(?:p|h1)>", body)]
        assert r.text == "\n\n".join(x for x in blocks if x) and r.n_chars == len(r.text)


def test_style_tree_cuts_the_sites_own_branches(spark):
    """Boxes without telling names: the same on all pages of a host, so they go; the prose stays, also where it repeats."""
    page = lambda i: f"<body><div class=q><p>Weather today</p><p>Call us</p></div><div class=z><p>Story {i} begins {i * i}.</p><p>It ends {i}.</p></div></body>"
    rows = [(i, f"http://one.example/{i}", page(i)) for i in range(30)] + [(100, "http://two.example/", page(1))]
    rows += [(200 + i, f"http://three.example/{i}", f"<article><p>All the same story</p></article><p>x{i % 2}</p>") for i in range(30)]
    got = {r.page_id: r.text for r in X.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Story {i} begins {i * i}.\n\nIt ends {i}." for i in range(30))
    assert got[100].startswith("Weather today") and all(got[200 + i] == "All the same story" for i in range(30))


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "http://h/", ""), (3, "nonsense", "<p>x</p>"), (None, "http://h/", "<p>y</p>"), (4, "http://h/", "<p>z</p>"), (4, "http://h/", "<p>z</p>")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = sorted((str(r.page_id), r.text, r.n_chars) for r in X.extract(df).collect())
    assert got == [("1", "", 0), ("2", "", 0), ("3", "x", 1), ("4", "z", 1), ("4", "z", 1), ("None", "y", 1)]
    assert X.extract(df.limit(0)).count() == 0


def test_marks_of_teasers_drop_no_text():
    """Only cards are marked: the story beside them stays.  A mark of the larger part still stands alone."""
    story = "This is the story itself, told at length in a plain box without a mark."
    page = f"<body><div class=z><p>{story}</p></div><article><p>Card one</p></article><article><p>Card two</p></article></body>"
    assert text(page) == f"{story}\n\nCard one\n\nCard two"
    assert text(f"<body><article><p>{story}</p></article><div class=z>also here</div></body>") == story


def test_style_tree_cuts_inside_articles(spark):
    """The same paragraph in every article of a host goes; an article that pages repeat with little of their own stays."""
    call = "Read more on our site"
    page = lambda i: f"<article><h1>Title {i}</h1><p>Story {i} begins {i * i}, goes on and ends.</p><p>{call}</p></article>"
    rows = [(i, f"http://one.example/{i}", page(i)) for i in range(30)] + [(100 + i, f"http://few.example/{i}", page(i)) for i in range(9)]
    rows += [(200 + i, f"http://same.example/{i}", f"<article><p>All the same story</p><p>and its end</p><p>{i}</p></article>") for i in range(30)]
    got = {r.page_id: r.text for r in X.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Title {i}\n\nStory {i} begins {i * i}, goes on and ends." for i in range(30))
    assert all(got[100 + i].endswith(call) for i in range(9)) and all(got[200 + i] == f"All the same story\n\nand its end\n\n{i}" for i in range(30))


def test_names_cut_no_page_empty():
    """Wrappers whose names hold a word of furniture: on a box around the article, on the article, around its text, and without an article."""
    story, ad = "This is the story itself, told at length.", '<div class="ad">Buy</div><div class="sidebar-left">links</div>'
    for name in ("no-sidebar", "has-sidebar", "comments-closed", "page-header-wrap", "content-widget"):
        for page in ("<div class='{0}'>{2}<article><p>{1}</p></article></div>", "{2}<article class='{0}'><p>{1}</p></article>", "<article><h1>T</h1><div id='{0}'><p>{1}</p></div></article>{2}", "<div class='{0}'><p>{1}</p>{2}</div>"):
            assert text(f"<body>{page.format(name, story, ad)}</body>") in (story, f"T\n\n{story}"), (name, page)
    assert text(f"<div class='widget'><p>{story}</p></div>") == story and text(f"<div class='widget'><article>{story}</article></div>") == story
    cards = "<div class='related'><article>A card</article></div><section id='comments'><article class='comment'>Nice</article></section>"
    assert text(f"<body><div class='no-sidebar'><p>{story}</p></div>{cards}</body>") == story
    assert text(f"<article>Short</article><div class='ad'>{story}</div>") == "Short"


def test_furniture_alone_and_inline_parts():
    assert text("<body><nav>Home</nav><div class='cookie-notice'>We use cookies</div><footer>Imprint</footer></body>") == "" and text("<div class='sidebar'>Weather today</div>") == ""
    assert text("<p>One <label>two</label> three</p>") == "One two three" and text("<p>One <span class='ad'>buy</span> three</p>") == "One three"
    assert text("<p><span class='ad'>buy</span>One</p><p>Two</p>") == "One\n\nTwo"
    assert text("<div id='page' class='site no-sidebar'><main><p>Short</p></main></div>") == "Short" and text("<article class='legal-news'><p>Short</p></article>") == "Short"


def test_deep_pages_take_linear_time():
    for source in ("<div>" * 100_000 + "deep" + "</div>" * 100_000, "<div>" * 100_000 + "deep", "<ul><li>" * 50_000 + "deep", "<b class='ad-x'>" * 20_000 + "x" + "</b>" * 20_000 + "deep"):
        began = time.process_time()
        assert text(source).endswith("deep")
        assert time.process_time() - began < 30


def test_style_tree_by_brute_force(spark):
    """The importance of every branch of a host, from nested dictionaries in memory."""
    rng = random.Random(4)
    pages = [f"<body><div class=q><p>Weather</p><p>Call {rng.randint(0, 1)}</p></div><div class=z>" + "".join(f"<p>Story {i} {rng.random()}</p>" for _ in range(rng.randint(1, 4))) + "</div><span class=ad>x</span></body>" for i in range(12)]
    frame = spark.createDataFrame([("h", x) for x in pages], "host string, html string")
    tree = X.style_tree(X.style_values(frame)).collect()
    nodes = {}
    for n, x in enumerate(pages):
        for path, up, kind, value, count in X.Page(x).features():
            node = nodes.setdefault(path, {"up": up, 0: {}, 1: {}, 2: {}})
            c, on = node[kind].get(value, (0, set()))
            node[kind][value] = (c + count, on | {n})
    assert {r.path for r in tree} == set(nodes)
    for r in tree:
        own = nodes[r.path]
        m = sum(c for c, _ in own[0].values())
        entropy = -sum(c / m * math.log(c / m) for c, _ in own[0].values()) / math.log(m) if m > 1 else 1
        texts = [x for k in (1, 2) for x in own[k].values()]
        total = sum(c for c, _ in texts)
        content = max(0, 1 - sum(c * math.log(len(on)) for c, on in texts) / total / math.log(m)) if texts and m > 1 else 1
        assert r.m == m and abs(r.entropy - entropy) < 1e-9 and r.texts == total and (not total or abs(r.content - content) < 1e-9) and r.pages == max(len(on) for _, on in own[0].values())
