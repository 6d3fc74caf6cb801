import itertools
import random

from pinfold.llm import html_wrapper as H

SCHEMA = "page_id long, url string, html string, host string, blocks int"
PAGE = """<!DOCTYPE html><html lang="en"><head><title>T &amp; U</title><style>p{{margin:0}}</style><script>var t="</p>";x(1);</script></head>
<body><header>Site name</header><nav><ul><li><a href="/a">a</a></li></ul></nav><!-- ad --><div class="ad">Buy this.</div><div class="cookie-notice">We use cookies</div>
<article><h1>{title}</h1><p>Share this page with friends</p><p><b>{first}<br><p>x &lt; y&nbsp;&eacute; {second}</p><div class="comments"><p>nice!</p></div></article>
<aside>side</aside><form><p>mail</p></form><footer>the end</footer></body></html>"""


def run(spark, rows):
    df = spark.createDataFrame([(*r, "h", 1) for r in rows], SCHEMA)
    return H.extract_main_text(df).orderBy("page_id").collect()


def brute(a, b):
    """Largest order-preserving mapping by trying all of them."""
    if a.label != b.label:
        return 0
    xs, ys = H._inner(a), H._inner(b)
    best = 0
    for k in range(1, min(len(xs), len(ys)) + 1):
        for i in itertools.combinations(range(len(xs)), k):
            for j in itertools.combinations(range(len(ys)), k):
                w = [brute(xs[p], ys[q]) for p, q in zip(i, j)]
                best = max(best, sum(w)) if all(w) else best
    return 1 + best


def test_tree_matching_against_brute_force():
    rng = random.Random(5)

    def make(depth):
        inner = "".join(make(depth - 1) for _ in range(rng.randint(0, 3))) if depth else rng.choice("xy")
        tag = rng.choice(["div", "span", "b"])
        return f"<{tag}>{inner}</{tag}>"

    for _ in range(60):
        a, b = H.parse(make(3)), H.parse(make(3))
        assert H.tree_match(a, b, {}) == brute(a, b)
        got = H.mapping(a, b)
        assert len(got) == brute(a, b)


def test_template_goes_and_content_stays(spark):
    rows = [(i, f"https://a.example.com/{i}?q=1", PAGE.format(title=f"Title {i}", first=f"One  {i}\n two", second=f"v{i}")) for i in range(9)]
    rows += [(20, "https://b.example.com/x", PAGE.format(title="Only", first="f", second="s"))]
    got = run(spark, rows)
    for i in range(9):
        assert got[i].text == f"Title {i}\nOne {i} two\nx < y é v{i}"
        assert got[i].n_chars == len(got[i].text)
    # one page of a host has nothing to be aligned with
    assert got[9].text == "Only\nShare this page with friends\nf\nx < y é s"


def test_layout_around_the_article_is_no_sidebar(spark):
    page = (
        '<body><form><div class="layout has-sidebar"><div class="sidebar">x</div><article class="post comments-open"><header><h1>T</h1></header><p>body</p>'
        '<section id="comments"><article><p>first!</p></article></section></article></div></form><section class="comments"><article class="comment"><p>longer than the article is</p></article></section></body>'
    )
    assert run(spark, [(1, "http://e.org/1", page)])[0].text == "T\nbody"


def test_pages_without_article_keep_the_varying_slots(spark):
    page = "<html><body><div id=top>Welcome to us</div><div><p>{a}</p><p>{b}</p></div><div>All rights reserved</div></body></html>"
    rows = [(i, f"http://c.org/{i}", page.format(a=f"text {i}", b=f"more {i * i}")) for i in range(6)]
    assert [r.text for r in run(spark, rows)] == [f"text {i}\nmore {i * i}" for i in range(6)]


def test_nulls_empty_broken_long_and_repeated(spark):
    long = "<article>" + "".join(f"<p>word {i}</p>" for i in range(6000)) + "</article>"
    rows = [(1, "http://d.org/1", None), (2, None, "<p>a<p>b"), (3, "nonsense", ""), (4, "http://d.org/2", "plain < text & <b>bold"), (5, "http://d.org/5", long), (5, "http://d.org/5", long)]
    rows += [(6 + i, f"http://d.org/{i}", f"<div><div><div>{i}") for i in range(4)] + [(None, "http://d.org/n", "<article>n</article>")]
    got = {(r.page_id, r.url): r for r in run(spark, rows)}
    assert got[1, "http://d.org/1"].text == "" and got[1, "http://d.org/1"].n_chars == 0
    assert got[2, None].text == "a\nb" and got[3, "nonsense"].text == ""
    assert got[4, "http://d.org/2"].text == "plain < text & bold"
    assert got[5, "http://d.org/5"].text.count("\n") == 5999
    assert got[None, "http://d.org/n"].text == "n"
    assert len(run(spark, rows)) == len(rows) and run(spark, []) == []


def test_every_region_of_a_page_is_kept_in_order(spark):
    pages = [
        "<body><article><p>one</p></article><div>between</div><article><p>two is longer</p></article><article class=teaser><p>read this as well</p></article></body>",
        "<body><div class=wrap><div class=entry><p>part 1</p></div><p>not named</p><div class=entry><p>part 2 is longer</p></div></div></body>",
        "<body><div role=main><p>a</p></div><main><p>b</p><main><p>c</p></main></main></body>",
        "<body><article class=teaser><p>first</p></article><article class=teaser><p>second</p></article></body>",
        "<body><article></article><main><p>in main</p></main></body>",
    ]
    got = run(spark, [(i, f"http://r{i}.org/", p) for i, p in enumerate(pages)])
    assert [r.text for r in got] == ["one\ntwo is longer", "part 1\npart 2 is longer", "a\nb\nc", "first\nsecond", "in main"]


def test_deep_pages_and_wide_pages(spark):
    deep = "<body><article>" + "<div>" * 5000 + "{}" + "</div>" * 5000 + "</article></body>"
    wide = "<body><article>" + "".join(f"<p>{{0}} line {k}</p>" for k in range(3000)) + "<p>Print this page</p><p>{0} last</p></article></body>"
    rows = [(i, "http://deep.org/", deep.format(f"text {i}")) for i in range(3)] + [(10 + i, "http://wide.org/", wide.format(f"w{i}" * (i + 1)).replace("<p>", "<p>x</p><p>", i)) for i in range(3)]
    got = {r.page_id: r.text for r in run(spark, rows)}
    assert [got[i] for i in range(3)] == [f"text {i}" for i in range(3)]
    # the constant block is found in the middle, though lines before it were put in
    assert all("Print this page" not in got[10 + i] and got[10 + i].endswith(f"{f'w{i}' * (i + 1)} last") for i in range(3))


def test_halved_tables_give_the_same_matching():
    rng = random.Random(11)
    for _ in range(40):
        pages = ["".join(f"<{t}>{rng.choice('xyz')}</{t}>" for t in rng.choices(["p", "b", "div"], k=rng.randint(0, 12))) for _ in range(2)]
        a, b = map(H.parse, pages)
        sizes = []
        for cells in (1, 1 << 20):
            H.CELLS, saved = cells, H.CELLS
            found = H.mapping(a, b)
            H.CELLS = saved
            nodes = {id(n): n for n in [a, *a.inner]}
            sizes.append((len(found), sum(nodes[k].digest == n.digest for k, n in found.items())))
        assert sizes[0] == sizes[1] and sizes[0][0] == brute(a, b)


def test_repeated_and_copied_pages_keep_their_article(spark):
    page = "<body><article><h1>Title</h1><p>One paragraph that all of them have.</p><p>Another one.</p></article></body>"
    rows = [(i, "http://same.org/", page) for i in range(6)]
    assert {r.text for r in run(spark, rows)} == {"Title\nOne paragraph that all of them have.\nAnother one."}
    # copies that differ in a word are no template either
    rows = [(i, "http://near.org/", page.replace("Another one", f"Another {i}")) for i in range(6)]
    assert [r.text for r in run(spark, rows)] == [f"Title\nOne paragraph that all of them have.\nAnother {i}." for i in range(6)]


def test_stubs_and_two_pages_of_a_host(spark):
    stubs = [(100 + i, "http://s.org/", s) for i, s in enumerate([" ", "<p>404</p>", "<html></html>"])]
    rows = [(i, "http://s.org/", PAGE.format(title=f"Title {i}", first=f"One {i}", second=f"v{i} " * 20)) for i in range(2)]
    got = {r.page_id: r.text for r in run(spark, rows + stubs)}
    assert all("Share this page" not in got[i] and f"One {i}" in got[i] for i in range(2))
    assert got[101] == "404" and got[100] == got[102] == ""


def test_regions_by_text_and_words_inside_articles(spark):
    pages = [
        "<body><main><div><p>" + "A sentence of the main text. " * 20 + "</p></div><article class=card>Short teaser</article></main></body>",
        '<body><article><h1>T</h1><section class="related work"><p>Others did this before us, at length.</p></section><p>a<math><mi>x</mi></math></p>'
        '<div class="related"><a href="/">One link</a><a href="/">two</a></div><div class="ad">Buy</div></article></body>',
        "<body>" + "<b>" * 300 + "</i>" * 300 + "x</body>",
    ]
    got = [r.text for r in run(spark, [(i, f"http://w{i}.org/", p) for i, p in enumerate(pages)])]
    assert got[0].startswith("A sentence") and got[1] == "T\nOthers did this before us, at length.\nax" and got[2] == "x"
