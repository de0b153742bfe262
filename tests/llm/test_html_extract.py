"""Main text of pages against the known article, and tree matching against all matchings."""

import html
import itertools
import random
import re

from vigilo.llm import html_extract as H

DDL = "page_id bigint, url string, html string"


def article(page):
    body = page[page.index("<article>") + 9:]
    body = body[:body.index("</article>")] if "</article>" in body else body
    blocks = (" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", body))
    return "\n".join(b for b in blocks if b)


def test_pages_of_the_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    want = {r.page_id: article(r.html) for r in pages.collect()}
    got = H.extract(pages).collect()
    assert {r.page_id: r.text for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)


def text_of(page):
    return H.main_text(page, None, None, H.Aligner())


def test_markup():
    assert text_of("<body><p>a &lt;b&gt; &amp;amp;<br>c<p>d  e\n f<ul><li>x<li>y</ul>") == "a <b> &amp; c\nd e f\nx\ny"
    assert text_of("<body><article><script>if (a < b) '</p>'</script><style>p{}</style>a<!-- <p>no --> b</article>") == "a b"
    assert text_of("<p>1 < 2 and 3 > 2</p>") == "1 < 2 and 3 > 2"
    assert text_of('<p title="a > b">x</p><p title=\'"\'>y') == "x\ny"
    assert text_of("<b>a<i>b</b>c</i>") == "abc"
    assert text_of("") == text_of("<html>") == text_of("<script>x") == ""


def test_chrome_is_left_out():
    page = ("<body><header>site</header><nav>m</nav><div class='cookie-notice'>n</div><div id=sidebar>s</div>"
            "<main><article><header><h1>T</h1></header><p>one</p><form><p>f</form><aside>x</aside><p>two</p></article>"
            "<section class=comments><article class=comment>c</article></section></main><footer>f</footer>")
    assert text_of(page) == "T\none\ntwo"


def test_marked_elements_around_the_content_stay():
    article = "<article><h1>T</h1><p>one</p></article>"
    for start, end in (("<div class='layout has-sidebar'>", "</div>"), ("<div id=page class=header-fixed>", "</div>"),
                       ("<form id=aspnetForm>", "</form>"), ("<div class=widget><form>", "</form></div>"),
                       ("<main><div class=banner>", "</div></main>")):
        assert text_of(f"<body><nav>m</nav>{start}{article}{end}<footer>f</footer>") == "T\none", start
    assert text_of("<form><p>one</p><div class=ad>x</div><p>two</p></form>") == "one\ntwo"
    assert text_of("<div class=widget><p>one</p></div>") == "one"
    # With content elsewhere, and what surely is none, nothing changes.
    assert text_of(f"<p>{'body ' * 9}</p><div class=sidebar>{article}</div>") == ("body " * 9).strip()
    assert text_of(f"{article}<div class=related><article>{'teaser ' * 9}</article></div>") == "T\none"
    assert text_of(f"<aside>{article}</aside><div class=comments>{article}</div>") == ""


def test_headings_and_sections_of_an_article_stay():
    parts = ("<h2 id=related-work>R</h2><h2 id=how-to-share>H</h2><h2 id=search>S</h2><h2 id=search-engines>E</h2>"
             "<section class=article-header>A</section><div class='nav-menu x'>m</div><div class=ad-2>n</div>")
    assert text_of(f"<article>{parts}</article>") == "R\nH\nS\nE\nA"


def test_deep_and_broken_pages():
    assert text_of("<div>" * 5000 + "x" + "</div>" * 5000 + "<p>y") == "x\ny"
    assert text_of("<b>" * 3000 + "x") == "x"
    assert text_of("<a b='" * 2000) is not None
    assert len(text_of("<p>" + "word " * 200_000)) == 5 * 200_000 - 1


def test_long_tags_and_deep_elements():
    long = "x>" * 10_000
    assert text_of(f"<article><p>a<img src='data:{long}'>b<div style=\"{long}\">c</div></article>") == "ab\nc"
    assert text_of(f"<article><p>a</p><nav data-x='{long}'>menu</nav><p>b</p></article>") == "a\nb"
    many = " ".join(f'a{i}=">"' for i in range(200))
    assert text_of(f"<article><p>a</p><nav {many}>menu</nav><p>b</p></article>") == "a\nb"
    deep = "<div>" * 300 + "<nav>menu</nav><div><p>b</p></div>" + "</div>" * 300
    assert text_of(f"<article><p>a</p>{deep}<p>c</p></article>") == "a\nb\nc"
    assert text_of("<p>x<script>'<!--'</script>y <a href='u'\">z</a> 1 <b") == "xy z 1 <b"


def test_broken_tags_are_linear():
    n = 20_000
    for text in ("<a b='" * n, "<a b='>" * n, "<a b=\"'" * n, "<a b='x" * n + ">", "<a" * n + ">",
                 "<div>" * n + "</b>" * n, "<b>" * n + "<div>" * n + "</b>" * n, "<b>" * n + "x<hr>" * n,
                 "<p><b>" * n + "</i>" * n):
        text_of(text)


def host(n, make):
    return [(i, f"http://h.example/{i}", make(i)) for i in range(n)]


def test_template_is_learned_where_nothing_names_it(spark):
    random.seed(1)
    body = [" ".join(random.choices("aa bb cc dd ee ff".split(), k=40)) for _ in range(20)]
    pages = host(20, lambda i: f"<body><div class=top>The site</div><div class=c><h2>t{i}</h2><p>{body[i]}</p>"
                               f"<p class=tail>Always the same line</p></div><div class=end>All rights</div>")
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(pages, DDL)).collect()}
    # The frame around the varying container is template; inside, few pages are no proof.
    assert got == {i: f"t{i}\n{body[i]}\nAlways the same line" for i in range(20)}
    many = host(60, lambda i: f"<body><div class=c><p>text {i} {body[i % 20]}</p><p class=tail>Always the same line</p></div>")
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(many, DDL)).collect()}
    assert got == {i: f"text {i} {body[i % 20]}" for i in range(60)}


def test_reference_is_the_commonest_tree(spark):
    # The page with the smallest id is empty, the next is built unlike the others.
    page = "<body><div class=top>The site</div><table><tr><td>Menu of the site</table><div class=c><p>text {}</p></div>"
    pages = host(20, lambda i: "" if i == 0 else "<p>moved" if i == 1 else page.format(f"{i} " * 9))
    trees = {r.host: r.skeleton for r in H.induce(spark.createDataFrame(pages, DDL)).collect()}
    assert trees == {"h.example": H.skeleton(H.parse(page)[0])}
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(pages, DDL)).collect()}
    assert got == {i: "" if i == 0 else "moved" if i == 1 else " ".join(["text"] + [str(i)] * 9) for i in range(20)}


def test_copies_of_an_article_stay(spark):
    pages = host(30, lambda i: "<body><nav>x</nav><article><p>one and the same</p></article>" if i < 20
                 else f"<body><nav>x</nav><article><p>other {i}</p></article>")
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(pages, DDL)).collect()}
    assert got == {i: "one and the same" if i < 20 else f"other {i}" for i in range(30)}


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "nohost", "<p>hi"), (None, "http://a.b/c", "<p>x"), (3, "http://A.b:80/c", ""),
            (3, "http://A.b:80/c", ""), (4, "http://user@a.b?q", "<p>y")]
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], DDL + ", host string, nodes int")
    got = sorted((str(r.page_id), r.text, r.n_chars) for r in H.extract(pages).collect())
    assert got == [("1", "", 0), ("2", "hi", 2), ("3", "", 0), ("3", "", 0), ("4", "y", 1), ("None", "x", 1)]
    assert H.extract(spark.createDataFrame([], DDL)).count() == 0


def random_tree(rng, depth=3):
    node = H.Node(rng.choice("ab"), False, None)
    if depth:
        for label in rng.sample("abcd", rng.randint(0, 3)):
            child = random_tree(rng, depth - 1)
            child.label, child.parent = label, node
            node.children[label] = child
    return node


def best_matching(x, y):
    if x.label != y.label:
        return 0
    xs, ys = list(x.children.values()), list(y.children.values())
    best = 0
    for n in range(min(len(xs), len(ys)) + 1):
        for a in itertools.combinations(xs, n):
            for b in itertools.combinations(ys, n):
                best = max(best, sum(best_matching(p, q) for p, q in zip(a, b)))
    return 1 + best


def test_tree_matching_is_largest():
    rng = random.Random(4)
    for _ in range(200):
        x, y = random_tree(rng), random_tree(rng)
        pairs = H.simple_tree_matching(x, y)
        assert len(pairs) == best_matching(x, y)
        for a, b in pairs.items():
            assert a.label == b.label and (a is x or pairs[a.parent] is b.parent)


def test_skeleton_round_trip():
    root, _ = H.parse("<div class='a b'><p>x<p>y</div><ul><li>1<li>2</ul><we(ir)d,tag>z")
    assert H.skeleton(H.from_skeleton(H.skeleton(root))) == H.skeleton(root)
