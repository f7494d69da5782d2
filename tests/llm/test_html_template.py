"""Template deduction against plain vectors, and main text of pages of many forms."""

import html as entities
import re
from collections import defaultdict

import pytest

from tallyproof.llm import html_template
from tallyproof.llm.html_template import Walk, extract, main_text

SCHEMA = "page_id long, url string, html string, host string, row long, labels string, token long"


def table(spark, pages):
    return spark.createDataFrame([(i, u, h, "h", 1, "l", 2) for i, u, h in pages], SCHEMA)


def texts(spark, pages, **more):
    return {r["page_id"]: r["text"] for r in extract(table(spark, pages), **more).collect()}


def test_elements_alone():
    page = """<html><head><title>T</title><style>p{}</style></head><body class="nav-open"><header>Site</header><ul class="menu"><li>Home<li>About</ul>
    <article class="post"><header><h1>Head &amp; line</h1></header><p>One <b>bold</b>&nbsp;and <a href=x>a link</a>.<p>Two<br>lines &lt;p&gt;
    <script>var s = "</p><p>no</p>";</script><!-- <p>no</p> --><div class="ad-slot">Buy</div><ul><li>First<li>Second</ul><footer>By us</footer>
    <section id="comments"><p>Nice!</p></section></article><aside>Other</aside><form><p>Mail</p></form><div class="cookie-notice">Cookies</div></body></html>"""
    assert main_text(page) == "Head & line\nOne bold and a link.\nTwo lines <p>\nFirst\nSecond"


@pytest.mark.parametrize(
    "page,want",
    [
        ("", ""),
        ("just words & more", "just words & more"),
        ("a < b and b > a", "a < b and b > a"),
        ("<p>a</p>b<p>c", "a\nb\nc"),
        ("<main><p>in</p></main><p>out</p>", "in"),
        ('<div itemprop="articleBody">in</div><div>out</div>', "in"),
        ("<!-- never closed <p>x</p>", ""),
        ("<script>never closed <p>x</p>", ""),
        ('<p title="a>b">x</p>', "x"),
        ("<p title=it's>x</p><p>it's</p>", "x\nit's"),
        ('<p class="x>kept</p>', "kept"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"),
        ("<p>&#65;&#x42;&eacute;&copy;&#xD800;</p>", "ABé©�"),
        ("</p></div>x<hr>y", "x\ny"),
        ('<div class="article-header">kept? no</div><article><div class="article-header">yes</div></article>', "yes"),
        ('<div class="content no-sidebar"><p>x</p></div>', "x"),
        ("<article><p>post</p></article><article class='comment'><p>me too</p></article>", "post"),
    ],
)
def test_small_pages(page, want):
    assert main_text(page) == want


def test_long_and_deep():
    assert main_text("<p>" + "word " * 400_000).count(" ") == 399_999
    assert main_text("<div>" * 50_000 + "x" + "</section>" * 50_000) == "x"
    assert main_text("<li>x" * 20_000).count("\n") == 19_999
    for odd in ("<p a=", "<script", "<!", "<p a=\"", "<a href='"):
        assert len(main_text(odd * 50_000)) <= len(odd) * 50_000


def page(k, body, notice="We use cookies on this site."):
    return f'<html><body><div id="top"><span>Shop {k}</span></div><div class="x1">{notice}</div><div class="x2"><ul>' + "".join(f"<li><a href=/{j}>Item {k} {j}</a></li>" for j in range(2 + k % 3)) + f'</ul></div><div class="x3">{body}</div></body></html>'


def test_template_texts_and_link_lists_go(spark):
    """Nothing in these pages says what it is: only the host's other pages tell."""
    bodies = {k: f"<p>Story {k} begins.</p>" + f"<p>More of it {k}, with <a href=x>a link</a>.</p>" * (1 + k % 2) for k in range(9)}
    got = texts(spark, [(k, f"http://a.example/{k}", page(k, b)) for k, b in bodies.items()])
    for k, b in bodies.items():
        assert got[k] == f"Shop {k}\n" + "\n".join(re.sub("<.*?>", "", p) for p in re.findall(r"<p>.*?</p>", b))


def test_articles_that_repeat_stay(spark):
    """Copies of an article on most pages of a host are no template."""
    same = "<article><h1>Same</h1><p>All of it.</p><p>Again.</p></article>"
    pages = [(k, "http://b.example/x", f"<body><nav>n{k}</nav>{same}<footer>f</footer></body>") for k in range(8)]
    pages += [(9, "http://b.example/y", "<body><nav>n</nav><article><h1>Other</h1></article><footer>f</footer></body>")]
    got = texts(spark, pages)
    assert all(got[k] == "Same\nAll of it.\nAgain." for k in range(8)) and got[9] == "Other"


def test_odd_rows(spark):
    pages = [(1, None, "<p>x</p>"), (2, "http://a.example", None), (None, "no address", ""), (3, "http://a.example", "<nav>x</nav>"), (3, "http://a.example", "<nav>x</nav>"), (4, "//A.example:80/q", "<p>long</p>" * 20_000)]
    got = extract(table(spark, pages))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    rows = sorted((r["page_id"] or 0, r["url"], len(r["text"]), r["n_chars"]) for r in got.collect() if r["url"])
    assert [(r[0], r[2], r[3]) for r in rows] == [(0, 0, 0), (2, 0, 0), (3, 0, 0), (3, 0, 0), (4, 99_999, 99_999)]
    assert extract(table(spark, [])).count() == 0


def plain_template(pages, share):
    """Valid classes of one host's pages from whole vectors, by loops."""
    walks = [Walk()(h)[0] for h in pages]
    tokens = {t: (kind, up) for seen in walks for t, kind, up, _ in seen}
    vector = {t: tuple(sum(x[0] == t for x in seen) for seen in walks) for t in tokens}
    often = {t for t, v in vector.items() if sum(map(bool, v)) >= max(2, share * len(pages))}
    classes = defaultdict(set)
    for t in often:
        classes[vector[t]].add(t)
    valid = set()
    for members in classes.values():
        if not {0, 1} <= {tokens[t][0] for t in members}:
            continue
        parts = defaultdict(set)
        for t in members:
            top = t
            while tokens[top][1] in members:
                top = tokens[top][1]
            parts[tokens[top][1]].add(t)
        for part in parts.values():
            kinds = {tokens[t][0] for t in part}
            orders, ok = set(), {0, 1} <= kinds or kinds == {2}
            for seen in walks:
                seq = [x[0] for x in seen if x[0] in part]
                if seq:
                    k = len(set(seq))
                    ok &= seq == seq[:k] * (len(seq) // k)
                    orders.add(tuple(seq[:k]))
            if ok and len(orders) == 1:
                valid |= part
    return {t for t in valid if tokens[t][0] != 1}


def test_classes_against_loops(spark):
    from pyspark.sql import functions as F

    real = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").limit(12).collect()]
    for pages in ([page(k, "<p>a</p>" * (k % 3) + "<h2>b</h2>" * (k % 2)) for k in range(10)], real, [page(1, "x"), "<ul><li>a</ul>", page(1, "x") + "<ul><li>b</ul>"]):
        df = table(spark, [(k, "http://c.example/", h) for k, h in enumerate(pages)]).select(F.monotonically_increasing_id().alias("row"), F.lit("c.example").alias("host"), "html")
        tokens = df.mapInArrow(html_template._tokens, html_template.TOKENS)
        members = html_template.nested(html_template.candidates(tokens, 0.1)[0])
        valid = members.join(html_template.valid_classes(tokens, members), ["host", "class"], "left_semi").where("kind <> 1")
        got = {r["token"] & (1 << 64) - 1 for r in valid.collect()}
        assert got == plain_template(pages, 0.1) and got


def test_real_pages(spark):
    """Pages of the test tables, whose articles are marked, against a plain cut."""
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r["text"] for r in extract(df).collect()}
    for r in df.collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub(r"</?b>", "", b).replace("<br>", " ")).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r["page_id"]] == "\n".join(b for b in blocks if b)
