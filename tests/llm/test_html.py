"""HTML extraction on built pages whose main text is known."""

import pytest
from pyspark.sql import functions as F

from corvane.llm.html_extract import blocks, extract


def text_of(page):
    return [t for t, drop in blocks(page) if not drop]


def page(i, body, extra=""):
    return f"""<!DOCTYPE html><html lang="en"><head><title>T{i}</title><style>p{{a:b}}</style><script>var x="</p>";</script></head>
<body><nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="plain">Same on all pages &amp; here</div><!-- c --><article>{body}</article>{extra}<footer>&copy; x</footer></body></html>"""


def test_blocks():
    assert text_of("<p>a  <b>b</b>\n c<br>d<p>e &amp; f&eacute; &#233; &am</p>tail") == ["a b c d", "e & fé é &am", "tail"]
    assert text_of("<div class='ad-box'>x<p>y</div>z<ul><li>1<li>2</ul>") == ["z", "1", "2"]
    assert text_of("<article><header><h1>H</h1></header><p>x</p><section class='comments'><p>c</p></section></article><header>no</header>") == ["H", "x"]
    assert text_of("a<script>if (a<b) '</p>'</script>b<style>x") == ["ab"]
    assert text_of("<p>a<svg>b</svg>c<svg/>d<svg><p>e</p>f<svg>g") == ["acd", "e", "fg"]
    assert text_of("a<select><option>x</select>b<object>c") == ["abc"]
    assert text_of("x<textarea>in</textarea><form>f</form><p>y <span class=ad>advert</span> z") == ["x", "y", "z"]
    assert text_of("<p>1 < 2</p><p>cut <a href='") == ["1 < 2", "cut"]
    assert text_of("") == [] and text_of(None) == [] and text_of("<" * 1000) == ["<" * 1000]
    assert len(text_of("<div>" * 20_000 + "deep")) == 1
    assert text_of("<p>" + "word <b>bold</b> " * 50_000) == [" ".join(["word bold"] * 50_000)]


def test_style_tree(spark):
    rows = [(i, f"http://h.org/{i}", page(i, f"<h1>Head {i}</h1><p>Text {i} of it.<p>More {i}", f'<div class="teaser">Own {i}</div>')) for i in range(6)]
    rows += [(10 + i, "http://copies.org/x", page(0, "<p>One article.</p><p>Twice.</p>")) for i in range(5)]
    rows += [(20, "http://single.org/", page(0, "<p>Lone</p>")), (21, None, None), (22, "", ""), (None, "x", "<p>y")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit(1), "paths": F.lit("p"), "text": F.lit("t")})
    got = {r.page_id: r.text for r in extract(table).collect()}
    for i in range(6):
        assert got[i] == f"Head {i}\nText {i} of it.\nMore {i}\nOwn {i}"
    for i in range(5):
        assert got[10 + i] == "One article.\nTwice."
    assert got[20] == "Same on all pages & here\nLone" and got[21] == "" and got[22] == "" and got[None] == "y"
    assert extract(table.limit(0)).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_tables(spark, sf):
    """Only the article of the given pages is left, word for word."""
    import html
    import re

    pages = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet")
    raw = {r.page_id: r.html for r in pages.collect()}
    for r in extract(pages).collect():
        article = re.search(r"<article>(.*?)(</article>|$)", raw[r.page_id], re.S)[1]
        want = [" ".join(html.unescape(re.sub(r"</?(b|br|a|i)\b[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)\b[^>]*>", article)]
        assert r.text == "\n".join(x for x in want if x)


def test_head_without_end_tag():
    assert text_of("<html><head><title>t</title><meta charset=x><body><article><p>x</article><div>y</div>") == ["x", "y"]
    assert text_of("<head><link rel=a><style>b</style>\n<p>x <b>y</b>") == ["x y"]
    assert text_of("<head><title>t</title>bare <b>text</b><p>z") == ["bare text", "z"]


def test_names_do_not_drop_main_text():
    assert text_of("<div class='layout has-sidebar'><h2>T</h2><article><p>x</article><div class=sidebar>s</div></div><div class=related>r</div>") == ["T", "x"]
    assert text_of("<article><div class='entry-header'>H</div><section id='related-work'>R</section><p id=search>s<p class='share'>no<div class='note reply-box'>n</div></article>") == ["H", "R", "s", "n"]
    assert text_of("<div id=notice><main>m</main></div><section id='related-work'><h2 id=search>S</h2>w</section>") == ["m", "S", "w"]
    assert text_of("<nav class=menu><article>x</article></nav><article><div class=comments><article>c</article></div>y</article>") == ["y"]


def test_copies_are_one_page(spark):
    """Copies of a page without <article> neither remove each other nor the same path of other pages of their host."""
    plain = "<div class=note>One notice on every page</div><div class=body>{}</div>"
    rows = [(i, "http://copies.org/", plain.format("Own text of the copied page, longer than the notice")) for i in range(5)]
    rows += [(100 + i, "http://mixed.org/", plain.format("The copied page, in eighty rows")) for i in range(80)]
    rows += [(200 + i, "http://mixed.org/", plain.format(f"Only page {i}, with words {i * i} of its own")) for i in range(20)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all("Own text of the copied page" in got[i] for i in range(5))
    assert all(got[100 + i] == "The copied page, in eighty rows" for i in range(80))
    assert all(got[200 + i] == f"Only page {i}, with words {i * i} of its own" for i in range(20))


def extracted(spark, rows):
    return {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_tree_decides_without_names(spark):
    """Hosts of plain divs, and a menu inside main: no tag, role or name says what is boilerplate."""
    words = ["ash", "birch", "cedar", "elm", "fir", "gum", "hazel", "ivy"]
    own = lambda i: f"<h2>On {words[i]} {i}</h2><p>Page {i} tells of {words[i]} wood.</p><p>It ends with {words[-i]} {i}.</p>"
    plain = [(i, "http://plain.org/", f"<div class=a><ul><li>One</li><li>Two</li></ul></div><div class=b>{own(i)}</div><div class=c><p>All rights</p></div>") for i in range(8)]
    inside = [(10 + i, "http://main.org/", f"<main><div class=x><p>Start</p><p>Shop</p></div>{own(i)}<div class=y>Read this next</div></main>") for i in range(8)]
    got = extracted(spark, plain + inside)
    for i in range(8):
        want = f"On {words[i]} {i}\nPage {i} tells of {words[i]} wood.\nIt ends with {words[-i]} {i}."
        assert got[i] == want and got[10 + i] == want


def test_branch_importance(spark):
    """The composed importance against the recursion over one host's tree."""
    from math import log

    from corvane.llm import html_extract as h

    rows = [(f"<div class=m><p>a</p></div><div class=t><h2>h{i % 4}</h2><p>own {i}</p>{'<p>more</p><ul><li>x</ul>' if i % 3 else ''}</div>",) for i in range(7)]
    table = spark.createDataFrame(rows, "html string").withColumn("host", F.lit("s"))
    stats = {r.path: r for r in h.path_counts(table).collect()}

    def value(path):
        r = stats[path]
        base, shape = log(r.cs0), h.GAMMA**r.l
        style = (base - r.cw0 / r.cs0) / base if base else 1.0
        content = (1 - r.cw1 / r.cs1 / base if base else 1.0) if r.cs1 else 0.0
        parts = [(r.cs0, content)] * (r.cs1 > 0) + [(x.cs0, value(x.path)) for x in stats.values() if x.up and x.up[-1] == path]
        return (1 - shape) * style + shape * sum(n * v for n, v in parts) / sum(n for n, _ in parts)

    got = {r.path: r.importance for r in h.style_tree(table).collect()}
    assert got.keys() == stats.keys() and all(abs(got[p] - value(p)) < 1e-9 for p in got)


def test_near_copies_keep_their_title(spark):
    rows = [(i, "http://near.org/", f"<article><h1>One title</h1><p>Shared part.</p><p>Changed word {i}.</p></article><div class=z>Menu</div>") for i in range(5)]
    assert extracted(spark, rows) == {i: f"One title\nShared part.\nChanged word {i}." for i in range(5)}


def test_names_are_a_prior():
    assert text_of("<div class='content has-sidebar'><article><p>x</article></div>") == ["x"]
    assert text_of("<div class='layout-no-sidebar'><main><p>x</main></div>") == ["x"]
    assert text_of("<article><div class='entry-header'>T</div><div class='related-work'>r</div><div class='skip-lines'>s</div><div class='comment-free'>c</div></article>") == ["T", "r", "s", "c"]
    assert text_of("<nav><ul><li><a>Home</a></ul><article><h1>T</h1><p>text</article><footer>f</footer>") == ["T", "text"]
    assert text_of("<nav><ul><li><a>Home</a></ul><div><p>Long text of the page that follows</p><p>and more</p></div>") == ["Long text of the page that follows", "and more"]
    assert text_of("<main><div class=menu><a>a</a> <a>b</a></div><h1>T</h1><p>text</p></main>") == ["T", "text"]
    assert text_of("<div class='site-footer'>f</div><div class='banner'>All of the article is in here, oddly</div>x") == ["All of the article is in here, oddly", "x"]
    assert text_of("<p>post</p><div id=comments><article class=comment>a long comment of a reader</article></div>") == ["post"]


def test_forms_around_pages():
    assert text_of('<body><form id="form1"><input type=hidden name=v><div><h1>T</h1><p>Body of the page</p></div></form>') == ["T", "Body of the page"]
    assert text_of("<aside><p>All of a page that stands in an aside</p></aside>") == ["All of a page that stands in an aside"]
    assert text_of("<form>Name <input> Mail <input> <textarea></textarea></form>") == []
    assert text_of("<p>A page</p><form>Search <input></form>") == ["A page"]
    assert text_of("<form><div><a href=x>Home</a> <a href=y>Shop</a></div></form>") == []
    assert text_of("<form><article><p>x</article><p>y</form>") == ["x"]
    assert text_of("Click <button>OK</button> now") == ["Click now"]


def test_comments_and_code():
    assert text_of("<article><p>x</p><section id='comments'><p>c</section></article><section id=comments>d</section>") == ["x"]
    assert text_of("<p>x</p><section id=newsletter>n</section><section id='newsletter-design'>d</section>") == ["x", "d"]
    assert text_of('code <span class="comment">/* why */</span> end') == ["code /* why */ end"]
    assert text_of('<pre class="comment">a <span class="nav">b</span> <span class=ad>c</span></pre>') == ["a b c"]
    assert text_of("<article><h2 class='menu'>The menu</h2><p>text</p><div class='related'>own</div><div id=ad>no</div><div id=sidebar>no</div></article>") == ["The menu", "text", "own"]


def test_numbered_pages_of_a_host(spark):
    """A strip that is on every page goes though ids and body classes are numbered."""
    rows = [(i, "http://n.org/", f'<body class="post postid-{i}"><div id="post-{i}"><div class="strip-{i}">Same strip here</div><div><h2>Head {i}</h2><p>Own text {i} with words {i * i}</p></div></div>') for i in range(30)]
    assert extracted(spark, rows) == {i: f"Head {i}\nOwn text {i} with words {i * i}" for i in range(30)}
