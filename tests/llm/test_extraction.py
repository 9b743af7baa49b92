"""Main text of pages: layouts with known text, and odd markup."""

import pytest

from faultsift.llm import text_density
from faultsift.llm.text_density import main_texts

PROSE = "The council met on Monday evening and agreed on the plan for the old bridge, after a debate of three hours. "
MENU = "<ul><li><a href=/a>Home page</a><li><a href=/b>All news today</a><li><a href=/c>About the paper</a></ul>"
BODY = f"<h1>A bridge</h1><p>{PROSE}</p><p>Short.</p><p>{PROSE * 2}</p>"
TEXT = "\n".join(["A bridge", PROSE.strip(), "Short.", (PROSE * 2).strip()])
AROUND = [
    "<header><a href=/>The Paper</a></header>", f"<nav>{MENU}</nav>", f"<aside><p>{PROSE * 3}</p></aside>",
    f"<div class='cookie-banner'>{PROSE}</div>", f'<div id="sidebar"><p>{PROSE * 4}</p></div>', f"<form><p>{PROSE}</p></form>",
    f"<div class=ad>{PROSE * 5}</div>", f"<section class='comments'><p>{PROSE * 9}</p><p>{PROSE * 9}</p></section>",
    "<script>var a = '<p>no</p>';</script>", "<style>p{}</style>", f"<!-- {PROSE} -->", "<footer>&copy; The Paper</footer>",
    f"<div role=complementary>{PROSE}</div>", f"<noscript>{PROSE}</noscript>"]


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", "<div role='article'>{}</div>",
                                  "<div class='with-sidebar content'>{}</div>", "<div><div>{}</div></div>"])
def test_what_surrounds_an_article_goes(wrap):
    inside = "".join(AROUND[1:])
    for page in (wrap.format(BODY), "".join(AROUND[:6]) + wrap.format(BODY) + "".join(AROUND[6:]),
                 "<html><head><title>t</title></head><body>" + wrap.format(BODY + inside) + "</body></html>"):
        assert main_texts([page]) == [TEXT], page


def test_density_finds_unmarked_articles():
    plain = f"<div>{MENU}</div><div><h2>Head of this unmarked article</h2><div><p>{PROSE}</p><p>{PROSE * 3}</p></div></div>"
    links = "<div>" + "".join(f"<span><a href=/{i}>Other story {i}</a></span>" for i in range(30)) + "</div>"
    want = "\n".join(["Head of this unmarked article", PROSE.strip(), (PROSE * 3).strip()])
    assert main_texts([f"<body>{plain}{links}<div>Imprint</div></body>"]) == [want]


def test_density_formula():
    from math import e, isclose, log
    got = text_density.composite_density(*(float(x) for x in (500, 10, 100, 4, 2000, 300)))
    assert isclose(float(got), 500 / 10 * log(500 / 100 * 10 / 4, log(500 / 400 * 100 + 300 / 2000 * 500 + e)))
    assert float(text_density.composite_density(0.0, 3.0, 0.0, 0.0, 9.0, 0.0)) == 0


@pytest.mark.parametrize("page,text", [
    ("", ""), ("just text", "just text"), ("<article></article><p>x", "x"), ("<p>a<p>b<br>c</p>d", "a\nb c\nd"),
    ("<article><p>a <b>bold<p>b &amp;amp; c&nbsp;&#8212;\t d<!-- x", "a bold\nb &amp; c — d"),
    ("<article>a < b <c", "a < b"), ("<article>x<p title='>'>y</p title=\"", "x\ny"), ("<nav>only</nav>", ""),
    ("<article>" + "<div>" * 3000 + "deep", "deep"), ("<ul><li>one<li>two</ul><table><tr><td>a<td>b</table>", "one\ntwo\na\nb"),
    ("<article><p>It<i>al</i>ic&#0;&#xD800;</p></article>", "Italic��"), ("</p></b><p>x</div>", "x"),
    ("<article>own<article>reader</article>end</article>", "own\nend"),
    ("<form id=all><nav>n</nav><article>t</article></form>", "t"), ("<article>a&lt;b&gt;</article>", "a<b>")])
def test_odd_markup(page, text):
    assert main_texts([page]) == [text]


def test_many_unclosed_tags_take_linear_time():
    assert main_texts(["<b>" * 50_000 + "</i>" * 50_000 + "x"]) == ["x"]


def test_table_with_odd_rows(spark):
    long = "<article><p>" + PROSE * 12_000 + "</p></article>"  # over one slice
    rows = [(1, "u", "<article>a</article>", "t", 5), (1, "u", "<article>a</article>", "t", 5), (None, None, None, None, None),
            (2, None, "", "t", 0), (3, "v", long, "t", 1)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int").repartition(2)
    got = text_density.extract_text(table, carry=("page_id", "url", "text", "html"))
    assert got.columns == ["page_id", "url", "html", "text", "n_chars"]
    assert {(r["page_id"], r["url"], r["text"], r["n_chars"]) for r in got.collect()} == {
        (1, "u", "a", 1), (None, None, "", 0), (2, None, "", 0), (3, "v", (PROSE * 12_000).strip(), len((PROSE * 12_000).strip()))}
    assert got.count() == 5 and text_density.extract_text(table.where("false")).count() == 0
