"""Pages whose body, wrappers or article carry words of boilerplate in their class, and long or unclosed attributes."""

import html
import re

import pytest

from auditlake.llm import html_text

ARTICLE = "<h1>The harbour at low tide</h1><p>The boats lay on the sand until noon and the crews mended their nets in the shade of the old harbour wall.<p>Nobody was in a hurry."
WANT = "The harbour at low tide\n\nThe boats lay on the sand until noon and the crews mended their nets in the shade of the old harbour wall.\n\nNobody was in a hurry."
NAV = "<nav><a>Home</a> <a>News</a></nav>"
COMMENT = "<p>I was there too and it was the quietest morning that I can remember in all my years at the coast.</p>"
SIDE = "<aside><p>Readers who liked this also liked the story of the lighthouse keeper and the nine cats that he had.</aside><footer>Imprint</footer>"
JSON = '{"html": "<div class=ad><p>' + "buy < more > now " * 2000 + '"}'


@pytest.fixture(scope="module")
def tree(spark):
    return html_text.train(spark)


@pytest.mark.parametrize(
    "page",
    [
        f"<body class='has-sidebar'>{NAV}<article>{ARTICLE}</article>{SIDE}",
        f"<html class='cookie-consent'><body class='comments'>{NAV}<main>{ARTICLE}</main>{SIDE}",
        f"<body>{NAV}<div class='content with-sidebar'>{ARTICLE}</div>{SIDE}",
        f"<body>{NAV}<article class='post comments-open tags-x'>{ARTICLE}</article>{SIDE}",
        f"<body>{NAV}<article class='comments-open'>{ARTICLE}</article>{SIDE}",
        f"<body><div class='cookie-wrapper'>{NAV}<article>{ARTICLE}</article>{SIDE}</div>",
        f"<body><form id='page'>{NAV}<div class='entry'>{ARTICLE}</div>{SIDE}</form>",
        f"<body><div class='overlay'>{NAV}<main class='search'>{ARTICLE}</main>{SIDE}</div>",
        f"<body>{NAV}<article>{ARTICLE}<section class='comments'><article>{COMMENT}</article></section></article>{SIDE}",
        f"<body>{NAV}<article>{ARTICLE}</article><section class='comments-list'><article class='comment-body'>{COMMENT}</article></section>{SIDE}",
        f"<body>{NAV}<article>{ARTICLE}</article><div class='widget content'>{COMMENT}</div><div class='comment-content'>{COMMENT}</div>{SIDE}",
        f"<body>{NAV}<div class='content' data-state='{JSON}'>{ARTICLE}</div>{SIDE}",
    ],
)
def test_article_is_kept_and_the_rest_is_not(tree, page):
    assert html_text.main_text(page, tree) == WANT


def test_quotes_that_never_close():
    page = f"<body><article><p title=\"x>{ARTICLE.replace(chr(34), '')}</article>"
    assert "\n\n".join(t for t, _ in html_text.blocks(page)) == WANT


def accuracy(tree, rows):
    return sum(html_text.predict(tree, f) == (y > 0.5) for f, y in rows) / len(rows)


def test_neighbours_decide_on_plain_pages(tree):
    rows = html_text.labelled([html_text.sample_page(i, False) for i in range(1000, 1060)])
    blind = [([*f[:2], 0.0, 0.0, 0.0, 0.0, *f[6:]], y) for f, y in rows]
    assert accuracy(tree, rows) > 0.98 and accuracy(tree, blind) < 0.92
    assert accuracy(tree, html_text.labelled([html_text.sample_page(i, True) for i in range(1000, 1060)])) > 0.98


def test_pages_against_brute_force(spark, tree):
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        inside = re.search(r"<article>(.*?)(</article>|\Z)", r.html or "", re.S)
        text = re.sub(r"(?s)<!--.*?-->", "", inside[1] if inside else "")
        text = re.sub(r"<br\s*/?>", " ", re.sub(r"</?(?:b|i|a|em|strong|span)\b[^>]*>", "", text))
        parts = [" ".join(html.unescape(x).split()) for x in re.split(r"</?(?:p|h\d|li|ul|ol|div)\b[^>]*>", text)]
        assert html_text.main_text(r.html, tree) == "\n\n".join(x for x in parts if x)


def test_long_attributes_do_not_leak(tree):
    page = f"<body>{NAV}<div class='content'><p data-j='" + "x" * 30_000 + "<b>leak</b>' title=y>" + f"</p>{ARTICLE}</div>{SIDE}"
    assert html_text.main_text(page, tree) == WANT


def test_edge_rows(spark, tree):
    page = f"<body><article>{ARTICLE}</article>"
    rows = [(1, page, "a", "b", "c"), (1, page, "a", "b", "c"), (None, None, None, None, None), (2, "", "a", "b", "c"), (3, "<article><p>" + "word " * 200_000, "", "", "")]
    pages = spark.createDataFrame(rows, "page_id long, html string, `_html` string, `Text` string, N_CHARS string")
    got = html_text.extract_text(pages, tree=tree)
    assert got.columns == ["page_id", "_html", "text", "n_chars"]
    assert sorted(((r.page_id, r.n_chars) for r in got.collect()), key=str) == sorted([(1, len(WANT)), (1, len(WANT)), (None, 0), (2, 0), (3, 999_999)], key=str)
    assert html_text.extract_text(pages.filter("page_id = 77"), tree=tree).count() == 0
