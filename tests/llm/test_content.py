import random
import re
import time

import pytest
from pyspark.sql import functions as F

from pairloom.llm import content
from pairloom.llm.content import extract_main_text, main_text, token_counts, weights_from

ARTICLE = "<article><h1>A title here</h1><p>First  <b>bold</b>\n words &amp; more&nbsp;text.<br>Next line</p><ul><li>Item one</li><li>Item two</li></ul><p>End.</p></article>"
TEXT = "A title here\nFirst bold words & more text.\nNext line\nItem one\nItem two\nEnd."
PAGE = (
    "<!DOCTYPE html><html><head><title>Page title words</title><style>p{}</style><script>var x='</p><article>';</script></head><body>"
    '<header><a href="/">Home of the site</a></header><nav><ul><li><a href="a">Menu one</a></li></ul></nav>'
    '<div class="cookie-notice">We use cookies on this site for many reasons</div><!-- <p>hidden</p> -->{}'
    '<aside>Read this too</aside><form><label>Name</label><input name="x"></form><section id="comments"><p>I like it a lot</p></section>'
    "<footer>&copy; the site</footer></body></html>"
)


@pytest.fixture(scope="module")
def weights():
    counts = token_counts(PAGE.replace("{}", ARTICLE))
    return weights_from(*({k: 500 * v for k, v in c.items()} for c in counts))


def test_article_is_found_whole(weights):
    assert main_text(PAGE.replace("{}", ARTICLE), weights) == TEXT


def test_parts_that_are_never_content(weights):
    inner = ARTICLE.replace("<ul>", '<div class="ad banner">Buy this now</div><figure><svg><text>x</text></svg></figure><ul>')
    inner = inner.replace("</article>", '<div id="disqus_thread" class="comments"><p>Nice post</p></div></article>')
    assert main_text(PAGE.replace("{}", inner), weights) == TEXT


@pytest.mark.parametrize(
    "opening",
    [
        '<div style="overflow:hidden">', '<div class="overflow-hidden prose">', '<a href="/hidden-city">', '<div hidden="until-found">',
        '<div data-id="share-3">', '<a href="?id=search">', "<a href=?id=search>", '<div title="class=ad">', '<div aria-hidden="false">',
        '<div class="content no-sidebar">', '<div class="site-content sidebar-right">', '<div class="post comments-open">', "<math>",
        '<div style="backface-visibility:hidden">', '<div data-state="display:none">',
    ],
)
def test_words_inside_attributes_leave_nothing_out(weights, opening):
    inner = f"{opening}Words that stay</{opening[1:].split()[0].rstrip('>')}>"
    assert main_text(f"<p>One two</p>{inner}", {}).split() == "One two Words that stay".split()
    marked = PAGE.replace("{}", ARTICLE.replace("<p>End.</p>", f"<p>End.</p>{inner}<p>Last.</p>"))
    assert main_text(marked, weights).split() == f"{TEXT} Words that stay Last.".split()


@pytest.mark.parametrize(
    "attributes",
    [
        "hidden", 'id="x" HIDDEN class="y"', 'hidden=""', 'aria-hidden="true"', "aria-hidden=true", 'style="color:red; display : none"',
        "style='visibility:hidden !important;'", 'class="box ad"', 'id="comments"', 'id="comment-12"', "class=sidebar", 'role="search"',
        'class="cookie_banner"', 'title="a > b" class="x"class="y" id="disqus_thread"',
    ],
)
def test_attributes_that_are_never_content(attributes):
    want = "One two three four five\nsix seven eight nine ten"
    assert main_text(f"<p>One two three four five</p><div {attributes}>Words left out</div><p>six seven eight nine ten</p>", {}) == want


def test_open_and_stray_tags(weights):
    cut = PAGE.replace("{}", ARTICLE.replace("</b>", "").replace("</li>", "").replace("</article>", "</span></article>"))
    assert main_text(cut, weights) == TEXT
    assert main_text(cut[: cut.index("</footer>")], weights) == TEXT
    unclosed = "<nav><a>Menu</a><article><p>Words of the article stay here.</p></article>"
    assert main_text(unclosed, weights) == "Words of the article stay here."


def test_weights_have_their_signs(weights):
    assert weights["words"] > 0
    assert all(w < 0 for name, w in weights.items() if name != "words")
    assert weights["article"] < weights["p"]


def test_pages_without_marks():
    assert main_text("Just some plain words", {}) == "Just some plain words"
    assert main_text("", {}) == main_text("<p></p><br>", {}) == main_text("<script>a b c", {}) == ""
    assert main_text("<p>1 < 2 and 3 > 2 &lt;b&gt;</p>", {}) == "1 < 2 and 3 > 2 <b>"


def test_rows_columns_and_edge_cases(spark):
    rows = [(i, f"u{i}", PAGE.replace("{}", ARTICLE), "mine") for i in range(5)]
    rows += [(5, None, None, "x"), (None, "u", "", None), (0, "u0", "<p>" + "long words " * 50_000 + "</p>", "y")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string").withColumn("_row", F.lit(1))
    found = extract_main_text(df)
    assert found.columns == ["page_id", "url", "html", "_row", "text", "n_chars"]
    got = found.collect()
    assert len(got) == 8
    assert sum(r["text"] == TEXT for r in got) == 5
    assert sorted(r["n_chars"] for r in got)[:2] == [0, 0]
    assert max(r["n_chars"] for r in got) == 50_000 * 11 - 1
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert extract_main_text(df.limit(0)).count() == 0


def test_given_pages_by_their_marks(spark):
    import re
    from html import unescape

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for row in extract_main_text(pages).collect():
        marked = re.search(r"<article>(.*?)</article>", row["html"], re.S)[1]
        parts = re.split(r"</?(?:p|h1|br)>", marked)
        lines = (" ".join(unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in parts)
        assert row["text"] == "\n".join(line for line in lines if line)


@pytest.mark.parametrize(
    "html",
    [
        "<a " * 350_000, "<a \"\" " * 150_000 + "\"x>", "<a " * 350_000 + "\"", "<div>" * 60_000 + "</b>" * 60_000,
        "<script>" + "</script " * 120_000, "<!" * 500_000, "<a ' " * 200_000 + ">", "<a" + "\"'" * 400_000,
    ],
)
def test_broken_pages_take_linear_time(html):
    started = time.process_time()
    assert sum(1 for _ in content.page_tokens(html)) >= 0
    assert time.process_time() - started < 5


def plain_marks(html):
    """Tags, comments and declarations by one pattern that looks ahead to the end each time."""
    token = re.compile(
        r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
        r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>",
        re.S,
    )
    return [(m.start(), m.end(), m["tag"], m["close"] == "/", m["rest"] or "") for m in token.finditer(html)]


def test_marks_are_found_as_by_pattern():
    rng = random.Random(3)
    parts = ["<", ">", '"', "'", "a", "/", " ", "!", "div", "<a ", "</a>", "<!--", "-->", "<p>", 'x="', "=", "?", "<![CDATA[", "]]>", "\n"]
    for _ in range(20_000):
        html = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 25)))
        markup, at, found = content._Markup(html), 0, []
        while at < len(html) and (mark := markup.next(at))[0] < len(html):
            found.append(mark)
            at = mark[1]
        assert found == plain_marks(html), html
