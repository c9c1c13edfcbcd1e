import re

import duckdb
import pytest

from lexiforge.llm import html as module
from lexiforge.llm.html import extract, main_text, op7_html_extraction, surges

WORDS = "word " * 30


def test_article_between_boilerplate():
    page = f"""<!doctype html><html><head><title>T</title><style>p{{}}</style><script>var x="</p>";</script></head><body>
    <header>Site</header><nav><ul><li><a href=x>Home</a><li>News</ul></nav><div class="ad">Buy {WORDS}</div>
    <article><h1>Head &amp; more</h1><p>{WORDS}<p>Short.<br>line &lt;b&gt;<p><b>Bold<br><p>{WORDS}</article>
    <div id="comments"><p>{WORDS}</p></div><form>Mail <input></form><footer>&copy; me</footer></body></html>"""
    text = main_text(page)
    assert text.split("\n\n") == ["Head & more", WORDS.strip(), "Short. line <b>", "Bold", WORDS.strip()]


def test_without_semantic_elements():
    page = f"<body><div><a>One</a></div><div><p>{WORDS}</p><p>Tiny</p><p>{WORDS}</p></div><div>x</div></body>"
    assert main_text(page).split("\n\n") == [WORDS.strip(), "Tiny", WORDS.strip()]


A, B, C, TINY = "alpha " * 30, "beta " * 20, "gamma " * 15, "The end."


@pytest.mark.parametrize(
    "body",
    [
        f"<article><section><p>{A}</section><section><p>{B}</section><section>{C}</section><div>{TINY}</div></article>",
        f"<main><div><div><p>{A}</div></div><section>{B}</section><div><p>{C}</div><p>{TINY}</main>",
        f"<div class=post><div>{A}</div><div>{B}</div><div>{C}</div><div>{TINY}</div></div>",
        f"<div class=post><section><p>{A}<p>{B}</section><section><p>{C}<p>{TINY}</section></div>",
        f"<div class=wrap><div class=post><div><div>{A}</div></div><div>{B}</div><div>{C}</div><div>{TINY}</div></div></div>",
        f"<article><table><tr><td>{A}<td>{B}</tr><tr><td>{C}<td>{TINY}</table></article>",
        f"<div><table><tr><td>{A}</td><td>{B}</td></tr><tr><td>{C}</td><td>{TINY}</td></tr></table></div>",
    ],
)
def test_article_of_sibling_blocks(body):
    page = f"<body><nav>Home</nav><div><a>One</a></div>{body}<div>x</div></body>"
    assert main_text(page).split("\n\n") == [A.strip(), B.strip(), C.strip(), TINY]


def test_paragraph_divisions_of_the_page():
    page = f"<body><div><a>One</a></div><div>{A}</div><div>{TINY}</div><div>{B}</div><div>x</div></body>"
    assert main_text(page).split("\n\n") == [A.strip(), TINY, B.strip()]


def test_articles_stay_apart():
    page = f"<body><main><article><section>{A}</section><section>{B}</section></article><article>{C}</article></main></body>"
    assert main_text(page).split("\n\n") == [A.strip(), B.strip()]


@pytest.mark.parametrize("page", [None, "", "<p>", "<!-- x", "<script>x", "<nav>Home</nav>", "   \n"])
def test_empty(page):
    assert main_text(page) == ""


def test_odd_markup_does_not_fail():
    for page in ("<p>a</b></i>c<p", "a < b", "<div " * 50, "<p title='>'>x</p>", "&#xFFFFFF;&bogus;", "<![CDATA[x <y>]]>"):
        main_text(page)
    assert main_text("<p title='>'>x</p>") == "x"


@pytest.mark.parametrize("name", ["legal", "notice", "related", "share-list", "copyright", "with-sidebar", "has-comments", "no-footer"])
@pytest.mark.parametrize("tag", ["article", "div"])
def test_misleading_names(name, tag):
    if tag == "div" and set(name.split("-")) & module._BAD_WORDS:
        pytest.skip("only an article tells that such a name misleads")
    page = f"<body><div><a>One</a></div><div class={name}><{tag}><p>{A}</p><p>{TINY}</p><p>{B}</p></{tag}></div><div class={name}>{TINY} Again.</div></body>"
    assert main_text(page).split("\n\n") == [A.strip(), TINY, B.strip()]


def test_long_comments_and_sidebars_with_articles_go():
    page = f"<body><article><p>{B}<p>{TINY}</article><div id=comments><article><p>{A}{A}{A}</article></div><aside><article>{A}{B}</article></aside></body>"
    assert main_text(page).split("\n\n") == [B.strip(), TINY]


def test_an_advert_inside_an_article_goes_and_what_follows_stays():
    page = f"<body><article><p>{A}</p><div class=ad><p>{B}</div><p>{C}<ul><li><a href=x>one</a><li><a href=y>two</a><li><a>three</a></ul><p>{TINY}</article></body>"
    assert main_text(page).split("\n\n") == [A.strip(), C.strip(), "one", "two", "three", TINY]


def test_link_lists_do_not_surge():
    links = "".join(f"<li><a href=x{i}>A rather long headline number {i} of another page of this site</a>" for i in range(40))
    page = f"<body><div><ul>{links}</ul></div><div><p>{A}<p>{TINY}</div><div><ul>{links}</ul></div></body>"
    assert main_text(page).split("\n\n") == [A.strip(), TINY]


def test_surges_and_dives_decide(monkeypatch):
    """Everything as one text, without surge and dive: pages with articles and without them come out wrong."""
    plain = f"<body><div><a>One</a></div><div><p>{A}</p><p>{TINY}</p></div><div>x</div></body>"
    pages = [html for (html,) in duckdb.sql("SELECT html FROM '/root/testdata/sf0.001/pages.parquet' LIMIT 20").fetchall()]
    right = [main_text(p) for p in (plain, *pages)]
    monkeypatch.setattr(module, "surges", lambda lengths, window, surge: [(0, len(lengths))])
    assert all(main_text(p) != text for p, text in zip((plain, *pages), right, strict=True))


def test_a_very_long_page():
    body = "".join(f"<p>{A}{i}</p>" for i in range(20_000))
    assert main_text(f"<body><nav>Home</nav><article>{body}</article></body>").count("\n\n") == 19_999
    assert len(main_text(f"<div>{'word ' * 500_000}</div>")) == 2_499_999


def test_ties_take_the_first_text():
    page = f"<body><main><article>{A}</article><article>{'omega ' * 30}</article></main></body>"
    assert main_text(page) == A.strip()


def test_surges():
    assert surges([0, 0, 100, 0, 0, 0, 0, 50, 80, 0], window=2, surge=60) == [(1, 3), (7, 9)]


def test_rows(spark):
    pages = spark.createDataFrame([(1, "u", None, "x"), (1, "u", "<p>hi é", "x"), (None, None, "<p>hi é", "x")], "page_id long, url string, html string, text string")
    assert sorted((r["text"], r["n_chars"]) for r in extract(pages).collect()) == [("", 0), ("hi é", 4), ("hi é", 4)]
    assert extract(pages.limit(0)).count() == 0


def test_equals_the_article_of_the_pages(spark):
    """The pages' articles by a plain rule of their own layout: what is between the article's tags, block by block."""
    got = {r["page_id"]: r["text"] for r in op7_html_extraction(spark, "/root/testdata/sf0.01").collect()}
    import html

    for i, page in duckdb.sql("SELECT page_id, html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall():
        body = re.search(r"<article[^>]*>(.*?)(</article>|<footer|\Z)", page, re.DOTALL)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br\s*/?>", " ", b)))).strip() for b in re.split(r"</?(?:p|h1|h2|h3|ul|li|div|blockquote|table|tr|td)\b[^>]*>", body)]
        assert got[i] == "\n\n".join(b for b in blocks if b), (i, page[:3000])
