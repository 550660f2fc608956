"""Main text of pages with known parts."""

import html as markup

import pytest

from provspark.llm import html

PARAGRAPHS = [
    "The first paragraph is long enough, has commas, and tells what the article is about, at some length & more.",
    "A second one follows, with further clauses, so that the container gathers points from both of its children.",
    "Short.",
]
ARTICLE = "<h1>Title here</h1>" + "".join(f"<p>{markup.escape(p)}</p>" for p in PARAGRAPHS)
CHROME = (
    "<header><a href=/>Home</a><h2>Site name</h2></header><nav><ul><li><a href=/a>Menu</a></li></ul></nav>"
    "<div class='cookie-notice'>We use cookies, many of them, for all kinds of things, as is known.</div>"
)
AFTER = (
    "<aside><p>Related stories, of which there are many, and others, too.</p></aside><div id='comments'><p>I disagree, strongly, "
    "with all of this, and I write a long comment, with commas, to say so, again and again.</p></div>"
    "<form><p>Subscribe, please, now</p><input></form><div class='ad'>Buy, buy, buy</div><footer>&copy; us</footer>"
)
EXPECTED = "\n\n".join(["Title here", *PARAGRAPHS])


@pytest.mark.parametrize("open_, close", [("<article>", "</article>"), ("<div class='post-content'>", "</div>"), ("<main><div>", "</div></main>"), ("<div>", "</div>"), ("", "")])
def test_article_is_found(open_, close):
    page = f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{CHROME}{open_}{ARTICLE}{close}{AFTER}<script>var a='</p>';</script></body></html>"
    assert html.main_text(page) == EXPECTED


def test_siblings_of_the_best_container_are_kept():
    prose = "".join(f"<p>{markup.escape(p)}</p>" for p in PARAGRAPHS + PARAGRAPHS[:2])
    parts = [
        "<ul><li>First point</li><li>Second point</li></ul>", "<ol><li>One</li></ol>", "<dl><dt>Term</dt><dd>Meaning</dd></dl>",
        "<table><tr><th>Year</th><td>1990</td></tr></table>", "<figure><img src=x><figcaption>A view</figcaption></figure>",
        "<details><summary>More</summary>to read</details>", "Bare text with <b>bold</b> and <a href=x>one</a> link.", "<div><p>Short end.</p></div>",
    ]
    shown = ["First point", "Second point", "One", "Term", "Meaning", "Year", "1990", "A view", "More", "to read", "Bare text with bold and one link.", "Short end."]
    links = "<ul><li><a href=a>Another story</a></li><li><a href=b>And one more</a></li></ul><a href=c>Next page</a>"
    page = f"<body>{CHROME}<div><div>{prose}</div>{''.join(parts[:-1])}{parts[-1]}{links}</div>{AFTER}</body>"
    assert html.main_text(page) == "\n\n".join([*PARAGRAPHS, *PARAGRAPHS[:2], *shown])
    page = f"<body>{CHROME}<section>Before<table><tr><td>In a table</td></tr></table><section>{prose}</section></section>{links}</body>"
    assert html.main_text(page) == "\n\n".join(["Before", "In a table", *PARAGRAPHS, *PARAGRAPHS[:2]])


def test_broken_markup_and_references():
    page = "<body><nav><a href=x>m</a></nav><article><h1>A &amp; B</h1><p><b>One &quot;x&quot;,\n two<br><p>Three&nbsp;four &#233; &am"
    assert html.main_text(page) == 'A & B\n\nOne "x", two\n\nThree four é &am'


def test_defined_cases(spark):
    long = "<article>" + "<p>word, word</p>" * 50_000 + "</article>"
    deep = "<div>" * 20_000 + "<p>deep text, here</p>"
    rows = [(1, None, "x"), (2, "", "x"), (3, "plain", None), (4, long, "x"), (5, deep, "x"), (6, "<", "x"), (7, "<p>a</p>", "x"), (7, "<p>a</p>", "x")]
    df = spark.createDataFrame(rows, "page_id long, html string, main_text string")
    done = [(r.page_id, r.main_text) for r in html.extract_main(df).orderBy("page_id").collect()]
    assert done[0] == (1, "") and done[1] == (2, "") and done[2] == (3, "plain")
    assert done[3] == (4, "\n\n".join(["word, word"] * 50_000)) and done[4] == (5, "deep text, here")
    assert done[6] == done[7] == (7, "a")
    assert html.extract_main(df.limit(0)).count() == 0


PROSE = "".join(f"<p>{markup.escape(p)}</p>" for p in PARAGRAPHS + PARAGRAPHS[:2])
SHOWN = [*PARAGRAPHS, *PARAGRAPHS[:2]]
OTHER = "<p>Another article, of some length, with commas, and sentences that are long enough, follows here on the page.</p>"
OTHER_TEXT = "Another article, of some length, with commas, and sentences that are long enough, follows here on the page."


@pytest.mark.parametrize("inside, expected", [
    (f"<main><h1>Title</h1><p>Lead text</p><article>{PROSE}</article></main>", ["Title", "Lead text", *SHOWN]),
    (f"<article>{PROSE}</article><article>{OTHER * 3}</article>", [*SHOWN, *[OTHER_TEXT] * 3]),
    (f"<p>An intro of the page.</p><article>{PROSE}</article>", ["An intro of the page.", *SHOWN]),
    (f"<div id=w><div class=c1><div>{PROSE}</div></div><div class=c2>{OTHER}</div></div>", [*SHOWN, OTHER_TEXT]),
    (f"<main><article>{PROSE}</article><div>All rights are with us.</div></main>", SHOWN),
    (f"<main><article>{PROSE}</article><ul><li><a href=a>Older</a></li><li><a href=b>Newer</a></li></ul></main>", SHOWN),
])
def test_the_best_container_climbs(inside, expected):
    assert html.main_text(f"<body>{CHROME}{inside}{AFTER}</body>") == "\n\n".join(expected)


@pytest.mark.parametrize("part, shown", [
    ("<p class=form>The form of a poem.</p>", "The form of a poem."), ("<blockquote class=share>A share of it.</blockquote>", "A share of it."),
    ("<p>To <span class=search>search</span> is human.</p>", "To search is human."),
    (f"<div class=related-work><h2>Related work</h2>{OTHER}</div>", f"Related work\n\n{OTHER_TEXT}"),
    ("<div class=related><p>See also</p></div>", None), ("<div class=share-this><a href=x>Share this with all your friends at once</a></div>", None),
    (f"<div class=commentlist>{OTHER}</div>", None), (f"<div id=respond2>{OTHER}</div>", None), (f"<section class='comment-area-3'>{OTHER}</section>", None),
    ("<div class=notice><p>Notice: the site is closed on Monday, and on Tuesday, too, as it was in the past.</p></div>", None),
])
def test_names_inside_an_article(part, shown):
    for open_, close in (("<article>", "</article>"), ("<div>", "</div>")):
        page = f"<body>{CHROME}{open_}{PROSE}{part}<p>The end.</p>{close}{AFTER}</body>"
        assert html.main_text(page) == "\n\n".join([*SHOWN, *([shown] if shown else []), "The end."])
