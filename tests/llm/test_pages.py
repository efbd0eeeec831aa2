"""Pages whose page-wide elements have names of boilerplate, and heads that never end."""

from __future__ import annotations

import pytest

from corpusmill.llm import op8_html

TEXT = "Storm shuts the harbour\nThe harbour closed early as the storm came in, and crews tied up all the boats they could find.\nBy night the wind had torn two roofs off, the keeper of the light said on Monday."
TITLE, *PARAGRAPHS = TEXT.split("\n")
ARTICLE = f"<article><h1>{TITLE}</h1>" + "".join(f"<p>{p}</p>" for p in PARAGRAPHS) + "</article>"
MENU = '<nav><a href="/">Home</a> <a href="/n">News</a></nav>'
END = "<footer>All rights reserved</footer>"
PAGES = [
    f'<html><head><title>t</title></head><body class="has-sidebar">{MENU}{ARTICLE}{END}</body></html>',
    f'<body>{MENU}<div class="page with-comments">{ARTICLE}</div>{END}</body>',
    f'<body>{MENU}<main id="share-story">{ARTICLE}</main>{END}</body>',
    f'<body><form id="aspnetForm" action="/x">{MENU}{ARTICLE}{END}</form></body>',
    f"<html><head><title>t</title><body>{MENU}{ARTICLE}{END}</body></html>",
    f"<html><head><title>t</title><meta charset=utf-8>{MENU}{ARTICLE}{END}",
    f'<body>{MENU}<div class="comments-page">{ARTICLE}</div>{END}</body>',
    f'<body>{MENU}{ARTICLE}<aside><article><p>Read more of our stories about boats and storms here, all of them for free.</p></article></aside>{END}</body>',
    f'<body>{MENU}{ARTICLE}<section class="comments"><article class="comment"><p>I was there that night, and it was loud, as you would think it was.</p></article></section>{END}</body>',
]


@pytest.mark.parametrize("fitted", [False, True])
def test_articles_in_wide_elements(spark, fitted):
    df = spark.createDataFrame([(i, "u", p) for i, p in enumerate(PAGES)], "page_id long, url string, html string")
    model = op8_html.fit(spark.createDataFrame([(i, "u", p) for i, p in enumerate(PAGES * 3)], df.schema)) if fitted else None
    got = {r.page_id: r.text for r in (op8_html.extract(df, model=model) if fitted else op8_html.extract(df)).collect()}
    assert got == dict.fromkeys(range(len(PAGES)), TEXT)


def test_a_page_of_a_form_alone_is_judged_by_its_looks():
    (block,) = op8_html.blocks(f"<form><p>{PARAGRAPHS[0]}</p></form>")
    assert block.place == op8_html.PLAIN
    places = [b.place for b in op8_html.blocks(f"<form><p>Your name</p></form><p>{PARAGRAPHS[0]}</p>")]
    assert places == [op8_html.OUTSIDE, op8_html.PLAIN]
