"""Hand-made pages with and without article tags: each gives its article and nothing of the page around it."""

import pytest

from chronoweave.llm import html_text

LONG = ("It snowed in the north today and the roads were closed for hours while people waited, said the mayor, who asked everybody to stay at "
        "home until the evening came and the ploughs had cleared the main streets of the town and of the villages around it.")
MORE = "By nightfall most of the buses ran again, and the schools said that lessons would start an hour later than usual on the next morning."
NAV = '<nav><a href="/">Home</a> <a href="/news">News</a> <a href="/about">About us</a></nav>'
FOOT = '<footer><p>Copyright of the town paper. All rights reserved.</p></footer>'
COMMENTS = "".join(f'<article class="comment-body"><p>Reader {i} wrote that snow is nothing new in the north and that everybody should have winter tyres by now.</p></article>' for i in range(8))
TWO = f"<p>{LONG}</p><p>{MORE}</p>"

#: page, and its text blocks
PAGES = [
    (f'<div id="page" class="site has-sidebar">{TWO}</div>', [LONG, MORE]),
    (f'<div class="post comments-open">{TWO}</div>', [LONG, MORE]),
    (f'<div class="post category-legal">{TWO}</div>', [LONG, MORE]),
    (f'<section class="entry-content share-enabled">{TWO}</section>', [LONG, MORE]),
    (f'<p title="The hidden valley">{LONG}</p>', [LONG]),
    (f'<div data-state="hidden"><p>{LONG}</p></div>', [LONG]),
    (f'<div data-id="promo"><p>{LONG}</p></div>', [LONG]),
    (f'<div title="class=advert"><p>{LONG}</p></div>', [LONG]),
    (f'<body><form action="page.do">{NAV}<h1>Snow</h1>{TWO}{FOOT}</form></body>', ["Snow", LONG, MORE]),
    (f"<body><form>{TWO}</form></body>", [LONG, MORE]),
    ("<body><div><h1>Snow falls</h1><p>It snowed in the north today.</p></div></body>", ["Snow falls", "It snowed in the north today."]),
    ("<body><p>He said so.</p></body>", ["He said so."]),
    (f"<body>{NAV}<p>{LONG}</p>{FOOT}</body>", [LONG]),
    (f"<body>{NAV}<article><p>{LONG}</p></article>{FOOT}</body>", [LONG]),
    (f'<body>{NAV}<article><p>{LONG}</p></article><section class="comments">{COMMENTS}</section>{FOOT}</body>', [LONG]),
    (f'<body>{NAV}<main><p>{LONG}</p></main><div id="disqus_thread">{COMMENTS}</div></body>', [LONG]),
    (f'<article class="post has-comments"><p>{LONG}</p></article>', [LONG]),
    (f'<body class="no-sidebar single-post"><p>{LONG}</p></body>', [LONG]),
    (f'<div class="wrapper menu-open"><h1>Snow</h1><p>{LONG}</p></div>', ["Snow", LONG]),
    (f'<article><p>{LONG}</p><div class="related-posts"><p>Read about rain in the south, which was heavy all week.</p></div></article>', [LONG]),
    (f'<article><p>{LONG}</p><aside><p>Subscribe to our paper for the price of a coffee.</p></aside><p>{MORE}</p></article>', [LONG, MORE]),
    (f'<div class="cookie-notice"><p>We use cookies to make this page better for you and for our partners.</p></div><article><p>{LONG}</p></article>', [LONG]),
    (f'<article><p>{LONG}</p><p hidden>{MORE}</p></article>', [LONG]),
    (f'<article><p>{LONG}</p><div style="display: none"><p>{MORE}</p></div></article>', [LONG]),
    (f'<article><p aria-hidden="true">{MORE}</p><p>{LONG}</p></article>', [LONG]),
    (f'<article><p data-hidden="hidden" aria-hidden="false">{LONG}</p></article>', [LONG]),
    (f'<head><title>x</title><body><article><p>{LONG}</p></article>', [LONG]),
    (f'<article><p>{LONG}</p><svg width=1 /><p>{MORE}</p></article>', [LONG, MORE]),
    ("<body></body>", []),
    (f"<body>{NAV}{FOOT}</body>", []),
    ('<body><nav><a href="/">Home</a></nav><div class="cookie-bar">We use cookies.</div><form><label>Name</label></form></body>', []),
]


@pytest.mark.parametrize("page,texts", PAGES)
def test_page(page, texts):
    assert html_text.main_text(page, html_text.train()) == "\n\n".join(texts)


def test_deep_and_long_pages():
    deep = "<div>" * 20_000 + f"<p>{LONG}</p>"
    assert html_text.main_text(deep, html_text.train()) == LONG
    attributes = "<p " + "a='x' " * 50_000 + f">{LONG}</p>" + "<p =\"'" * 2_000
    assert LONG in html_text.main_text(attributes, html_text.train())
