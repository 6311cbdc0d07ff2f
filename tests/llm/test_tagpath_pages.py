"""Comments, forms, nested spans, pages without an article element, and very deep markup."""

import time

import pytest

from tessera.llm.tagpath import main_text

BODY = "<h1>Head</h1><p>A first paragraph, long enough to count. It has points, too.</p><p>A second one; it goes on for a while, as texts do.</p>"
TEXT = "Head A first paragraph, long enough to count. It has points, too. A second one; it goes on for a while, as texts do."
RICH = "<p>" + "I disagree, strongly; and at length. " * 30 + "</p>"


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<article>{BODY}<div id='comments'>{RICH}</div></article>", TEXT),
        (f"<article>{BODY}<section class='comments-area wide'>{RICH}</section></article>", TEXT),
        (f"<article>{BODY}<ol class='commentlist'><li>{RICH}</li></ol><div id=disqus_thread>{RICH}</div></article>", TEXT),
        (f"<body><div>{BODY}</div><div class='post-comments'>{RICH}</div></body>", TEXT),
        (f"<body><div class='has-comments'><article>{BODY}</article></div></body>", TEXT),
        (f"<body><div class='comments-open'>{BODY}</div></body>", TEXT),
        (f"<body><form id=aspnetForm><div>{BODY}</div></form></body>", TEXT),
        (f"<body><form id=aspnetForm><article>{BODY}</article><div class=ad>Buy.</div></form></body>", TEXT),
        (f"<article>{BODY}<form action='/s'><label>Your name, please.</label><input><button>Send</button></form></article>", TEXT),
        (f"<body><div>{BODY}</div><form><p>Write to us. We answer.</p></form></body>", TEXT),
        (f"<article>{BODY}<p><span class=ad><span>Buy</span> now</span></p></article>", TEXT),
        (f"<article>{BODY}<p>One <span class=note>two <span>three</span></span> four.</p></article>", TEXT + " One two three four."),
        (f"<article>{BODY}<p>One <span class=ad>open</p></article>", TEXT + " One open"),
        # no article or main element: the paths' ratios decide
        (f"<body><ul><li>Home</li><li>Terms</li></ul><div>{BODY}</div></body>", TEXT),
        (f"<body><table><tr><td>{BODY}</td><td><ul><li><a href=/>One</a></li><li><a href=/>Two</a></li></ul></td></tr></table></body>", TEXT),
    ],
)
def test_pages(page, text):
    assert main_text(page) == text


def test_ratios_choose_the_container_where_no_name_does():
    prose = "<p>" + "Prose, of some length; with points. " * 6 + "</p>"
    page = f"<body><table><tr><td>Menu</td><td>Shop</td><td>Cart</td></tr></table><section>{prose * 4}</section><center>Copyright</center></body>"
    assert main_text(page) == " ".join(["Prose, of some length; with points. " * 5 + "Prose, of some length; with points."] * 4)


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "deep. Text, here." + "</div>" * 100_000, "<div>x, y.<p>" * 50_000, "<ul><li>a, b." * 30_000 + "</ul>" * 30_000, "<div class='comments'>" * 50_000 + "t, u." + "</p>" * 1000])
def test_deep_markup_takes_time_in_proportion_to_its_length(page):
    began = time.thread_time()
    assert main_text(page)
    assert time.thread_time() - began < 6
