"""Pages whose class words mislead, and pages of few or strange elements."""

import pytest

from paperspark.llm.html_text import main_text

LONG = "A long plain paragraph of words that says something about its subject. " * 3
BODY = f"<h1>Title of it</h1><p>{LONG}</p><p>{LONG}</p>"
WANT = f"Title of it {LONG.strip()} {LONG.strip()}"
AROUND = "<nav><ul><li><a href=a>Home</a></li></ul></nav>{}<footer>About us</footer>"


@pytest.mark.parametrize("element", ["article class=\"post share-enabled\"", "div class=\"legal\"", "div class=\"tag-page\"",
                                     "div id=\"login\"", "main role=\"search\""])
def test_words_on_the_whole_page_do_not_empty_it(element):
    page = AROUND.format(f"<{element}>{BODY}</{element.split()[0]}>")
    assert main_text(page)[0] == WANT


@pytest.mark.parametrize("page,want", [
    ("<p>Hello world</p>", "Hello world"), ("bare text", "bare text"), ("<div>Short.</div><footer>x</footer>", "Short."),
    ("<nav><a href=x>Home</a></nav><footer>imprint</footer>", ""),
    # All of the page's text is in that element.
    ("<div class=ad>Buy now</div>", "Buy now"),
    ("<ul><li><a href=x>Home</a></li></ul>", "")])
def test_short_pages_keep_what_is_no_boilerplate(page, want):
    assert main_text(page)[0] == want


def test_a_link_that_is_not_closed_ends():
    page = f"<article><h1>Title of it</h1><p>{LONG}<a href=x>more</p><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></article>"
    text = main_text(page)[0]
    assert text.count("says something") == 12


@pytest.mark.parametrize("part", [
    f"<section class=\"discussion\"><p>{LONG}</p></section>", f"<div id=\"thread\"><p>{LONG}</p></div>",
    f"<div id=\"gdpr-box\"><p>{LONG}</p></div>", f"<div class=\"col-right rail\"><p>{LONG}</p></div>",
    f"<div id=\"disqus\"><p>{LONG}</p></div>"])
def test_readers_notices_and_rails_go(part):
    page = AROUND.format(f"<article>{BODY}</article>{part}")
    assert main_text(page)[0] == WANT
    # Also where they hold more text than the article.
    assert main_text(AROUND.format(f"<article>{BODY}</article>{part * 4}"))[0] == WANT


def test_very_long_page():
    page = "<article>" + f"<p>{LONG}</p>" * 20_000 + "</article>"
    assert main_text(page)[1:] == (20_000, 20_000)
