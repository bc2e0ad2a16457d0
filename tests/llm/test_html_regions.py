"""Pages whose articles no element or word marks, words that only look like marks, siblings, and time in proportion to length."""

import time

import pytest

from parcelry.llm.html_text import main_text

LONG = "The quick brown fox jumps over the lazy dog and then goes on for quite some time about it. " * 4
LONG = LONG.strip()
LINKS = "".join(f"<a href=/{i}>Menu entry {i}</a> " for i in range(12))
ITEMS = "".join(f"<li><a href=/{i}>Menu entry {i}</a></li>" for i in range(9))


@pytest.mark.parametrize(
    "page",
    [
        f"<div id=top>{LINKS}</div><div class=body><p>{LONG}</p><p>short</p><p>{LONG}</p></div><div class=legal>All rights reserved</div>",
        f"<ul class=topbar>{ITEMS}</ul><div><p>{LONG}</p><p>short</p><p>{LONG}</p></div><p>All rights reserved</p>",
        f"<table><tr><td>{LINKS}</td><td><p>{LONG}</p><p>short</p><p>{LONG}</p></td></tr><tr><td>All rights reserved</td></tr></table>",
        f"<html><body><ul>{ITEMS}</ul><p>{LONG}</p><p>short</p><p>{LONG}</p></body></html>",
        f"<div><div>{LINKS}</div><div><div><p>{LONG}</p><p>short</p></div><div><p>{LONG}</p></div></div></div>",
    ],
)
def test_pages_without_marks(page):
    assert main_text(page) == f"{LONG} short {LONG}"


def test_headings_before_unmarked_text_stay():
    assert main_text(f"<body><ul>{ITEMS}</ul><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></body>") == f"Title {LONG} {LONG}"
    assert main_text(f"<div>{LINKS}</div>") != "" and main_text("<div></div>") == "" and main_text("<p>one") == "one"


def test_words_of_sections_mark_nothing():
    kept = "".join(f"<div class='{c}'>{c} text</div>" for c in ("related-work", "social-history", "ad-hoc", "form_of_life"))
    gone = "".join(f"<div class='{c}'>gone</div>" for c in ("related-posts", "share-buttons", "ad", "ad-slot-2", "post comments", "newsletter-box"))
    assert main_text(f"<article><p>{LONG}</p>{kept}{gone}<p>{LONG}</p></article>") == f"{LONG} related-work text social-history text ad-hoc text form_of_life text {LONG}"


def test_sibling_articles():
    assert main_text(f"<body><nav>{ITEMS}</nav><article><p>{LONG} {LONG}</p></article><article><p>{LONG}</p></article><footer>x</footer></body>") == f"{LONG} {LONG} {LONG}"
    assert main_text(f"<article><p>{LONG} {LONG} {LONG}</p></article><article>{ITEMS}</article>") == f"{LONG} {LONG} {LONG}"


@pytest.mark.parametrize("piece", ["<article>x", "<div class=ad>x", "<div><p>some text here</p>", "<a href='x'>y", "<li>z<ul>"])
def test_a_megabyte_of_open_elements(piece):
    def took(n):
        began = time.process_time()
        main_text(piece * (n // len(piece)))
        return time.process_time() - began

    took(10_000)
    assert took(1_000_000) < 5 and took(1_000_000) < 8 * max(took(250_000), 0.05)
