"""A class or id word alone does not drop what holds most of a page's text."""
import pytest

from tessera.llm.html_text import main_text

TEXT = "The river rose in the night and the ferry stayed on the far bank until the wind had turned. " * 6
NAV = '<div class="sidebar"><a href="/a">One</a> <a href="/b">Two</a></div><div class="comments"><p>First! A short remark.</p></div>'


@pytest.mark.parametrize(
    "page",
    [
        f'<body><div class="content has-sidebar"><p>{TEXT}</p></div>{NAV}</body>',
        f'<body><div class="hentry comments-open"><article><p>{TEXT}</p></article></div>{NAV}</body>',
        f'<body><div id=page class="has-cookie-banner"><p>{TEXT}</p>{NAV}</div></body>',
    ],
)
def test_wrappers_stay(page):
    said = main_text(page)
    assert TEXT.strip() in said and "First!" not in said and "Two" not in said


def test_long_comments_go():
    said = main_text(f'<body><article><p>{TEXT}</p></article><div class="comments"><p>{"No, I disagree with all of it. " * 60}</p></div></body>')
    assert said == TEXT.strip()
