"""Quotes in attributes."""

import pytest

from tessera.llm.tagpath import main_text


@pytest.mark.parametrize(
    "page, text",
    [
        ("<article><p>First</p><p data-x=it's>Second</p><p>Third</p></article>", "First Second Third"),
        ("<article><p title='a > b'>First</p><p title = \"it's > that\">Second</p></article>", "First Second"),
        ('<article><p data-x=5">First</p><p>Second</p></article>', "First Second"),
    ],
)
def test_a_quote_opens_a_value_only_after_an_equals_sign(page, text):
    assert main_text(page) == text
