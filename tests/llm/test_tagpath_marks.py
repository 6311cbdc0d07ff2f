"""Words for boilerplate in class, id and role, as evidence."""

import pytest

from tessera.llm.tagpath import main_text

BODY = "<h1>Head</h1><p>A first paragraph, long enough to count. It has points, too.</p><p>A second one; it goes on for a while, as texts do.</p>"
TEXT = "Head A first paragraph, long enough to count. It has points, too. A second one; it goes on for a while, as texts do."
REFERENCES = "<ul><li><a href='/1'>Smith, J. On things. 1999.</a></li><li><a href='/2'>Jones, K. On more. 2001.</a></li></ul>"


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<body><div class='layout has-sidebar'><article>{BODY}</article></div></body>", TEXT),
        (f"<body><div id='search-result'><article>{BODY}</article></div></body>", TEXT),
        (f"<body><div class='search'><article>{BODY}</article></div></body>", TEXT),
        (f"<body><div class='social'>{BODY}</div></body>", TEXT),
        ("<article><div class='post-header'><h1>Head</h1></div><p>Some text, with points.</p></article>", "Head Some text, with points."),
        (f"<article>{BODY}<div class='related-work'><p>Others did this, and that.</p></div></article>", TEXT + " Others did this, and that."),
        (f"<article>{BODY}{REFERENCES}</article>", TEXT + " Smith, J. On things. 1999. Jones, K. On more. 2001."),
        (f"<body>{BODY}{REFERENCES}</body>", TEXT + " Smith, J. On things. 1999. Jones, K. On more. 2001."),
        # marks still tell
        (f"<article>{BODY}<div class='ad'>Buy now</div></article>", TEXT),
        (f"<article>{BODY}<div hidden>unseen, unheard. It isn't shown.</div></article>", TEXT),
        (f"<body><article>{BODY}</article><div class='comments'><p>{'I disagree, strongly. ' * 40}</p></div></body>", TEXT),
        (f"<body><div>{BODY}</div><div class='menu'><ul><li><a href='/'>Home</a></li></ul></div></body>", TEXT),
    ],
)
def test_marks_are_evidence(page, text):
    assert main_text(page) == text
