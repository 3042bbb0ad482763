"""Bare names of licenses, and every match of a window."""

import pytest

from courtflux.llm import licenses


@pytest.mark.parametrize(
    "text, want",
    [
        ("under the MIT Licence here", [("mit", 2, 3, 1)]),
        ("Apache Licence, Version 2.0", [("apache", 0, 1, 1)]),
        ("the GNU Generl Public Licence", [("gpl", 1, 4, 2)]),
        ("CC BY", [("cc-by", 0, 1, 0)]),
        ("MIT Licence MIT License", [("mit", 0, 1, 1), ("mit", 2, 3, 0)]),
        ("submit license under its license; written in C by me", []),
        ("released under teh mit license released under the mit license", [("mit", 0, 4, 2), ("mit", 5, 9, 0)]),
        ("released under the mit license released under teh mit license", [("mit", 0, 4, 0), ("mit", 5, 9, 2)]),
    ],
)
def test_spans(text, want):
    assert [(s.label, s.first_word, s.last_word, s.edits) for s in licenses.scan(text.encode())[2]] == want
