"""Entities inside runs of digit groups that are no card as a whole."""

from __future__ import annotations

import pytest

from kithgraph.llm import pii


@pytest.mark.parametrize("text,want", [
    ("4111 1111 1111 1111 123", [("4111 1111 1111 1111", "card")]), ("12 4111111111111111", [("4111111111111111", "card")]),
    ("12-4111111111111111", [("4111111111111111", "card")]), ("4111-1111-1111-1111-123456", [("4111-1111-1111-1111", "card")]),
    ("2024-4111111111111111", [("4111111111111111", "card")]), ("7 12 4111 1111 1111 1111 9 8", [("4111 1111 1111 1111", "card")]),
    ("415-555-1234 100 Main", [("415-555-1234", "phone")]), ("10 415-555-1234 100 Main", [("415-555-1234", "phone")]),
    ("4111 1111 1111 1111 5500 0000 0000 0004", [("4111 1111 1111 1111", "card"), ("5500 0000 0000 0004", "card")]),
    ("4111 1111 1111 1112 123", []), ("x4111111111111111", []), ("4111111111111111.5", []), ("1 " * 20_000, [])])
def test_runs(text, want):
    assert [(text[s:e], kind) for s, e, kind, _ in pii.detect(text)] == want


def test_nothing_of_the_card_stays():
    new, n = pii.rewrite("card 4111 1111 1111 1111 123, once more 12 4111111111111111", lambda *_: 0)
    assert n == 2 and "4111 1111" not in new and "41111111" not in new and new.startswith("card 4") and " 123, once more 12 4" in new
