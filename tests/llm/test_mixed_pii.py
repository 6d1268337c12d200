"""Addresses with plain, bracketed and spoken marks in all mixes."""

import itertools

import pytest

from chalkline.llm import pii

ATS, DOTS = ("@", " (at) ", " at "), (".", " [dot] ", " dot ")


@pytest.mark.parametrize("at, dot", itertools.product(ATS, DOTS))
@pytest.mark.parametrize("host", [("example", "com"), ("mail", "example", "co", "uk")])
@pytest.mark.parametrize("local", [("jane",), ("john", "doe"), ("j", "o", "e"), ("x" * 90,)])
def test_mixes(at, dot, host, local):
    for inner in DOTS:
        address = inner.join(local) + at + dot.join(host)
        if at == " at " and dot == "." and (len(local) == 1 or inner == "."):
            continue  # as prose has it
        assert pii.redacted(f"mail {address}, now") == "mail [EMAIL], now", address


def test_prose_stays_and_old_forms_hold():
    for t in ("look at example.com now", "a dot here and @ there", "the dot dot dot at noon", "we met at noon. a dot here"):
        assert pii.redacted(t) == t
    assert pii.redacted("the dot at example dot com") == "the [EMAIL]"
    assert pii.redacted("jane@exаmple dot com") == "[EMAIL]"
    assert pii.redacted("a dot " * 100_000 + "b") == "a dot " * 100_000 + "b"  # read once
