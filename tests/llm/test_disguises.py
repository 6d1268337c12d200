"""Disguised personal data in further forms, and prose that is none."""

import pytest

from chalkline.llm import pii


def found(text):
    return [(pii.KINDS[k], text[s:e]) for s, k, e, _ in pii.find(text)]


@pytest.mark.parametrize(
    ("text", "kind", "part"),
    [
        ("mail jane (a) example . com now", "email", "jane (a) example . com"), ("mail jane @ example . com now", "email", "jane @ example . com"),
        ("to jane&#64;example.com.", "email", "jane&#64;example.com"), ("u=jane%40example.com&x", "email", "jane%40example.com"),
        ("jane\nat\nexample\ndot\ncom", "email", "jane\nat\nexample\ndot\ncom"), ("jane  at  example  dot  com", "email", "jane  at  example  dot  com"),
        ("escribe a jane arroba ejemplo punto com hoy", "email", "jane arroba ejemplo punto com"), ("jane chez exemple point fr", "email", "jane chez exemple point fr"),
        ("jane at beispiel punkt de", "email", "jane at beispiel punkt de"), ("host 192 point 168 point 1 point 5 is up", "ip", "192 point 168 point 1 point 5"),
        ("ip 10 dot 0\ndot 0 punkt 7", "ip", "10 dot 0\ndot 0 punkt 7"),
        ("call +1 (four one five) five five five, one two three four", "phone", "+1 (four one five) five five five, one two three four"),
        ("plus four nine one seven double five three four six two", "phone", "plus four nine one seven double five three four six two"),
        ("plus one\nfour one five\nfive five five\none two three four", "phone", "plus one\nfour one five\nfive five five\none two three four"),
    ],
)
def test_disguised(text, kind, part):
    assert found(text) == [(kind, part)]


@pytest.mark.parametrize(
    "text",
    [
        "je suis chez Marie point final", "we met @ noon . Then we left", "look at example.com", "see (a) the first. and (b) the rest", "the point at issue is this",
        "am Punkt drei", "one, two, three", "the double of it", "auf den punkt gebracht", "at the dot of ten", "50%40 is no address", "un punto de vista", "1 point 5 million", "chez nous point de vue",
    ],
)
def test_prose_is_left_alone(text):
    assert found(text) == []
