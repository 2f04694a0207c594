"""Disguised signs: nothing far away decides, and no label or length is left out."""

import random
import time

import pytest

from braidseq.llm.pii import disguised_spans, plain_spans


def added(text):
    return [(k, text[s:e]) for k, s, e in disguised_spans(text, plain_spans(text))]


FOUND = [
    ("write to john.doe at example.com", "email", "john.doe at example.com"),
    ("write to john_doe at example.com now", "email", "john_doe at example.com"),
    ("mail john@example . com", "email", "john@example . com"),
    ("host 10 . 0 . 0 . 7 up", "ip", "10 . 0 . 0 . 7"),
    ("an max.m ät firma.de", "email", "max.m ät firma.de"),
    ("mail jane dot doe at example.com", "email", "jane dot doe at example.com"),
    *[(f"mail john at example dot {top} now", "email", f"john at example dot {top}") for top in ("hu", "gr", "tr", "ua", "xyz", "online", "museum")],
    ("mail john arroba example punto nowhere", "email", "john arroba example punto nowhere"),
    ("a_b at example.hu", "email", "a_b at example.hu"),
    ("mail " + "part dot " * 40 + "end at example dot com", "email", "part dot " * 40 + "end at example dot com"),
]
NOTHING = ["look at example.com", "we stopped . He looked at example.com", "mail a@b.co . Then go", "see john@example . He said", "at this point we go", "he sat at the dot of noon", "arrived at that point is", "server 2 10.0.0.7 up"]


@pytest.mark.parametrize("text, kind, span", FOUND)
def test_disguises_are_found(text, kind, span):
    assert added(text) == [(kind, span)]


@pytest.mark.parametrize("text", NOTHING)
def test_prose_gains_nothing(text):
    assert added(text) == []


@pytest.mark.parametrize("text", [t for t, *_ in FOUND] + NOTHING)
@pytest.mark.parametrize("word", ["dot", "point", "&#", "(at", "_at_", "x @ y"])
def test_unrelated_words_change_no_span(text, word):
    far = " , nothing else . , "
    assert added(text + far + word) == added(text) == added(word + far + "\n" + text)


def test_time_is_linear_in_the_text():
    took = []
    for text in ("a_at_b.co", "a dot b at c dot com ", "x at ", "a dot ", "a.", "1 "):
        began = time.perf_counter()
        disguised_spans(text * (400_000 // len(text)), [])
        took.append(time.perf_counter() - began)
    assert max(took) < 20, took


def test_every_case_variant_of_a_digit_word_is_read():
    """Patterns without regard to case match more characters than lower() maps; none of them may end a job."""
    from braidseq.llm.pii import _DIGIT_WORDS, _TIMES, spelled_edits

    others = {"i": "iIıİ", "s": "sSſ", "k": "kKK"}
    for word in [*_DIGIT_WORDS, *_TIMES]:
        variants = {word, word.upper(), word.title()}
        for k, c in enumerate(word):
            variants |= {word[:k] + x + word[k + 1 :] for x in others.get(c, c + c.upper())}
        for v in variants:
            text = f"call {v} two three 4"
            spelled_edits(text)
            plain = word in _TIMES
            assert [e[2] for e in spelled_edits(text)][0] == ("2" * _TIMES[word] if plain else _DIGIT_WORDS[word]), v
            disguised_spans(text, plain_spans(text))


@pytest.mark.parametrize(
    "text, found",
    [
        ("ask x (at) exaſmple (dot) com", "x (at) exaſmple (dot) com"),
        ("ask x (at) oﬃce (dot) com", "x (at) oﬃce (dot) com"),
        ("ask jİm@example.com", "jİm@example.com"),
    ],
)
def test_letters_that_fold_to_ascii(text, found):
    assert [text[s:e] for _, s, e in disguised_spans(text, plain_spans(text))] == [found]


def test_random_mixtures_end_no_job():
    rng = random.Random(9)
    pieces = ["ſ", "İ", "ı", "K", "ﬁ", "six", "nine", "double", "plus", "at", "dot", "@", ".", " ", "-", "4111", "(", ")", "x", "\u200b", "_at_", "&#46;", "com", "é", "日本", "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 30)))
        for kind, s, e in disguised_spans(text, plain_spans(text)):
            assert 0 <= s < e <= len(text) and kind in ("email", "ip", "card", "phone")
