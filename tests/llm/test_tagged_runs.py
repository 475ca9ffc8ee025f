import numpy as np
import pytest

from velatura.llm import pii_tagger

CARDS = ["4111 1111 1111 1111", "5500 0000 0000 0004", "4012 8888 8888 1881", "6011 0000 0000 0004", "4242 4242 4242 4242"]


class OneRun:
    """A field that tags every run as one value of a kind."""

    def __init__(self, kind):
        self.first = pii_tagger.TAGS.index(f"B-{kind}")

    def viterbi(self, runs):
        return [np.array([self.first, *[self.first + 1] * (len(s) - 3)]) for s, _ in runs]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_every_card_of_a_run_is_found(n):
    text = f"pay {' '.join(CARDS[:n])} now"
    _, got = pii_tagger.all_spans([text], OneRun("card"))[0]
    assert [text[a:b] for _, a, b in got] == CARDS[:n]


def test_trained_field_finds_cards_side_by_side():
    text = f"pay {' '.join(CARDS[:4])} now"
    _, got = pii_tagger.all_spans([text], pii_tagger.train())[0]
    assert [text[a:b] for _, a, b in got] == CARDS[:4]


def test_values_after_tokens_that_start_none():
    text = "see 77 10 4111 1111 1111 1111 33 5500 0000 0000 0004 9 x"
    _, got = pii_tagger.all_spans([text], OneRun("card"))[0]
    assert {CARDS[0], CARDS[1]} <= {text[a:b] for _, a, b in got}
    text = "at 10.0.0.1 999.1.1.1 10.0.0.2 x"
    assert [text[a:b] for a, b in pii_tagger._values(1, text, [(3, 11), (12, 21), (22, 30)])] == ["10.0.0.1", "10.0.0.2"]
