"""Toxic passages that occur again, and words that were used before."""

from __future__ import annotations

import random

import numpy as np
import pytest

from flowgate.llm import toxicity


@pytest.fixture(scope="module")
def table():
    """Scores of a table where three words are toxic: log-odds of about four for them, below zero after the shift for all others."""
    toxic, both = (np.zeros(toxicity.LEVELS * toxicity.BUCKETS + 1, dtype=np.float32) for _ in range(2))
    toxic[-1], both[-1] = 100, 1000
    for word in (b"idiot", b"scum", b"moron"):
        for bucket in toxicity._buckets(word):
            toxic[bucket] = both[bucket] = 80
    model = toxicity.Model(toxic, both)
    model.scale = [0.01, 0.01]
    return model, toxicity.Scores(toxic, both)


def test_every_passage_is_found(table):
    r = random.Random(3)
    plain = lambda n: " ".join(r.choice(["field", "river", "house", "green"]) for _ in range(n))
    insult = "idiot scum moron"
    text = " ".join([plain(30), "idiot", plain(20), "scum", plain(20), "moron", plain(20), insult, plain(40), insult, plain(30)])
    score, passages, surprise = toxicity._judge(table[0], text, table[1])
    words = text.split()
    found = [" ".join(words[b:e]) for b, e in zip(passages[::2], passages[1::2], strict=True)]
    assert found.count(insult) == 2 and len(surprise) == len(found)
    # a repetition adds nothing to the document's score
    once = toxicity._judge(table[0], " ".join([insult, plain(200)]), table[1])
    twice = toxicity._judge(table[0], " ".join([insult, plain(97), insult, plain(100)]), table[1])
    assert len(twice[1]) == 2 * len(once[1]) == 4 and twice[0] == pytest.approx(once[0])


def test_a_run_of_one_word_is_one_passage(table):
    assert toxicity._judge(table[0], "field " * 100 + "scum " * 30, table[1])[1] == [100, 130]
