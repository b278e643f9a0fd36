"""How often an n-gram occurs tells toxic texts, not only whether it does."""

import random

import numpy as np

from loomtext.llm import toxicity


def test_counts_tell_where_presence_does_not():
    r = random.Random(2)

    def text(toxic):  # n-grams are the same in all, their numbers are not
        return "réeu " * (r.randrange(25, 40) if toxic else 2) + "word " * 40

    marks = [k % 2 for k in range(300)]
    texts = [text(t) for t in marks]
    model = toxicity.fit(texts[:200], marks[:200])
    known, number = np.zeros(1 << toxicity.BITS, bool), np.zeros(1 << toxicity.BITS, np.int32)
    known[model.slots], number[model.slots] = True, np.arange(len(model.slots))
    told = toxicity.score(model, known, number, texts[200:]) >= 0.7
    assert np.mean(told == np.asarray(marks[200:])) > 0.95


def test_features_count_in_each_text():
    row, slot, value = toxicity.features(["aaaaa", "aaa", "", None])
    assert sorted(zip(row.tolist(), np.expm1(value).round().astype(int).tolist())) == [(0, 1), (0, 2), (0, 3), (1, 1)]
