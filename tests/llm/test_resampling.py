"""Importance resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from loomtext.llm import resampling as R

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def buckets_of(text):
    words = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), Counter(zlib.crc32(" ".join(words[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(words) - k + 1))


def plain(docs, target):
    """(doc_id, n_features, weight, score, rank) by the contract; repeated rows may swap ranks."""
    of_docs, of_target = sum((buckets_of(t)[1] for _, t in docs), Counter()), sum((buckets_of(t)[1] for t in target), Counter())
    s, t = of_docs.total(), of_target.total()
    gain = [math.floor(1000 * math.log((of_target[b] + 1) * (s + 10000) / ((of_docs[b] + 1) * (t + 10000)))) for b in range(10000)]
    rows, may = [], []
    for k, text in docs:
        n, found = buckets_of(text)
        h = int(hashlib.sha256(f"42:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] * c for b, c in found.items())
        rows.append([k, found.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if n >= 20:
            may.append(rows[-1])
    may.sort(key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    for place, row in enumerate(may[: 5 * len(may) // 100], 1):
        row[4] = place
    return rows


@pytest.fixture(scope="module")
def texts():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcé😀Z9-") for _ in range(r.randrange(1, 6)))
    some = [" ".join(word() for _ in range(r.randrange(60))) for _ in range(400)]
    return [None, "", "\x00 .", "A b C", "one", "two words", "x" * 1000 + " y " + "z" * 60, *some, *[some[7]] * 150, "w " * 30_000]


def test_crcs_by_pieces(texts, monkeypatch):
    monkeypatch.setattr(R, "PIECE", 64)
    got = [Counter() for _ in texts]
    for owner, runs in R.features([None if t is None else t.encode() for t in texts[:-1]] + [b"tail"], 10000):
        for first, found in runs:
            for k, b in zip(owner[first].tolist(), found.tolist()):
                got[k][b] += 1
    assert got[:-1] == [buckets_of(t)[1] for t in texts[:-1]]


def test_equals_plain(spark, texts):
    docs = [(k, t) for k, t in enumerate(texts)] + [(None, texts[30]), (12, texts[12]), (12, texts[12]), (12, texts[13])]
    target = [texts[20], texts[40], None, "", texts[21]]
    rows = spark.createDataFrame([(k, t, "s", 3, 1.5) for k, t in docs], "doc_id long, text string, rank string, n_words int, __own_range double")
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = sorted(([g.doc_id, g.n_features, g.weight, g.score, g["rank"]] for g in R.resample(rows, goal).collect()), key=str)
    assert got == sorted(plain(docs, target), key=str)
    assert sum(g[4] is not None for g in got) > 15
    held = R.drawn(rows, goal)
    assert held.columns == rows.columns and {h.doc_id for h in held.collect()} == {g[0] for g in got if g[4]}


def test_many_equal_scores(spark):
    scored = spark.createDataFrame([(k, 20, 7 if k % 3 else 5) for k in range(900)] + [(k, 19, 99) for k in range(9)], "doc_id long, n_words int, score long")
    got = {r.doc_id: r["rank"] for r in R.ranked(scored, 20, (80, 100)).where("n_words = 20").collect()}
    order = sorted(range(900), key=lambda k: (-(7 if k % 3 else 5), k))
    assert got == {k: place if place <= 720 else None for place, k in enumerate(order, 1)}


def test_empty_tables(spark, texts):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts[:40])], "doc_id long, text string")
    none = docs.limit(0)
    assert R.resample(none, none).count() == 0 and R.resample(none, docs).count() == 0
    got = sorted(([g.doc_id, g.n_features, g.weight, g.score, g["rank"]] for g in R.resample(docs, none).collect()), key=str)
    assert got == sorted(plain(list(enumerate(texts[:40])), []), key=str)
