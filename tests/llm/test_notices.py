"""Licence notices against a plain reading of the contract and edit distances by the textbook."""

import random
import re

import pytest

from loomtext.llm import notices as N
from loomtext.llm.words import FOLD

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
NOTES = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0."]


def words_of(text):
    return WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_base(text):
    words = words_of(text)
    found = sorted((k, label) for phrase, label in N.BASE.items() for n in [len(phrase.split())] for k in range(len(words)) if words[k : k + n] == phrase.split())
    places = [k for k, _ in found]
    return len(words), len(found), min(places, default=None), max(places, default=None), ",".join(sorted({label for _, label in found}))


def edits(pattern, text):
    """The fewest edits of the pattern anywhere in the text."""
    above = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        row = [i]
        for j, d in enumerate(text, 1):
            row.append(min(above[j] + 1, row[j - 1] + 1, above[j - 1] + (c != d)))
        above = row
    return min(above)


def normal(text):
    return (b" %b " % b" ".join(text.encode().translate(FOLD).split())).decode()


def test_seeds_and_bounded_matching_lose_nothing():
    find, r, met = N.search(), random.Random(5), 0

    def noise():
        return " ".join("".join(r.choice("licenudrthmv") for _ in range(r.randrange(1, 8))) for _ in range(r.randrange(12)))

    for _ in range(60):
        letters = list(r.choice(N.NOTICES).words)
        for _ in range(r.randrange(len(letters) // N.CHARS_AN_EDIT + 2)):
            k = r.randrange(len(letters))
            letters[k : k + r.randrange(2)] = r.choice(["", "x", "q ", "z"])
        text = normal(f"{noise()} {''.join(letters)} {noise()}")
        least = {}
        for number, a, b in find.windows(text):
            if m := find.fuzzy[number].search(text[a:b]):
                least[number] = min(least.get(number, 99), sum(m.fuzzy_counts))
        want = {k: d for k, p in enumerate(find.padded) if (d := edits(p, text)) <= find.allowed[k]}
        assert least == want
        met += len(want)
    assert met > 40


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("apache licence,\nVersion 2", ["apache-2"]),
        ("Apache License Version 3", []),
        ("Apache License Version 12", []),
        ("under the BSD license", ["bsd"]),
        ("under the MPL license", []),
        ("under the mit license / under the mit-license", ["mit", "mit"]),
        ("GNU Lesser General Public License version 3", ["lgpl"]),
        ("the gnu genral public licence version 3", ["gpl-3"]),
        ("Creative Commons Attribution-NonComercial", ["cc-by-nc"]),
        ("thunder the mitt licenses", []),
        ("", []),
    ],
)
def test_notices_of_a_text(text, labels):
    find = N.search()
    spans = N.spans_in(text, find.places(normal(text)), find.notices)
    assert [s["label"] for s in spans] == labels
    for s in spans:
        assert re.sub(r"[\s/]", "", text[s["start"] : s["end"]]) and text[s["start"]].isalnum() and text[s["end"] - 1].isalnum()


def test_spans_hold_the_notice():
    text = "É, no.\n\tReleased under: the (MIT)\nLicence! cc-by-nc"
    find = N.search()
    (mit, nc) = N.spans_in(text, find.places(normal(text)), find.notices)
    assert text[mit["start"] : mit["end"]] == "under: the (MIT)\nLicence" and mit["edits"] == 1
    assert text[nc["start"] : nc["end"]] == "cc-by-nc" and nc["edits"] == 0


def test_rows(spark, sf):
    r = random.Random(2)
    filler = ["cc", "by", "nc", "under", "the", "mit", "license", "é", "CC-BY", "x_y", "4.0"]
    odd = [" ".join(r.choice(filler) for _ in range(r.randrange(60))) for _ in range(80)] + [None, "", "cc by nc " * 30, "CC BY-NC\x00CC/BY/NC"]
    texts = odd + NOTES + [x.text for x in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    rows = spark.createDataFrame([(k if k % 7 else None, t, "s", 1) for k, t in enumerate(texts)], "doc_id long, text string, spans string, score int")
    got = N.licence_notices(rows).collect()
    assert len(got) == len(texts)
    key = lambda x: str(x)
    assert sorted(((g.doc_id, g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) for g in got), key=key) == sorted(
        ((k if k % 7 else None, *plain_base(t)) for k, t in enumerate(texts)), key=key
    )
    assert all(set(g.base_labels.split(",")) - {""} <= set(g.labels.split(",")) and 0 <= g.score <= 1 and (g.score == 1 or not g.n_base) for g in got)
    assert N.licence_notices(rows.limit(0)).count() == 0


def test_many_near_places_stay_linear():
    text = normal("under the mti license, cc by nc under the mit licence " * 3000)
    places = N.search().places(text)
    assert sum(N.NOTICES[f.notice].label == "mit" for f in places) == 3000 == sum(N.NOTICES[f.notice].label == "cc-by-nc" for f in places)
