"""Conversion between Thaana and Latin letters as token maps: one expression, in Spark and in DuckDB."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, functions as F

from loomtext.functions import tables as T
from loomtext.functions.text import unmarked

#: Private marks: a coda h, a barrier between letters, a y between vowels, and sh before a vowel.
CODA, BARRIER, GLIDE, SOFT = "\ue000", "\ue001", "\ue002", "\ue003"
_STOPS = ("dh", "th", "b", "d", "t", "g")
_VOWELS = ("aa", "ee", "oo", "oa", "ey", "a", "i", "u", "e", "o")


@cache
def native() -> dict[str, str]:
    """Latin reading to letter: the first of each group, without readings that have no inverse."""
    found: dict[str, str] = {}
    for letter, reading in T.CONSONANTS.items():
        if reading and reading not in T.NO_INVERSE:
            found.setdefault(reading, letter)
    return found


@cache
def thaana_map() -> dict[str, str]:
    """Every token of THAANA_TOKENS that changes, to its Latin."""
    signs = {**T.SIGNS, T.SUKUN: ""}
    out: dict[str, str] = dict(T.SIGNS)
    for letter, reading in T.CONSONANTS.items():
        out[letter] = reading
        for sign, vowel in signs.items():
            out[letter + sign] = T.SUKUN_READINGS.get(letter, reading) if sign == T.SUKUN else reading + vowel
        if reading in T.GEMINATES:
            out["އ" + T.SUKUN + letter] = 2 * reading
        if reading in T.PRENASAL_STOPS:
            for sign, vowel in {"": "", **signs}.items():
                out["ނ" + letter + sign] = f"n'{reading}{vowel}"
    return out


@cache
def thaana_tokens() -> str:
    """The pattern of tokens: geminates, prenasal pairs, consonants with a sign, anything else alone."""
    letters, signs = "".join(T.CONSONANTS), "".join(T.SIGNS) + T.SUKUN
    double = "".join(c for c, r in T.CONSONANTS.items() if r in T.GEMINATES)
    stops = "".join(c for c, r in T.CONSONANTS.items() if r in T.PRENASAL_STOPS)
    return f"(?s)އ{T.SUKUN}[{double}]|ނ[{stops}][{signs}]?|[{letters}][{signs}]?|."


@cache
def latin_map() -> dict[str, str]:
    """Every token of LATIN_TOKENS that changes, to its Thaana."""
    sign = {v: k for k, v in T.SIGNS.items()}
    letters = native()
    out = {"iy": "ތ" + T.SUKUN, CODA: "ށ" + T.SUKUN, BARRIER: "", "sh": "ޝ" + T.SUKUN}
    out |= {v: "އ" + s for v, s in sign.items()}
    for reading, letter in letters.items():
        if reading != "sh":
            out[reading] = letter + T.SUKUN
        for v in ("", *_VOWELS):
            tail = sign[v] if v else T.SUKUN
            if v and reading != "sh":
                out[reading + v] = letter + tail
            elif v:
                out["sh" + v] = letter + tail
            if reading in _doubled():
                out[2 * reading + v] = "އ" + T.SUKUN + letter + tail
            if reading in _STOPS:
                out[f"n'{reading}{v}"] = "ނ" + letter + tail
    for v in _VOWELS:
        out[SOFT + v] = letters["sh"] + sign[v]
        out["sh" + SOFT + v] = "އ" + T.SUKUN + letters["sh"] + sign[v]
        out[GLIDE + v] = letters["y"] + sign[v]
    out[GLIDE] = letters["y"] + T.SUKUN
    return out


def _doubled() -> list[str]:
    return ["th", "lh", "ch", "sh", "s", "d", "t", "l", "k", "g", "n", "m", "b", "r", "f", "p", "j", "y", "z"]


@cache
def latin_tokens() -> str:
    """The pattern of tokens of a marked word, first alternative first."""
    v = "|".join(_VOWELS)
    twice = "|".join(2 * x for x in _doubled())
    single = "|".join(sorted(native(), key=lambda x: (-len(x), x)))
    return f"(?s)n'(?:{'|'.join(_STOPS)})(?:{v})?|sh{SOFT}(?:{v})|(?:{twice})(?:{v})?|iy|{CODA}|{BARRIER}|{SOFT}(?:{v})|{GLIDE}(?:{v})?|(?:{single})(?:{v})?|{v}|."


#: Marks before tokens are cut, in order; the third runs twice as its matches share vowels.
MARKS = [
    ("([aeiou])h([^aeiou]|$)", f"\\1{CODA}\\2"),
    *[(f"{c}{c}h", f"{c}{BARRIER}{c}h") for c in ("c", "s", "d", "t", "l", "k", "g")],
    ("ggn", f"g{BARRIER}gn"),
    ("([ei])y([aeiou])", f"\\1{GLIDE}\\2"),
    ("([ei])y([aeiou])", f"\\1{GLIDE}\\2"),
    ("sh([aeiou])", f"{SOFT}\\1"),
]


def _mapped(text: Column, pattern: str, table: dict[str, str]) -> Column:
    # a map is searched from its start, so tokens are looked up among those of their first character
    first: dict[str, dict[str, str]] = {}
    for token, put in table.items():
        first.setdefault(token[0], {})[token] = put
    known = F.create_map(*[x for c, own in first.items() for x in (F.lit(c), F.create_map(*[F.lit(y) for kv in own.items() for y in kv]))])
    put = lambda t: F.try_element_at(F.try_element_at(known, F.left(t, F.lit(1))), t)
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda t: F.coalesce(put(t), t)), "")


def to_latin(text: Column) -> Column:
    """Thaana read out in Latin letters; anything else as it is."""
    return _mapped(text, thaana_tokens(), thaana_map())


def unread(text: Column) -> Column:
    """Distinct Thaana characters that have no reading here."""
    known = list(thaana_map())
    left = F.filter(F.regexp_extract_all(text, F.lit(thaana_tokens()), F.lit(0)), lambda t: F.rlike(t, F.lit("^[ހ-޿]")) & ~t.isin(*known))
    return F.array_distinct(left)


def word_to_thaana(word: Column) -> Column:
    """One word of Latin letters, lower case and without accents, in Thaana."""
    marked = word
    for pattern, put in MARKS:
        marked = F.regexp_replace(marked, pattern, put.replace("\\1", "$1").replace("\\2", "$2"))
    return _mapped(marked, latin_tokens(), latin_map())


def to_thaana(text: Column) -> Column:
    """Latin words of a text in Thaana, without their accents; white space and words without Latin letters as they are."""
    parts = F.regexp_extract_all(unmarked(text), F.lit("[ \\t-\\r]+|[^ \\t-\\r]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(F.rlike(p, F.lit("[A-Za-z]")), word_to_thaana(F.lower(p))).otherwise(p)), "")


def fold_letters(text: Column) -> Column:
    """Letters that share a reading as the first of them."""
    first: dict[str, str] = {}
    pairs = [(c, first[r]) for c, r in T.CONSONANTS.items() if first.setdefault(r, c) != c]
    return F.translate(text, "".join(a for a, _ in pairs), "".join(b for _, b in pairs))


#: The key that takes back a letter.
BACKSPACE = "\u232b"


def typed(keys: Column) -> Column:
    """struct<text, latin>: what an input method shows after an array of keys, and the Latin letters it is composing.

    Latin letters and apostrophes compose: the run of them is converted anew at each key. Backspace takes back the last
    of its letters, not a Thaana sign; with none it takes the last character of the text. Any other key ends the run.
    """
    text = lambda s: F.concat(s["done"], to_thaana(s["latin"]))
    state = lambda done, latin: F.struct(done.alias("done"), latin.alias("latin"))
    less = lambda c: F.substring(c, F.lit(1), F.length(c) - 1)

    def step(s: Column, key: Column) -> Column:
        back = F.when(s["latin"] != "", state(s["done"], less(s["latin"]))).otherwise(state(less(s["done"]), F.lit("")))
        return F.when(F.rlike(key, F.lit("^[a-zA-Z']$")), state(s["done"], F.concat(s["latin"], key))).when(key == BACKSPACE, back).otherwise(state(F.concat(text(s), key), F.lit("")))

    shown = lambda s: F.struct(text(s).alias("text"), s["latin"].alias("latin"))
    return F.aggregate(F.filter(keys, lambda k: k.isNotNull()), state(F.lit(""), F.lit("")), step, shown)


def typed_prefixes(word: Column) -> Column:
    """What an input method shows after each key of a word without backspaces: the conversion of every prefix."""
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda n: to_thaana(F.substring(word, F.lit(1), n)))


def failure_class(source: Column, latin: Column, back: Column, stable: Column) -> Column:
    """Why a round trip changed a text, most specific first; null if it didn't. Thaana left in `latin` has no reading."""
    coda = "|".join(c + T.SUKUN for c in ("ތ", "ށ", "އ"))
    stops = "".join(c for c, r in T.CONSONANTS.items() if r in T.PRENASAL_STOPS)
    return (
        F.when(source == back, None).when(fold_letters(source) == fold_letters(back), "variant_fold").when(stable, "spelling_normalised")
        .when(F.rlike(latin, F.lit("[ހ-޿]")), "unmapped_char").when(F.rlike(source, F.lit(f"ނ[{stops}]")), "prenasalized")
        .when(F.rlike(source, F.lit(coda)), "coda_h_ambiguity").when(F.contains(source, F.lit("އ")), "alifu_onset_ambiguity")
        .when(F.length(source) != F.length(back), "length_mismatch").otherwise("other")
    )


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _duck(text: str, pattern: str, table: dict[str, str]) -> str:
    keys, values = ", ".join(map(_quoted, table)), ", ".join(map(_quoted, table.values()))
    return f"array_to_string(list_transform(regexp_extract_all({text}, {_quoted(pattern)}), lambda t: coalesce(map([{keys}], [{values}])[t], t)), '')"


def duck_to_latin(text: str) -> str:
    """to_latin() as DuckDB SQL over an SQL expression."""
    return _duck(text, thaana_tokens(), thaana_map())


def duck_word_to_thaana(word: str) -> str:
    """word_to_thaana() as DuckDB SQL over an SQL expression."""
    for pattern, put in MARKS:
        word = f"regexp_replace({word}, {_quoted(pattern)}, {_quoted(put)}, 'g')"
    return _duck(word, latin_tokens(), latin_map())
