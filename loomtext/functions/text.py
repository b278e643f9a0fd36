"""Text columns: normalising, tokens, predicates, keys and domains, all as JVM expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from loomtext.functions import tables as T

SPACES = "[ \\t-\\r]"
INVISIBLE = "\u200b\u200c\u200d\ufeff"
THAANA = "[ހ-޿]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` with `value` evaluated once."""
    return F.transform(F.array(value), body)[0]


def _in_form(text: Column, way: str) -> Column:
    """Text in a canonical form, by the Unicode library that comes with Spark, in the JVM; null stays null."""
    told = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit(way), F.coalesce(text, F.lit("")), F.lit(False))
    return F.when(F.rlike(text, F.lit("[^\\x00-\\x7f]")), told).otherwise(text)


def composed(text: Column) -> Column:
    """NFC: canonical composition."""
    return _in_form(text, "compose")


def decomposed(text: Column) -> Column:
    """NFD: canonical decomposition, marks in their canonical order."""
    return _in_form(text, "decompose")


def unmarked(text: Column) -> Column:
    """Letters without their marks; Thaana, whose vowel signs are marks, stays."""
    return F.regexp_replace(decomposed(text), f"[\\p{{M}}&&[^{THAANA[1:-1]}]]", "")


def normalise(text: Column) -> Column:
    """NFC, no invisible marks, no-break space as space; null stays null."""
    return F.translate(composed(text), "\u00a0" + INVISIBLE, " ")


def fold_punctuation(text: Column) -> Column:
    """Typographic marks as ASCII, invisible marks gone, trimmed."""
    single = {k: v for k, v in T.PUNCTUATION_FOLD.items() if len(v) == 1}
    folded = F.translate(text, "".join(single) + INVISIBLE, "".join(single.values()))
    for k, v in T.PUNCTUATION_FOLD.items():
        if len(v) > 1:
            folded = F.replace(folded, F.lit(k), F.lit(v))
    return F.btrim(folded, F.lit(" \t\n\x0b\f\r"))


def one_line(text: Column) -> Column:
    """White space runs as one space, trimmed."""
    return F.btrim(F.regexp_replace(text, SPACES + "+", " "))


def tokens(text: Column) -> Column:
    """Words, numbers and single punctuation marks in order."""
    return F.regexp_extract_all(one_line(text), F.lit(T.WORD), F.lit(0))


def words_only(text: Column) -> Column:
    """The tokens that are words."""
    return F.filter(tokens(text), lambda t: F.rlike(t, F.lit(T.WORD_TOKEN)))


def has_content(text: Column) -> Column:
    """A letter or digit is in the text."""
    return F.rlike(text, F.lit("[\\p{L}\\p{N}]"))


def has_thaana(text: Column) -> Column:
    return F.rlike(text, F.lit(THAANA))


def composition(text: Column) -> dict[str, Column]:
    """Percent of a text's characters by script; punctuation is counted beside the others. Null for empty texts."""
    classes = {
        "thaana": THAANA,
        "latin": "[a-zA-Z]",
        "digits": "[0-9]",
        "punctuation": "[.,;:!?()\\[\\]{}\"'،؛؟ـ۔]",
        "whitespace": "[ \\t-\\r]",
    }
    n = F.nullif(F.length(text), F.lit(0))
    return {k: 100.0 * (F.length(text) - F.length(F.regexp_replace(text, c, ""))) / n for k, c in classes.items()}


def near_keys(latin: Column, english: Column) -> Column:
    """What near duplicates share: case and white space folded, and of the English side letters, digits and spaces only."""
    def folded(c: Column) -> Column:
        return F.lower(F.regexp_replace(c, SPACES + "+", " "))

    return F.concat(folded(latin), F.lit("\x01"), F.regexp_replace(folded(english), "[^a-z0-9 ]+", ""))


def letters_key(text: Column) -> Column:
    """A text's letters and digits of any script in lower case, words apart; a text without any is its own key."""
    kept = one_line(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{M}\\p{N} \\t-\\r]+", ""))
    return F.when(kept == "", F.concat(F.lit("\x02"), text)).otherwise(kept)


def unspellable(latin: Column) -> Column:
    """A lower-case text has a letter that Dhivehi in Latin letters doesn't: w, x, or c but in ch."""
    return F.rlike(F.lower(latin), F.lit(T.FOREIGN_LETTERS))


def unspellable_tokens(latin: Column) -> Column:
    """The distinct lower-case tokens that make a text unspellable, sorted."""
    words = F.split(F.lower(latin), SPACES + "+")
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: F.rlike(w, F.lit(T.FOREIGN_LETTERS)))))


def in_domain(domain: Column, wanted: str) -> Column:
    """`x` keeps the domain x, `!x` all but it; rows without a domain are in none."""
    return ~domain.eqNullSafe(F.lit(wanted[1:])) if wanted.startswith("!") else domain.eqNullSafe(F.lit(wanted))


def conversational(text: Column) -> Column:
    """A question, first or second person, or quoted speech."""
    bare = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.coalesce((bare != "") & (F.endswith(bare, F.lit("?")) | F.rlike(bare, F.lit(T.SECOND_PERSON)) | F.rlike(bare, F.lit(T.QUOTED))), F.lit(False))


def canonical_domain(raw: Column) -> Column:
    """A free-text label folded onto the canonical domains, `other` if it doesn't clearly resolve."""
    text = F.lower(F.btrim(F.coalesce(raw, F.lit(""))))
    tail = F.btrim(F.regexp_replace(text, "(?s)^[^:]*:", ""))
    text = F.when(tail == "", text).otherwise(tail)
    for mark in (",", "/", ";", "\\|", " and ", " or "):
        text = F.btrim(F.regexp_replace(text, f"(?s){mark}.*$", ""))
    text = F.btrim(F.regexp_replace(text, "(?s)\\s*\\(.*$", ""))
    known = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in T.DOMAIN_ALIASES.items() for x in kv]), text), text)
    out = None
    for domain in T.DOMAINS:
        out = F.when(F.startswith(known, F.lit(domain)), domain) if out is None else out.when(F.startswith(known, F.lit(domain)), domain)
    exact = F.when(known.isin(*T.DOMAINS), known)
    return F.coalesce(exact, out, F.lit("other"))


def reject_reason(source: Column, english: Column, in_thaana: bool = True) -> Column:
    """The first row rule that a pair breaks, or null."""
    def size(c: Column) -> Column:
        return F.length(F.btrim(c))

    bare = F.coalesce(F.btrim(english), F.lit(""))
    reason = F.when((F.coalesce(size(source), F.lit(0)) == 0) | (bare == ""), "empty_side")
    if in_thaana:
        reason = reason.when(~has_thaana(source), "no_thaana_in_source").when(has_thaana(english), "thaana_in_english")
        reason = reason.when(F.rlike(source, F.lit("[A-Za-z]")), "latin_in_dhivehi")
    reason = reason.when(F.rlike(bare, F.lit(T.TIME_AGO)), "timestamp_fragment").when(F.rlike(english, F.lit(T.UI_STRING)), "ui_string")
    reason = reason.when(F.size(F.split(one_line(english), " ")) < T.MIN_WORDS, "too_few_words")
    outside = ~size(source).between(T.MIN_CHARS, T.MAX_CHARS) | ~size(english).between(T.MIN_CHARS, T.MAX_CHARS)
    return reason.when(outside, "length_bounds")


def latin_reason(latin: Column, english: Column) -> Column:
    """The first rule that a pair breaks once its source is in Latin letters, or null."""
    ratio = F.length(latin) / F.length(english)
    reason = F.when(F.btrim(latin) == "", "empty_after_transliteration").when(F.rlike(latin, F.lit("[^\\x00-\\x7f]")), "non_ascii_latin")
    return reason.when((ratio < T.MIN_RATIO) | (ratio > T.MAX_RATIO), "length_ratio")


def normal_key(latin: Column) -> Column:
    """A lexicon key: straight apostrophes, trimmed, lower case, single spaces."""
    return F.lower(one_line(F.replace(latin, F.lit("’"), F.lit("'"))))


def distinct_words(values: Column) -> Column:
    """The first spelling of each value, whatever its case."""
    empty = F.array().cast("array<string>")
    return F.aggregate(values, empty, lambda s, x: F.when(F.exists(s, lambda y: F.lower(y) == F.lower(x)), s).otherwise(F.concat(s, F.array(x))))


def split_keys(latin: Column) -> Column:
    """Valid keys of a compound headword: alternatives at / and ;, parentheses as alternatives of their own."""
    flat = F.regexp_replace(latin, "[()]", "/")
    parts = F.transform(F.split(flat, "[/;]"), lambda p: normal_key(F.regexp_replace(F.lower(F.replace(p, F.lit("’"), F.lit("'"))), "[^a-z' ]", " ")))
    return F.array_distinct(F.filter(parts, lambda p: F.rlike(p, F.lit(T.VALID_KEY)) & (F.length(p) >= 2)))


def expand_glosses(values: Column) -> Column:
    """Each gloss, its pieces between slashes, and both without parentheses; trimmed of ` -,;`, case-folded distinct."""
    def tidy(c: Column) -> Column:
        return F.btrim(F.regexp_replace(c, "[ \\t-\\r]+", " "), F.lit(" -,;"))

    def forms(v: Column) -> Column:
        pieces = F.concat(F.array(v), F.split(v, "/"))
        return F.flatten(F.transform(pieces, lambda p: F.array(tidy(p), tidy(F.regexp_replace(p, "\\([^)]*\\)", "")))))

    return distinct_words(F.filter(F.flatten(F.transform(values, forms)), lambda x: x != ""))


def alpha_tokens(text: Column) -> Column:
    """Lower-case letter runs of two characters or more."""
    return F.filter(F.split(F.lower(text), "[^a-z']+"), lambda t: F.length(t) > 1)


def overlap_ratio(words: Column, known: list[str]) -> Column:
    """Share of tokens, repeats included, that a word list has; 0 without tokens."""
    hits = F.size(F.filter(words, lambda t: t.isin(*known)))
    return F.when(F.size(words) == 0, 0.0).otherwise(hits / F.size(words))


def english_phrase(text: Column) -> Column:
    """More than one word, one of them an English function word."""
    words = alpha_tokens(text)
    return (F.size(words) > 1) & F.exists(words, lambda t: t.isin(*T.STOPWORDS))


def parse_glosses(raw: Column) -> Column:
    """A JSON array or a list between ; or |, as trimmed non-empty values."""
    listed = F.coalesce(F.from_json(raw, "array<string>"), F.split(raw, "[;|]"))
    return F.filter(F.transform(listed, lambda x: F.btrim(x)), lambda x: x != "")


def canonical_pos(raw: Column) -> Column:
    """A part of speech by its canonical name, as it is if unknown."""
    bare = F.btrim(F.coalesce(raw, F.lit("")))
    known = F.element_at(F.create_map(*[F.lit(x) for kv in T.POS.items() for x in kv]), F.lower(bare))
    return F.coalesce(known, F.nullif(bare, F.lit("")), F.lit("unknown"))


def headword_class(latin: Column, english: Column) -> Column:
    """inverted, corrupt, malformed or clean, by spelling alone."""
    foreign = F.rlike(latin, F.lit(T.FOREIGN_LETTERS))
    native = (F.size(english) > 0) & F.forall(english, lambda g: ~F.rlike(g, F.lit(T.FOREIGN_LETTERS)))
    return (
        F.when(foreign & native, "inverted").when(foreign, "corrupt")
        .when(~F.rlike(normal_key(latin), F.lit(T.VALID_KEY)), "malformed").otherwise("clean")
    )


def csv_cell(cell: Column) -> Column:
    """A cell for a CSV file: guarded against formulas, quoted."""
    safe = F.when(F.rlike(cell, F.lit("^[=+\\-@\\t\\r]")), F.concat(F.lit("'"), cell)).otherwise(cell)
    return F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))


def char_recovery(expected: Column, got: Column) -> Column:
    """Share of characters recovered: 1 less edits by length, 0 at least."""
    return F.greatest(F.lit(0.0), 1 - F.levenshtein(expected, got) / F.nullif(F.length(expected), F.lit(0)))


def decoded_exactly(expected: Column, got: Column) -> Column:
    """The texts are equal but for the amount of white space between words and around them."""
    return one_line(expected) == one_line(got)


#: Tokens of a text by name of the counter; a tokenizer's (pieces.piece_counts) can be added as a column function.
TOKEN_COUNTERS: dict[str, Callable[[Column], Column]] = {
    "words": lambda text: F.size(F.split(one_line(text), " ")),
    "marks": lambda text: F.size(tokens(text)),
    "bytes": lambda text: F.octet_length(text),
}


def over_max_tokens(sides: list[Column], most: int, counter: str = "bytes") -> Column:
    """`over_max_tokens` if a side has more tokens than a model takes, else null."""
    return F.when(F.greatest(*[TOKEN_COUNTERS[counter](s) for s in sides], F.lit(0)) > most, "over_max_tokens")
