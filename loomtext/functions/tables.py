"""Word lists, letter maps, patterns and limits that results depend on, as given."""

from __future__ import annotations

# Letters and their Latin readings, in groups that share a reading; the first of a group is native.
CONSONANTS = {
    "ހ": "h", "ށ": "sh", "ނ": "n", "ރ": "r", "ބ": "b", "ޅ": "lh", "ކ": "k", "އ": "", "ވ": "v", "މ": "m", "ފ": "f", "ދ": "dh",
    "ތ": "th", "ލ": "l", "ގ": "g", "ޏ": "gn", "ސ": "s", "ޑ": "d", "ޒ": "z", "ޓ": "t", "ޔ": "y", "ޕ": "p", "ޖ": "j", "ޗ": "ch",
    "ޘ": "th", "ޙ": "h", "ޚ": "kh", "ޛ": "dh", "ޜ": "zh", "ޝ": "sh", "ޞ": "s", "ޟ": "d", "ޠ": "t", "ޡ": "z", "ޢ": "", "ޣ": "gh",
    "ޤ": "q", "ޥ": "w", "ޱ": "n",
}
SIGNS = {"ަ": "a", "ާ": "aa", "ި": "i", "ީ": "ee", "ު": "u", "ޫ": "oo", "ެ": "e", "ޭ": "ey", "ޮ": "o", "ޯ": "oa"}
SUKUN = "ް"
SUKUN_READINGS = {"އ": "h", "ށ": "h", "ތ": "iy"}
GEMINATES = "b d t th l lh m n s sh r f p k g j ch y z".split()
PRENASAL_STOPS = "b d dh t th g".split()
NO_INVERSE = {"zh"}

# Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = (
    "dr mr mrs ms prof sr jr st rev hon gen col capt sgt vs etc no nos fig vol pp approx dept univ inc ltd co est min max al "
    "jan feb mar apr jun jul aug sept sep oct nov dec mon tue tues wed thu thur thurs fri sat sun"
).split()
SENTENCE_ENDS = ".!?؟۔"
CLOSERS = "\"'’”)]»"

# Domains, spellings folded into them, typographic marks folded to ASCII.
DOMAINS = (
    "politics", "local news", "crime", "business", "sports", "international", "health", "entertainment", "education",
    "environment", "religion", "technology", "tourism", "society", "law",
)
DOMAIN_ALIASES = {
    "poltics": "politics", "politic": "politics", "poliics": "politics", "busines": "business", "entertainement": "entertainment",
    "heath": "health", "loc al news": "local news", "internationa l": "international", "internationale": "international",
    "religious": "religion", "legal": "law", "accidents": "accident", "social issues": "society", "societal values": "society",
    "arts and culture": "culture", "art and culture": "culture",
}
PUNCTUATION_FOLD = {
    "…": "...", "“": '"', "”": '"', "„": '"', "«": '"', "»": '"', "‘": "'", "’": "'", "‚": "'", "–": "-", "—": "-", "−": "-",
    "•": "-", "·": "-", "\u00a0": " ", "\u202f": " ", "\u2009": " ", "،": ",", "؛": ";", "؟": "?", "۔": ".", "٪": "%",
}

# Patterns.
WORD = r"[ހ-޿]+|[a-zA-ZÁÉÍÓÚáéíóú]+(?:['-][a-zA-ZÁÉÍÓÚáéíóú]+)*|[0-9]+(?:[.,][0-9]+)+|[0-9]+|[.,;:!?()\[\]{}\"'،؛؟ـ۔]"
WORD_TOKEN = r"^(?:[ހ-޿]+|[a-zA-ZÁÉÍÓÚáéíóú]+(?:['-][a-zA-ZÁÉÍÓÚáéíóú]+)*)$"
TIME_AGO = r"(?i)^[0-9]+\s+(second|minute|hour|day|week|month|year)s?\s+.*ago\.?$"
UI_STRING = r"%[sdifg@]|%[0-9]+\$[sdifg@]|\{[0-9]+\}|</?[a-z][a-z0-9]*>"
SECOND_PERSON = r"(?i)(^|[^\p{L}\p{N}_])(i|i'm|i'll|i've|me|my|mine|we|we're|our|you|you're|your|yours)($|[^\p{L}\p{N}_])"
QUOTED = r"[\"“‘].+[\"”’]"
FOREIGN_LETTERS = r"(?i)[wx]|c([^h]|$)"
VALID_KEY = r"^[a-z][a-z' ]*$"
MIN_WORDS, MIN_CHARS, MAX_CHARS, MIN_RATIO, MAX_RATIO = 3, 2, 600, 0.4, 2.5
QUARANTINE_ROWS, MAX_TOKENS = 5000, 128

# Suffixes and what they say.
NOUN_SUFFIXES = {
    "ge": ("genitive", "of"), "gey": ("genitive", "of"), "ah": ("dative", "to"), "gai": ("locative", "in/on/at"), "ga": ("locative", "on/in"),
    "in": ("ablative", "from/by"), "un": ("ablative", "from"), "ek": ("indefinite", "a"), "eh": ("indefinite", "a"), "aku": ("indefinite", "a"),
    "aai": ("sociative", "and/with"), "kamah": ("indefinite_dative", "to"),
}
VERB_SUFFIXES = {
    "an": ("infinitive", "to"), "nna": ("infinitive", "to"), "fi": ("past", "did"), "i": ("past", "did"), "jje": ("perfective_past", "has"),
    "ijje": ("perfective_past", "has"), "aane": ("future", "will"), "ene": ("future", "will"), "vani": ("present_focus", "is"),
    "nee": ("present_focus", "is"), "anee": ("present_focus", "is"), "amun": ("progressive", "while"), "un": ("verbal_noun", "doing"),
    "fai": ("converb_sequential", "having"), "fei": ("converb_sequential", "having"), "gen": ("converb_completive", "having"),
}
STEM_SUFFIXES = {
    "thakuge": "of", "thakah": "to", "thakun": "from", "thakaai": "and", "thakee": "", "thaku": "", "thah": "", "tha": "", "kamaai": "and",
    "kamuge": "of", "kamah": "to", "kamun": "from", "kamee": "", "kan": "", "kohdhehvai": "", "dhehvai": "", "dhehvi": "", "vamun": "",
    "veyiru": "when", "veemaa": "if", "vanee": "", "vaane": "", "vejje": "", "vaa": "", "vee": "", "vun": "", "vi": "", "ve": "", "kollun": "",
    "kolli": "", "koh": "", "anan": "", "fulhun": "", "fulhu": "", "eve": "", "gai": "in", "gey": "of", "ge": "of", "ah": "to", "ash": "to",
    "aai": "and", "un": "from", "in": "from", "ai": "", "aku": "a", "akee": "is", "ek": "a", "eh": "a", "ee": "", "ey": "",
}
SHORTEST_ROOT = {
    "ah": 2, "gai": 2, "ga": 2, "fulhu": 2, "fulhun": 2, "kolhu": 2, "kolhun": 2, "thakuge": 3, "thakah": 3, "thakun": 3, "thakaai": 3,
    "thaku": 3, "kamaai": 3, "kamuge": 3, "kamah": 3, "kamun": 3, "kohdhehvai": 3, "dhehvai": 3, "veyiru": 3, "vamun": 3,
}
ROOT_LENGTH, STRIP_DEPTH, MAX_VARIANTS = 5, 3, 64
INFLECTIONS = ("kamah", "vani", "nna", "gey", "ge", "ah", "ga", "eh", "un", "in", "fi", "anan", "ee")
LETTER_VARIANTS = (("q", "g"), ("kh", "h"), ("gh", "g"), ("dhh", "dh"))
FINAL_VARIANTS = (("m", "n"), ("h", "s"))
VOWEL_VARIANTS = (("ey", "e"), ("ee", "i"), ("aa", "a"), ("oo", "u"))

# Function words in both directions.
CLOSED_ENGLISH = {
    "i": "aharen", "me": "aharen", "my": "aharenge", "we": "aharemen", "us": "aharemen", "you": "kaley", "he": "eyna", "she": "eyna",
    "they": "emeehun", "them": "emeehun", "self": "thimaa", "this": "mi", "that": "ey", "one": "ek", "which": "kon", "what": "kon", "not": "nu",
    "also": "ves", "although": "namaves", "when": "iru", "now": "adhu", "later": "fahun", "go": "dhaa", "going": "dhaa", "went": "dhiya",
    "gone": "dhiya", "come": "ann", "live": "ulhun", "drink": "bonun", "give": "dhinun", "sleep": "nidun", "look": "belun", "take": "gann",
    "buy": "gathun", "find": "hoadhun", "read": "kiyun", "write": "liyun", "male": "male", "malé": "male", "maldives": "raajje", "addu": "addu",
    "hulhumale": "hulhumale", "hulhumalé": "hulhumale", "today": "miadhu", "yesterday": "iyye", "tomorrow": "maadhamaa", "water": "fen",
    "house": "ge", "home": "ge", "person": "meehu", "people": "meehun", "food": "kei", "book": "foiy", "fish": "mas", "say": "bunun",
    "eat": "keun", "see": "belun", "know": "engun",
}
CLOSED_LATIN = {
    "aharen": "I", "aharenge": "my", "aharemen": "we", "ahah": "to me", "kaley": "you", "eyna": "he/she", "emeehun": "they", "thimaa": "self",
    "thimange": "own", "thibaa": "you", "mi": "this", "e": "that", "ey": "that", "thi": "that", "thiya": "that", "ek": "one", "kon": "which",
    "nu": "not", "nuun": "no", "neth": "there is not", "noonee": "if not", "eve": "they say", "ves": "also", "namaves": "although",
    "iru": "when", "maa": "when", "gai": "in", "ah": "to", "dhaa": "go", "dhaan": "go", "dhaanan": "go", "dhiya": "go", "dhiyun": "go",
    "ann": "come", "annan": "come", "ulhun": "live", "ulee": "live", "huri": "was", "vanee": "is", "bonun": "drink", "dhinun": "give",
    "nidun": "sleep", "gann": "take", "gathun": "buy", "hoadhun": "find", "kurun": "do", "kiyun": "read", "liyun": "write", "male": "Male",
    "maale": "Male", "raajje": "Maldives", "addu": "Addu", "hulhumale": "Hulhumale", "miadhu": "today", "iyye": "yesterday",
    "maadhamaa": "tomorrow", "adhu": "now", "fahun": "later", "fen": "water", "ge": "house", "meehu": "person", "meehun": "people",
    "kei": "food", "foiy": "book", "mas": "fish", "bunun": "say", "keun": "eat", "belun": "look", "engun": "know",
}
ONE_WAY = ("me", "us", "them", "what", "going", "went", "gone", "home", "see", "malé", "hulhumalé")

# Parts of speech, English function words.
POS = {
    "n": "noun", "noun": "noun", "nan": "noun", "ނަން": "noun", "nanithuruge nan": "noun", "v": "verb", "verb": "verb", "masdharu": "verb",
    "kan": "verb", "adj": "adjective", "adjective": "adjective", "nanithuru": "adjective", "adv": "adverb", "adverb": "adverb",
    "kanithuru": "adverb", "ithuru": "adverb", "pron": "pronoun", "pronoun": "pronoun", "conj": "conjunction", "conjunction": "conjunction",
    "particle": "particle", "prep": "preposition", "preposition": "preposition", "interj": "interjection", "num": "numeral",
    "numeral": "numeral", "akuru": "unknown",
}
WEAK_POS = ("", "unknown", "akuru")
POS_OVERRIDES = {
    "aharen": "pronoun", "aharemen": "pronoun", "aharenge": "pronoun", "kaley": "pronoun", "thibaa": "pronoun", "eyna": "pronoun",
    "emeehun": "pronoun", "thimaa": "pronoun", "thimange": "pronoun", "mi": "pronoun", "e": "pronoun", "ey": "pronoun", "thi": "pronoun",
    "thiya": "pronoun", "kon": "pronoun", "nu": "particle", "nuun": "particle", "neth": "particle", "noonee": "particle", "eve": "particle",
    "ves": "particle", "namaves": "conjunction", "iru": "particle", "maa": "particle", "gai": "particle", "ah": "particle", "ge": "particle",
    "male": "proper", "maale": "proper", "raajje": "proper", "addu": "proper", "hulhumale": "proper",
}
STOPWORDS = (
    "a an the of to in on at for and or with is are was were be been by from that this kind sort type used someone something person place"
).split()
