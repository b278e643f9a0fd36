"""Tokens, scripts, sentences and round trips over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomtext.functions import morphology as M, script as S, tables as T, text as X
from loomtext.functions.segment import duck_sentences, sentences
from loomtext.operators import metrics as N, sampling as P
from loomtext.plans.registry import WORDS, document_words, query, table
from loomtext.plans.trace import trace_documents
from loomtext.spread import spread

_WORD = T.WORD.replace("'", "''")
_ONE_LINE = "trim(regexp_replace(text, '[ \\t-\\r]+', ' ', 'g'))"
_TOKENS = f"select doc_id, unnest(regexp_extract_all({_ONE_LINE}, '{_WORD}')) as token from documents"


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(X.tokens(F.col("text"))).alias("token"))


@query(f"select token, count(*) as n, count(distinct doc_id) as docs from ({_TOKENS}) group by token")
def tokenize_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tokens with their counts, by document first, so that a frequent token meets as one row for each of its documents at most."""
    in_doc = _tokens(spark, sf_dir).groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n"))
    return in_doc.groupBy("token").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs"))


@query(f"""select count(*) as tokens, count(distinct token) as types, round(avg(length(token)), 6) as chars_per_token,
  (select round(avg(length(token)), 6) from (select distinct token from ({_TOKENS}) where regexp_matches(token, '{T.WORD_TOKEN.replace("'", "''")}'))) as chars_per_type
  from ({_TOKENS}) where regexp_matches(token, '{T.WORD_TOKEN.replace("'", "''")}')""")
def type_vs_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words counted each time and once."""
    words = table(spark, sf_dir, "documents").select(F.explode(X.words_only(F.col("text"))).alias("token"))
    counts = words.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    size = F.length("token")
    return counts.agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("types"), F.round(F.sum(size * F.col("n")) / F.sum("n"), 6).alias("chars_per_token"), F.round(F.avg(size), 6).alias("chars_per_type"))


@query(f"""with c as (select ceil(length(word) / 4.0)::int as bin, count(*) as n from (select distinct word from ({WORDS})) group by 1)
  select g.bin::int as bin, coalesce(n, 0) as n, round(100.0 * coalesce(n, 0) / (select sum(n) from c), 3)::double as percent from range(1, 16) g(bin) left join c on c.bin = g.bin""")
def pieces_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of four letters per distinct word, on a grid of 1 to 15."""
    words = document_words(spark, sf_dir).select("word").distinct().withColumn("pieces", F.ceil(F.length("word") / 4.0))
    return N.histogram(words, "pieces", 1, 15)


_CLASSES = {"thaana": "[ހ-޿]", "latin": "[a-zA-Z]", "digits": "[0-9]", "punctuation": "[.,;:!?()\\[\\]{}\"''،؛؟ـ۔]", "whitespace": "[ \\t-\\r]"}


@query("select doc_id, " + ", ".join(f"round(100.0 * (length(text) - length(regexp_replace(text, '{c}', '', 'g'))) / nullif(length(text), 0), 6)::double as {k}" for k, c in _CLASSES.items()) + " from documents")
def script_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percent of each document's characters by script."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", *[F.round(c, 6).alias(k) for k, c in X.composition(F.col("text")).items()])


@query("select doc_id, length(nfc_normalize(t)) as n, md5(nfc_normalize(t)) as digest from (select doc_id, translate(regexp_replace(text, '[\\x{200B}\\x{200C}\\x{200D}\\x{FEFF}]', '', 'g'), chr(160), ' ') as t from documents)")
def normalise_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in composed form without invisible marks."""
    docs = table(spark, sf_dir, "documents").select("doc_id", X.normalise(F.col("text")).alias("t"))
    return docs.select("doc_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("digest"))


def _fold_sql(text: str) -> str:
    """fold_punctuation() in SQL."""
    for mark, plain in T.PUNCTUATION_FOLD.items():
        quoted = plain.replace("'", "''")
        text = f"replace({text}, chr({ord(mark)}), '{quoted}')"
    return f"trim(regexp_replace({text}, '[\\x{{200B}}\\x{{200C}}\\x{{200D}}\\x{{FEFF}}]', '', 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


@query(f"select doc_id, md5({_fold_sql('text')}) as digest from (select doc_id, text || ' “x” … a–b ‘y’' as text from documents)")
def fold_punctuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, and typographic marks behind them, in ASCII punctuation."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(X.fold_punctuation(F.concat("text", F.lit(" “x” … a–b ‘y’")))).alias("digest"))


#: Documents as X.normalise() gives them.
_NORMAL = "(select doc_id, regexp_replace(replace(nfc_normalize(text), chr(160), ' '), '[\\x{200B}\\x{200C}\\x{200D}\\x{FEFF}]', '', 'g') as text from documents)"


@query(f"select * from {duck_sentences('documents', 'doc_id', 'text')}")
def sentence_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's sentences in order."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(sentences("text")).alias("place", "sentence"))


_ROLLED = f"select doc_id, count(*) as n from {duck_sentences(_NORMAL, 'doc_id', 'text')} group by doc_id"


@query(f"select d.doc_id, coalesce(r.n, 0) as sentences, false as available, cast(null as varchar) as output from documents d left join ({_ROLLED}) r on r.doc_id = d.doc_id")
def doc_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence traces rolled up by document; nothing is available as no model is loaded."""
    return trace_documents(table(spark, sf_dir, "documents"), "doc_id")


_DISTINCT = f"select distinct word from ({WORDS})"


def _distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(document_words(spark, sf_dir).select("word").distinct())


@query(f"select word, {S.duck_word_to_thaana('word')} as thaana from ({_DISTINCT})")
def la2th_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words in Thaana."""
    return _distinct(spark, sf_dir).select("word", S.word_to_thaana(F.col("word")).alias("thaana"))


@query(f"select word, {S.duck_to_latin('thaana')} as latin from (select word, {S.duck_word_to_thaana('word')} as thaana from ({_DISTINCT}))")
def th2la_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words in Thaana, read back in Latin letters."""
    return _distinct(spark, sf_dir).select("word", S.to_latin(S.word_to_thaana(F.col("word"))).alias("latin"))




def _one_byte(text: str) -> str:
    """Thaana as one byte for each letter: DuckDB's edit distance counts bytes."""
    letters = [*T.CONSONANTS, *T.SIGNS, T.SUKUN]
    return f"translate({text}, '{''.join(letters)}', '{''.join(map(chr, range(40, 40 + len(letters))))}')"


_PLAIN = "strip_accents(word)"
_TRIPS = f"""w as ({_DISTINCT}), a as (select word, {_PLAIN} as plain from w), t as (select word, case when regexp_matches(plain, '[A-Za-z]') then {S.duck_word_to_thaana('plain')} else plain end as thaana from a), l as (select word, thaana, {S.duck_to_latin('thaana')} as latin from t),
  b as (select word, thaana, latin, array_to_string(list_transform(regexp_extract_all(latin, '[ \\t-\\r]+|[^ \\t-\\r]+'), lambda p: case when regexp_matches(p, '[A-Za-z]') then {S.duck_word_to_thaana('lower(p)')} else p end), '') as back from l),
  s as (select *, {S.duck_to_latin('back')} = latin as stable, levenshtein({_one_byte('thaana')}, {_one_byte('back')}) as edits from b)"""


@query(f"""with {_TRIPS} select count(*) as n, round(100.0 * count_if(thaana = back) / count(*), 3)::double as exact, round(100.0 * count_if(thaana = back) / count(*), 3)::double as exact_folded,
  round(100.0 * count_if(stable) / count(*), 3)::double as latin_stable, sum(edits)::bigint as edits, round(sum(edits) * 1.0 / sum(length(thaana)), 5)::double as edits_per_char from s""")
def roundtrip_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words survive the way to Thaana, to Latin and back. No letter of the way there shares its reading, so folding changes nothing."""
    return N.round_trip_summary(N.round_trip(_distinct(spark, sf_dir)))


@query(f"""with {_TRIPS} select case when stable then 'spelling_normalised' when regexp_matches(latin, '[ހ-޿]') then 'unmapped_char' when regexp_matches(thaana, 'ނ[ބޑދތޓގޘޛޟޠ]') then 'prenasalized'
  when regexp_matches(thaana, 'ތް|ށް|އް') then 'coda_h_ambiguity' when contains(thaana, 'އ') then 'alifu_onset_ambiguity' when length(thaana) <> length(back) then 'length_mismatch' else 'other' end as class, count(*) as n
  from s where thaana <> back group by 1""")
def roundtrip_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why round trips fail."""
    return N.round_trip(_distinct(spark, sf_dir)).where("class is not null").groupBy("class").agg(F.count(F.lit(1)).alias("n"))


#: Keys for a word: its characters, two of them taken back, a space, the word from its end, and what runs on into the space.
_BACK = f"'{S.BACKSPACE}'"
_KEYED = f"""select word, list_concat(string_split(word, ''), [{_BACK}, {_BACK}, ' '], list_reverse(string_split(word, '')), [{_BACK}, chr(39), {_BACK}],
  list_transform(range(0, length(word)), lambda i: {_BACK}), ['A', 'n', '.', {_BACK}, {_BACK}, 'e']) as keys from (select distinct unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}'']+')) as word from conversations)"""
_COMPOSED = "case when regexp_matches(latin, '[A-Za-z]') then " + S.duck_word_to_thaana("lower(latin)") + " else latin end"


@query(f"""with recursive k as ({_KEYED}), s(word, keys, i, done, latin) as (select word, keys, 0, '', '' from k union all
  select word, keys, i + 1, case when regexp_matches(keys[i + 1], '^[a-zA-Z'']$') or keys[i + 1] = {_BACK} and latin <> '' then done when keys[i + 1] = {_BACK} then done[1:length(done) - 1] else done || {_COMPOSED} || keys[i + 1] end,
    case when regexp_matches(keys[i + 1], '^[a-zA-Z'']$') then latin || keys[i + 1] when keys[i + 1] = {_BACK} and latin <> '' then latin[1:length(latin) - 1] else '' end from s where i < len(keys))
  select word, done || {_COMPOSED} as shown, latin as composing from s where i = len(keys)""")
def ime_keystrokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an input method shows after the keys of each word of the conversations, with letters taken back."""
    turns = table(spark, sf_dir, "conversations")
    words = turns.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[\\p{L}\\p{M}']+"), F.lit(0))).alias("word")).distinct()
    each = F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.substring(F.col("word"), i, F.lit(1)))
    b = F.lit(S.BACKSPACE)
    more = F.array(b, F.lit("'"), b), F.array_repeat(b, F.length("word")), F.array(F.lit("A"), F.lit("n"), F.lit("."), b, b, F.lit("e"))
    keys = F.concat(each, F.array(b, b, F.lit(" ")), F.reverse(each), *more)
    return words.select("word", S.typed(keys).alias("typed")).select("word", F.col("typed.text").alias("shown"), F.col("typed.latin").alias("composing"))


@query(f"select p_name, unnest(list_transform(range(1, length(p_name) + 1), lambda n: {S.duck_word_to_thaana('p_name[1:n]')})) as shown from (select distinct unnest(string_split(p_name, ' ')) as p_name from part)")
def ime_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an input method shows key by key."""
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("p_name")).distinct()
    return words.select("p_name", F.explode(S.typed_prefixes(F.col("p_name"))).alias("shown"))


@query(f"""select doc_id, case when list_bool_or(list_transform(regexp_extract_all(lower({_ONE_LINE}), '{_WORD}'), lambda w: ends_with(w, 'eve'))) then 'written' else 'neutral' end as register from documents""")
def register_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a word that ends like written narrative."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", M.register_of(F.transform(X.tokens(F.col("text")), lambda t: F.lower(t))).alias("register"))


@query("""select lang, count(*) as n, sum(length(text))::bigint as chars, sum(strlen(text))::bigint as bytes, round(sum(strlen(text)) * 1.0 / sum(length(text)), 6)::double as bytes_per_char,
  sum(len(string_split(trim(regexp_replace(text, '[ \\t-\\r]+', ' ', 'g')), ' ')))::bigint as words from documents group by lang""")
def tokens_per_char(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters, UTF-8 bytes as byte-level tokens, and words of each language."""
    docs = table(spark, sf_dir, "documents")
    words = F.size(F.split(X.one_line(F.col("text")), " "))
    g = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"), F.sum(F.octet_length("text")).alias("bytes"), F.sum(words).alias("words"))
    return g.select("lang", "n", "chars", "bytes", F.round(F.col("bytes") / F.col("chars"), 6).alias("bytes_per_char"), "words")


_EVEN = [("p50", 0.5), ("p90", 0.9), ("p99", 0.99)]


@query("select lang as \"group\", count(*) as n, round(avg(k), 6) as mean, " + ", ".join(f"list_sort(list(k))[least(count(*) - 1, floor({q} * count(*)))::int + 1] as {n}" for n, q in _EVEN) + " from (select lang, len(string_split(text, chr(10)))::bigint as k from documents) group by lang")
def lines_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank quantiles of lines per document."""
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("group"), F.size(F.split("text", "\n", -1)).cast("long").alias("k"))
    return P.quantiles(docs, "group", "k", dict(_EVEN)).withColumn("mean", F.round("mean", 6))


@query("select count(*) as n, sum(length(id))::bigint as chars from (select distinct id from (select unnest(string_split(text, '')) as id from documents) union select chr(c::int) from range(32, 127) t(c)) where id <> ''")
def used_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct characters in use, with printable ASCII as a margin."""
    used = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(F.split("text", ""))).alias("id"))  # of each text once
    margin = spark.createDataFrame([(chr(c),) for c in range(32, 127)], "id string")
    return used.unionAll(margin).where("id <> ''").distinct().agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("id")).alias("chars"))
