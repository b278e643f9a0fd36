"""Lexicons derived from documents and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomtext.functions import morphology as M, script as S, tables as T, text as X
from loomtext.operators import lexicon as L, sampling as P
from loomtext.plans.registry import WORDS, document_words, query, table

_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
_LEXICON = f"select word as latin, count(*) as frequency from ({WORDS}) group by word having count(*) >= 2"
#: Words to look up: those of conversations.
_SAID = "select unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{M}'']+')) as word from conversations"
_ASKED = f"select distinct word from ({_SAID})"
_PARTS = "select p_name as latin, max(p_size)::bigint as frequency, case when split_part(p_name, ' ', 1) = split_part(p_name, ' ', 2) then [split_part(p_name, ' ', 1)] else [split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)] end as english from part group by p_name"


def _lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.vocabulary(document_words(spark, sf_dir))


def _said(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return turns.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[\\p{L}\\p{M}']+"), F.lit(0))).alias("word"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _said(spark, sf_dir).distinct()


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as headwords with their words as glosses."""
    gloss = F.array_distinct(F.array(F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))))
    return table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("latin")).agg(F.max("p_size").cast("long").alias("frequency"), F.first(gloss).alias("english"))


@query(f"select latin, frequency from ({_LEXICON}) union all select w, 0 from unnest([{_STOP}]) t(w) where w not in (select latin from ({_LEXICON}))")
def lexicon_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that occur twice or more, and function words."""
    return L.vocabulary(document_words(spark, sf_dir), 2, T.STOPWORDS)


@query(f"select word, latin, frequency from ({_ASKED}) join ({_LEXICON}) on lower(trim(latin)) = lower(trim(word))")
def lookup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that are headwords."""
    return L.lookup_exact(_asked(spark, sf_dir), _lexicon(spark, sf_dir))


@query(f"""with l as ({_LEXICON}), p as (select latin, frequency, unnest(list_transform(range(4, length(latin) + 1), lambda n: latin[1:n])) as word from l where length(latin) >= 4)
  select word, place, latin, frequency from (select word, latin, frequency, row_number() over (partition by word order by length(latin), frequency desc, latin)::int as place
  from ({_ASKED}) join p using (word)) where place <= 5""")
def lookup_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headwords that the words begin."""
    return L.lookup_prefix(_asked(spark, sf_dir), _lexicon(spark, sf_dir))


@query(f"""with g as (select latin, frequency, generate_subscripts(english, 1)::int - 1 as rank, lower(trim(unnest(english))) as word from ({_PARTS})),
  m as (select word, latin, frequency, min(rank) as rank from g group by all)
  select word, place, latin, rank from (select word, latin, rank, row_number() over (partition by word order by rank, frequency desc, latin)::int as place from m) where place <= 5""")
def lookup_gloss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by the words of their names."""
    parts = _parts(spark, sf_dir)
    return L.lookup_gloss(parts.select(F.explode("english").alias("word")), parts)


_PADDED = "select p_name as latin, max(p_size)::bigint as frequency, [case when max(p_size) % 3 = 0 then upper(split_part(p_name, ' ', 1)) || ' ' else upper(split_part(p_name, ' ', 1)) end, split_part(p_name, ' ', 2)] as english from part group by p_name"


@query(f"""with e as (select latin, frequency, english, unnest(english) as gloss from ({_PADDED})), g as (select latin, frequency, lower(trim(gloss)) as word, list_position(list_transform(english, lambda g: lower(g)), lower(trim(gloss))) as nth from e),
  m as (select word, latin, frequency, coalesce(min(nullif(nth, 0)) - 1, 99)::int as rank from g group by all)
  select word, place, latin, rank from (select word, latin, rank, row_number() over (partition by word order by rank, frequency desc, latin)::int as place from m) where place <= 5""")
def lookup_gloss_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by the words of their names, some of which have a space too many: those stand last."""
    one = F.upper(F.split_part("p_name", F.lit(" "), F.lit(1)))
    size = F.max("p_size").cast("long")
    rows = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("latin")).agg(size.alias("frequency"))
    one, two = F.upper(F.split_part("latin", F.lit(" "), F.lit(1))), F.split_part("latin", F.lit(" "), F.lit(2))
    parts = rows.withColumn("english", F.array(F.when(F.col("frequency") % 3 == 0, F.concat(one, F.lit(" "))).otherwise(one), two))
    return L.lookup_gloss(parts.select(F.explode("english").alias("word")).select(F.lower(F.btrim("word")).alias("word")), parts)


#: Glosses of several shapes: none, empty, a placeholder, a real one; headwords of which some are empty.
_SHAPED = """select p_partkey, p_name as word, case when p_size % 5 = 0 then null when p_size % 5 = 1 then '' else p_type end as latin, case when p_size % 4 = 0 then []::varchar[] when p_size % 4 = 1 then ['[unknown: ' || p_name || ']', 'x'] when p_size % 4 = 2 then [''] else [p_brand, 'x'] end as english,
  case when p_size % 7 = 0 then '' when p_size % 7 < 4 then null else p_container end as stem, case when p_size % 3 = 0 then '' else p_brand end as read from (select *, p_type || '!' as p_container from part)"""


@query(f"""select p_partkey, case when len(english) > 0 and english[1] <> '' and not starts_with(english[1], '[unknown:') then english[1] when latin <> '' then latin else word end as gloss,
  coalesce(nullif(stem, ''), nullif(read, ''), nullif(latin, ''), word) as value from ({_SHAPED})""")
def gloss_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gloss and the Latin value that stand for a word, by what there is of them."""
    n, name = F.col("p_size"), F.col("p_name")
    latin = F.when(n % 5 == 0, None).when(n % 5 == 1, "").otherwise(F.col("p_type"))
    english = F.when(n % 4 == 0, F.array().cast("array<string>")).when(n % 4 == 1, F.array(F.concat(F.lit("[unknown: "), name, F.lit("]")), F.lit("x"))).when(n % 4 == 2, F.array(F.lit(""))).otherwise(F.array(F.col("p_brand"), F.lit("x")))
    stem = F.when(n % 7 == 0, "").when(n % 7 < 4, None).otherwise(F.concat("p_type", F.lit("!")))
    read = F.when(n % 3 == 0, "").otherwise(F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", L.gloss_of(english, latin, name).alias("gloss"), L.latin_value(stem, read, latin, name).alias("value"))


_HONOURED = f"select latin, case length(latin) % 4 when 0 then 'reverential' when 1 then 'informal' else 'written' end as register from ({_LEXICON}) where length(latin) % 4 < 3 and frequency % 2 = 0"


@query(f"""with w as (select conv_id, turn, lower(unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}'']+'))) as word from conversations),
  h as (select lower(trim(latin)) as word, bool_or(register in ('written', 'reverential', 'respectful')) as formal from ({_HONOURED}) group by 1),
  f as (select conv_id, turn, bool_or(ends_with(word, 'eve') or coalesce(formal, false)) as written, count(formal) as honorific from w left join h using (word) group by all)
  select c.conv_id, c.turn, case when written then 'written' else 'neutral' end as register, coalesce(honorific, 0) as honorific from conversations c left join f using (conv_id, turn)""".replace("\\\\", "\\"))
def register_honorifics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The register of each turn, by a table of honorifics and by endings, and how many honorifics it has."""
    length = F.length("latin") % 4
    register = F.when(length == 0, "reverential").when(length == 1, "informal").otherwise("written")
    honorifics = _lexicon(spark, sf_dir).where((length < 3) & (F.col("frequency") % 2 == 0)).select("latin", register.alias("register"))
    turns = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("at"), F.regexp_extract_all(F.lower("text"), F.lit("[\\p{L}\\p{M}']+"), F.lit(0)).alias("words"))
    return M.registers(turns, "at", "words", honorifics).select("at.conv_id", "at.turn", "register", "honorific")


def _values(rows: list[tuple]) -> str:
    return "values " + ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'" for v in r) + ")" for r in rows)


def _stems_sql(words: str, lexicon: str) -> str:
    """CTEs up to stem (word, root, suffixes, hints) of `words` (word): candidates as rows, ordered as they are tried, joined with the lexicon."""
    stem = sorted(T.STEM_SUFFIXES.items(), key=lambda x: -len(x[0]))
    suffixes = _values([(k, s, h, T.SHORTEST_ROOT.get(s, T.ROOT_LENGTH)) for k, (s, h) in enumerate(stem)])
    cut = "select word, s[1:length(s) - length(x)] as s, list_append(path, k) as path, list_append(taken, x) as taken, case when h <> '' then list_append(hints, h) else hints end as hints from {} join sx on ends_with(s, x) and length(s) - length(x) >= least_"
    ends = [(k, *r) for k, r in enumerate((*T.FINAL_VARIANTS, *T.VOWEL_VARIANTS))]
    return f"""sx(k, x, h, least_) as ({suffixes}), lx(k, a, b) as ({_values([(k, *r) for k, r in enumerate(T.LETTER_VARIANTS)])}), ex(k, a, b) as ({_values(ends)}),
  l0 as (select word, lower(trim(word)) as s, []::int[] as path, []::varchar[] as taken, []::varchar[] as hints from ({words}) where trim(word) <> ''),
  l1 as ({cut.format("l0")}), l2 as ({cut.format("l1")}), l3 as ({cut.format("l2")}),
  ls as (select * from l0 union all select * from l1 union all select * from l2 union all select * from l3),
  sp(s, v, p) as (select distinct s, s, []::int[] from ls union all select s, replace(v, a, b), list_append(p, k) from sp join lx on contains(v, a) where len(p) < 64),
  sr as (select s, v, row_number() over (partition by s order by min(struct_pack(n := len(p), p := p))) as r from sp group by s, v),
  en as (select s, r, k, v[1:length(v) - length(a)] || b as v from sr join ex on ends_with(v, a)
    union all select s, r, 90, v[1:length(v) - 1] from sr where length(v) > 1 and v[-1] = v[-2] and regexp_matches(v, '[b-df-hj-np-tv-z]$')
    union all select s, r, 91, v || 'un' from sr where not regexp_matches(v, '[aeiou]$')),
  ca as (select s, v, 0 as phase, r, 0 as k from sr union all select s, v, 1, r, k from en where v <> ''),
  stem as (select word, arg_min(v, o) as root, arg_min(taken, o) as suffixes, arg_min(hints, o) as hints from
    (select word, ca.v, taken, hints, struct_pack(n := len(path), path := path, phase := phase, r := r, k := k) as o from ls join ca using (s) join (select distinct lower(trim(latin)) as v from ({lexicon})) lk on lk.v = ca.v) group by word)"""


#: The words as they are and in Thaana.
_MIXED = f"select word from ({_ASKED}) union select {S.duck_word_to_thaana('word')} from ({_ASKED})"


@query(f"""with recursive {_stems_sql(_ASKED, _LEXICON)}, h as (select lower(trim(latin)) as key, arg_max(latin, struct_pack(f := frequency, l := latin)) as latin from ({_LEXICON}) group by 1),
  cl(key, closed) as ({_values(sorted(T.CLOSED_LATIN.items()))}), px as (select latin, frequency, unnest(list_transform(range(4, length(latin) + 1), lambda n: latin[1:n])) as word from ({_LEXICON}) where length(latin) >= 4),
  pf as (select word, arg_min(latin, struct_pack(n := length(latin), f := -frequency, l := latin)) as latin from px group by word),
  w as (select distinct word, not regexp_matches(word, '[^\\x00-\\x7f]') as own, lower(trim(case when regexp_matches(word, '[^\\x00-\\x7f]') then {S.duck_to_latin('word')} else word end)) as key from ({_MIXED})),
  m as (select w.word, w.own, w.key, h.latin as exact, case when own then cl.closed end as closed, st.root, st.suffixes, hs.latin as stem_latin, pf.latin as longer from w left join h on h.key = w.key left join cl on cl.key = w.key
    left join stem st on own and st.word = w.key and st.root <> w.key left join h hs on hs.key = st.root left join pf on pf.word = w.key)
  select word, case when exact is not null then 'exact' when closed is not null then 'closed_class' when stem_latin is not null then 'stem' when longer is not null then 'prefix' else 'unknown' end as found,
    coalesce(exact, case when closed is not null then word end, stem_latin, longer, case when own then word else {S.duck_to_latin('word')} end) as latin, case when exact is null and closed is null and stem_latin is null then 'low' when own then 'high' else 'medium' end as confidence,
    case when not own and (exact is not null or longer is not null) then 'transliteration_lookup' when exact is not null then null when closed is not null then 'closed_class' when stem_latin is not null then null when longer is not null then 'prefix' else 'transliteration_only' end as fallback,
    case when exact is null and closed is null and stem_latin is not null then array_to_string(suffixes, '+') end as suffixes from m""")
def lookup_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of any script by the first of exact hit, closed class, stem and prefix; each word is asked in Thaana, too."""
    asked = _asked(spark, sf_dir)
    found = L.translate_words(asked.unionAll(asked.select(S.word_to_thaana(F.col("word")).alias("word"))), _lexicon(spark, sf_dir))
    return found.select("word", "found", "latin", "confidence", "fallback", F.array_join("suffixes", "+").alias("suffixes"))


_ENGLISH = f"select word from ({_ASKED}) union select unnest([{', '.join(repr(w) for w in sorted(T.CLOSED_ENGLISH) if w.isascii())}, 'almond', 'antique'])"


@query(f"""with w as (select distinct word, lower(trim(word)) as key from ({_ENGLISH})), cl(key, closed) as ({_values([kv for kv in sorted(T.CLOSED_ENGLISH.items()) if kv[0].isascii()])}),
  g as (select latin, frequency, generate_subscripts(english, 1) as rank, lower(trim(unnest(english))) as key from ({_PARTS})), h as (select distinct latin from ({_PARTS})),
  b as (select key, arg_min(latin, struct_pack(r := rank, f := -frequency, l := latin)) as latin from g group by key)
  select word, case when h.latin is not null then 'exact' when closed is not null then 'closed_class' when b.latin is not null then 'gloss' else 'unknown' end as found,
    coalesce(closed, b.latin, '[unknown: ' || word || ']') as latin, case when closed is null and b.latin is null then 'low' else 'high' end as confidence
  from w left join cl using (key) left join h on h.latin = closed left join b using (key)""")
def english_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English words by closed class and glosses."""
    more = spark.createDataFrame([(w,) for w in sorted(T.CLOSED_ENGLISH) if w.isascii()] + [("almond",), ("antique",)], "word string")
    return L.translate_english(_asked(spark, sf_dir).unionAll(more), _parts(spark, sf_dir)).select("word", "found", "latin", "confidence")


@query(f"""with w as ({_SAID}), l as ({_LEXICON})
  select count(*) as n, count(distinct word) as types, count_if(latin is null)::bigint as misses, count(distinct case when latin is null then word end) as missed_types from w left join l on latin = word""")
def unknown_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words without a headword, each time and once."""
    counts = _said(spark, sf_dir).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    met = counts.join(_lexicon(spark, sf_dir), F.col("word") == F.col("latin"), "left")
    miss = F.col("latin").isNull()
    return met.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("types"), F.coalesce(F.sum(F.when(miss, F.col("n"))), F.lit(0)).alias("misses"), F.count_if(miss).alias("missed_types"))


_KIND = "case when lower({0}) = 'ring' then 0 when starts_with(lower({0}), 'ring') then 1 when contains(lower({0}), 'ring') then 2 end"


@query(f"""with h as (select latin, {_KIND.format("latin")} as own, list_min(list_filter(list_transform(english, lambda g: {_KIND.format("g")}), lambda k: k is not null)) as gloss from ({_PARTS})),
  s as (select latin, least(own, gloss)::int as kind, case when own = least(own, gloss) then 'headword' else 'gloss' end as side from h where own is not null or gloss is not null)
  select latin, kind, side, (select count(*) from s) as total from s order by kind, side desc, length(latin), latin limit 50""")
def search_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 50 parts for a search, with the exact number of hits."""
    return L.search(_parts(spark, sf_dir), "ring")


#: Runs of letters of every word of the conversations, at every place, of two and four letters, and the words themselves.
_NEEDLES = f"select distinct unnest([word, word[1:2], word[-4:], word[2:5]]) as needle from ({_ASKED})"
_OTHER_KIND = "case when lower({0}) = needle then 0 when starts_with(lower({0}), needle) then 1 when contains(lower({0}), needle) then 2 end"


@query(f"""with n as (select needle from ({_NEEDLES}) where needle <> ''), l as (select latin, [reverse(latin), latin[1:3]] as english from ({_LEXICON})),
  h as (select needle, latin, {_OTHER_KIND.format("latin")} as own, list_min([k for k in [{_OTHER_KIND.format("english[1]")}, {_OTHER_KIND.format("english[2]")}] if k is not null]) as gloss
    from n join l on contains(lower(latin), needle) or contains(lower(english[1]), needle) or contains(lower(english[2]), needle)),
  s as (select needle, latin, least(own, gloss)::int as kind, case when own = least(own, gloss) then 'headword' else 'gloss' end as side from h)
  select needle, place, latin, kind, side, total from (select *, row_number() over (partition by needle order by kind, side desc, length(latin), latin)::int as place, count(*) over (partition by needle) as total from s) where place <= 50""")
def search_needles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of words, thousands at once, searched in a lexicon that has words backwards and beginnings as glosses."""
    word = F.col("word")
    needles = _asked(spark, sf_dir).select(F.explode(F.array(word, F.left(word, F.lit(2)), F.right(word, F.lit(4)), F.substring(word, 2, 4))).alias("needle"))
    lexicon = _lexicon(spark, sf_dir).select("latin", F.array(F.reverse("latin"), F.left("latin", F.lit(3))).alias("english"))
    return L.search_many(needles, lexicon)


@query(f"with recursive {_stems_sql(_ASKED, _LEXICON)} select word, root, array_to_string(suffixes, '+') as suffixes, array_to_string(hints, ' ') as hints from stem")
def stem_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems of words by the lexicon of the documents."""
    found = M.stems(_asked(spark, sf_dir), _lexicon(spark, sf_dir))
    return found.select("word", "root", F.array_join("suffixes", "+").alias("suffixes"), F.array_join("hints", " ").alias("hints"))


def _suffix_sql(base: str, kind: dict) -> str:
    cases = [f"when ends_with({base}, '{s}') and length({base}) - {len(s)} >= {T.SHORTEST_ROOT.get(s, T.ROOT_LENGTH)} then '{s}'" for s in sorted(kind, key=lambda s: -len(s))]
    return "case " + " ".join(cases) + " end"


_BASE = """case when ends_with(word, 'gaeeve') then word[:-7] || 'gai' when ends_with(word, 'eheve') then word[:-6] || 'eh' when ends_with(word, 'ekeve') then word[:-6] || 'ek'
  when ends_with(word, 'aheve') then word[:-6] || 'ah' when ends_with(word, 'eve') then word[:-4] else word end"""


_MARKED = f"select distinct word from ({WORDS}) union select 'nu-' || word || 'ge' from ({_ASKED}) union select word || 'gaeeve' from ({_ASKED})"


@query(f"""with b as (select word, regexp_replace({_BASE}, '^n[ui]-', '') as base, ends_with(word, 'eve') as written, regexp_matches({_BASE}, '^n[ui]-') as negative from ({_MARKED})),
  s as (select *, coalesce({_suffix_sql('base', T.NOUN_SUFFIXES)}, {_suffix_sql('base', T.VERB_SUFFIXES)}) as suffix from b)
  select word, base[1:length(base) - coalesce(length(suffix), 0)] as root, suffix, written, negative from s""")
def suffix_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots and suffixes of distinct words, some of them negated or with the narrative particle."""
    words = _marked(spark, sf_dir).withColumn("p", M.suffix_parse(F.col("word")))
    return words.select("word", "p.root", "p.suffix", "p.written", "p.negative")


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _asked(spark, sf_dir)
    more = asked.select(F.concat(F.lit("nu-"), "word", F.lit("ge")).alias("word")).unionAll(asked.select(F.concat("word", F.lit("gaeeve")).alias("word")))
    return document_words(spark, sf_dir).select("word").unionAll(more).distinct()


@query(f"""with b as (select word, regexp_replace({_BASE}, '^n[ui]-', '') as base from ({_MARKED})), k as (select distinct latin as base from ({_LEXICON})),
  s as (select word, b.base, case when k.base is null then coalesce({_suffix_sql('b.base', T.NOUN_SUFFIXES)}, {_suffix_sql('b.base', T.VERB_SUFFIXES)}) end as suffix from b left join k on k.base = b.base)
  select word, base[1:length(base) - coalesce(length(suffix), 0)] as root, suffix from s""")
def suffix_parse_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, but words of the lexicon are roots as they are."""
    return M.parse_known(_marked(spark, sf_dir), _lexicon(spark, sf_dir)).select("word", "root", "suffix")


@query("select p_name, p_name || s as form from (select distinct unnest(string_split(p_name, ' ')) as p_name from part), unnest([" + ", ".join(f"'{s}'" for s in T.INFLECTIONS) + "]) t(s)")
def inflect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inflected forms of the words of part names."""
    nouns = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("p_name")).distinct()
    return nouns.select("p_name", F.explode(M.inflections(F.col("p_name"))).alias("form"))


@query(f"""select word, case when ends_with(word, 'gai') then word[:-4] || 'gaeeve' when ends_with(word, 'eh') then word[:-3] || 'eheve' when ends_with(word, 'ek') then word[:-3] || 'ekeve' when ends_with(word, 'ah') then word[:-3] || 'aheve'
  when ends_with(word, 'ash') then word[:-4] || 'asheve' when ends_with(word, 'h') and length(word) > 2 then word[:-2] || 'eve' when regexp_matches(word, '[aeiou]$') then word || 'eve' else word || ' eve' end as fused
  from (select distinct word from ({WORDS}))""")
def merge_narrative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with the narrative particle."""
    return document_words(spark, sf_dir).select("word").distinct().select("word", M.with_narrative(F.col("word")).alias("fused"))


_SOURCES = """select p_name as latin, [p_type, upper(p_type), '[unknown:x]'] as english, case when p_size > 25 then 'n' else '' end as pos, p_size::bigint as frequency, p_partkey as source from part
  union all select p_name, [p_brand, p_type], 'verb', (p_size + 1)::bigint, p_partkey + 1000000 from part where p_size < 20"""


@query(f"""with r as ({_SOURCES}), g as (select latin, source, generate_subscripts(english, 1) as place, unnest(english) as gloss from r), k as (select latin, lower(gloss) as f, min(struct_pack(source := source, place := place, gloss := gloss)) as g from g where not starts_with(gloss, '[unknown:') group by all),
  l as (select latin, array_to_string(list_transform(list_sort(list(g)), lambda x: x.gloss), ';') as english from k group by latin),
  h as (select latin, max(frequency) as frequency, min(case when pos <> '' then struct_pack(source := source, pos := case when pos = 'n' then 'noun' else pos end) end) as p from r group by latin)
  select latin, english, coalesce(p.pos, 'unknown') as pos, frequency from h join l using (latin)""")
def lexicon_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources of part entries merged by key."""
    part = table(spark, sf_dir, "part")
    size = F.col("p_size").cast("long")
    base = part.select(F.col("p_name").alias("latin"), F.array("p_type", F.upper("p_type"), F.lit("[unknown:x]")).alias("english"), F.when(size > 25, "n").otherwise("").alias("pos"), size.alias("frequency"), F.col("p_partkey").alias("source"))
    more = part.where("p_size < 20").select(F.col("p_name").alias("latin"), F.array("p_brand", "p_type").alias("english"), F.lit("verb").alias("pos"), (size + 1).alias("frequency"), (F.col("p_partkey") + 1000000).alias("source"))
    return L.merge_sources(base.unionAll(more)).withColumn("english", F.array_join("english", ";"))


@query("""select n_name, case when f and not regexp_matches(lower(r_name), '(?i)[wx]|c([^h]|$)') then 'inverted' when f then 'corrupt' when not regexp_matches(lower(n_name), '^[a-z][a-z'' ]*$') then 'malformed' else 'clean' end as class
  from (select n_name, r_name, regexp_matches(n_name, '(?i)[wx]|c([^h]|$)') as f from nation join region on n_regionkey = r_regionkey)""")
def lexicon_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation names by spelling, with their region as gloss."""
    met = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return met.select("n_name", X.headword_class(F.col("n_name"), F.array("r_name")).alias("class"))


@query("""select p_partkey, k as key from (select p_partkey, unnest(list_distinct([lower(split_part(p_name, ' ', 1)), lower(split_part(p_name, ' ', 2)), lower(p_type)])) as k from part) where length(k) >= 2""")
def split_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of compound headwords."""
    part = table(spark, sf_dir, "part")
    compound = F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit("/"), F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit(" ("), "p_type", F.lit(")"))
    return part.select("p_partkey", F.explode(X.split_keys(compound)).alias("key"))


@query("select p_partkey, array_to_string([p_name || ' (' || p_type || ')/x', p_name || ' /x', p_name || ' (' || p_type || ')', p_name, 'x'], ';') as glosses from part")
def expand_glosses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms of a gloss with alternatives and parentheses."""
    gloss = F.concat("p_name", F.lit(" ("), "p_type", F.lit(")/x"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(X.expand_glosses(F.array(gloss)), ";").alias("glosses"))


_GLOSSED = "select distinct split_part(p_name, ' ', 1) as latin, split_part(p_name, ' ', 2) as gloss from part union select distinct split_part(p_name, ' ', 2), split_part(p_name, ' ', 1) from part where p_size > 20"


@query(f"""with g as ({_GLOSSED}), n as (select latin, count(*) as n_glosses, sum(length(gloss)) as frequency from g group by latin), e as (select g.latin, gloss, frequency, n_glosses from g join n using (latin))
  select distinct case when a.frequency <= b.frequency then a.latin else b.latin end as loser, case when a.frequency <= b.frequency then b.latin else a.latin end as winner,
  case when a.frequency = b.frequency then 'tie' when case when a.frequency < b.frequency then a.n_glosses else b.n_glosses end = 1 then 'fixed' else 'review' end as verdict
  from e a join e b on a.gloss = b.latin and b.gloss = a.latin and a.latin < b.latin""")
def mirror_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of part names that gloss each other."""
    one, two = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    part = table(spark, sf_dir, "part")
    g = part.select(one.alias("latin"), two.alias("gloss")).union(part.where("p_size > 20").select(two.alias("latin"), one.alias("gloss"))).distinct()
    n = g.groupBy("latin").agg(F.count(F.lit(1)).alias("n_glosses"), F.sum(F.length("gloss")).alias("frequency"))
    return L.mirror_pairs(g.join(n, "latin"))


_REWRITES = "select c_custkey::varchar as old, case when c_custkey % 11 = 0 then '' when c_custkey < 4 then ((c_custkey + 1) % 4)::varchar else (c_custkey // 2 + 3)::varchar end as new from customer"


@query(f"""with recursive r as ({_REWRITES}), h(old, via, steps) as (select old, new, 1 from r union all select h.old, r.new, h.steps + 1 from h join r on r.old = h.via where h.steps <= (select count(*) from r))
  select old, case when max(steps) > (select count(*) from r) then null else nullif(arg_max(via, steps), '') end as final, case when max(steps) <= (select count(*) from r) then max(steps) end as steps from h group by old""")
def rewrite_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where chains of rewritten keys end."""
    key = F.col("c_custkey")
    new = F.when(key % 11 == 0, "").when(key < 4, ((key + 1) % 4).cast("string")).otherwise((F.floor(key / 2) + 3).cast("string"))
    return L.closure(table(spark, sf_dir, "customer").select(key.cast("string").alias("old"), new.alias("new")))


@query(f"""select reading, arg_min(word, struct_pack(n := -frequency, w := word)) as canonical, count(*) as n, array_to_string(list(word order by -frequency, word), ' ') as members
  from (select latin as word, frequency, {S.duck_word_to_thaana('latin')} as reading from ({_LEXICON})) group by reading having count(*) > 1""")
def collision_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headwords that are written alike in Thaana, the most frequent first."""
    place = F.struct((-F.col("frequency")).alias("n"), F.col("latin").alias("w"))
    rows = _lexicon(spark, sf_dir).select(F.col("latin").alias("letter"), S.word_to_thaana(F.col("latin")).alias("reading"), place.alias("place"))
    return L.collisions(rows, " ")


@query(f"""select latin, greatest(frequency, coalesce(seen, 0)) as frequency, case when seen > frequency then 'corpus' end as freq_source
  from ({_LEXICON}) left join (select word, count(*) * 20 as seen from ({_SAID}) group by word) on latin = word""")
def frequency_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headwords whose frequency the conversations raise, a word of theirs for 20."""
    seen = _said(spark, sf_dir).groupBy(F.col("word").alias("latin")).agg((F.count(F.lit(1)) * 20).alias("frequency"))
    return L.raise_frequency(_lexicon(spark, sf_dir), seen).select("latin", "frequency", "freq_source")


@query(f"select latin, frequency, row_number() over (order by frequency desc, lower(latin), latin) as place from ({_LEXICON})")
def export_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entries of the lexicon with their places as it is exported."""
    return L.export_places(_lexicon(spark, sf_dir))


@query(f"select latin from ({_LEXICON}) where latin not in (select word from ({_SAID}))")
def lost_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headwords that conversations don't have."""
    return L.lost_keys(_lexicon(spark, sf_dir), _said(spark, sf_dir).select(F.col("word").alias("latin")))


@query("select p_partkey, array_to_string([p_name, p_type, p_brand], '+') as listed, case when p_size % 3 = 0 then 'noun' when p_size % 3 = 1 then 'verb' else p_type end as pos from part")
def parse_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gloss lists in several notations, and parts of speech by canonical name."""
    n = F.col("p_size")
    raw = F.when(n % 2 == 0, F.concat_ws(" ; ", "p_name", "p_type", "p_brand")).otherwise(F.to_json(F.array("p_name", "p_type", "p_brand")))
    pos = F.when(n % 3 == 0, " N ").when(n % 3 == 1, "masdharu").otherwise(F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(X.parse_glosses(raw), "+").alias("listed"), X.canonical_pos(pos).alias("pos"))


@query(f"""select doc_id, len(w) > 1 and len(list_filter(w, lambda t: t in ({_STOP}))) > 0 as phrase, round(case when len(w) = 0 then 0 else len(list_filter(w, lambda t: t in ({_STOP}))) * 1.0 / len(w) end, 6)::double as overlap
  from (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z'']+'), lambda t: length(t) > 1) as w from documents)""")
def english_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that look like English, and their share of function words."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", X.english_phrase(F.col("text")).alias("phrase"), F.round(X.overlap_ratio(X.alpha_tokens(F.col("text")), T.STOPWORDS), 6).alias("overlap"))


_FUNCTION_WORDS = ", ".join(f"'{w}'" for w in sorted(T.CLOSED_LATIN))


@query(f"select word, {S.duck_word_to_thaana('word')} as thaana, n from (select word, count(*) as n from (select word from ({WORDS}) union all {_SAID} union all select unnest([split_part(p_name, ' ', 1), left(p_name, 2), right(p_name, 2), left(p_name, 3)]) from part) where word in ({_FUNCTION_WORDS}) group by word)")
def closed_class_thaana(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Function words that documents, conversations and names of parts have, in Thaana, and how often."""
    name = F.col("p_name")
    parts = table(spark, sf_dir, "part").select(F.explode(F.array(F.split_part(name, F.lit(" "), F.lit(1)), F.left(name, F.lit(2)), F.right(name, F.lit(2)), F.left(name, F.lit(3)))).alias("word"))
    every = document_words(spark, sf_dir).select("word").unionAll(_said(spark, sf_dir)).unionAll(parts)
    found = every.where(F.col("word").isin(*sorted(T.CLOSED_LATIN))).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return found.select("word", S.to_thaana(F.col("word")).alias("thaana"), "n")
