"""Corpus building over documents and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomtext.functions import tables as T, text as X
from loomtext.operators import corpus as C, sampling as P
from loomtext.plans.registry import query, table
from loomtext.scratch import materialise
from loomtext.spread import spread

_BARE = "trim(regexp_replace(coalesce(text, ''), '[ \\t-\\r]+', ' ', 'g'))"
_REASON = f"""case when {_BARE} = '' then 'empty_side'
  when regexp_matches(text, '%[sdifg@]|%[0-9]+\\$[sdifg@]|\\{{[0-9]+\\}}|</?[a-z][a-z0-9]*>') then 'ui_string'
  when len(string_split({_BARE}, ' ')) < 3 then 'too_few_words' when length({_BARE}) > 2000 then 'length_bounds'
  when length(regexp_replace(text, '[\\x00-\\x7f]', '', 'g')) * 1.0 / nullif(length(text), 0) > 0.08 then 'non_ascii_latin' end"""
_NEAR = "trim(regexp_replace(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{M}}\\p{{N}} \\t-\\r]+', '', 'g'), '[ \\t-\\r]+', ' ', 'g'))"
_DEDUP = f"""select doc_id, source, case when doc_id = min(doc_id) over w then 'kept'
  when text is not distinct from arg_min(coalesce(text, ''), doc_id) over w then 'duplicate_exact' else 'duplicate_near' end as status
  from (select doc_id, source, text, case when k = '' then chr(2) || text else k end as k from (select doc_id, source, coalesce(text, '') as text, {_NEAR.format("coalesce(text, '')")} as k from documents)) window w as (partition by k)"""


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, reason, exact, near): rules and keys of each document, written once; no near key where a rule rejects."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").withColumn("reason", C.document_reason(F.col("text")))
    return docs.select("doc_id", "source", "reason", F.md5(text).alias("exact"), F.md5(X.letters_key(text)).alias("near"))


@query(f"select doc_id, source, status from ({_DEDUP})")
def dedup_exact_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as kept, exact or near duplicate of the first of its near key."""
    rows = materialise(_keyed(spark, sf_dir).select("doc_id", "source", "exact", "near"), "keyed")
    return C.mark_duplicates(rows, F.col("exact"), F.col("near"), "doc_id").select("doc_id", "source", "status")


@query(f"select reason, count(*) as n from (select {_REASON} as reason from documents) where reason is not null group by reason")
def reject_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that each funnel rule rejects, first rule first."""
    docs = table(spark, sf_dir, "documents").withColumn("reason", C.document_reason(F.col("text")))
    return C.funnel_counts(docs, "reason")


@query(f"""with r as (select doc_id, {_REASON} as reason from documents), d as ({_DEDUP.replace("from documents", f"from documents where ({_REASON}) is null")}),
  s as (select reason from r where reason is not null union all select status from d)
  select reason, count(*) as n from s group by reason""")
def corpus_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row rules, then duplicates among what passed: every document under its label; rules and keys are computed once."""
    rows = materialise(_keyed(spark, sf_dir), "keyed")
    marked = C.mark_duplicates(rows, F.col("exact"), F.when(F.col("reason").isNull(), F.col("near")), "doc_id")
    return C.funnel_counts(marked.select(F.coalesce("reason", "status").alias("reason")), "reason")


@query(f"""select doc_id, reason, length(text) as size, coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[^\\x00-\\x7f]'))), ''), '') as evidence
  from (select doc_id, text, {_REASON} as reason from documents) where reason is not null order by doc_id limit 5000""")
def quarantine_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected documents with the characters beyond ASCII that they have."""
    docs = table(spark, sf_dir, "documents").withColumn("reason", C.document_reason(F.col("text")))
    return C.quarantine(docs, "text", "reason", "doc_id").select("doc_id", "reason", F.col("size").cast("long").alias("size"), F.coalesce("evidence", F.lit("")).alias("evidence"))


_LABELS = "select distinct p_type as raw from part union select distinct 'Topic 4: ' || c_mktsegment from customer union select distinct event_type || ', Sports' from events union select distinct 'Law (' || r_name || ')' from region union select distinct n_name || '/Crime' from nation"


@query(f"""select raw, case when starts_with(t, 'politics') then 'politics' when starts_with(t, 'law') then 'law' when starts_with(t, 'business') then 'business' else 'other' end as domain
  from (select raw, trim(regexp_replace(regexp_replace(case when contains(lower(raw), ':') then trim(split_part(lower(raw), ':', 2)) else lower(raw) end, '(?s)[,/;|].*$', ''), '(?s)\\s*\\(.*$', '')) as t from ({_LABELS}))""")
def domain_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of several tables folded onto the canonical domains."""
    def labels(name: str, c: Column) -> DataFrame:
        return table(spark, sf_dir, name).select(c.alias("raw"))

    raw = labels("part", F.col("p_type")).union(labels("customer", F.concat(F.lit("Topic 4: "), "c_mktsegment"))).union(labels("events", F.concat("event_type", F.lit(", Sports"))))
    raw = raw.union(labels("region", F.concat(F.lit("Law ("), "r_name", F.lit(")")))).union(labels("nation", F.concat("n_name", F.lit("/Crime")))).distinct()
    return raw.select("raw", X.canonical_domain(F.col("raw")).alias("domain"))


@query("select source as domain, count(*) as n, count(distinct lang) as langs from documents group by source")
def domain_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and languages of each source."""
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("domain")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("lang").alias("langs"))


_SPLIT = """with s as (select source as name, count(*) as n from documents group by source), total as (select sum(n) as t from s),
  o as (select name, n, coalesce(sum(n) over (order by n, name rows between unbounded preceding and 1 preceding), 0) as b, row_number() over (order by n, name) as k from s where name <> 'src0'),
  a as (select name, n, (b < 0.05 * t or k = 1) as test from o, total),
  r as (select name, n, coalesce(sum(n) over (order by n, name rows between unbounded preceding and 1 preceding), 0) as b, row_number() over (order by n, name) as k from a where not test)
  select name, n, 'test' as split from a where test union all select name, n, case when b < 0.05 * t or k = 1 then 'valid' else 'train' end from r, total
  union all select name, n, 'train' from s where name = 'src0'"""


@query(_SPLIT)
def domain_holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole sources held out, smallest first."""
    sizes = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return C.hold_out_groups(sizes, ["src0"])


_ROWS = "select doc_id, case when k <= 30 then 'valid' when k <= 60 then 'test' else 'train' end as split from (select doc_id, row_number() over (order by md5('11|' || doc_id), doc_id) as k from documents)"


@query(_ROWS)
def row_holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents held out by a seeded shuffle."""
    return C.hold_out_rows(table(spark, sf_dir, "documents"), "doc_id", 11, 30, 30).select("doc_id", "split")


_SENTENCE = "md5(trim(coalesce(text, '')))"


@query(f"""with d as (select {_SENTENCE} as input, case when md5('7|' || doc_id) < '1' then 'valid' when md5('7|' || doc_id) < '2' then 'test' else 'train' end as split from documents),
  tr as (select distinct input from d where split = 'train'), te as (select * from d where split = 'test' and input not in (select input from tr)),
  va as (select * from d where split = 'valid' and input not in (select input from tr))
  select split, count(*) as n, count(distinct input) as inputs from (select * from d where split = 'train' union all select * from te union all select * from va where input not in (select input from te)) group by split""")
def leak_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents in three splits by their whole texts, less what leaks between them."""
    return C.without_leaks(_split_texts(spark, sf_dir), "input")[0].groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("input").alias("inputs"))


def _split_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lot = C.seeded_order(F.col("doc_id"), 7)
    line = F.md5(F.trim(F.coalesce("text", F.lit(""))))
    return table(spark, sf_dir, "documents").select(line.alias("input"), F.when(lot < "1", "valid").when(lot < "2", "test").otherwise("train").alias("split"))


@query(f"""with d as (select distinct {_SENTENCE} as input, case when md5('7|' || doc_id) < '1' then 'valid' when md5('7|' || doc_id) < '2' then 'test' else 'train' end as split from documents),
  p as (select a.split || '_' || b.split as pair, count(*) as shared from d a join d b using (input) where (a.split, b.split) in (('train', 'valid'), ('train', 'test'), ('valid', 'test')) group by 1)
  select pair, coalesce(shared, 0) as shared from (values ('train_valid'), ('train_test'), ('valid_test')) v(pair) left join p using (pair)""")
def split_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that two splits share."""
    return C.split_overlap(_split_texts(spark, sf_dir), "input")


_PAIRS = "select q.conv_id, q.turn, q.text as latin, a.text as english from conversations q join conversations a on a.conv_id = q.conv_id and a.turn = q.turn + 1 where q.role = 'user' and a.role = 'assistant'"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("latin"))
    said = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("english"))
    return asked.join(said, ["conv_id", "turn"])


_EMIT = f"""select conv_id, turn, 'translate Dhivehi Latin to English: ' || latin as input, english as target, 'dv-en' as direction from ({_PAIRS})
  union all select conv_id, turn, 'translate English to Dhivehi Latin: ' || english, latin, 'en-dv' from ({_PAIRS})"""


@query(_EMIT)
def bidirectional_emit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question and answer pairs as rows of both directions."""
    return C.both_directions(_pairs(spark, sf_dir))


@query(f"select distinct latin, english from ({_PAIRS}) where md5(latin) >= '2'")
def direction_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete pairs out of rows of both directions of which some are missing."""
    rows = C.both_directions(_pairs(spark, sf_dir))
    dropped = (F.col("direction") == "en-dv") & (F.md5("target") < "2")
    return C.re_pair(rows.where(~dropped))


@query("""select role, count(*) as n, count_if(c)::bigint as conversational from (select role, coalesce(trim(text) <> '' and (ends_with(trim(text), '?')
  or regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}_])(i|i''m|i''ll|i''ve|me|my|mine|we|we''re|our|you|you''re|your|yours)($|[^\\p{L}\\p{N}_])') or regexp_matches(text, '["“‘].+["”’]')), false) as c from conversations) group by role""")
def conversational_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversational turns of each role."""
    turns = table(spark, sf_dir, "conversations").withColumn("c", X.conversational(F.col("text")))
    return turns.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.count_if("c").alias("conversational"))


def _allocated(total: int, floor: int, table_: str) -> str:
    """allocate() in SQL."""
    return f"""c0 as ({table_}), c1 as (select *, least({floor}, n) as f0 from c0), c2 as (select *, {total} - sum(f0) over () as l0 from c1),
  c3 as (select name, n, case when l0 <= 0 then 0 else f0 end as f, case when l0 <= 0 then {total} else l0 end as l from c2), c4 as (select *, sum(n - f) over () as pool from c3),
  c5 as (select *, case when pool > 0 then l::double * (n - f) / pool else 0 end as e from c4), c6 as (select *, f + floor(e) as b, {total} - sum(f + floor(e)) over () as s, row_number() over (order by e - floor(e) desc, name) as p from c5),
  o as (select name, row_number() over (order by r, p) as turn, s from c6, range(1, 5) t(r) where b + r <= n), x as (select name, count(*) as extra from o where turn <= s group by name),
  q as (select name, n, (b + coalesce(extra, 0))::bigint as quota from c6 left join x using (name))"""


_STRATA = "select source as name, count(*) as n from documents group by source"


@query(f"with {_allocated(300, 5, _STRATA)} select name, n, quota from q")
def stratified_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that each source gives to a sample of 300."""
    counts = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return P.allocate(counts, 300, 5)


@query(f"""with {_allocated(300, 5, _STRATA)} select doc_id, source, place from (select doc_id, source, row_number() over (partition by source order by md5('11|' || doc_id), doc_id)::int as place from documents) d
  join q on q.name = d.source where place <= quota""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample itself."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    counts = docs.groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return P.draw(docs, "source", "doc_id", P.allocate(counts, 300, 5), 11).select("doc_id", "source", "place")


@query("select doc_id, ((row_number() over (order by doc_id) - 1) % 4)::int as shard from documents")
def round_robin_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents dealt to four shards by place."""
    return P.round_robin(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 4).select("doc_id", "shard")


@query("select doc_id, place from (select doc_id, row_number() over (order by doc_id) - 1 as place from documents) where place % 7 = 0 and place < 700")
def systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh document, a hundred of them."""
    return P.systematic(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 7, 100).select("doc_id", "place")


@query("select source, doc_id, place from (select source, doc_id, row_number() over (partition by source order by doc_id)::int as place from documents) where place <= 3")
def first_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three documents of each source."""
    return P.first_examples(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id", 3)


#: Pairs made for each label around a word W of the data; those of one word are told apart from other words' by it.
_DV = "ދިވެހި ބަސް މިއީ"
_SHOWN = [
    ("", "W b c", "empty_side"), ("W", "a b W", "no_thaana_in_source"), (_DV, "W b ދިވެހި", "thaana_in_english"), (_DV + " W", "W two three", "latin_in_dhivehi"),
    (_DV, "5 minutes W ago", "timestamp_fragment"), (_DV, "W %s b c", "ui_string"), (_DV, "one W", "too_few_words"), (_DV, "W two " + "x" * T.MAX_CHARS, "length_bounds"),
    (_DV + " ☺", "W two three four", "non_ascii_latin"), (_DV, "W two three " + "word " * 30, "length_ratio"), (_DV, "W two three four", "kept"), (_DV, "W two three four", "duplicate_exact"),
    ("ދިވެހި  ބަސް މިއީ", "W two, Three four!", "duplicate_near"), ((_DV + " ") * 14, "W two three four " * 14, "over_max_tokens"),
]
#: Words of the conversations as eight letters each, of any script before.
_CODE = "translate(md5(word)[:8], '0123456789', 'ghijklmnop')"
_CODES = f"select distinct {_CODE} as code from (select unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}'']+')) as word from conversations)"


@query(f"select code, k, reason from ({_CODES}) cross join (values " + ", ".join(f"({k}, '{r}')" for k, (_, _, r) in enumerate(_SHOWN)) + ") t(k, reason)")
def reject_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label of the pair funnel on the pairs made for it around each word of the conversations."""
    turns = table(spark, sf_dir, "conversations")
    words = turns.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[\\p{L}\\p{M}']+"), F.lit(0))).alias("word")).distinct()
    codes = words.select(F.translate(F.left(F.md5("word"), F.lit(8)), "0123456789", "ghijklmnop").alias("code")).distinct()
    made = [F.struct(F.lit(k).alias("k"), F.replace(F.lit(dv), F.lit("W"), F.col("code")).alias("dv"), F.replace(F.lit(en), F.lit("W"), F.col("code")).alias("en")) for k, (dv, en, _) in enumerate(_SHOWN)]
    # a few bytes of codes stand for much text: they are dealt over all tasks, and the text is judged once
    told = materialise(C.pair_rules(spread(codes).select("code", F.inline(F.array(*made)))).select("code", "k", "judged"), "judged")
    return C.pair_labels(told.withColumn("place", F.struct("code", "k")), "place").select("code", "k", F.coalesce("reason", F.lit("kept")).alias("reason"))


_CLEAN = "trim({0}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_ONE = "trim(regexp_replace({0}, '[ \\t-\\r]+', ' ', 'g'))"


@query(f"""with p as (select struct_pack(c := conv_id, t := turn) as k, {_CLEAN.format('latin')} as dv, {_CLEAN.format('english')} as en from ({_PAIRS})),
  r as (select *, case when dv = '' or en = '' then 'empty_side' when regexp_matches(en, '%[sdifg@]|%[0-9]+\\$[sdifg@]|\\{{[0-9]+\\}}|</?[a-z][a-z0-9]*>') then 'ui_string'
    when len(string_split({_ONE.format('en')}, ' ')) < 3 then 'too_few_words' when length(dv) not between 2 and 600 or length(en) not between 2 and 600 then 'length_bounds'
    when regexp_matches(dv, '[^\\x00-\\x7f]') then 'non_ascii_latin' when length(dv) * 1.0 / length(en) not between 0.4 and 2.5 then 'length_ratio' end as rule from p),
  n as (select *, md5(lower(regexp_replace(dv, '[ \\t-\\r]+', ' ', 'g')) || chr(1) || regexp_replace(lower(regexp_replace(en, '[ \\t-\\r]+', ' ', 'g')), '[^a-z0-9 ]+', '', 'g')) as near from r where rule is null),
  d as (select *, case when k = min(k) over w then null when (dv, en) = arg_min((dv, en), k) over w then 'duplicate_exact' else 'duplicate_near' end as dup from n window w as (partition by near)),
  f as (select k, rule as reason from r where rule is not null union all select k, coalesce(dup, case when greatest(strlen(dv) + 36, strlen(en) + 36) > 1000 then 'over_max_tokens' end) from d)
  select k.c as conv_id, k.t as turn, reason from f""")
def pair_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question and answer pairs under the label that rejects them, null for those kept."""
    pairs = _pairs(spark, sf_dir).select(F.struct("conv_id", "turn").alias("k"), F.col("latin").alias("dv"), F.col("english").alias("en"))
    return C.pair_funnel(pairs, "k", in_thaana=False, most_tokens=1000).select("k.conv_id", "k.turn", "reason")


_TOKENS = "list_distinct(list_filter(regexp_split_to_array(lower(text), '[ \\t-\\r]+'), lambda t: regexp_matches(t, '[wx]|c([^h]|$)')))"


@query(f"select doc_id, len({_TOKENS})::int as n, md5(array_to_string(list_sort({_TOKENS}), ' ')) as tokens from documents where regexp_matches(lower(text), '[wx]|c([^h]|$)')")
def spellability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that Dhivehi spelling can't write, and how many of their tokens are why."""
    odd = X.unspellable_tokens(F.col("text"))
    docs = table(spark, sf_dir, "documents").where(X.unspellable(F.col("text"))).withColumn("odd", odd)
    return docs.select("doc_id", F.size("odd").alias("n"), F.md5(F.array_join("odd", " ")).alias("tokens"))


@query("select 'only' as spec, lang, count(*) as n from documents where source = 'src0' group by lang union all select 'not', lang, count(*) from documents where source is distinct from 'src0' group by lang")
def domain_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one source, and of all but it."""
    docs = table(spark, sf_dir, "documents")
    sides = [docs.where(X.in_domain(F.col("source"), spec)).select(F.lit(name).alias("spec"), "lang") for name, spec in (("only", "src0"), ("not", "!src0"))]
    return sides[0].unionAll(sides[1]).groupBy("spec", "lang").agg(F.count(F.lit(1)).alias("n"))
