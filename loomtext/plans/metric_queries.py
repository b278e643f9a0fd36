"""Quantiles, scores, gates and report relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomtext.functions import text as X
from loomtext.operators import metrics as N, sampling as P
from loomtext.plans.corpus_queries import _pairs
from loomtext.plans import reports
from loomtext.plans.registry import query, table
from loomtext.sources import logs

_QS = {"p50": 0.5, "p90": 0.9, "p99": 0.99}
_RANKED = ", ".join(f"list_sort(list(value))[least(count(*) - 1, floor({q} * count(*)))::int + 1] as {k}" for k, q in _QS.items())


@query(f'select event_type as "group", count(*) as n, round(avg(value), 6) as mean, {_RANKED} from events group by event_type')
def latency_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank quantiles of event values."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("group"), "value")
    return P.quantiles(rows, "group", "value", _QS).withColumn("mean", F.round("mean", 6))


@query("select event_type, value, round(100.0 * row_number() over (partition by event_type order by value) / count(*) over (partition by event_type), 6) as percent from events")
def empirical_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of events with the percent of rows up to each."""
    rows = table(spark, sf_dir, "events")
    return P.empirical_cdf(rows, "event_type", "value").withColumn("percent", F.round("percent", 6))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers against the questions' texts, in four groups."""
    return _pairs(spark, sf_dir).select((F.col("conv_id") % 4).cast("string").alias("group"), F.col("english").alias("prediction"), F.col("latin").alias("reference"))


_BARE = "replace(replace(replace(rtrim(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '<skipped>', ''), '-' || chr(10), ''), chr(10), ' ')"
_PLAIN = f"replace(replace(replace(replace({_BARE}, '&quot;', '\"'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>')"
_GRAMS = f"""t as (select conv_id % 4 as g, conv_id, turn, x.s as s, coalesce(x.t, '') as t from (select conv_id, turn, unnest([struct_pack(s := 'p', t := english), struct_pack(s := 'r', t := latin)]) as x from p)),
  k as (select g, conv_id, turn, s, list_filter(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(regexp_replace(' ' || {_PLAIN} || ' ', '([{{-~\\[-` -&(-+:-@/])', ' \\1 ', 'g'), '([^0-9])([.,])', '\\1 \\2 ', 'g'), '([.,])([^0-9])', ' \\1 \\2', 'g'), '([0-9])(-)', '\\1 \\2 ', 'g'), '[ \\t-\\r]+'), lambda x: x <> '') as w from t),
  e as (select g, conv_id, turn, s, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], chr(1)))) as gram from k, range(1, 5) r(n)),
  c as (select g, conv_id, turn, n, gram, count_if(s = 'p') as p, count_if(s = 'r') as r from e group by all),
  m as (select g, n, sum(least(p, r)) as hits, sum(p) as guessed, sum(r) as given from c group by all)"""
_PAIR_SQL = "select q.conv_id, q.turn, q.text as latin, a.text as english from conversations q join conversations a on a.conv_id = q.conv_id and a.turn = q.turn + 1 where q.role = 'user' and a.role = 'assistant'"


@query(f"""with p as ({_PAIR_SQL}), {_GRAMS}, z as (select *, sum(case when hits = 0 then 1 else 0 end) over (partition by g order by n) as halvings from m),
  s as (select g, count_if(guessed > 0) as orders, sum(hits) as hit, exp(avg(ln(case when hits = 0 then 1 / pow(2, halvings) else hits end / nullif(guessed, 0)))) as geo, max(case when n = 1 then guessed end) as pl, max(case when n = 1 then given end) as rl from z group by g)
  select g::varchar as "group", (select count(*) from p where conv_id % 4 = g) as n, round(case when hit = 0 or orders < 4 then 0 else 100 * geo * case when pl < rl then exp(1 - rl / pl) else 1 end end, 4)::double as bleu from s""")
def bleu_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus BLEU of answers against questions."""
    return N.bleu(_answers(spark, sf_dir), "group")


_MARK = "[!-/:-@\\[-`{-~]"


@query(f"""with p as ({_PAIR_SQL}), {_GRAMS}, h as (select g, conv_id, turn, s, list_filter(string_split(regexp_replace(t, '[ \\t-\\r]+', '', 'g'), ''), lambda x: x <> '') as w from t),
  v as (select g, conv_id, turn, s, flatten(list_transform(list_filter(regexp_split_to_array(t, '[ \\t-\\r]+'), lambda x: x <> ''), lambda x: case when length(x) > 1 and regexp_matches(x, '{_MARK}$') then [x[:-2], x[-1]]
    when length(x) > 1 and regexp_matches(x, '^{_MARK}') then [x[1], x[2:]] else [x] end)) as w from t),
  e2 as (select g, conv_id, turn, s, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], chr(1)))) as gram from h, range(1, 7) r(n)
    union all select g, conv_id, turn, s, n + 10, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], chr(1)))) from v, range(1, 3) r(n)),
  c2 as (select g, conv_id, turn, n, gram, count_if(s = 'p') as p, count_if(s = 'r') as r from e2 group by all),
  o as (select g, conv_id, turn, n, sum(least(p, r)) as hits, case when sum(r) > 0 then sum(p) else 0 end as guessed, sum(r) as given from c2 group by all),
  a as (select g, n, sum(hits) as hits, sum(guessed) as guessed, sum(given) as given from o group by all),
  f as (select g, avg(hits / guessed) as pr, avg(hits / given) as re from a where guessed > 0 and given > 0 group by g)
  select g::varchar as "group", (select count(*) from p where conv_id % 4 = g) as n, round(case when pr + re > 0 then 500 * pr * re / (4 * pr + re) else 0 end, 4)::double as chrf from f""")
def chrf_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chrF++ of answers against questions."""
    return N.chrf(_answers(spark, sf_dir), "group")


@query("""select id, measured, target, case when measured is null then 'unmeasured' when case when higher then measured >= target else measured <= target end then 'met' else 'not-met' end as status,
  round(100.0 * measured / nullif(target, 0), 3)::double as percent from (
  select 'late' as id, (select avg((l_shipdate > o_orderdate)::int) from lineitem join orders on l_orderkey = o_orderkey)::double as measured, 0.2::double as target, false as higher
  union all select 'revenue', (select round(sum(l_extendedprice), 2) from lineitem), 1e6, true union all select 'returns', (select avg((l_returnflag = 'R')::int) from lineitem)::double, 0.5, false union all select 'ratings', null, 4.0, true)""")
def acceptance_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates over orders; one is unmeasured and stays null."""
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    late = items.join(orders, items["l_orderkey"] == orders["o_orderkey"]).agg(F.avg((F.col("l_shipdate") > F.col("o_orderdate")).cast("int")).alias("late"))
    sums = items.agg(F.round(F.sum("l_extendedprice"), 2).alias("revenue"), F.avg((F.col("l_returnflag") == "R").cast("int")).alias("returns"))
    gates = [("late", 0.2, False), ("revenue", 1e6, True), ("returns", 0.5, False), ("ratings", 4.0, True)]
    wide = late.crossJoin(sums).withColumn("ratings", F.lit(None).cast("double"))  # one row each
    rows = wide.select(F.inline(F.array(*[F.struct(F.lit(i).alias("id"), F.col(i).alias("measured"), F.lit(t).alias("target"), F.lit(h).alias("higher")) for i, t, h in gates])))
    return rows.select("id", "measured", "target", N.gate(F.col("measured"), F.col("target"), F.col("higher")).alias("status"), F.round(100 * F.col("measured") / F.nullif("target", F.lit(0.0)), 3).alias("percent"))


_AGG = "select l_shipmode_ as series, sum(l_quantity)::double as quantity, round(avg(l_discount), 6)::double as discount, nullif(max(l_tax), 0.08)::double as tax from (select *, l_returnflag || l_linestatus as l_shipmode_ from lineitem) group by 1"


@query(f"select series, metric, value from (unpivot ({_AGG}) on quantity, discount, tax into name metric value value)")
def metric_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregates as one row per metric, nulls left out."""
    items = table(spark, sf_dir, "lineitem").withColumn("series", F.concat("l_returnflag", "l_linestatus"))
    wide = items.groupBy("series").agg(F.sum("l_quantity").alias("quantity"), F.round(F.avg("l_discount"), 6).alias("discount"), F.nullif(F.max("l_tax"), F.lit(0.08)).alias("tax"))
    return N.unpivot(wide, ["series"], ["quantity", "discount", "tax"])


@query("""select 'held_out' as population, lang as name, count(*) as n from documents where doc_id % 5 = 0 group by lang union all select 'in_domain', source, count(*) from documents where doc_id % 5 <> 0 group by source
  union all select 'budget', 'all', 2000""")
def report_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two populations, never merged, and a budget row."""
    docs = table(spark, sf_dir, "documents")
    held = docs.where("doc_id % 5 = 0").groupBy(F.col("lang").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    own = docs.where("doc_id % 5 <> 0").groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    budget = spark.createDataFrame([("budget", "all", 2000)], "population string, name string, n long")
    return held.select(F.lit("held_out").alias("population"), "name", "n").unionAll(own.select(F.lit("in_domain").alias("population"), "name", "n")).unionAll(budget)


@query("""with s as (select event_id, case event_type when 'error' then '{k: broken}' when 'click' then '{"loss": ' || value || '} then {"eval_loss": ' || event_id || '}' else props end as said from events),
  r as (select event_id, unnest(regexp_extract_all(said, '\\{[^{}]*\\}')) as raw from s)
  select event_id, case when raw = '{k: broken}' then 'failed' when contains(raw, '"eval_loss"') then 'eval' when contains(raw, '"loss"') then 'train' else 'other' end as kind,
    coalesce(json_extract_string(case when json_valid(raw) then raw end, '$.k'), json_extract_string(case when json_valid(raw) then raw end, '$.loss'), json_extract_string(case when json_valid(raw) then raw end, '$.eval_loss'))::double as value from r""")
def log_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event's log line: dictionaries in it by the keys they have, unreadable ones counted."""
    rows = table(spark, sf_dir, "events")
    train = F.concat(F.lit('\x1b[1m{"loss": '), F.col("value").cast("string"), F.lit('}\x1b[0m then\r{"eval_loss": '), F.col("event_id").cast("string"), F.lit("}"))
    said = F.when(F.col("event_type") == "error", "{k: broken}").when(F.col("event_type") == "click", train).otherwise(F.col("props"))
    found = logs.events(rows.select("event_id", said.alias("said")), "said")
    return found.select("event_id", "kind", F.coalesce(*[F.try_element_at("event", F.lit(k)) for k in ("k", "loss", "eval_loss")]).alias("value"))


@query("""select page_id, nullif(regexp_extract(html, 'lang="([a-z]+)"', 1), '') as lang, nullif(regexp_extract(html, 'track\\(([0-9]+)\\)', 1), '')::double as track,
  len(regexp_extract_all(html, '<a ')) as links from pages""")
def page_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named facts out of pages."""
    pages = table(spark, sf_dir, "pages")
    facts = logs.facts(F.col("html"), {"lang": 'lang="([a-z]+)"', "track": "track\\(([0-9]+)\\)"})
    return pages.select("page_id", facts["lang"].alias("lang"), facts["track"].try_cast("double").alias("track"), F.size(F.regexp_extract_all("html", F.lit("<a "), F.lit(0))).cast("long").alias("links"))


@query("""select conv_id, turn, '"' || replace(case when regexp_matches(cell, '^[=+\\-@\\t\\r]') then '''' || cell else cell end, '"', '""') || '"' as cell from (select conv_id, turn, case when turn = 0 then '=' || text when turn = 1 then '"-' || text else text end as cell from conversations)""")
def csv_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as CSV cells that no spreadsheet runs."""
    cell = F.when(F.col("turn") == 0, F.concat(F.lit("="), "text")).when(F.col("turn") == 1, F.concat(F.lit('"-'), "text")).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.csv_cell(cell).alias("cell"))


@query("""with e as (select event_type, round_even(value * 7 / 3, 0)::bigint as rows_ from events) select event_type, case when rows_ > 500 then 'full' else 'small' end as eval_set, count(*) as evaluations, count(distinct rows_) as sizes,
  min(rows_) as least, max(rows_) as most from e group by all""")
def eval_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes rebuilt from rates, rounded half to even, in two populations."""
    rows = table(spark, sf_dir, "events").select("event_type", F.bround(F.col("value") * 7 / 3, 0).cast("long").alias("rows_"))
    return rows.groupBy("event_type", F.when(F.col("rows_") > 500, "full").otherwise("small").alias("eval_set")).agg(F.count(F.lit(1)).alias("evaluations"), F.count_distinct("rows_").alias("sizes"), F.min("rows_").alias("least"), F.max("rows_").alias("most"))


@query("select l_partkey, arg_max(l_orderkey, (l_quantity, l_orderkey)) as l_orderkey, max(l_quantity) as l_quantity, array_to_string(list_sort(list(distinct l_suppkey::varchar)), ',') as cells, count(distinct l_suppkey) as n_cells from lineitem group by l_partkey")
def most_precise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fullest line of each part, with all its suppliers."""
    rows = table(spark, sf_dir, "lineitem").select("l_quantity", "l_orderkey", "l_partkey", "l_suppkey")
    return N.most_precise(rows, ["l_partkey"], "l_suppkey", "l_quantity").select("l_partkey", "l_orderkey", "l_quantity", "cells", "n_cells")


@query("""with e as (select event_type, round_even(value * 7 / 3, 0)::bigint % 50 as rows_ from events) select event_type, count(*) as evaluations, array_to_string(list_sort(list(distinct rows_)), ',') as sizes from e group by all""")
def eval_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluations by kind, and the sorted list of the distinct sizes they had."""
    rows = table(spark, sf_dir, "events").select("event_type", (F.bround(F.col("value") * 7 / 3, 0).cast("long") % 50).alias("rows_"))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("evaluations"), F.array_join(F.sort_array(F.collect_set("rows_")), ",").alias("sizes"))


@query("select event_type, min(case when value < 1 then ts end) as boundary from events group by event_type")
def population_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When the first small value came."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.min(F.when(F.col("value") < 1, F.col("ts"))).alias("boundary"))


@query("select o_custkey, min(o_orderkey) as o_orderkey, count(*) as copies from orders group by o_custkey")
def shard_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of orders merged by customer, the first order wins."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    shards = orders.where("o_orderkey % 2 = 0").unionAll(orders.where("o_orderkey % 2 = 1"))
    return N.first_wins(shards, "o_custkey", "o_orderkey")


@query("select l_orderkey, l_linenumber, o_orderstatus from lineitem join orders on l_orderkey = o_orderkey")
def prediction_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line with its order; a line without one would stop the query."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return N.joined_or_fail(items, orders, "o_orderkey").withColumnRenamed("o_orderkey", "l_orderkey")


@query("select p_partkey, round(greatest(0, 1 - levenshtein(p_name, p_type) * 1.0 / nullif(length(p_name), 0)), 6)::double as recovery from part")
def char_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a part's name that its type recovers."""
    return table(spark, sf_dir, "part").select("p_partkey", F.round(X.char_recovery(F.col("p_name"), F.col("p_type")), 6).alias("recovery"))


@query("""select conv_id, turn, text = trim(regexp_replace(text, '[ \\t-\\r]+', ' ', 'g')) as plain, case when turn % 3 = 0 then false else true end as exact from conversations where text <> ''""")
def decode_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns against themselves with other white space, and with a letter more."""
    got = F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit("x"))).when(F.col("turn") % 3 == 1, F.concat(F.lit(" "), F.replace("text", F.lit(" "), F.lit(" \t\n")))).otherwise(F.col("text"))
    turns = table(spark, sf_dir, "conversations").where("text <> ''")
    return turns.select("conv_id", "turn", (X.one_line(F.col("text")) == F.col("text")).alias("plain"), X.decoded_exactly(F.col("text"), got).alias("exact"))


_NAMED = "select case when source = 'src3' then 'conversational' else source end as name, count(*) as n from documents group by 1"


@query(f"select name, n, case when name in ('src1', 'src2', 'src4') then 'test' when name = 'conversational' then 'all three' else '?' end as split from ({_NAMED})")
def domain_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with the split they are assigned to; one is in all, others in none."""
    name = F.when(F.col("source") == "src3", "conversational").otherwise(F.col("source"))
    domains = table(spark, sf_dir, "documents").groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n"))
    splits = spark.createDataFrame([(f"src{k}", "test") for k in (1, 2, 4)], "name string, split string")
    return reports.domains_and_splits({"domains": domains, "splits": splits})


@query("select o_orderpriority as direction, count(*) as n, count(*) >= 500 as reportable, bit_xor(('0x' || md5(o_orderkey::varchar)[:15])::bigint) as fingerprint from orders group by o_orderpriority")
def size_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups large enough to report, with a fingerprint of their keys that no order changes."""
    lot = F.conv(F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 15), 16, 10).cast("long")
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("direction"))
    return orders.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(lot).alias("fingerprint")).withColumn("reportable", F.col("n") >= 500)


@query("""with b as (select text as latin, arg_max(lang, doc_id) as english, max(doc_id) as last_id from documents group by text), s as (select distinct text as latin from documents where doc_id % 2 = 0)
  select md5(latin) as latin, english, last_id from s join b using (latin)""")
def script_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of a sample with the last row that has the same text: on a duplicate key the last write wins."""
    docs = table(spark, sf_dir, "documents").select(F.col("text").alias("latin"), F.col("lang").alias("english"), "doc_id")
    sample = docs.where("doc_id % 2 = 0").select("latin").distinct()
    return N.last_wins(sample, docs, "latin", "doc_id").select(F.md5("latin").alias("latin"), "english", F.col("doc_id").alias("last_id"))


_MEDIAN = "select lang as \"group\", count(*) as n, round(median(length(text)), 6)::double as median, list_sort(list(length(text)))[floor(0.9 * count(*))::int + 1]::bigint as p90 from documents group by lang"


@query(_MEDIAN)
def quantile_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interpolated median and the unclamped 90 % value of document lengths by language."""
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("group"), F.length("text").cast("long").alias("k"))
    tail = P.quantiles(docs, "group", "k", {"p90": 0.9}, clamp=False).select("group", "p90")
    return P.medians(docs, "group", "k").join(tail, "group").select("group", "n", F.round(F.col("median").cast("double"), 6).alias("median"), "p90")
