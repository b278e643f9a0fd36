"""The seventeen reports over artefacts that the tables stand in for: each input is a small aggregate with nulls in it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomtext.plans import reports
from loomtext.plans.registry import QUERIES, SQL, WORDS, document_words, table

Input = Callable[[SparkSession, str], DataFrame]


def _by_brand(spark: SparkSession, sf: str) -> DataFrame:
    size, n = F.col("p_size"), F.count(F.lit(1))
    lost, odd = F.nullif(F.max(size).cast("double"), F.lit(50.0)), F.when(n % 2 == 0, F.sum(size).cast("double"))
    return table(spark, sf, "part").groupBy(F.col("p_brand").alias("model")).agg(n.alias("vocabulary"), lost.alias("lost_percent"), F.min(size).cast("double").alias("thaana_tokens"), odd.alias("latin_tokens"))


def _evaluations(spark: SparkSession, sf: str) -> DataFrame:
    keys = [(F.col("o_orderkey") % 5).alias("epoch"), F.col("o_orderpriority").alias("direction"), F.col("o_orderstatus").alias("eval_set")]
    loss = F.when(F.count(F.lit(1)) % 2 == 0, F.count(F.lit(1)).cast("double"))
    return table(spark, sf, "orders").groupBy(*keys).agg(F.max("o_totalprice").alias("bleu"), F.min("o_totalprice").alias("chrf"), loss.alias("loss"))


def _scores(by: str) -> Input:
    def build(spark: SparkSession, sf: str) -> DataFrame:
        discount = F.nullif(F.max("l_discount"), F.lit(0.1))
        return table(spark, sf, "lineitem").groupBy(F.col(by).alias("direction")).agg(F.max("l_extendedprice").alias("bleu"), discount.alias("chrf"))

    return build


def _gates(spark: SparkSession, sf: str) -> DataFrame:
    best = F.when(F.col("o_orderpriority") != "2-HIGH", F.col("o_totalprice"))
    told = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("id")).agg(F.max(best).alias("measured"), F.count(F.lit(1)).alias("n"))
    return told.select("id", "measured", F.when(F.col("n") % 2 == 0, 0.0).otherwise(400000.0).alias("target"), (F.col("n") % 3 > 0).alias("higher"))


def _round_trips(spark: SparkSession, sf: str) -> DataFrame:
    balance = F.col("c_acctbal")
    return table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("population")).agg(F.max(balance).alias("exact"), F.min(balance).alias("exact_folded"), F.nullif(F.count(F.lit(1)), F.lit(0)).cast("double").alias("latin_stable"))


#: Each input as a table and as SQL.
INPUTS: dict[str, tuple[Input, str]] = {
    "profiles": (_by_brand, "select p_brand as model, count(*) as vocabulary, nullif(max(p_size)::double, 50.0) as lost_percent, min(p_size)::double as thaana_tokens, case when count(*) % 2 = 0 then sum(p_size)::double end as latin_tokens from part group by p_brand"),
    "showcase": (lambda spark, sf: table(spark, sf, "part").select(F.col("p_name").alias("model"), F.split("p_name", " ").alias("pieces")).distinct(), "select distinct p_name as model, string_split(p_name, ' ') as pieces from part"),
    "words": (lambda spark, sf: document_words(spark, sf).select("word").distinct().select(F.ceil(F.length("word") / 4.0).alias("pieces")), f"select ceil(length(word) / 4.0) as pieces from (select distinct word from ({WORDS}))"),
    "files": (lambda spark, sf: table(spark, sf, "part").groupBy(F.col("p_name").alias("name")).agg((F.max("p_size") * 1000).cast("long").alias("bytes")), "select p_name as name, (max(p_size) * 1000)::bigint as bytes from part group by p_name"),
    "budget": (lambda spark, sf: spark.createDataFrame([("all", 25000)], "name string, bytes long"), "select 'all' as name, 25000::bigint as bytes"),
    "evaluations": (_evaluations, "select o_orderkey % 5 as epoch, o_orderpriority as direction, o_orderstatus as eval_set, max(o_totalprice) as bleu, min(o_totalprice) as chrf, case when count(*) % 2 = 0 then count(*)::double end as loss from orders group by all"),
    "steps": (lambda spark, sf: table(spark, sf, "events").select(F.col("event_id").alias("step"), F.col("value").alias("loss"), F.when(F.col("event_id") % 10 == 0, F.col("value")).alias("learning_rate")), "select event_id as step, value as loss, case when event_id % 10 = 0 then value end as learning_rate from events"),
    "scores": (_scores("l_returnflag"), "select l_returnflag as direction, max(l_extendedprice) as bleu, nullif(max(l_discount), 0.1) as chrf from lineitem group by 1"),
    "scores_in_domain": (_scores("l_linestatus"), "select l_linestatus as direction, max(l_extendedprice) as bleu, nullif(max(l_discount), 0.1) as chrf from lineitem group by 1"),
    "latencies": (lambda spark, sf: table(spark, sf, "events").select(F.col("event_type").alias("direction"), "value"), "select event_type as direction, value from events"),
    "gates": (_gates, "select o_orderpriority as id, max(case when o_orderpriority <> '2-HIGH' then o_totalprice end) as measured, case when count(*) % 2 = 0 then 0.0::double else 400000.0::double end as target, count(*) % 3 > 0 as higher from orders group by o_orderpriority"),
    "rejects": (lambda spark, sf: table(spark, sf, "documents").groupBy(F.col("lang").alias("reason")).agg(F.count(F.lit(1)).alias("n")), "select lang as reason, count(*) as n from documents group by lang"),
    "domains": (lambda spark, sf: table(spark, sf, "documents").groupBy(F.coalesce(F.nullif("source", F.lit("src0")), F.lit("conversational")).alias("name")).agg(F.count(F.lit(1)).alias("n")), "select coalesce(nullif(source, 'src0'), 'conversational') as name, count(*) as n from documents group by 1"),
    "splits": (lambda spark, sf: spark.createDataFrame([("src1", "test"), ("src2", "valid")], "name string, split string"), "select * from (values ('src1', 'test'), ('src2', 'valid')) t(name, split)"),
    "round_trips": (_round_trips, "select c_mktsegment as population, max(c_acctbal) as exact, min(c_acctbal) as exact_folded, nullif(count(*), 0)::double as latin_stable from customer group by 1"),
    "trips": (lambda spark, sf: table(spark, sf, "orders").select(F.nullif("o_orderstatus", F.lit("O")).alias("class")), "select nullif(o_orderstatus, 'O') as class from orders"),
}


def _long(of: str, keys: str, values: list[str]) -> str:
    return " union all ".join(f"select {keys}, '{v}' as metric, {v}::double as value from {of} where {v} is not null" for v in values)


_STATUS = "case when measured is null or target is null then 'unmeasured' when case when higher then measured >= target else measured <= target end then 'met' else 'not-met' end"
#: Each report over CTEs named like its inputs.
REPORT_SQL: dict[str, str] = {
    "tokens_per_sentence": "select model, 'thaana' as script, thaana_tokens as tokens from profiles where thaana_tokens is not null union all select model, 'latin', latin_tokens from profiles where latin_tokens is not null",
    "information_loss": "select model, lost_percent from profiles",
    "worked_example": "select model, generate_subscripts(pieces, 1)::int - 1 as place, unnest(pieces) as piece from showcase",
    "pieces_per_word": "select g.bin::int as bin, coalesce(n, 0) as n, round(100.0 * coalesce(n, 0) / (select count(*) from words), 3)::double as percent from range(1, 16) g(bin) left join (select pieces::int as bin, count(*) as n from words group by 1) c on c.bin = g.bin",
    "size_vs_budget": "select name, bytes, 'measured' as kind from files union all select name, bytes, 'budget' from budget",
    "vocabulary_coverage": "select model, vocabulary, 100 - lost_percent as coverage from profiles",
    "training_curve": _long("evaluations", "epoch, direction, eval_set", ["bleu", "chrf", "loss"]),
    "training_loss": _long("steps", "step", ["loss", "learning_rate"]),
    "scores_by_direction": _long("scores", "direction", ["bleu", "chrf"]),
    "held_out_vs_in_domain": _long("scores", "'held_out' as population, direction", ["bleu", "chrf"]) + " union all " + _long("scores_in_domain", "'in_domain' as population, direction", ["bleu", "chrf"]),
    "latency_distribution": "select direction, value, round(100.0 * row_number() over (partition by direction order by value) / count(*) over (partition by direction), 6)::double as percent from latencies",
    "budget_vs_actual": f"select id, measured, target, round(100 * measured / coalesce(nullif(target, 0), 1), 6)::double as percent, {_STATUS} as status from gates where measured is not null",
    "acceptance_criteria": f"with s as (select id, {_STATUS} as status from gates) select id, status, 'criterion' as kind from s union all select id, status, 'gap' from s where status = 'unmeasured'",
    "corpus_funnel": "select reason, n from rejects",
    "domains_and_splits": "select name, n, coalesce(split, case when name = 'conversational' then 'all three' end, '?') as split from domains left join splits using (name)",
    "round_trip_figures": _long("round_trips", "population", ["exact", "exact_folded", "latin_stable"]),
    "round_trip_failures": "select class, count(*) as n, round(100.0 * count(*) / (select count(*) from trips where class is not null), 6)::double as percent from trips where class is not null group by class",
}


def _report(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        report = reports.REPORTS[name]
        made = report.build({n: INPUTS[n][0](spark, sf_dir) for n in report.needs})
        return made.withColumn("percent", F.round("percent", 6)) if "percent" in made.columns else made

    build.__doc__ = reports.REPORTS[name].build.__doc__
    return build


for _name, _sql in REPORT_SQL.items():
    _ctes = ", ".join(f"{n} as ({INPUTS[n][1]})" for n in reports.REPORTS[_name].needs)
    QUERIES[f"report_{_name}"] = _report(_name)
    SQL[f"report_{_name}"] = f"with {_ctes} select * from ({_sql})"
