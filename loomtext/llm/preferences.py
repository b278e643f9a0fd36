"""Operator 7: preference pairs of conversations as one prompt and two masked completions.

A pair's chosen and rejected conversations are sequences of turns in the order of (turn, role, text). Their longest common
prefix is the prompt, rendered once; what follows are the two completions, in which only assistant turns carry loss. Both
sequences are sorted and distinct, hence the prefix is what lies before the least turn that only one of them has, which is
a minimum and needs no conversation in one place.

A pair is one row with prompt, chosen and rejected text. Only a pair with more than TURNS turns in a part goes on in
further rows, `segment` 1, 2, ..., each with the next TURNS turns of each part: a conversation of any length is never one
task's or one row's. Turns are numbered over ranges of a written table, as a hot conversation must spread.

Defined results: null roles and texts are empty; equal rows of a conversation are one turn; a null pair_id is a pair like
any other; equal conversations are all prompt, their completions empty; a side without turns has no completion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomtext.llm.neighbours import next_lower
from loomtext.llm.scratch import materialise
from loomtext.operators.sampling import ranged

#: Turns of a part in one row.
TURNS = 1000
_KEY = ("pair_id", "turn", "role", "text")


def _turns(side: DataFrame) -> DataFrame:
    return side.select("pair_id", side["turn"].cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def pair_turns(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """(pair_id, part, turn, role, text, rendered, loss_from, loss_to): every turn of a pair once in each part it is in.

    part is prompt, chosen or rejected. Loss is on the code points from loss_from up to loss_to of `rendered`; both are 0
    where the turn is masked.
    """
    sides = _turns(chosen).withColumn("c", F.lit(1)).withColumn("r", F.lit(0)).unionByName(_turns(rejected).withColumn("c", F.lit(0)).withColumn("r", F.lit(1)))
    turns = sides.groupBy(*_KEY).agg(F.max("c").alias("c"), F.max("r").alias("r"))
    order = F.struct("turn", "role", "text")
    first = turns.where("c <> r").groupBy("pair_id").agg(F.min(order).alias("first")).select(F.col("pair_id").alias("of_pair"), "first")
    met = turns.join(first, F.col("pair_id").eqNullSafe(F.col("of_pair")), "left")
    part = F.when(F.col("first").isNull() | (order < F.col("first")), F.array(F.lit("prompt")))
    part = part.otherwise(F.filter(F.array(F.when(F.col("c") == 1, F.lit("chosen")), F.when(F.col("r") == 1, F.lit("rejected"))), lambda p: p.isNotNull()))
    head = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"))
    rows = met.select("pair_id", F.explode(part).alias("part"), "turn", "role", "text", F.length(head).alias("head"), F.concat(head, "text", F.lit("<|end|>\n")).alias("rendered"))
    learned = (F.col("part") != "prompt") & (F.col("role") == "assistant")
    loss = {"loss_from": F.col("head"), "loss_to": F.length("rendered") - 1}
    return rows.select("pair_id", "part", "turn", "role", "text", "rendered", *[F.when(learned, c).otherwise(0).alias(k) for k, c in loss.items()])


def _numbered(turns: DataFrame) -> DataFrame:
    """`turns` with `place`: from 0 in each part of a pair, in the order of (turn, role, text)."""
    rows, at = ranged(turns, "pair_id", "part", "turn", "role", "text")
    sizes = rows.groupBy("pair_id", "part", at).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("pair_id", "part").orderBy(at)) - F.col("n")  # a row for each range of a part
    lead = sizes.select(F.col("pair_id").alias("of_pair"), F.col("part").alias("of_part"), F.col(at).alias("of_range"), before.alias("before"))
    inside = F.row_number().over(Window.partitionBy(at, "pair_id", "part").orderBy("turn", "role", "text")) - 1
    same = F.col("pair_id").eqNullSafe(F.col("of_pair")) & (F.col("part") == F.col("of_part")) & (F.col(at) == F.col("of_range"))
    return rows.withColumn("inside", inside).join(lead, same).withColumn("place", F.col("inside") + F.col("before"))


def _losses(turns: Column) -> Column:
    """from:to of each learned turn in their joined text, comma-joined."""
    init = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, t: Column) -> Column:
        span = F.concat_ws(":", state["at"] + t["loss_from"], state["at"] + t["loss_to"])
        out = F.when(t["loss_to"] > 0, F.concat(state["out"], F.array(span))).otherwise(state["out"])
        return F.struct((state["at"] + F.length(t["rendered"])).alias("at"), out.alias("out"))

    return F.aggregate(turns, init, step, lambda s: F.array_join(s["out"], ","))


def format_preferences(chosen: DataFrame, rejected: DataFrame, turns: int = TURNS) -> DataFrame:
    """(pair_id, segment, prompt, chosen, rejected, chosen_loss, rejected_loss) from two tables (pair_id, turn, role, text).

    Losses list the code points of the completion in their row that are learned, as from:to with an exclusive end.
    """
    rows = _numbered(pair_turns(chosen, rejected)).withColumn("segment", F.floor(F.col("place") / turns).cast("long"))
    listed = F.array_sort(F.collect_list(F.struct("place", "rendered", "loss_from", "loss_to")))  # `turns` at most
    parts = rows.groupBy("pair_id", "part", "segment").agg(listed.alias("turns"))
    parts = parts.select("pair_id", "part", "segment", F.array_join(F.transform("turns", lambda t: t["rendered"]), "").alias("text"), _losses(F.col("turns")).alias("loss"))

    def of(part: str, what: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("part") == part, F.col(what))), F.lit(""))

    texts = [of(p, "text").alias(p) for p in ("prompt", "chosen", "rejected")]
    return parts.groupBy("pair_id", "segment").agg(*texts, *[of(p, "loss").alias(f"{p}_loss") for p in ("chosen", "rejected")])


def answers_swapped(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected turns from `conversations` (conv_id, turn, role, text).

    Chosen is each conversation up to its last assistant turn; rejected answers there with the last assistant turn of the
    conversation of the next lower conv_id (after the lowest: the highest). Conversations without conv_id or without an
    assistant turn make no pair.
    """
    turns = _turns(conversations.withColumn("pair_id", F.col("conv_id").cast("long"))).where("pair_id is not null")
    last = turns.where("role = 'assistant' and turn is not null").groupBy("pair_id").agg(F.max(F.struct("turn", "text")).alias("last"))
    last = materialise(last.select(F.col("pair_id").alias("id"), F.col("last.turn").alias("at"), F.col("last.text").alias("answer")), "answers")
    other = last.select(F.col("id").alias("next_id"), F.col("answer").alias("other"))
    pairs = last.join(next_lower(last.select("id")), "id").join(other, "next_id").select("id", "at", "answer", "other")
    met = turns.join(pairs, turns["pair_id"] == pairs["id"]).where("turn is null or turn <= at")
    swap = (F.col("role") == "assistant") & F.col("turn").eqNullSafe(F.col("at")) & (F.col("text") == F.col("answer"))
    return met.select(*_KEY), met.select("pair_id", "turn", "role", F.when(swap, F.col("other")).otherwise(F.col("text")).alias("text"))


SQL = """
with t as (select distinct conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
m as (select conv_id, max(struct_pack(turn := turn, text := text)) as m from t where role = 'assistant' and turn is not null group by conv_id),
l as (select conv_id, m.turn as last_turn, m.text as answer from m),
p as (select conv_id, last_turn, answer,
        coalesce(lag(answer) over (order by conv_id), last_value(answer) over (order by conv_id rows between unbounded preceding and unbounded following)) as other from l),
c as (select t.conv_id, t.turn, t.role, t.text, p.last_turn, p.answer, p.other from t join p using (conv_id) where t.turn is null or t.turn <= p.last_turn),
r as (select distinct conv_id, turn, role, case when role = 'assistant' and turn = last_turn and text = answer then other else text end as text from c),
u as (select conv_id, turn, role, text, max(c) as c, max(r) as r from
        (select conv_id, turn, role, text, 1 as c, 0 as r from c union all select conv_id, turn, role, text, 0, 1 from r) group by all),
d as (select conv_id, turn, role, text, row_number() over (partition by conv_id order by turn nulls first, role, text) as place, c, r from u),
f as (select conv_id, min(place) as first_place from d where c <> r group by conv_id),
s as (select d.*, first_place is null or place < first_place as common from d left join f using (conv_id)),
parts as (select conv_id, 'prompt' as part, turn, role, text from s where common
  union all select conv_id, 'chosen', turn, role, text from s where not common and c = 1
  union all select conv_id, 'rejected', turn, role, text from s where not common and r = 1),
n as (select *, row_number() over (partition by conv_id, part order by turn nulls first, role, text) - 1 as place from parts),
w as (select conv_id, part, place // 1000 as segment, place, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) as rendered,
  part <> 'prompt' and role = 'assistant' as learned, 5 + length(role) as head from n),
o as (select *, coalesce(sum(length(rendered)) over (partition by conv_id, part, segment order by place rows between unbounded preceding and 1 preceding), 0) as lead_ from w),
g as (select conv_id, part, segment, string_agg(rendered, '' order by place) as text,
  coalesce(string_agg((lead_ + head)::bigint || ':' || (lead_ + length(rendered) - 1)::bigint, ',' order by place) filter (where learned), '') as loss from o group by all)
select conv_id, segment, coalesce(max(case when part = 'prompt' then text end), '') as prompt, coalesce(max(case when part = 'chosen' then text end), '') as chosen,
  coalesce(max(case when part = 'rejected' then text end), '') as rejected, coalesce(max(case when part = 'chosen' then loss end), '') as chosen_loss,
  coalesce(max(case when part = 'rejected' then loss end), '') as rejected_loss
from g group by conv_id, segment
"""
