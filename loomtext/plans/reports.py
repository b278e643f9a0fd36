"""Report relations over measured artefacts: each names what it needs, and is skipped where that is missing.

What is not measured stays null throughout; a null is never published as 0.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, Window, functions as F

from loomtext.operators import metrics as N, sampling as P

Inputs = dict[str, DataFrame]


class Report(NamedTuple):
    needs: tuple[str, ...]
    build: Callable[[Inputs], DataFrame]


def tokens_per_sentence(x: Inputs) -> DataFrame:
    """(model, script, tokens): from profiles (model, thaana_tokens, latin_tokens)."""
    return N.unpivot(x["profiles"], ["model"], ["thaana_tokens", "latin_tokens"]).select("model", F.regexp_replace("metric", "_tokens", "").alias("script"), F.col("value").alias("tokens"))


def information_loss(x: Inputs) -> DataFrame:
    """(model, lost_percent), the least loss first, unmeasured last."""
    return x["profiles"].select("model", "lost_percent").orderBy(F.asc_nulls_last("lost_percent"), "model")


def worked_example(x: Inputs) -> DataFrame:
    """(model, place, piece): from showcase (model, pieces)."""
    return x["showcase"].select("model", F.posexplode("pieces").alias("place", "piece"))


def pieces_per_word(x: Inputs) -> DataFrame:
    """(bin, n, percent) on 1 to 15: from words (pieces)."""
    return N.histogram(x["words"], "pieces", 1, 15)


def size_vs_budget(x: Inputs) -> DataFrame:
    """(name, bytes, kind): measured files and the budget, largest first."""
    rows = x["files"].select("name", "bytes", F.lit("measured").alias("kind")).unionAll(x["budget"].select("name", "bytes", F.lit("budget").alias("kind")))
    return rows.orderBy(F.desc_nulls_last("bytes"), "name")


def vocabulary_coverage(x: Inputs) -> DataFrame:
    """(model, vocabulary, coverage): what isn't lost, null where loss is unmeasured."""
    return x["profiles"].select("model", "vocabulary", (100 - F.col("lost_percent")).alias("coverage"))


def training_curve(x: Inputs) -> DataFrame:
    """(epoch, direction, eval_set, metric, value): from evaluations; the two populations stay apart."""
    return N.unpivot(x["evaluations"], ["epoch", "direction", "eval_set"], ["bleu", "chrf", "loss"])


def training_loss(x: Inputs) -> DataFrame:
    """(step, metric, value): from steps (step, loss, learning_rate)."""
    return N.unpivot(x["steps"], ["step"], ["loss", "learning_rate"])


def scores_by_direction(x: Inputs) -> DataFrame:
    """(direction, metric, value): from scores (direction, bleu, chrf)."""
    return N.unpivot(x["scores"], ["direction"], ["bleu", "chrf"])


def held_out_vs_in_domain(x: Inputs) -> DataFrame:
    """(population, direction, metric, value): two score tables side by side."""
    both = x["scores"].withColumn("population", F.lit("held_out")).unionByName(x["scores_in_domain"].withColumn("population", F.lit("in_domain")))
    return N.unpivot(both, ["population", "direction"], ["bleu", "chrf"])


def latency_distribution(x: Inputs) -> DataFrame:
    """(direction, value, percent): the empirical distribution of latencies."""
    return P.empirical_cdf(x["latencies"], "direction", "value")


def budget_vs_actual(x: Inputs) -> DataFrame:
    """(id, measured, target, percent, status) of what is measured, not-met first."""
    g = x["gates"].where("measured is not null")
    status = N.gate(F.col("measured"), F.col("target"), F.col("higher"))
    return g.select("id", "measured", "target", (100 * F.col("measured") / F.coalesce(F.nullif("target", F.lit(0.0)), F.lit(1.0))).alias("percent"), status.alias("status")).orderBy(F.desc(F.col("status") == "not-met"), "id")


def acceptance_criteria(x: Inputs) -> DataFrame:
    """(id, status, kind): all gates, and the unmeasured ones again as gaps."""
    rows = x["gates"].select("id", N.gate(F.col("measured"), F.col("target"), F.col("higher")).alias("status"))
    return rows.withColumn("kind", F.lit("criterion")).unionAll(rows.where("status = 'unmeasured'").withColumn("kind", F.lit("gap")))


def corpus_funnel(x: Inputs) -> DataFrame:
    """(reason, n), most first: from rejects (reason, n)."""
    return x["rejects"].orderBy(F.desc("n"), "reason")


def domains_and_splits(x: Inputs) -> DataFrame:
    """(name, n, split): domain counts with their split; `all three` for the conversational one, `?` if unassigned."""
    split = F.coalesce("split", F.when(F.col("name") == "conversational", "all three"), F.lit("?"))
    return x["domains"].join(x["splits"], "name", "left").select("name", "n", split.alias("split")).orderBy(F.desc("n"), "name")


def round_trip_figures(x: Inputs) -> DataFrame:
    """(population, metric, value): from round_trips (population, exact, exact_folded, latin_stable)."""
    return N.unpivot(x["round_trips"], ["population"], ["exact", "exact_folded", "latin_stable"])


def round_trip_failures(x: Inputs) -> DataFrame:
    """(class, n, percent): from trips (class), failures only."""
    counts = x["trips"].where("class is not null").groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()))  # one row for each of 8 classes


REPORTS: dict[str, Report] = {
    "tokens_per_sentence": Report(("profiles",), tokens_per_sentence),
    "information_loss": Report(("profiles",), information_loss),
    "worked_example": Report(("showcase",), worked_example),
    "pieces_per_word": Report(("words",), pieces_per_word),
    "size_vs_budget": Report(("files", "budget"), size_vs_budget),
    "vocabulary_coverage": Report(("profiles",), vocabulary_coverage),
    "training_curve": Report(("evaluations",), training_curve),
    "training_loss": Report(("steps",), training_loss),
    "scores_by_direction": Report(("scores",), scores_by_direction),
    "held_out_vs_in_domain": Report(("scores", "scores_in_domain"), held_out_vs_in_domain),
    "latency_distribution": Report(("latencies",), latency_distribution),
    "budget_vs_actual": Report(("gates",), budget_vs_actual),
    "acceptance_criteria": Report(("gates",), acceptance_criteria),
    "corpus_funnel": Report(("rejects",), corpus_funnel),
    "domains_and_splits": Report(("domains", "splits"), domains_and_splits),
    "round_trip_figures": Report(("round_trips",), round_trip_figures),
    "round_trip_failures": Report(("trips",), round_trip_failures),
}


def render(inputs: Inputs, path: str, strict: bool = False) -> list[str]:
    """Write each report that has its inputs as CSV under `path`; returns their names. Strict: a missing input stops it."""
    done = []
    for name, report in REPORTS.items():
        missing = [n for n in report.needs if n not in inputs]
        if missing and strict:
            raise ValueError(f"report {name} lacks {missing}")
        if not missing:
            report.build(inputs).coalesce(1).write.option("header", True).csv(f"{path}/{name}")
            done.append(name)
    return done
