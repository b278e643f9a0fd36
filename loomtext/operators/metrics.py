"""Measures: round trips, n-gram scores, histograms, gates."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Sequence
from string import punctuation

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType

from loomtext.functions import script as S
from loomtext.functions.text import let

MAX_ORDER = 4
CHAR_ORDER, WORD_ORDER, BETA = 6, 2, 2.0


def round_trip(words: DataFrame) -> DataFrame:
    """(word, thaana, back, class, edits): Latin words to Thaana, to Latin and to Thaana again; each distinct word once."""
    def told(thaana: Column, latin: Column, back: Column, stable: Column) -> Column:
        named = {"thaana": thaana, "latin": latin, "back": back, "class": S.failure_class(thaana, latin, back, stable), "edits": F.levenshtein(thaana, back), "stable": stable}
        return F.struct(*[c.alias(k) for k, c in named.items()])

    def from_thaana(thaana: Column) -> Column:
        return let(S.to_latin(thaana), lambda latin: let(S.to_thaana(latin), lambda back: let(S.to_latin(back) == latin, lambda stable: told(thaana, latin, back, stable))))

    each = words.select("word").distinct()
    return each.select("word", F.inline(F.array(let(S.to_thaana(F.col("word")), from_thaana))))


def round_trip_summary(trips: DataFrame) -> DataFrame:
    """Counts and shares of exact, folded and Latin-stable trips, and edits by character."""
    exact, folded = F.col("thaana") == F.col("back"), S.fold_letters(F.col("thaana")) == S.fold_letters(F.col("back"))
    n = F.count(F.lit(1))

    def percent(c: Column) -> Column:
        return F.round(100.0 * F.count_if(c) / n, 3)

    return trips.agg(n.alias("n"), percent(exact).alias("exact"), percent(folded).alias("exact_folded"), percent(F.col("stable")).alias("latin_stable"), F.sum("edits").alias("edits"), F.round(F.sum("edits") / F.sum(F.length("thaana")), 5).alias("edits_per_char"))


_MARKS = re.compile(r"([{-~\[-` -&(-+:-@/])")
_STOPS = ((re.compile(r"([^0-9])([.,])"), r"\1 \2 "), (re.compile(r"([.,])([^0-9])"), r" \1 \2"), (re.compile(r"([0-9])(-)"), r"\1 \2 "))
#: What marks a text's entities stand for, in the order they are restored.
_ENTITIES = (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))


def score_tokens(text: str | None) -> list[str]:
    """Tokens for BLEU, as mteval-v13a cuts them: entities restored, marks apart from words but between digits; case stays."""
    line = (text or "").rstrip().replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    for entity, mark in _ENTITIES:
        line = line.replace(entity, mark)
    line = _MARKS.sub(r" \1 ", f" {line} ")
    for pattern, spaced in _STOPS:
        line = pattern.sub(spaced, line)
    return line.split()


def split_words(text: str | None) -> list[str]:
    """Words for chrF++: cut at white space, one ASCII mark apart at a word's end, else at its start."""
    out = []
    for word in (text or "").split():
        if len(word) > 1 and word[-1] in punctuation:
            out += [word[:-1], word[-1]]
        elif len(word) > 1 and word[0] in punctuation:
            out += [word[0], word[1:]]
        else:
            out.append(word)
    return out


def _clipped(guess: Sequence, given: Sequence, order: int) -> tuple[int, int, int]:
    """n-grams that both have, of the guess, of what is given."""
    a, b = (Counter(tuple(x[k : k + order]) for k in range(len(x) - order + 1)) for x in (guess, given))
    return sum((a & b).values()), a.total(), b.total()


def _word_counts(prediction: str | None, reference: str | None) -> list[int]:
    a, b = score_tokens(prediction), score_tokens(reference)
    return [n for order in range(1, MAX_ORDER + 1) for n in _clipped(a, b, order)]


def _char_counts(prediction: str | None, reference: str | None) -> list[int]:
    """A side's n-grams count for nothing where the reference is too short to have any of that order."""
    bare = ["".join((x or "").split()) for x in (prediction, reference)]
    words = [split_words(x) for x in (prediction, reference)]
    counts = [_clipped(*bare, order) for order in range(1, CHAR_ORDER + 1)] + [_clipped(*words, order) for order in range(1, WORD_ORDER + 1)]
    return [n for hits, guessed, given in counts for n in (hits, guessed if given else 0, given)]


def _counted(pairs: DataFrame, group: str, count: Callable[[str | None, str | None], list[int]], orders: int) -> DataFrame:
    """(group, n, hits1, guessed1, given1, ...): clipped n-gram counts within each pair, summed over the group.

    Counts leave a pair's row as 3 numbers an order, so that only sums are shuffled.
    """

    @F.pandas_udf(ArrayType(LongType()))
    def of_pair(prediction: pd.Series, reference: pd.Series) -> pd.Series:
        return pd.Series([count(a, b) for a, b in zip(prediction, reference)])

    names = [f"{name}{order}" for order in range(1, orders + 1) for name in ("hits", "guessed", "given")]
    each = pairs.select(group, of_pair(F.col("prediction").cast("string"), F.col("reference").cast("string")).alias("counts"))
    return each.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.get("counts", F.lit(k))).alias(name) for k, name in enumerate(names)])


def bleu(pairs: DataFrame, group: str) -> DataFrame:
    """(group, n, bleu): corpus BLEU-4 of (group, prediction, reference), never pooled over groups.

    Counts are summed over the group; orders without a hit count as 1/2, 1/4, ... of a hit, one after another; shorter
    predictions pay the brevity penalty. 0 without any hit, or where no prediction has an n-gram of some order.
    """
    wide = _counted(pairs, group, _word_counts, MAX_ORDER)
    halvings, logs, any_hit, all_orders = F.lit(0), F.lit(0.0), F.lit(False), F.lit(True)
    for n in range(1, MAX_ORDER + 1):
        hits, guessed = F.col(f"hits{n}"), F.col(f"guessed{n}")
        halvings = halvings + (hits == 0).cast("int")
        logs = logs + F.log(F.when(hits == 0, 1 / F.pow(F.lit(2.0), halvings)).otherwise(hits) / F.nullif(guessed, F.lit(0)))
        any_hit, all_orders = any_hit | (hits > 0), all_orders & (guessed > 0)
    brevity = F.when(F.col("guessed1") < F.col("given1"), F.exp(1 - F.col("given1") / F.col("guessed1"))).otherwise(1.0)
    score = F.when(any_hit & all_orders, 100 * brevity * F.exp(logs / MAX_ORDER)).otherwise(0.0)
    return wide.select(group, "n", F.round(score, 4).alias("bleu"))


def chrf(pairs: DataFrame, group: str) -> DataFrame:
    """(group, n, chrf): chrF++ of (group, prediction, reference): character orders 1-6 without white space, words 1-2, beta 2.

    The F-score of precision and recall, each averaged over the orders that both sides have, from counts summed over the group.
    """
    orders = CHAR_ORDER + WORD_ORDER
    wide = _counted(pairs, group, _char_counts, orders)
    precision, recall, both = F.lit(0.0), F.lit(0.0), F.lit(0)
    for k in range(1, orders + 1):
        there = (F.col(f"guessed{k}") > 0) & (F.col(f"given{k}") > 0)
        precision = precision + F.when(there, F.col(f"hits{k}") / F.col(f"guessed{k}")).otherwise(0.0)
        recall = recall + F.when(there, F.col(f"hits{k}") / F.col(f"given{k}")).otherwise(0.0)
        both = both + there.cast("int")
    # sums over `both` orders, averaged: the number of orders leaves the quotient of the score once
    score = (1 + BETA**2) * precision * recall / (BETA**2 * precision + recall) / both
    return wide.select(group, "n", F.round(100 * F.when((both > 0) & (precision + recall > 0), score).otherwise(0.0), 4).alias("chrf"))


def histogram(rows: DataFrame, value: str, low: int, high: int) -> DataFrame:
    """(bin, n, percent) on every whole number from low to high, zero where there is none; values beyond are in no bin but count."""
    counts = rows.groupBy(F.col(value).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    grid = rows.sparkSession.range(low, high + 1).select(F.col("id").cast("int").alias("bin"))
    met = grid.join(counts, "bin", "left").crossJoin(F.broadcast(total))
    return met.select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.round(100.0 * F.coalesce("n", F.lit(0)) / F.col("total"), 3).alias("percent"))


def gate(measured: Column, target: Column, higher: Column) -> Column:
    """met, not-met, or unmeasured where there is no measurement; null is never 0."""
    met = F.when(higher, measured >= target).otherwise(measured <= target)
    return F.when(measured.isNull() | target.isNull(), "unmeasured").when(met, "met").otherwise("not-met")


def unpivot(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(*keys, metric, value): the non-null values of the columns."""
    return rows.unpivot(keys, [F.col(v).cast("double").alias(v) for v in values], "metric", "value").where("value is not null")


def most_precise(rows: DataFrame, fingerprint: list[str], cell: str, precision: str, most: int | None = None) -> DataFrame:
    """One row for each fingerprint, the most precise, with the cells it was seen in, sorted, and `n_cells`, their number.

    With `most`, a fingerprint seen in more cells lists none of them (null): cells_of() has them all, as rows.
    """
    whole = F.struct(precision, *[c for c in rows.columns if c != precision])
    best = rows.groupBy(*fingerprint).agg(F.max(whole).alias("b"))
    cells = cells_of(rows, fingerprint, cell)
    sizes = cells.groupBy(*fingerprint).agg(F.count(F.lit(1)).alias("n_cells"))
    few = cells.join(sizes.where(F.col("n_cells") <= most).drop("n_cells"), fingerprint) if most else cells
    listed = few.groupBy(*fingerprint).agg(F.array_join(F.sort_array(F.collect_list("cell")), ",").alias("cells"))
    return best.join(sizes, fingerprint).join(listed, fingerprint, "left").select("b.*", "cells", "n_cells")


def cells_of(rows: DataFrame, fingerprint: list[str], cell: str) -> DataFrame:
    """(*fingerprint, cell): each cell of a fingerprint once."""
    return rows.select(*fingerprint, F.col(cell).cast("string").alias("cell")).distinct()


def joined_or_fail(wanted: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Every row of `wanted` with its match; a row without one stops the query."""
    met = wanted.join(found.withColumn("__found", F.lit(True)), key, "left")
    return met.where(F.when(F.col("__found").isNull(), F.raise_error(F.concat(F.lit("no match for "), F.col(key).cast("string"))).cast("boolean")).otherwise(True)).drop("__found")


def first_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row of each key, the first by `order`, with the number of rows it had."""
    g = rows.groupBy(key).agg(F.min(F.struct(order, *[c for c in rows.columns if c not in (order, key)])).alias("r"), F.count(F.lit(1)).alias("copies"))
    return g.select(key, "r.*", "copies")


def last_wins(wanted: DataFrame, rows: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of `wanted` (key) with the last row by `order` of those in `rows` that have their key."""
    others = [c for c in rows.columns if c not in (key, order)]
    last = rows.groupBy(key).agg(F.max_by(F.struct(order, *others), order).alias("last"))
    return wanted.join(last, key).select(key, "last.*")
