"""Operator 5: toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the character 3-, 4- and 5-grams of a text, hashed to 2^22 slots, each with the log of 1 plus how often it
occurs; each is scaled by the log of the ratio of its (smoothed) means in toxic and other texts, and a logistic regression
with an L2 penalty is fitted over the scaled features until its gradient has gone. The fit sees a bounded sample of labelled rows: at most POSITIVES toxic and NEGATIVES other ones, those
of least hash, and at most SAMPLE_CHARS characters of their texts in all, in that order; the fit needs memory for their
features only. Fit says which slots get a weight: by default the 50,000 strongest of those in three sampled texts or more
with a log ratio of 1 or more; with Fit(None, 1, 0.0) every slot that was met. Every text is scored whole.

Defined results: a null text is empty and gets the score of a text without features; a null doc_id is not held out and
never learned from; labels that are null, or name no document, are left out; if a document has several labels, it is
toxic if half of them say so; without labels of both kinds every score is the share of toxic labels, 0 without labels.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from loomtext.llm.batches import give_back, in_parts, small_batches
from loomtext.llm.names import unused
from loomtext.llm.scratch import materialise

ORDERS = (3, 4, 5)
BITS = 22
POSITIVES, NEGATIVES = 2500, 4000
#: Characters of the sample's texts, at most; the text that reaches the bound is the last one, whole.
SAMPLE_CHARS = 40_000_000


class Fit(NamedTuple):
    """Which slots get a weight: `slots` at most (None: all), those in `rows` texts or more with a log ratio of `ratio` or more."""

    slots: int | None = 50_000
    rows: int = 3
    ratio: float = 1.0


#: The fit ends where the gradient is this share of the first one.
CONVERGED = 1e-3
#: Characters whose features are made at once, in the fit and in scoring.
FIT_CHARS, SCORE_CHARS = 300_000, 1_000_000
#: The log odds of a score of 0.
NEVER = -40.0
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Model(NamedTuple):
    """Weights of the kept slots and the intercept."""

    slots: np.ndarray
    weights: np.ndarray
    intercept: float


def _points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Lowered code points of all texts, white space and controls as one kind of space, and where each text ends."""
    lowered = [(t or "").lower() for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return np.maximum(points, np.uint64(32)), np.cumsum(np.fromiter(map(len, lowered), np.int64, len(lowered)))


def features(texts: list[str | None], known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, slot, log of 1 + occurrences) of each distinct feature of each text; only slots marked in `known`, if given."""
    points, ends = _points(texts)
    found = []
    rolled = points * _STEP
    for order in range(2, max(ORDERS) + 1):
        rolled = (rolled[: max(0, len(points) - order + 1)] + points[order - 1 :]) * _STEP
        if order not in ORDERS or not len(rolled):
            continue
        slot = ((rolled ^ (rolled >> np.uint64(29))) * _STEP >> np.uint64(64 - BITS)).astype(np.int64)
        at = np.flatnonzero(known[slot]) if known is not None else np.arange(len(slot))
        text = np.searchsorted(ends, at, side="right")
        inside = at + order <= ends[text]  # an n-gram ends in the text that it begins in
        found.append((text[inside] << BITS) | slot[at[inside]])
    pairs, often = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
    return pairs >> BITS, pairs & ((1 << BITS) - 1), np.log1p(often)


def fit(texts: list[str | None], toxic: list[int], penalty: float = 1e-3, keep: Fit = Fit()) -> Model:
    """Naive Bayes ratios, then logistic regression by accelerated gradient steps; both classes weigh the same.

    Steps go on until the gradient is CONVERGED of the first one; the penalty makes that certain.
    """
    y = np.asarray(toxic, np.float64)
    pos, neg = y.sum(), len(y) - y.sum()
    if not pos or not neg:
        share = pos / len(y) if len(y) else 0.0
        return Model(np.zeros(0, np.int64), np.zeros(0), math.log(share / (1 - share)) if 0 < share < 1 else -NEVER if share else NEVER)
    size = 1 << BITS
    in_pos, in_neg, in_all, start = np.zeros(size), np.zeros(size), np.zeros(size, np.int64), 0
    for part in in_parts(texts, FIT_CHARS):  # counts only: the features of all texts at once would need a task's whole memory
        row, slot, value = features(part)
        in_pos += np.bincount(slot, weights=value * y[row + start], minlength=size)
        in_neg += np.bincount(slot, weights=value * (1 - y[row + start]), minlength=size)
        in_all += np.bincount(slot, minlength=size)
        start += len(part)
    ratio = np.log((in_pos + 1) / (pos + 2)) - np.log((in_neg + 1) / (neg + 2))
    strength = np.abs(ratio) * np.sqrt(in_all)
    kept = np.flatnonzero((in_all >= max(1, keep.rows)) & (np.abs(ratio) >= keep.ratio))
    kept = np.sort(kept[np.argsort(-strength[kept], kind="stable")[: keep.slots]])
    number = np.zeros(size, np.int64)
    number[kept] = np.arange(len(kept))
    known = np.zeros(size, bool)
    known[kept] = True
    rows, cols, values, start = [], [], [], 0
    for part in in_parts(texts, FIT_CHARS):
        row, slot, value = features(part, known)
        rows.append(row + start)
        cols.append(number[slot])
        values.append(value)
        start += len(part)
    row, col = np.concatenate(rows), np.concatenate(cols)
    scale = ratio[kept]
    x = np.concatenate(values) * scale[col]
    weigh = np.where(y > 0, 0.5 / pos, 0.5 / neg)
    many = np.bincount(row, weights=x**2, minlength=len(y))
    step = 1.0 / (0.25 * (np.dot(weigh, many) + 1.0) + penalty)
    w, b, ahead_w, ahead_b, k, first = np.zeros(len(kept)), 0.0, np.zeros(len(kept)), 0.0, 0, None
    while True:
        z = np.bincount(row, weights=ahead_w[col] * x, minlength=len(y)) + ahead_b
        g = weigh * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        slope_w, slope_b = np.bincount(col, weights=g[row] * x, minlength=len(kept)) + penalty * ahead_w, g.sum()
        steep = math.sqrt(np.dot(slope_w, slope_w) + slope_b**2)
        first = steep if first is None else first
        if steep <= CONVERGED * first:
            w, b = ahead_w, ahead_b
            break
        new_w, new_b = ahead_w - step * slope_w, ahead_b - step * slope_b
        if np.dot(slope_w, new_w - w) + slope_b * (new_b - b) > 0:
            k = 0  # the pull has gone uphill: it starts anew
        pull = k / (k + 3)
        ahead_w, ahead_b = new_w + pull * (new_w - w), new_b + pull * (new_b - b)
        w, b, k = new_w, new_b, k + 1
    return Model(kept, w * scale, float(b))


def score(model: Model, known: np.ndarray, number: np.ndarray, texts: list[str | None]) -> np.ndarray:
    """Probability of toxicity for each text."""
    z = np.full(len(texts), model.intercept)
    if len(model.slots):
        row, slot, value = features(texts, known)
        z += np.bincount(row, weights=model.weights[number[slot]] * value, minlength=len(texts))
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def held_out(doc_id: Column) -> Column:
    """True for the third of the ids that is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """(doc_id, text, toxic): the bounded sample to learn from."""
    voted = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.avg("toxic").alias("share"))
    voted = voted.where(~held_out(F.col("id"))).select("id", (F.col("share") >= 0.5).cast("int").alias("toxic"))
    order = F.xxhash64("id")
    chosen = [voted.where(F.col("toxic") == k).orderBy(order, "id").limit(n) for k, n in ((1, positives), (0, negatives))]
    some = materialise(chosen[0].unionAll(chosen[1]), "labelled")  # at most positives + negatives rows
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    joined = rows.join(F.broadcast(some), rows["doc_id"] == some["id"]).select("doc_id", "text", "toxic")
    chosen = [joined.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id", "text")).limit(n) for k, n in ((1, positives), (0, negatives))]
    return chosen[0].unionAll(chosen[1])


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, keep: Fit = Fit()) -> Model:
    """Fit on the sample, in one task; the weights come back."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, chars = [], 0
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "toxic"))):
                if chars < SAMPLE_CHARS:
                    rows.append(r)
                    chars += len(r[1] or "")
        rows.sort(key=lambda r: (r[0], r[1] or ""))
        model = fit([r[1] for r in rows], [r[2] for r in rows], keep=keep)
        slots = np.append(model.slots, -1)
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(np.append(model.weights, model.intercept))], names=["slot", "weight"])
        give_back()

    sample = labelled_sample(docs, labels, positives, negatives)
    with small_batches(docs.sparkSession):
        found = sample.repartition(1).sortWithinPartitions(F.xxhash64("doc_id", "text")).mapInArrow(learn, "slot long, weight double").collect()
    by_slot = {r["slot"]: r["weight"] for r in found}
    intercept = by_slot.pop(-1, NEVER)  # an empty sample makes no task
    slots = np.asarray(sorted(by_slot), np.int64)
    return Model(slots, np.asarray([by_slot[s] for s in slots.tolist()]), intercept)


def score_rows(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with one more column, the last, that holds the score, by mapInArrow."""
    columns, name = docs.columns, f"{unused(docs)}score"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, number = np.zeros(1 << BITS, bool), np.zeros(1 << BITS, np.int32)
        known[model.slots] = True
        number[model.slots] = np.arange(len(model.slots))
        at = columns.index("text")
        for batch in batches:
            scores = [score(model, known, number, part) for part in in_parts(batch.column(at), SCORE_CHARS)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate([np.zeros(0), *scores]))], names=[*columns, name])
        give_back()

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    return docs.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of `docs` (doc_id, text)."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    scored = score_rows(rows, train(docs, labels))
    value = F.col(scored.columns[-1])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), value.alias("score"), (value >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of `docs` that score below `threshold`, all columns as they are."""
    scored = score_rows(docs, train(docs, labels))
    name = scored.columns[-1]
    return scored.where(F.col(name) < threshold).drop(name)
