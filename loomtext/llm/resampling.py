"""Operator 13: documents drawn in proportion to how much likelier a target's n-grams make them.

Features are all runs of 1 to 3 consecutive words, hashed to buckets by CRC32. Bucket counts of the documents and of the
target give an array of gains, one whole number for each bucket; a document's weight is the sum of the gains of its
features, and its score adds seeded Gumbel noise, so that the highest scores are a draw without replacement.

CRCs are put together in numpy: the CRC of a run is that of its first words, carried over the bytes of the next word by a
table for that length, xor that of the next word; so a word's bytes are looked at once for all its runs.

The draw is exact and sorts nothing that isn't drawn: a histogram of the whole-number scores is summed from the highest
down, which tells how many documents stand above each score and at which score the draw ends; only documents from that
score on are numbered, by doc_id within each score.

Defined results: a null or empty text has no features and weight 0; a null doc_id counts as an empty string in the noise
and comes before others at equal scores; repeated rows are counted, scored and drawn as often as they come; an empty target
gives each bucket the gain of none found; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loomtext.llm.batches import give_back, in_parts
from loomtext.llm.names import unused
from loomtext.llm.scratch import materialise
from loomtext.llm.words import FOLD, utf8
from loomtext.operators.sampling import running

BUCKETS = 10_000
#: Documents with fewer words aren't drawn; the share that is drawn, as a fraction.
LEAST_WORDS, SHARE = 20, (5, 100)
#: Bytes looked at together; words longer than LONG are hashed one by one.
PIECE, LONG = 1 << 20, 48

_NEXT_TWO = re.compile(rb"(?: *[^ ]+){0,2}")
_ALL = np.uint32(0xFFFFFFFF)


@lru_cache(maxsize=1)
def _bytewise() -> np.ndarray:
    """What a CRC without its first and last inversion becomes by a byte, for each value of its low byte xor the byte."""
    return np.array([zlib.crc32(bytes([b]), 0xFFFFFFFF) ^ 0xFFFFFFFF for b in range(256)], np.uint32)


def _over(tables: np.ndarray, which: np.ndarray | int, crc: np.ndarray) -> np.ndarray:
    """CRCs carried over zero bytes; tables[which] has the four tables of a length, one for each byte of a CRC."""
    flat, at = tables.reshape(-1), np.asarray(which, np.int64) * 1024
    out = flat[at + (crc & 255)]
    for k in (1, 2, 3):
        out ^= flat[at + (256 * k + ((crc >> np.uint32(8 * k)) & 255))]
    return out


@lru_cache(maxsize=4096)
def _tables(length: int) -> np.ndarray:
    """The four tables of a length: those of half of it, twice, and one byte more if it is odd."""
    each = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).reshape(-1)
    if length > 1:
        half = _tables(length // 2)[None]
        each = _over(half, 0, _over(half, 0, each))
    if length % 2:
        each = _bytewise()[each & 255] ^ (each >> np.uint32(8))
    return each.reshape(4, 256)


def word_crcs(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The CRC32 of each word, a byte of all words at a time, longest first."""
    order = np.argsort(-lens, kind="stable")
    at, left = starts[order], lens[order]
    crc, table = np.full(len(at), _ALL, np.uint32), _bytewise()
    for k in range(min(int(left[0]), LONG) if len(left) else 0):
        n = int(np.searchsorted(-left, -k))  # so many words have a byte here
        crc[:n] = table[(crc[:n] ^ data[at[:n] + k]) & 255] ^ (crc[:n] >> np.uint32(8))
    for k in range(int(np.searchsorted(-left, -LONG)) if len(left) else 0):
        crc[k] = zlib.crc32(data[at[k] : at[k] + left[k]].tobytes()) ^ 0xFFFFFFFF
    out = np.empty_like(crc)
    out[order] = crc ^ _ALL
    return out


def run_crcs(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> list[np.ndarray]:
    """CRC32s of the runs of one, two and three words that begin at each word (the last ones lack one or two)."""
    one = word_crcs(data, starts, lens)
    known, which = np.unique(lens, return_inverse=True)
    tables = np.stack([_tables(int(n)) for n in known]) if len(known) else np.zeros((0, 4, 256), np.uint32)
    out = [one]
    for k in (1, 2):
        before = out[-1][: max(0, len(one) - k)] ^ _ALL
        spaced = _bytewise()[(before ^ np.uint32(32)) & 255] ^ (before >> np.uint32(8)) ^ _ALL
        out.append(_over(tables, which[k:], spaced) ^ one[k:])
    return out


def features(texts: list[bytes | None], buckets: int) -> Iterator[tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """For pieces of the texts: the text of each word, and for runs of one to three words which words begin one, and its bucket."""
    data = b" ".join((t or b"").translate(FOLD) for t in texts)
    ends = np.cumsum([len(t or b"") + 1 for t in texts])
    start = 0
    while start < len(data):
        # a piece ends before a word; runs that begin in it may go on for two words
        stop = data.find(b" ", start + PIECE) if start + PIECE < len(data) else -1
        stop = len(data) if stop < 0 else stop
        piece = np.frombuffer(data[start : _NEXT_TWO.match(data, stop).end()], np.uint8)
        edges = np.flatnonzero(np.diff(piece != 32, prepend=False, append=False))
        starts, lens = edges[::2], edges[1::2] - edges[::2]
        own = int(np.searchsorted(starts, stop - start))
        owner = np.searchsorted(ends, starts + start, side="right")
        runs = []
        for k, crc in enumerate(run_crcs(piece, starts, lens)):
            first = np.flatnonzero(owner[: len(owner) - k] == owner[k:]) if k else np.arange(len(owner))
            first = first[first < own]
            runs.append((first, (crc[first] % np.uint32(buckets)).astype(np.int64)))
        yield owner[:own], runs
        start = stop


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how often each bucket's features come in all rows of `texts` (text); a task sends each bucket once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in in_parts(utf8(batch.column("text"))):
                for _, runs in features(part, buckets):
                    for _, found in runs:
                        counts += np.bincount(found, minlength=buckets)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(counts[met])], names=["bucket", "n"])
        give_back()

    each = texts.select(texts["text"].cast("string").alias("text")).mapInArrow(run, "bucket long, n long")
    return each.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: dict[int, int], target: dict[int, int], buckets: int) -> list[int]:
    """The gain of each bucket from the counts of those met."""
    s, t = sum(docs.values()), sum(target.values())
    return [math.floor(1000 * math.log((target.get(b, 0) + 1) * (s + buckets) / ((docs.get(b, 0) + 1) * (t + buckets)))) for b in range(buckets)]


def weights(docs: DataFrame, gain: list[int]) -> DataFrame:
    """doc_id, text_hash, n_words, n_features, weight for each row of `docs` (doc_id, text)."""
    names, buckets = ["n_words", "n_features", "weight"], len(gain)

    def weighed(texts: list[bytes | None], worth: np.ndarray) -> np.ndarray:
        sums = np.zeros((3, len(texts)), np.int64)
        for owner, runs in features(texts, buckets):
            for k, (first, found) in enumerate(runs):
                of = owner[first]
                many = np.bincount(of, minlength=len(texts))
                sums[0] += many if k == 0 else 0
                sums[1] += many
                sums[2] += np.bincount(of, worth[found], len(texts)).astype(np.int64)  # whole numbers far below 2^53
        return sums

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worth = np.array(gain, np.float64)
        for batch in batches:
            sums = np.concatenate([np.zeros((3, 0), np.int64), *[weighed(part, worth) for part in in_parts(utf8(batch.column("text")))]], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *map(pa.array, sums)], names=["doc_id", "text_hash", *names])
        give_back()

    text = docs["text"].cast("string")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, " + ", ".join(f"{n} long" for n in names))


def noise(doc_id: Column, seed: int) -> Column:
    """Seeded Gumbel noise in thousandths, rounded down."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    even = (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(-1000 * F.log(-F.log(even)))


def ranked(scored: DataFrame, least_words: int = LEAST_WORDS, share: tuple[int, int] = SHARE) -> DataFrame:
    """`scored` (doc_id, n_words, score and more) with `rank`, from 1 for the highest score, null for what isn't drawn."""
    may = scored.where(F.col("n_words") >= least_words)
    counts = materialise(may.groupBy("score").agg(F.count(F.lit(1)).alias("n")), "scores")
    drawn = (counts.agg(F.sum("n")).first()[0] or 0) * share[0] // share[1]
    if not drawn:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    summed = running(counts.select(F.lit(0).alias("all"), (-F.col("score")).alias("down"), "score", "n"), "all", "down", "n")
    above = materialise(summed.select("score", (F.col("upto") - F.col("n")).alias("above")).where(F.col("above") < drawn), "above")
    cutoff = above.agg(F.min("score")).first()[0]
    in_draw = (F.col("n_words") >= least_words) & (F.col("score") >= cutoff)
    placed = running(scored.where(in_draw).withColumn("one", F.lit(1)), "score", "doc_id", "one")
    rank = F.col("above") + F.col("upto")
    met = placed.join(above.withColumnRenamed("score", "of_score"), F.col("score") == F.col("of_score"))
    told = met.withColumn("rank", F.when(rank <= drawn, rank)).select(*scored.columns, "rank")
    return told.unionByName(scored.where(~in_draw).withColumn("rank", F.lit(None).cast("long")))


def resample(
    docs: DataFrame, target: DataFrame, share: tuple[int, int] = SHARE, least_words: int = LEAST_WORDS, seed: int = 42, buckets: int = BUCKETS
) -> DataFrame:
    """doc_id, text_hash, n_words, n_features, weight, score, rank for each row of `docs` (doc_id, text).

    `target` (text) is what the drawn documents should be like. Two arrays of `buckets` counts are read to the driver.
    """
    met = [{r["bucket"]: r["n"] for r in bucket_counts(texts, buckets).collect()} for texts in (docs, target)]
    scored = weights(docs, gains(*met, buckets)).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    return ranked(materialise(scored, "scored"), least_words, share)


def drawn(docs: DataFrame, target: DataFrame, **options: object) -> DataFrame:
    """The rows of `docs` that are drawn, with all their columns; equal rows (doc_id and text) stay if one of them is drawn."""
    own = unused(docs)
    told = resample(docs, target, **options).where("rank is not null").select(F.col("doc_id").alias(f"{own}id"), F.col("text_hash").alias(f"{own}hash"))
    key = docs["doc_id"].cast("long").eqNullSafe(told[f"{own}id"]) & (F.xxhash64(docs["text"].cast("string")) == told[f"{own}hash"])
    return docs.join(told.distinct(), key, "left_semi")
