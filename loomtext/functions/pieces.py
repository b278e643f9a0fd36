"""Token counts by a tokenizer file, and what of a text its unknown pieces swallow."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

PIECES = "struct<tokens:int,unknown:int,lost:int,spans:array<struct<start:int,end:int>>>"
_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_KIND = pa.struct([("tokens", pa.int32()), ("unknown", pa.int32()), ("lost", pa.int32()), ("spans", pa.list_(_SPAN))])


@lru_cache(maxsize=4)
def _loaded(file: str) -> tuple[Any, int | None]:
    """A worker's tokenizer, without truncation, padding and added tokens, and the id of its unknown piece, if it has one."""
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(file)
    own.no_truncation()
    own.no_padding()
    model = json.loads(own.to_str())["model"]
    unknown = model.get("unk_token")
    if unknown is None and isinstance(model.get("unk_id"), int):
        return own, model["unk_id"]
    return own, None if unknown is None else own.token_to_id(unknown)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that touch or overlap as one; empty ones say nothing."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(s for s in spans if s[0] < s[1]):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


def piece_counts(file: str) -> Callable[[Column], Column]:
    """A column function: struct<tokens, unknown, lost, spans> of each text; null for a null text.

    `spans` are code points of the text that unknown pieces stand for, and `lost` is how many. If the tokenizer has no
    unknown piece these are null: it wasn't measured, which isn't 0.
    """

    @F.arrow_udf(PIECES)
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own, unknown = _loaded(file)
        for batch in batches:
            texts = batch.to_pylist()
            known = iter(own.encode_batch([t for t in texts if t is not None], add_special_tokens=False))
            out: list[dict[str, Any] | None] = []
            for text in texts:
                if text is None:
                    out.append(None)
                    continue
                e = next(known)
                told: dict[str, Any] = {"tokens": len(e.ids), "unknown": None, "lost": None, "spans": None}
                if unknown is not None:
                    at = merged([span for i, span in zip(e.ids, e.offsets) if i == unknown])
                    told |= {"unknown": e.ids.count(unknown), "lost": sum(b - a for a, b in at), "spans": [{"start": a, "end": b} for a, b in at]}
                out.append(told)
            yield pa.array(out, _KIND)

    return counted


def lost_report(rows: DataFrame, group: str, text: str, count: Callable[[Column], Column]) -> DataFrame:
    """(group, sentences, tokens, tokens_per_char, unknown_sentences, unknown_share, lost_percent) of rows (group, text).

    Percent of sentences with an unknown piece, of pieces that are unknown, and, on average over sentences, of characters
    they stand for; null where the tokenizer has no unknown piece, or there is nothing to divide by.
    """
    told = rows.where(F.col(text).isNotNull()).select(group, F.length(text).alias("chars"), count(F.col(text)).alias("p"))
    share = F.when(F.col("chars") > 0, F.col("p.lost") / F.col("chars")).when(F.col("p.lost").isNotNull(), 0.0)
    return told.groupBy(group).agg(
        F.count(F.lit(1)).alias("sentences"), F.sum("p.tokens").alias("tokens"), F.round(F.sum("p.tokens") / F.nullif(F.sum("chars"), F.lit(0)), 4).alias("tokens_per_char"),
        F.round(100 * F.avg(F.when(F.col("p.unknown") > 0, 1.0).when(F.col("p.unknown") == 0, 0.0)), 3).alias("unknown_sentences"),
        F.round(100 * F.sum("p.unknown") / F.nullif(F.sum(F.when(F.col("p.unknown").isNotNull(), F.col("p.tokens"))), F.lit(0)), 3).alias("unknown_share"), F.round(100 * F.avg(share), 3).alias("lost_percent"),
    )
