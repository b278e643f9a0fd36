"""A model as a column function: loaded once in each Python worker, asked in Arrow batches, with errors and refusals as rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, functions as F

from loomtext.functions import tables as T

RESULT = "struct<status:string,text:string,error:string>"
_KIND = pa.struct([("status", pa.string()), ("text", pa.string()), ("error", pa.string())])
#: Models of this worker by the number of their translator.
_LOADED: dict[str, Model] = {}


class Model(Protocol):
    """What a loader gives."""

    def count(self, text: str) -> int:
        """Tokens of an input, by the model's own tokenizer."""

    def translate(self, texts: list[str]) -> list[str]:
        """An output for each input, in order; the same inputs give the same outputs."""


def _told(e: Exception) -> str:
    return str(e) or type(e).__name__


def _answers(model: Model, texts: list[str]) -> list[tuple[str, str | None, str | None]]:
    """One result for each text; where a batch fails its texts are asked one by one, so that only bad ones fail."""
    try:
        out = model.translate(texts)
        if len(out) != len(texts):
            raise ValueError(f"{len(out)} outputs for {len(texts)} inputs")
        return [("ready", t.strip(), None) for t in out]
    except Exception as e:  # noqa: BLE001  whatever a model raises is its row's error
        if len(texts) == 1:
            return [("error", None, _told(e))]
        return [a for t in texts for a in _answers(model, [t])]


def results(load: Callable[[], Model], number: str, texts: list[str | None], limit: int) -> list[dict[str, str | None]]:
    """status, text and error for each input: ready; error, with the reason; or not_loaded for a null input, which asks nothing.

    An input of more than `limit` tokens is refused, never cut. A loader that fails makes errors of its rows and is tried
    again with the next batch.
    """
    out: list[tuple[str, str | None, str | None]] = [("not_loaded", None, None)] * len(texts)
    asked = [k for k, t in enumerate(texts) if t is not None]
    if asked and number not in _LOADED:
        try:
            _LOADED[number] = load()
        except Exception as e:  # noqa: BLE001  as above
            for k in asked:
                out[k] = ("error", None, _told(e))
            asked = []
    model, fit = _LOADED.get(number), []
    for k in asked:
        try:
            n = model.count(texts[k])
        except Exception as e:  # noqa: BLE001  as above
            out[k] = ("error", None, _told(e))
            continue
        if n > limit:
            out[k] = ("error", None, f"{n} tokens, over the limit of {limit}: it would be cut, so it isn't translated")
        else:
            fit.append(k)
    if fit:
        for k, answer in zip(fit, _answers(model, [texts[k] for k in fit]), strict=True):
            out[k] = answer
    return [dict(zip(("status", "text", "error"), o)) for o in out]


def model_translator(load: Callable[[], Model], limit: int = T.MAX_TOKENS) -> Callable[[Column], Column]:
    """A translator for plans.trace: `load` is called where the rows are, once in a worker's life, and its model answers them.

    `load` travels to the workers, the model doesn't: what it needs (files, sessions) it must find there.
    """
    number = uuid.uuid4().hex

    @F.arrow_udf(RESULT)
    def answered(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(results(load, number, batch.to_pylist(), limit), _KIND)

    return answered
