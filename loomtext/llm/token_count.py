"""Operator 1: token counts with a whole-token shortcut.

A vocabulary of merged pieces is read from a model file. Offline, each piece is run through the merge rounds on its own:
those that end as one token form the shortcut set. At run time a pre-token in that set counts as one; the others are merged.

Texts are cut where no piece can reach across: before a space that follows another character, and at line feeds. The cut
rules are proven against the vocabulary when it is loaded, so counts equal those of the library that owns the file.

Defined results: a null or empty text has 0 tokens and 0 bytes; every input row, repeated or not, gives one row; a null
doc_id stays null; other columns are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from sys import getsizeof

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomtext.llm.batches import give_back, in_parts
from loomtext.llm.bpe import PairTable

#: The mark that stands for a space in the pieces.
MARK = "▁"
#: Bytes of pre-tokens that a worker remembers the counts of before it starts again.
MEMO_BYTES = 48_000_000
_RUNS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class PieceCounter:
    """Token counts by a sentencepiece BPE file with byte fallback."""

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.ids = {model.id_to_piece(i): i for i in plain}
        scores = sorted({model.get_score(i) for i in plain}, reverse=True)
        rank_of = {s: r for r, s in enumerate(scores)}
        ranks = {i: rank_of[model.get_score(i)] for i in plain}
        #: Characters that aren't pieces still are symbols until the end, when each becomes its UTF-8 bytes.
        pairs = []
        self.of_point = -1 - np.arange(0x110000)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.of_point[ord(piece)] = i
        for piece, i in self.ids.items():
            for cut in range(1, len(piece)):
                a, b = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if a is not None and b is not None:
                    pairs.append((a, b, ranks[i], i))
        self.rules = PairTable(pairs)
        self._prove_cuts()
        self.whole = self._prove_whole()
        self.memo: dict[str, int] = {}
        self.held = 0

    def _prove_cuts(self) -> None:
        """No piece holds a space mark after another character, none a line feed, and no character is missing as a symbol."""
        for piece in self.ids:
            if MARK in piece.lstrip(MARK) or (len(piece) > 1 and "\n" in piece):
                raise ValueError(f"piece {piece!r} reaches across a cut")
            if len(piece) > 1 and not all(c in self.ids for c in piece):
                raise ValueError(f"piece {piece!r} is not made of symbols")

    def _prove_whole(self) -> frozenset[str]:
        """The pieces whose own merge ends as one token."""
        pieces = list(self.ids)
        _, lens = self.rules.merge(*self._symbols(pieces))
        return frozenset(p for p, n in zip(pieces, lens.tolist()) if n == 1)

    def _symbols(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The characters of all units as ids, -1 - code point for those outside the vocabulary; and the units' lengths."""
        points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        return self.of_point[points], np.fromiter(map(len, units), np.int64, len(units))

    def count_units(self, units: list[str]) -> list[int]:
        """Tokens of each pre-token by merging; a symbol outside the vocabulary counts its UTF-8 bytes."""
        if not units:
            return []
        symbols, lens = self.rules.merge(*self._symbols(units))
        point = -1 - symbols
        tokens = np.where(symbols >= 0, 1, 1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF))
        return np.add.reduceat(tokens, np.cumsum(lens) - lens).tolist()

    def units(self, text: str) -> Iterator[str]:
        """Pre-tokens of a text: runs of marks with what follows up to the next mark, cut at line feeds."""
        for k, line in enumerate((MARK + text.replace(" ", MARK)).split("\n")):
            if k:
                yield "\n"
            yield from _RUNS.findall(line)

    def count_batch(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text: known pre-tokens at once, the batch's unknown ones in one merge."""
        if self.held > MEMO_BYTES:
            self.memo.clear()
            self.held = 0
        memo, whole = self.memo, self.whole
        cut, fresh = [], set()
        for text in texts:
            if not text:
                cut.append(None)
                continue
            units = self._fast_units(text)
            cut.append(units)
            fresh.update(units)
        fresh = [u for u in fresh if u not in memo]
        self.held += sum(map(getsizeof, fresh)) + 100 * len(fresh)  # with their places in the table
        slow = []
        for u in fresh:
            if u in whole:
                memo[u] = 1
            else:
                slow.append(u)
        memo.update(zip(slow, self.count_units(slow)))
        return [sum(map(memo.__getitem__, units)) if units else 0 for units in cut]

    def _fast_units(self, text: str) -> list[str]:
        """As units(); a text of single spaces, the common case, needs plain splits only."""
        if MARK in text or "  " in text or " \n" in text or text[0] == " " or text[-1] == " ":
            return list(self.units(text))
        out: list[str] = []
        for k, line in enumerate(text.split("\n")):
            if k:
                out.append("\n")
                head, _, line = line.partition(" ") if line[:1] != " " else ("", "", line[1:])
                if head:
                    out.append(head)
                if not line:
                    continue
            elif not line:
                out.append(MARK)
                continue
            out += (MARK + line.replace(" ", " " + MARK)).split(" ")
        return out


@lru_cache(maxsize=4)
def _counter(model_file: str) -> PieceCounter:
    """One per Python worker, kept between tasks."""
    return PieceCounter(model_file)


def count_tokens(docs: DataFrame, model_file: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of `docs` (doc_id, text). See the module for edge cases."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(model_file)
        for batch in batches:
            tokens, sizes = [], []
            for part in in_parts(batch.column("text")):
                tokens += counter.count_batch(part)
                sizes += [len(t.encode()) if t else 0 for t in part]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([t > limit for t in tokens], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )
        give_back()

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
