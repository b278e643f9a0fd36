"""Operator 3: BPE encoding and decoding with batched merge rounds.

A tokenizer file with word-end marks is read; texts are cut at white space into chunks, chunks into pre-tokens by the
file's own pattern, and the pre-tokens that a worker hasn't met are merged together in flat arrays (loomtext.llm.bpe).
White space is dropped by this vocabulary, so the tokens of a text are those of its chunks, one after another.

Defined results: a null or empty text encodes to no ids and decodes to the empty string; the strings of the file's added
tokens inside a text become these tokens, as the library does by default; repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from sys import getsizeof as sizeof
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from loomtext.llm.batches import give_back, in_parts
from loomtext.llm.bpe import PairTable

#: Bytes of chunks and their views that a worker remembers before it starts again.
MEMO_BYTES = 48_000_000
#: Python's split() takes these for white space, the vocabulary's pattern doesn't.
_SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")
_SPACES = regex.compile(r"\s+")


class Shown(NamedTuple):
    """What encode_decode() needs of a chunk of text without white space."""

    n: int
    ids: str
    decoded: str

    def __sizeof__(self) -> int:
        return object.__sizeof__(self) + 24 + sizeof(self.ids) + sizeof(self.decoded)


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the rest in order from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Numbers(dict):
    """Numbers for strings, in the order of first look-up; `fresh` lists the strings that got theirs since it was emptied."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        self.fresh.append(key)
        return n


class WordCodec:
    """Encoder and decoder of one tokenizer file.

    `view` turns the ids of many chunks, behind one another, and the chunks' ends into what is remembered for each.
    """

    def __init__(self, file: str, view: Callable[[WordCodec, np.ndarray, np.ndarray], list]) -> None:
        self.view = view
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        by_id = {i: t for t, i in [*vocab.items(), *self.added.items()]}
        self.tokens = [by_id.get(i, "") for i in range(max(by_id) + 1)]
        self.decimals = list(map(str, range(len(self.tokens))))
        pairs = [(vocab[a], vocab[b], rank, vocab[a + b]) for rank, (a, b) in enumerate(map(tuple, model["merges"]))]
        self.rules = PairTable(pairs)
        letters = byte_letters()
        self.inner = np.asarray([vocab[c] for c in letters], np.int64)
        self.final = np.asarray([vocab[c + self.end] for c in letters], np.int64)
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(split + r"|\n").findall
        self.specials = re.compile("|".join(map(re.escape, self.added))) if self.added else None
        self._forget()

    def _forget(self) -> None:
        self.chunks, self.views, self.held = Numbers(), [], 0

    @staticmethod
    def normal(text: str) -> str:
        """NFC, then each character lowered by itself (no rule for final sigma)."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def _merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pre-tokens and how many each has: its bytes, the last one with the word-end mark, merged in batch."""
        coded = [w.encode() for w in words]
        flat = np.frombuffer(b"".join(coded), np.uint8)
        lens = np.fromiter(map(len, coded), np.int64, len(coded))
        symbols = self.inner[flat]
        last = np.cumsum(lens) - 1
        symbols[last] = self.final[flat[last]]
        return self.rules.merge(symbols, lens)

    def _encoded(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks behind one another, and each chunk's end. A chunk that begins with a line feed is an added token."""
        numbers = Numbers()
        numbers["\n"] = 0
        where = {k: c[1:] for k, c in enumerate(chunks) if c[0] == "\n"}
        plain = ["" if k in where else c for k, c in enumerate(chunks)] if where else chunks
        row = np.fromiter(map(numbers.__getitem__, self.words("\n".join(plain))), np.int64)
        ids, many = self._merged(numbers.fresh)
        start = np.concatenate([[0, 0], np.cumsum(many)])
        many = np.concatenate([[0], many])
        chunk = np.cumsum(row == 0)  # line feeds so far
        lens = many[row]
        flat = ids[np.arange(lens.sum()) + np.repeat(start[row] - (np.cumsum(lens) - lens), lens)]
        ends = np.cumsum(np.bincount(chunk, weights=lens, minlength=len(chunks)).astype(np.int64))
        for k in sorted(where, reverse=True):
            flat = np.insert(flat, ends[k], self.added[where[k]])
            ends[k:] += 1
        return flat, ends

    def decode(self, ids: list[int] | tuple[int, ...]) -> str:
        """The tokens' strings with a space between them: the file names no decoder."""
        return " ".join(map(self.tokens.__getitem__, ids))

    def cut(self, text: str) -> list[str]:
        """Chunks of a text without added tokens in it."""
        text = self.normal(text)
        if any(c in text for c in _SEPARATORS):
            return [c for c in _SPACES.split(text) if c]
        return text.split()

    def encode_chunks(self, texts: list[str | None]) -> list[list[Any]]:
        """Views of each text's chunks; those not remembered are merged in one batch."""
        if self.held > MEMO_BYTES:
            self._forget()
        number = self.chunks.__getitem__
        rows: list[list[int]] = []
        for text in texts:
            if not text:
                rows.append([])
            elif self.specials and "<|" in text and self.specials.search(text):
                row, at = [], 0
                for m in self.specials.finditer(text):
                    row += [*self.cut(text[at : m.start()]), f"\n{m[0]}"]
                    at = m.end()
                rows.append(list(map(number, row + self.cut(text[at:]))))
            else:
                rows.append(list(map(number, self.cut(text))))
        if self.chunks.fresh:
            made = self.view(self, *self._encoded(self.chunks.fresh))
            self.views += made
            self.held += sum(map(sizeof, self.chunks.fresh)) + sum(map(sizeof, made)) + 120 * len(made)  # with places in list and table
            self.chunks.fresh = []
        get = self.views.__getitem__
        return [list(map(get, row)) for row in rows]


def shown(own: WordCodec, ids: np.ndarray, ends: np.ndarray) -> list[Shown]:
    """The decimal ids and the decoded tokens, each joined by one space."""
    ids, ends = ids.tolist(), ends.tolist()
    decimals, tokens = [own.decimals[i] for i in ids], [own.tokens[i] for i in ids]
    return [Shown(b - a, " ".join(decimals[a:b]), " ".join(tokens[a:b])) for a, b in zip([0, *ends], ends)]


def packed(_: WordCodec, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """Little-endian unsigned 32-bit ids."""
    data, at = ids.astype("<u4").tobytes(), (4 * ends).tolist()
    return [data[a:b] for a, b in zip([0, *at], at)]


@lru_cache(maxsize=4)
def codec(file: str, view: Callable[[WordCodec, np.ndarray, np.ndarray], list]) -> WordCodec:
    """One per Python worker and view, kept between tasks."""
    return WordCodec(file, view)


def encode_decode(docs: DataFrame, file: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of `docs` (doc_id, text).

    The first digest is of the decimal ids joined by one space, the second of the decoded text in UTF-8.
    keep_ids adds `ids` array<int> and `decoded` string.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(file, shown)
        for batch in batches:
            many, of_ids, of_text, ids, decoded = [], [], [], [], []
            for part in in_parts(batch.column("text")):
                for row in own.encode_chunks(part):
                    many.append(sum([c.n for c in row]))
                    of_ids.append(hashlib.sha256(" ".join([c.ids for c in row]).encode()).hexdigest())
                    text = " ".join([c.decoded for c in row])
                    of_text.append(hashlib.sha256(text.encode()).hexdigest())
                    if keep_ids:
                        ids.append([int(i) for c in row for i in c.ids.split()])
                        decoded.append(text)
            columns = [batch.column("doc_id"), pa.array(many, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns += [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names=names)
        give_back()

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(run, schema)
