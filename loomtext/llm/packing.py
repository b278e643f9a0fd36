"""Operator 8: best-fit packing of token sequences in bounded space.

Documents become ids and an end id; only those longer than a sequence are cut. Their pieces stream through packers that
hold a fixed number of open sequences, listed in a bitset by free space: a piece goes where the least space is left over,
and when it fits nowhere and no place is free, the fullest open sequence closes.

Streams run side by side, one for each partition. What they leave open at their end streams on into fewer packers, until
one packer has the rest, so that the space lost doesn't grow with the number of partitions. Only lengths are shuffled.

Defined results: a null or empty text is the end id alone; repeated rows are packed as often as they come; no documents
make no sequences; a null doc_id stays null. Rows are sorted within a stream, so a repeated task packs alike.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from loomtext.llm.batches import give_back, in_parts
from loomtext.llm.scratch import materialise
from loomtext.llm.word_bpe import codec, packed

#: Open sequences of a packer.
OPEN = 256
#: Streams whose open sequences meet in one stream of the next pass.
FAN_IN = 16

_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


class BestFit:
    """One packer. Items are (length, payload); closed bins are lists of (payload, offset)."""

    def __init__(self, size: int, places: int) -> None:
        self.size, self.places = size, places
        self.free_bits = 0  # bit f: some open bin has f free
        self.by_free: dict[int, list[list]] = {}
        self.open = 0

    def _put(self, bin_: list, free: int) -> None:
        self.by_free.setdefault(free, []).append(bin_)
        self.free_bits |= 1 << free

    def _take(self, free: int) -> list:
        bins = self.by_free[free]
        bin_ = bins.pop(0)
        if not bins:
            del self.by_free[free]
            self.free_bits ^= 1 << free
        return bin_

    def add(self, length: int, payload: object) -> list[list]:
        """Place one item; returns the bins that this closes."""
        closed = []
        fits = self.free_bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_ = self._take(free)
        else:
            if self.open == self.places:
                fullest = (self.free_bits & -self.free_bits).bit_length() - 1
                closed.append(self._take(fullest))
                self.open -= 1
            free, bin_ = self.size, []
            self.open += 1
        bin_.append((payload, self.size - free))
        if free == length:
            closed.append(bin_)
            self.open -= 1
        else:
            self._put(bin_, free - length)
        return closed

    def rest(self) -> list[list]:
        """The open bins, fullest first."""
        return [b for f in sorted(self.by_free) for b in self.by_free[f]]


def cut_pieces(docs: DataFrame, file: str, size: int, end_id: int, keep_ids: bool = False) -> DataFrame:
    """Pieces of at most `size` tokens of each row of `docs` (doc_id, text), without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(file, packed)
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            doc_ids, seen = batch.column("doc_id").to_pylist(), 0
            rows: list[tuple] = []
            for part in in_parts(batch.column("text")):
                encoded = zip(doc_ids[seen : seen + len(part)], own.encode_chunks(part), strict=True)
                seen += len(part)
                for doc_id, chunks in encoded:
                    ids = b"".join(chunks) + end
                    for piece, at in enumerate(range(0, len(ids), 4 * size)):
                        own_ids = ids[at : at + 4 * size]
                        rows.append((doc_id, piece, at // 4, len(own_ids) // 4, zlib.crc32(own_ids), *[own_ids] * keep_ids))
            columns = list(zip(*rows)) or [[]] * (5 + keep_ids)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            if keep_ids:
                arrays.append(pa.array([memoryview(x).cast("I").tolist() for x in columns[5]], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids])
        give_back()

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(run, _PIECE + ", ids array<int>" * keep_ids)


def _pack_pass(pieces: DataFrame, streams: int, level: int, size: int, places: int, last: bool) -> DataFrame:
    """Pack pieces in `streams` packers; `done` is false for what the packer had open at its end."""
    names = [f.strip().split(" ")[0] for f in _PIECE.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, number = BestFit(size, places), 0
        base = (level << 56) + (TaskContext.get().partitionId() << 32)

        def told(bins: list[list], done: bool) -> pa.RecordBatch:
            nonlocal number
            rows = []
            for bin_ in bins:
                rows += [(*payload, base + number, offset, done) for payload, offset in bin_]
                number += 1
            columns = list(zip(*rows)) or [[]] * 8
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[*names, "sequence_id", "offset", "done"])

        for batch in batches:
            closed = []
            for row in zip(*(batch.column(n).to_pylist() for n in names)):
                closed += packer.add(row[3], row)
            yield told(closed, True)
        yield told(packer.rest(), last)

    dealt = pieces.select(*names).repartition(streams, F.xxhash64(*names)) if streams > 1 else pieces.select(*names).coalesce(1)
    ordered = dealt.sortWithinPartitions(F.xxhash64("doc_id", "piece"), *names)
    return ordered.mapInArrow(run, f"{_PIECE}, sequence_id long, offset long, done boolean")


def pack_pieces(pieces: DataFrame, size: int, places: int = OPEN, streams: int | None = None) -> DataFrame:
    """Place pieces (doc_id, piece, start, length, ids_crc32) into sequences: adds sequence_id and offset."""
    spark = pieces.sparkSession
    streams = streams or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    level, packed_rows, waiting = 0, None, pieces
    while True:
        last = streams == 1
        table = materialise(_pack_pass(waiting, streams, level, size, places, last), f"pack{level}")
        done = table.where("done").drop("done")
        packed_rows = done if packed_rows is None else packed_rows.unionAll(done)
        if last:
            return packed_rows
        waiting = table.where("not done")
        level, streams = level + 1, -(-streams // FAN_IN)


def pack_documents(docs: DataFrame, file: str, size: int = 4096, end_id: int = 1, places: int = OPEN) -> DataFrame:
    """Tokenize and pack `docs` (doc_id, text): a row per piece with its sequence and place."""
    return pack_pieces(cut_pieces(docs, file, size, end_id), size, places)


def sequences(packed_rows: DataFrame, pieces: DataFrame) -> DataFrame:
    """sequence_id, ids: the packed sequences' tokens. `pieces` is cut_pieces(..., keep_ids=True) of the same documents.

    Repeated rows have the same ids, so one of them gives those of all; a null doc_id meets a null one; no rows give none.
    """
    key = ["doc_id", "piece", "length", "ids_crc32"]
    ids = pieces.select(*key, "ids").dropDuplicates(key)
    matched = packed_rows.alias("p").join(ids.alias("i"), [F.col(f"p.{k}").eqNullSafe(F.col(f"i.{k}")) for k in key])
    placed = matched.groupBy("p.sequence_id").agg(F.array_sort(F.collect_list(F.struct("p.offset", "i.ids"))).alias("parts"))
    return placed.select("sequence_id", F.flatten(F.transform("parts", lambda x: x["ids"])).alias("ids"))
