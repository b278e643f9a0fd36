"""Operator 10: near copies by SimHash, joined in a segment-popcount embedding.

A fingerprint's 64 bits form 32 segments of two; the embedding is the vector of their bit counts, whose Manhattan distance
never exceeds the fingerprints' number of differing bits. Counts are kept in unary (1 is 01, 2 is 11), so that the
Manhattan distance of two vectors is the number of differing bits of their codes.

The range join: four segments form one of 8 coordinates of a grid. Vectors within distance 4 agree in at least 4 of the 8
coordinates, so every pair meets in a cell of one of the 70 grids over 4 coordinates. A cell that is too full is divided by
70 finer grids over the segments that it leaves open, and again, until it holds 28 of the 32 segments. In a cell, pairs
beyond the Manhattan bound go first, the rest is verified on the fingerprints; a cell reports links that connect what is
linked in it, not all pairs. Equal fingerprints are one node from the start, so copies make no pairs.

Defined results: texts without a word have fingerprint zero and are linked like any other; fewer words than a shingle
make one shingle; a null text has no words; repeated rows share a component; a null doc_id counts for nothing in
component_id, which is null where a component has no doc_id at all.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from loomtext.llm.batches import give_back, in_parts
from loomtext.llm.components import connected_components
from loomtext.llm.names import unused
from loomtext.llm.scratch import materialise, passing

_LOW = 0x5555555555555555
_COORDINATES = 8
_SPACE = re.compile(rb"[ \t-\r]")
#: Bytes of a long text that are cut into shingles at once.
PIECE = 500_000
#: Fingerprints of a cell that are compared with each other; a fuller cell is divided.
FULL = 16_384


def shingle_hashes(text: str | None, width: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of each shingle of a text, A-Z lowered, repeats included; of a long text in several arrays."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    digest, words, at, whole = xxhash.xxh64_intdigest, [], 0, True
    while at < len(data):
        gap = _SPACE.search(data, at + PIECE) if len(data) - at > PIECE else None
        cut = gap.start() if gap else len(data)
        words += data[at:cut].split()
        at = cut
        if len(words) > width or (at == len(data) and words and (whole or len(words) == width)):
            joined = b" ".join(words)
            ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
            starts = [0, *(e + 1 for e in ends[: max(0, len(words) - width)])]
            found = [digest(joined[a:b], seed) for a, b in zip(starts, ends[min(width, len(words)) - 1 :])]
            words, whole = words[len(words) - width + 1 :] if width > 1 else [], False
            yield np.fromiter(found, np.uint64, len(found))


def _ones(flat: np.ndarray, starts: np.ndarray, bit: int) -> np.ndarray:
    """How many hashes of each run have the bit."""
    return np.add.reduceat(((flat >> np.uint64(bit)) & np.uint64(1)).astype(np.uint32), starts).astype(np.int64)


def voted(texts: Iterable[Iterable[np.ndarray]]) -> np.ndarray:
    """A 64-bit fingerprint for each text, given as its arrays of hashes: bits that are set in over half of them.

    One bit of all hashes is counted at a time, which holds a few bytes for each shingle; a long text's arrays are added up.
    """
    runs, owner, counted, n = [], [], [], 0

    def count() -> None:
        if runs:
            lens = np.asarray([len(r) for r in runs], np.int64)
            flat, starts = np.concatenate(runs), np.cumsum(lens) - lens
            counted.append((np.asarray(owner), lens, np.stack([_ones(flat, starts, bit) for bit in range(64)], axis=1)))
            runs.clear()
            owner.clear()

    for text in texts:
        for run in text:
            runs.append(run)
            owner.append(n)
            if len(run) >= PIECE // 16:
                count()
        n += 1
    count()
    votes, many = np.zeros((n, 64), np.int64), np.zeros(n, np.int64)
    for own, lens, ones in counted:
        np.add.at(votes, own, ones)
        np.add.at(many, own, lens)
    on = (2 * votes > many[:, None]).astype(np.uint8)
    return np.packbits(on, axis=1, bitorder="little").reshape(-1).view("<u8").astype(np.uint64)


def fingerprints(texts: list[str | None], width: int, seed: int) -> np.ndarray:
    """A 64-bit fingerprint for each text."""
    return voted(shingle_hashes(t, width, seed) for t in texts)


def fingerprint_rows(docs: DataFrame, width: int, seed: int) -> DataFrame:
    """doc_id, text_hash, fp (the fingerprint as a signed long) for each row of `docs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [fingerprints(p, width, seed) for p in in_parts(batch.column("text"))]
            fp = np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(fp)], names=["doc_id", "text_hash", "fp"])
        give_back()

    text = docs["text"].cast("string")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


def unary_counts(fp: Column) -> Column:
    """The embedding: bit counts of the 32 segments, two unary bits each."""
    up = F.shiftrightunsigned(fp, 1)
    some, both = fp.bitwiseOR(up).bitwiseAND(F.lit(_LOW)), fp.bitwiseAND(up).bitwiseAND(F.lit(_LOW))
    return some.bitwiseOR(F.shiftleft(both, 1))


def _unary(fp: np.ndarray) -> np.ndarray:
    up, low = fp >> np.uint64(1), np.uint64(_LOW)
    return ((fp | up) & low) | ((fp & up & low) << np.uint64(1))


@lru_cache(maxsize=100_000)
def finer(mask: int, distance: int) -> tuple[int, ...]:
    """Masks that hold what `mask` holds and more, as unsigned numbers; none where too few segments are left to divide.

    The segments beyond the mask are dealt to 8 coordinates, so vectors that agree on the mask and are within `distance`
    agree on all but `distance` of them, too.
    """
    loose = [k for k in range(32) if not mask >> 2 * k & 3]
    if len(loose) < _COORDINATES:
        return ()
    parts = [sum(3 << 2 * int(k) for k in part) for part in np.array_split(loose, _COORDINATES)]
    return tuple(mask | sum(held) for held in combinations(parts, _COORDINATES - distance))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def cell_links(fp: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that connect whatever is linked among the fingerprints of one cell: fewer than there are fingerprints."""
    code, label, links = _unary(fp), np.arange(len(fp)), []
    for i in range(1, len(fp)):
        near = np.flatnonzero(np.bitwise_count(code[:i] ^ code[i]) <= distance)
        near = near[np.bitwise_count(fp[near] ^ fp[i]) <= distance]
        if not len(near):
            continue
        found, first = np.unique(label[near], return_index=True)
        links += [(i, int(near[k])) for k in first]
        if len(found) > 1:
            label[np.isin(label[:i], found[1:]).nonzero()[0]] = found[0]
        label[i] = found[0]
    return links


def _pass(rows: DataFrame, distance: int, full: int) -> DataFrame:
    """Compare the cells of `rows` (mask, fp): (mask 0, a, b) is a link, (mask, a, a) a fingerprint of a divided cell's part."""

    def emptied(mask: int, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        masks = np.asarray(finer(mask, distance), np.uint64)
        for start in range(0, len(fp), 1024):
            own = np.repeat(fp[start : start + 1024], len(masks))
            yield told(np.tile(masks, len(own) // len(masks)), own, own)

    def told(mask: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (mask, a, b)], names=["mask", "a", "b"])

    def compared(mask: np.ndarray, fp: np.ndarray, first: np.ndarray, many: np.ndarray) -> Iterator[pa.RecordBatch]:
        two = first[many == 2]
        x, y = fp[two], fp[two + 1]
        near = np.bitwise_count(_unary(x) ^ _unary(y)) <= distance
        x, y = x[near], y[near]
        near = np.bitwise_count(x ^ y) <= distance
        a, b = [x[near]], [y[near]]
        for start, n in zip(first[many > 2].tolist(), many[many > 2].tolist()):
            own = fp[start : start + n]
            if n > full and finer(int(mask[start]), distance):
                yield from emptied(int(mask[start]), own)
                continue
            found = np.asarray(cell_links(own, distance), np.int64).reshape(-1, 2)
            a.append(own[found[:, 0]])
            b.append(own[found[:, 1]])
        a, b = np.concatenate(a), np.concatenate(b)
        yield told(np.zeros(len(a), np.uint64), a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.uint64)
        held = (none, none)  # of a cell that may go on in the next batch
        divided = None  # (mask, cell) that is too full to be held
        for batch in batches:
            mask, fp = (np.concatenate([h, c.to_numpy(zero_copy_only=False).view(np.uint64)]) for h, c in zip(held, batch.columns))
            cell = _unary(fp) & mask
            if divided is not None:
                goes_on = np.logical_and.accumulate((mask == divided[0]) & (cell == divided[1]))
                more = int(goes_on.sum())
                yield from emptied(int(divided[0]), fp[:more])
                mask, fp, cell = mask[more:], fp[more:], cell[more:]
            if not len(fp):
                held = (none, none)
                continue
            first = np.concatenate([[0], np.flatnonzero((mask[1:] != mask[:-1]) | (cell[1:] != cell[:-1])) + 1])
            last = int(first[-1])
            yield from compared(mask[:last], fp[:last], first[:-1], np.diff(first))
            divided, held = None, (mask[last:], fp[last:])
            if len(held[1]) > full and finer(int(mask[last]), distance):
                divided, held = (mask[last], cell[last]), (none, none)
                yield from emptied(int(mask[last]), fp[last:])
        if len(held[1]):
            yield from compared(*held, np.zeros(1, np.int64), np.asarray([len(held[1])]))
        give_back()

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cell = unary_counts(F.col("fp")).bitwiseAND(F.col("mask"))
    dealt = rows.select("mask", "fp").repartition(n, F.col("mask"), cell)
    return dealt.sortWithinPartitions("mask", cell, "fp").mapInArrow(run, "mask long, a long, b long")


def near_links(nodes: DataFrame, distance: int, full: int = FULL) -> DataFrame:
    """(a, b): links among distinct fingerprints `nodes` (fp) that connect all that differ by at most `distance` bits.

    A cell with more than `full` fingerprints is divided by grids over the segments that it doesn't hold, 8, 16 and 24 of
    them at last: what is within `distance` meets in a part, too.
    """
    masks = F.array(*[F.lit(_signed(m)) for m in finer(0, distance)])
    rows, found = nodes.select("fp", F.explode(masks).alias("mask")), None
    while True:
        made = materialise(_pass(rows, distance, full), "cells")
        links = made.where("mask = 0").select("a", "b")
        found = links if found is None else found.unionAll(links)
        parts = made.where("mask <> 0").select("mask", F.col("a").alias("fp"))
        if parts.isEmpty():
            return found
        rows = parts.distinct()  # parts of different cells may be the same


def near_components(nodes: DataFrame, distance: int = 4) -> DataFrame:
    """(fp, root) for each row of `nodes` (fp, distinct, and node, an ordered name for it): root is the least node reachable."""
    links = near_links(nodes.select("fp"), distance)
    for end in "ab":
        links = links.join(nodes.select(F.col("fp").alias(end), F.col("node").alias(f"node_{end}")), end)
    roots = connected_components(links.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")))
    return nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("root"))


def named_prints(prints: DataFrame) -> DataFrame:
    """(fp, node): each fingerprint of `prints` (doc_id, fp) with its name: no doc_id at all, the least doc_id, the fingerprint.

    The least name of a component so tells its least doc_id, and nothing is joined by component, of which one may be large.
    """
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    return materialise(first.select("fp", F.struct(F.col("first").isNull().alias("none"), "first", "fp").alias("node")), "fingerprints")


def near_copies(docs: DataFrame, width: int = 4, seed: int = 42, distance: int = 4) -> DataFrame:
    """doc_id, fingerprint, component_id for each row of `docs` (doc_id, text). See the module for edge cases."""
    with passing() as tables:
        prints = materialise(fingerprint_rows(docs, width, seed), "prints")
        roots = near_components(named_prints(prints), distance)
        named = materialise(roots.select("fp", F.col("root.first").alias("component_id")), "classes")
        tables += [prints, named]
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def least_rows(docs: DataFrame, prints: DataFrame, rooted: DataFrame) -> DataFrame:
    """(id, hash, many) of the row with the least doc_id of each root, under names that `docs` hasn't; many if it is repeated.

    `prints` (doc_id, text_hash) are all rows, `rooted` has their root.
    """
    own = unused(docs)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    kept = rooted.groupBy("root").agg(F.min(order).alias("row")).select(F.col("row.doc_id").alias(f"{own}id"), F.col("row.text_hash").alias(f"{own}hash"))
    many = prints.groupBy("doc_id", "text_hash").count().where("count > 1").select(F.col("doc_id").alias("i"), F.col("text_hash").alias("h"))
    kept = kept.join(many, F.col(f"{own}id").eqNullSafe(F.col("i")) & (F.col(f"{own}hash") == F.col("h")), "left")
    return materialise(kept.select(f"{own}id", f"{own}hash", F.col("h").isNotNull().alias(f"{own}many")), "kept")


def rows_kept(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of `docs` that least_rows() names, of equal rows any one; all columns as they are."""
    at, mark, many = kept.columns
    held = docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept[at]) & (F.xxhash64(docs["text"].cast("string")) == kept[mark]))
    columns = [docs[c] for c in docs.columns]
    once = held.where(~F.col(many)).select(*columns)
    return once.unionAll(held.where(F.col(many)).dropDuplicates([at, mark]).select(*columns))


def drop_near_copies(docs: DataFrame, width: int = 4, seed: int = 42, distance: int = 4) -> DataFrame:
    """One row of `docs` for each component: the one with the least doc_id (null last), of equal rows any one.

    All columns of `docs` are kept as they are.
    """
    with passing() as tables:
        prints = materialise(fingerprint_rows(docs, width, seed), "prints")
        kept = least_rows(docs, prints, prints.join(near_components(named_prints(prints), distance), "fp"))
        tables.append(kept)
    return rows_kept(docs, kept)
