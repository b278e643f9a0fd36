"""Near copies of a pipeline: texts whose five-word shingles have a Jaccard likeness of 0.8 or more.

Candidates come from two joins. The first is operator 10's: SimHash fingerprints of the five-word shingles that differ in
DISTANCE bits or less, by its grids. Fingerprints of texts as alike as 0.8 may differ in 5 to 20 of 64 bits, where such
grids no longer tell texts apart; so each text has BANDS keys of ROWS min-hashes over its set of shingles, too. Texts of
likeness 0.8 share a key unless all bands differ, which has a chance of (1 - 0.8^ROWS)^BANDS, 3 in a million, whatever
their length. Candidates are held against each other on the shingles themselves, so none is linked that is less alike.

Texts with a common passage may share a key, too, and be many. What shares a key but isn't linked to the key's least text
is compared on signatures first, one byte of each of the 96 min-hashes, inside a task: only pairs that agree on AGREE of
them or more leave it. At a likeness of 0.8, 77 agree on average with a deviation of 3.9, so 1 pair in 50,000 is lost. A
key with more than FULL such texts is divided by SPLITS keys of 8 further min-hashes each, again with a loss of about 1 in
100,000, and again as often as need be.

Defined results: case of A-Z doesn't count; fewer words than a shingle make one; texts without a word are copies of each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from loomtext.llm.batches import give_back, in_parts, small_batches
from loomtext.llm.likeness import cell_links, like_components
from loomtext.llm.scratch import materialise, passing
from loomtext.llm.simhash import least_rows, near_links, rows_kept, shingle_hashes, voted

WIDTH, BANDS, ROWS = 5, 24, 4
_R = np.random.default_rng(42)
_MASK = _R.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
_TIMES = _R.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Bits that fingerprints of operator 10 may differ in, and characters that are cut into shingles at once.
DISTANCE, CHARS = 4, 200_000
#: Bytes of signatures that agree at least; texts of a key compared at once; keys that a fuller one is divided by, how deep.
AGREE, FULL, SPLITS, DEPTH = 60, 4096, 64, 3
#: Texts of a key in one of the two blocks of a cell: what a task holds the shingles of.
BLOCK = 512
_CHOICES = [[_R.choice(BANDS * ROWS, 8, replace=False) for _ in range(SPLITS)] for _ in range(DEPTH)]


def _set_of(hashes: list[np.ndarray]) -> np.ndarray:
    """The distinct hashes, sorted."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes]))


def band_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """BANDS keys and a signature of BANDS * ROWS bytes for each set that isn't empty; those of an empty one mean nothing."""
    lens = np.asarray([len(s) for s in sets], np.int64)
    out, signs = np.zeros((len(sets), BANDS), np.uint64), np.zeros((len(sets), BANDS * ROWS), np.uint8)
    some = np.flatnonzero(lens)
    if len(some):
        flat, starts = np.concatenate(sets), (np.cumsum(lens) - lens)[some]
        for band in range(BANDS):
            key = np.full(len(some), band, np.uint64)
            for k in range(band * ROWS, (band + 1) * ROWS):
                least = np.minimum.reduceat((flat ^ _MASK[k]) * _TIMES[k], starts)
                signs[some, k] = (least * _MIX) >> np.uint64(56)
                key = (key ^ least) * _MIX
                key ^= key >> np.uint64(31)
            out[some, band] = key
    return out, signs


def _digest(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes())


def printed(docs: DataFrame, width: int, seed: int) -> DataFrame:
    """doc_id, text_hash, bits (the SimHash fingerprint), fp (a hash of the shingle set), keys and sign (null without a word) for each row of `docs`."""
    names = ["doc_id", "text_hash", "bits", "fp", "keys", "sign"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits, fps, keys, signs = [], [], [], []
            for part in in_parts(batch.column("text"), CHARS):
                hashes = [list(shingle_hashes(t, width, seed)) for t in part]
                bits.append(voted(hashes))
                sets = [_set_of(h) for h in hashes]
                fps += map(_digest, sets)
                bands, signed = band_keys(sets)
                keys += [k if len(s) else None for k, s in zip(bands.view(np.int64), sets)]
                signs += [g.tobytes() if len(s) else None for g, s in zip(signed, sets)]
            bits = np.concatenate([np.zeros(0, np.uint64), *bits]).view(np.int64)
            columns = [batch.column("doc_id"), batch.column("text_hash"), pa.array(bits), pa.array(np.asarray(fps, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64())), pa.array(signs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=names)
        give_back()

    text = docs["text"].cast("string")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, bits long, fp long, keys array<long>, sign binary")


def _with_items(texts: DataFrame, width: int, seed: int) -> DataFrame:
    """(node, items): the shingle set of each row of `texts` (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in in_parts(batch.column("text"), CHARS):
                items = pa.array([_set_of(list(shingle_hashes(t, width, seed))).view(np.int64) for t in part], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(at, len(part)), items], names=["node", "items"])
                at += len(part)
        give_back()

    return texts.mapInArrow(run, "node long, items array<long>")


def candidate_keys(nodes: DataFrame) -> DataFrame:
    """(key, node): what may be alike shares a key. `nodes` has fp, bits and keys.

    Keys are the min-hash bands, the fingerprint, and each link between fingerprints that operator 10 finds.
    """
    bands = nodes.select(F.explode("keys").alias("key"), F.col("fp").alias("node"))
    same = nodes.select(F.xxhash64("bits", F.lit("bits")).alias("key"), F.col("fp").alias("node"))
    links = near_links(nodes.select(F.col("bits").alias("fp")).distinct(), DISTANCE).select(F.xxhash64("a", "b").alias("key"), F.explode(F.array("a", "b")).alias("bits"))
    linked = links.join(nodes.select("bits", F.col("fp").alias("node")), "bits").select("key", "node")
    return bands.unionAll(same).unionAll(linked)


def _cells(node: np.ndarray, a: np.ndarray, b: np.ndarray, block: int) -> Iterator[np.ndarray]:
    """Places of `node` in cells of up to two blocks, so that each pair of places (a, b) has a cell for both."""
    used, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    of_a, of_b = flat[: len(a)] // block, flat[len(a) :] // block
    told = np.minimum(of_a, of_b) * (len(used) // block + 1) + np.maximum(of_a, of_b)
    for cell in np.unique(told).tolist():
        own = np.unique(np.concatenate([a[told == cell], b[told == cell]]))
        yield own[np.argsort(node[own])]


def _agreeing(sign: np.ndarray, i: int, near: np.ndarray) -> np.ndarray:
    return near[(sign[near] == sign[i]).sum(axis=1) >= AGREE]


def _signed_pass(rows: DataFrame, level: int, full: int, block: int | None = None) -> DataFrame:
    """(a, b, key, root, sign) from rows (key, node, root, sign): pairs of a key that may be alike, key null; or, with b
    null, a node a of a key that is too full, under one of its next keys.

    With `block` cells stand for pairs: a is a node, b its cell, which has the same number in every key with the same nodes.
    """
    names = ["a", "b", "key", "root", "sign"]

    def divided(key: int, node: np.ndarray, root: np.ndarray, sign: np.ndarray) -> Iterator[pa.RecordBatch]:
        for start in range(0, len(node), 256):
            own = slice(start, start + 256)
            n = len(node[own])
            told = [xxhash.xxh64_intdigest(sign[k, chosen].tobytes(), (key + i) & 0xFFFFFFFF) for k in range(*own.indices(len(node))) for i, chosen in enumerate(_CHOICES[level])]
            texts = [s.tobytes() for s in np.repeat(sign[own], SPLITS, axis=0)]
            columns = [pa.array(np.repeat(node[own], SPLITS)), pa.nulls(n * SPLITS, pa.int64()), pa.array(np.asarray(told, np.uint64).view(np.int64)), pa.array(np.repeat(root[own], SPLITS)), pa.array(texts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    def compared(key: int, node: np.ndarray, root: np.ndarray, sign: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(node) > full and level < DEPTH:
            yield from divided(key, node, root, sign)
            return
        a, b = [], []
        for i in range(1, len(node)):
            near = _agreeing(sign, i, np.flatnonzero(root[:i] != root[i]))
            a.append(np.full(len(near), i))
            b.append(near)
        if not sum(map(len, a)):
            return
        a, b = np.concatenate(a), np.concatenate(b)
        if not block:
            a, b = np.maximum(node[a], node[b]), np.minimum(node[a], node[b])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *[pa.nulls(len(a), t) for t in (pa.int64(), pa.int64(), pa.binary())]], names=names)
            return
        for own in _cells(node, a, b, block):
            n, cell = len(own), np.asarray([_digest(node[own])], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(np.repeat(cell, n)), pa.nulls(n, pa.int64()), pa.array(root[own]), pa.nulls(n, pa.binary())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # parts of the key that may go on in the next batch
        spilled = None  # a key that is too full to be held

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                yield from compared(held[0][0], *(np.concatenate([h[k] for h in held]) for k in (1, 2, 3)))
                held.clear()

        for batch in batches:
            key, node, root = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "node", "root"))
            sign = np.frombuffer(b"".join(batch.column("sign").to_pylist()), np.uint8).reshape(len(key), -1)
            turns = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]]) if len(key) else np.zeros(1, np.int64)
            for start, end in zip(turns[:-1].tolist(), turns[1:].tolist()):
                own, part = int(key[start]), (node[start:end], root[start:end], sign[start:end])
                if own == spilled:
                    yield from divided(own, *part)
                    continue
                if held and held[0][0] != own:
                    yield from flush()
                spilled = None
                held.append((own, *part))
                if sum(len(h[1]) for h in held) > full and level < DEPTH:
                    yield from flush()
                    spilled = own
        yield from flush()
        give_back()

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("key", "node", "root", "sign").repartition(n, "key").sortWithinPartitions("key", "node")
    return dealt.mapInArrow(run, "a long, b long, key long, root long, sign binary")


def _signed(open_keys: DataFrame, signs: DataFrame, full: int, block: int | None) -> DataFrame:
    """What all passes over `open_keys` (key, node, root) and `signs` (node, sign) find, until no key is too full."""
    rows, found, level = open_keys.join(signs, "node"), None, 0
    while True:
        with small_batches(rows.sparkSession):
            made = materialise(_signed_pass(rows, level, full, block), f"compared{level}")
        told = made.where("b is not null").select("a", "b", "root")
        found = told if found is None else found.unionAll(told)
        parts = made.where("b is null")
        if parts.isEmpty():
            return found
        rows, level = parts.select("key", F.col("a").alias("node"), "root", "sign").distinct(), level + 1


def signed_pairs(open_keys: DataFrame, signs: DataFrame, full: int = FULL) -> DataFrame:
    """Pairs (a, b) of nodes that share a key of `open_keys` (key, node, root), have different roots and like `signs` (node, sign)."""
    return _signed(open_keys, signs, full, None).select("a", "b").distinct()


def signed_links(open_keys: DataFrame, sets: DataFrame, signs: DataFrame, full: int = FULL, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect what signed_pairs() would find and `sets` (node, items) shows to be alike."""

    def told(held: list[tuple]) -> pa.RecordBatch:
        node, root, sign = (np.concatenate([h[k] for h in held]) for k in (1, 2, 3))
        items = [x for h in held for x in h[4]]
        links = np.asarray(cell_links(lambda i: _agreeing(sign, i, np.arange(i)), root, items), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(node[links[:, 0]]), pa.array(node[links[:, 1]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # parts of the cell that may go on in the next batch
        for batch in batches:
            cell, node, root = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "node", "root"))
            sign = np.frombuffer(b"".join(batch.column("sign").to_pylist()), np.uint8).reshape(len(cell), -1)
            turns = np.concatenate([[0], np.flatnonzero(cell[1:] != cell[:-1]) + 1, [len(cell)]]) if len(cell) else np.zeros(1, np.int64)
            for start, end in zip(turns[:-1].tolist(), turns[1:].tolist()):
                items = [np.array(x.values, np.int64) for x in batch.column("items").slice(start, end - start)]
                if held and held[0][0] != cell[start]:
                    yield told(held)
                    held.clear()
                held.append((cell[start], node[start:end], root[start:end], sign[start:end], items))
        if held:
            yield told(held)
        give_back()

    n = int(open_keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = _signed(open_keys, signs, full, block).select(F.col("b").alias("cell"), F.col("a").alias("node"), "root").distinct()
    dealt = cells.join(signs, "node").join(sets, "node").select("cell", "node", "root", "sign", "items").repartition(n, "cell").sortWithinPartitions("cell", "node")
    with small_batches(open_keys.sparkSession):
        return materialise(dealt.mapInArrow(run, "a long, b long"), "linked")


def similar_components(docs: DataFrame, prints: DataFrame, width: int, seed: int) -> DataFrame:
    """(fp, root) for each distinct shingle set of `prints`: what is alike, directly or over others, has one root."""
    first = F.min_by(F.struct("doc_id", "text_hash", "bits", "keys", "sign"), F.struct("doc_id", "text_hash"))
    nodes = materialise(prints.groupBy("fp").agg(first.alias("row")).select("fp", "row.*"), "nodes")
    keys = materialise(candidate_keys(nodes), "candidates")
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    keys = materialise(keys.join(shared, "key").select("key", "node"), "shared")
    asked = nodes.join(keys.select(F.col("node").alias("fp")).distinct(), "fp").select(F.col("fp").alias("node"), F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
    text = docs["text"].cast("string")
    texts = docs.select(docs["doc_id"].cast("long").alias("own_id"), F.xxhash64(text).alias("own_hash"), text.alias("text"))
    held = texts.join(asked, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_hash") == F.col("hash"))).select("node", "text")
    with small_batches(docs.sparkSession):
        sets = materialise(_with_items(held.dropDuplicates(["node"]), width, seed), "sets")
    signs = nodes.where("sign is not null").select(F.col("fp").alias("node"), "sign")
    roots = like_components(keys, sets, lambda open_keys, of: signed_links(open_keys, of, signs))
    return nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def drop_similar(docs: DataFrame, width: int = WIDTH, seed: int = 42) -> DataFrame:
    """One row of `docs` for each component of like texts: the one with the least doc_id (null last), of equal rows any one.

    All columns of `docs` are kept as they are.
    """
    with passing() as tables:
        with small_batches(docs.sparkSession):
            prints = materialise(printed(docs, width, seed), "prints")
        rooted = prints.select("doc_id", "text_hash", "fp").join(similar_components(docs, prints, width, seed), "fp")
        kept = least_rows(docs, prints, rooted)
        tables.append(kept)
    return rows_kept(docs, kept)
