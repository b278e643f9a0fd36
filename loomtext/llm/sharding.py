"""Operator 9: resharding by minimum-cost flow.

Rows belong to blocks by a hash of their text, so equal texts share a block. The shards as they are give old sizes, the
caller gives new capacities, and a minimum-cost flow says how many bytes go from which shard to which; whole blocks then
realise it, and only shards that lose or gain blocks are written again. A block larger than `tolerance` of a shard is
divided into parts by further bits of the same hash, so equal texts stay together whatever their size; a text whose
copies alone pass the tolerance stays one part. Only a text whose copies alone are more than a whole shard holds can't
stay together; it is divided by a hash of doc_id. Plans see the sizes of blocks by shard, whose number is bounded by
parameters: `blocks` and, for divided blocks, one part for each tolerance of bytes; there are fewer divided texts than shards.

A sharded table is a folder with `gen=<n>/shard=<k>` folders of Parquet files and `layout/<n>` tables that say, for each
generation, which folder each shard is in. A layout is written last, in one file: until then readers see the old one.

Law: bytes. Each shard ends within the tolerance of its capacity, as far as single rows and groups of equal texts allow.

Defined results: the size of a null text is 1 (none, plus 1) and its CRC32 that of no bytes; repeated rows are placed as
often as they come; rows without doc_id take part; an empty table gives no rows, and empty shards if it is written; other
columns are kept in files, whatever their names.
"""

from __future__ import annotations

import heapq
from bisect import insort

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from loomtext.llm.names import unused
from loomtext.llm.scratch import materialise

#: Blocks of a table by default; the share of a shard's capacity that a block may hold undivided.
BLOCKS = 4096
TOLERANCE = 1 / 200

Unit = tuple[int, int]  # block and part


def min_cost_flow(old: list[int], new: list[int], cost: list[list[int]] | None = None) -> dict[tuple[int, int], int]:
    """Bytes to send from shard to shard so that `old` becomes `new`, at the least cost: successive shortest paths.

    cost[i][j] is the price of a byte from i to j; by default 1 for any move, so that the fewest bytes move.
    """
    n = len(old)
    if sum(old) != sum(new):
        raise ValueError("old and new sizes differ in sum")
    source, sink = 2 * n, 2 * n + 1
    graph: list[list[int]] = [[] for _ in range(2 * n + 2)]
    to, room, price = [], [], []

    def edge(a: int, b: int, most: int, each: int) -> int:
        for x, y, r, c in ((a, b, most, each), (b, a, 0, -each)):
            graph[x].append(len(to))
            to.append(y)
            room.append(r)
            price.append(c)
        return len(to) - 2

    arcs = {}
    for i in range(n):
        edge(source, i, old[i], 0)
        edge(n + i, sink, new[i], 0)
        for j in range(n):
            arcs[i, j] = edge(i, n + j, old[i], 0 if i == j else cost[i][j] if cost else 1)
    potential = [0] * len(graph)
    while True:
        best, via = [float("inf")] * len(graph), [-1] * len(graph)
        best[source] = 0
        queue = [(0, source)]
        while queue:
            d, x = heapq.heappop(queue)
            if d > best[x]:
                continue
            for e in graph[x]:
                y = to[e]
                if room[e] and (w := d + price[e] + potential[x] - potential[y]) < best[y]:
                    best[y], via[y] = w, e
                    heapq.heappush(queue, (w, y))
        if via[sink] < 0:
            return {k: room[e ^ 1] for k, e in arcs.items() if room[e ^ 1] and k[0] != k[1]}
        for x in range(len(graph)):
            if best[x] < float("inf"):
                potential[x] += best[x]
        push, x = float("inf"), sink
        while x != source:
            push, x = min(push, room[via[x]]), to[via[x] ^ 1]
        x = sink
        while x != source:
            room[via[x]] -= push
            room[via[x] ^ 1] += push
            x = to[via[x] ^ 1]


def capacities(total: int, weights: list[int]) -> list[int]:
    """Whole shares of `total` by weight; for equal weights at most 1 apart."""
    upto = [total * sum(weights[: k + 1]) // sum(weights) for k in range(len(weights))]
    return [b - a for a, b in zip([0, *upto], upto)]


def move_blocks(blocks: list[tuple[Unit, int, int]], new: list[int]) -> dict[Unit, int]:
    """New shard of each block of (key, size, old shard); old shards may be more or fewer than new ones.

    Each transfer of the flow takes the sender's blocks, largest first, while they fit into it; what is left of the
    transfers, less than a block each, is evened out by blocks that bring sender and taker closer to their sizes. Shards
    that are no more give all they have.
    """
    shards = max([len(new), *(shard + 1 for _, _, shard in blocks)])
    goal = [*new, *[0] * (shards - len(new))]
    at = {key: shard for key, _, shard in blocks}
    size = {key: s for key, s, _ in blocks}
    held: list[list[tuple[int, Unit]]] = [[] for _ in range(shards)]  # (size, key), ascending
    for key, s, shard in blocks:
        held[shard].append((s, key))
    for keys in held:
        keys.sort()
    full = [sum(s for s, _ in keys) for keys in held]

    def move(key: Unit, a: int, b: int) -> None:
        insort(held[b], (size[key], key))
        full[a] -= size[key]
        full[b] += size[key]
        at[key] = b

    for (a, b), amount in sorted(min_cost_flow(full, goal).items()):
        stay = []
        for s, key in reversed(held[a]):
            if s <= amount:
                amount -= s
                move(key, a, b)
            else:
                stay.append((s, key))
        held[a] = stay[::-1]
    for a in range(len(new), shards):  # what didn't fit into a transfer
        for s, key in held[a]:
            move(key, a, min(range(len(new)), key=lambda k: (full[k] - goal[k], k)))
        held[a] = []
    for _ in range(16 * shards):
        over = [f - n for f, n in zip(full[: len(new)], new)]
        a, b = max(range(len(new)), key=over.__getitem__), min(range(len(new)), key=over.__getitem__)
        gap = over[a] - over[b]
        best = min(((abs(2 * s - gap), key, k) for k, (s, key) in enumerate(held[a]) if s < gap), default=None)
        if best is None:
            break
        del held[a][best[2]]
        move(best[1], a, b)
    return at


def _measured(docs: DataFrame, old: Column | None, shards: int, blocks: int) -> dict[str, Column]:
    """What a row's place depends on: size, text_hash, block (by text), dice (by doc_id, to divide a text), old shard."""
    text = docs["text"].cast("string")
    block = F.pmod(F.xxhash64(text), F.lit(blocks)).cast("int")
    return {
        "size": (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long"),
        "text_hash": F.xxhash64(text),
        "block": block,
        "dice": F.pmod(F.xxhash64(docs["doc_id"].cast("long"), F.lit("dice")), F.lit(1 << 30)),
        # a row that is in no shard yet belongs where its block would be in a new table
        "old": F.coalesce(old.cast("int"), block % shards) if old is not None else block % shards,
    }


def _part(text_hash: Column, dice: Column, parts: Column, divided: Column) -> Column:
    """Which of a block's parts a row is in: by its text; below zero by its doc_id, for texts that are divided."""
    cuts = F.get(F.filter(divided, lambda d: d["text_hash"] == text_hash), F.lit(0))["cuts"]
    return F.coalesce(-1 - F.pmod(dice, cuts), F.pmod(F.xxhash64(text_hash), parts)).cast("int")


def _parted(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """`rows` (block, text_hash, dice) with the part of each."""
    met = rows.join(F.broadcast(parts), "block")
    return met.withColumn("part", _part(*map(F.col, ("text_hash", "dice", "parts", "divided"))))


def plan_shards(rows: DataFrame, new: list[int] | int) -> tuple[DataFrame, DataFrame, set[int]]:
    """From rows with size, text_hash, block, dice and old: parts (block, parts, divided), moves (block, part, shard, base),
    shards that change.

    `new` are the capacities of the new shards, in any unit, or their number if they are equal. A block of which rows are
    in several shards counts where most of its bytes are; `base` is the number of rows that come before the part's in its
    new shard. Tables of at most blocks + shards / TOLERANCE rows for each old shard are read to the driver, which solves
    the flow.
    """
    spark = rows.sparkSession
    weights = [1] * new if isinstance(new, int) else new
    sizes = {r["block"]: r["size"] for r in rows.groupBy("block").agg(F.sum("size").alias("size")).collect()}
    total, shards = sum(sizes.values()), len(weights)
    most = max(1.0, total / shards * TOLERANCE)
    room = max(total * w / sum(weights) for w in weights) if total else 1.0
    full = [b for b, s in sizes.items() if s > room]  # only these can hold a text that no shard has room for
    divided: dict[int, list[tuple[int, int]]] = {}
    if full:
        copies = rows.where(F.col("block").isin(full)).groupBy("block", "text_hash").agg(F.sum("size").alias("size"))
        for r in copies.where(F.col("size") > room).collect():  # each is more than a shard, so they are fewer than shards
            divided.setdefault(r["block"], []).append((r["text_hash"], round(r["size"] / most)))
    schema = "block int, parts int, divided array<struct<text_hash:bigint,cuts:int>>"
    parts = spark.createDataFrame([(b, max(1, round(s / most)), divided.get(b, [])) for b, s in sizes.items()], schema)
    counted = _parted(rows, parts).groupBy("block", "part", "old").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")).collect()
    where: dict[Unit, dict[int, int]] = {}
    count: dict[Unit, int] = {}
    for r in counted:
        key = (r["block"], r["part"])
        where.setdefault(key, {})[r["old"]] = r["size"]
        count[key] = count.get(key, 0) + r["rows"]
    blocks = [(key, sum(of.values()), max(of, key=lambda k: (of[k], -k))) for key, of in where.items()]
    at = move_blocks(blocks, capacities(total, weights))
    before, moves = [0] * shards, []
    for key in sorted(at):
        moves.append((*key, at[key], before[at[key]]))
        before[at[key]] += count[key]
    changed = {k for key, of in where.items() for old in of if old != at[key] for k in (old, at[key])}
    return parts, spark.createDataFrame(moves, "block int, part int, shard int, base long"), changed


def assign_shards(docs: DataFrame, new: list[int] | int = 16, old: Column | None = None, blocks: int = BLOCKS) -> DataFrame:
    """doc_id, size, text_crc32, law, old_shard, shard, slot for each row of `docs` (doc_id, text).

    `new` are capacities or a number of equal shards, `old` says which shard a row is in now; without it, and where it is
    null, rows are taken to be where a hash of their text puts them.
    """
    n = new if isinstance(new, int) else len(new)
    text = docs["text"].cast("string")
    crc = F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32")
    measured = [c.alias(k) for k, c in _measured(docs, old, n, blocks).items()]
    rows = materialise(docs.select(docs["doc_id"].cast("long").alias("doc_id"), crc, *measured), "sizes")
    parts, moves, _ = plan_shards(rows, new)
    placed = _parted(rows, parts).join(F.broadcast(moves), ["block", "part"])
    in_part = Window.partitionBy("block", "part").orderBy("doc_id", "text_crc32", "size")
    slot = (F.col("base") + F.row_number().over(in_part) - 1).alias("slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("old").alias("old_shard"), "shard", slot)


def _layout(spark: SparkSession, path: str) -> tuple[int, dict[int, str], int]:
    """Generation, folder of each shard (none: empty), and number of blocks of the newest layout; -1 where there is none."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/layout")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return -1, {}, 0
    # a layout is one file that its writer's commit puts there; the folder alone may be of a writer that died
    whole = [int(p.getName()) for s in fs.listStatus(root) if (p := s.getPath()).getName().isdigit() and fs.exists(p.suffix("/_SUCCESS"))]
    if not whole:
        return -1, {}, 0
    rows = spark.read.parquet(f"{path}/layout/{max(whole)}").collect()
    return max(whole), {r["shard"]: r["folder"] for r in rows}, rows[0]["blocks"]


def read_shards(spark: SparkSession, path: str, name: str = "shard") -> DataFrame:
    """The rows of a sharded table with the number of their shard in a last column `name`; none if all shards are empty.

    Rows are those that were written: nulls, repeated rows and other columns as they were. No layout in `path` is a ValueError.
    """
    generation, folders, _ = _layout(spark, path)
    if generation < 0:
        raise ValueError(f"no sharded table in {path}")
    schema = spark.read.parquet(f"{path}/layout/{generation}-schema").schema
    filled = [f"{path}/{f}" for f in folders.values() if f]
    if not filled:
        return spark.createDataFrame([], schema).withColumn(name, F.lit(None).cast("int"))
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(*filled)
    return rows.withColumn(name, F.regexp_extract(F.col("_metadata.file_path"), "/[^/=]+=([0-9]+)/[^/]*$", 1).cast("int"))


def reshard(spark: SparkSession, path: str, new: list[int] | int, more: DataFrame | None = None, blocks: int = BLOCKS) -> list[int]:
    """Bring the sharded table in `path` to new capacities (or a number of equal shards), with the rows of `more` added.

    Old sizes are those of the files. Only shards that lose or gain rows are written again, into a new generation of
    folders; the layout that names them is written last, then what it no longer names is deleted. Without a table in
    `path` one is made from `more`, in `blocks` blocks. Returns the shards written.
    """
    generation, folders, own_blocks = _layout(spark, path)
    n = new if isinstance(new, int) else len(new)
    if generation < 0 and more is None:
        raise ValueError(f"no sharded table in {path}")
    own = unused(more) if generation < 0 else unused(read_shards(spark, path).drop("shard"))
    blocks = own_blocks or blocks
    now = read_shards(spark, path, f"{own}old") if generation >= 0 else None
    if more is not None:
        added = more.withColumn(f"{own}old", F.lit(None).cast("int"))
        now = added if now is None else now.unionByName(added)
    columns = [c for c in now.columns if c != f"{own}old"]
    measured = {f"{own}{k}": c for k, c in _measured(now, F.col(f"{own}old"), n, blocks).items() if k != "old"}
    rows = now.withColumns(measured)
    place = F.coalesce(F.col(f"{own}old"), F.col(f"{own}block") % n)
    fresh = F.col(f"{own}old").isNull()
    sized = materialise(rows.select(*[F.col(f"{own}{k}").alias(k) for k in ("size", "text_hash", "block", "dice")], place.alias("old"), fresh.alias("fresh")), "sizes")
    parts, moves, changed = plan_shards(sized, new)
    where = moves.join(parts, "block").select(*[F.col(c).alias(f"{own}{c}_to") for c in ("block", "part", "parts", "divided", "shard")])
    # rows that are new to the table change the shard they go to
    here = _parted(sized, parts).join(F.broadcast(moves), ["block", "part"])
    changed |= {r["shard"] for r in here.where("fresh").select("shard").distinct().collect()}
    kept = {k: folder for k, folder in folders.items() if k < n and k not in changed}
    written = sorted(k for k in range(n) if k not in kept)
    part = _part(*[F.col(f"{own}{c}") for c in ("text_hash", "dice", "parts_to", "divided_to")])
    match = (F.col(f"{own}block") == F.col(f"{own}block_to")) & (part == F.col(f"{own}part_to"))
    out = rows.join(F.broadcast(where.where(F.col(f"{own}shard_to").isin(written))), match)
    gen = generation + 1
    salt = F.pmod(F.col(f"{own}dice"), F.lit(8))
    out.repartition(f"{own}shard_to", salt).select(*columns, f"{own}shard_to").write.mode("overwrite").partitionBy(f"{own}shard_to").parquet(f"{path}/gen={gen}")
    fs_of = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_of(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for k in written:
        folder = f"gen={gen}/{own}shard_to={k}"
        kept[k] = folder if fs.exists(fs_of(f"{path}/{folder}")) else ""
    spark.createDataFrame([], now.select(*columns).schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/layout/{gen}-schema")
    layout = spark.createDataFrame([(k, kept[k], blocks) for k in sorted(kept)], "shard int, folder string, blocks int")
    layout.coalesce(1).write.mode("overwrite").parquet(f"{path}/layout/{gen}")
    for folder in {f for f in folders.values() if f} - set(kept.values()):
        fs.delete(fs_of(f"{path}/{folder}"), True)
    return written
