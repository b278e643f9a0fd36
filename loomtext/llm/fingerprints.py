"""Operator 4: document fingerprints that subtract, in DataFrame functions only.

A fingerprint is an invertible Bloom lookup sketch of the digests of a text's distinct paragraphs (lines with a word):
three subtables of cells, each with a count, the xor of digests and the xor of their checks. Two versions' cells subtract;
what is left is peeled: a cell of count 1 or -1 whose check fits names a digest of one version only, which is then taken
from its other cells. Subtables take turns, so that a digest is found in one cell at a time. Where cells are left over,
the pair is tried again with sketches GROWTH times as large, until every pair is solved. Rows are written in buckets of
their document, so that sketches and peeling need no shuffle, and what a lost executor had is read again.

Likeness of two fingerprints: paragraphs that both have, by those that either has; 1 if neither has any.

Defined results: a null text is empty; the next document is the one of the next lower doc_id (after the lowest: the
highest), of equal doc_ids the one of the least text; a row without doc_id has no next document, so that its edited text
only loses its end and near_next is null; repeated rows give repeated results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomtext.llm.neighbours import next_lower
from loomtext.llm.scratch import materialise, materialise_by

CELLS = 24  # of the fingerprint; a multiple of 3
GROWTH = 4
SWEEPS = 2
_TABLES = 3


def digests(text: Column) -> Column:
    """Digests of the distinct lines that have a word."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\f\r"))) > 0)
    return F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x)))


def _check(digest: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(digest, F.lit("check")), 32)


def _cell(digest: Column, table: int, cells: int) -> Column:
    """The digest's cell in one subtable."""
    own = cells // _TABLES
    return (F.pmod(F.xxhash64(digest, F.lit(table)), F.lit(own)) + table * own).cast("int")


def _entry(cell: Column, count: Column, digest: Column) -> Column:
    return F.struct(cell.alias("cell"), count.cast("long").alias("n"), digest.alias("key"), _check(digest).alias("chk"))


def _spread(digest: Column, count: Column, cells: int) -> Column:
    """A digest's entries, one for each subtable."""
    return F.array(*[_entry(_cell(digest, t, cells), count, digest) for t in range(_TABLES)])


def _summed(entries: DataFrame, by: list[str]) -> DataFrame:
    """Cells of entries that fall together; empty cells are left out."""
    cells = entries.groupBy(*by).agg(F.sum("n").alias("n"), F.bit_xor("key").alias("key"), F.bit_xor("chk").alias("chk"))
    return cells.where("n <> 0 or key <> 0 or chk <> 0")


def sketch(rows: DataFrame, digest_column: str, cells: int, by: list[str]) -> DataFrame:
    """(*by, cell, n, key, chk): the cells of each row's digests."""
    spread = rows.select(*by, F.explode(digest_column).alias("digest")).select(*by, F.inline(_spread(F.col("digest"), F.lit(1), cells)))
    return _summed(spread, [*by, "cell"])


def subtracted(rows: DataFrame, left: str, right: str, cells: int, by: list[str]) -> DataFrame:
    """(*by, cell, n, key, chk): cells of each row's `left` digests less those of its `right` ones.

    Both sides' entries come out of one row and are summed at once: a union of two sketches would forget how rows are partitioned.
    """
    signed = F.concat(*[F.transform(c, lambda d: F.struct(d.alias("digest"), F.lit(n).alias("sign"))) for c, n in ((left, 1), (right, -1))])
    entries = rows.select(*by, F.inline(signed)).select(*by, F.inline(_spread(F.col("digest"), F.col("sign"), cells)))
    return _summed(entries, [*by, "cell"])


def peel(cells: DataFrame, size: int, by: list[str]) -> DataFrame:
    """(*by, digest, sign, left): digests recovered from subtracted cells of sketches of `size` cells.

    A row with digest null and left above 0 tells how many cells resisted.
    """
    state = cells.withColumn("digest", F.lit(None).cast("long"))
    kept = F.struct("cell", "n", "key", "chk", "digest")
    for turn in range(SWEEPS * _TABLES):
        table = turn % _TABLES
        own, key = F.col("n"), F.col("key")
        pure = F.col("digest").isNull() & (F.abs(own) == 1) & (F.col("chk") == _check(key)) & (F.col("cell") == _cell(key, table, size))
        taken = [F.struct(*_fields(_entry(_cell(key, t, size), -own, key)), F.lit(None).cast("long").alias("digest")) for t in range(_TABLES)]
        found = F.struct(F.lit(-1).alias("cell"), own.alias("n"), F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("chk"), key.alias("digest"))
        state = _summed(state.select(*by, F.inline(F.when(pure, F.array(kept, found, *taken)).otherwise(F.array(kept)))), [*by, "cell", "digest"])
    return state.select(*by, "digest", F.col("n").alias("sign"), F.col("digest").isNull().cast("int").alias("left"))


def _fields(entry: Column) -> list[Column]:
    return [entry[name].alias(name) for name in ("cell", "n", "key", "chk")]


def _pairs(rows: DataFrame, wanted: dict[str, Column]) -> DataFrame:
    """(row, against, a, b): the own digests and those of each other text that is there and wanted."""
    sides = F.array(*[F.when(F.col(k).isNotNull() & w, F.struct(F.lit(k).alias("against"), F.col(k).alias("b"))) for k, w in wanted.items()])
    return rows.select("row", F.col("own").alias("a"), F.inline(F.filter(sides, lambda x: x.isNotNull())))


def differences(rows: DataFrame, against: tuple[str, ...]) -> DataFrame:
    """(row, against, only_a, only_b) for the pairs of `own` and each column of `against`, arrays of distinct digests.

    `rows` is partitioned by row, and stays so: what is joined to it is one small row for each of its rows that waits. A
    pair without differences has no row.
    """
    by = ["row", "against"]
    size, solved = CELLS, None
    waiting = _pairs(rows, {k: F.lit(True) for k in against})
    while True:
        told = peel(subtracted(waiting, "a", "b", size, by), size, by).groupBy(*by).agg(
            F.count(F.when((F.col("left") == 0) & (F.col("sign") > 0), 1)).alias("only_a"),
            F.count(F.when((F.col("left") == 0) & (F.col("sign") < 0), 1)).alias("only_b"),
            F.sum("left").alias("left"),
        )
        told = materialise(told, f"peeled{size}")
        done = told.where("left = 0").drop("left")
        solved = done if solved is None else solved.unionAll(done)
        left = told.where("left > 0")
        if left.isEmpty():
            return solved
        flags = left.groupBy("row").agg(*[F.max((F.col("against") == k).cast("int")).alias(f"wait_{k}") for k in against])
        waiting = _pairs(rows.join(flags, "row"), {k: F.col(f"wait_{k}") == 1 for k in against})
        size *= GROWTH


def fingerprint(cells: DataFrame, by: list[str]) -> DataFrame:
    """(*by, fingerprint): the non-empty cells as cell:count:digest:check in hexadecimal, comma-joined."""
    shown = F.concat_ws(":", F.hex("cell"), F.hex("n"), F.hex("key"), F.hex("chk"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cell", shown.alias("shown")))), lambda c: c["shown"]), ",")
    return cells.groupBy(*by).agg(joined.alias("fingerprint"))


def versions(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n_chars, edited_sha256, own, edited, next): each document with the digests of its three texts."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    # a plain column where it is long already: an alias would keep the two uses of one exchange from being seen as equal
    doc_id = docs["doc_id"] if dict(docs.dtypes)["doc_id"] == "bigint" else docs["doc_id"].cast("long").alias("doc_id")
    rows = docs.select(doc_id, text.alias("text"))
    numbered = rows.where("doc_id is not null")
    half = F.floor(F.length("text") / 2).cast("int")
    lengths = numbered.groupBy("doc_id").agg(F.max(half).alias("need")).select(F.col("doc_id").alias("id"), "need")
    links = next_lower(lengths).join(lengths, "id").select(F.col("id").alias("for_id"), F.col("next_id").alias("of_id"), "need")
    links = materialise(links, "links")
    dealt = numbered.repartition(n, "doc_id")
    each = dealt.groupBy("doc_id").agg(F.min("text").alias("text"))
    given = each.join(links, each["doc_id"] == links["of_id"]).select("for_id", F.expr("left(text, need)").alias("start"), digests(F.col("text")).alias("next"))
    met = dealt.join(given, dealt["doc_id"] == given["for_id"]).select("doc_id", "text", "start", "next")
    alone = rows.where("doc_id is null").select("doc_id", "text", F.lit("").alias("start"), F.lit(None).cast("array<bigint>").alias("next"))
    both = met.unionAll(alone)
    edited = F.concat(F.left("text", F.length("text") - half), F.left("start", half))
    made = both.select("doc_id", "text", edited.alias("edited"), "next")
    return made.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        digests(F.col("text")).alias("own"),
        digests(F.col("edited")).alias("edited"),
        "next",
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of `docs`."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = materialise_by(materialise(versions(docs), "versions"), "row", n, "digests")
    of = {k: sketch(rows, k, CELLS, ["row"]) for k in ("own", "edited")}
    apart = differences(rows, ("edited", "next"))
    by_row = apart.groupBy("row").agg(*[
        F.max(F.when(F.col("against") == k, F.struct("only_a", "only_b"))).alias(f"apart_{k}") for k in ("edited", "next")
    ])
    shown = [fingerprint(of[k], ["row"]).withColumnRenamed("fingerprint", name) for k, name in (("own", "fingerprint"), ("edited", "edited_fingerprint"))]

    def likeness(k: str) -> Column:
        shared = F.size("own") - F.coalesce(F.col(f"apart_{k}.only_a"), F.lit(0))
        either = F.size("own") + F.coalesce(F.col(f"apart_{k}.only_b"), F.lit(0))
        return F.when(F.col(k).isNotNull(), F.when(either == 0, 1.0).otherwise(shared / either))

    joined = rows.join(shown[0], "row", "left").join(shown[1], "row", "left").join(by_row, "row", "left")
    return joined.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.coalesce("fingerprint", F.lit("")).alias("fingerprint"),
        F.coalesce("edited_fingerprint", F.lit("")).alias("edited_fingerprint"),
        likeness("edited").alias("near_edited"),
        likeness("next").alias("near_next"),
    )
