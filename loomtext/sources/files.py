"""Files: JSON arrays and lines, TSV counts, CSV, tables; optional sources; appends that resume."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from loomtext.functions.text import csv_cell, has_thaana
from loomtext.scratch import discard, materialise

LEXICON = "latin string, english array<string>, pos string, frequency bigint, freq_source string"
SOURCE_NAMES, TARGET_NAMES = ("dv", "dhivehi", "source", "thaana"), ("en", "english", "target")


def json_array(spark: SparkSession, path: str, schema: str | StructType = LEXICON) -> DataFrame:
    """Rows of a JSON array."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_lines(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Rows of JSON lines; blank lines are none, rows without any field are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).dropna("all")


def optional(spark: SparkSession, path: str, schema: str, kind: str = "json") -> DataFrame:
    """A source that may be missing: no rows then."""
    try:
        return spark.read.schema(schema).format(kind).load(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def tsv_counts(spark: SparkSession, path: str) -> DataFrame:
    """(latin, frequency) of tab-separated lines: comments, short rows and other than whole numbers are skipped, the largest count wins."""
    lines = spark.read.text(path).where("value not like '#%'")
    parts = F.split("value", "\t")
    rows = lines.where(F.size(parts) >= 2).select(F.trim(parts[0]).alias("latin"), F.trim(parts[1]).try_cast("long").alias("frequency"))
    return rows.where("latin <> '' and frequency is not null").groupBy("latin").agg(F.max("frequency").alias("frequency"))


def thaana_rows(spark: SparkSession, path: str, field: str) -> DataFrame:
    """(text): values with Thaana of a .jsonl, .json or text file."""
    if path.endswith((".json", ".jsonl")):
        rows = spark.read.option("multiLine", path.endswith(".json")).schema(f"`{field}` string").json(path).select(F.col(field).alias("text"))
    else:
        rows = spark.read.text(path).select(F.col("value").alias("text"))
    return rows.where(has_thaana(F.col("text")))


def pooled(sources: dict[str, DataFrame], limit: int | None = None) -> DataFrame:
    """(dv, en, source, raw_domain): all sources under the names found in them, each row with its source."""
    out = None
    for name, rows in sources.items():
        def first(names: tuple[str, ...]) -> str:
            found = [n for n in names if n in rows.columns]  # noqa: B023
            if not found:
                raise ValueError(f"source {name} has none of {names}")  # noqa: B023
            return found[0]

        domain = next((F.col(c) for c in ("topic", "domain", "category") if c in rows.columns), F.lit(None).cast("string"))
        one = rows.select(F.col(first(SOURCE_NAMES)).alias("dv"), F.col(first(TARGET_NAMES)).alias("en"), F.lit(name).alias("source"), domain.alias("raw_domain"))
        one = one.limit(limit) if limit else one
        out = one if out is None else out.unionByName(one)
    return out


def guarded_csv(rows: DataFrame, path: str) -> None:
    """CSV files with quoted text cells that no spreadsheet runs as formulas."""
    cells = [csv_cell(F.coalesce(F.col(c).cast("string"), F.lit(""))) if t == "string" else F.coalesce(F.col(c).cast("string"), F.lit("")) for c, t in rows.dtypes]
    rows.select(F.concat_ws(",", *cells).alias("value")).write.text(path)


def json_artefact(rows: DataFrame, path: str, order: str) -> None:
    """Rows as one JSON array in the order of a column, non-ASCII unescaped: for artefacts that one file and task can hold."""
    n = F.row_number().over(Window.orderBy(order))
    told = rows.select(F.to_json(F.struct(*rows.columns)).alias("json"), n.alias("n")).coalesce(1)
    last = rows.count()
    if not last:
        rows.sparkSession.createDataFrame([("[]",)], "value string").coalesce(1).write.text(path)
        return
    told.select(F.concat(F.when(F.col("n") == 1, "[").otherwise(" "), "json", F.when(F.col("n") == last, "]").otherwise(",")).alias("value")).write.text(path)


def csv_union(tables: list[DataFrame], path: str) -> None:
    """Tables under one header: the union of their columns in the order they are first seen; what a table lacks is empty."""
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    out.write.option("header", True).csv(path)


def append_new(rows: DataFrame, path: str, key: str) -> DataFrame:
    """Append the rows whose key the table at `path` hasn't got, of equal keys the least row; returns them. Run again, it adds nothing.

    A null key is a key like any other.
    """
    spark = rows.sparkSession
    try:
        done = spark.read.parquet(path).select(F.col(key).alias("done"))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = rows.select(F.col(key).alias("done")).limit(0)
    least = rows.groupBy(key).agg(F.min(F.struct(*[c for c in rows.columns if c != key])).alias("row")) if len(rows.columns) > 1 else rows.distinct()
    new = least.join(done, F.col(key).eqNullSafe(F.col("done")), "left_anti")
    new = new.select(*[F.col(c) if c == key else F.col("row")[c].alias(c) for c in rows.columns])
    new = materialise(new, "appended")  # the table changes below
    new.write.mode("append").parquet(path)
    return new


def latest(rows: DataFrame, key: str, order: str, version: str | None = None, wanted: int | None = None) -> DataFrame:
    """The last row by `order` of each key of an appended table; with `wanted`, of those whose `version` is that one."""
    rows = rows.where(F.col(version) == wanted) if version else rows
    last = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("row"))
    return last.select(key, "row.*")


def fingerprint(spark: SparkSession, path: str) -> str:
    """SHA-256 of the files under a path: of their names and their contents' own digests, in the order of names."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    each = files.select(F.regexp_extract("path", "[^/]+$", 0).alias("name"), F.sha2("content", 256).alias("digest"))
    told = each.select(F.concat_ws(":", "name", "digest").alias("line")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256))  # a line for each file
    return told.first()[0]


def checked_write(rows: DataFrame, path: str, broken: Column) -> None:
    """Write only if no row breaks the invariant; nothing is written otherwise. Rows are computed once, aside, and checked there."""
    rows = materialise(rows, "checked")
    bad = rows.where(broken).limit(5).collect()
    if bad:
        raise ValueError(f"not written, rows break the invariant: {bad}")
    rows.write.parquet(path)
    discard(rows)


def with_defaults(stored: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Stored settings, null where unset, with defaults in their place."""
    return stored.select(*[F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in stored.columns])


def honorifics(spark: SparkSession, path: str) -> DataFrame:
    """(latin, english, register, kind, plain_form) of JSON lines: glosses between ;, `-` or nothing for no plain form."""
    rows = json_lines(spark, path, "latin string, english string, register string, kind string, plain string")
    listed = F.filter(F.transform(F.split("english", ";"), lambda x: F.trim(x)), lambda x: x != "")
    plain = F.nullif(F.nullif(F.trim("plain"), F.lit("")), F.lit("-"))
    return rows.select("latin", listed.alias("english"), "register", "kind", plain.alias("plain_form"))


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes) of the files under a folder, contents unread."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    return rows.select(F.regexp_extract("path", "[^/]+$", 0).alias("name"), F.col("length").alias("bytes"))


def shipped_size(sizes: DataFrame, budget: int, forbidden: str) -> DataFrame:
    """(bytes, files, forbidden, ok): total size against a budget, and files that may not ship."""
    told = sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("files"), F.count_if(F.rlike("name", F.lit(forbidden))).alias("forbidden"))
    return told.withColumn("ok", (F.col("bytes") <= budget) & (F.col("forbidden") == 0))
