"""Parallel corpora: reject funnel, duplicates, splits without leaks, both directions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomtext.functions import tables as T, text as X
from loomtext.functions.script import to_latin
from loomtext.names import unused

TEST_SHARE, VALID_SHARE = 0.05, 0.05
# Task prefixes, colon and space included.
PREFIXES = {"dv-en": "translate Dhivehi Latin to English: ", "en-dv": "translate English to Dhivehi Latin: "}


def mark_duplicates(rows: DataFrame, exact: Column, near: Column, order: str) -> DataFrame:
    """`rows` with `status`: kept, duplicate_exact or duplicate_near; null where the near key is null.

    The first row of a near key is kept. An exact duplicate shares its near key, so the rest are told apart by the kept
    row's exact key. Keys are digests, and the first of each key is found before rows meet, so a hot key is one small row.
    """
    own = unused(rows)
    keyed = rows.withColumns({f"{own}exact": F.md5(exact), f"{own}near": F.md5(near)})
    at = F.struct(F.col(order).alias("place"), F.col(f"{own}exact").alias("exact"))
    first = keyed.where(F.col(f"{own}near").isNotNull()).groupBy(F.col(f"{own}near").alias(f"{own}of")).agg(F.min(at).alias(f"{own}first"), F.count(F.lit(1)).alias(f"{own}n"))
    # most keys have one row: only the others' are joined back; rows without a key are dealt by their place, not all to one task
    key = F.coalesce(F.col(f"{own}near"), F.concat(F.lit("-"), F.xxhash64(F.col(order)).cast("string")))
    met = keyed.join(first.where(F.col(f"{own}n") > 1), key == F.col(f"{own}of"), "left")
    alone = F.col(f"{own}of").isNull() | (F.col(order) == F.col(f"{own}first.place"))
    status = F.when(F.col(f"{own}near").isNull(), None).when(alone, "kept").when(F.col(f"{own}exact") == F.col(f"{own}first.exact"), "duplicate_exact").otherwise("duplicate_near")
    return met.withColumn("status", status).drop(*[f"{own}{c}" for c in ("exact", "near", "of", "first", "n")])


def pair_rules(rows: DataFrame, in_thaana: bool = True, counter: str = "bytes", judged: str = "judged") -> DataFrame:
    """`rows` (dv, en, ...) as cleaned, with latin and, in the struct `judged`, all that pair_labels() needs of a row.

    Its parts are the rule that rejects the row (null: none), digests that duplicates share, tokens, ratio and non_ascii.
    """
    def clean(c: str) -> Column:
        return X.fold_punctuation(X.normalise(F.col(c)))

    own = unused(rows)
    told = rows.withColumns({"dv": clean("dv"), "en": clean("en")})
    told = told.withColumn(f"{own}rule", X.reject_reason(F.col("dv"), F.col("en"), in_thaana))
    source = to_latin(F.col("dv")) if in_thaana else F.col("dv")
    told = told.withColumn("latin", F.when(F.col(f"{own}rule").isNull(), source))
    late = F.when(F.col("latin").isNotNull(), X.latin_reason(F.col("latin"), F.col("en")))
    told = told.withColumn(f"{own}rule", F.coalesce(F.col(f"{own}rule"), late))
    rule = F.col(f"{own}rule")
    count = X.TOKEN_COUNTERS[counter]
    sides = [F.concat(F.lit(PREFIXES["dv-en"]), "latin"), F.col("en"), F.concat(F.lit(PREFIXES["en-dv"]), "en"), F.col("latin")]
    odd = F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all("latin", F.lit("[^\\x00-\\x7f]"), F.lit(0)))), "")
    ratio = F.round(F.length("latin") / F.greatest(F.length("en"), F.lit(1)), 3)
    parts = {
        "rule": rule, "exact": F.when(rule.isNull(), F.md5(F.concat("latin", F.lit("\x01"), "en"))), "near": F.when(rule.isNull(), F.md5(X.near_keys(F.col("latin"), F.col("en")))),
        "tokens": F.when(rule.isNull(), F.greatest(*[count(s) for s in sides])), "non_ascii": F.when(rule == "non_ascii_latin", odd),
        "ratio": F.when(F.col("latin").isNotNull() & (F.coalesce(rule, F.lit("")) != "non_ascii_latin"), ratio),
    }
    return told.withColumn(judged, F.struct(*[c.alias(name) for name, c in parts.items()])).drop(f"{own}rule")


def pair_labels(told: DataFrame, order: str, most_tokens: int | None = T.MAX_TOKENS, judged: str = "judged") -> DataFrame:
    """`told`, with the struct `judged` of pair_rules(), as labelled: reason, tokens, non_ascii and ratio in its place."""
    told = mark_duplicates(told, F.col(f"{judged}.exact"), F.col(f"{judged}.near"), order)
    kept = F.col("status") == "kept"
    tokens = F.when(kept, F.col(f"{judged}.tokens"))
    long = F.when(tokens > most_tokens, "over_max_tokens") if most_tokens else F.lit(None).cast("string")
    evidence = {
        "reason": F.coalesce(F.col(f"{judged}.rule"), F.when(~kept, F.col("status")), long), "tokens": tokens,
        "non_ascii": F.col(f"{judged}.non_ascii"), "ratio": F.col(f"{judged}.ratio"),
    }
    return told.withColumns(evidence).drop(judged, "status")


def pair_funnel(rows: DataFrame, order: str, in_thaana: bool = True, most_tokens: int | None = T.MAX_TOKENS, counter: str = "bytes") -> DataFrame:
    """`rows` (dv, en, ...) as cleaned, with latin, reason (null: kept), ratio, tokens and non_ascii: the 14 labels in order.

    Row rules on the cleaned sides, then on the source in Latin letters, then exact and near duplicates of an earlier row
    that passed, by `order`, then sequences that exceed a model: inputs with their task prefix and targets of both
    directions. Evidence is null where a row didn't get that far. With `in_thaana` false the source is in Latin letters.
    """
    judged = f"{unused(rows)}judged"
    return pair_labels(pair_rules(rows, in_thaana, counter, judged), order, most_tokens, judged)


def hold_out_groups(sizes: DataFrame, excluded: list[str], test: float = TEST_SHARE, valid: float = VALID_SHARE) -> DataFrame:
    """(name, n, split) from (name, n): whole groups go to test, then to valid, smallest first, until the share is reached.

    `sizes` has a row for each group; excluded groups train.
    """
    total = sizes.agg(F.sum("n").alias("total"))
    order = Window.orderBy("n", "name")
    open_ = sizes.where(~F.col("name").isin(*excluded)).crossJoin(F.broadcast(total))
    ranked = open_.withColumn("before", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    in_test = (F.col("before") < test * F.col("total")) | (F.row_number().over(order) == 1)
    ranked = ranked.withColumn("test", in_test)
    rest = ranked.where("not test").withColumn("before", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rest = rest.withColumn("valid", (F.col("before") < valid * F.col("total")) | (F.row_number().over(order) == 1))
    split = ranked.where("test").select("name", "n", F.lit("test").alias("split"))
    split = split.unionAll(rest.select("name", "n", F.when(F.col("valid"), "valid").otherwise("train").alias("split")))
    return split.unionAll(sizes.where(F.col("name").isin(*excluded)).select("name", "n", F.lit("train").alias("split")))


def seeded_order(key: Column, seed: int) -> Column:
    """A reproducible shuffle: the MD5 of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def hold_out_rows(rows: DataFrame, key: str, seed: int, valid: int, test: int) -> DataFrame:
    """`rows` with `split`: the first `valid` rows of a shuffle, the next `test`, the rest train. Held-out rows are few: a top-k finds them."""
    order = seeded_order(F.col(key), seed)  # valid + test are small by contract: what is broadcast is that many keys
    head = rows.select(F.col(key).alias("__key"), order.alias("__o")).orderBy("__o", "__key").limit(valid + test)
    numbered = head.withColumn("__n", F.row_number().over(Window.orderBy("__o", "__key")))
    met = rows.join(F.broadcast(numbered) if valid + test <= 1_000_000 else numbered, rows[key] == numbered["__key"], "left")
    split = F.when(F.col("__n") <= valid, "valid").when(F.col("__n").isNotNull(), "test").otherwise("train")
    return met.withColumn("split", split).drop("__key", "__o", "__n")


def without_leaks(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows with `split` in train, valid and test, less held-out rows whose `key` trains, and valid rows that test; and counts removed."""
    train, valid, test = (rows.where(F.col("split") == s) for s in ("train", "valid", "test"))
    seen, tested = train.select(key).distinct(), test.select(key).distinct()
    clean_test = test.join(seen, key, "left_anti")
    no_train = valid.join(seen, key, "left_anti")
    clean_valid = no_train.join(clean_test.select(key).distinct(), key, "left_anti")

    def removed(name: str, part: DataFrame, against: DataFrame) -> DataFrame:
        return part.join(against, key, "left_semi").agg(F.count(F.lit(1)).alias("removed")).select(F.lit(name).alias("step"), "removed")

    counts = removed("valid_in_train", valid, seen).unionAll(removed("test_in_train", test, seen)).unionAll(removed("valid_in_test", no_train, tested))
    return train.unionByName(clean_valid).unionByName(clean_test), counts


def split_overlap(rows: DataFrame, key: str) -> DataFrame:
    """(pair, shared): keys that two splits share; all zero for a clean corpus. One aggregate, no self-join."""
    at = rows.groupBy(key).agg(*[F.max((F.col("split") == s).cast("int")).alias(s) for s in ("train", "valid", "test")])
    pairs = [("train", "valid"), ("train", "test"), ("valid", "test")]
    sums = at.agg(*[F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0)).alias(f"{a}_{b}") for a, b in pairs])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(f"{a}_{b}").alias("pair"), F.col(f"{a}_{b}").alias("shared")) for a, b in pairs])))


def both_directions(pairs: DataFrame) -> DataFrame:
    """Two rows of each pair (latin, english, ...): input with the direction's prefix, target, direction."""
    others = [c for c in pairs.columns if c not in ("latin", "english")]
    sides = [(d, p, *s) for (d, p), s in zip(PREFIXES.items(), (("latin", "english"), ("english", "latin")))]
    rows = F.array(*[F.struct(F.concat(F.lit(p), F.col(a)).alias("input"), F.col(b).alias("target"), F.lit(d).alias("direction")) for d, p, a, b in sides])
    return pairs.select(*others, F.inline(rows))


def prefix_ok(text: Column, direction: Column) -> Column:
    """Exactly one task prefix stands at the start, the direction's own."""
    own = F.when(direction == "dv-en", PREFIXES["dv-en"]).when(direction == "en-dv", PREFIXES["en-dv"])
    either = [F.startswith(text, F.lit(p)) for p in PREFIXES.values()]
    return F.coalesce((either[0] != either[1]) & F.startswith(text, own), F.lit(False))


def re_pair(rows: DataFrame) -> DataFrame:
    """Complete pairs (latin, english) of rows (input, target, direction) in both directions."""
    def bare(d: str) -> Column:
        return F.substring("input", F.lit(len(PREFIXES[d]) + 1), F.length("input"))

    latin = F.when(F.col("direction") == "dv-en", bare("dv-en")).otherwise(F.col("target"))
    english = F.when(F.col("direction") == "dv-en", F.col("target")).otherwise(bare("en-dv"))
    ok = rows.where(prefix_ok(F.col("input"), F.col("direction"))).select(latin.alias("latin"), english.alias("english"), "direction")
    both = ok.groupBy("latin", "english").agg(F.count_distinct("direction").alias("n"))
    return both.where("n = 2").select("latin", "english")


def quarantine(rows: DataFrame, text: str, reason: str, order: str, most: int | None = T.QUARANTINE_ROWS) -> DataFrame:
    """Rejected rows with evidence: the distinct characters beyond ASCII, sorted, and the length; the first `most` by `order`, or all."""
    odd = F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit("[^\\x00-\\x7f]"), F.lit(0)))), "")
    rejected = rows.where(F.col(reason).isNotNull()).withColumns({"evidence": odd, "size": F.length(text)})
    return rejected.orderBy(order).limit(most) if most else rejected


def funnel_counts(rows: DataFrame, reason: str) -> DataFrame:
    """(reason, n), most first."""
    return rows.where(F.col(reason).isNotNull()).groupBy(F.col(reason).alias("reason")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason")


def document_reason(text: Column) -> Column:
    """The funnel's rules for single texts: no second side, no script rules."""
    odd = F.length(F.regexp_replace(text, "[\\x00-\\x7f]", "")) / F.nullif(F.length(text), F.lit(0))
    return (
        F.when(F.coalesce(X.one_line(text), F.lit("")) == "", "empty_side").when(F.rlike(text, F.lit(T.UI_STRING)), "ui_string")
        .when(F.size(F.split(X.one_line(text), " ")) < T.MIN_WORDS, "too_few_words").when(F.length(X.one_line(text)) > 2000, "length_bounds")
        .when(odd > 0.08, "non_ascii_latin")
    )
