"""Operator 2: quality by weak supervision, in DataFrame functions only.

Rules over counts of a text vote good (1) or bad (-1) or abstain (0); each can cast one kind of vote. The label model: a
document is good with some share, and each rule votes with one chance on good documents and with another on bad ones;
these two are its accuracy. Expectation-maximisation estimates share and chances from all documents' votes, without
labels; a document's verdict is the posterior probability that it is good. Each kind of junk is seen by two rules or
more, which is what lets accuracies be told from agreement. The only thing taken for granted is that no rule is worse than
chance: one against a document doesn't vote more often on good ones. Votes take one of 2^len(RULES) patterns, so the
estimation runs over pattern counts, one row of at most that many structs, whatever the input.

Defined results: a null or blank text has no words, counts of 0, fails the base rule and isn't kept; repeated rows give
repeated results and count as often in the estimation; an empty table gives no rows; a null doc_id stays null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, functions as F

from loomtext.llm.scratch import materialise

WHITE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
ROUNDS = 30
_PLACE = 30  # bits of a word's place in a coded window

#: Name, vote, and when it is cast.
RULES: list[tuple[str, int, str]] = [
    ("symbol_chars", -1, "n_symbols >= 0.08 * word_chars and n_symbols > 0"),
    ("symbol_words", -1, "n_symbols >= 0.3 * n_words and n_symbols > 0"),
    ("bangs", -1, "n_bangs >= 0.25 * n_words and n_bangs > 0"),
    ("capitals", -1, "n_upper >= 0.4 * word_chars and n_upper > 0"),
    ("repeats", -1, "n_repeat_words >= 0.45 * n_words and n_repeat_words > 0"),
    ("same_lines", -1, "n_dup_lines >= 0.3 * n_lines and n_dup_lines >= 3"),
    ("few_distinct", -1, "n_distinct * sqrt(greatest(n_words / 500.0D, 1.0D)) <= 0.2 * n_words"),
    ("short_lines", -1, "n_words <= 2 * n_lines"),
    ("long_words", -1, "n_long >= 0.2 * n_words and n_long > 0"),
    ("clean", 1, "n_words > 0 and n_symbols <= 0.02 * word_chars and n_bangs <= 0.1 * n_words"),
    ("calm", 1, "n_words > 0 and n_upper <= 0.25 * word_chars and n_repeat_words <= 0.35 * n_words and n_dup_lines <= greatest(2, 0.2 * n_lines)"),
    ("prose", 1, "n_words >= 4 * n_lines and word_chars between 2.5 * n_words and 15 * n_words"),
]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` with `value` evaluated once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words between ASCII white space."""
    bare = F.btrim(text, F.lit(WHITE))
    return F.when(F.length(bare) > 0, F.split(bare, "[ \\t-\\r]+")).otherwise(F.array().cast("array<string>"))


def _beside(items: Column, k: Column, same: Callable[[Column, Column], Column]) -> Column:
    """Item k equals the item before or behind it."""
    one = F.get(items, k)
    return F.coalesce(same(one, F.get(items, k - 1)), F.lit(False)) | F.coalesce(same(one, F.get(items, k + 1)), F.lit(False))


def repeat_words(words: Column) -> Column:
    """Words in 3-word windows that the text has twice or more, the first included.

    Windows are sorted as hash and place in one long; those with a neighbour of equal hash are compared as strings.
    """
    place = (1 << _PLACE) - 1

    def window(w: Column, i: Column) -> Column:
        return F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))

    def count(w: Column) -> Column:
        coded = F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.shiftleft(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), _PLACE).bitwiseOR(i.cast("long")),
        )

        def same_hash(a: Column, b: Column) -> Column:
            return F.shiftright(a, _PLACE) == F.shiftright(b, _PLACE)

        def exact(codes: Column) -> Column:
            near = F.filter(codes, lambda c, k: _beside(codes, k, same_hash))
            told = F.array_sort(F.transform(near, lambda c: let(c.bitwiseAND(F.lit(place)).cast("int"), lambda i: F.struct(window(w, i).alias("s"), i.alias("i")))))

            def covered(rows: Column) -> Column:
                again = F.filter(rows, lambda r, k: _beside(rows, k, lambda a, b: a["s"] == b["s"]))
                return F.size(F.array_distinct(F.flatten(F.transform(again, lambda r: F.array(r["i"], r["i"] + 1, r["i"] + 2)))))

            return let(told, covered)

        return let(F.sort_array(coded), exact)

    return F.when(F.size(words) >= 3, let(words, count)).otherwise(0).cast("long")


def measured(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """doc_id, `row` (null if not given), the base counts and those of the rules for each row of `docs` (doc_id, text)."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    row = F.lit(None) if row is None else row
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), row.alias("row"), text.alias("text"))
    rows = rows.withColumn("words", words_of(F.col("text")))
    rows = rows.withColumn("lines", F.filter(F.split("text", "\n", -1), lambda x: F.length(F.btrim(x, F.lit(WHITE))) > 0))
    plain = F.col("text")
    for symbol in SYMBOLS:
        plain = F.replace(plain, F.lit(symbol), F.lit(""))
    n_words, n_lines = F.size("words").cast("long"), F.size("lines").cast("long")
    bangs = F.length("text") - F.length(F.replace("text", F.lit("!"), F.lit("")))
    return rows.select(
        "doc_id",
        "row",
        n_words.alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(plain)).cast("long").alias("n_symbols"),
        (n_lines - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).alias("n_repeat_words"),
        n_lines.alias("n_lines"),
        bangs.cast("long").alias("n_bangs"),
        (F.length("text") - F.length(F.regexp_replace("text", "\\p{Lu}+", ""))).cast("long").alias("n_upper"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        F.aggregate("words", F.lit(0), lambda s, w: s + (F.length(w) > 30).cast("int")).cast("long").alias("n_long"),
    )


def votes() -> Column:
    """array<int>: one vote for each rule."""
    return F.array(*[F.when(F.expr(when), vote).otherwise(0) for _, vote, when in RULES])


def estimate(cast: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row (share, chances) from `cast` (votes): the share of good documents and each rule's chances to vote.

    chances is array<struct<good, bad>>. Pseudo-counts, a thousandth of the documents, hold them to the first guess where
    votes are few.
    """
    patterns = cast.groupBy("votes").count()
    table = patterns.agg(F.collect_list(F.struct("votes", F.col("count").cast("double").alias("n"))).alias("rows"), F.sum("count").cast("double").alias("total"))
    for_rule = F.array(*[F.struct(F.lit(g).alias("good"), F.lit(b).alias("bad")) for g, b in ((0.95, 0.4) if vote > 0 else (0.01, 0.3) for _, vote, _ in RULES)])
    init = F.struct(F.lit(0.8).alias("share"), for_rule.alias("chances"))

    def step(model: Column, rows: Column, total: Column) -> Column:
        strength = F.greatest(total / 1000.0, F.lit(1.0))
        told = F.transform(rows, lambda r: F.struct(r["votes"].alias("votes"), r["n"].alias("n"), (r["n"] * _posterior(model["share"], model["chances"], r["votes"])).alias("good")))

        def maximise(t: Column) -> Column:
            good = F.aggregate(t, F.lit(0.0), lambda s, r: s + r["good"])

            def chances(g: Column) -> Column:
                def chance(first: Column, j: Column) -> Column:
                    voted = F.aggregate(
                        t,
                        F.struct(F.lit(0.0).alias("good"), F.lit(0.0).alias("all")),
                        lambda s, r: F.when(F.get(r["votes"], j) == 0, s).otherwise(F.struct((s["good"] + r["good"]).alias("good"), (s["all"] + r["n"]).alias("all"))),
                    )

                    def bounded(v: Column) -> Column:
                        on_good = (v["good"] + strength * first["good"]) / (g + strength)
                        on_bad = (v["all"] - v["good"] + strength * first["bad"]) / (total - g + strength)
                        against = first["good"] < first["bad"]
                        return F.struct(
                            F.when(against, F.least(on_good, on_bad)).otherwise(on_good).alias("good"),
                            F.when(against, on_bad).otherwise(F.least(on_bad, on_good)).alias("bad"),
                        )

                    return let(voted, bounded)

                share = (g + 0.8 * strength) / (total + strength)
                return F.struct(share.alias("share"), F.transform(for_rule, chance).alias("chances"))

            return let(good, chances)

        return let(told, maximise)

    model = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), init, lambda m, _: step(m, F.col("rows"), F.col("total")))
    return table.where("total > 0").select(model.alias("m")).select("m.share", "m.chances")


def _posterior(share: Column, chances: Column, cast: Column) -> Column:
    """Probability of a good document, from log odds."""
    of_rule = F.zip_with(chances, cast, lambda c, v: F.when(v == 0, F.log(1 - c["good"]) - F.log(1 - c["bad"])).otherwise(F.log(c["good"]) - F.log(c["bad"])))
    log_odds = F.aggregate(of_rule, F.log(share) - F.log(1 - share), lambda s, x: s + x)
    return 1 / (1 + F.exp(-log_odds))


def quality(model: Row | None) -> Column:
    """Posterior of `votes` under an estimate; without one there are no documents."""
    if model is None:
        return F.lit(0.0)
    chances = F.array(*[F.struct(F.lit(c["good"]).alias("good"), F.lit(c["bad"]).alias("bad")) for c in model["chances"]])
    return _posterior(F.lit(model["share"]), chances, F.col("votes"))


def base_failed() -> Column:
    """Too few words, or half of them in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judged(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Base counts, base_failed, kept, quality and votes for each row of `docs` (doc_id, text)."""
    rows = materialise(measured(docs).drop("row").withColumn("votes", votes()), "measures")
    model = estimate(rows.select("votes")).first()
    rows = rows.withColumns({"base_failed": base_failed(), "quality": quality(model)})
    counts = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return rows.select(*counts, "base_failed", (~F.col("base_failed") & (F.col("quality") >= threshold)).alias("kept"), "quality", "votes")


def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of `docs` that are kept, all columns as they are.

    They are written once with their votes, so that the texts are measured once.
    """
    rows = materialise(measured(docs, F.struct(*[docs[c] for c in docs.columns])).select("row", "n_words", "n_repeat_words", votes().alias("votes")), "votes")
    kept = rows.where(~base_failed() & (quality(estimate(rows.select("votes")).first()) >= threshold))
    return kept.select("row.*")
