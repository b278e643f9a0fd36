"""Lexicons: building, merging, repairing, looking up and searching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomtext.functions import tables as T, text as X
from loomtext.functions.morphology import stems
from loomtext.functions.script import to_latin
from loomtext.operators.sampling import numbered
from loomtext.scratch import materialise

PREFIX_LENGTH, PREFIX_HITS, SEARCH_LIMIT = 4, 5, 50
# Fixed value: the rank of a gloss that isn't literally the word.
NOT_LITERAL = 99
#: Characters of the runs that keys are found by.
GRAM = 3


def vocabulary(words: DataFrame, least: int = 2, extra: list[str] | None = None) -> DataFrame:
    """(latin, frequency): words (word) that occur `least` times, and `extra` words whatever their count."""
    counted = words.groupBy(F.col("word").alias("latin")).agg(F.count(F.lit(1)).alias("frequency")).where(F.col("frequency") >= least)
    if not extra:
        return counted
    more = words.sparkSession.createDataFrame([(w,) for w in sorted(set(extra))], "latin string").join(counted, "latin", "left_anti")
    return counted.unionByName(more.withColumn("frequency", F.lit(0).cast("long")))


def max_frequency(rows: DataFrame) -> DataFrame:
    """(latin, frequency): the largest count of each key of rows (latin, frequency)."""
    return rows.groupBy("latin").agg(F.max("frequency").alias("frequency"))


def lookup_exact(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(word, latin, frequency): words whose lower-case key is a headword."""
    keyed = lexicon.withColumn("key", F.lower(F.btrim("latin")))
    w = words.select("word").distinct().withColumn("key", F.lower(F.btrim("word")))
    return w.join(keyed, "key").select("word", "latin", "frequency")


def lookup_prefix(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(word, place, latin, frequency): for words of 4 characters or more, the 5 first headwords that they begin.

    Each headword stands under its own prefixes, so that an equality join finds them; shorter headwords first, then more
    frequent ones, then by spelling.
    """
    spread = lexicon.where(F.length("latin") >= PREFIX_LENGTH).select(
        "latin", "frequency", F.explode(F.transform(F.sequence(F.lit(PREFIX_LENGTH), F.length("latin")), lambda n: F.substring(F.col("latin"), F.lit(1), n))).alias("word")
    )
    hits = words.select("word").distinct().where(F.length("word") >= PREFIX_LENGTH).join(spread, "word")
    order = Window.partitionBy("word").orderBy(F.length("latin"), F.desc("frequency"), "latin")
    return hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= PREFIX_HITS).select("word", "place", "latin", "frequency")


def lookup_gloss(words: DataFrame, lexicon: DataFrame, hits: int = PREFIX_HITS) -> DataFrame:
    """(word, place, latin, rank): headwords with the word among their glosses, by the gloss's position, then frequency.

    A gloss that is the word only when it is trimmed has the rank NOT_LITERAL, behind all that are it as they are.
    """
    glosses = lexicon.select("latin", "frequency", F.posexplode("english").alias("at", "gloss")).withColumn("word", F.lower(F.btrim("gloss")))
    glosses = glosses.withColumn("rank", F.when(F.lower("gloss") == F.col("word"), F.col("at")).otherwise(NOT_LITERAL))
    met = words.select("word").distinct().join(glosses, "word").groupBy("word", "latin", "frequency").agg(F.min("rank").alias("rank"))
    order = Window.partitionBy("word").orderBy("rank", F.desc("frequency"), "latin")
    return met.withColumn("place", F.row_number().over(order)).where(F.col("place") <= hits).select("word", "place", "latin", "rank")


def _heads(lexicon: DataFrame) -> DataFrame:
    """(key, head): the entry of each lower-case headword, the most frequent one where it has several."""
    entry = F.struct("frequency", F.col("latin").alias("latin"), (F.col("english") if "english" in lexicon.columns else F.lit(None).cast("array<string>")).alias("english"))
    return lexicon.groupBy(F.lower(F.btrim("latin")).alias("key")).agg(F.max_by(entry, F.struct("frequency", F.col("latin"))).alias("head"))


def gloss_of(english: Column, latin: Column, word: Column) -> Column:
    """The first gloss; the headword, else the word itself, where there is none or only a placeholder."""
    first = F.get(english, F.lit(0))
    return F.when((first != "") & ~F.startswith(first, F.lit("[unknown:")), first).otherwise(F.coalesce(F.nullif(latin, F.lit("")), word))


def latin_value(stem: Column, transliteration: Column, latin: Column, word: Column) -> Column:
    """A word in Latin letters: its stem, else its transliteration, else the first headword found, else itself."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in (stem, transliteration, latin)], word)


def _closed(words: DataFrame, table: dict[str, str]) -> DataFrame:
    return F.broadcast(words.sparkSession.createDataFrame(sorted(table.items()), "key string, closed string"))  # a fixed table


def translate_words(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(word, found, latin, gloss, confidence, fallback, transliteration, stem, suffixes, case_gloss) for each distinct word.

    Words in ASCII: the first of an exact hit, the closed class, a stem that is a headword, a headword that the word begins;
    the last one is a guess of low confidence. Words in Thaana are read out first and have only exact and begun headwords,
    one level of confidence lower. What isn't found is named unknown, not guessed.
    """
    each = words.select("word").distinct().withColumn("ascii", ~F.rlike("word", F.lit("[^\\x00-\\x7f]")))
    read = F.when(F.col("ascii"), F.col("word")).otherwise(to_latin(F.col("word")))
    each = each.withColumn("transliteration", read).withColumn("key", F.lower(F.btrim("transliteration")))
    heads = _heads(lexicon)
    plain = each.where("ascii").select(F.col("key").alias("word")).distinct()
    stem = stems(plain, lexicon).where(F.col("root") != F.col("word")).select(F.col("word").alias("key"), "root", "suffixes", F.array_join("hints", " ").alias("case_gloss"))
    stem = stem.join(heads.select(F.col("key").alias("root"), F.col("head").alias("stem_head")), "root")
    begun = lookup_prefix(each.select(F.col("key").alias("word")), lexicon).where("place = 1").select(F.col("word").alias("key"), F.lower(F.btrim("latin")).alias("longer"))
    begun = begun.join(heads.select(F.col("key").alias("longer"), F.col("head").alias("begun_head")), "longer").drop("longer")
    met = each.join(heads, "key", "left").join(_closed(words, T.CLOSED_LATIN), "key", "left").join(stem, "key", "left").join(begun, "key", "left")
    curated, own = F.col("ascii") & F.col("closed").isNotNull(), F.col("ascii")
    found = (
        F.when(F.col("head").isNotNull(), "exact").when(curated, "closed_class").when(own & F.col("stem_head").isNotNull(), "stem")
        .when(F.col("begun_head").isNotNull(), "prefix").otherwise("unknown")
    )
    met = met.withColumn("found", found)
    kind = F.col("found")
    entry = F.when(kind == "exact", F.col("head")).when(kind == "stem", F.col("stem_head")).when(kind == "prefix", F.col("begun_head"))
    latin = F.when(kind == "closed_class", F.col("word")).when(kind == "unknown", F.col("transliteration")).otherwise(entry["latin"])
    unknown = F.array(F.concat(F.lit("[unknown: "), "transliteration", F.lit("]")))
    english = F.when(kind == "closed_class", F.array("closed")).when(kind == "unknown", unknown).otherwise(entry["english"])
    sure = F.when(own, "high").otherwise("medium")
    fallback = F.when(kind == "unknown", "transliteration_only").when(~own, "transliteration_lookup").when(kind.isin("closed_class", "prefix"), kind)
    by_stem = kind == "stem"
    root = F.when(by_stem, F.col("root"))
    told = {
        "found": kind, "latin": latin, "gloss": gloss_of(english, latin, F.col("word")), "confidence": F.when(kind.isin("prefix", "unknown"), "low").otherwise(sure), "fallback": fallback,
        "transliteration": latin_value(root, F.col("transliteration"), latin, F.col("word")), "stem": root, "suffixes": F.when(by_stem, F.col("suffixes")), "case_gloss": F.when(by_stem, F.col("case_gloss")),
    }
    return met.select("word", *[c.alias(k) for k, c in told.items()])


def translate_english(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """As translate_words(), from English: the closed class, which only an exact headword may replace, then the glosses."""
    each = words.select("word").distinct().withColumn("key", F.lower(F.btrim("word")))
    heads = _heads(lexicon).select(F.col("key").alias("closed"), "head")
    glossed = lookup_gloss(each.select(F.col("key").alias("word")), lexicon, 1).select(F.col("word").alias("key"), F.lower(F.btrim("latin")).alias("by_gloss"))
    glossed = glossed.join(_heads(lexicon).select(F.col("key").alias("by_gloss"), F.col("head").alias("gloss_head")), "by_gloss")
    met = each.join(_closed(words, T.CLOSED_ENGLISH), "key", "left").join(heads, "closed", "left").join(glossed, "key", "left")
    curated = F.col("closed").isNotNull()
    met = met.withColumn("found", F.when(curated & F.col("head").isNotNull(), "exact").when(curated, "closed_class").when(F.col("gloss_head").isNotNull(), "gloss").otherwise("unknown"))
    kind = F.col("found")
    entry = F.when(kind == "exact", F.col("head")).when(kind == "gloss", F.col("gloss_head"))
    latin = F.when(kind == "closed_class", F.col("closed")).when(kind == "unknown", F.concat(F.lit("[unknown: "), "word", F.lit("]"))).otherwise(entry["latin"])
    none = F.lit(None).cast("string")
    told = {
        "found": kind, "latin": latin, "gloss": gloss_of(F.when(entry.isNotNull(), entry["english"]).otherwise(F.array("word")), latin, F.col("word")),
        "confidence": F.when(kind == "unknown", "low").otherwise("high"), "fallback": F.when(kind == "unknown", "unknown_english").when(kind == "closed_class", kind),
        "transliteration": F.when(curated, F.col("closed")).otherwise(entry["latin"]), "stem": none, "suffixes": F.lit(None).cast("array<string>"), "case_gloss": none,
    }
    return met.select("word", *[c.alias(k) for k, c in told.items()])


def search(lexicon: DataFrame, needle: str, limit: int = SEARCH_LIMIT) -> DataFrame:
    """(latin, kind, side, total): entries whose headword or a gloss contains the needle; exact before prefix before contained.

    `total` counts all hits, beyond the limit too.
    """
    text = needle.strip().lower()

    def kind(c: Column) -> Column:
        low = F.lower(c)
        return F.when(low == text, 0).when(F.startswith(low, F.lit(text)), 1).when(F.contains(low, F.lit(text)), 2)

    own, gloss = kind(F.col("latin")), F.array_min(F.filter(F.transform("english", kind), lambda k: k.isNotNull()))
    hits = lexicon.select("latin", own.alias("own"), gloss.alias("gloss")).where((F.lit(text) != "") & (F.col("own").isNotNull() | F.col("gloss").isNotNull()))
    best = F.least("own", "gloss")
    shown = hits.select("latin", best.alias("kind"), F.when(F.col("own") == best, "headword").otherwise("gloss").alias("side"))
    top = shown.orderBy("kind", F.desc("side"), F.length("latin"), "latin").limit(limit)
    return top.crossJoin(F.broadcast(shown.agg(F.count(F.lit(1)).alias("total"))))


def _grams(key: Column, n: int) -> Column:
    """The distinct runs of `n` characters of a key."""
    starts = F.when(F.length(key) >= n, F.sequence(F.lit(1), F.length(key) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(key, i, F.lit(n))))


def contained(needles: DataFrame, keys: DataFrame) -> DataFrame:
    """(needle, key) for each distinct `needles` (needle) and `keys` (key) of which the key contains the needle.

    Keys stand under each of their runs of GRAM characters, a needle is looked up under the one of its own that the fewest
    keys have, and what shares it is compared. Shorter needles are a run by themselves: keys stand under runs of one and
    two characters, too. So all joins are of equal runs; no needle is held against all keys.
    """
    asked = materialise(needles.select("needle").where("needle <> ''").distinct(), "needles")
    known = keys.select("key").where("key <> ''").distinct()
    runs = F.flatten(F.array(*[_grams(F.col("key"), n) for n in range(1, GRAM + 1)]))
    posted = materialise(known.select("key", F.explode(runs).alias("gram")), "postings")
    often = posted.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    own = asked.select("needle", F.explode(F.when(F.length("needle") < GRAM, F.array("needle")).otherwise(_grams(F.col("needle"), GRAM))).alias("gram"))
    # a run that no key has: no key contains the needle
    rarest = own.join(often, "gram", "left").groupBy("needle").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    return rarest.join(posted, "gram").where(F.contains("key", F.col("needle"))).select("needle", "key")


def search_many(needles: DataFrame, lexicon: DataFrame, limit: int = SEARCH_LIMIT) -> DataFrame:
    """(needle, place, latin, kind, side, total): search() for each of `needles` (needle), which share one pass over the lexicon.

    Needles are trimmed and in lower case, empty and null ones find nothing. Rows of one headword are one hit.
    """
    asked = needles.select(F.lower(F.btrim("needle")).alias("needle")).distinct()
    sides = F.transform("english", lambda g: F.struct(F.lit(1).alias("at"), F.lower(g).alias("key")))
    keyed = lexicon.select("latin", F.inline(F.concat(F.array(F.struct(F.lit(0).alias("at"), F.lower("latin").alias("key"))), F.coalesce(sides, F.array()))))
    keyed = materialise(keyed.where("key <> ''").distinct(), "keys")
    kind = F.when(F.col("key") == F.col("needle"), 0).when(F.startswith("key", F.col("needle")), 1).otherwise(2)
    hits = contained(asked, keyed).withColumn("kind", kind).join(keyed, "key")
    best = hits.groupBy("needle", "latin").agg(F.min(F.struct("kind", "at")).alias("b"))
    shown = materialise(best.select("needle", "latin", "b.kind", F.when(F.col("b.at") == 0, "headword").otherwise("gloss").alias("side")), "hits")
    totals = shown.groupBy("needle").agg(F.count(F.lit(1)).alias("total"))
    order = Window.partitionBy("needle").orderBy("kind", F.desc("side"), F.length("latin"), "latin")
    top = shown.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)
    return top.join(totals, "needle").select("needle", "place", "latin", "kind", "side", "total")


def merge_sources(rows: DataFrame) -> DataFrame:
    """(latin, english, pos, frequency) from (latin, english, pos, frequency, source): the base source's part of speech unless weak.

    Glosses of all sources in the order of source and position, the first spelling of each; placeholders are left out. If
    `rows` has dhivehi and verified (of its spelling), a verified spelling goes before others, then the first source's.
    """
    gloss = rows.select("latin", "source", F.posexplode("english").alias("at", "gloss")).where(~F.startswith("gloss", F.lit("[unknown:")))
    first = gloss.groupBy("latin", F.lower("gloss").alias("folded")).agg(F.min(F.struct("source", "at", "gloss")).alias("g"))
    listed = first.groupBy("latin").agg(F.transform(F.array_sort(F.collect_list("g")), lambda g: g["gloss"]).alias("english"))
    strong = F.when(~X.canonical_pos(F.col("pos")).isin(*T.WEAK_POS), F.struct("source", X.canonical_pos(F.col("pos")).alias("pos")))
    aggs = [F.max("frequency").alias("frequency"), F.min(strong).alias("p")]
    spelled = "dhivehi" in rows.columns
    if spelled:
        aggs.append(F.min(F.when(F.col("dhivehi") != "", F.struct(~F.coalesce("verified", F.lit(False)), "source", F.col("dhivehi").alias("dhivehi")))).alias("d"))
    pos = F.coalesce(F.col("p.pos"), F.lit("unknown"))
    met = rows.groupBy("latin").agg(*aggs).join(listed, "latin", "left")
    more = [F.col("d.dhivehi").alias("dhivehi")] if spelled else []
    return met.select("latin", F.coalesce("english", F.array().cast("array<string>")).alias("english"), pos.alias("pos"), "frequency", *more)


def export_order(lexicon: DataFrame, by: str = "frequency") -> DataFrame:
    """The lexicon as it is exported: the most frequent first, then by lower-case headword; or by headword alone."""
    key = [F.lower("latin"), F.col("latin")]
    return lexicon.orderBy(F.desc(F.coalesce("frequency", F.lit(0))), *key) if by == "frequency" else lexicon.orderBy(*key)


def export_places(lexicon: DataFrame) -> DataFrame:
    """(latin, frequency, place) in the order of export, from 1: places within ranges plus what lies before, in no one task."""
    order = F.struct((-F.coalesce("frequency", F.lit(0))).alias("f"), F.lower("latin").alias("low"), F.col("latin").alias("latin"))
    placed = numbered(lexicon.select("latin", "frequency", order.alias("order")), "order")
    return placed.select("latin", "frequency", (F.col("place") + 1).alias("place"))


def rewrite_expanded(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repaired entries (latin, english, pos, frequency) and rewrites (old, new) of rows (place, latin, english, pos, frequency).

    Inverted rows change sides, with each of their glosses' keys as an entry; malformed headwords stand under each key
    they hold; corrupt ones are quarantined: rewritten to nothing (new is empty). Rows that end under one key merge: glosses
    in the order of `place`, the first part of speech, the largest frequency. That of closed-class words is fixed.
    """
    kind, own = X.headword_class(F.col("latin"), F.col("english")), X.normal_key(F.col("latin"))
    shown = F.filter("english", lambda g: F.btrim(g) != "")

    def keys_of(gloss: Column) -> Column:
        return X.let(X.split_keys(gloss), lambda k: F.when(F.size(k) > 0, k).otherwise(F.array(X.normal_key(gloss))))

    told = rows.select("place", own.alias("old"), kind.alias("kind"), "pos", "frequency", F.btrim("latin").alias("gloss"), shown.alias("shown"))
    keys = F.when(F.col("kind") == "inverted", F.flatten(F.transform("shown", keys_of))).when(F.col("kind") == "malformed", X.split_keys(F.col("gloss")))
    keys = keys.when(F.col("kind") == "corrupt", F.array().cast("array<string>")).otherwise(F.array("old"))
    told = told.withColumns({"keys": keys, "english": F.when(F.col("kind") == "inverted", F.array("gloss")).otherwise(F.col("shown"))})
    changed = told.where("kind <> 'clean'").select("old", F.explode(F.when(F.size("keys") > 0, F.col("keys")).otherwise(F.array(F.lit("")))).alias("new")).distinct()
    each = told.select("place", F.posexplode("keys").alias("nth", "latin"), "english", "pos", "frequency")
    gloss = each.select("latin", "place", "nth", F.posexplode("english").alias("at", "gloss")).groupBy("latin", F.lower("gloss").alias("folded")).agg(F.min(F.struct("place", "nth", "at", "gloss")).alias("g"))
    listed = gloss.groupBy("latin").agg(F.transform(F.array_sort(F.collect_list("g")), lambda g: g["gloss"]).alias("english"))
    heads = each.groupBy("latin").agg(F.min_by(F.coalesce("pos", F.lit("unknown")), F.struct("place", "nth")).alias("pos"), F.max(F.coalesce("frequency", F.lit(0))).alias("frequency"))
    fixed = F.create_map(*[F.lit(x) for kv in T.POS_OVERRIDES.items() for x in kv])
    pos = F.coalesce(F.try_element_at(fixed, F.col("latin")), F.col("pos")).alias("pos")
    entries = heads.join(listed, "latin", "left").select("latin", F.coalesce("english", F.array().cast("array<string>")).alias("english"), pos, "frequency")
    return entries, changed


def resolved(keys: DataFrame, rewrites: DataFrame, entries: DataFrame) -> DataFrame:
    """(latin, resolves) of each of `keys` (latin): an entry has it, or one of its rewrites (old, new: many for one) leads there.

    A key rewritten to nothing is quarantined on purpose and resolves. All keys that resolve are found from the ends
    backwards, a step of all chains in each round, until a round adds none; circles so never resolve.
    """
    there = materialise(entries.select("latin").unionAll(rewrites.where("new = ''").select(F.col("old").alias("latin"))).distinct(), "resolved")
    steps = rewrites.where("new <> ''").select("old", "new").distinct()
    fresh = there
    while True:
        more = steps.join(fresh, steps["new"] == fresh["latin"]).select(F.col("old").alias("latin")).distinct()
        fresh = materialise(more.join(there, "latin", "left_anti"), "resolved")
        if fresh.isEmpty():
            break
        there = there.unionAll(fresh)
    return keys.select("latin").distinct().join(there.withColumn("there", F.lit(True)), "latin", "left").select("latin", F.coalesce("there", F.lit(False)).alias("resolves"))


def raise_frequency(lexicon: DataFrame, corpus: DataFrame) -> DataFrame:
    """Lexicon rows with the corpus's count where it is larger, and `freq_source` that says so."""
    seen = max_frequency(corpus).withColumnRenamed("frequency", "seen")
    larger = F.coalesce(F.col("seen") > F.col("frequency"), F.lit(False))
    return lexicon.join(seen, "latin", "left").withColumns({"freq_source": F.when(larger, "corpus"), "frequency": F.when(larger, F.col("seen")).otherwise(F.col("frequency"))}).drop("seen")


def mirror_pairs(glosses: DataFrame) -> DataFrame:
    """(loser, winner, verdict) from (latin, gloss, frequency, n_glosses): pairs that gloss each other.

    One simultaneous round: the less frequent one is fixed if the other is its only gloss, else the pair is for review; a
    tie has its names in order.
    """
    a, b = glosses.alias("a"), glosses.alias("b")
    met = a.join(b, (F.col("a.gloss") == F.col("b.latin")) & (F.col("b.gloss") == F.col("a.latin")) & (F.col("a.latin") < F.col("b.latin")))
    lower = F.col("a.frequency") < F.col("b.frequency")
    tie = F.col("a.frequency") == F.col("b.frequency")
    alone = F.when(lower, F.col("a.n_glosses")).otherwise(F.col("b.n_glosses")) == 1
    loser = F.when(tie | lower, F.col("a.latin")).otherwise(F.col("b.latin"))
    winner = F.when(tie | lower, F.col("b.latin")).otherwise(F.col("a.latin"))
    return met.select(loser.alias("loser"), winner.alias("winner"), F.when(tie, "tie").when(alone, "fixed").otherwise("review").alias("verdict")).distinct()


def repair_mirrors(lexicon: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries (latin, english) after repairs, and what was done (latin, other, verdict), for entries (place, latin, english, frequency).

    Entries are looked at in the order of `place`. The first gloss of one that is another entry, which has the one among
    its glosses, decides: the less frequent of the two takes the other's glosses if it has no gloss but the other (fixed;
    `latin` is the loser), else the pair is for review (latin < other), as it is if they are as frequent. A repair is seen
    by all that come later. Keys of `latin` are one row each, as normal_key() gives them.

    That is order-dependent, but only nearby: an entry reads and changes itself and what it glosses. So in each round all
    entries are looked at that come before every other waiting one within three steps over glosses, in either direction.
    Two such are four steps apart, so neither sees the other's doing; and what comes earlier but lies further off can
    bring a link no nearer than four steps, as a repair only gives an entry the glosses of its neighbour. The result is
    that of the plain loop. Entries that no repair can reach wait for nothing.
    """
    key = lambda g: X.normal_key(g)
    state = lexicon.select("place", "latin", "frequency", "english", F.transform("english", key).alias("keys"))
    known = materialise(state.select("latin"), "known")
    state = materialise(state.withColumn("waits", F.size("english") > 0), "mirrors")
    done: list[DataFrame] = []
    while True:
        steps = state.select(F.col("latin").alias("a"), F.posexplode("keys").alias("at", "b")).where("a <> b").join(known.withColumnRenamed("latin", "b"), "b", "left_semi")
        steps = materialise(steps.groupBy("a", "b").agg(F.min("at").alias("at")), "steps")
        pairs = steps.join(steps.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"])
        ways = steps.select("a", "b").unionAll(steps.select("b", "a")).distinct()
        # who may take part: has a mirror, or is next to an entry with nothing but one gloss, whose glosses may change
        single = state.where(F.size(F.array_distinct("keys")) == 1).select(F.col("latin").alias("a"))
        part = pairs.select("a").unionAll(ways.join(single, "a", "left_semi").select(F.col("b").alias("a"))).distinct()
        waiting = state.where("waits").join(part, state["latin"] == part["a"], "left_semi").select(F.col("latin").alias("a"), F.col("place").alias("least"), "place")
        if waiting.isEmpty():
            break
        near = waiting.select("a", "least")
        for _ in range(3):
            over = ways.join(near, "a").select(F.col("b").alias("a"), "least").unionAll(near)
            near = over.groupBy("a").agg(F.min("least").alias("least"))
        now = waiting.select("a", "place").join(near, "a").where("place = least").select("a")
        first = pairs.join(now, "a").groupBy("a").agg(F.min_by("b", "at").alias("b"))
        entry = lambda c: state.select(F.col("latin").alias(c), F.col("frequency").alias(f"f_{c}"), F.col("english").alias(f"e_{c}"), F.col("keys").alias(f"k_{c}"))  # noqa: B023, E731
        met = first.join(entry("a"), "a").join(entry("b"), "b")
        lower = F.col("f_a") < F.col("f_b")
        loser, winner = (F.when(lower, F.col(x)).otherwise(F.col(y)) for x, y in (("a", "b"), ("b", "a")))
        stub = F.forall(F.when(lower, F.col("k_a")).otherwise(F.col("k_b")), lambda k: k == winner)
        fixed = (F.col("f_a") != F.col("f_b")) & stub
        told = met.select(
            F.when(fixed, loser).otherwise(F.least("a", "b")).alias("latin"), F.when(fixed, winner).otherwise(F.greatest("a", "b")).alias("other"), F.when(fixed, "fixed").otherwise("review").alias("verdict"),
            F.when(fixed, F.when(lower, F.col("e_b")).otherwise(F.col("e_a"))).alias("given"),
        )
        told = materialise(told, "repairs")
        done.append(told.select("latin", "other", "verdict"))
        given = told.where("verdict = 'fixed'").select(F.col("latin").alias("to"), "given")
        after = state.join(given, state["latin"] == given["to"], "left").join(now.withColumn("looked", F.lit(True)), F.col("latin") == F.col("a"), "left")
        english = F.coalesce("given", "english")
        state = materialise(after.select("place", "latin", "frequency", english.alias("english"), F.transform(english, key).alias("keys"), (F.col("waits") & F.col("looked").isNull()).alias("waits")), "mirrors")
    none = lexicon.sparkSession.createDataFrame([], "latin string, other string, verdict string")
    every = none
    for more in done:
        every = every.unionAll(more)
    return state.select("latin", "english"), every.distinct()


def closure(rewrites: DataFrame) -> DataFrame:
    """(old, final, steps) from rewrites (old, new), one for a key: where each key ends; null if it is quarantined or runs in a circle.

    Chains double in length each round: what a key leads to is looked up in what that leads to, until no key moves or all
    that still move have gone further than there are keys, which only circles do.
    """
    hops = materialise(rewrites.select("old", F.col("new").alias("final"), F.lit(1).cast("long").alias("steps")), "hops")
    n = hops.count()
    while True:
        nxt = hops.select(F.col("old").alias("via"), F.col("final").alias("onward"), F.col("steps").alias("more"))
        met = hops.join(nxt, hops["final"] == nxt["via"], "left")
        hops = materialise(met.select("old", F.when(F.col("via").isNull(), F.col("final")).otherwise(F.col("onward")).alias("final"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("via").isNotNull().alias("moved")), "hops")
        if hops.where((F.col("moved")) & (F.col("steps") <= n)).isEmpty():
            break
        hops = hops.drop("moved")
    circle = F.col("steps") > n
    return hops.select("old", F.when(~circle & (F.col("final") != ""), F.col("final")).alias("final"), F.when(~circle, F.col("steps")).alias("steps"))


def collisions(pairs: DataFrame, between: str = "") -> DataFrame:
    """(reading, canonical, n, members) from (letter, reading, place): readings that several letters, or words, share."""
    g = pairs.groupBy("reading").agg(F.min_by("letter", "place").alias("canonical"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("place", "letter"))).alias("m"))
    return g.where("n > 1").select("reading", "canonical", "n", F.array_join(F.transform("m", lambda x: x["letter"]), between).alias("members"))


def lost_keys(old: DataFrame, new: DataFrame) -> DataFrame:
    """Keys (latin) of `old` that `new` lacks."""
    return old.select("latin").distinct().join(new.select("latin"), "latin", "left_anti")
