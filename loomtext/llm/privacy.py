"""Operator 6: personal data and the terms that reveal it, in DataFrame functions only.

Base spans are e-mail addresses, IP addresses, card and phone numbers. Each found value is a protected entity, and so is
the group it belongs to (an address's domain, a network of 256, a card's issuer, a phone number's first digits). An
entity's context is what stands within REACH code points of it in its line. A term's disclosure of an entity is its
pointwise mutual information with it by the information of the entity itself, from counts of lines over all documents:

    share = 1 + log2 p(entity | term) / information(entity),  p = n_both / (n_term + 1),  information = -log2(n_entity / n_lines)

where n_both are the lines in which the term is in the entity's context. The 1 smooths what few lines tell. From DISCLOSES
on a term discloses the entity, if it met it in SUPPORT contexts or more that aren't near copies of each other (Jaccard
likeness of 0.8 or more of their terms, directly or over others that have the term), and in so many that, were words
dealt out at random, CHANCE of all tried pairs would be expected to do so (Chernoff bound of the Poisson tail). So a word
that is met once discloses nothing. Terms that disclose an entity are generalised to a placeholder; those with a p of
SURE or more are removed. p is of counts alone: the same lines in a larger table remove the same terms.

Defined results: a null text is empty; base spans of different kinds may overlap, a term span never overlaps a base span;
ends are exclusive and count code points; a term's spans are all its places in all texts, whatever their case; repeated
rows give repeated results and count as often as they come; a null doc_id stays null; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from loomtext.llm.likeness import LIKE, like_components
from loomtext.llm.names import unused
from loomtext.llm.quality import let
from loomtext.llm.scratch import materialise, passing

#: Contexts that a term met an entity in at least, and how many pairs may belong together by chance.
SUPPORT, CHANCE = 2, 0.05
#: The share from which a term is generalised, and the chance of the entity given the term from which it is removed.
DISCLOSES, SURE = 0.9, 0.9
#: Code points on either side of an entity that are its context.
REACH = 100
#: Terms that are broadcast at once to be looked up in texts; more are looked up in several passes.
FEW_TERMS = 500_000

#: Kinds in the order that ties at one start follow. Possessive forms of the contract's patterns: what follows a repeated
#: class is never in the class, so nothing is given back; a match fails at every later start of its run, so runs are tried
#: at their beginning, or where the match before ended.
PATTERNS: dict[str, str] = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Terms: runs of letters, marks and digits, of any length.
_WORD = r"[\p{L}\p{M}\p{N}]+"
_MAY_HOLD = {"email": "@", "ip": ".", "card": "", "phone": "+"}
_SPANS = "array<struct<start:int,end:int>>"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """The digit sum with every second digit from the right doubled is a multiple of 10."""
    places = F.sequence(F.lit(0), F.length(digits) - 1)

    def worth(i: Column) -> Column:
        digit = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, digit).when(digit > 4, 2 * digit - 9).otherwise(2 * digit)

    return F.aggregate(F.transform(places, worth), F.lit(0), lambda s, x: s + x) % 10 == 0


def accepted(kind: str, match: Column) -> Column:
    """What a match must be besides its pattern."""
    if kind == "ip":
        bare = F.transform(F.split(match, r"\."), lambda p: F.ltrim(p, F.lit("0")))
        return F.forall(bare, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.when(F.length(_digits(match)).between(12, 19), _luhn(_digits(match))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


def spans_of(text: Column, pattern: str, ok: Callable[[Column], Column]) -> Column:
    """array<struct<start, end>> of the accepted matches: what lies between matches and the matches add up to places."""
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.arrays_zip(between.alias("gap"), found.alias("match"))
    init = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        end = start + F.length(x["match"])
        grown = F.when(ok(x["match"]), F.concat(state["out"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(state["out"])
        return F.struct(end.alias("at"), grown.alias("out"))

    return F.aggregate(F.filter(steps, lambda x: x["match"].isNotNull()), init, step, lambda s: s["out"])


def _base_of_kind(text: Column, kind: str) -> Column:
    found = spans_of(text, PATTERNS[kind], lambda m: accepted(kind, m))
    may = F.contains(text, F.lit(_MAY_HOLD[kind])) if _MAY_HOLD[kind] else F.rlike(text, F.lit("[0-9][ -]?[0-9]"))
    told = F.when(may, found).otherwise(F.array().cast(_SPANS))
    place = F.lit(list(PATTERNS).index(kind))
    return F.transform(told, lambda s: F.struct(s["start"].alias("start"), place.alias("place"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def base_spans(text: Column) -> Column:
    """array<struct<start, place, kind, end>> of all kinds, by start, then kind."""
    return F.array_sort(F.concat(*[_base_of_kind(text, kind) for kind in PATTERNS]))


def _named(kind: str, match: Column) -> Column:
    """array<string>: the entity that a match stands for, and its group."""
    if kind == "email":
        low = F.lower(match)
        return F.array(F.concat(F.lit("email:"), low), F.concat(F.lit("domain:"), F.substring_index(low, "@", -1)))
    if kind == "ip":
        return F.array(F.concat(F.lit("ip:"), match), F.concat(F.lit("net:"), F.substring_index(match, ".", 3)))
    head = 6 if kind == "card" else 5
    return F.array(F.concat(F.lit(f"{kind}:"), _digits(match)), F.concat(F.lit(f"{kind}s:"), F.left(_digits(match), F.lit(head))))


def entities_of(kind: Column, match: Column) -> Column:
    """The entities of a match of any kind."""
    out = None
    for k in PATTERNS:
        out = F.when(kind == k, _named(k, match)) if out is None else out.when(kind == k, _named(k, match))
    return out


def masked(text: Column, spans: Column | None = None) -> Column:
    """The text with spaces in place of its base spans; all else stays where it is."""
    init = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        start = F.greatest(state["at"], s["start"])
        out = F.concat(state["out"], F.substring(text, state["at"] + 1, start - state["at"]), F.repeat(F.lit(" "), s["end"] - start))
        return F.when(s["end"] > state["at"], F.struct(s["end"].alias("at"), out.alias("out"))).otherwise(state)

    spans = base_spans(text) if spans is None else spans
    bare = F.aggregate(spans, init, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(F.rlike(text, F.lit("[0-9@]")), bare).otherwise(text)


def _terms(bare: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(bare), F.lit(_WORD), F.lit(0)))


def terms_of(line: Column) -> Column:
    """Distinct lower-case terms of a line outside its base spans."""
    return _terms(masked(line))


def _context(bare: Column, s: Column) -> Column:
    """The text around a span in a masked line, without the terms that REACH cuts."""
    from_ = F.greatest(s["start"] - REACH, F.lit(0))
    left, right = F.substring(bare, from_ + 1, s["start"] - from_), F.substring(bare, s["end"] + 1, F.lit(REACH))
    cut_left = F.when(F.rlike(F.substring(bare, from_, F.lit(1)), F.lit(_WORD)) & (from_ > 0), F.regexp_replace(left, f"^{_WORD}", "")).otherwise(left)
    cut_right = F.when(F.rlike(F.substring(bare, s["end"] + 1 + REACH, F.lit(1)), F.lit(_WORD)), F.regexp_replace(right, f"{_WORD}$", "")).otherwise(right)
    return F.concat(cut_left, F.lit(" "), cut_right)


def contexts_of(line: Column) -> Column:
    """array<struct<entity, terms>>: each entity of a line, once, with the sorted terms of all its contexts there."""

    def of_spans(spans: Column) -> Column:
        def told(bare: Column) -> Column:
            each = F.transform(
                spans,
                lambda s: F.struct(entities_of(s["kind"], F.substring(line, s["start"] + 1, s["end"] - s["start"])).alias("names"), _context(bare, s).alias("around")),
            )

            def met(found: Column) -> Column:
                names = F.array_distinct(F.flatten(F.transform(found, lambda x: x["names"])))

                def one(name: Column) -> Column:
                    around = F.array_join(F.transform(F.filter(found, lambda x: F.array_contains(x["names"], name)), lambda x: x["around"]), " ")
                    return F.struct(name.alias("entity"), F.array_sort(_terms(around)).alias("terms"))

                return F.transform(names, one)

            return let(each, met)

        return let(masked(line, spans), told)

    return let(base_spans(line), of_spans)


def examined(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, base (spans), n_lines, and where there are base spans the text, contexts (of all lines) and terms, for each row."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text")).withColumn("base", base_spans(F.col("text")))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.rlike(x, F.lit("[0-9@]")))
    some = F.size("base") > 0
    contexts = F.when(some, F.flatten(F.transform(lines, contexts_of)))
    terms = F.when(some, _terms(masked(F.col("text"), F.col("base"))))
    n_lines = F.size(F.split("text", "\n", -1)).cast("long")
    return rows.select("doc_id", F.xxhash64("text").alias("text_hash"), "base", F.when(some, F.col("text")).alias("held"), contexts.alias("contexts"), terms.alias("terms"), n_lines.alias("n_lines"))


def supported(contexts: DataFrame, pairs: DataFrame) -> DataFrame:
    """For `pairs` (entity, term): (entity, term, support), the entity's contexts with the term that aren't near copies of each other.

    Only contexts (entity, terms) that have the term are held against each other. Like ones share a term among the rarest
    fifth of their terms (the prefix of a set join), so all like pairs are compared.
    """
    lines = contexts.join(pairs.select("entity").distinct(), "entity", "left_semi").distinct()
    lines = materialise(lines.withColumn("line", F.xxhash64("entity", "terms")), "lines")
    met = lines.select("line", "entity", F.explode("terms").alias("term")).join(pairs.select("entity", "term").distinct(), ["entity", "term"])
    met = met.select("line", "entity", "term", F.xxhash64("entity", "term").alias("pair"), F.xxhash64("line", "term").alias("node"))
    met = materialise(met, "supporting")
    sets = materialise(met.select("line", "pair", "node").join(lines.select("line", F.col("terms").alias("items")), "line").drop("line"), "contexts")
    words = sets.select("pair", "node", F.explode("items").alias("word"))
    often = words.groupBy("pair", "word").agg(F.count(F.lit(1)).alias("c"))
    order = words.join(often, ["pair", "word"]).groupBy("pair", "node").agg(F.array_sort(F.collect_list(F.struct("c", "word"))).alias("o"))  # a context's terms
    size = F.size("o")
    prefix = F.slice("o", 1, (size - F.ceil(size * LIKE[0] / LIKE[1]) + 1).cast("int"))
    keys = order.select("pair", "node", F.inline(prefix)).where("c > 1").select(F.xxhash64("pair", "word").alias("key"), "node")
    roots = like_components(keys, sets.select("node", "items"))
    told = met.join(roots, "node", "left").select("entity", "term", F.coalesce("root", "node").alias("context")).distinct()
    return told.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("support"))


def disclosing_terms(docs: DataFrame, rows: DataFrame) -> DataFrame | None:
    """(term, share, removed, apart): terms that disclose an entity, whether they are removed, and whether they stand in
    lines without it, too; None if there is none."""
    contexts = rows.select(F.inline("contexts"))
    joint = contexts.select("entity", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_both"))
    joint = materialise(joint, "met")
    tried = joint.count()
    if not tried:
        return None
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    spoken = docs.select(F.explode(F.split(text, "\n", -1)).alias("line")).select(F.explode(terms_of(F.col("line"))).alias("term"))
    totals = spoken.groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    entities = contexts.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    n_lines = rows.agg(F.sum("n_lines")).first()[0]
    information = -F.log2(F.col("n_entity") / n_lines)
    scored = joint.where(F.col("n_both") >= SUPPORT).join(totals, "term").join(entities, "entity").withColumn("p", F.col("n_both") / (F.col("n_term") + 1))
    scored = scored.withColumn("share", F.when(information > 0, 1 + F.log2("p") / information))
    pairs = materialise(scored.where(F.col("share") >= DISCLOSES), "pairs")
    if pairs.isEmpty():
        return None
    sure = pairs.join(supported(contexts, pairs), ["entity", "term"]).where(F.col("support") >= SUPPORT)
    # contexts expected by chance: lines with both, less by what copies make of the contexts
    by_chance = F.col("n_entity").cast("double") * F.col("n_term") / n_lines * F.col("support") / F.col("n_both")
    tail = F.col("support") * (1 + F.log(by_chance / F.col("support"))) - by_chance
    sure = sure.where((by_chance < F.col("support")) & (tail + math.log(tried) <= math.log(CHANCE)))
    told = sure.groupBy("term").agg(F.max("share").alias("share"), (F.max("p") >= SURE).alias("removed"), F.min(F.col("n_both") < F.col("n_term")).alias("apart"))
    return materialise(told, "disclosing")


def _hits(docs: DataFrame, rows: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, hash, text, found, gone): each text with disclosing terms, these terms, and those of them to be removed.

    Texts with entities are at hand; a term that never stands without an entity is in no others. The rest of the texts
    are looked through where they lie, and only those with a term leave their task.
    """
    key = [F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")]
    marked = terms.select("term", "removed", "apart")
    with_entity = rows.where("held is not null")
    near = with_entity.select(*key, F.explode("terms").alias("term")).join(marked.drop("apart"), "term")
    near = near.groupBy("id", "hash").agg(F.collect_set("term").alias("found"), F.collect_set(F.when(F.col("removed"), F.col("term"))).alias("gone"))
    own = with_entity.select(F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_hash"), F.col("held").alias("text")).dropDuplicates(["of_id", "of_hash"])
    met = own.join(near, F.col("of_id").eqNullSafe(F.col("id")) & (F.col("of_hash") == F.col("hash"))).select("id", "hash", "text", "found", "gone")
    apart = marked.where("apart")
    passes = -(-apart.count() // FEW_TERMS)
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    texts = docs.select(docs["doc_id"].cast("long").alias("id"), text.alias("text"))
    for k in range(passes):
        few = apart.where(F.pmod(F.xxhash64("term"), F.lit(passes)) == k)
        # the text is carried along and written for the terms that are met only
        spoken = texts.select("id", F.xxhash64("text").alias("hash"), "text", F.explode(terms_of(F.col("text"))).alias("term")).join(F.broadcast(few), "term")
        spoken = spoken.where(F.size(base_spans(F.col("text"))) == 0)
        got = spoken.groupBy("id", "hash").agg(F.first("text").alias("text"), F.collect_set("term").alias("found"), F.collect_set(F.when(F.col("removed"), F.col("term"))).alias("gone"))
        met = met.unionByName(got)
    if passes < 2:
        return met
    return met.groupBy("id", "hash").agg(F.first("text").alias("text"), *[F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("found", "gone")])


def find_private(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, base, terms (spans of disclosing terms) for each row of `docs` (doc_id, text)."""
    kind = "array<struct<start:int,place:int,kind:string,end:int>>"
    with passing() as tables:
        rows = materialise(examined(docs), "examined")
        tables.append(rows)
        terms = disclosing_terms(docs, rows)
        if terms is None:
            return rows.select("doc_id", "text_hash", "base", F.array().cast(kind).alias("terms"))
        spot = F.transform(
            spans_of(masked(F.col("text")), _WORD, lambda m: F.array_contains(F.col("found"), F.lower(m))),
            lambda s: F.struct(
                s["start"].alias("start"),
                F.lit(len(PATTERNS)).alias("place"),
                F.when(F.array_contains("gone", F.lower(F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"]))), "removed").otherwise("term").alias("kind"),
                s["end"].alias("end"),
            ),
        )
        spots = materialise(_hits(docs, rows, terms).select(F.col("id").alias("of_id"), F.col("hash").alias("of_hash"), spot.alias("spots")), "spots")
        tables.append(spots)
    both = rows.join(spots, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_hash") == F.col("of_hash")), "left")
    return both.select("doc_id", "text_hash", "base", F.coalesce("spots", F.array().cast(kind)).alias("terms"))


def joined_spans(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _number(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind))


def span_report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans for each row of `docs`."""
    found = find_private(docs)
    counts = [_number(kind).cast("long").alias(f"n_{kind}") for kind in PATTERNS]
    every = F.array_sort(F.concat("base", "terms"))
    return found.select("doc_id", *counts, F.sha2(joined_spans(F.col("base")), 256).alias("base_sha256"), joined_spans(every).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each run of overlapping spans replaced by the first one's placeholder, or by nothing if removed."""
    init = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        mark = F.when(s["kind"] == "removed", "").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        out = F.concat(state["out"], F.substring(text, state["at"] + 1, s["start"] - state["at"]), mark)
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(s["start"] >= state["at"], out).otherwise(state["out"]).alias("out"))

    rest = F.aggregate(spans, init, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, rest).otherwise(text)


def sanitise(docs: DataFrame) -> DataFrame:
    """`docs` with personal data and disclosing terms replaced in `text` (and n_chars set anew, if there is one).

    Null texts stay null; all rows and columns are kept. Texts without base spans aren't shuffled unless some of them
    have terms that were learned elsewhere.
    """
    own = unused(docs)
    with passing() as tables:
        found = find_private(docs)
        told = found.select(F.col("doc_id").alias(f"{own}id"), F.col("text_hash").alias(f"{own}hash"), F.array_sort(F.concat("base", "terms")).alias(f"{own}spans"), (F.size("base") > 0).alias(f"{own}based"))
        told = materialise(told.where(F.size(f"{own}spans") > 0).dropDuplicates([f"{own}id", f"{own}hash"]), "spans")
        tables.append(told)
    text, spans = docs["text"].cast("string"), F.col(f"{own}spans")
    based = F.size(base_spans(F.coalesce(text, F.lit("")))) > 0

    def replaced(rows: DataFrame, known: DataFrame) -> DataFrame:
        key = rows["doc_id"].cast("long").eqNullSafe(known[f"{own}id"]) & (F.xxhash64(text) == known[f"{own}hash"])
        out = rows.join(known, key, "left").withColumn("text", F.when(spans.isNotNull(), redacted(text, spans)).otherwise(text))
        if "n_chars" in docs.columns:
            out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
        return out.select(*docs.columns)

    far = told.where(~F.col(f"{own}based"))
    rest = docs.where(~based)
    if not far.isEmpty():
        rest = replaced(rest, far)
    else:
        rest = rest.withColumn("text", text)
        rest = rest.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else rest
    return replaced(docs.where(based), told.where(f"{own}based")).unionByName(rest.select(*docs.columns))
