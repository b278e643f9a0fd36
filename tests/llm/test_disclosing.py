"""Which terms disclose an entity: counts, information, contexts and spans by brute force."""

import math
import random
from collections import Counter, defaultdict

import regex

from loomtext.llm import privacy
from test_documents import KINDS, base_of

WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def found(spark, texts):
    return {r.doc_id: [(k, texts[r.doc_id][int(a) : int(b)]) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)] for r in privacy.span_report(frame(spark, texts)).collect()}


def spans(text):
    return [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in base_of(text).split(",") if s)]


def masked(text):
    for _, a, b in spans(text):
        text = text[:a] + " " * (b - a) + text[b:]
    return text


def names(kind, value):
    digits = "".join(c for c in value if c in "0123456789")
    if kind == "email":
        return [f"email:{value.lower()}", "domain:" + value.lower().split("@")[-1]]
    if kind == "ip":
        return [f"ip:{value}", "net:" + value.rsplit(".", 1)[0]]
    return [f"{kind}:{digits}", f"{kind}s:{digits[: 6 if kind == 'card' else 5]}"]


def contexts(line):
    out, bare = defaultdict(set), masked(line)
    for kind, a, b in spans(line):
        around = {m[0].lower() for m in WORD.finditer(bare) if (m.end() <= a and m.start() >= a - privacy.REACH) or (m.start() >= b and m.end() <= b + privacy.REACH)}
        for name in names(kind, line[a:b]):
            out[name] |= around
    return {e: tuple(sorted(t)) for e, t in out.items()}


def contexts_apart(lines):
    """Contexts (sets) that aren't linked by a likeness of 0.8."""
    lines, root = sorted(set(lines)), {}
    for i, a in enumerate(lines):
        root[i] = i
        for j in range(i):
            if 5 * len({*a} & {*lines[j]}) >= 4 * len({*a} | {*lines[j]}):
                low, high = sorted((root[i], root[j]))
                root = {k: low if v == high else v for k, v in root.items()}
    return {line: root[i] for i, line in enumerate(lines)}


def by_brute_force(texts):
    lines = [x for t in texts for x in (t or "").split("\n")]
    met, n_term = defaultdict(list), Counter()
    for line in lines:
        n_term.update({m[0].lower() for m in WORD.finditer(masked(line))})
        for e, terms in contexts(line).items():
            met[e].append(terms)
    pairs = {(e, t): sum(t in x for x in of) for e, of in met.items() for t in {t for x in of for t in x}}
    sure = {}
    for (e, t), both in pairs.items():
        information = -math.log2(len(met[e]) / len(lines))
        share = 1 + math.log2(both / (n_term[t] + 1)) / information if information > 0 else 0
        if share < privacy.DISCLOSES:
            continue
        support = len(set(contexts_apart([x for x in met[e] if t in x]).values()))
        chance = len(met[e]) * n_term[t] / len(lines) * support / both
        tail = support * (1 + math.log(chance / support)) - chance
        if support < privacy.SUPPORT or chance >= support or tail + math.log(len(pairs)) > math.log(privacy.CHANCE):
            continue
        sure[t] = max(both / (n_term[t] + 1), sure.get(t, 0))
    told = {}
    for k, text in enumerate(texts):
        text = text or ""
        more = [("removed" if sure[t] >= privacy.SURE else "term", m.start(), m.end()) for m in WORD.finditer(masked(text)) if (t := m[0].lower()) in sure]
        order = [*KINDS, "term", "removed"]
        told[k] = sorted([*spans(text), *more], key=lambda s: (s[1], min(order.index(s[0]), len(KINDS))))
    return told


def reported(spark, texts):
    return {r.doc_id: [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)] for r in privacy.span_report(frame(spark, texts)).collect()}


def corpus(r, n=600):
    vocabulary = ["".join(r.choice("abdeilmnorstu") for _ in range(5)) for _ in range(300)]
    return [" ".join(r.choice(vocabulary) for _ in range(12)) for _ in range(n)], vocabulary


def test_counts_information_and_spans(spark):
    r = random.Random(4)
    texts, vocabulary = corpus(r, 1500)
    who = ["ann@corp.example", "bob@corp.example", "+1 (743) 555-3824", "10.2.3.4", "10.2.3.9", "4111 1111 1111 1111"]
    for k in range(60):  # entities among common words, words of their own, words met elsewhere, copies, two in a line, far words
        own = [f"own{k % 7}", f"once{k}"][: r.randrange(3)]
        words = r.sample(vocabulary, r.randrange(1, 30))
        words.insert(r.randrange(len(words)), " ".join([*own, r.choice(who)]))
        line = " ".join(words)
        texts += [line, line + " more"] if k % 5 == 0 else [line + "\n" + r.choice(texts)]
        if k % 9 == 0:
            texts.append(f"own{k % 7} {r.choice(vocabulary)}")
    texts += [f"Zelmira writes {who[0]} {' '.join(r.sample(vocabulary, 5))}" for _ in range(20)] + ["zelmira was here", None, "", who[0], f"{who[1]} {who[3]}é李 x{who[4]}"]
    texts += [f"Yolanda calls {who[2]} {' '.join(r.sample(vocabulary, 5))}" for _ in range(6)] + ["so yolanda said"]
    want, got = by_brute_force(texts), reported(spark, texts)
    kinds = Counter(k for s in want.values() for k, _, _ in s)
    assert kinds["term"] > 5 and kinds["removed"] > 5 and got == want


def test_terms_of_any_kind(spark):
    r = random.Random(3)
    texts, vocabulary = corpus(r)
    terms = ["Kim", "李", "b27x", "ދިވެހި", "Renée", "4711"]
    for k, term in enumerate(terms):
        texts += [" ".join(r.sample(vocabulary, 6)) + f" {term} mail{k}@corp.example" for _ in range(3)]
    texts += [f"so {t} said" for t in terms] + [f"a lone{k}@corp.example" for k in range(5)]
    got = found(spark, texts)
    at = len(texts) - 5 - len(terms)
    assert [[x for _, x in got[at + k]] for k in range(len(terms))] == [[t] for t in terms]
    assert not any(got[k] for k in range(600))


def test_copies_of_a_context_are_one(spark):
    """A term needs contexts that differ, also one that is never apart from the entity."""
    r = random.Random(5)
    texts, vocabulary = corpus(r, 2000)
    line = r.sample(vocabulary, 12)
    texts += [" ".join([*line, "zelmira", "ann@corp.example", *more]) for more in ([], [], ["edit"], ["edit", "other"])] + ["zelmira elsewhere"]
    told = found(spark, texts)
    assert [x for _, x in told[len(texts) - 1]] == []
    assert [x for _, x in told[len(texts) - 3]] == ["ann@corp.example"]


def test_one_meeting_tells_nothing(spark):
    """Words that are met once, beside an entity, stay; the same lines in a larger table give the same verdicts."""
    texts, vocabulary = corpus(random.Random(6), 60)
    texts += [f"hapax{k} mail{k}@d{k}.example" for k in range(30)]
    texts += [f"{' '.join(vocabulary[9 * k : 9 * k + 7])} zelmira ann@corp.example" for k in range(12)]
    small = found(spark, texts)
    large = found(spark, texts + corpus(random.Random(7), 20_000)[0])
    assert {k: large[k] for k in small} == small
    assert all([w for _, w in small[60 + k]] == [f"mail{k}@d{k}.example"] for k in range(30))
    assert all(("removed", "zelmira") in small[90 + k] for k in range(12))


def test_support_against_brute_force_on_templated_lines(spark):
    r = random.Random(7)
    rows = []
    for e in range(12):
        shared = [f"s{e}{k}" for k in range(r.choice([5, 8, 30]))]
        for _ in range(r.randrange(2, 20)):
            line = sorted({*shared, *(f"o{r.randrange(60)}" for _ in range(r.choice([1, 4, 6])))})
            rows += [(f"email:{e}", line)] * r.randrange(1, 3)
    pairs = {(e, t) for e, line in rows for t in line if t[0] == "o" or r.random() < 0.3}
    table = spark.createDataFrame(rows, "entity string, terms array<string>")
    got = {(x.entity, x.term): x.support for x in privacy.supported(table, spark.createDataFrame(sorted(pairs), "entity string, term string")).collect()}
    assert got == {(e, t): len(set(contexts_apart([tuple(line) for f, line in rows if f == e and t in line]).values())) for e, t in pairs}


def test_odd_tables(spark):
    odd = [(1, "see a@b.co now", 1, "x"), (1, "see a@b.co now", 1, "x"), (None, "see a@b.co", None, None), (None, None, None, None), (2, "", 0, ""), (3, "w " * 60_000 + "c@d.co", 9, "")]
    docs = spark.createDataFrame(odd, "doc_id long, text string, n_chars int, __own_id string")
    clean = privacy.sanitise(docs)
    assert clean.columns == docs.columns
    got = sorted((r.doc_id or 0, (r.text or "")[-13:], r.n_chars or 0, r["__own_id"] or "") for r in clean.collect())
    assert got == [(0, "", 0, ""), (0, "see [EMAIL]", 11, ""), (1, "e [EMAIL] now", 15, "x"), (1, "e [EMAIL] now", 15, "x"), (2, "", 0, ""), (3, "w w w [EMAIL]", 120_007, "")]
    assert privacy.span_report(docs.limit(0)).count() == 0 and privacy.sanitise(docs.limit(0)).count() == 0
