"""Quality, fingerprints, toxicity, privacy, sharding and near copies against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomtext.llm import fingerprints, privacy, quality, sharding, simhash, toxicity
from loomtext.llm.components import connected_components
from loomtext.llm.neighbours import next_lower

WHITE = " \t\n\x0b\f\r"


def rows_of(spark, texts):
    return spark.createDataFrame([(k, t, 5) for k, t in enumerate(texts)], "doc_id long, text string, row int")


@pytest.fixture(scope="module")
def prose():
    r = random.Random(1)
    vocabulary = ["".join(r.choice("abdeilmnorstu") for _ in range(r.randrange(2, 8))) for _ in range(900)]

    def text(n):
        lines = [" ".join(r.choice(vocabulary) for _ in range(12)).capitalize() + "." for _ in range(max(1, n // 12))]
        return "\n".join(lines)

    return [text(r.randrange(60, 400)) for _ in range(60)]


def test_quality_counts(spark):
    r = random.Random(4)
    odd = ["".join(r.choice(["a", "b", " ", "\n", "#", "é", "\t", "a b c ", "|"]) for _ in range(r.randrange(60))) for _ in range(150)]
    texts = [*odd, None, "", " \n ", "a a a a", "x y z x y z", "  a", "one\none\n\none"]
    for r_ in quality.judged(rows_of(spark, texts)).collect():
        t = texts[r_.doc_id] or ""
        w = re.findall(f"[^{WHITE}]+", t)
        c = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        again = {j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
        lines = [x for x in t.split("\n") if x.strip(WHITE)]
        want = (len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again))
        assert (r_.n_words, r_.word_chars, r_.n_symbols, r_.n_dup_lines, r_.n_repeat_words) == want
        assert r_.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w)) and not (r_.base_failed and r_.kept)


def test_quality_verdicts(spark, prose):
    junk = [re.sub(r"(\w+)", r"\1***", prose[0]), re.sub(r"(\w+)", lambda m: m[0].upper() + "!!", prose[1]), re.sub(" ", " | ", prose[2])]
    told = quality.judged(rows_of(spark, prose + junk)).orderBy("doc_id").collect()
    assert all(r.kept for r in told[: len(prose)]) and not any(r.kept for r in told[len(prose) :])
    kept = quality.keep_good(rows_of(spark, prose + junk))
    assert kept.columns == ["doc_id", "text", "row"] and kept.count() == len(prose)
    assert quality.judged(rows_of(spark, ["x"]).limit(0)).count() == 0 and quality.keep_good(rows_of(spark, ["x"]).limit(0)).count() == 0


def test_estimation_against_numpy(spark):
    """Expectation-maximisation and verdicts of rules' votes, also where most documents are junk."""
    r = random.Random(12)
    names = [vote for _, vote, _ in quality.RULES]
    for share in (0.9, 0.3):
        votes = []
        for _ in range(600):
            good = r.random() < share
            votes.append([v if r.random() < ((0.97 if good else 0.5) if v > 0 else (0.01 if good else 0.4)) else 0 for v in names])
        fit = quality.estimate(spark.createDataFrame([(v,) for v in votes], "votes array<int>")).first()
        cast, n = np.asarray(votes) != 0, len(votes)
        first_good, first_bad = np.asarray([0.95 if v > 0 else 0.01 for v in names]), np.asarray([0.4 if v > 0 else 0.3 for v in names])
        good, bad, p, weight = first_good, first_bad, 0.8, max(n / 1000, 1)

        def posterior(p, good, bad, cast=cast):
            odds = np.log(p / (1 - p)) + np.where(cast, np.log(good / bad), np.log((1 - good) / (1 - bad))).sum(axis=1)
            return 1 / (1 + np.exp(-odds))

        for _ in range(quality.ROUNDS):
            w = posterior(p, good, bad)
            on_good = (w @ cast + weight * first_good) / (w.sum() + weight)
            on_bad = ((1 - w) @ cast + weight * first_bad) / (n - w.sum() + weight)
            against = np.asarray(names) < 0
            good, bad = np.where(against, np.minimum(on_good, on_bad), on_good), np.where(against, on_bad, np.minimum(on_bad, on_good))
            p = (w.sum() + 0.8 * weight) / (n + weight)
        assert fit["share"] == pytest.approx(p) and abs(p - share) < 0.08
        assert [c["good"] for c in fit["chances"]] == pytest.approx(good.tolist()) and [c["bad"] for c in fit["chances"]] == pytest.approx(bad.tolist())
        told = spark.createDataFrame([(k, v) for k, v in enumerate(votes)], "k int, votes array<int>").select("k", quality.quality(fit).alias("q")).orderBy("k").collect()
        assert [x.q for x in told] == pytest.approx(posterior(p, good, bad).tolist())


def test_fingerprints_against_sets(spark, prose):
    texts = [*prose[:12], None, "", "one\n\none\ntwo", prose[0], "x", "\n".join(map(str, range(300)))]
    data = [(10 * k, t, 1) for k, t in enumerate(texts)]
    frame = spark.createDataFrame([*data, data[3], (None, "a\nb", 1)], "doc_id long, text string, row int")
    order = sorted((i for i, _, _ in data), reverse=True)
    following, by_id = dict(zip(order, [*order[1:], order[0]])), {i: t or "" for i, t, _ in data}
    seen = {}

    def alike(a, b):
        a, b = ({x for x in t.split("\n") if x.strip(WHITE)} for t in (a, b))
        return len(a & b) / len(a | b) if a | b else 1.0

    got = fingerprints.fingerprints(frame).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        t = by_id.get(r.doc_id, "a\nb")
        after = by_id[following[r.doc_id]] if r.doc_id is not None else ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == pytest.approx(alike(t, edited))
        assert (r.near_next is None) == (r.doc_id is None) and (r.near_next is None or r.near_next == pytest.approx(alike(t, after)))
        assert seen.setdefault(t, r.fingerprint) == r.fingerprint and seen.setdefault(edited, r.edited_fingerprint) == r.edited_fingerprint


def test_next_lower(spark):
    ids = [5, -3, 900, 7, 10**15]
    got = {r.id: r.next_id for r in next_lower(spark.createDataFrame([(i,) for i in ids], "id long")).collect()}
    assert got == {5: -3, 7: 5, 900: 7, 10**15: 900, -3: 10**15}
    assert next_lower(spark.createDataFrame([(4,)], "id long")).first().next_id == 4
    assert next_lower(spark.createDataFrame([], "id long")).count() == 0


def test_toxicity_on_held_out_rows(spark, prose):
    r = random.Random(6)
    texts, labels = [], []
    for k in range(300):
        words = r.choice(prose).split(" ")
        toxic = k % 3 == 0
        if toxic:
            for bad in r.sample(["vilest", "scumbag", "worthless", "rotten"], 3):
                words.insert(r.randrange(len(words)), bad)
        texts.append(" ".join(words))
        labels.append((k, int(toxic)))
    docs, marks = rows_of(spark, [*texts, None, ""]), spark.createDataFrame([*labels, (None, 1), (9999, 1), (5, None)], "doc_id long, toxic int")
    told = toxicity.toxicity(docs, marks).collect()
    assert len(told) == 302 and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7) for x in told)
    held = [x for x in told if x.held_out and x.doc_id < 300]
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1) for x in told)
    assert np.mean([x.predicted == labels[x.doc_id][1] for x in held]) > 0.95
    assert not any(x.predicted for x in told if x.doc_id >= 300)
    kept = toxicity.drop_toxic(docs, marks)
    assert kept.columns == docs.columns and kept.count() == sum(1 - x.predicted for x in told)
    none = toxicity.toxicity(docs.limit(3), marks.limit(0)).collect()
    assert [x.score for x in none] == pytest.approx([0.0] * 3, abs=1e-6) and toxicity.toxicity(docs.limit(0), marks).count() == 0


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits))) % 10 == 0


KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(re.sub(r"\D", "", m)) <= 19 and luhn(re.sub(r"\D", "", m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub(r"\D", "", m)) <= 15),
}


def base_of(text):
    found = [(m.start(), n, k, m.end()) for n, (k, (p, ok)) in enumerate(KINDS.items()) for m in re.finditer(p, text) if ok(m[0])]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))


def test_base_spans_against_patterns(spark):
    r = random.Random(8)
    bits = ["a@b.co", "@", ".", "x", "1.2.3.4", "255.0.0.001", "999.1.1.1", "+1 (743) 555-3824", "+", "4111 1111 1111 1111", "4111-1111-1111-1112", "0", "12", " ", "-", "é", "😀", "\n", "_", "b.c", "%", "()", "a@b@c.de"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(14))) for _ in range(600)] + [None, "", "1 " * 9000, "a" * 30000 + "@", "9" * 20000]
    for row in privacy.span_report(rows_of(spark, texts)).collect():
        want = base_of(texts[row.doc_id] or "")
        assert row.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (texts[row.doc_id], want, row.spans)
        assert {k: want.count(k + ":") for k in KINDS} == {k: row[f"n_{k}"] for k in KINDS}


def test_disclosing_terms(spark, prose):
    words = [w for t in prose for w in re.findall("[a-z]{4,}", t.lower())]
    r = random.Random(9)
    lines = [" ".join(r.sample(words, 9)) + " write zelmira to ann@corp.example please" for _ in range(30)]
    texts = [*prose, *lines, "Only Zelmira said so.", "nobody@corp.example was here once"]
    got = {x.doc_id: x.spans for x in privacy.span_report(rows_of(spark, texts)).collect()}
    assert all(not got[k] for k in range(len(prose)))
    n = len(prose)
    assert all("email:" in got[k] and re.search("(term|removed):", got[k]) for k in range(n, n + 30))
    assert got[n + 30] in ("removed:5:12", "term:5:12") and got[n + 31] == "email:0:19"
    clean = {x.doc_id: x.text for x in privacy.sanitise(rows_of(spark, texts)).collect()}
    assert all(clean[k] == texts[k] for k in range(n)) and clean[n + 31] == "[EMAIL] was here once"
    assert not any(re.search("zelmira|@corp", clean[k], re.I) for k in range(n, n + 32))


def test_sanitise_keeps_rows(spark):
    frame = spark.createDataFrame([(1, "a@b.co", 6), (1, "a@b.co", 6), (None, None, 0), (2, "+1 (743) 555-3824\n4111111111111111", 3)], "doc_id long, text string, n_chars long")
    got = sorted((r.text or "", r.n_chars or 0) for r in privacy.sanitise(frame).collect())
    assert got == [("", 0), ("[EMAIL]", 7), ("[EMAIL]", 7), ("[PHONE]\n[CARD]", 14)]


def test_sharding(spark, prose):
    texts = [*prose * 8, *["same"] * 700, None]
    got = sharding.assign_shards(rows_of(spark, texts), 4).collect()
    sizes, slots = Counter(), {}
    for r in got:
        t = texts[r.doc_id] or ""
        assert (r.size, r.text_crc32) == (len(t.encode()) + 1, zlib.crc32(t.encode()))
        sizes[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(got) == len(texts) and max(sizes.values()) - min(sizes.values()) <= 0.02 * sum(sizes.values()) / 4
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.assign_shards(rows_of(spark, ["x"]).limit(0)).count() == 0


def split_groups(spark, texts, shards):
    of_text, sizes = {}, Counter()
    for r in sharding.assign_shards(rows_of(spark, texts), shards).collect():
        of_text.setdefault(texts[r.doc_id], set()).add(r.shard)
        sizes[r.shard] += r.size
    return {t: s for t, s in of_text.items() if len(s) > 1}, sizes


def test_equal_texts_stay_together(spark, sf, prose):
    """No group is torn, also of texts whose copies are much of a shard; only one that no shard has room for is divided."""
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    assert split_groups(spark, texts, 16)[0] == {}
    assert split_groups(spark, [*prose * 8, *["some text of many copies"] * 300, *["another"] * 400, None, None, ""], 4)[0] == {}
    torn, sizes = split_groups(spark, [*prose, *["hot text that is more than any shard"] * 3000], 8)
    assert list(torn) == ["hot text that is more than any shard"] and max(sizes.values()) < 1.05 * sum(sizes.values()) / 8


def test_flow_moves_the_fewest_bytes():
    r = random.Random(3)
    for _ in range(20):
        old = [r.randrange(100) for _ in range(5)]
        new = sharding.capacities(sum(old), [1] * 5)
        flow = sharding.min_cost_flow(old, new)
        assert sum(flow.values()) == sum(max(0, a - b) for a, b in zip(old, new))
        after = [old[i] + sum(v for (a, b), v in flow.items() if b == i) - sum(v for (a, b), v in flow.items() if a == i) for i in range(5)]
        assert after == new
    cheap = sharding.min_cost_flow([10, 0, 0], [0, 5, 5], [[0, 1, 9], [1, 0, 1], [9, 1, 0]])
    assert sum(cheap.values()) == 10 and cheap == {(0, 1): 5, (0, 2): 5}


def test_capacities_in_any_unit():
    assert sharding.capacities(17, [1] * 5) == [3, 3, 4, 3, 4] and sum(sharding.capacities(1000, [5, 1, 0])) == 1000
    assert sharding.capacities(600, [5, 1, 0]) == [500, 100, 0]


def test_blocks_leave_shards_that_go():
    r = random.Random(4)
    blocks = [((k, 0), r.randrange(1, 50), r.randrange(6)) for k in range(300)]
    total = sum(s for _, s, _ in blocks)
    for new in (sharding.capacities(total, [1] * 4), sharding.capacities(total, [1] * 9), sharding.capacities(total, [3, 1, 1, 1, 1, 1])):
        at = sharding.move_blocks(blocks, new)
        full = [sum(s for key, s, _ in blocks if at[key] == k) for k in range(len(new))]
        assert set(at) == {key for key, _, _ in blocks} and max(abs(a - b) for a, b in zip(full, new)) < 50
        moved = sum(s for key, s, old in blocks if at[key] != old)
        have = [sum(s for _, s, old in blocks if old == k) for k in range(max(6, len(new)))]
        least = sum(max(0, h - n) for h, n in zip(have, [*new, *[0] * 9]))
        assert abs(moved - least) <= 50 * len(have)  # the flow's bytes, but for less than a block each


def test_resharding_files(spark, prose, tmp_path):
    """Grow, take in new rows, shrink, run again: no row is lost or doubled, and shards that aren't concerned stay as they are."""
    path = str(tmp_path / "s")
    docs = rows_of(spark, [*prose, *prose[:5], None, ""]).withColumns({"shard": F.lit("own"), "__own_old": F.lit(7)})

    def state():
        rows = sharding.read_shards(spark, path, "of_shard").withColumn("file", F.input_file_name()).collect()
        sizes = Counter()
        for r in rows:
            sizes[r.of_shard] += len((r.text or "").encode()) + 1
        return sorted((r.doc_id, r.text, r.row, r.shard, r["__own_old"]) for r in rows), sizes, {r.of_shard: r.file for r in rows}, {r.doc_id: r.of_shard for r in rows}

    want = sorted((r.doc_id, r.text, 5, "own", 7) for r in docs.collect())
    with pytest.raises(ValueError):
        sharding.read_shards(spark, path)
    assert sharding.reshard(spark, path, 4, docs, blocks=64) == [0, 1, 2, 3]
    rows, sizes, files, at = state()
    assert rows == want and sharding.read_shards(spark, path, "of_shard").columns == [*docs.columns, "of_shard"]
    assert sharding.reshard(spark, path, 4) == [] and state()[2] == files
    grown = sharding.reshard(spark, path, 5)
    rows, sizes, after, now = state()
    assert rows == want and 4 in grown and len(sizes) == 5 and max(sizes.values()) < 1.5 * min(sizes.values())
    assert all(after[k] == files[k] for k in range(4) if k not in grown)
    assert all(at[i] == now[i] or now[i] == 4 or {at[i], now[i]} <= {*grown} for i in at)
    one = spark.createDataFrame([(1000, "new", 5, "own", 7)], docs.schema)
    took = sharding.reshard(spark, path, 5, one)
    want = sorted([*want, (1000, "new", 5, "own", 7)], key=lambda r: r[0])
    rows, _, last, now = state()
    assert sorted(rows, key=lambda r: r[0]) == want and now[1000] in took and all(last[k] == after[k] for k in range(5) if k not in took)
    sharding.reshard(spark, path, [2, 1, 1])
    rows, sizes, _, _ = state()
    assert sorted(rows, key=lambda r: r[0]) == want and set(sizes) == {0, 1, 2} and 0.4 < sizes[0] / sum(sizes.values()) < 0.6
    empty = str(tmp_path / "e")
    sharding.reshard(spark, empty, 3, docs.limit(0))
    assert sharding.read_shards(spark, empty).count() == 0 and sharding.reshard(spark, empty, 2, docs) and sharding.read_shards(spark, empty).count() == docs.count()


def test_realised_moves_of_rows(spark, prose):
    docs = rows_of(spark, prose * 6)
    old = F.when(F.col("doc_id") % 7 == 0, F.lit(0)).otherwise(F.pmod(F.xxhash64("text"), F.lit(3))).cast("int")
    got = sharding.assign_shards(docs, [1, 1, 1, 1], old, blocks=512).collect()
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r.size
    assert len(got) == 6 * len(prose) and max(sizes.values()) < 1.2 * min(sizes.values())


def test_near_copies(spark, prose):
    base = (prose[0] + "\n" + prose[1]).split(" ")
    near = [" ".join([*base[:k], "changed", *base[k + 1 :]]) for k in range(0, len(base), 7)]
    texts = [" ".join(base), *near, *prose[2:], prose[5], None, "", "One two", "one TWO", "one"]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_copies(rows_of(spark, texts)).collect()}
    prints = []
    for t in texts:
        w = re.findall(f"[^{WHITE}]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        shingles = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    assert [got[k][0] for k in range(len(texts))] == [f"{p:016x}" for p in prints]
    root = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(prints):
            root[i] = min(root[j] for j, b in enumerate(prints) if (a ^ b).bit_count() <= 4)
    assert [got[k][1] for k in range(len(texts))] == root
    kept = simhash.drop_near_copies(rows_of(spark, texts).unionAll(rows_of(spark, texts[:3])))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root))


def test_cells_lose_no_link(spark):
    r = random.Random(11)
    centre = r.getrandbits(64)
    prints = list({centre ^ sum(1 << b for b in r.sample(range(64), r.randrange(5))) for _ in range(120)} | {r.getrandbits(64) for _ in range(200)})
    nodes = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    links = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash.near_links(nodes, 4).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in links)

    def classes(pairs):
        root = {p: p for p in prints}

        def find(p):
            while root[p] != p:
                p = root[p]
            return p

        for a, b in pairs:
            root[find(a)] = find(b)
        groups = {}
        for p in prints:
            groups.setdefault(find(p), set()).add(p)
        return sorted(map(sorted, groups.values()))

    every = [(a, b) for i, a in enumerate(prints) for b in prints[:i] if (a ^ b).bit_count() <= 4]
    assert classes(links) == classes(every)
    unary = simhash._unary(np.asarray(prints, np.uint64))
    native = [x[0] for x in nodes.select(simhash.unary_counts(F.col("fp"))).collect()]
    assert sorted(native) == sorted(unary.view(np.int64).tolist())


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (3, 1), (5, 5), *[(100 + k, 101 + k) for k in range(40)]]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got[2] == got[3] == 1 and got[9] == got[8] == got[7] == 6 and got[140] == 100 and 5 not in got and 1 not in got
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprints_are_peeled_where_their_rows_lie(spark, prose, monkeypatch):
    """Sketches of a pair are subtracted and peeled in the buckets of their rows: no cell is shuffled."""
    plans = {}

    def noted(df, label, real=fingerprints.materialise):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return real(df, label)

    monkeypatch.setattr(fingerprints, "materialise", noted)
    frame = spark.createDataFrame(list(enumerate(prose[:20])), "doc_id long, text string")
    assert fingerprints.fingerprints(frame).count() == 20
    assert "peeled24" in plans and "Exchange" in plans["versions"] and "Exchange" not in plans["peeled24"]
