"""The pipeline's near copies against exact Jaccard likeness of five-word shingles."""

import random

import numpy as np
import pytest

import corpus_pipeline
from loomtext.llm import likeness, minhash, simhash


def shingles(text):
    words = (text or "").split()
    return {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def test_stage_drops_what_is_alike_by_four_fifths(spark):
    r = random.Random(21)
    vocabulary = ["".join(r.choice("abdeilmnorstu") for _ in range(6)) for _ in range(800)]
    texts = []
    for _ in range(12):
        base = [r.choice(vocabulary) for _ in range(r.randrange(60, 300))]
        texts.append(" ".join(base))
        for edits in (1, 2, 3, 5, 8):
            words = list(base)
            for at in r.sample(range(len(words)), edits):
                words[at] = "changed"
            texts.append(" ".join(words))
    texts += [None, "", "one two", "one two three"]
    root = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(map(shingles, texts)):
            for j in range(i):
                b = shingles(texts[j])
                if not (a or b) or (a or b) and 5 * len(a & b) >= 4 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = corpus_pipeline.near_copies(spark, docs, "")
    assert kept.columns == docs.columns and sorted(x.doc_id for x in kept.collect()) == sorted(set(root))
    assert simhash.drop_near_copies(docs).count() > len(set(root))  # four bits of 64 leave edited copies


@pytest.mark.parametrize("seed", range(2))
def test_like_components_compare_all_that_share_a_key(spark, seed):
    r = random.Random(seed)
    sets = [sorted({*range(20)} - set(r.sample(range(20), r.randrange(5)))) for _ in range(40)]
    root = list(range(40))
    for _ in sets:
        for i in range(40):
            for j in range(40):
                if 5 * len({*sets[i]} & {*sets[j]}) >= 4 * len({*sets[i]} | {*sets[j]}):
                    root[i] = root[j] = min(root[i], root[j])
    keys = spark.createDataFrame([(1, k) for k in range(40)], "key long, node long")
    got = {x.node: x.root for x in likeness.like_components(keys, spark.createDataFrame(list(enumerate(sets)), "node long, items array<long>")).collect()}
    assert [got.get(k, k) for k in range(40)] == root


@pytest.mark.parametrize("full", [4096, 20])
def test_signed_pairs_find_what_is_alike_in_a_hot_key(spark, full):
    """One key for all: every pair of a likeness of 0.8 or more comes out, most others don't, linked ones never; also of divided keys."""
    r = random.Random(9)
    passage = [r.getrandbits(64) for _ in range(60)]
    sets = []
    for _ in range(40):
        base = passage + [r.getrandbits(64) for _ in range(90)]
        sets += [base, base[:-5] + [r.getrandbits(64) for _ in range(5)], base[:-12] + [r.getrandbits(64) for _ in range(12)]]
    sets = [np.unique(np.asarray(s, np.uint64)) for s in sets]
    _, signs = minhash.band_keys(sets)
    root = [k if k % 3 < 2 else k - 2 for k in range(len(sets))]  # the third of each family is linked to the first already
    keys = spark.createDataFrame([(7, k, root[k]) for k in range(len(sets))], "key long, node long, root long")
    table = spark.createDataFrame([(k, bytearray(s.tobytes())) for k, s in enumerate(signs)], "node long, sign binary")
    got = {(x.a, x.b) for x in minhash.signed_pairs(keys, table, full).collect()}
    like = {(i, j) for i in range(len(sets)) for j in range(i) if root[i] != root[j] and 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))}
    assert like and like <= got and len(got) <= len(like) + 20 and not any(root[a] == root[b] for a, b in got)


def test_many_texts_with_one_passage_stay(spark):
    r = random.Random(13)
    words = ["".join(r.choice("abdeilmnorstu") for _ in range(6)) for _ in range(3000)]
    passage = " ".join(r.sample(words, 120))
    texts = [f"{' '.join(r.sample(words, 60))} {passage} {' '.join(r.sample(words, 30))}" for _ in range(60)]
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts + texts[:10])] + [(None, texts[0], "y", 2), (None, None, None, None)], "doc_id long, text string, __own_id string, n int")
    kept = minhash.drop_similar(docs)
    assert kept.columns == docs.columns and sorted(x.doc_id for x in kept.collect() if x.text) == list(range(60)) and kept.count() == 61
    assert minhash.drop_similar(docs.limit(0)).count() == 0


@pytest.mark.parametrize("full, block", [(4096, 512), (4096, 7), (20, 5)])
def test_unlike_texts_of_one_key_make_no_square_of_pairs(spark, full, block, monkeypatch):
    """Texts that agree on signatures, but aren't alike: what is joined grows with the texts, and no link is lost or made up."""
    r = random.Random(17)
    passage = [r.getrandbits(63) for _ in range(70)]
    sets = [passage + [r.getrandbits(63) for _ in range(14)] for _ in range(90)]
    sets += [s[:-3] + [r.getrandbits(63) for _ in range(3)] for s in sets[:20]]
    sets = [np.unique(np.asarray(s, np.uint64)) for s in sets]
    _, signs = minhash.band_keys(sets)
    written = []
    monkeypatch.setattr(minhash, "materialise", lambda df, label, real=minhash.materialise: written.append((label, real(df, label))) or written[-1][1])
    keys = spark.createDataFrame([(7 + k, n, n) for k in range(3) for n in range(len(sets))], "key long, node long, root long")
    of = spark.createDataFrame([(k, bytearray(s.tobytes())) for k, s in enumerate(signs)], "node long, sign binary")
    items = spark.createDataFrame([(k, s.view(np.int64).tolist()) for k, s in enumerate(sets)], "node long, items array<long>")
    got = {(x.a, x.b) for x in minhash.signed_links(keys, items, of, full, block).collect()}
    like = {(i, j) for i in range(len(sets)) for j in range(i) if 9 * len(np.intersect1d(sets[i], sets[j])) >= 4 * (len(sets[i]) + len(sets[j]))}
    assert len(like) >= 20 and {(max(x), min(x)) for x in got} <= like

    def connected(links):
        root = list(range(len(sets)))
        for _ in sets:
            for a, b in links:
                root[a] = root[b] = min(root[a], root[b])
        return root

    assert connected(got) == connected(like)
    assert len(minhash.signed_pairs(keys, of).collect()) > 5000
    cells = [df for label, df in written if label.startswith("compared")][0]
    assert block < 512 or full < 4096 or cells.count() == 3 * len(sets)
