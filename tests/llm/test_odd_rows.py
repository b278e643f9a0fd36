"""Every operator on documents with nulls, repeats, clashing columns and very long texts, and on an empty table."""

import hashlib
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomtext.llm import fingerprints, notices, packing, preferences, privacy, quality, resampling, sharding, simhash, token_count, toxicity, whitening, word_bpe

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
LONG = "\n".join(f"line {k} of a very long text with words{k % 977} and more w{k % 31}" for k in range(12_000))
ROWS = [(1, "One two three four five"), (1, "One two three four five"), (1, "another text of the same id"), (2, None), (3, ""), (4, " \n\t"), (None, "no id at all here"), (None, None), (5, LONG), (6, "x" * 200_000), (7, "İ ß é́ 😀 \x00 \x1c")]
SCHEMA = "doc_id long, text string, row int, shard int, __own_id string, score double, id long, n string, fp string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t, 1, 2, "a", 0.5, 9, "n", "f") for k, t in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (5, 0), (6, 0), (None, 1), (99, None)], "doc_id long, toxic int")


OPERATORS = {
    "counts": lambda d, _: token_count.count_tokens(d, PIECES),
    "quality": lambda d, _: quality.judged(d),
    "codec": lambda d, _: word_bpe.encode_decode(d, WORDS),
    "fingerprints": lambda d, _: fingerprints.fingerprints(d),
    "toxicity": toxicity.toxicity,
    "private": lambda d, _: privacy.span_report(d),
    "shards": lambda d, _: sharding.assign_shards(d, 4),
    "copies": lambda d, _: simhash.near_copies(d),
    "notices": lambda d, _: notices.licence_notices(d),
    "resampled": lambda d, _: resampling.resample(d, d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(docs, labels, name):
    told = OPERATORS[name](docs, labels)
    assert sorted(str(r.doc_id) for r in told.select("doc_id").collect()) == sorted(str(k) for k, _ in ROWS)
    none = OPERATORS[name](docs.limit(0), labels)
    assert none.columns == told.columns and none.count() == 0


def test_defined_results(spark, docs, labels):
    near = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_copies(docs).collect()}
    assert near[2, "0" * 16] == near[3, "0" * 16] == near[4, "0" * 16] == near[None, "0" * 16] == 2  # without words: linked, the least id
    assert [c for (k, fp), c in near.items() if k is None and fp != "0" * 16] == [None]
    long = word_bpe.encode_decode(docs.where("doc_id in (5, 6)"), WORDS)
    library = Tokenizer.from_file(WORDS)
    for r in long.collect():
        ids = library.encode({5: LONG, 6: "x" * 200_000}[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    sizes = {(r.doc_id, r.size): r.text_crc32 for r in sharding.assign_shards(docs, 4).collect()}
    assert sizes[2, 1] == sizes[3, 1] == zlib.crc32(b"") and sizes[6, 200_001] == zlib.crc32(b"x" * 200_000)
    scores = toxicity.toxicity(docs, labels).collect()
    assert all(0 <= r.score <= 1 for r in scores) and len({r.score for r in scores if r.doc_id in (2, 3)}) == 1
    packed = packing.pack_documents(docs, WORDS).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in packed}[2] == 1


def test_packed_rows(docs):
    """Every row is packed as often as it comes, whole and gapless, under its doc_id or null."""
    library, want, got, bins = Tokenizer.from_file(WORDS), Counter(), Counter(), defaultdict(list)
    for k, t in ROWS:
        want[k] += len(library.encode(t or "", add_special_tokens=False).ids) + 1
    for r in packing.pack_documents(docs, WORDS).collect():
        got[r.doc_id] += r.length
        bins[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for parts in bins.values():
        ends = [0, *(o + n for o, n in sorted(parts))]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 4096
    assert packing.pack_documents(docs.limit(0), WORDS).count() == 0
    ids = packing.sequences(packing.pack_documents(docs, WORDS), packing.cut_pieces(docs, WORDS, 4096, 1, keep_ids=True))
    assert sum(len(r.ids) for r in ids.collect()) == sum(want.values())


def test_preference_rows(spark):
    """Nulls in any column, repeated and missing sides, very long turns: a row for each pair with a side."""
    schema = "pair_id long, turn long, role string, text string, segment string, prompt int"
    rows = [(1, 0, "user", LONG), (1, 1, "assistant", None), (1, 1, "assistant", None), (None, None, None, None), (2, 0, None, "x"), (3, 0, "user", "")]
    chosen = spark.createDataFrame([(*r, "s", 1) for r in rows], schema)
    got = preferences.format_preferences(chosen, chosen.where("pair_id = 1")).collect()
    assert {r.pair_id for r in got} == {1, 2, 3, None} and any(LONG in r.prompt for r in got if r.pair_id == 1)
    assert {r.pair_id for r in preferences.format_preferences(chosen.limit(0), chosen).collect()} <= {1, 2, 3, None}


def test_resharded_files_of_odd_rows(spark, docs, tmp_path):
    """All rows go through files and through other capacities as they are, and an empty table makes empty shards."""
    path = str(tmp_path / "odd")
    plain = docs.withColumnRenamed("shard", "own_shard")
    sharding.reshard(spark, path, 3, plain, blocks=16)
    sharding.reshard(spark, path, [5, 1])
    back = sharding.read_shards(spark, path)
    assert Counter(map(tuple, back.drop("shard").collect())) == Counter(map(tuple, plain.collect())) and {r.shard for r in back.collect()} <= {0, 1}
    sharding.reshard(spark, path + "-none", 2, plain.limit(0))
    assert sharding.read_shards(spark, path + "-none").count() == 0 and sharding.read_shards(spark, path + "-none").columns == [*plain.columns, "shard"]


def test_whitened_rows(spark):
    """Nulls, ties, repeated rows and clashing names; no row is left that could not be told."""
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [2.0, 1.0]), (3, None), (4, [None, 1.0]), (5, [0.0, 0.0]), (6, [])]
    table = spark.createDataFrame([(k, v, "x", 1, 2.0) for k, v in rows], "vec_id long, embedding array<float>, x string, n int, deviation double")
    got = whitening.whiten(table).collect()
    assert Counter(r.vec_id for r in got) == {1: 4, None: 2, 5: 2} and all(r.n == 3 for r in got)


def test_classifier_without_a_bound_on_slots():
    texts, marks = ["vile scum here", "a nice day", "vile rot", "fine weather day"] * 5, [1, 0, 1, 0] * 5
    every, few = toxicity.fit(texts, marks, keep=toxicity.Fit(None, 1, 0.0)), toxicity.fit(texts, marks, keep=toxicity.Fit(5))
    _, slots, _ = toxicity.features(texts)
    assert set(every.slots.tolist()) == set(slots.tolist()) and len(few.slots) == 5
